"""What a query asks for, and how well a text answers it.

A query is one string, so its plan is made on the driver: terms, groups of equivalent terms, phrases, intents, question types, index filters and the
time it speaks of. The plan's parts become literals of column expressions that run over any number of texts without leaving the JVM.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values ---------------------------------------------------------------------------------------------------
STOPWORDS = frozenset(
    "the and for with that this what when where which who why how about would likely still considered consider more benchmark context memory conversation dialogue question".split())

#: Terms by what they also stand for: words before the sign share the words after it.
SYNONYMS_TEXT = """
checkout = payment, purchase, order
payment = checkout, purchase, billing
billing, purchase, order = checkout, payment
risk = fraud, score, safety
fraud = risk, score, safety
score = risk, fraud, safety
latest, recent, current, currently, now = updated, update, status
status, state = current, latest, condition
failed, failure, outage = error, incident, down
down, error = failed, failure, outage, incident
dependency, backend = service, system
ticket, followup, follow = support, agent, helpdesk
support, agent, helpdesk = ticket, followup
preference, preferences = likes, setting, choice
setting, choice, likes = preference
want, wants, wanted = prefer, preference, choice
prefer, preferred = want, preference, choice
update, updated, updates = changed, change, modify, replaced
changed, change, modify, replaced = update, updated, switched
switch, switched, switching = changed, moved, replaced
moved, move = switched, changed, relocated
session, sessions = dialogue, conversation, visit
conversation, dialogue, chat = session, message
message, messages = conversation, dialogue, session
user, customer = person, account, member
service = dependency, backend, system
timeline, temporal, history, sequence = before, after, during
before, after, during = timeline, temporal, sequence
schedule, scheduled, reschedule, rescheduled = calendar, appointment, time, date
appointment, meeting, deadline = schedule, calendar, date, time
tomorrow, tonight, morning, afternoon, evening = time, date
many, count, number, quantity = total, amount
total, amount = count, number, quantity
multi, hop, reasoning = related, connection, because
why, because, reason = cause, root, explain, problem
cause, root = because, reason, incident, problem
problem, issue = incident, failure, resolved, cause
resolved, fixed = recovered, solved, closed
recovered, recovery, solved, closed = resolved, fixed
where, location, located = place, city, office, work
office, work, workplace = location, place, job
when, date, time = timeline, temporal, session
who, person, people = user, customer, member
roommate, housemate = person, friend, contact
manager, supervisor, lead = owner, responsible, contact
name, named, called = alias, known
pet, dog, cat = animal, name
friend, coworker, colleague, teammate = person, contact
recommend, recommended, suggest, suggested = introduced, referred, because
introduced, referred = recommended, suggested
travel, trip, flight = itinerary, journey, airport
remember, recall, remind = mentioned, said, told, note
medication, medicine, meds, prescription = pill, pharmacy, doctor
doctor, physician, clinic = visit, medical, medication
snack, meal = food, preference
gift, present = birthday, surprise, preference
allergy, allergic, avoid = restriction, food, without
correction, corrected, correct = changed, updated, replaced
backup, contact = owner, person, responsible
cancel, cancelled, canceled = stopped, dropped, no longer
identity = transgender, woman, community
transgender = identity, lgbtq, community
relationship = single, dating, married, status
research, researched = looked, adoption, agencies
adoption, agencies = research, interviews
field, fields, education, educaton, pursue, career = counseling, counselor, psychology, mental, health, certification
counseling, counselor, psychology = career, field, mental, health
interested, interest = likes, enjoys, prefer, outdoors
outdoors, camping, park = national, nature, outside
ally, supportive = support, community, transgender, lgbtq
bookshelf, books, book = collects, classic, children, reading
writing, reading = books, author, career, counselor
"""
SYNONYMS = {w.strip(): [x.strip() for x in b.split(",")] for a, b in (line.split("=") for line in SYNONYMS_TEXT.strip().splitlines()) for w in a.split(",")}

#: Intents by the terms that show them.
INTENT_TERMS = {
    "latest": "latest recent current currently now updated update status",
    "temporal": "before after during timeline temporal history when",
    "after": "after",
    "before": "before",
    "correction": "correction corrected correct changed updated now avoid",
    "reminder": "remember recall remind reminder said told",
    "contrast": "switch switched switching changed change moved move became instead cancel cancelled canceled",
    "social": "friend coworker colleague teammate recommend recommended suggest suggested introduced referred because who",
    "schedule": "when date time schedule scheduled reschedule rescheduled appointment meeting deadline calendar tomorrow tonight",
    "quantity": "many count number quantity total amount score percent percentage",
    "alias": "roommate housemate manager supervisor lead owner name named called pet dog cat",
}
#: What a text that answers an intent says, and what that is worth; in the order of scoring.
INTENT_MARKS = [
    ("latest", "latest|recent|current|updated|changed|replaced", 75),
    ("temporal", "timeline|temporal|history|sequence|before|after|during", 50),
    ("after", "after|later|latest|new|current|update|moved to", 65),
    ("after", "before|earlier|old", -25),
    ("before", "before|earlier|old", 65),
    ("before", "after|later|latest|new|current", -25),
    ("correction", "correction|corrected|no longer|instead|replaced|now", 90),
    ("reminder", "remember|reminder|mentioned|said|told|note", 70),
    ("contrast", "switched|switch|moved|became|instead|no longer|changed from", 85),
    ("social", "recommended|suggested|introduced|referred|because|from", 80),
    ("schedule", "rescheduled|scheduled|moved to|appointment|deadline|calendar|at |on ", 80),
    ("quantity", "count|total|number|score|amount|quantity", 80),
    ("alias", "roommate|manager|owner|named|called|pet|dog|cat", 75),
]
TOPIC, ALL_GROUPS, EACH_GROUP, PHRASE = 1_000, 100, 12, 50
#: Index filters by what asks for them; a group is alternatives.
INTENT_FILTERS = [
    (("latest", "correction"), [["event_type:correction", "event_type:status_update"], ["status:current", "status:observed"], ["segment_topic:correction"]]),
    (("social",), [["entity_type:person", "entity_type:social_link", "entity_type:relationship"]]),
    (("schedule",), [["entity_type:date", "event_type:schedule", "event_type:deadline"]]),
    (("quantity",), [["entity_type:quantity", "entity_type:amount", "event_type:measurement"]]),
    (("temporal", "before", "after"), [["event_type:timeline", "event_time_bucket:query_range"]]),
]
PLACE_TERMS, PLACE_FILTER = frozenset("where location located office workplace work".split()), ["entity_type:location", "entity_type:job_status"]
CAUSE_TERMS = frozenset("why because cause root".split())
LEXICAL_TERMS = 8
#: Question types of the serving side by the words that show them, first match first.
KINDS = [
    ("benchmark_quality", r"benchmark|workload|latency|p50|p90|p95|p99|throughput|qps|ops/s|req/s|hit[- ]?rate|read[- ]?hit|quality|recall|precision|locomo|longmemeval|memory[- ]?quality"),
    ("multi_hop", r"both|together|across|between|compare|combine|sessions|multi-hop|multi session|multi-session|cross session|cross-session|previous sessions|other sessions"),
    ("date", r"when|what date|which date|day|month|year|yesterday|tomorrow|last week|next week|before|after|as of|valid as of"),
    ("current_state", r"current|currently|latest|now|still|today|valid|status|preference|prefer|likes|where does|where is|goal|task|requirement"),
    ("why_emotion", r"why|reason|because|feel|felt|emotion|happy|sad|angry|worried|excited"),
    ("broad_exploration", r"overview|summarize|summary|explore|broad|what is in|what do we know|topics|map|inventory"),
    ("evidence", r"evidence|quote|exactly|what did .* say|conversation|dialogue|message"),
    ("procedure", r"procedure|steps?|how to|troubleshoot|debug|rollback|runbook|playbook|checklist|fix|remediate|mitigate"),
]
#: Time windows by the words that show them, first match first.
WINDOWS = [
    ("latest", r"current|currently|latest|now|still|today|valid"), ("before", r"before|prior to|earlier than"), ("after", r"after|since|later than"), ("valid_as_of", r"as of|valid as of|on"),
    ("relative", r"yesterday|tomorrow|last week|next week|last month|next month|last year|next year"),
]
#: A prompt that leans on what was said before: it refers back, goes on, or is short and opens like an answer.
REFERS = r"(?i)\b(that|it|this|those|these|they|them|its|their|there|the ones?|the two|the same|the fix|the change|the issue|the above|the whole)\b"
CONTINUES = r"(?i)^\s*(and|so|then|also|but|plus|why|what about|whats?\s+about|ok|okay)\b"
GOES_ON = r"(?i)^\s*(summariz|recap|tl;?dr|continue|elaborat|expand|go on|tell me more|more on|and\b)"
SHORT_WORDS, REWRITE_TURNS, REWRITE_CHARS = 14, 3, 600
STAGES = ["query_understanding", "scope_filter", "secondary_index_prefilter", "node_traversal", "leaf_candidate_fetch", "scoring", "budget_pack"]


def stem(word: str) -> str | None:
    """The word without its plural ending, None where it has none."""
    for ending, least, new in (("ies", 5, "y"), ("es", 5, ""), ("s", 4, "")):
        if word.endswith(ending) and len(word) >= least:
            return word[: -len(ending)] + new
    return None


@dataclass
class Plan:
    """A query's parts; ``groups`` are alternatives for one term each."""

    terms: list[str]
    groups: list[list[str]]
    phrases: list[str]
    topic: str | None
    intents: set[str] = field(default_factory=set)

    @property
    def question_type(self) -> str:
        """What the workflow side takes the question for."""
        asks = lambda *names: not self.intents.isdisjoint(names)
        if not self.terms:
            return "match_all"
        ladder = [
            ("current_state", asks("correction", "latest", "contrast")), ("temporal_reasoning", asks("temporal", "before", "after", "schedule")), ("quantity", asks("quantity")),
            ("relationship", asks("social")), ("identity_or_alias", asks("alias")), ("causal_reasoning", not CAUSE_TERMS.isdisjoint(self.terms)),
        ]
        return next((name for name, yes in ladder if yes), "semantic_recall")

    @property
    def filter_groups(self) -> list[list[str]]:
        """Index terms that candidates should carry: alternatives within a group, groups in order. Without an intent, the terms themselves."""
        groups = [g for names, found in INTENT_FILTERS if not self.intents.isdisjoint(names) for g in found]
        if not PLACE_TERMS.isdisjoint(self.terms):
            groups.append(PLACE_FILTER)
        return sorted({tuple(g): g for g in groups or [[f"query_term:{t}" for t in self.terms[:LEXICAL_TERMS]] or ["query_term:*"]]}.values())


def plan(query: str) -> Plan:
    """The plan of a query. Terms are runs of ASCII letters and digits, lower-cased, of three letters or more and no stopwords, repeats included."""
    words = [w for w in re.split(r"[^0-9A-Za-z]+", query) if w]
    words = [w.lower() for w in words]
    terms = [w for w in words if len(w) >= 3 and w not in STOPWORDS]
    groups = [sorted({t, *([stem(t)] if stem(t) else []), *SYNONYMS.get(t, [])}) for t in terms]
    topic = next((f"topic {b}" for a, b in zip(words, words[1:]) if a == "topic" and b.isdigit()), None)
    shown = {name for name, marks in INTENT_TERMS.items() if not set(marks.split()).isdisjoint(terms)}
    return Plan(terms, groups, [f"{a} {b}" for a, b in zip(terms, terms[1:])], topic, shown)


def kind_of_question(query: str) -> str:
    """What the serving side takes the question for."""
    return next((name for name, p in KINDS if re.search(rf"\b({p})\b", query.lower())), "fact")


def time_window(query: str, question_type: str, reference_ms: int) -> dict:
    """``mode, valid_as_of, reference_time_ms`` of the time a query speaks of."""
    mode = "latest" if question_type == "current_state" else next((name for name, p in WINDOWS if re.search(rf"\b({p})\b", query.lower())), "unbounded")
    return {"mode": mode, "valid_as_of": {"latest": "now", "unbounded": "not_applicable"}.get(mode, "query_inferred"), "reference_time_ms": reference_ms}


def structured(query: str, reference_ms: int) -> dict:
    """The whole plan as plain values: kind, filters by field, how groups combine, time window and the order of the stages."""
    p, kind = plan(query), kind_of_question(query)
    fields: dict[str, list[str]] = {}
    for name, _, value in (t.partition(":") for g in p.filter_groups for t in g):
        fields[name] = [*fields.get(name, []), *([value] if value not in fields.get(name, []) else [])]
    return {
        "query_type": kind, "filters": fields, "filter_groups": p.filter_groups, "filter_mode": "all_of_one" if len(p.filter_groups) == 1 else "any_group", "time_window": time_window(query, kind, reference_ms), "stages": STAGES,
    }


class Text:
    """A text column made ready for matching: ASCII letters small, and once more with all but ASCII letters and digits as spaces."""

    def __init__(self, text: Column):
        self.small = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
        self.plain = F.regexp_replace(self.small, "[^a-z0-9]", " ")

    def has(self, term: str) -> Column:
        flat = re.sub("[^a-z0-9]", " ", term.lower()).strip()
        found = self.small.contains(term)
        return found if not flat or flat == term and " " not in flat else found | self.plain.contains(flat)

    def any(self, terms: list[str]) -> Column:
        return reduce(lambda a, b: a | b, map(self.has, terms))


def matches(text: Column, p: Plan) -> Column:
    """Whether a text may answer: it names the topic, or the query has no terms, or a group has a term in it. Null texts do not."""
    t = Text(text)
    tests = ([t.has(p.topic)] if p.topic else []) + ([t.any([x for g in p.groups for x in g])] if p.groups else [F.lit(True)])
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def relevance(text: Column, p: Plan) -> Column:
    """How well a text answers, INT from 0: the topic, the longest match of every group, all or several groups, phrases, and what the intents look for.
    0 for a query without terms and for null texts."""
    if not p.groups:
        return F.lit(0)
    t = Text(text)
    score = F.when(t.has(p.topic), TOPIC).otherwise(0) if p.topic else F.lit(0)
    best = [reduce(F.greatest, [F.when(t.has(x), len(x)).otherwise(0) for x in g]) if len(g) > 1 else F.when(t.has(g[0]), len(g[0])).otherwise(0) for g in p.groups]
    hit = reduce(lambda a, b: a + b, [F.when(b > 0, 1).otherwise(0) for b in best])
    score = reduce(lambda a, b: a + b, best, score) + F.when(hit == len(best), ALL_GROUPS).when(hit > 1, hit * EACH_GROUP).otherwise(0)
    for phrase in p.phrases:
        score = score + F.when(t.has(phrase), PHRASE).otherwise(0)
    for intent, marks, worth in INTENT_MARKS:
        if intent in p.intents:
            seen = t.any(marks.split("|"))
            seen = seen | t.small.rlike("[0-9]") if intent == "quantity" else seen
            more = F.when(seen, worth).otherwise(0)
            score = score + more if worth > 0 else F.greatest(score + more, F.lit(0))
    return F.coalesce(score, F.lit(0))


# -- the same for a column of queries -----------------------------------------------------------------------------------
def terms_of(text: Column) -> Column:
    """The terms of every query, as :func:`plan` takes them."""
    words = F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), "[^0-9a-z]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(sorted(STOPWORDS)))


def question_types(text: Column) -> Column:
    """``Plan.question_type`` of every query; null for a null query."""
    terms = terms_of(text)
    shows = lambda words: F.arrays_overlap(terms, F.array(*(F.lit(w) for w in sorted(words))))
    asks = lambda *names: shows({w for n in names for w in INTENT_TERMS[n].split()})
    return (
        F.when(text.isNull(), None).when(F.size(terms) == 0, "match_all").when(asks("correction", "latest", "contrast"), "current_state").when(asks("temporal", "before", "after", "schedule"), "temporal_reasoning")
        .when(asks("quantity"), "quantity").when(asks("social"), "relationship").when(asks("alias"), "identity_or_alias").when(shows(CAUSE_TERMS), "causal_reasoning").otherwise("semantic_recall"))


def _by_words(text: Column, table: list[tuple[str, str]], rest: str) -> Column:
    out = F.when(text.isNull(), None)
    for name, words in table:
        out = out.when(F.lower(text).rlike(rf"\b({words})\b"), name)
    return out.otherwise(rest)


def kinds_of_questions(text: Column) -> Column:
    """:func:`kind_of_question` of every query; null for a null query."""
    return _by_words(text, KINDS, "fact")


def time_modes(text: Column) -> Column:
    """The mode of :func:`time_window` of every query; null for a null query."""
    return F.when(kinds_of_questions(text) == "current_state", "latest").otherwise(_by_words(text, WINDOWS, "unbounded"))


def leans_on_thread(text: Column) -> Column:
    """Whether a prompt refers to what was said before."""
    short = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) <= SHORT_WORDS
    return F.coalesce((F.trim(text) != "") & (text.rlike(REFERS) | text.rlike(GOES_ON) | (short & text.rlike(CONTINUES))), F.lit(False))
