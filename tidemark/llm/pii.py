"""Personal data in free text: found by anchor expansion and replaced by typed placeholders.

One Aho-Corasick pass over the lower-cased text of a whole Arrow batch finds the anchors: at-signs and their spelled-out forms,
street words and cues that introduce or follow a person. Digit groups are the anchors of phone and identity numbers. At each anchor
a deterministic parser expands to the item's bounds and validates it; a candidate that fails is dropped. Expansion goes as far as the
characters or words of the item go and stops at the first that does not fit, so no length is cut. Everything happens within a row, so there
is no shuffle and no state.

A person is found by what introduces the name (an introduction, a title, a label, thanks, a signature), by what follows it (a verb of
saying or doing, a mail address in angle brackets), or, in capitals, by a common given name. A rarer name that nothing announces is missed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "id_number", "phone", "address", "name"]  # what comes first wins where items overlap
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_S = r"[ \t\u00a0]{1,3}"  # the gap between the parts of one item

# -- emails ---------------------------------------------------------------------------------------------------------
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.+%'-")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}\b")
_SPELLED_DOMAIN = re.compile(rf"{_S}[A-Za-z0-9-]+(?:{_S}(?:\[dot\]|\(dot\)|\{{dot\}}|dot){_S}[A-Za-z0-9-]+)+", re.I | re.ASCII)
_DOT_BEFORE = re.compile(rf"[\w+-]{_S}(?:\[dot\]|\(dot\)|\{{dot\}}|dot){_S}$", re.I | re.ASCII)
_GAPS = " \t\u00a0"

# -- numbers --------------------------------------------------------------------------------------------------------
_ID = rf"(?P<id>\d{{3}}(?P<is>-|{_S})\d{{2}}(?P=is)\d{{4}}|[A-Za-z]{{2}}(?:{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}|\d{{6}})[A-Da-d]|[A-Za-z]{{2}}\d{{7}})"
_PHONE = (
    rf"(?P<phone>\+\d{{10,14}}|\+\d{{1,3}}(?:{_S}|-)(?:\(\d{{2,4}}\){_S}?|\d{{2,5}}(?:{_S}|[-.]))\d{{3,8}}(?:(?:{_S}|[-.])\d{{2,6}}){{0,2}}"
    rf"|(?:1(?:[-.]|{_S}))?(?:\(\d{{3}}\){_S}?|\d{{3}}(?:[-.]|{_S}))\d{{3}}(?:[-.]|{_S})\d{{4}}|0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{4}}|0\d{{4}}{_S}\d{{6}}|0\d{{2,4}}[-/]\d{{5,8}})"
)
_NUMBER = re.compile(rf"(?<![\w.:=@/+-])(?:{_ID}|{_PHONE})(?![\w@:/]|[.-]\d)|(?<=[:=|/])(?:(?<=tel:)|(?<=phone=)|(?<=[|])|(?<=id=))(?:{_ID.replace('<id>', '<id2>').replace('<is>', '<is2>').replace('(?P=is)', '(?P=is2)')}|{_PHONE.replace('<phone>', '<phone2>')})(?![\w@:/]|[.-]\d)")

# -- addresses (fixed values) -----------------------------------------------------------------------------------------
STREET_EN = [
    "street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "dr", "terrace", "close", "way", "court", "ct", "place", "boulevard", "blvd", "square", "crescent", "row",
]
STREET_DE = ["straße", "strasse", "weg", "gasse", "platz", "allee", "damm", "ufer"]
STREET_ES = ["calle", "avenida", "paseo", "plaza", "camino", "ronda", "travesía", "carrera"]
#: Street words that make an address in lower case too (fixed values).
STREET_LOWER = frozenset("street avenue boulevard road lane drive terrace crescent".split())
_PROPER = r"(?:[A-ZÄÖÜÁÉÍÓÚÑ][\w'’-]*)"
_BEFORE_EN = re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?{_S}(?:{_PROPER}{_S}){{1,5}}$")
_BEFORE_EN_LOWER = re.compile(rf"(?<![\w.-])\d{{1,5}}[a-z]?{_S}((?:[^\W\d_][^\W\d_'’-]*{_S}){{1,3}})$")
_HOUSE = re.compile(rf",?{_S}\d{{1,5}}(?:[A-Za-z]\b|\b)")
_REST_ES = re.compile(rf"(?:{_S}(?:de(?:l|{_S}la|{_S}los|{_S}las)?|la|el|los|las|y)\b)?(?:{_S}(?:(?:de|del|la|y){_S})?{_PROPER}){{1,4}},?{_S}(?:n[.º°]{_S}?)?\d{{1,5}}(?:[A-Za-z]\b|\b)", re.I)

# -- names (fixed values) ---------------------------------------------------------------------------------------------
INTRODUCE = "my name is|name is|i am|i'm|this is|call me|mein name ist|ich bin|ich heiße|me llamo|mi nombre es|soy".split("|")
REACH = "contact|contact:|please call|call|ask|ask for|wake|page|meet|met|email|tell|c/o|attn|attn:|bitte an|llame a|pregunte por|fragen sie".split("|")
#: Cues that are followed by other words too: the name must be in capitals.
WEAK = frozenset("call|page|email|tell|meet|this is|call me|ask for|given to|sent by".split("|"))
CREDIT = (
    "according to|thanks to|handed to|assigned to|given to|belongs to|number for|said he was|said she was|said they were|holder|signed by|written by|approved by|reviewed by|"
    "reported by|requested by|prepared by|sent by"
).split("|")
CLOSE = "yours,|regards,|sincerely,|cheers,|saludos,|grüße,|gruß,".split("|")
TITLES = "dr mr mrs ms prof herr frau señor señora".split()
LABELS = "owner user name author assignee contact customer patient holder reviewer caller".split()
PAPERS = "invoice receipt bill parcel letter order".split()
#: What a person does right after being named.
DOES = (
    "signed|reviewed|approved|asked|wants|wrote|said|says|called|replied|confirmed|reported|explained|answered|complained|lives|came|agreed|promised|thinks|told"
).split("|")
#: Of these, acts that name the person who did them in small letters too.
FORMAL = frozenset("signed reviewed approved wrote".split())
#: Given names that name a person without any cue, where a capitalised surname follows.
GIVEN = frozenset(
    "adam aisha alan alejandro alexander alice amanda amelia andrea andreas andrew angela anita anna anne antonio arthur barbara beatrice benjamin bernd brian bruno carlos carmen "
    "caroline catherine charles christian christina christopher clara claudia daniel daniela david deborah diego dmitri edward elena elizabeth emily emma eric eva fatima felix fernando "
    "francisco franz frederick gabriel george gerhard hannah hans harry heinrich helen helga henry ibrahim ines ingrid isabel jacob james jan javier jennifer jessica joan johann john "
    "jonas jorge jose joseph juan julia jürgen karen karin karl katharina kevin klaus laura lena linda louise lucia luis lukas manuel maria marie marta martin matthew mehmet michael miguel "
    "mohammed monica natalia nicole nina olga oliver oscar pablo patricia paul pedro peter petra philip priya rachel raj rebecca richard robert rosa ruth samuel sandra sarah sebastian "
    "sergei sofia sophie stefan stephen steven susan sven teresa thomas ursula victor walter werner wilhelm william wolfgang yuki yusuf".split())
#: Words that are no part of a person's name.
NO_NAME = frozenset(
    "the a an this that these those my your his her its our their you he she it we they i is are was were be to of in on at by for from with and or but not no all each every any some "
    "who what which when where why how if so then there here now up down out off over again please also still very just only both two one der die das ein eine und oder nicht el la los las un una y o que se "
    "really too quite almost always never already soon today tomorrow yesterday glad happy sorry sure tired done ready able afraid going about back home new old good bad "
    "team teams group department service services support office company bank board committee council university school hospital quality assurance management system systems data customer "
    "bridge station park river lake hall tower airport city county street road avenue lane square north south east west inc ltd llc gmbh corp".split())
_L = r"[^\W\d_]"
_STYLES = [  # capitalised, upper case, lower case; particles like O' and hyphens belong to the word
    (rf"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*", r"[A-Z]\."),
    (r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]*[A-ZÀ-ÖØ-Þ]", r"[A-Z]\."),
    (r"[a-zß-öø-ÿ][a-zß-öø-ÿ'’-]*[a-zß-öø-ÿ]", r"[a-zA-Z]\."),
]
_FORMS = "|".join(rf"(?:{w}|{i}){_S}(?:{i}{_S})?{w}(?![\w'’-])|{w},{_S}(?:{w}(?![\w'’.-]\w)(?:{_S}{i})?|{i})" for w, i in _STYLES)
_NAME = re.compile(rf"(?:{_FORMS})")
_NAME_END = re.compile(rf"(?<![\w'’.-])(?:{_FORMS})$")
_AND = re.compile(rf"{_S}(?:and|und|y|&){_S}")
_FOR = re.compile(rf"{_S}(?:for|of|belongs to|holder){_S}")
_AFTER_TITLE = re.compile(r"(?:dr|mr|mrs|ms|prof)\.?[ \t]+", re.I)
_PAPER = re.compile(r"[\w -]+: ")
_CELL = re.compile(r"\|[ \t]?(?:[+(]?\d|[\w.+%'-]+@)")
_ANGLE = re.compile(r"[\w.+%'-]+@")
_SAINT = re.compile(r"(?:san|santa|saint|st\.?)[ \t]+$", re.I)
_OPENERS = frozenset(".!?:;|>\n\x00\"“„(\ufeff")
_LED = re.compile(r"[ \t]+[a-zß-öø-ÿ]|[^\w \t]|$|[ \t]+[^\w \t]")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}

    def put(pattern: str, *what) -> None:
        entries.setdefault(pattern, []).append(what)

    put("@", "at")
    for x in ("[at]", "(at)", "{at}", " at", "\tat", "\u00a0at"):
        put(x, "spelled")
    for x in STREET_EN:
        put(f" {x}", "street")
    for x in STREET_DE:
        put(x, "strasse")
    for x in STREET_ES:
        put(f"{x} ", "calle")
    for x in (*INTRODUCE, *REACH, *CREDIT, *CLOSE):
        put(f"{x} ", "weak" if x in WEAK else "before")
    for x in TITLES:
        put(f"{x} ", "before")
        put(f"{x}. ", "before")
    for x in LABELS:
        for sep in (" = ", "=", ": ", '": "'):
            put(x + sep, "before")
    put("|", "cell")
    for x in PAPERS:
        put(f"{x} for ", "paper")
    for x in DOES:
        put(f" {x} ", "after")
    for x in ('" is ', '" was '):
        put(x, "after")
    put(" <", "angle")
    for x in GIVEN:
        put(x, "given")
    for pattern, what in entries.items():
        a.add_word(pattern, (len(pattern), tuple(w[0] for w in what)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Finds the items of many texts at once."""

    def __init__(self) -> None:
        self.anchors = _automaton()

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items of each text, in order, without overlaps."""
        gap = "\n\x00\n"
        joined = gap.join(t or "" for t in texts)
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += len(t or "") + len(gap)
        spans = self._scan(joined)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        taken: list[tuple[int, int, str]] = []
        # per kind, then by place; a longer item wins over a shorter one that starts with it
        for kind in KINDS:
            mine = sorted((s, -e) for s, e, k in spans if k == kind)
            good, end = [], -1
            for s, e in mine:
                if s >= end:
                    good.append((s, -e, kind))
                    end = -e
            taken = _merge(taken, good)
        for s, e, k in taken:
            d = bisect_right(starts, s) - 1
            out[d].append((s - starts[d], e - starts[d], k))
        return out

    def _scan(self, text: str) -> set[tuple[int, int, str]]:
        low = _lower(text)
        found: set[tuple[int, int, str]] = set()
        no_paper = 0  # up to here no colon ends a paper's subject
        for m in _NUMBER.finditer(text):
            kind = "id_number" if m["id"] or m["id2"] else "phone"
            s, e = m.span()
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            found.add((s, e, kind))
            if kind == "id_number" and (f := _FOR.match(text, e)):
                self._name_at(text, f.end(), found)
        for last, (length, kinds) in self.anchors.iter(low):
            begin, end = last + 1 - length, last + 1
            for kind in kinds:
                if kind in ("before", "weak"):
                    if begin and low[begin].isalpha() and low[begin - 1].isalnum() or kind == "weak" and not text[end : end + 1].isupper():
                        continue
                    self._name_at(text, end, found)
                elif kind == "cell":
                    self._name_at(text, end, found, cell=True)
                elif kind == "after":
                    self._name_before(text, begin, found, low[begin + 1 : end - 1] if low[begin] == " " else "")
                elif kind == "angle":
                    if _ANGLE.match(text, end):
                        self._name_before(text, begin, found)
                elif kind == "given":
                    self._given(text, begin, end, found)
                elif kind == "street":
                    self._street(text, begin, end, found)
                elif kind == "at":
                    start = self._local(text, begin)
                    if start is not None and (right := _DOMAIN.match(text, end)):
                        found.add((start, right.end(), "email"))
                elif kind == "spelled":
                    if right := _SPELLED_DOMAIN.match(text, end):
                        gap = begin + 1 if text[begin] in _GAPS else begin
                        while gap > 0 and text[gap - 1] in _GAPS:
                            gap -= 1
                        start = self._local(text, gap) if gap < begin + (text[begin] in _GAPS) else None
                        while start is not None and (m := _DOT_BEFORE.search(text, self._words_back(text, start, 2), start)) and (more := self._local(text, m.start() + 1)) is not None:
                            start = more
                        if start is not None and (start == 0 or not text[start - 1].isalnum()):
                            found.add((start, right.end(), "email"))
                elif kind == "strasse":
                    at = begin
                    while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
                        at -= 1
                    while at < begin and not text[at].isalpha():
                        at += 1
                    if at < begin and text[at].isupper() and (h := _HOUSE.match(text, end)):
                        found.add((at, h.end(), "address"))
                elif kind == "calle":
                    if (not begin or not low[begin - 1].isalnum()) and (h := _REST_ES.match(text, end - 1)):
                        found.add((begin, h.end(), "address"))
                elif kind == "paper" and end >= no_paper:
                    if m := _PAPER.match(text, end):
                        self._name_at(text, m.end(), found)
                    else:
                        no_paper = end
                        while no_paper < len(text) and (text[no_paper].isalnum() or text[no_paper] in "_ -"):
                            no_paper += 1
        return found

    @staticmethod
    def _local(text: str, end: int) -> int | None:
        """Where the local part of an address that ends at ``end`` begins; None if there is none."""
        at = end
        while at and text[at - 1] in _LOCAL:
            at -= 1
        while at < end and text[at] not in _ALNUM:
            at += 1
        return at if at < end and (text[end - 1] in _ALNUM or text[end - 1] in "_+-") else None

    @staticmethod
    def _words_back(text: str, end: int, n: int) -> int:
        """Where the last ``n`` words on the line before ``end`` begin."""
        at = end
        for _ in range(n):
            while at and text[at - 1] in _GAPS:
                at -= 1
            if not at or text[at - 1].isspace():
                break
            while at and not text[at - 1].isspace() and text[at - 1] not in _GAPS:
                at -= 1
        return at

    def _street(self, text: str, begin: int, end: int, found: set) -> None:
        if end < len(text) and (text[end].isalnum() or text[end] in "'’-" and text[end + 1 : end + 2].isalpha()):
            return
        word = text[begin + 1 : end]
        first = self._words_back(text, begin, 6)
        if word[0].isupper():
            if m := _BEFORE_EN.search(text, first, begin + 1):
                found.add((m.start(), end, "address"))
        elif word in STREET_LOWER and (m := _BEFORE_EN_LOWER.search(text, first, begin + 1)):
            if not any(w.lower() in NO_NAME or w in STREET_LOWER or w.endswith("s") for w in m[1].split()):
                found.add((m.start(), end, "address"))

    @staticmethod
    def _in_small(text: str, start: int, name: str, verb: str, end: int) -> bool:
        """Whether small letters before a verb are a name: of a common given name, or before a formal act that opens a sentence or has an object."""
        if not GIVEN.isdisjoint(re.split(r"[\s,]+", name)):
            return True
        while start and text[start - 1] in _GAPS:
            start -= 1
        return verb in FORMAL and (not start or text[start - 1] in _OPENERS or text.startswith(" the ", end + len(verb) + 1))

    def _name_before(self, text: str, end: int, found: set, verb: str = "") -> None:
        if m := _NAME_END.search(text, self._words_back(text, end, 4), end):
            if verb and m[0][0].islower() and not self._in_small(text, m.start(), m[0], verb, end):
                return
            t = _AFTER_TITLE.match(text, m.start())
            if not t or (m := _NAME.fullmatch(text, t.end(), m.end())):
                self._add_name(text, m.start(), m.end(), found)

    def _given(self, text: str, begin: int, end: int, found: set) -> None:
        """A known given name in capitals, before its surname or after it and a comma."""
        if not text[begin].isupper() or begin and (text[begin - 1].isalnum() or text[begin - 1] in "'’-@._/") or text[end : end + 1].isalnum():
            return
        if _SAINT.search(text, self._words_back(text, begin, 1), begin):
            return
        if (m := _NAME.match(text, begin)) and m.end() > end and text[end] != ",":
            self._add_name(text, begin, m.end(), found)
        elif text[begin - 2 : begin] == ", " and (m := _NAME.match(text, self._words_back(text, begin, 1))) and m.end() >= end:
            self._add_name(text, m.start(), m.end(), found)

    def _name_at(self, text: str, at: int, found: set, cell: bool = False) -> None:
        if t := _AFTER_TITLE.match(text, at):
            at = t.end()
        m = _NAME.match(text, at)
        if not m or cell and not _CELL.match(text, m.end()):
            return
        if not self._add_name(text, m.start(), m.end(), found):
            return
        if a := _AND.match(text, m.end()):
            n = _NAME.match(text, a.end())
            if n and (_LED.match(text, n.end()) if n[0][:1].isupper() else text[n.end() : n.end() + 7].lower().startswith((" about ", ".", ",", ";"))):
                self._add_name(text, n.start(), n.end(), found)

    @staticmethod
    def _add_name(text: str, s: int, e: int, found: set) -> bool:
        words = [w.strip(".,").lower() for w in text[s:e].split()]
        if any(len(w) > 1 and w in NO_NAME for w in words) or "@" in text[e : e + 1]:
            return False
        found.add((s, e, "name"))
        return True


def _merge(taken: list, good: list) -> list:
    """Both lists by place, without the items of ``good`` that overlap an item of ``taken``."""
    ends = [e for _, e, _ in taken]
    keep = []
    for s, e, k in good:
        i = bisect_right(ends, s)
        if i == len(taken) or taken[i][0] >= e:
            keep.append((s, e, k))
    return sorted([*taken, *keep])


def _slices(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about a million characters."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size < 1_000_000):
            size += len(texts[stop] or "")
            stop += 1
        yield at, stop
        at = stop


def find_items(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Distinct ``row_id, kind, surface`` of the personal data in ``text``; kinds as in ``KINDS``, surface as it stands.

    Null and empty texts hold nothing; texts are read whole, however long; rows repeated in the table are reported per row.
    ``row_id`` (BIGINT) may be null. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for a, b in _slices(texts):
                for i, spans in enumerate(finder.find(texts[a:b]), a):
                    rows += [(ids[i], k, x) for k, x in dict.fromkeys((k, texts[i][s:e]) for s, e, k in spans)]
            if rows:
                r, k, x = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(k), pa.array(x)], names=["row_id", "kind", "surface"])

    return df.select(F.col(row_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "row_id bigint, kind string, surface string")


def redact(df: DataFrame, text: str, placeholders: dict[str, str] | None = None) -> DataFrame:
    """``df`` with every item of ``text`` replaced by its kind's placeholder; everything else, null texts included, is unchanged."""
    marks = {**PLACEHOLDERS, **(placeholders or {})}
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in _slices(texts):
                for i, spans in enumerate(finder.find(texts[a:b]), a):
                    if spans:
                        t, out, last = texts[i], [], 0
                        for s, e, k in spans:
                            out += [t[last:s], marks[k]]
                            last = e
                        texts[i] = "".join([*out, t[last:]])
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return df.mapInArrow(run, df.schema)
