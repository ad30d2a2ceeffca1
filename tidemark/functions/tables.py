"""Table functions for SQL: ``register`` makes the text operators callable in a lateral join."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.operators import content


@udtf(returnType="chunk int, path string, level int, start bigint, stop bigint")
class TextChunks:
    """The chunks of one text, as ``content.chunks`` cuts them; none for null."""

    def eval(self, text: str):
        n = 0
        for path, level, s, e in content.units(text or ""):
            for a, b in content.split_text((text or "")[s:e]):
                yield n, path, level, s + a, s + b
                n += 1


def register(spark: SparkSession) -> None:
    """Makes ``text_chunks(text)`` known to SQL."""
    spark.udtf.register("text_chunks", TextChunks)
