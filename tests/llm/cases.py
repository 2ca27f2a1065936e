"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) + str(draw.randrange(vocabulary)) for _ in range(n)]


def docs(spark: SparkSession, texts: dict[int | None, str | None] | list[tuple]) -> DataFrame:
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", len(t or "")) for i, t in rows], DOCS)


def odd_rows(seed: int = 1) -> list[tuple]:
    """Rows that every operator has to take: the same text twice, a repeated row, nulls and blanks."""
    base = " ".join(prose(seed, 120))
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (None, base), (None, None),
        (7, "x" * 200_000), (8, " ".join(prose(seed + 1, 6_000))), (9, "Straße été 😀 naïve " + base), (-4, "a"),
    ]


def clashing(frame: DataFrame) -> DataFrame:
    """Extra columns whose names the operators also use inside or return."""
    names = (
        "score", "predicted", "held_out", "size", "target", "taken", "shard", "slot", "owner", "label", "key", "rep", "hash", "place", "head",
        "component_id", "kept", "n_shingles", "spans", "edits", "item_id", "start", "stop", "bucket", "weight", "term", "part",
    )
    return frame.withColumns({n: F.lit("clash") for n in names})


def empty(frame: DataFrame) -> DataFrame:
    return frame.where("false")
