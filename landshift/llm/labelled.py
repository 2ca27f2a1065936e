"""Labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.session import materialize


def held_out(doc_id: Column) -> Column:
    """One row in five is never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): ids that are null or carry no label are left out; of contradicting labels the larger counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, label) of every labelled document.

    Labels grow with the corpus, so both sides are shuffled at every size and the work grows like the input; the labels,
    one row per id, are hashed, and no text is sorted.
    """
    known = materialize(_known(labels, label), f"labels-{label}")
    return docs.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id").select("text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled ids, chosen by a hash of the id.

    The chosen ids are at most ``bound`` rows, which bounds the broadcast.
    """
    chosen = _known(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(texts.select("text", "label"), f"labelled-{label}")
