"""Mixing sources to target weights by capped water-filling.

All sources together get ``share`` times the words there are. A source's target is its
weight times a common rate, at most ``max_epochs`` times its size; what a full source
cannot take raises the rate of the others, until no target is above its ceiling. The
set of full sources follows from the rate alone and only grows, so each round is one
small aggregate over the table of sources and nothing but the rate returns.

Within a source a target is so many whole repetitions plus a rest. The rest goes to
the documents in the order of a seeded digest: digests fall into ``BUCKETS`` slices,
slices before the one where the rest runs out are taken whole, documents in that slice
take an equal fraction of their words. Sizes are summed per slice before they are
shuffled, and the slice is looked for among 256 groups of 256 slices, so a source with a
third of all rows costs no task more than a few hundred rows.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source
like any other (last in order); documents that repeat are mixed one by one, by their own
doc_id, and rows that share a doc_id share their fate; an empty table gives an empty result.
Columns of the input beside doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.operators.skew import rank_within
from landshift.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 65_536


def cycled(ordinal: Column, size: Column, cycle: tuple[int, ...]) -> Column:
    """Weights repeat along the order of sources."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(ordinal - 1, F.lit(len(cycle))) + 1).cast("int"))


def source_targets(
    sources: DataFrame, weigh: Callable[[Column, Column], Column], share: float, max_epochs: float
) -> DataFrame:
    """(source, source_size) with target: water-filling over sources in code point order, null last."""
    ranked = rank_within(sources, [], [F.asc_nulls_last("source")], "ordinal")
    plan = materialize(
        ranked.select(
            "source", "source_size", weigh(F.col("ordinal"), F.col("source_size")).alias("weight"),
            (F.col("source_size") * F.lit(float(max_epochs))).alias("ceiling"),
        ),
        "mix-sources",
    )
    rate = 0.0
    while True:
        full = F.col("weight") * F.lit(rate) > F.col("ceiling")
        total, used, weight = plan.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("ceiling")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not total or not weight:
            break
        raised = (total * share - used) / weight
        if raised == rate:
            break
        rate = raised
    target = F.least(F.col("ceiling"), F.col("weight") * F.lit(rate))
    return plan.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """The input with its number of words and its slice, in columns of their own."""
    return docs.withColumns({
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"),
        "__bucket": seeded_bucket(F.col("doc_id"), seed),
    })


def seeded_bucket(doc_id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def mix_plan(rows: DataFrame, weigh: Callable[[Column, Column], Column], share: float, max_epochs: float) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and where its rest runs out."""
    sliced = materialize(
        rows.groupBy("source", F.col("__bucket").alias("bucket")).agg(F.sum("__size").alias("words")), "mix-slices"
    )
    sources = sliced.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weigh, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", whole.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # The slice where the rest runs out: first among groups of slices, then inside that group.
    group = F.shiftright("bucket", 8)
    earlier = lambda by: F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sliced.groupBy("source", group.alias("group")).agg(F.sum("words").alias("words")).withColumn("before", earlier("group"))
    ends = "before <= rest and rest < before + words"
    open_group = groups.alias("g").join(plan.alias("p"), F.expr("g.source <=> p.source")).where(ends).select(
        "p.source", "group", "before", "rest"
    )
    within = F.coalesce(F.sum("words").over(
        Window.partitionBy("s.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sliced.withColumn("group", group).alias("s").join(
        open_group.alias("o"), F.expr("s.source <=> o.source and s.group = o.group")
    ).select("s.source", "bucket", "words", "rest", (F.col("before") + within).alias("before"))
    edge = inside.where(ends).select("source", F.col("bucket").alias("edge"), ((F.col("rest") - F.col("before")) / F.col("words")).alias("fraction"))
    return materialize(
        plan.alias("p").join(edge.alias("e"), F.expr("p.source <=> e.source"), "left").select(
            "p.*", F.coalesce("edge", F.lit(BUCKETS)).alias("edge"), F.coalesce("fraction", F.lit(0.0)).alias("fraction")
        ),
        "mix-plan",
    )


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows joined with their source's plan, and the words taken beyond whole repetitions."""
    named = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    extra = (
        F.when(F.col("__bucket") < F.col("__edge"), F.col("__size"))
        .when(F.col("__bucket") == F.col("__edge"), F.floor(F.col("__size") * F.col("__fraction")))
        .otherwise(0).cast("bigint")
    )
    return rows.join(named, rows["source"].eqNullSafe(F.col("__source"))).withColumn("__extra", extra)


def mix(
    docs: DataFrame,
    cycle: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    weigh: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, extra, taken.

    ``taken`` are the words the mix takes: ``whole`` repetitions and ``extra`` words.
    """
    weigh = weigh or (lambda ordinal, size: cycled(ordinal, size, cycle))
    rows = materialize(sized(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes")
    taken = with_plan(rows, mix_plan(rows, weigh, share, max_epochs))
    return taken.select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), F.col("__whole").alias("whole"), F.col("__extra").alias("extra"),
        (F.col("__whole") * F.col("__size") + F.col("__extra")).alias("taken"),
    )


def repeat_rows(
    docs: DataFrame,
    weigh: Callable[[Column, Column], Column],
    share: float,
    max_epochs: float,
    seed: int = 7,
) -> DataFrame:
    """All columns of the documents, each row as often as the mix takes the document whole.

    A rest of all its words is one more copy; a fraction of a document adds none.
    Documents without words have nothing to weigh and stay once. Texts are not shuffled.
    """
    rows = sized(docs, seed)
    taken = with_plan(rows, mix_plan(rows, weigh, share, max_epochs))
    copies = F.col("__whole") + F.when(F.col("__extra") == F.col("__size"), 1).otherwise(0)
    times = F.when(F.col("__size") == 0, 1).otherwise(copies).cast("int")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
