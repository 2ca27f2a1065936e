"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.llm import (
    bpe, conversations, decontaminate, mixing, near_dup, neighbours, quality, secrets, sharding, substring, token_counts, toxicity,
    vector_codes,
)
from landshift.llm.oracles import CONVERSATIONS_SQL, VECTOR_CODES_SQL
from landshift.llm.labelled import held_out
from landshift.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = [f"shard-{k:02d}" for k in range(32)]
TABLE_SIZE = 4_099


def register(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sharding --------------------------------------------------------------------------

SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
    SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
walks AS (
    SELECT i, ('0x' || substr(md5('offset:' || name), 1, 12))::BIGINT % {TABLE_SIZE} AS o,
           ('0x' || substr(md5('step:' || name), 1, 12))::BIGINT % {TABLE_SIZE - 1} + 1 AS s FROM shards),
preferred AS (SELECT i, list_transform(range({TABLE_SIZE}), lambda j: ((o + j * s) % {TABLE_SIZE})::INTEGER) AS slots FROM walks),
filled AS (
    SELECT 0 AS turn, repeat('0', {TABLE_SIZE})::BIT AS taken, -1 AS slot, -1::BIGINT AS owner
    UNION ALL
    SELECT turn + 1, set_bit(taken, claimed, 1), claimed, i FROM (
        SELECT turn, taken, i, list_filter(slots, lambda x: get_bit(taken, x) = 0)[1] AS claimed
        FROM filled JOIN preferred ON i = turn % {len(SHARDS)} WHERE turn < {TABLE_SIZE}))
SELECT doc_id, owner::INTEGER AS shard
FROM documents JOIN filled
  ON slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {TABLE_SIZE}
"""


@register("op5_sharding", SHARDING_SQL)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, TABLE_SIZE)


# --- mixing ----------------------------------------------------------------------------

MIXING_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 4))::INTEGER AS bucket
    FROM documents),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
    FROM sized GROUP BY source),
weighed AS (
    SELECT source, source_size, [3.0, 1.0, 2.0][((n - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS ceiling
    FROM sources),
rates AS (
    SELECT 0 AS round, 0.0::DOUBLE AS rate
    UNION ALL
    SELECT round + 1, (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN weight * rate > ceiling THEN ceiling ELSE 0 END))
                      / sum(CASE WHEN weight * rate > ceiling THEN 0 ELSE weight END)
    FROM rates, weighed WHERE round < 60 GROUP BY round, rate),
targets AS (
    SELECT source, source_size, least(ceiling, weight * rate) AS target FROM weighed, rates WHERE round = 60),
plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
           target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM targets),
slices AS (
    SELECT source, bucket, sum(size)::BIGINT AS words,
           coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM sized GROUP BY source, bucket)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.whole,
       CASE WHEN s.before + s.words <= p.rest THEN d.size
            WHEN s.before <= p.rest THEN floor(d.size * ((p.rest - s.before) / s.words)) ELSE 0 END::BIGINT AS extra,
       (p.whole * d.size + CASE WHEN s.before + s.words <= p.rest THEN d.size
            WHEN s.before <= p.rest THEN floor(d.size * ((p.rest - s.before) / s.words)) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
JOIN slices s ON d.source IS NOT DISTINCT FROM s.source AND d.bucket = s.bucket
"""


@register("op6_mixing", MIXING_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# --- classifiers -----------------------------------------------------------------------


def judged(docs: DataFrame, threshold: float) -> DataFrame:
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, learnable(spark, sf_dir))
    return judged(toxicity.with_score(docs, machine), 0.5)


@register("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs.where(~held_out(F.col("doc_id"))), learnable(spark, sf_dir))
    return judged(quality.with_score(docs, model), quality.AT_CUT)


# --- near duplicates -------------------------------------------------------------------


@register("op7_near_dup")
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.grouped(table(spark, sf_dir, "documents"))


# --- repeated passages -----------------------------------------------------------------


@register("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), texts=False)


# --- benchmark leaks -------------------------------------------------------------------


@register("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- secrets ---------------------------------------------------------------------------


@register("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(secrets.written(secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.written(secrets.KINDS).alias("spans"),
    )


# --- token counts ----------------------------------------------------------------------


def own_edits(docs: DataFrame, per_document: int = 3) -> DataFrame:
    """Documents with edits made of their own text: pieces of it replace others of up to 24 characters."""
    size = F.coalesce(F.char_length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1).cast("int")
    change = lambda k: F.struct(
        place(3 * k).alias("start"), (place(3 * k) + F.pmod(F.xxhash64("doc_id", F.lit(3 * k + 1)), F.lit(25))).cast("int").alias("stop"),
        F.substr(F.coalesce("text", F.lit("")), place(3 * k + 2) + 1, F.lit(16)).alias("insert"),
    )
    return docs.withColumn("edits", F.array(*[change(k) for k in range(per_document)]))


@register("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    indexed = token_counts.with_tree(docs).withColumn("n_tokens", token_counts.n_tokens())
    return token_counts.with_edits(indexed).select(
        "doc_id", "n_tokens", token_counts.n_tokens().alias("n_tokens_edited"), "encoded_chars"
    )


# --- nearest neighbours ----------------------------------------------------------------


@register("op10_neighbours")
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


# --- BPE -------------------------------------------------------------------------------


@register("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.public_vocabulary()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    hashed = coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return bpe.with_id_digest(hashed)


# --- vector codes ----------------------------------------------------------------------


@register("op12_vector_codes", VECTOR_CODES_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    lengths = sorted({length for length, _ in books})
    digests = F.array(*[F.lit(vector_codes.digest(books, n)) for n in lengths])
    found = F.element_at(digests, F.array_position(F.lit(lengths), F.col("length")).cast("int")) if lengths else F.lit(None).cast("string")
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return vector_codes.with_label_error(codes).select(
        "vec_id", F.concat_ws("", digits).alias("code"), "error", "label_error", found.alias("codebooks_sha256")
    )


# --- conversations ---------------------------------------------------------------------


@register("op13_conversations", CONVERSATIONS_SQL)
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(messages), messages.select("conv_id")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
