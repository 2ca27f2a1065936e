"""Secret scans: fixed patterns, and Markov models of random strings and identifiers.

Patterns find assignments to secret names, access keys and hexadecimal runs. Other long runs
of key characters are judged by two first-order Markov models over characters, one of
random strings and one of ordinary identifiers: a run is a secret if the log-likelihood
ratio of random against ordinary is at least ``MIN_GAIN``.

The models are trained from labelled samples, rows (kind, value) with kind ``random`` or
``ordinary``. The random model leans on a uniform prior (``RANDOM_PRIOR`` characters per
context), so alphabets that the samples lack still count as random. Each model is a table of
at most 68 x 68 counts, whatever the corpus.

Without samples, ``scan`` learns the ordinary model from what cannot hold the secrets sought: all
words of the corpus that are letters only and shorter than a run, as written and in capitals, and
identifiers joined from ``NAMED`` words. The random model is its prior then. The parts of the
ordinary model have fixed shares, one of them uniform, so neither how many runs are secrets
nor the size of the corpus moves a judgement.

Main path: DataFrame functions only. Texts are read once for spans and runs, which are kept as a
narrow stage table, and without samples once for words. Only counts of words and steps are
shuffled, after partial aggregation.

Positions count code points, ends are exclusive. Defined results: a null text is empty and has
no spans; repeated rows have equal results; an empty table gives an empty result; without
samples no run is judged random by more than the priors say. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landshift.session import materialize

# Patterns, least lengths and the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

NAMES = r"(?i)password|passwd|secret|token|api_?key"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEY = "A-Za-z0-9+/_=-"
RUN = f"[{KEY}]{{16,}}"
WIDTH = len(ALPHABET) + 1  # 0: before the first character
MIN_GAIN = 8.0
RANDOM_PRIOR, ORDINARY_PRIOR = 64.0, 1.0

WORD = "^[A-Za-z]{2,15}$"  # shorter than a run
# Words of common identifiers, and the shares of corpus words and named words where both know a context.
NAMED = """add address all append application args array async base batch begin bool buffer build bytes cache call case
change char check child class clear client close code column command config connection content context control count create
current data database date debug default delete description device document double element enable encode end engine entry error event
exception exists expected factory false field file filter find first flag float format frame from function generate get group
handle handler hash header height hidden host image import index info init input insert instance integer item iterator
join key label language last layer layout left length level library limit line link list load local lock log main manager
map mask match max memory merge message method min mode model module move name next node none note null number object
offset open operation option order output package page parameter parent parse parser path pattern person pixel point position
prefix previous print process product project property provider public query queue range read record reference region register
remove render replace report request reset resource response result return right root row run schema score script search select
sequence server service session set shape shift short show size socket sort source space split stack start state static status
step stop store stream string style system table target task temp test text thread time timestamp title token total trace
train transform tree true type unit update upload user util valid value vector version view visible warning weight width
window word work write"""
SHARES = (0.6, 0.3)

FOUND = "array<struct<start:int,stop:int,value:string>>"


def located(text: Column, pattern: str, group: int) -> Column:
    """All matches in order, with the value of ``group``; positions from the pieces between matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.zip_with(
        F.zip_with(matches, values, lambda m, v: F.struct(F.char_length(m).alias("size"), v.alias("value"))),
        F.transform(F.split(text, pattern, -1), F.char_length),
        lambda m, gap: F.struct(m["size"].alias("size"), m["value"].alias("value"), gap.alias("gap")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        stop = begin + F.coalesce(part["size"], F.lit(0))
        item = F.struct(begin.alias("start"), stop.alias("stop"), part["value"].alias("value"))
        return F.struct(stop.alias("at"), F.when(part["size"].isNull(), state["found"]).otherwise(
            F.array_append(state["found"], item)).alias("found"))

    return F.aggregate(parts, start, step, lambda state: state["found"])


def found_if(text: Column, hint: str, pattern: str, group: int, least: int) -> Column:
    """Matches whose value is long enough; texts without the hint are not searched further."""
    spans = F.filter(located(text, pattern, group), lambda s: F.char_length(s["value"]) >= least)
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(FOUND))


def spans_and_runs(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each pattern, and runs that touch none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        found_if(F.col("text"), NAMES, ASSIGN, 2, ASSIGN_LEAST).alias("assign"),
        # A run of these characters is matched whole, so its least length can stand in the pattern.
        found_if(F.col("text"), "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14,}", 0, ACCESS_LEAST).alias("access"),
        found_if(F.col("text"), "[0-9a-f]{16,}", "[0-9a-f]{16,}", 0, HEX_LEAST).alias("hex"),
        found_if(F.col("text"), RUN, RUN, 0, 16).alias("runs"),
    )
    taken = F.concat("assign", "access", "hex")
    apart = lambda r: ~F.exists(taken, lambda s: (s["start"] < r["stop"]) & (r["start"] < s["stop"]))
    return found.withColumn("runs", F.filter("runs", apart))


def word_steps(docs: DataFrame) -> DataFrame:
    """Counts (step, n) over all words that are too short for a run, as written and in capitals."""
    pieces = docs.select(F.explode(F.split("text", f"[^{KEY}]+")).alias("word"))
    words = pieces.where(F.col("word").rlike(WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    cased = words.select("n", F.explode(F.array("word", F.upper("word"))).alias("word"))
    return cased.select("n", F.explode(steps(F.col("word"))).alias("step")).groupBy("step").agg(F.sum("n").alias("n"))


def steps(value: Column) -> Column:
    """Numbers of all steps from one character to the next, from the start of the value on."""
    places = F.transform(F.split(value, "", -1), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    places = F.filter(places, lambda p: p > 0)
    before = F.concat(F.array(F.lit(0)), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))))
    return F.zip_with(before, places, lambda a, b: a * WIDTH + b)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every step, from counts over all samples."""
    counts = labelled.where("value is not null").select("kind", F.explode(steps(F.col("value"))).alias("step")).groupBy("kind", "step").count()
    seen = {(r["kind"], r["step"]): r["count"] for r in counts.collect()}  # at most 2 * WIDTH**2 rows
    uniform = 1 / len(ALPHABET)
    ratio = [0.0] * (WIDTH * WIDTH)
    for a in range(WIDTH):
        total = {k: sum(seen.get((k, a * WIDTH + b), 0) for b in range(1, WIDTH)) for k in ("random", "ordinary")}
        for b in range(1, WIDTH):
            s = a * WIDTH + b
            random = (seen.get(("random", s), 0) + RANDOM_PRIOR * uniform) / (total["random"] + RANDOM_PRIOR)
            ordinary = (seen.get(("ordinary", s), 0) + ORDINARY_PRIOR * uniform) / (total["ordinary"] + ORDINARY_PRIOR)
            ratio[s] = log(random / ordinary)
    return ratio


def named_steps() -> Counter:
    """Steps of identifiers of two named words each, in the usual ways of joining, and of dates and numbers."""
    seen: Counter = Counter()
    words = NAMED.split()
    for k, (a, b) in enumerate(zip(words, words[7:] + words[:7])):
        date = f"{1980 + k % 60}-{k % 12 + 1:02d}-{k % 28 + 1:02d}"
        for value in (date, date.replace("-", "/"), f"{k * 7919}_{a}", f"{a}_{k}", f"{a}_{b}", f"{a}-{b}", f"{a}/{b}", a + b.title(), (a + " " + b).title().replace(" ", ""), f"{a}_{b}".upper()):
            places = [0, *[ALPHABET.index(c) + 1 for c in value]]
            seen.update(x * WIDTH + y for x, y in zip(places, places[1:]))
    return seen


def ratios(corpus: dict[int, int]) -> list[float]:
    """Log-likelihood ratio of every step, from the steps of corpus words and named words; random is uniform."""
    uniform = 1 / len(ALPHABET)
    parts = list(zip(SHARES, (corpus, named_steps())))
    ratio = [0.0] * (WIDTH * WIDTH)
    for a in range(WIDTH):
        totals = [sum(seen.get(a * WIDTH + b, 0) for b in range(1, WIDTH)) for _, seen in parts]
        whole = sum(share for (share, _), total in zip(parts, totals) if total)
        for b in range(1, WIDTH):
            s = a * WIDTH + b
            known = sum(share * seen.get(s, 0) / total for (share, seen), total in zip(parts, totals) if total)
            ordinary = known / whole * sum(SHARES) + (1 - sum(SHARES)) * uniform if whole else uniform
            ratio[s] = log(uniform / ordinary)
    return ratio


def gain(value: Column, ratio: list[float]) -> Column:
    """Log-likelihood ratio of a value."""
    table = F.lit(ratio)
    return F.aggregate(steps(value), F.lit(0.0), lambda total, s: total + F.element_at(table, s + 1))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, assign, access, hex and markov spans (start, stop, value)."""
    found = materialize(spans_and_runs(docs), "secret-spans")
    # The counts are at most WIDTH**2 rows.
    ratio = ratios({r["step"]: r["n"] for r in word_steps(docs).collect()}) if labelled is None else train(labelled)
    likely = F.filter("runs", lambda r: gain(r["value"], ratio) >= MIN_GAIN)
    return found.select("doc_id", "assign", "access", "hex", likely.alias("markov"))


def written(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of spans by start, then kind as listed, joined by commas."""
    def with_rank(rank: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"))

    ranked = [F.transform(kind, with_rank(rank)) for rank, kind in enumerate(kinds)]
    names = F.array(*[F.lit(k) for k in kinds])
    show = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat(*ranked)), show), ",")
