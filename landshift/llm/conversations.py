"""Repair of conversations: least-cost edits that make the roles alternate, by a run-length DP.

A good conversation reads ``(s?(ua)+)?`` in the initials of its roles. Edits in order: Keep (0), Rerole to
user or assistant (2), Delete (3, required for blank and duplicate messages), Insert an empty
message of user or assistant anywhere (2); a truncated message that is not deleted adds 1. Of the
cheapest edits the ones whose initials are least in ASCII order are told as the audit.

A message counts by its symbol: the class of its role, and whether it is truncated or has to go.
Four states (nothing yet, after s, after u, after a) make each symbol a 4 x 4 matrix of costs under
(min, +), inserts before the message included. Equal symbols in a row are one run, and a run of any
length is the product of few cached powers of two of its matrix. The audit is then unrolled from the
front: costs to go are known behind every message, and the first letter that keeps the least cost is
taken; choices are remembered by symbol, state and costs to go, of which there are few.

Rows are sorted over range partitions and packed into packets of at most ``PACKET`` messages of
one conversation, so a conversation may spread over many tasks. Packets inside a partition that hold a
whole conversation are done at once. For the others the products of packets are combined per
conversation, which tells the costs behind each packet; then each packet tells in which state it
ends for each state at its begin; then all are unrolled. What is combined is one small row per packet.
Only the hash of a repaired text is a sequential function: the pieces of a conversation of several
packets stream through one task, in order and in bounded memory, but for the audit, which is one value.

Equal messages of a turn are counted before they are shuffled, and the first message with a role and text is
found by a minimum per role and text, joined back on a key that no two rows share.

Defined results: null roles and texts are one space; roles that begin with none of s, u, a cannot be
kept; messages of one turn follow by role and text (the first 32 characters each, then a digest), null
turns come first; rows with a null id are one conversation; a conversation without messages has zeros, an
empty audit and the hash of the empty text; an empty table gives an empty result. Only the four named
columns are read, others are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from landshift.session import materialize

PACKET = 16_384
PACKET_BYTES = 4 << 20
WHITE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states
GONE = 8  # symbol of messages that have to go; others are 2 * class + truncated
FAR = 1 << 40
LONGEST = 2**63 - 1
# State after an inserted or reroled message, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = ("user", "user", "assistant", "user")
KEPT = ({NONE: SYSTEM}, {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


@lru_cache(maxsize=None)
def inserts() -> Matrix:
    """Cheapest inserts from state to state."""
    once = tuple(tuple(0 if i == j else 2 if j == NEXT[i] else FAR for j in range(4)) for i in range(4))
    return times(once, once)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2**k equal symbols."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    own = [[3 if i == j else FAR for j in range(4)] for i in range(4)]
    if symbol != GONE:
        kind, open_end = divmod(symbol, 2)
        for i in range(4):
            own[i][NEXT[i]] = min(own[i][NEXT[i]], 2 + open_end)
            if i in KEPT[kind]:
                own[i][KEPT[kind][i]] = min(own[i][KEPT[kind][i]], open_end)
    return times(inserts(), tuple(map(tuple, own)))


@lru_cache(maxsize=None)
def closing() -> Vector:
    """Costs to go behind the last message."""
    return tuple(min(inserts()[i][NONE], inserts()[i][ASSISTANT]) for i in range(4))


def runs_of(symbols: list[int], more: list[int]) -> list[list[int]]:
    """(symbol, length) of equal neighbours; ``more`` messages that have to go follow each symbol."""
    runs: list[list[int]] = []
    for symbol, extra in zip(symbols, more):
        for s, n in ((symbol, 1), (GONE, extra)):
            if runs and runs[-1][0] == s:
                runs[-1][1] += n
            elif n:
                runs.append([s, n])
    return runs


def product(runs: list[list[int]]) -> Matrix:
    out = UNIT
    for symbol, length in runs:
        k = 0
        while length >> k:
            if length >> k & 1:
                out = times(out, power(symbol, k))
            k += 1
    return out


def level(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(maxsize=None)
def before(symbol: int, behind: Vector) -> Vector:
    """Costs to go in front of a message, less their least, from those behind it."""
    return level(applied(power(symbol, 0), behind))


@lru_cache(maxsize=None)
def choice(symbol: int, state: int, behind: Vector) -> tuple[str, tuple[str, ...], str | None, int]:
    """Letters up to and with the message's own, roles inserted before it, its new role, the state behind it."""
    front = applied(power(symbol, 0), behind)
    letters, added = "", []
    kind, open_end = divmod(symbol, 2)
    while True:
        need = front[state]
        if 3 + behind[state] == need:
            return letters + "D", tuple(added), None, state
        if 2 + front[NEXT[state]] == need:
            letters += "I"
            added.append(NAME[state])
            state = NEXT[state]
            continue
        if state in KEPT[kind] and open_end + behind[KEPT[kind][state]] == need:
            return letters + "K", tuple(added), None, KEPT[kind][state]
        return letters + "R", tuple(added), NAME[state], NEXT[state]


def choices(symbols: list[int], state: int, behind: Vector) -> tuple[list[tuple], int]:
    """The choice for each message from the front, and the state behind the last; deletions change no state."""
    costs = [level(behind)]
    for symbol in reversed(symbols):
        costs.append(costs[-1] if symbol == GONE else before(symbol, costs[-1]))
    out = []
    for k, symbol in enumerate(symbols):
        out.append(("D", (), None, state) if symbol == GONE else choice(symbol, state, costs[len(symbols) - 1 - k]))
        state = out[-1][3]
    return out, state


def unrolled(symbols: list[int], more: list[int], roles: list[str], texts: list[str], state: int, behind: Vector, last: bool) -> tuple[str, str]:
    """Audit and repaired messages of a packet that is entered in ``state``."""
    made, state = choices(symbols, state, behind)
    letters, lines = [], []
    for (own, added, renamed, _), extra, role, text in zip(made, more, roles, texts):
        letters.append(own + "D" * extra)
        lines += [f"{name}:" for name in added]
        if own[-1] != "D":
            lines.append(f"{renamed or role}:{text}")
    while last and state not in (NONE, ASSISTANT):
        letters.append("I")
        lines.append(f"{NAME[state]}:")
        state = NEXT[state]
    return "".join(letters), "\n".join(lines)


# --- packing ---------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _tagged(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit("="), text), F.lit("null"))


def counted(messages: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Distinct messages of each turn with their number, and whether role and text are seen here first."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = messages.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("present"))
    if ids is not None:
        nothing = lambda kind: F.lit(None).cast(kind)
        turn = messages.schema["turn"].dataType
        rows = rows.unionByName(ids.select("conv_id", nothing(turn).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("present")))
    rows = rows.withColumn("pair", F.sha2(F.concat("present", F.lit(" "), _tagged(F.col("role")), F.lit(" "), "text"), 256))
    key = lambda turn: F.sha2(F.concat(_tagged(F.col("conv_id")), F.lit(" "), _tagged(turn), F.lit(" "), "pair"), 256)
    once = rows.withColumn("id", key(F.col("turn"))).groupBy("id").agg(
        *[F.any_value(c).alias(c) for c in ("conv_id", "turn", "role", "text", "pair")], F.sum("present").alias("copies")
    )
    firsts = rows.groupBy("conv_id", "pair").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unset"))
    seen = firsts.select(key(F.when(~F.col("unset"), F.col("least"))).alias("id"), F.lit(True).alias("first"))
    return once.join(seen, "id", "left").withColumn("first", F.coalesce("first", F.lit(False))).drop("id")


def in_order(rows: DataFrame) -> DataFrame:
    """Messages with their faults, sorted over range partitions that are numbered by ``chunk``."""
    start = lambda c: F.substring(c, 1, 32)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), start("role").asc(), start("text").asc(), F.col("pair").asc()]
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select(
            "conv_id", "turn", "role", "text", "copies", "first", F.spark_partition_id().alias("chunk"), kind.alias("kind"),
            (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"),
        )
    )


class Packet:
    """Messages of one conversation that stand in a row, and what is counted in them."""

    def __init__(self, chunk: int, number: int, conv):
        self.chunk, self.number, self.conv = chunk, number, conv
        self.symbols, self.more, self.roles, self.texts = [], [], [], []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns, self.kinds, self.distinct, self.size = [], [], 0, 0

    def add(self, turn, role: str, text: str, copies: int, first: bool, kind: int, blank: bool, open_end: bool) -> None:
        if not copies:  # the conversation is known, but has no message here
            return
        if blank:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - first
            self.counts["truncated"] += first and open_end
        self.counts["illegal"] += copies - 1 + bool(self.kinds and (self.kinds[-1], kind) not in LEGAL)
        self.kinds = [(self.kinds or [kind])[0], kind]
        if turn is not None:
            self.distinct += not self.turns or self.turns[-1] != turn
            self.turns = [(self.turns or [turn])[0], turn]
        self.symbols.append(GONE if blank or not first else 2 * kind + open_end)
        self.more.append(copies - 1)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)

    def row(self, edge: bool) -> dict:
        matrix = [x for line in product(runs_of(self.symbols, self.more)) for x in line]
        return dict(
            conv_id=self.conv, chunk=self.chunk, packet=self.number, edge=edge, matrix=matrix, symbols=self.symbols, more=self.more,
            roles=self.roles, texts=self.texts, first_turn=self.turns[0] if self.turns else None, last_turn=self.turns[1] if self.turns else None,
            distinct_turns=self.distinct, first_kind=self.kinds[0] if self.kinds else None, last_kind=self.kinds[1] if self.kinds else None, **self.counts,
        )


LEGAL = {(0, 1), (1, 2), (2, 1)}
PACKET_FIELDS = (
    "chunk int, packet int, edge boolean, matrix array<bigint>, symbols array<int>, more array<bigint>, roles array<string>, texts array<string>, "
    "first_turn bigint, last_turn bigint, distinct_turns bigint, first_kind int, last_kind int, " + ", ".join(f"{c} bigint" for c in COUNTS)
)


def pack(conv_type: pa.DataType, size: int):
    """Packets of sorted messages. Conversations at the ends of a partition, or of several packets, are edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Packet] = []  # finished packets of the current conversation
        now: Packet | None = None
        done, first_conv, number = [], True, 0

        def close(last: bool) -> None:
            nonlocal held, first_conv
            packets = [*held, now]
            edge = first_conv or last or len(packets) > 1
            done.extend(p.row(edge) for p in packets)
            held, first_conv = [], False

        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "copies", "first", "kind", "blank", "open", "chunk")
            for conv, turn, role, text, copies, first, kind, blank, open_end, chunk in zip(*[batch.column(c).to_pylist() for c in names]):
                if now is None or now.conv != conv:
                    if now is not None:
                        close(False)
                    now = Packet(chunk, number, conv)
                    number += 1
                elif len(now.symbols) >= size or now.size >= PACKET_BYTES:
                    held.append(now)
                    now = Packet(chunk, number, conv)
                    number += 1
                    if len(held) > 1:  # certainly an edge: no need to hold it any longer
                        done.append(held.pop(0).row(True))
                now.add(turn, role, text, copies, first, kind, blank, open_end)
            if done:
                yield packed(done, conv_type)
                done = []
        if now is not None:
            close(True)
            yield packed(done, conv_type)

    return run


def packed(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    kinds = {
        "conv_id": conv_type, "chunk": pa.int32(), "packet": pa.int32(), "edge": pa.bool_(), "matrix": pa.list_(pa.int64()),
        "symbols": pa.list_(pa.int32()), "more": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()),
        "first_turn": pa.int64(), "last_turn": pa.int64(), "distinct_turns": pa.int64(), "first_kind": pa.int32(), "last_kind": pa.int32(),
        **dict.fromkeys(COUNTS, pa.int64()),
    }
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))


# --- conversations of several packets ----------------------------------------------------


def vector_behind(packets: pd.DataFrame) -> pd.DataFrame:
    """Costs to go behind each packet of a conversation."""
    packets = packets.sort_values(["chunk", "packet"])
    behind, out = closing(), []
    for row in reversed(list(packets.itertuples(index=False))):
        out.append((row.chunk, row.packet, list(behind), not out))
        m = [int(x) for x in row.matrix]
        behind = applied(tuple(tuple(m[4 * i : 4 * i + 4]) for i in range(4)), behind)
    return pd.DataFrame(out, columns=["chunk", "packet", "behind", "last"])


def states_at_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every state at the begin of a packet, the state at its end."""
    for batch in batches:
        ends = [
            [choices(symbols, state, tuple(behind))[1] for state in range(4)]
            for symbols, behind in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv_id", "chunk", "packet")], pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "chunk", "packet", "ends"]
        )


def states_at_begin(packets: pd.DataFrame) -> pd.DataFrame:
    state, out = NONE, []
    for row in packets.sort_values(["chunk", "packet"]).itertuples(index=False):
        out.append((row.chunk, row.packet, state))
        state = int(row.ends[state])
    return pd.DataFrame(out, columns=["chunk", "packet", "state"])


PIECE = ("first_turn", "last_turn", "distinct_turns", "first_kind", "last_kind", *COUNTS)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired text of each packet, from the state at its begin and the costs behind it."""
    for batch in batches:
        names = ("symbols", "more", "roles", "texts", "state", "behind", "last")
        made = [unrolled(*row[:5], tuple(row[5]), row[6]) for row in zip(*[batch.column(c).to_pylist() for c in names])]
        cost = []
        for matrix, state, behind in zip(*[batch.column(c).to_pylist() for c in ("matrix", "state", "behind")]):
            cost.append(min(x + y for x, y in zip(matrix[4 * state : 4 * state + 4], behind)))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("conv_id", "chunk", "packet", *PIECE)], pa.array(cost, pa.int64()),
             pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())],
            ["conv_id", "chunk", "packet", *PIECE, "cost", "audit", "repaired"],
        )


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Whole:
    """A conversation put together from its pieces, in order."""

    def __init__(self, conv):
        self.conv, self.counts, self.hash = conv, dict.fromkeys(COUNTS, 0), hashlib.sha256()
        self.cost, self.audit, self.begun = None, [], False
        self.turns, self.distinct, self.kind = None, 0, None

    def add(self, piece: dict) -> None:
        for c in COUNTS:
            self.counts[c] += piece[c]
        if self.cost is None:
            self.cost = piece["cost"]  # costs to go from its begin
        self.audit.append(piece["audit"])
        if piece["repaired"]:
            self.hash.update((("\n" if self.begun else "") + piece["repaired"]).encode())
            self.begun = True
        if piece["first_kind"] is not None:
            self.counts["illegal"] += self.kind is not None and (self.kind, piece["first_kind"]) not in LEGAL
            self.kind = piece["last_kind"]
        if piece["first_turn"] is not None:
            self.distinct += piece["distinct_turns"] - (self.turns is not None and self.turns[1] == piece["first_turn"])
            self.turns = ((self.turns or [piece["first_turn"]])[0], piece["last_turn"])

    def row(self) -> tuple:
        gaps = min(self.turns[1] - self.turns[0] + 1 - self.distinct, LONGEST) if self.turns else 0
        return (self.conv, gaps, *[self.counts[c] for c in COUNTS], self.cost, "".join(self.audit), self.hash.hexdigest())


def joined(conv_type: pa.DataType):
    """Results from pieces that are sorted by conversation."""
    kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256"]

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Whole | None = None
        for batch in batches:
            done = []
            for piece in batch.to_pylist():
                if now is None or now.conv != piece["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = Whole(piece["conv_id"])
                now.add(piece)
            if done:
                yield told(done)
        if now is not None:
            yield told([now.row()])

    return run


def repair(messages: DataFrame, ids: DataFrame | None = None, packet: int = PACKET) -> DataFrame:
    """One row per conversation: faults, cost, audit and the hash of the repaired messages.

    ``messages`` has conv_id, turn (whole number), role and text; ``ids`` may name more conversations.
    """
    conv = messages.schema["conv_id"].dataType.simpleString()
    conv_type = to_arrow_type(messages.schema["conv_id"].dataType)
    messages = messages.withColumn("turn", F.col("turn").cast("bigint"))
    stored = materialize(
        in_order(counted(messages, ids)).mapInArrow(pack(conv_type, packet), f"conv_id {conv}, {PACKET_FIELDS}"), "packets"
    )
    edge = stored.where("edge")
    behind = materialize(
        edge.select("conv_id", "chunk", "packet", "matrix").groupBy("conv_id")
        .applyInPandas(vector_behind, "chunk int, packet int, behind array<bigint>, last boolean"), "packet-costs",
    )
    ends = (
        edge.select("conv_id", "chunk", "packet", "symbols").join(behind, ["chunk", "packet"])
        .mapInArrow(states_at_end, f"conv_id {conv}, chunk int, packet int, ends array<int>")
    )
    begins = materialize(ends.groupBy("conv_id").applyInPandas(states_at_begin, "chunk int, packet int, state int"), "packet-states")
    closed = F.array(*[F.lit(x).cast("bigint") for x in closing()])
    lone = stored.where("not edge").withColumns({"behind": closed, "last": F.lit(True), "state": F.lit(NONE)})
    several = edge.join(behind, ["chunk", "packet"]).join(begins, ["chunk", "packet"])
    schema = (
        f"conv_id {conv}, chunk int, packet int, first_turn bigint, last_turn bigint, distinct_turns bigint, first_kind int, last_kind int, "
        + ", ".join(f"{c} bigint" for c in COUNTS) + ", cost bigint, audit string, repaired string"
    )
    made = lambda rows: rows.mapInArrow(pieces, schema)
    order = ["conv_id", "chunk", "packet"]
    result = f"conv_id {conv}, {RESULT}"
    # A packet that is a whole conversation needs no neighbour; pieces of the others meet in order.
    together = made(several).repartition("conv_id").sortWithinPartitions(*order)
    return made(lone).mapInArrow(joined(conv_type), result).unionByName(together.mapInArrow(joined(conv_type), result))


def damaged(messages: DataFrame) -> DataFrame:
    """Messages with planted faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    marked = messages.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    changed = marked.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return changed.drop("copy")
