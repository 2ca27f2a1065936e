import hashlib
import random
import re
from zlib import crc32

import pytest

from landshift.llm import conversations
from landshift.llm.queries import QUERIES
from tests.llm import cases

KIND = "conv_id bigint, turn bigint, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """The definition, message by message, with whole strings for every state."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], m[2]))
    turns = [t for t, _, _ in rows if t is not None]
    out = dict(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, blank=0, duplicate=0, truncated=0, illegal=0)
    seen, best = set(), {"": (0, "", "", ())}

    def inserted(states):
        states = dict(states)
        for _ in range(2):
            for cost, audit, reads, lines in list(states.values()):
                name = "assistant" if reads.endswith("u") else "user"
                better(states, (cost + 2, audit + "I", reads + name[0], (*lines, name + ":")))
        return states

    def better(states, made):
        # What may follow depends on the last initial alone; an opening s is one of its own.
        at = made[2][-1:]
        if at not in states or made[:2] < states[at][:2]:
            states[at] = made

    for k, (_, role, text) in enumerate(rows):
        blank, again = not WORDY.search(text), (role, text) in seen
        open_end = not blank and not again and WORDY.findall(text)[-1] not in ".!?"
        seen.add((role, text))
        out["blank"] += blank
        out["duplicate"] += not blank and again
        out["truncated"] += open_end
        out["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        new = {}
        for cost, audit, reads, lines in inserted(best).values():
            better(new, (cost + 3, audit + "D", reads, lines))
            if blank or again:
                continue
            for letter, price, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                if len(name[:1]) == 1 and re.match(r"s?(ua)*u?\Z", reads + name[:1]):
                    better(new, (cost + price + open_end, audit + letter, reads + name[:1], (*lines, f"{name}:{text}")))
        best = new
    cost, audit, _, lines = min(m for m in inserted(best).values() if GOOD.match(m[2]))
    return out | dict(cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for k in range(draw.randint(0, longest)):
            turn = draw.choice([k, k, k, k * 2, 0, None])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(["", " \n", None, "Yes.", "No!", "and", "Well, then? ", "open \t"]) if draw.random() < 0.5 else f"text {draw.randrange(40)}{draw.choice(['.', '', '!'])}"
            rows.append((conv if conv else None, turn, role, text))
    return rows


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def results(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


@pytest.mark.parametrize("packet, partitions", [(conversations.PACKET, 8), (2, 8), (3, 1)])
def test_equals_plain_repair(spark, packet, partitions):
    rows = random_rows(4, 120, 9) + random_rows(9, 1, 60)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = results(conversations.repair(spark.createDataFrame(rows, KIND), packet=packet))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert got == {conv: plain(messages) for conv, messages in grouped(rows).items()}


def test_one_conversation_over_many_partitions(spark):
    draw = random.Random(1)
    rows = [(7, k, draw.choice(["user", "assistant"]), draw.choice(["Yes.", "no", f"message {k}.", f"m {k}"])) for k in range(3_000)]
    got = results(conversations.repair(spark.createDataFrame(rows, KIND).repartition(8), packet=100))
    assert got == {7: plain([r[1:] for r in rows])}
    same = [(1, 4, "user", "Hello.")] * 5_000
    told = results(conversations.repair(spark.createDataFrame(same, KIND)))[1]
    assert (told["duplicate"], told["illegal"], told["cost"], told["gaps"]) == (4_999, 4_999, 4_999 * 3 + 2, 0)
    assert told["audit"] == "K" + "D" * 4_999 + "I"


def test_powers_equal_steps():
    for symbol in range(9):
        step = conversations.UNIT
        for n in range(1, 40):
            step = conversations.times(step, conversations.power(symbol, 0))
            assert conversations.product([[symbol, n]]) == step


def test_damage_and_lost_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}. More!") for c in range(60) for t in range(3)]
    rows += [(None, 1, None, None), (900, None, "user", "a."), (901, 5, "user", None)]
    rows += [(c, 0, "user", "Only.") for c in range(1_000, 1_200)]
    frame = cases.clashing(spark.createDataFrame(rows, KIND))
    crowded = frame.withColumns({c: frame["text"] for c in ("copies", "first", "pair", "id", "chunk", "packet", "kind", "fault", "copy")})
    damaged = {}
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        fault = crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        damaged.setdefault(conv, []).extend([(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1))
    got = results(conversations.repair(conversations.damaged(crowded), crowded.select("conv_id")))
    assert got == {conv: plain(messages) for conv, messages in damaged.items()}
    assert any(not messages for messages in damaged.values())
    assert conversations.repair(cases.empty(crowded)).count() == 0


def test_query_over_a_whole_table(spark):
    got = QUERIES["op13_conversations"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count()
