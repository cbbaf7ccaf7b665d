"""Structure repair against plain search over all edits, with every cut into segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from recallframe.llm import repair as R

COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    """(conv, turn, role, text) rows after damage, by conversation."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn, role, text)] * (2 if fate == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cost, audit and repaired lines: the least of all paths, kept for each number of rows done and roles' initials mod the
    pattern, by plain relaxation."""
    kinds = faults(rows)
    best = {(0, ""): (0, "", ())}
    order = [(0, "")]

    def state(initials):
        if not re.fullmatch("s?(ua)*u?", initials):
            return None
        return initials if len(initials) < 2 else "u" if initials[-1] == "u" else "ua"

    def reach(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value
            order.append(key)

    while order:
        i, q = key = order.pop(0)
        cost, audit, lines = best[key]
        for role in ("user", "assistant"):
            to = state(q + role[0])
            if to is not None and cost < 30 * (len(rows) + 1):
                reach((i, to), (cost + 5, audit + "I", (*lines, f"{role}:")))
        if i == len(rows):
            continue
        reach((i + 1, q), (cost + 2, audit + "D", lines))
        if kinds[i] not in ("blank", "duplicate"):
            _, own, text = rows[i]
            more = 5 * (kinds[i] == "truncated")
            for name, role, c in (("K", own, 0), ("R", "user", 1), ("R", "assistant", 1)):
                to = state(q + role[:1]) if role[:1] else None
                if to is not None:
                    reach((i + 1, to), (cost + c + more, audit + name, (*lines, f"{role}:{text}")))
    return min(v for (i, q), v in best.items() if i == len(rows) and q in ("", "ua"))


def plain(rows):
    kinds = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, lines = plain_repair(rows)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def compare(spark, rows, schema="conv_id long, turn long, role string, text string", **more):
    got = {r[0]: tuple(r[c] for c in COLUMNS) for r in R.repair_conversations(spark.createDataFrame(rows, schema), **more).collect()}
    want = {k: plain(v) for k, v in damaged(rows).items()}
    assert got == want


def random_rows(seed, convs, most, nulls=True):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "", "User", "umpire"] + [None] * nulls
    texts = ["Yes.", "No!", "what", "", " \n ", "a. ", "é日本?", "x" * 300 + "."] + [None] * nulls
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 3, None if nulls else t]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts) if rng.random() < 0.4 else f"line {t}."))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 4096])
def test_against_plain_search(spark, segment):
    compare(spark, [*random_rows(segment, 60, 9), (None, None, None, None), (None, 1, "user", "hi."), (None, 2, "assistant", "ho.")], segment_rows=segment)


def test_long_conversation_in_segments(spark):
    rows = [(7, *r[1:]) for r in random_rows(5, 40, 12, nulls=False)]
    rows = [(c, i // 2, r, x) for i, (c, _, r, x) in enumerate(rows)]
    compare(spark, rows, segment_rows=10)


def test_codes_by_all_short_patterns():
    for codes in itertools.chain.from_iterable(itertools.product("suaxUdS", repeat=n) for n in range(5)):
        rows = [(i, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c.lower()] if c != "d" else "user", "" if c == "d" else f"{i}" + "." * c.islower()) for i, c in enumerate(codes)]
        assert R.row_codes(rows, R._first_seen()) == "".join(codes)
        cost, audit = R.cheapest("".join(codes))
        want = plain_repair(rows)
        assert (cost, audit) == want[:2]
        assert tuple(R.repaired_lines(rows, audit, 0)) == want[2]


def test_repeated_rows_text_ids_and_clashing_names(spark):
    rows = [("a", 1, "user", "hi.", 1, "x"), ("a", 1, "user", "hi.", 2, "y"), ("b", 2, "assistant", "ho.", 3, "z"), ("", None, "", "", 4, "w")] * 3
    frame = spark.createDataFrame(rows, "c string, t int, r string, x string, ord long, audit string").toDF("c", "t", "r", "x", "ord", "audit")
    got = {r["c"]: tuple(r[c] for c in COLUMNS) for r in R.repair_conversations(frame, "c", "t", "r", "x").collect()}
    assert got == {k: plain(v) for k, v in damaged([r[:4] for r in rows]).items()}


def test_all_rows_dropped_and_empty_table(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string"
    got = R.repair_conversations(spark.createDataFrame([(gone, 0, "user", "hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair_conversations(spark.createDataFrame([], schema)).count() == 0


def test_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(spark, rows)
