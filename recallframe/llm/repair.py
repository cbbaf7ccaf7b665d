"""Conversation structure repair: cheapest edits that give a conversation's roles the pattern ``(s?(ua)+)?``.

A conversation is a graph of (rows done, state of the pattern) whose arcs are edits: keep a row, give it the role that the
pattern wants, delete it, or insert a row. Costs are small integers, so distances to the end come from Dial's bucket
queue; the audit walks tight arcs from the start, of several the one with the ASCII-least initial.

Rows are sorted by range, so a conversation of any length is spread over tasks, in segments of ``SEGMENT_ROWS`` rows or
``SEGMENT_BYTES`` at most. One that lies in one task and one segment is repaired there. Of the others each segment
tells its distances from every state to every state; these are chained backwards, so that each segment knows the distances
behind it, and its walks forwards, so that it knows its first state. Only slim summaries stream through one task in order, and
for the SHA-256, which is serial by definition, blocks of repaired rows, in bounded memory. The audit itself is one
value of a result row, as long as the conversation.

Nulls in role or text are one space, and so are those of id and turn in the hash that damages rows. Null turns come first;
rows that share a turn come by role, then text, then copies. A null id is a conversation like others. Repeated rows
are rows (their hash, so their damage, is the same). Texts may be empty or of any length; an empty table has no rows.
Columns that aren't named are not looked at and may be called anything.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released, stage_table

#: Costs of edits; a row without an end that isn't deleted costs CUT_COST more.
REROLE_COST, DELETE_COST, INSERT_COST, CUT_COST = 1, 2, 5, 5
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
#: Row patterns up to this length are remembered, so many at most.
SHORT, REMEMBERED = 64, 1 << 15
#: Code points of role and text that cut ranges of rows.
KEY_LENGTH = 48
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, behind s, behind u, behind a. The state that the wanted role leads to, and that role.
WANTED = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Distances behind the last row: a conversation may end empty or behind an assistant.
END = (0, FAR, FAR, 0)

Rows = list[tuple[int | None, str, str]]


def row_codes(rows: Rows, repeated: Callable[[str, str], bool]) -> str:
    """A letter for each row: d for one that has to go as a blank one, e as a duplicate, else its role's initial (x for any but
    s, u, a), in upper case if its text is cut off."""
    out = []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        if not end:
            out.append("d")
            repeated(role, text)
        elif repeated(role, text):
            out.append("e")
        else:
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            out.append(c if end[-1] in ".!?" else c.upper())
    return "".join(out)


def arcs(code: str, q: int) -> list[tuple[str, int, int]]:
    """Edits of a row from state ``q``: initial, state behind it, cost; in ASCII order."""
    out = [("D", q, DELETE_COST)]
    if code not in "de":
        more = CUT_COST if code.isupper() else 0
        kept = KEPT[q].get(code.lower())
        if kept is not None:
            out.append(("K", kept, more))
        out.append(("R", WANTED[q], REROLE_COST + more))
    return out


@functools.cache
def incoming(code: str) -> list[list[tuple[int, int]]]:
    """For each state, the states before a row of this code and the costs of coming from there."""
    into: list[list[tuple[int, int]]] = [[], [], [], []]
    for p in range(4):
        for _, q, cost in arcs(code, p):
            into[q].append((p, cost))
    return into


def distances(codes: str, behind: tuple[int, ...]) -> list[int]:
    """Distance of each node (4 * rows done + state) to the end, whose states are ``behind`` away: Dial's queue with a bucket for
    each distance that a node may be ahead."""
    n = len(codes)
    dist = [FAR] * (4 * n + 4)
    least = min(behind)
    seeds = [(d - least, q) for q, d in enumerate(behind) if d < FAR]
    width = max([INSERT_COST, REROLE_COST + CUT_COST, DELETE_COST, *(d for d, _ in seeds)]) + 1
    buckets: list[list[int]] = [[] for _ in range(width)]
    waiting = 0
    for d, q in seeds:
        dist[4 * n + q] = d
        buckets[d].append(4 * n + q)
        waiting += 1
    now = 0
    while waiting:
        bucket = buckets[now % width]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            i, q = divmod(node, 4)
            for p in range(4):
                if WANTED[p] == q and now + INSERT_COST < dist[4 * i + p]:
                    dist[4 * i + p] = now + INSERT_COST
                    buckets[(now + INSERT_COST) % width].append(4 * i + p)
                    waiting += 1
            if i:
                for p, cost in incoming(codes[i - 1])[q]:
                    at = 4 * i - 4 + p
                    if now + cost < dist[at]:
                        dist[at] = now + cost
                        buckets[(now + cost) % width].append(at)
                        waiting += 1
        now += 1
    return [d + least if d < FAR else FAR for d in dist]


def walk(codes: str, dist: list[int], behind: tuple[int, ...], q: int) -> tuple[str, int]:
    """Initials of the ASCII-least tight path from state ``q`` before the rows, and the state behind them."""
    out, i, n = [], 0, len(codes)
    while True:
        here = dist[4 * i + q]
        if i == n and here == behind[q]:
            return "".join(out), q
        options = [(name, i + 1, to, cost) for name, to, cost in arcs(codes[i], q)] if i < n else []
        options.append(("I", i, WANTED[q], INSERT_COST))
        name, i, q = min((name, row, to) for name, row, to, cost in options if dist[4 * row + to] + cost == here)
        out.append(name)


@functools.lru_cache(REMEMBERED)
def _short(codes: str) -> tuple[int, str]:
    dist = distances(codes, END)
    return dist[0], walk(codes, dist, END, 0)[0]


def cheapest(codes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return _short(codes) if len(codes) <= SHORT else _short.__wrapped__(codes)


def repaired_lines(rows: Rows, audit: str, q: int) -> list[str]:
    """The rows that an audit leaves, as ``role:text``."""
    out, i = [], 0
    for name in audit:
        if name == "I":
            q = WANTED[q]
            out.append(f"{ROLE_OF[q]}:")
            continue
        _, role, text = rows[i]
        i += 1
        if name == "K":
            q = KEPT[q][role[:1]]
            out.append(f"{role}:{text}")
        elif name == "R":
            q = WANTED[q]
            out.append(f"{ROLE_OF[q]}:{text}")
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _first_seen() -> Callable[[str, str], bool]:
    seen: set[tuple[str, str]] = set()

    def repeated(role: str, text: str) -> bool:
        known = (role, text) in seen
        seen.add((role, text))
        return known

    return repeated


def _digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _counts(codes: str, rows: Rows) -> dict[str, int | None]:
    """What a run of rows tells of itself."""
    turns = [t for t, _, _ in rows if t is not None]
    return {
        "blank": codes.count("d"), "duplicate": codes.count("e"), "truncated": sum(c.isupper() for c in codes), "illegal": illegal_pairs([r[:1] for _, r, _ in rows]),
        "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
    }


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIRST = pa.schema([("conv", pa.string()), ("ord", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("digests", pa.list_(pa.binary()))])


def damaged(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows after damage: conv, turn, role, text and copies (0: dropped, without role and text)."""
    hashed = F.concat(F.coalesce(convs[conv_col].cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(convs[turn_col].cast("string"), F.lit(" ")))
    own = convs.select(
        convs[conv_col].cast("string").alias("conv"), convs[turn_col].cast("long").alias("turn"), F.coalesce(convs[role_col].cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(convs[text_col].cast("string"), F.lit(" ")).alias("text"), (F.crc32(F.encode(hashed, "UTF-8")) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).when(F.col("fate") != 0, F.col("text"))
    role = F.when(F.col("fate") == 4, "user").when(F.col("fate") != 0, F.col("role"))
    return own.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _repair(batches: Iterator[pa.RecordBatch], segment_rows: int = SEGMENT_ROWS) -> Iterator[pa.RecordBatch]:
    """Conversations that begin and end within the partition, repaired (ord is null), and segments of the others."""
    part = TaskContext.get().partitionId() << 32
    out: list[dict] = []
    rows: Rows = []
    size = number = 0
    conv, begun, cut = None, False, True  # the partition's first conversation may have begun before it

    def segment() -> dict:
        nonlocal number
        number += 1
        return {"conv": conv, "ord": part + number, "turns": [t for t, _, _ in rows], "roles": [r for _, r, _ in rows], "texts": [x for _, _, x in rows], "digests": list({_digest(r, x) for _, r, x in rows})}

    def whole() -> dict:
        codes = row_codes(rows, _first_seen())
        cost, audit = cheapest(codes)
        told = _counts(codes, rows)
        n, low, high = told.pop("turns"), told.pop("low"), told.pop("high")
        text = "\n".join(repaired_lines(rows, audit, 0))
        return {"conv": conv, "gaps": high - low + 1 - n if n else 0, **told, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    def flushed() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pylist(out, schema=_FIRST)
        out.clear()
        return got

    held = 0
    for batch in batches:
        for name, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if not begun or name != conv:
                if begun:
                    out.append(segment() if cut else whole())
                    cut = False
                conv, begun, rows, size = name, True, [], 0
            for _ in range(copies):
                rows.append((turn, role, text))
                size += len(text)
                held += len(text)
                if len(rows) >= segment_rows or size >= SEGMENT_BYTES:
                    out.append(segment())
                    cut, rows, size = True, [], 0
            if len(out) >= 2000 or held >= SEGMENT_BYTES and out:
                held = 0
                yield flushed()
    if begun:
        out.append(segment())  # the next partition may go on with it
    if out:
        yield flushed()


def _rows_of(batch: pa.RecordBatch, i: int) -> Rows:
    return list(zip(*(batch.column(name)[i].as_py() for name in ("turns", "roles", "texts")), strict=True))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment its codes, counts, ends and distances from each state to each."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            rows, late = _rows_of(batch, i), set(batch.column("late")[i].as_py() or [])
            inside = _first_seen()
            codes = row_codes(rows, lambda role, text: inside(role, text) or bool(late) and _digest(role, text) in late)  # noqa: B023
            far = [distances(codes, tuple(0 if q == p else FAR for p in range(4)))[:4] for q in range(4)]
            told = _counts(codes, rows)
            out.append({"conv": batch.column("conv")[i].as_py(), "ord": batch.column("ord")[i].as_py(), "codes": codes, "far": [far[q][p] for p in range(4) for q in range(4)], "first": rows[0][1][:1] if rows else None, "last": rows[-1][1][:1] if rows else None, **told})
        yield pa.RecordBatch.from_pylist(out, schema=_SUMMARY)


_SUMMARY = pa.schema([("conv", pa.string()), ("ord", pa.int64()), ("codes", pa.string()), ("far", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _streamed(batches: Iterator[pa.RecordBatch], state: Callable[[], object], step: Callable[[object, dict], dict | None], end: Callable[[object, str | None], dict] | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation in order through ``step``, which keeps what it needs in the conversation's state."""
    out: list[dict] = []
    now, conv, begun = None, None, False
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            for row in batch.slice(low, 256).to_pylist():
                if not begun or row["conv"] != conv:
                    if begun and end:
                        out.append(end(now, conv))
                    now, conv, begun = state(), row["conv"], True
                got = step(now, row)
                if got:
                    out.append(got)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
    if begun and end:
        yield pa.RecordBatch.from_pylist([end(now, conv)], schema=schema)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances behind each segment; segments come last to first."""

    def step(now: list[int], row: dict) -> dict:
        behind = list(now)
        far = row["far"]
        now[:] = [min(FAR, *(far[4 * p + q] + behind[q] for q in range(4))) for p in range(4)]
        return {"ord": row["ord"], "behind": behind}

    yield from _streamed(batches, lambda: list(END), step, None, pa.schema([("ord", pa.int64()), ("behind", pa.list_(pa.int64()))]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state before a segment the state behind it (null: there is no way)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            behind = tuple(row["behind"])
            dist = distances(row["codes"], behind)
            out.append({"conv": row["conv"], "ord": row["ord"], "behind": list(behind), "exits": [walk(row["codes"], dist, behind, q)[1] if dist[q] < FAR else None for q in range(4)]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv", pa.string()), ("ord", pa.int64()), ("behind", pa.list_(pa.int64())), ("exits", pa.list_(pa.int32()))]))


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each segment; segments come first to last."""

    def step(now: list[int], row: dict) -> dict:
        q = now[0]
        now[0] = row["exits"][q]
        return {"ord": row["ord"], "state": q, "behind": row["behind"]}

    yield from _streamed(batches, lambda: [0], step, None, pa.schema([("ord", pa.int64()), ("state", pa.int32()), ("behind", pa.list_(pa.int64()))]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit, cost and repaired rows of each segment."""
    names = ["conv", "ord", "first", "last", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in [*names, "codes", "state", "behind"]}
            told = {k: row[k] for k in names}
            rows = _rows_of(batch.rename_columns([{"t_turns": "turns", "turns": "n_turns"}.get(c, c) for c in batch.schema.names]), i)
            behind, q = tuple(row["behind"]), row["state"]
            dist = distances(row["codes"], behind)
            audit, _ = walk(row["codes"], dist, behind, q)
            lines = repaired_lines(rows, audit, q)
            out.append({**told, "audit": audit, "cost": dist[q], "lines": len(lines), "block": "\n".join(lines).encode()})
        yield pa.RecordBatch.from_pylist(out, schema=_BLOCK)


_BLOCK = pa.schema([*((f.name, f.type) for f in _SUMMARY if f.name not in ("codes", "far")), ("audit", pa.string()), ("cost", pa.int64()), ("lines", pa.int64()), ("block", pa.binary())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from its segments in order."""
    schema = pa.schema([f for f in _FIRST if f.name not in ("ord", "turns", "roles", "texts", "digests")])

    def state() -> dict:
        return {"sha": hashlib.sha256(), "lines": 0, "audit": [], "cost": None, "low": None, "high": None, "turns": 0, "last": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def step(now: dict, row: dict) -> None:
        if now["cost"] is None:
            now["cost"] = row["cost"]  # the distance from the start
        if row["lines"]:
            now["sha"].update(b"\n" * bool(now["lines"]) + row["block"])
            now["lines"] += row["lines"]
        now["audit"].append(row["audit"])
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            now[k] += row[k]
        if row["first"] is not None:
            now["illegal"] += now["last"] is not None and illegal_pairs([now["last"], row["first"]])
            now["last"] = row["last"]
        if row["low"] is not None:
            now["turns"] -= now["high"] == row["low"]  # turns rise: only one can stand on both sides
            now["low"] = row["low"] if now["low"] is None else now["low"]
            now["high"] = row["high"]

    def end(now: dict, conv: str | None) -> dict:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        return {"conv": conv, "gaps": gaps, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(now["audit"]), "repaired_sha256": now["sha"].hexdigest()}

    yield from _streamed(batches, state, step, end, schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def repair_conversations(convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """A row for each conversation: its id, gaps, counts of faults, cost and audit of the cheapest edits and the SHA-256 of what they
    leave."""
    bound_batches(convs.sparkSession)
    rows = damaged(convs, conv_col, turn_col, role_col, text_col)
    # long roles and texts take part in ranges by their beginnings alone: the cuts of ranges are sampled through the driver
    rows = rows.repartitionByRange("conv", "turn", F.substring("role", 1, KEY_LENGTH), F.substring("text", 1, KEY_LENGTH)).sortWithinPartitions("conv", "turn", "role", "text")
    first = stage_table(rows.mapInArrow(released(functools.partial(_repair, segment_rows=segment_rows)), _ddl(_FIRST)), "repairs")
    results = [f.name for f in _FIRST if f.name not in ("conv", "ord", "turns", "roles", "texts", "digests")]
    kind = convs.schema[conv_col].dataType.simpleString()
    done = first.where("ord is null").select("conv", *results)

    open_ = first.where("ord is not null")
    digests = open_.select("conv", "ord", F.explode("digests").alias("digest"))
    seen = digests.groupBy("conv", "digest").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = digests.alias("d").join(seen.alias("s"), F.expr("d.conv <=> s.conv and d.digest = s.digest and d.ord > s.first")).groupBy("d.ord").agg(F.collect_list("d.digest").alias("late"))
    told = open_.select("conv", "ord", "turns", "roles", "texts").join(late, "ord", "left").mapInArrow(released(_summaries), _ddl(_SUMMARY))
    told = stage_table(told, "segments")
    behind = told.select("conv", "ord", "far").repartition("conv").sortWithinPartitions("conv", F.desc("ord")).mapInArrow(_backwards, "ord long, behind array<long>")
    exits = told.select("conv", "ord", "codes").join(behind, "ord").mapInArrow(_exits, "conv string, ord long, behind array<long>, exits array<int>")
    states = exits.repartition("conv").sortWithinPartitions("conv", "ord").mapInArrow(_forwards, "ord long, state int, behind array<long>")
    blocks = told.drop("far").join(states, "ord").join(open_.select("ord", F.col("turns").alias("t_turns"), "roles", "texts"), "ord").mapInArrow(released(_blocks), _ddl(_BLOCK))
    joined = blocks.repartition("conv").sortWithinPartitions("conv", "ord").mapInArrow(released(_joined), f"conv string, {_RESULT}")
    return done.union(joined.select("conv", *results)).select(F.col("conv").cast(kind).alias(conv_col), *results)
