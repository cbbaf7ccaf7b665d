"""Spelling variants: words of a corpus at distance one, by a self-join of the vocabulary's trie with sets of active nodes.

The trie is partitioned by prefixes. A prefix that more than ``CELL`` words have is split one code point deeper, as often as
needed; the others are cells, each with its whole subtree in one task. Descending a cell level by level, every node keeps
its active nodes, those at distance one: they begin at a node with two children (a replacement) or beside a child (an
insertion), and go on while both have a child of the same label; where both are terminal, the words are a pair.

Above the cells an active pair that has spent its edit goes on along equal labels alone, so its partition is the path: each
word is sent, for each of its split prefixes, to (prefix, rest behind one skipped code point) and (prefix, rest). Few more
than an alphabet of words meet there. An insertion counts where it stands last among equal code points, so that no pair is
found twice.

A null or empty text has no words; a null id counts as the empty text in the hash. Rows that repeat each count. Texts
and words may be of any length; ties go to the word that is smallest in code-point order. An empty table gives no rows. Columns
other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage_table, lower_ascii_table, released, stage_table, text_bytes, text_slices

#: Runs whose hash this number divides lose a code point.
DAMAGE = 31
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form occurs so many times as often as its variant.
RATIO = 10
#: Words of a trie cell at most, and rows that a worker descends at once.
CELL = 4096
ROWS = 40_000
#: Bytes of words that a worker gathers before it counts them.
HELD_BYTES = 8 << 20
#: Split prefixes up to which their list is broadcast.
BROADCAST_PREFIXES = 1 << 18
#: Bytes of a run up to which its hash is computed beside others'.
SHORT_RUN = 64

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_CRC & np.uint32(1)))


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each maximal run of letters A-Z, a-z and U+00C0 to U+00FF (0xC3 and the byte behind it), and
    which bytes end a two-byte letter."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool)
    lead = data == 0xC3
    tail = np.zeros_like(lead)
    tail[1:] = lead[:-1]
    letter = _LETTER[data] | lead | tail
    inner = np.zeros(len(data) + 1, bool)
    inner[off[1:-1]] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | inner[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | inner[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1, tail


def run_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run, continued from ``before``, the crc32 of what stands in front of it."""
    out = np.empty(len(starts), np.uint32)
    size = ends - starts
    for i in np.flatnonzero(size > SHORT_RUN):
        out[i] = zlib.crc32(lower[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= SHORT_RUN]
    at, size, c = starts[order], size[order], ~before[order]
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
        c[:k] = _CRC[(c[:k] ^ lower[at[:k] + j]) & 255] ^ (c[:k] >> np.uint32(8))
    out[order] = ~c
    return out


def damaged_words(ids: list[str], texts: pa.Array) -> Iterator[pa.Array]:
    """The words of texts, after damage, that are long enough (a word for each run)."""
    table = lower_ascii_table()
    for first, last in text_slices(texts):
        data, off = text_bytes(texts.slice(first, last - first))
        starts, ends, tail = letter_runs(data, off)
        points = np.cumsum(~tail)  # code points up to each byte
        length = points[ends - 1] - points[starts] + 1 if len(starts) else starts
        keep = length >= MIN_LENGTH
        starts, ends, length = starts[keep], ends[keep], length[keep]
        if not len(starts):
            continue
        lower = table[data]
        rows = np.searchsorted(off, starts, side="right") - 1
        before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[first:last]], np.uint32)[rows]
        h = run_hashes(lower, starts, ends, before)
        hit = h % DAMAGE == 0
        keep = (length >= MIN_LENGTH + 1) | ~hit
        starts, ends, length, h, hit = starts[keep], ends[keep], length[keep], h[keep], hit[keep]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts] += 1
        edge[ends] -= 1
        stays = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        size = ends - starts
        begin = np.flatnonzero(~tail)
        gone = begin[points[starts[hit]] - 1 + h[hit] % length[hit]]
        stays[gone] = False
        wide = data[gone] == 0xC3
        stays[gone[wide] + 1] = False
        size[hit] -= 1 + wide
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        yield pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(lower[stays]))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words that occur often enough: word, n."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for words in damaged_words(ids, batch.column(1)):
                held.append(words)
                if sum(x.nbytes for x in held) > HELD_BYTES:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        got = pc.value_counts(pa.concat_arrays(held))
        return pa.RecordBatch.from_arrays([got.field(0), got.field(1)], names=["word", "n"])

    own = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    found = own.mapInArrow(released(count), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def latin_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each code point of the words, and the words' offsets."""
    data, off = text_bytes(words)
    lead = data == 0xC3
    points = np.concatenate([[0], np.cumsum(~lead)])
    out = data.copy()
    out[1:][lead[:-1]] += 0x40
    return out[~lead], points[off]


def _children(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each child of each of ``nodes``: which of them it belongs to, and the child."""
    low, high = np.searchsorted(keys, nodes << 8), np.searchsorted(keys, (nodes + 1) << 8)
    n = high - low
    owner = np.repeat(np.arange(len(nodes)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _same_label(keys: np.ndarray, nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``nodes`` has a child of its label, and that child."""
    want = (nodes << 8) | labels
    at = np.searchsorted(keys, want)
    has = at < len(keys)
    has[has] = keys[at[has]] == want[has]
    return has, at


def trie_pairs(data: np.ndarray, start: np.ndarray, size: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words (by number) of the same cell at distance one. Words come sorted by cell, then by their ``size`` bytes
    of ``data`` from ``start``, without repeats; cells are numbered from 0.

    Nodes of a level are numbered in order. ``same`` holds active pairs of nodes of the level, ``longer`` pairs of a node
    and one of the level above, with the label that the longer has over (256 once another label followed). Words leave as soon as
    their node neither holds others nor is in a pair.
    """
    found_a, found_b = [], []
    words, node = np.arange(len(start)), cell.astype(np.int64)
    above = np.full(len(start), -1)  # each word's node one level up
    none = np.zeros(0, np.int64)
    same, longer, old_keys = (none, none), (none, none, none), none
    level, nodes = 0, int(cell[-1]) + 1 if len(cell) else 0
    ends = np.full(nodes, -1)  # the word that ends at a node
    ends[node[size == 0]] = words[size == 0]
    while len(words):
        # who may still be in a pair
        crowd = np.bincount(node, minlength=nodes) > 1
        active = crowd.copy()
        active[same[0]] = active[same[1]] = active[longer[0]] = True
        shorter = np.zeros(int(above.max(initial=-1)) + 2, bool)
        shorter[longer[2][longer[2] < len(shorter)]] = True
        stay = (size[words] > level) & (active[node] | (shorter[above] & (above >= 0)))
        words, node = words[stay], node[stay]
        if not len(words):
            break
        key = (node << 8) | data[start[words] + level]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        keys = key[first]
        above, node = node, np.cumsum(first) - 1
        parent, label = keys >> 8, keys & 255
        nodes = len(keys)
        child_ends = np.full(nodes, -1)
        done = size[words] == level + 1
        child_ends[node[done]] = words[done]

        own, child = _children(keys, same[0])
        has, other = _same_label(keys, same[1][own], label[child])
        pairs = [(child[has], other[has])]
        apart = np.arange(nodes)[crowd[parent]]
        step = 1
        while len(apart):  # an alphabet of rounds at most
            apart = apart[apart + step < nodes]
            apart = apart[parent[apart] == parent[apart + step]]
            pairs.append((apart, apart + step))
            step += 1
        own, child = _children(keys, longer[0])
        moved = label[child]
        has, other = _same_label(old_keys, longer[2][own], moved)
        has &= moved != longer[1][own]
        fresh = crowd[parent]
        longer = (
            np.concatenate([child[has], np.flatnonzero(fresh)]),
            np.concatenate([np.full(int(has.sum()), 256), label[fresh]]),
            np.concatenate([other[has], parent[fresh]]),
        )
        same = tuple(np.concatenate(x) for x in zip(*pairs, strict=True))
        for a, b in ((child_ends[same[0]], child_ends[same[1]]), (child_ends[longer[0]], ends[longer[2]])):
            both = (a >= 0) & (b >= 0)
            found_a.append(a[both])
            found_b.append(b[both])
        ends, old_keys, level = child_ends, keys, level + 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def path_pairs(group: np.ndarray, skipped: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among rows that share a path: two with a skipped code point each, or one with (which isn't the one that follows)
    and one without (``skipped`` is -1). Rows come sorted by group; a group has few more rows than an alphabet."""
    found_a, found_b = [], []
    at = np.arange(len(group))
    step = 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        a, b = at, at + step
        x, y = skipped[a], skipped[b]
        over = np.where(x >= 0, x, y)
        good = ((x >= 0) & (y >= 0)) | ((x != y) & (over != following[a]))
        found_a.append(a[good])
        found_b.append(b[good])
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs at distance one, both ways (word, other, n of the other), from rows (key, depth, kind, word, n) sorted by key
    and word: kind 0 stands in a trie cell, 1 at the end of a path whole, 2 there without the code point at depth."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > ROWS:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = table.column(0)
            last = key[len(key) - 1].as_py()
            cut = len(key) - int(pc.sum(pc.equal(key, last)).as_py())
            if cut:
                yield from _descended(table.slice(0, cut))
            held, size = [table.slice(cut)], len(key) - cut
    if size:
        yield from _descended(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _descended(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    key, depth, kind, word, n = (rows.column(i) for i in range(5))
    kind, depth = kind.to_numpy(), depth.to_numpy().astype(np.int64)
    changed = np.concatenate([[True], pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)])
    group = np.cumsum(changed) - 1
    data, off = latin_bytes(word)
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    size = np.diff(off)
    found = []
    inner = np.flatnonzero(kind == 0)
    if len(inner):
        cell = np.cumsum(np.concatenate([[0], group[inner][1:] != group[inner][:-1]]))
        a, b = trie_pairs(data, off[inner] + depth[inner], size[inner] - depth[inner], cell)
        found.append((inner[a], inner[b]))
    outer = np.flatnonzero(kind > 0)
    if len(outer):
        first = off[outer] + depth[outer]
        skips = kind[outer] == 2
        ended = depth[outer] + skips >= size[outer]
        a, b = path_pairs(group[outer], np.where(skips, padded[first], -1), np.where(ended, -2, padded[first + skips]))
        found.append((outer[a], outer[b]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    for low in range(0, len(a), ROWS):
        x, y = pa.array(a[low : low + ROWS]), pa.array(b[low : low + ROWS])
        yield pa.RecordBatch.from_arrays([word.take(x), word.take(y), n.take(y)], names=["word", "other", "n"])
        yield pa.RecordBatch.from_arrays([word.take(y), word.take(x), n.take(x)], names=["word", "other", "n"])


def split_prefixes(words: DataFrame, cell: int = CELL) -> tuple[DataFrame, int]:
    """Prefixes that more than ``cell`` words have (prefix), and the length of the longest, -1 without any. Each round counts the
    prefixes of one more length below those of the last."""
    tables: list[DataFrame] = []
    rows = words.select("word")
    while True:
        d = len(tables)
        part = rows.where(F.length("word") >= d).groupBy(F.substring("word", 1, d).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        hot = stage_table(part.where(F.col("n") > cell).select("prefix"), "prefixes")
        if not hot.limit(1).count():
            drop_stage_table(hot)
            break
        tables.append(hot)
    out = words.select(F.col("word").alias("prefix")).limit(0)
    for hot in tables:
        out = out.union(hot)
    return out, len(tables) - 1


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of words (word, n) at distance one, both ways: word, other, n (of the other)."""
    hot, deepest = split_prefixes(words, cell)
    known = hot.select(F.col("prefix"), F.lit(True).alias("hot"))
    if hot.count() <= BROADCAST_PREFIXES:
        known = F.broadcast(known)
    rows = words.select("word", "n", F.explode(F.expr(f"sequence(0, least(length(word), {deepest + 1}))")).alias("depth"))
    rows = rows.withColumn("prefix", F.expr("substring(word, 1, depth)")).withColumn("before", F.expr("substring(word, 1, depth - 1)"))
    rows = rows.join(known, "prefix", "left").join(known.select(F.col("prefix").alias("before"), F.col("hot").alias("reached")), "before", "left")
    rows = rows.where("hot or depth = 0 or reached")
    forms = F.expr("""
        case when hot is null then array(struct(0 as kind, prefix as key))
        when depth < length(word) then array(struct(1 as kind, concat(prefix, '*', substring(word, depth + 1)) as key), struct(2 as kind, concat(prefix, '*', substring(word, depth + 2)) as key))
        else array(struct(1 as kind, concat(prefix, '*') as key)) end""")
    rows = rows.select("word", "n", "depth", F.explode(forms).alias("x")).select("x.key", "depth", "x.kind", "word", "n")
    rows = rows.repartition("key").sortWithinPartitions("key", "word")
    return rows.mapInArrow(released(descend), "word string, other string, n long")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """A row for each word: word, form (its near word that occurs most, if often enough), root (the last of its forms), n,
    n_near and form_n."""
    words = stage_table(vocabulary(docs, id_col, text_col), "words")
    near = near_words(words, cell).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    own = words.join(near, "word", "left")
    form = F.col("best.n") * -1 >= F.col("n") * RATIO
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    own = stage_table(own, "forms")
    drop_stage_table(words)
    links = table = stage_table(own.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each form occurs RATIO times as often: a chain is short, and each round doubles its reach
        then = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage_table(links.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_stage_table(table)
        links, table = jumped.select("word", "root"), jumped
        if not jumped.where("moved").limit(1).count():
            break
    return own.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
