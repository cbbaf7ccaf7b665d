"""Substring dedup by collinear chaining: shared k-mer seeds are joined, matches in the same order in two documents
are chained with gap costs through Fenwick trees of maxima, and chains are aligned to find fuzzy passages.

Seeds are the minimizers of each document's word k-mers, so that every run of ``K + WINDOW - 1`` equal words shares
one. Every place of a seed joins the seed's first occurrence in the corpus (the smallest document id), never all pairs
of occurrences; a passage's first document is what its later ones point at. Spans are bytes of the UTF-8 text.

A null or empty text has no passages, nor has an empty table. Of rows that repeat an id, equal texts are one document and
share their passages; different texts are documents of their own. No document matches itself. Null ids take no part.
Texts may be of any length; of passages that several earlier documents hold the first is named.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, WordHasher, bound_batches, dealt_join, drop_stage_table, filter_bits, fresh, released, repeated_ids, stage_table, text_bytes, text_nodes, text_slices, thinned, window_hashes

K, WINDOW = 6, 8
#: Words of a reported passage, and of a chain that may become part of one.
MIN_WORDS, MIN_CHAIN_WORDS = 45, 18
#: Share of equal words in an aligned passage.
MIN_IDENTITY = 0.8
#: Bytes between two matches of a chain at most; score that a gap costs for each byte.
MAX_GAP, GAP_COST = 240, 0.25
MIN_CHAIN_BYTES = 60
#: Bytes of text on either side of a chain in which its ends are sought.
MARGIN = 600
#: Past a chain's ends: score that a word costs which has no equal, how far the score may fall below its best, and how
#: many words one side may run ahead of the other.
WORD_COST, MAX_DROP, BAND = 2, 8, 4
_HASHER: WordHasher | None = None


def hasher() -> WordHasher:
    global _HASHER
    if _HASHER is None:
        _HASHER = WordHasher(SPACE_WORDS, seed=2)
    return _HASHER


def minimizers(values: np.ndarray) -> np.ndarray:
    """Positions of the smallest value of every window of WINDOW values."""
    n = len(values) - WINDOW + 1
    if n <= 0:
        return np.array([int(np.argmin(values))]) if len(values) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, WINDOW)
    at = view.argmin(1) + np.arange(n)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def seed_table(own: DataFrame) -> DataFrame:
    """h, doc, b (first byte), e (end byte) and w (first word) of each document's seeds, at all their places."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in text_slices(texts):
                data, off = text_bytes(texts.slice(first, last - first))
                starts, ends, rows = h.spans(data, off)
                words = h.hashes(data, starts, ends)
                grams = window_hashes(words, K)
                edge = np.searchsorted(rows, np.arange(last - first + 1))
                take, owner = [], []
                for i in range(last - first):
                    a, b = int(edge[i]), int(edge[i + 1]) - K + 1
                    if b > a:
                        at = a + minimizers(grams[a:b])
                        take.append(at)
                        owner.append(np.full(len(at), i))
                if not take:
                    continue
                at, who = np.concatenate(take), np.concatenate(owner)
                base = off[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), ids.slice(first, last - first).take(pa.array(who)), pa.array((starts[at] - base).astype(np.int32)), pa.array((ends[at + K - 1] - base).astype(np.int32)), pa.array((at - edge[who]).astype(np.int32))],
                    names=["h", "doc", "b", "e", "w"],
                )

    return own.mapInArrow(released(seeds), f"h long, doc {own.schema['doc'].dataType.simpleString()}, b int, e int, w int")


class MaxFenwick:
    """Fenwick tree of prefix maxima."""

    NONE = (-1e18, -1)

    def __init__(self, n: int):
        self.best = [self.NONE] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Largest value at places 0 to i."""
        i += 1
        top = self.NONE
        while i > 0:
            top = max(top, self.best[i])
            i -= i & -i
        return top


class Reach:
    """Largest values whose place in the other document lies within MAX_GAP before a given one.

    Places are cut into blocks of MAX_GAP + 1, so that what is within reach of a place is the beginning of its own block
    and the end of the block before; each block has a Fenwick tree from its beginning and one from its end.
    """

    BLOCK = MAX_GAP + 1

    def __init__(self) -> None:
        self.trees: dict[int, tuple[MaxFenwick, MaxFenwick]] = {}

    def put(self, place: int, value: tuple[float, int]) -> None:
        block, at = divmod(place, self.BLOCK)
        if block not in self.trees:
            self.trees[block] = MaxFenwick(self.BLOCK), MaxFenwick(self.BLOCK)
        low, high = self.trees[block]
        low.put(at, value)
        high.put(self.BLOCK - 1 - at, value)

    def before(self, place: int) -> tuple[float, int]:
        block, at = divmod(place, self.BLOCK)
        top = MaxFenwick.NONE
        if block in self.trees:
            top = self.trees[block][0].upto(at)
        if at < MAX_GAP and block - 1 in self.trees:
            top = max(top, self.trees[block - 1][1].upto(self.BLOCK - 1 - (at + 1)))
        return top


Anchor = tuple[int, int, int, int, int]


def anchors(b: np.ndarray, e: np.ndarray, c: np.ndarray, w: np.ndarray) -> list[Anchor]:
    """Merge matches that lie on one diagonal and touch or nearly touch: (start, end, other start, other end, first word)."""
    diagonal = c - b
    cut = np.flatnonzero((diagonal[1:] != diagonal[:-1]) | (b[1:] - e[:-1] > MAX_GAP // 2)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(b)]]) - 1
    return [(int(b[i]), int(e[j]), int(c[i]), int(c[i] + e[j] - b[i]), int(w[i])) for i, j in zip(first, last, strict=True)]


def chains(found: list) -> list[list]:
    """Best collinear chains of anchors sorted by their start, best first, each anchor in one chain at most.

    A chain's score is the bytes of its anchors less GAP_COST for every byte skipped in either document; no gap is longer
    than MAX_GAP. The part of the gap cost that depends on the predecessor alone is stored with it, so that the best one
    is a maximum over the other document's places. In this document, too, blocks keep what is too far off away: anchors
    that end in a start's own block are put in as starts rise, those of the block before as starts fall.
    """
    if len(found) == 1:
        return [found]
    score, back = [float(a[1] - a[0]) for a in found], [-1] * len(found)
    starts: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    for i in sorted(range(len(found)), key=lambda i: found[i][0]):
        starts.setdefault(found[i][0] // Reach.BLOCK, []).append(i)
    for i in sorted(range(len(found)), key=lambda i: found[i][1]):
        ends.setdefault(found[i][1] // Reach.BLOCK, []).append(i)
    value = lambda j: (score[j] + GAP_COST * (found[j][1] + found[j][3]), j)
    for block in sorted(starts):
        own, top = starts[block], {}
        earlier, reach = list(ends.get(block - 1, ())), Reach()
        for i in reversed(own):
            while earlier and found[earlier[-1]][1] >= found[i][0] - MAX_GAP:
                j = earlier.pop()
                reach.put(found[j][3], value(j))
            top[i] = reach.before(found[i][2])
        ended, reach = ends.get(block, ()), Reach()
        done = 0
        for i in own:
            while done < len(ended) and found[ended[done]][1] <= found[i][0]:
                j = ended[done]
                reach.put(found[j][3], value(j))
                done += 1
            best, j = max(top[i], reach.before(found[i][2]))
            gain = best - GAP_COST * (found[i][0] + found[i][2])
            if j >= 0 and gain > 0:
                score[i] += gain
                back[i] = j
    used = [False] * len(found)
    out = []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def chain_table(matches: DataFrame) -> DataFrame:
    """Chains of the matches (doc, other, b, e, c, w), which come sorted by doc, other and b."""
    id_type = matches.schema["doc"].dataType.simpleString()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "other", "spans"]
        kind = pa.list_(pa.struct([(x, pa.int32()) for x in "becfw"]))
        held: list[np.ndarray] = []
        key: tuple[Any, Any] | None = None
        rows: list[tuple[Any, Any, list[dict[str, int]]]] = []
        id_kind = pa.int64()

        def close() -> None:
            if key is None:
                return
            x = np.concatenate(held, axis=1)
            if x[1].max() - x[0].min() < MIN_CHAIN_BYTES:
                return
            for chain in chains(anchors(*x)):
                if chain[-1][1] - chain[0][0] >= MIN_CHAIN_BYTES:
                    rows.append((*key, [dict(zip("becfw", a, strict=True)) for a in chain]))

        for batch in batches:
            if not len(batch):
                continue
            id_kind = batch.column(0).type
            doc, other = batch.column(0), batch.column(1)
            values = np.stack([batch.column(i).to_numpy() for i in (2, 3, 4, 5)]).astype(np.int64)
            d, o = doc.to_numpy(zero_copy_only=False), other.to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((d[1:] != d[:-1]) | (o[1:] != o[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
                own = (doc[a].as_py(), other[a].as_py())
                if own != key:
                    close()
                    key, held = own, []
                held.append(values[:, a:z])
            if len(rows) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_kind), pa.array([r[1] for r in rows], id_kind), pa.array([r[2] for r in rows], kind)], names=names)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_kind), pa.array([r[1] for r in rows], id_kind), pa.array([r[2] for r in rows], kind)], names=names)

    return matches.mapInArrow(released(link), f"doc {id_type}, other {id_type}, spans array<struct<b:int,e:int,c:int,f:int,w:int>>")


def _words(piece: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = np.frombuffer(piece, np.uint8)
    starts, ends, _ = hasher().spans(data, np.array([0, len(data)]))
    low = piece.lower()  # bytes.lower folds A-Z alone
    return [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], starts, ends


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of ``a``."""
    if a == b:
        return len(a)
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def grown(a: list[bytes], b: list[bytes]) -> tuple[int, int, int]:
    """Words of a, words of b and equal words by which an alignment grows over their beginnings: banded, through
    mismatches, until the score falls MAX_DROP below its best; it ends where the best score is first reached."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    top, reached = n, (n, n, n)
    row = {n + k: (n - WORD_COST * k, n) for k in range(BAND + 1) if n + k <= len(b)}
    for i in range(n + 1, len(a) + 1):
        above, row = row, {}
        for j in range(max(n, i - BAND), min(len(b), i + BAND) + 1):
            best = (-(10**9), 0)
            if j - 1 in above:
                score, equal = above[j - 1]
                best = (score + 1, equal + 1) if a[i - 1] == b[j - 1] else (score - WORD_COST, equal)
            if j in above:
                best = max(best, (above[j][0] - WORD_COST, above[j][1]))
            if j - 1 in row:
                best = max(best, (row[j - 1][0] - WORD_COST, row[j - 1][1]))
            if best[0] >= top - MAX_DROP:
                row[j] = best
                if best[0] > top:
                    top, reached = best[0], (i, j, best[1])
        if not row:
            break
    return reached


def align(x: bytes, y: bytes, spans: list[Anchor], x_open: tuple[bool, bool], y_open: tuple[bool, bool]) -> tuple[int, int, int, int, int, int, int, int] | None:
    """Align two slices along a chain: (start, end, other start, other end, words, equal words) in bytes of the slices,
    and the first word and the word past the last one in the document.

    Ends grow over equal words, and through mismatches as long as the identity stays MIN_IDENTITY. ``x_open``,
    ``y_open``: whether a slice begins and ends within its text, where its edge may cut a word.
    """
    wx, sx, ex = _words(x)
    wy, sy, ey = _words(y)
    i = int(np.searchsorted(sx, spans[0][0]))
    j = int(np.searchsorted(sy, spans[0][2]))
    p = int(np.searchsorted(ex, spans[-1][1], side="left"))
    q = int(np.searchsorted(ey, spans[-1][3], side="left"))
    before = spans[0][4] - i  # words of the document before the slice
    if i > p or j > q or p >= len(wx) or q >= len(wy):
        return None
    equal, at, bt = 0, i, j
    for b, e, c, f, _ in spans:
        b0, e0 = int(np.searchsorted(sx, b)), int(np.searchsorted(ex, e, side="left")) + 1
        c0, f0 = int(np.searchsorted(sy, c)), int(np.searchsorted(ey, f, side="left")) + 1
        b0, c0 = max(b0, at), max(c0, bt)
        equal += common_words(wx[at:b0], wy[bt:c0]) + common_words(wx[b0:e0], wy[c0:f0])
        at, bt = max(e0, at), max(f0, bt)
    x_low, y_low, x_high, y_high = int(x_open[0]), int(y_open[0]), len(wx) - x_open[1], len(wy) - y_open[1]
    while i > x_low and j > y_low and wx[i - 1] == wy[j - 1]:
        i, j, equal = i - 1, j - 1, equal + 1
    while p + 1 < x_high and q + 1 < y_high and wx[p + 1] == wy[q + 1]:
        p, q, equal = p + 1, q + 1, equal + 1
    m, n, same = grown(wx[x_low:i][::-1], wy[y_low:j][::-1])
    if equal + same >= MIN_IDENTITY * (max(p - i + m, q - j + n) + 1):
        i, j, equal = i - m, j - n, equal + same
    m, n, same = grown(wx[p + 1 : x_high], wy[q + 1 : y_high])
    if equal + same >= MIN_IDENTITY * (max(p - i + m, q - j + n) + 1):
        p, q, equal = p + m, q + n, equal + same
    return int(sx[i]), int(ex[p]), int(sy[j]), int(ey[q]), max(p - i, q - j) + 1, equal, before + i, before + p + 1


def aligned(x: bytes, y: bytes, spans: list[Anchor], x_open: tuple[bool, bool], y_open: tuple[bool, bool]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Alignments of a chain that reach MIN_IDENTITY: a chain that doesn't is parted at its widest gap, so that a good
    part isn't lost by what was chained to it."""
    out, left = [], [spans]
    while left:
        part = left.pop()
        got = align(x, y, part, x_open, y_open)
        if got and got[5] >= MIN_IDENTITY * got[4]:
            out.append(got)
        elif len(part) > 1:
            gaps = [b[0] - a[1] + b[2] - a[3] for a, b in zip(part, part[1:], strict=False)]
            at = gaps.index(max(gaps)) + 1
            left += [part[at:], part[:at]]
    return out


def aligned_table(slices: DataFrame) -> DataFrame:
    """Aligned spans of chains. ``slices`` (chain, own, doc, other, spans, at, piece) come sorted by chain and own: the slice
    of the other document, then that of the own one, which also has the chain's spans. Rows that repeat do nothing."""
    id_type = slices.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start_byte", "end_byte", "other", "other_start", "other_end", "n_words", "n_equal", "word", "word_end"]
        theirs: dict[str, Any] | None = None
        done = None
        for batch in batches:
            out = []
            for i in range(len(batch)):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                if not r["own"]:
                    theirs = r
                    continue
                if r["chain"] == done or theirs is None or theirs["chain"] != r["chain"]:
                    continue
                done = r["chain"]
                x, y, x_at, y_at = r["piece"], theirs["piece"], r["at"], theirs["at"]
                spans = [(s["b"] - x_at, s["e"] - x_at, s["c"] - y_at, s["f"] - y_at, s["w"]) for s in r["spans"]]
                x_open = x_at > 0, len(x) >= spans[-1][1] + MARGIN
                y_open = y_at > 0, len(y) >= spans[-1][3] + MARGIN
                for got in aligned(x, y, spans, x_open, y_open):
                    if got[4] < MIN_CHAIN_WORDS:
                        continue
                    out.append((r["doc"], got[0] + x_at, got[1] + x_at, r["other"], got[2] + y_at, got[3] + y_at, *got[4:]))
            kind = batch.schema.field("doc").type
            kinds = [kind, pa.int32(), pa.int32(), kind, *[pa.int32()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return slices.mapInArrow(released(work), f"doc {id_type}, start_byte int, end_byte int, other {id_type}, other_start int, other_end int, n_words int, n_equal int, word int, word_end int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of at least MIN_WORDS words that an earlier document holds too, exactly or nearly: doc_id,
    start_byte, end_byte, n_words, src_doc_id, src_start, src_end, identity, part_start, part_end.

    Parts that follow one another in a document count as one passage even if they come from different ones; the source
    span, its identity and the bytes of this document that it answers to are those of the longest part. An id column that is
    called like one of the others keeps its name with underscores behind.
    """
    if repeated_ids(docs, id_col, text_col)[1]:
        rows, keys, node = text_nodes(docs, id_col, text_col)
        got = _passages(rows, node, text_col)
        got = got.join(keys.select(F.col("node").alias("doc"), F.col("id").alias("own")), "doc").join(keys.select(F.col("node").alias("src_doc_id"), F.col("id").alias("src")), "src_doc_id")
        got = got.withColumns({"doc": F.col("own"), "src_doc_id": F.col("src")}).drop("own", "src")
    else:
        got = _passages(docs, id_col, text_col)
    told = [c for c in got.columns if c != "doc"]
    return got.select(F.col("doc").alias(fresh(told, id_col)), *told)


def _passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text")).where("doc is not null and text is not null")
    seeds = stage_table(seed_table(own), "seeds")
    firsts = seeds.groupBy("h").agg(F.min(F.struct("doc", "b")).alias("at"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("at.doc <> last")
    firsts = stage_table(firsts.select("h", F.col("at.doc").alias("other"), F.col("at.b").alias("c"), "n"), "firsts")
    matches = dealt_join(seeds, firsts.drop("n"), firsts, "h", seeds.count(), "doc").where("doc <> other").select("doc", "other", "b", "e", "c", "w")
    matches = matches.repartition("doc").sortWithinPartitions("doc", "other", "b", "e", "c")
    found = stage_table(chain_table(matches).withColumn("chain", F.monotonically_increasing_id()), "chains")
    drop_stage_table(seeds, firsts)

    # both slices of each chain: the texts of these documents are shuffled once, then slices alone; they meet sorted
    first, last = F.col("spans")[0], F.element_at("spans", -1)
    own_cut = found.select("chain", F.lit(True).alias("own"), "doc", "other", "spans", F.greatest(F.lit(0), first["b"] - MARGIN).alias("at"), (last["e"] + MARGIN).alias("to"))
    kinds = {f.name: f.dataType for f in own_cut.schema}
    other_cut = found.select("chain", F.lit(False), F.col("other").alias("doc"), F.lit(None).cast(kinds["other"]), F.lit(None).cast(kinds["spans"]), F.greatest(F.lit(0), first["c"] - MARGIN), last["f"] + MARGIN)
    texts = thinned(own, filter_bits(found.select("doc").union(found.select(F.col("other").alias("doc")))))
    slices = own_cut.union(other_cut).join(texts.select("doc", F.encode("text", "UTF-8").alias("raw")), "doc")
    slices = slices.select("chain", "own", "doc", "other", "spans", "at", F.expr("substring(raw, at + 1, to - at)").alias("piece"))
    parts = stage_table(aligned_table(slices.repartition("chain").sortWithinPartitions("chain", "own")), "parts")
    drop_stage_table(found)
    return joined_parts(parts)


def joined_parts(parts: DataFrame) -> DataFrame:
    """Unite parts of a document that overlap or nearly touch; report what is long enough. Words are counted exactly, as
    parts carry their places among the document's words."""
    w = Window.partitionBy("doc").orderBy("start_byte", "end_byte", "other", "other_start")
    reach = F.max("end_byte").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("new", F.when(F.col("start_byte") > F.coalesce(reach, F.lit(-100)) + 12, 1).otherwise(0))
    parts = parts.withColumn("group", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("n_words", F.struct((-F.col("start_byte")).alias("s"), "other", "other_start", "other_end", "n_equal", "start_byte", "end_byte"))).alias("best")
    out = parts.groupBy("doc", "group").agg(F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), best, (F.max("word_end") - F.min("word")).alias("n_words"))
    return out.where(F.col("n_words") >= MIN_WORDS).select(
        "doc", "start_byte", "end_byte", "n_words", F.col("best.col2.other").alias("src_doc_id"), F.col("best.col2.other_start").alias("src_start"), F.col("best.col2.other_end").alias("src_end"),
        (F.col("best.col2.n_equal") / F.col("best.n_words")).alias("identity"), F.col("best.col2.start_byte").alias("part_start"), F.col("best.col2.end_byte").alias("part_end"),
    )


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every passage cut out that an earlier document holds; texts of which nothing is left go.

    Texts without such a passage stay byte for byte, as do n_chars and all other columns except that n_chars, where
    it exists, follows a cut text.
    """
    if repeated_ids(docs)[1]:
        rows, _, node = text_nodes(docs)
        return _cut(rows, node).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
    return _cut(docs, "doc_id")


def _cut(docs: DataFrame, id_col: str) -> DataFrame:
    spans = _passages(docs, id_col, "text").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte"))).alias("cuts"))
    spans = stage_table(spans.select(F.col("doc").alias("cut_doc"), "cuts"), "cuts")
    cut_name, doc_name = fresh(docs.columns, "cuts"), fresh(docs.columns, "cut_doc")
    spans = spans.select(F.col("cut_doc").alias(doc_name), F.col("cuts").alias(cut_name))
    joined = docs.join(spans, docs[id_col] == F.col(doc_name), "left")
    raw = "encode(text, 'UTF-8')"
    edges = f"concat(array(0), transform(`{cut_name}`, c -> c.end_byte))"
    stops = f"concat(transform(`{cut_name}`, c -> c.start_byte), array(length({raw})))"
    kept = f"decode(aggregate(zip_with({edges}, {stops}, (a, b) -> substring({raw}, a + 1, b - a)), cast('' as binary), (s, p) -> concat(s, p)), 'UTF-8')"
    text = F.when(F.col(cut_name).isNull(), F.col("text")).otherwise(F.expr(kept))
    out = joined.withColumn("text", text).where(F.col(cut_name).isNull() | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(cut_name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
