"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link if the Jaccard similarity of their sets of five-word shingles reaches the threshold; the join
is exact. All shingles have one global order: rare ones by hash, then those that are frequent in the corpus by
frequency. If two sets of sizes m >= n are similar, their prefixes of length ``size - ceil(threshold * size) + l``
share at least l shingles. Each document chooses its l by the candidates it would meet (estimated from the
shingles' frequencies in prefixes): a longer prefix demands more shared shingles before a pair is verified.

Candidates are never all pairs of a group. First every document is verified against one representative of the
groups it shares; then only pairs whose documents are still in different components meet, the members of a
group's largest component against the others only. Pairs inside a component can't change the components.

Words are what spaces and \\t\\n\\v\\f\\r separate; A-Z are lower-cased. A shorter text is one shingle; a null or
empty one has none and links with nothing. Rows that repeat an id and its text are one document; rows that repeat an id
with another text are documents of their own, which share the id. Null ids link with nothing. Texts may be of any length;
an empty table has no rows. Columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, SPACE_WORDS, WordHasher, bound_batches, dealt_join, drop_stage_table, filter_bits, fresh, released, repeated_ids, stage_table, text_bytes, text_nodes, text_slices, window_hashes
from .components import connected_components

SHINGLE = 5
#: Threshold as a ratio of integers: intersection * 100 >= union * 80.
NUMERATOR, DENOMINATOR = 4, 5
#: Longest l of an l-prefix.
MAX_MATCHES = 4
#: Cost of verifying a pair, in shuffled posting entries.
VERIFY_COST = 20.0
#: Frequent shingles that the order knows (broadcast: 8 bytes each), the number of documents that makes one, and
#: the counters that one partition keeps.
FREQUENT = 1 << 17
FREQUENT_FROM = 12
LOCAL_COUNTERS = 1 << 19
#: Shingles that a partition gathers before it counts them, and marks (a byte each) by which it tells first occurrences,
#: which are most of all, from later ones.
HELD = 250_000
MARKS = 24
#: Postings of a group from which its documents' whole sets are looked at before pairs are formed.
LARGE_GROUP = 64
LOCAL_FROM = 3
_HASHER: WordHasher | None = None


def hasher() -> WordHasher:
    global _HASHER
    if _HASHER is None:
        _HASHER = WordHasher(SPACE_WORDS, seed=4)
    return _HASHER


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = hasher()
    for first, last in text_slices(texts):
        data, off = text_bytes(texts.slice(first, last - first))
        starts, ends, rows = h.spans(data, off)
        words = h.hashes(data, starts, ends)
        shingles = window_hashes(words, SHINGLE)
        edge = np.searchsorted(rows, np.arange(last - first + 1))
        for i in range(last - first):
            a, b = int(edge[i]), int(edge[i + 1])
            if b - a >= SHINGLE:
                own = np.unique(shingles[a : b - SHINGLE + 1])
            elif b > a:
                own = window_hashes(words[a:b], b - a)
            else:
                own = np.zeros(0, np.uint64)
            yield own.view(np.int64)


def prefix_length(n: np.ndarray | int, matches: int) -> np.ndarray | int:
    """Length of the prefix in which similar sets of size n share ``matches`` elements at least."""
    return np.minimum(n, n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + matches)


def frequent_shingles(own: DataFrame) -> np.ndarray:
    """The most frequent shingles of all texts, least frequent first (FREQUENT at most, whatever the input).

    Every partition counts its own shingles from their second occurrence on (marks of hashed places tell first ones) by
    lossy counting; what it finds often is added up over partitions.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0
        seen = np.zeros(1 << MARKS, bool)

        def fold() -> None:
            nonlocal keys, sums, held, size
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], sums[:0])
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
            least = 1
            while len(keys) > LOCAL_COUNTERS:
                keep = sums > least
                keys, sums, least = keys[keep], sums[keep], least + 1
            held, size = [], 0

        for batch in batches:
            for s in shingle_sets(batch.column(1)):
                at = s.view(np.uint64) >> np.uint64(64 - MARKS)
                again = s[seen[at]]
                seen[at] = True
                held.append(again)
                size += len(again)
                if size > HELD:
                    fold()
        fold()
        keep = sums + 1 >= LOCAL_FROM
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(sums[keep] + 1)], names=["token", "n"])

    found = own.mapInArrow(released(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    got = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return got["token"].to_numpy()[::-1].copy()


def prefixes(own: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc, n (set size) and the longest prefix of each document in the global order."""
    by_value = np.argsort(frequent, kind="stable")
    known = frequent[by_value]
    rank_of = by_value.astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists = [], []
            for s in shingle_sets(batch.column(1)):
                n = len(s)
                p = int(prefix_length(n, MAX_MATCHES))
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = known[at] == s
                    if often.any():
                        rare = s[~often][:p]
                        late = s[often][np.argsort(rank_of[at[often]], kind="stable")]
                        s = np.concatenate([rare, late[: p - len(rare)]])
                sizes.append(n)
                lists.append(s[:p])
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["doc", "n", "tokens"])

    return own.mapInArrow(released(cut), f"doc {own.schema['doc'].dataType.simpleString()}, n int, tokens array<long>")


def set_table(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc and its whole set, for documents that stand in a pair (and few others). A bounded filter thins the
    documents while they are read, so that texts are not shuffled; of rows that repeat an id one set stays."""
    bits = filter_bits(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))))
    packed = bits.tobytes()
    hashed = own.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS)).alias("bit"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(packed, np.uint64)
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64)
            hit = known[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            lists = list(shingle_sets(batch.column(1)))
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["doc", "items"])

    return hashed.mapInArrow(released(sets), f"doc {own.schema['doc'].dataType.simpleString()}, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold. A document that stands in very many pairs meets them in parts."""
    left, right = sets.select(F.col("doc").alias("a"), F.col("items").alias("x")), sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    pairs = pairs.select("a", "b")
    total = pairs.count()
    counts = lambda side: pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    both = dealt_join(dealt_join(pairs, left, counts("a"), "a", total, "b"), right, counts("b"), "b", total, "a")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return both.where(f"i > 0 and {DENOMINATOR} * i >= {NUMERATOR} * (s - i)").select("a", "b")


def shareable_sizes(mixed: DataFrame, own: DataFrame) -> DataFrame:
    """For documents of large groups the number of their shingles that any other such document has (doc, s).

    Documents that meet in a large group both have this number, and their overlap can't exceed the smaller one: a
    document with many shingles of its own leaves the group before pairs are formed. One pass over the shingles of
    these documents, whose counts are combined before they are shuffled.
    """
    large = mixed.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LARGE_GROUP).select("token")
    docs = stage_table(mixed.select("token", "doc").join(large, "token").select("doc").distinct(), "large")
    items = set_table(own, docs.select(F.col("doc").alias("a"), F.col("doc").alias("b"))).join(docs, "doc")
    items = stage_table(items.select("doc", F.explode("items").alias("item")), "items")
    common = items.groupBy("item").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("item")
    counted = items.join(common, "item").groupBy("doc").agg(F.countDistinct("item").cast("int").alias("s"))
    out = stage_table(docs.join(counted, "doc", "left").select("doc", F.coalesce("s", F.lit(0)).alias("s")), "shareable")
    drop_stage_table(docs, items)
    return out


def _similar_sizes(m: str, n: str) -> str:
    return f"{DENOMINATOR} * least({m}, {n}) >= {NUMERATOR} * greatest({m}, {n})"


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Table of documents (doc, n) and of the components of all that link (node, component)."""
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(docs[id_col].alias("doc"), docs[text_col].cast("string").alias("text"))
    table = stage_table(prefixes(own, frequent_shingles(own)), "prefixes")
    own = own.where("doc is not null")
    sizes = stage_table(table.select("doc", "n"), "sizes")
    # a posting holds the size and the place in one number; its level is the least l whose l-prefix holds it
    entries = table.where("doc is not null and n > 0").select("doc", "n", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.select("token", "doc", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("place"))
    groups = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("doc").alias("rep"))
    groups = stage_table(groups.where("df > 1"), "groups")
    posts = posts_table = stage_table(entries.join(groups, "token").select("token", "doc", "place", "df", "rep"), "posts")
    drop_stage_table(table)
    drop_stage_table(groups)
    posts = posts.select("token", "doc", "df", "rep", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND((1 << 32) - 1).cast("int").alias("pos"))
    first = f"n - (({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})"
    posts = posts.withColumn("level", F.expr(f"cast(greatest(1, pos - ({first}) + 1) as int)"))

    # each document's l: postings met in the l-prefix, and at most an l-th of them as candidates
    met = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).alias(f"c{k}") for k in range(1, MAX_MATCHES + 1)]
    cost = [F.struct((F.col(f"c{k}") * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("l")) for k in range(1, MAX_MATCHES + 1)]
    chosen = posts.groupBy("doc").agg(F.max("n").alias("n"), *met)
    # a small set can't share more elements than similarity asks for
    most = f"greatest(1, ({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR})"
    chosen = stage_table(chosen.select("doc", "n", F.least(F.least(*cost)["l"], F.expr(most)).alias("l")), "matches")

    # a document against the representative with which it shares most
    near = posts.where("doc <> rep").groupBy("doc", "n", "rep").agg(F.count(F.lit(1)).alias("shared")).where(f"shared >= least({MAX_MATCHES}, {most})")
    near = near.join(chosen.select(F.col("doc").alias("rep"), F.col("n").alias("m")), "rep").where(_similar_sizes("n", "m"))
    near = near.groupBy("doc").agg(F.max(F.struct("shared", "rep")).alias("best")).select(F.col("doc").alias("a"), F.col("best.rep").alias("b"))
    near = stage_table(near, "near")
    sets = stage_table(set_table(own, near), "sets")
    links = stage_table(verified(near, sets), "links")
    drop_stage_table(sets, near)
    found = stage_table(connected_components(links), "components")

    # what is left: pairs of a group in different components
    comp = found.select(F.col("node").alias("doc"), "component")
    state = chosen.join(comp, "doc", "left").select("doc", "l", F.coalesce("component", "doc").alias("comp"))
    state = posts.select("token", "doc", "n", "pos", "level").join(state, "doc").where("level <= l")
    state = stage_table(state, "state")
    drop_stage_table(posts_table, chosen)
    share = state.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = share.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", F.col("top.comp").alias("major"))
    major = stage_table(major, "mixed")
    mixed = mixed_table = stage_table(state.join(major, "token"), "mixed")
    drop_stage_table(state, major)
    shareable = shareable_sizes(mixed, own)
    mixed = mixed.join(shareable, "doc", "left")
    cols = ("doc", "n", "pos", "level", "l", "comp", "s")
    a = mixed.where("comp <> major").select("token", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = mixed.select("token", "major", *[F.col(c).alias(f"b_{c}") for c in cols])
    overlap = f"(({NUMERATOR} * (a_n + b_n) + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR})"
    rule = f"""a_comp <> b_comp and (b_comp = major or a_doc < b_doc) and {_similar_sizes('a_n', 'b_n')} and greatest(a_level, b_level) <= least(a_l, b_l)
        and least(a_pos, b_pos) + least(a_n - a_pos, b_n - b_pos) >= {overlap} and (a_s is null or b_s is null or least(a_s, b_s) >= {overlap})"""
    # of the l-prefix of the set that ends first, no more may be missing than the overlap allows
    largest = "greatest(a_n, b_n)"
    need = F.expr(f"least(a_l, b_l) + {overlap} - (({NUMERATOR} * {largest} + {DENOMINATOR - 1}) div {DENOMINATOR})")
    # which side a document stands on changes from token to token: a pair is counted under its ordered ids
    pair = F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")
    pairs = a.join(b, "token").where(rule).groupBy(*pair).agg(F.count(F.lit(1)).alias("k"), F.min(need).alias("need"))
    pairs = stage_table(pairs.where("k >= need").select("a", "b"), "pairs")
    drop_stage_table(mixed_table, shareable)
    sets = stage_table(set_table(own, pairs), "sets")
    more = stage_table(verified(pairs, sets), "links")
    drop_stage_table(sets, pairs)
    if more.limit(1).count():
        found = connected_components(links.unionByName(more))
    drop_stage_table(links, more)
    return sizes, found


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id (smallest id reachable by links). An id column that is called
    like one of the others keeps its name with underscores behind."""
    name = fresh(["n_shingles", "component_id"], id_col)
    if repeated_ids(docs, id_col, text_col)[1]:  # rows of an id are documents of their own then
        rows, keys, node = text_nodes(docs, id_col, text_col)
        sizes, found = similar_components(rows, node, text_col)
        least = found.join(keys.select(F.col("node").alias("component"), F.col("id").alias("least")), "component").select("node", "least")
        known = sizes.withColumnRenamed("doc", "node").join(keys, "node").join(least, "node", "left").select(F.col("id").alias(name), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
        nameless = docs.where(docs[id_col].isNull())
        return known.unionByName(jaccard_classes(nameless, id_col, text_col)) if nameless.limit(1).count() else known
    sizes, found = similar_components(docs, id_col, text_col)
    out = sizes.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left")
    return out.select(F.col("doc").alias(name), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_first_of_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id; rows with a null id stay.

    Of rows that repeat an id and a text one stays. Rows that repeat an id with different texts are documents of
    their own: each stays unless its own text is near another's.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeated, apart = repeated_ids(docs)
    nameless = docs.where("doc_id is null")
    if apart:
        rows, _, node = text_nodes(docs)
        _, found = similar_components(rows, node)
        late = found.where("node <> component").select(F.col("node").alias(node))
        return rows.join(late, node, "left_anti").dropDuplicates([node]).select(*columns).unionByName(nameless)
    _, found = similar_components(docs)
    late = found.where("node <> component").select(F.col("node").alias("doc_id"))
    known = docs.where("doc_id is not null").join(late, "doc_id", "left_anti").select(*columns)
    return (known.dropDuplicates(["doc_id"]) if repeated else known).unionByName(nameless)
