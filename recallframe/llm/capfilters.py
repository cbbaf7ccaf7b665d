"""Embedding near-duplicates by spherical-cap filters.

Directions come from a structured random product code: a seeded rotation, then one codebook for each half of the
space; every pair of code words is a direction (CODE**2 of them for 2 * CODE stored words). Each vector is
list-decoded to all directions whose cap holds it, without looking at the others: sorted scores of one half are cut
at what the other half can still add. Vectors meet in the filters that they share and are verified by cosine in
double precision; a pair counts in the smallest filter that it shares.

Equal vectors are one class and count by their number. A filter with many vectors is dealt into tiles, and pairs of
tiles are separate groups, so that no group is larger than about two tiles. Vectors that are null, empty, zero or
hold null or non-finite components, null labels and null ids link with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage_table, fresh, released, stage_table
from .components import connected_components

COSINE = 0.93
CODE = 256
#: Cap height in standard deviations of a random direction's score; about 14 of 65,536 caps hold a vector.
HEIGHT = 3.4
#: Directions that a vector gets at least: the nearest ones, where fewer caps hold it.
LEAST = 32
#: Vectors of a tile; rows that are compared at once, and filters that are looked at together.
TILE, ROWS, NAMES = 8192, 256, 512
SEED = 5


@lru_cache(maxsize=8)
def product_code(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two codebooks for vectors of a dimension."""
    rng = np.random.default_rng([SEED, dim])
    q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    half = max(1, dim // 2)
    books = [rng.normal(size=(CODE, n)) for n in (half, max(1, dim - half))]
    return q, *[b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]


def list_decode(unit: np.ndarray) -> list[np.ndarray]:
    """For each unit vector the directions whose cap holds it, sorted."""
    n, dim = unit.shape
    q, first, second = product_code(dim)
    x = unit @ q
    half = first.shape[1]
    s = x[:, :half] @ first.T
    t = x[:, half:] @ second.T if dim > half else np.zeros((n, CODE))
    mark = HEIGHT * np.sqrt(2.0 / dim)
    order = np.argsort(-t, axis=1)
    out = []
    for i in range(n):
        best = t[i, order[i]]
        rows = np.flatnonzero(s[i] >= mark - best[0])
        found = [r * CODE + order[i, : np.searchsorted(-best, s[i, r] - mark, side="right")] for r in rows]
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(hits) < LEAST:
            r, c = np.argsort(-s[i], kind="stable")[:LEAST], order[i, :LEAST]
            near = np.add.outer(s[i, r], t[i, c])
            at = np.argsort(-near, axis=None, kind="stable")[:LEAST]
            hits = np.unique(np.concatenate([hits, r[at // len(c)] * CODE + c[at % len(c)]]))
        out.append(np.sort(hits).astype(np.int32))
    return out


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec, label, v (float or double components) and key (digest of the components; null where a row links with nothing)
    of every row."""
    kept = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    own = vectors.select(F.col(f"`{id_col}`").alias("vec"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast(kept).alias("v"))
    fine = "vec is not null and label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = cast('infinity' as double)) and exists(v, x -> x <> 0)"
    key = "md5(array_join(transform(v, x -> cast(cast(x as double) + 0.0D as string)), ','))"
    return own.select("vec", "label", "v", F.expr(f"case when {fine} then {key} end").alias("key"))


def filters_of(classes: DataFrame) -> DataFrame:
    """vec and its filters, for rows vec, v."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray | None] = [None] * len(batch)
            col = batch.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.values.to_numpy().astype(np.float64)[col.offsets[0].as_py() :]
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for r, f in zip(rows.tolist(), list_decode(x), strict=True):
                    lists[r] = f
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["vec", "filters"])

    return classes.select("vec", "v").mapInArrow(released(decode), f"vec {classes.schema['vec'].dataType.simpleString()}, filters array<int>")


def linked_in_tile(copies: np.ndarray, tile: np.ndarray, x: np.ndarray, below: list[np.ndarray], cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For one filter's pair of tiles: partners found for each row, and links (row, row) that span what is linked. ``below``
    are each row's filters before this one: a pair that shares one of them is counted there. Rows are compared with all
    in blocks of ROWS; of the pairs a bit each is kept."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    n = len(copies)
    count = np.zeros(n, np.int64)
    two = tile.min() != tile.max()
    place = np.arange(n)

    def close_to(first: int, least: float) -> np.ndarray:
        """Of a block's rows the later ones that are close."""
        close = unit[first : first + ROWS] @ unit.T >= least
        close &= place[None, :] > place[first : first + ROWS, None]
        if two:  # pairs within a tile have a group of their own
            close &= tile[first : first + ROWS, None] != tile[None, :]
        return close

    near = np.zeros(n, bool)
    for first in range(0, n, ROWS):
        close = close_to(first, cosine - 1e-9)
        near[first : first + ROWS] |= close.any(1)
        near |= close.any(0)
    rows = np.flatnonzero(near)
    if not len(rows):
        return count, []
    unit, tile, place, parts = unit[rows], tile[rows], np.arange(len(rows)), copies[rows]
    blocks = range(0, len(rows), ROWS)
    bits = np.zeros((len(rows), -(-len(rows) // 8)), np.uint8)  # of each row the later ones that are close
    for first in blocks:
        bits[first : first + ROWS] = np.packbits(close_to(first, cosine), axis=1)
    # pairs that share a filter before this one go; filters that most rows have come first, so that little is left for the others
    listed = [below[r] for r in rows]
    names, where, held = np.unique(np.concatenate(listed), return_inverse=True, return_counts=True)
    by_use = np.argsort(-held, kind="stable")
    by_use = by_use[held[by_use] > 1]
    column = np.full(len(names), -1)
    column[by_use] = np.arange(len(by_use))
    where, owner = column[where], np.repeat(place, [len(f) for f in listed])
    low, step = 0, NAMES // 8
    while low < len(by_use):
        own = (where >= low) & (where < low + step)
        member = np.zeros((len(rows), min(step, len(by_use) - low)), np.float32)
        member[owner[own], where[own] - low] = 1
        for first in blocks:
            if bits[first : first + ROWS].any():
                bits[first : first + ROWS] &= ~np.packbits(member[first : first + ROWS] @ member.T > 0, axis=1)
        low, step = low + step, NAMES
    both = bits.copy()  # partners on either side
    for first in blocks:
        close = np.unpackbits(bits[first : first + ROWS], axis=1, count=len(rows)).astype(bool)
        count[rows[first : first + ROWS]] += close @ parts
        count[rows] += parts[first : first + ROWS] @ close
        both[:, first // 8 : -(-(first + len(close)) // 8)] |= np.packbits(close.T, axis=1)
    links = []
    new = both.any(1)
    for root in np.flatnonzero(new):
        if not new[root]:
            continue
        new[root] = False
        reached = np.array([root])
        while len(reached):
            reached = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(both[reached], axis=0), count=len(rows)).astype(bool) & new)
            new[reached] = False
            links += [(int(rows[root]), int(rows[i])) for i in reached]
    return count, links


def suspects(unit: np.ndarray, group: np.ndarray, cosine: float) -> np.ndarray:
    """Groups (numbered along the rows) that hold a close pair, by comparing each row with the k-th after it."""
    found = []
    for k in range(1, len(group)):
        at = np.flatnonzero(group[k:] == group[:-k])
        if not len(at):
            break
        close = np.einsum("ij,ij->i", unit[at], unit[at + k]) >= cosine - 1e-9
        found.append(group[at[close]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def verified_tiles(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): rows with b null count n links of a, the others are links.

    Groups end before the next key begins; an unfinished one waits for the next batch.
    """
    kind = rows.schema["vec"].dataType.simpleString()
    small = 48

    def settle(t: pa.RecordBatch, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(start) - 1), np.diff(start))
        size = np.diff(start)
        v = t.column("v")
        width = np.diff(v.offsets.to_numpy())
        flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)[v.offsets[0].as_py() :]
        at = np.concatenate([[0], np.cumsum(width)])
        busy = np.flatnonzero(size > small).tolist()
        for dim in np.unique(width).tolist():
            own = np.flatnonzero((width == dim) & (size[group] <= small) & (size[group] > 1))
            if len(own):
                x = flat[at[own][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                busy += suspects(x / np.linalg.norm(x, axis=1, keepdims=True), group[own], cosine).tolist()
        ids, copies, tile = t.column("vec"), t.column("copies").to_numpy(), t.column("tile").to_numpy()
        lists = t.column("filters")
        edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        for g in busy:
            i, j = int(start[g]), int(start[g + 1])
            x = flat[at[i] : at[j]].reshape(j - i, -1)
            count, links = linked_in_tile(copies[i:j], tile[i:j], x, [values[edges[r] : edges[r + 1]] for r in range(i, j)], cosine)
            hit = np.flatnonzero(count)
            if len(hit):
                a = [*(hit + i).tolist(), *(p + i for p, _ in links)]
                b = [*[None] * len(hit), *(q + i for _, q in links)]
                n = [*count[hit].tolist(), *[0] * len(links)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64())), pa.array(n, pa.int64())], names=["a", "b", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            head = tuple(c[0] for c in cols)
            change = np.zeros(len(batch) - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cut = np.flatnonzero(change) + 1
            if held and head != last:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield from settle(whole, np.array([0, len(whole)]))
                held = []
            if len(cut):
                edge = int(cut[-1])
                if held:
                    whole = pa.Table.from_batches([*held, batch.slice(0, int(cut[0]))]).combine_chunks().to_batches()[0]
                    yield from settle(whole, np.array([0, len(whole)]))
                    begin = int(cut[0])
                else:
                    begin = 0
                if begin < edge:
                    inner = np.concatenate([[begin], cut[(cut > begin) & (cut <= edge)]]) - begin
                    part = pa.Table.from_batches([batch.slice(begin, edge - begin)]).combine_chunks().to_batches()[0]
                    yield from settle(part, inner)
                held = [batch.slice(edge)]
            else:
                held.append(batch)
            last = tuple(c[-1] for c in cols)
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from settle(whole, np.array([0, len(whole)]))

    return rows.mapInArrow(released(work), f"a {kind}, b {kind}, n long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id and kept.

    Rows that repeat an id with an equal vector and label count once. Rows that repeat an id with another vector or label
    are vectors of their own, which share the id: each has its own links. An empty table has no rows.
    """
    bound_batches(vectors.sparkSession)
    rows = _usable(vectors, id_col, vector_col, label_col)
    # equal vectors of a label are one class, known by a number from here on
    members = rows.where("key is not null").groupBy("label", "key", "vec").agg(F.first("v").alias("v"))
    classes = members.groupBy("label", "key").agg(F.min("vec").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = stage_table(classes.select(F.monotonically_increasing_id().alias("vec"), "label", "key", "rep", "copies", F.size("v").alias("dim"), "v"), "classes")
    listed = filters_of(classes).join(classes.select("vec", "label", "dim"), "vec")
    entries = stage_table(listed.select("vec", "label", "dim", F.posexplode("filters").alias("pos", "f"), "filters").select("vec", "label", "dim", "f", F.expr("slice(filters, 1, pos)").alias("filters")), "entries")
    groups = entries.groupBy("label", "dim", "f").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = stage_table(groups.select("label", "dim", "f", F.expr(f"cast(ceil(size / {TILE}) as int)").alias("tiles")), "tiles")
    dealt = entries.join(groups, ["label", "dim", "f"]).withColumn("tile", F.expr("cast(pmod(xxhash64(vec), tiles) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = dealt.select("label", "dim", "f", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "vec", "tile", "filters")
    met = dealt.join(classes.select("vec", "v", "copies"), "vec").select("label", "dim", "f", "t1", "t2", "vec", "tile", "filters", "copies", "v")
    met = met.repartition("label", "dim", "f", "t1", "t2").sortWithinPartitions("label", "dim", "f", "t1", "t2")
    found = stage_table(verified_tiles(met, cosine), "found")
    drop_stage_table(entries, groups)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null")).withColumnRenamed("node", "vec")
    ids = classes.select("vec", "rep").join(comps, "vec")
    least = ids.groupBy("component").agg(F.min("rep").alias("least"))
    ids = ids.join(least, "component").select("vec", "least")
    state = classes.select("vec", "label", "key", "rep", "copies").join(counts, F.col("vec") == F.col("a"), "left").join(ids, "vec", "left")
    state = state.select(F.col("label").alias("c_label"), F.col("key").alias("c_key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    state = stage_table(state, "state")
    drop_stage_table(found, classes)
    out = rows.select("vec", "label", "key").join(state, (F.col("key") == F.col("c_key")) & (F.col("label") == F.col("c_label")), "left")
    return out.select(F.col("vec").alias(fresh(["n_links", "component_id", "kept"], id_col)), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec").alias("component_id"), F.coalesce(F.col("component_id") == F.col("vec"), F.lit(True)).alias("kept"))
