"""Exact inner-product retrieval under payload filters.

Scores are summed in double precision; ties go to the smaller ordinal. Queries are a set of stated rows: it is
broadcast only where the optimizer finds its size small, else both sides are hashed on their scope.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import written
from .blocks import best_in_blocks
from .guards import require, valid_hits


#: Queries that are broadcast at most; more meet the rows as a product of partitions.
BROADCAST_QUERIES = 4096
#: Bits that a round of selection counts, and ranks in search up to which they are broadcast.
DIGIT, BROADCAST_TARGETS = 16, 1 << 16
#: Centres of an inverted file at most.
CELLS = 4096


def inner_product(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def payload_matches(filters: Mapping[str, Any] | None, value: Any = F.col) -> Column:
    """All filters hold. A scalar is equality; a mapping may hold eq, ne and in. A missing value counts as null;
    unknown operators are rejected."""
    tests: list[Column] = []
    for key, want in (filters or {}).items():
        have = value(key)
        for op, operand in want.items() if isinstance(want, Mapping) else [("eq", want)]:
            if op == "eq":
                tests.append(have.eqNullSafe(F.lit(operand)))
            elif op == "ne":
                tests.append(~have.eqNullSafe(F.lit(operand)))
            elif op == "in":
                known = [x for x in operand if x is not None]
                test = F.coalesce(have.isin(*known), F.lit(False)) if known else F.lit(False)
                tests.append(test | have.isNull() if len(known) < len(operand) else test)
            else:
                raise ValueError(f"unknown filter operator: {op}")
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None, id_col: str = "id", ordinal: str = "ordinal", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", floor: str | None = None) -> DataFrame:
    """The k best rows for every query: query_id, id, score, distance (-score) and rank from 1.

    With ``scope`` a query meets only rows of its scope (an equality join). Without, queries are joined to every row, a
    stated query set against all rows, in blocks that meet as matrices; ``floor`` names a column of the queries below which
    no score is wanted. A bounded number of rows per query and partition survives before the shuffle, as the window's limit
    is pushed below it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if scope and floor:
        raise ValueError("a floor goes with queries of all rows")
    own = vectors.select(F.col(id_col).alias("id"), F.col(ordinal).alias("ordinal"), F.col(vector).alias("v"), *([F.col(scope).alias("s")] if scope else []))
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q"), *([F.col(scope).alias("s")] if scope else []), (F.col(floor) if floor else F.lit(None)).cast("double").alias("floor"))
    scored = own.join(asked, "s").select("query_id", "id", "ordinal", inner_product(F.col("v"), F.col("q")).alias("score")) if scope else best_in_blocks(own, asked, k, BROADCAST_QUERIES)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "id", "score", (-F.col("score")).alias("distance"), "rank")


def search(vectors: DataFrame, query: list[float], k: int, filters: Mapping[str, Any] | None = None, id_col: str = "id", ordinal: str = "ordinal", vector: str = "vector") -> DataFrame:
    """Best k rows for one vector among those that pass the filters."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(payload_matches(filters)).select(F.col(id_col).alias("id"), F.col(ordinal).alias("ordinal"), inner_product(F.col(vector), q).alias("score"))
    best = scored.orderBy(F.desc("score"), "ordinal").limit(max(1, k))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ordinal")))  # at most k rows
    return ranked.select("id", "score", (-F.col("score")).alias("distance"), "rank")


def list_rows(rows: DataFrame, filters: Mapping[str, Any] | None = None, limit: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """Rows that pass, by ordinal, with rank from 1 and score and distance 0."""
    out = rows.where(payload_matches(filters))
    if limit is not None:
        out = out.orderBy(ordinal).limit(max(0, limit))
        return out.withColumn("rank", F.row_number().over(Window.orderBy(ordinal))).withColumns({"score": F.lit(0.0), "distance": F.lit(0.0)})
    # without a limit ranks come from counts of ranges, not from one global window
    return ranked_by(out, ordinal).withColumns({"score": F.lit(0.0), "distance": F.lit(0.0)})


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of an order (nulls first), written: __at holds the range's number (from bit 33 on) and the row's in it.

    Spark samples the keys and cuts them into ranges; rows of one key may stand in several, as a salt goes with the key. One
    shuffle of the rows and one write, at the time of the call.
    """
    salt = F.xxhash64(F.monotonically_increasing_id())
    keys = [F.col(f"`{c}`") for c in order]
    return written(df.withColumn("__salt", salt).repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__salt"), "ranked")


def ranked_by(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Global 1-based position in an order (nulls first), exact at any size; equal keys have distinct positions. Rows are
    numbered in their ranges, which are counted."""
    rows = numbered(df, *order)
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row per range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = rows.join(F.broadcast(before), part == F.col("__part"))
    return out.withColumn(name, (F.col("__before") + row + 1).cast("long")).drop("__part", "__before", "__at")


def order_key(value: Column) -> Column:
    """A long that rises with a double, as its bits do: exponent and mantissa, negated below zero. Zeros are alike, NaN is last."""
    a = F.abs(value)
    near = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(a)).cast("int")))
    base = F.pow(F.lit(2.0), near)
    e = F.greatest(F.lit(-1022), F.when(a < base, near - 1).when(a >= base * 2, near + 1).otherwise(near))
    size = ((e + 1022).cast("long") * F.lit(1 << 52)) + (a / F.pow(F.lit(2.0), e - 52)).cast("long")
    size = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).otherwise(size)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -size).otherwise(size)


def order_statistics(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float]) -> DataFrame:
    """Interpolated quantiles of the non-null values of each group: by, fraction, quantile.

    Found by selection: values become longs of the same order; each round counts the next DIGIT bits of those that share the bits
    found so far with a rank that is asked for, and ends for ranks whose bucket holds one value alone. Rows are neither sorted
    nor shuffled, only counts are, a row for each digit that occurs; repeated values cost nothing. Up to BROADCAST_TARGETS ranks
    go from round to round through the driver, more as a written table.
    """
    groups = [f"__g{i}" for i in range(len(by))]
    own = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(value).cast("double").alias("__v"))
    own = own.withColumn("__key", order_key(F.col("__v")))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups], F.lit(True))
    counted = [F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]
    shift = 64 - DIGIT
    counts = written(own.groupBy(*groups, F.shiftright("__key", shift).alias("__digit")).agg(*counted), "digits")  # read three times
    per = counts.groupBy(*groups).agg(F.sum("__n").alias("__all"))
    asked = per.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("__place", (F.col("__all") - 1) * F.col("fraction"))
    low = F.floor("__place")
    asked = asked.withColumn("__pick", F.explode(F.array(*[F.struct(F.least(F.col("__all") - 1, low + k).alias("rank"), w.alias("w")) for k, w in ((0, 1 - (F.col("__place") - low)), (1, F.col("__place") - low))])))
    asked = asked.select(*groups, "fraction", F.col("__pick.rank").alias("__rank"), F.col("__pick.w").alias("__w"))
    targets = asked.select(*groups, "__rank", F.lit(0).cast("long").alias("__bits"), F.col("__rank").alias("__left")).distinct()
    found, prefix = [], F.lit(0).cast("long")
    while True:
        of = Window.partitionBy(*groups, "__bits").orderBy("__digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = counts.withColumn("__bits", prefix).withColumn("__upto", F.sum("__n").over(of))
        hit = targets.alias("t").join(placed.alias("c"), same("t", "c") & (F.col("t.__bits") == F.col("c.__bits")) & (F.col("__left") < F.col("__upto")) & (F.col("__left") >= F.col("__upto") - F.col("__n")))
        state = hit.select(*[F.col(f"t.{g}").alias(g) for g in groups], "__rank", F.col("__digit").alias("__bits"), (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left"), F.col("__low").alias("__found"), (~F.col("__low").eqNullSafe(F.col("__high"))).alias("__open"))
        rows = state.limit(BROADCAST_TARGETS + 1).collect()
        few = len(rows) <= BROADCAST_TARGETS
        state = df.sparkSession.createDataFrame(rows, state.schema) if few else written(state, "targets")
        found.append(state.where("not __open").select(*groups, "__rank", "__found"))
        if not shift or not (any(r["__open"] for r in rows) if few else state.where("__open").limit(1).count()):
            break
        targets = state.where("__open").select(*groups, "__rank", "__bits", "__left")
        before, shift = shift, shift - DIGIT
        wanted = targets.select(*groups, "__bits").distinct()
        wanted = F.broadcast(wanted) if few else wanted
        rest = own.alias("o").join(wanted.alias("w"), same("o", "w") & (F.shiftright("__key", before) == F.col("__bits"))).select(*[F.col(f"o.{g}").alias(g) for g in groups], "__key", "__v")
        counts = rest.groupBy(*groups, F.shiftright("__key", shift).alias("__digit")).agg(*counted)
        prefix = F.shiftright("__digit", DIGIT)
    values = reduce(DataFrame.union, found)
    got = asked.alias("a").join(values.alias("v"), same("a", "v") & (F.col("a.__rank") == F.col("v.__rank")))
    got = got.groupBy(*[F.col(f"a.{g}").alias(g) for g in groups], "fraction").agg(F.sum(F.when(F.col("__w") > 0, F.col("__found") * F.col("__w")).otherwise(0.0)).alias("quantile"))
    return got.select(*[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], "fraction", "quantile")


def point_lookup(rows: DataFrame, item: Any, id_col: str = "id", ordinal: str = "ordinal") -> DataFrame:
    """The row with an id: score 1, distance 0, rank its ordinal + 1."""
    return rows.where(F.col(id_col) == F.lit(item)).limit(1).withColumns({"score": F.lit(1.0), "distance": F.lit(0.0), "rank": F.col(ordinal) + 1})


def hits_with_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits joined to their facts: a hit without a fact, or whose text differs, raises; distance is 1 - score."""
    known = facts.select(F.col("fact_id"), F.col("text").alias("__text"), *[c for c in facts.columns if c not in {"fact_id", "text"}])
    out = hits.join(known, "fact_id", "left")
    out = require(out, F.col("__text").isNotNull(), F.concat(F.lit("unknown fact: "), F.col("fact_id").cast("string")))
    out = require(out, F.col("text") == F.col("__text"), F.concat(F.lit("text differs: "), F.col("fact_id").cast("string")))
    out = require(out, F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < 1e30), "score is not finite")
    return out.withColumn("distance", 1 - F.col("score")).drop("__text")


def prepared_hits(found: DataFrame, facts: DataFrame, k: int, query_id: str = "query_id") -> DataFrame:
    """What a prepared store hands out of an outside ranker's rows (query_id, fact_id, text, score): the k best of each query by score,
    then id, with rank and distance 1 - score, joined to their facts. A fact that is found twice for a query raises, as do one
    that isn't known, another text, and a score that isn't finite."""
    if k < 1:
        raise ValueError("k must be at least 1")
    once = Window.partitionBy(query_id, "fact_id")
    own = require(found.withColumn("__n", F.count(F.lit(1)).over(once)), F.col("__n") == 1, F.concat(F.lit("found twice: "), F.col("fact_id").cast("string"))).drop("__n")
    best = own.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "fact_id"))).where(F.col("rank") <= k)
    return hits_with_facts(best, facts)


def approximate_top_k(vectors: DataFrame, queries: DataFrame, k: int, cells: DataFrame, probe: int = 4) -> DataFrame:
    """Inverted-file search (approximate): rows live in the cell of their nearest centre; a query looks into the
    ``probe`` best cells. ``cells`` (cell, centre) are the centres of a fitted quantiser, CELLS at most: they travel as
    one array, so that finding cells shuffles nothing."""
    if cells.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"more than {CELLS} cells")
    centres = cells.agg(F.collect_list(F.struct("cell", "centre")).alias("__centres"))

    def nearest(df: DataFrame, vector: str, n: int) -> DataFrame:
        scored = F.transform("__centres", lambda c: F.struct(inner_product(F.col(vector), c["centre"]).alias("s"), c["cell"].alias("cell")))
        best = F.slice(F.sort_array(scored, asc=False), 1, n) if n > 1 else F.array(F.array_max(scored))
        return df.crossJoin(F.broadcast(centres)).withColumn("__best", F.explode(best)).withColumn("cell", F.col("__best.cell")).drop("__best", "__centres")

    return top_k(nearest(vectors, "vector", 1), nearest(queries, "query_vector", probe), k, scope="cell")


def pushable(filters: Mapping[str, Any] | None) -> bool:
    """Whether a backend's own filter can express the filters: eq, ne and in over strings, whole numbers and booleans;
    others (numbers with a fraction, null, empty or unknown operators, booleans in a list) are tested after the scan."""
    def plain(x: Any) -> bool:
        return isinstance(x, (str, int))

    for want in (filters or {}).values():
        if not isinstance(want, Mapping):
            if not plain(want):
                return False
            continue
        if not want or not set(want) <= {"eq", "ne", "in"}:
            return False
        listed = want.get("in", [""])
        if not isinstance(listed, list) or not listed or not all(plain(x) and not isinstance(x, bool) for x in listed):
            return False
        if not all(plain(want[op]) for op in ("eq", "ne") if op in want):
            return False
    return bool(filters)


def split_filters(filters: Mapping[str, Any] | None) -> tuple[dict[str, Any], dict[str, Any]]:
    """Filters that a backend's own filter can express, and those that are tested behind the scan. All of both must hold."""
    pushed = {k: v for k, v in (filters or {}).items() if pushable({k: v})}
    return pushed, {k: v for k, v in (filters or {}).items() if k not in pushed}


def dispatch(k: int, count: int, matching: int, finalised: bool, filtered: bool, beam: int) -> dict[str, Any]:
    """How a store of ``count`` rows, of which ``matching`` pass the filters, is searched: the k that is asked for, the
    candidates, the beam, and whether the approximate index serves (finalised, no filter that leaves rows out, fewer
    candidates than rows)."""
    k = max(1, min(k, count))
    selective = filtered and matching < count
    candidates = count if selective else k
    return {"k": k, "candidates": candidates, "beam": max(beam, k), "approximate": finalised and not selective and candidates < count}


def dispatched_search(vectors: DataFrame, query: Sequence[float], k: int, filters: Mapping[str, Any] | None = None, cells: DataFrame | None = None, beam: int = 64, id_col: str = "id", ordinal: str = "ordinal", vector: str = "vector") -> DataFrame:
    """Search under the rules of ``dispatch``: with ``cells`` the store is finalised and its inverted file may serve; where
    it finds fewer rows than asked for, the exact search answers. An empty store has no hits; a query of another dimension
    raises."""
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(payload_matches(filters)).alias("matching"), F.max(F.size(vector)).alias("dim")).first()
    if not sizes.n:
        return search(vectors, list(query), 1, filters, id_col, ordinal, vector)
    if len(query) != sizes.dim:
        raise ValueError(f"query dim {len(query)} does not match store dim {sizes.dim}")
    plan = dispatch(k, sizes.n, sizes.matching, cells is not None, bool(filters), beam)
    if plan["approximate"]:
        own = vectors.select(F.col(id_col).alias("id"), F.col(ordinal).alias("ordinal"), F.col(vector).alias("vector"))
        asked = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query_vector array<double>")
        near = approximate_top_k(own, asked, plan["k"], cells).drop("query_id")
        if near.count() == plan["k"]:
            return near
    return search(vectors, list(query), plan["k"], filters, id_col, ordinal, vector)


def adapter_search(vectors: DataFrame, query: Sequence[float] | Sequence[Sequence[float]], k: int | None = 5, filters: Mapping[str, Any] | None = None, id_col: str = "id", ordinal: str = "ordinal", vector: str = "vector") -> DataFrame:
    """Search as the memory layer calls it: k is 5 unless given and at least 1, the first of several query vectors counts,
    and hits that break the contract raise (as many as min(k, rows that pass), distinct ids, ranks without gaps, finite
    scores)."""
    k = 5 if k is None else int(k)
    if k < 1:
        raise ValueError("k must be at least 1")
    if len(query) and isinstance(query[0], (list, tuple)):
        query = query[0]
    if not len(query):
        raise ValueError("no query vector")
    hits = dispatched_search(vectors, query, k, filters, id_col=id_col, ordinal=ordinal, vector=vector)
    matching = vectors.where(payload_matches(filters)).agg(F.least(F.lit(k), F.count(F.lit(1))).alias("expected"))
    bad = valid_hits(hits.crossJoin(F.broadcast(matching)).withColumn("query_id", F.lit(0)), F.col("expected"))
    found = bad.agg(F.max("problem").alias("problem"))
    short = matching.crossJoin(F.broadcast(hits.agg(F.count(F.lit(1)).alias("n")))).select((F.col("n") == F.col("expected")).alias("enough"))
    checked = require(hits.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(short)), F.col("problem").isNull() & F.col("enough"), F.concat(F.lit("bad hits: "), F.coalesce("problem", F.lit("count"))))
    return checked.select("id", "score", "distance", "rank")
