"""Benchmark decontamination with DataFrame functions alone: a broadcast hash set of normalised test n-grams, which the
training texts' token windows are scanned with; hits are verified word by word, and spans or documents removed.

Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII. A window is WINDOW consecutive words
of a benchmark item, or all words of a shorter one. A window of m words covers one of the text's blocks of (m + 1) // 2 words
wholly, wherever it stands (blocks begin at multiples of their length). So a text hashes each word once, in its blocks, and
the set holds the items' n-grams of the blocks' lengths. What shares a block is compared with whole windows, as text.

The set is broadcast up to ``BROADCAST_GRAMS`` n-grams; a larger benchmark is cut by hash into as many sets as that bound
asks for, each with a scan of its own. Texts are not shuffled, only contexts of blocks found and one slim row a document.

A null or empty text has no words and no hits; a null or wordless item has no window. Rows that repeat an id, null ids too,
are documents of their own, and equal rows get equal results. Items that repeat an id count once; a null item_id
counts as the empty text. Texts may be of any length. An empty table has no rows; without items nothing is hit. Columns other
than id and text are not looked at and may be called anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage_table

#: Words of a window, and n-grams of a set that is broadcast (a long each, 16 MB in a hash table of longs).
WINDOW = 10
BROADCAST_GRAMS = 1 << 20
#: Documents with hits up to which their list is broadcast when texts are cleaned (an id and spans each).
BROADCAST_DOCS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a lower-cased text, and of a text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Normalised words of a text (null: none)."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def block_words(window: int) -> int:
    """Length of the blocks of which a window of so many words always covers one."""
    return (window + 1) // 2


def _windows(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: item, m (words of the window) and the words."""
    items = bench.select(F.coalesce(bench[item_col].cast("string"), F.lit("")).alias("item"), words_of(bench[text_col]).alias("w")).where("size(w) > 0")
    items = items.select("item", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("m"))
    return items.select("item", "m", F.explode(F.expr("transform(sequence(0, size(w) - m), i -> slice(w, i + 1, m))")).alias("w")).distinct()


def _grams(windows: DataFrame) -> DataFrame:
    """Distinct hashes of the windows' n-grams that may stand as a block."""
    b = "((m + 1) div 2)"
    return windows.select(F.explode(F.expr(f"transform(sequence(0, m - {b}), i -> xxhash64(cast({b} as int), slice(w, cast(i + 1 as int), cast({b} as int))))")).alias("gram")).distinct()


def _blocks(lengths: list[int]) -> str:
    """SQL for a text's blocks: structs of their length, their first word's place and their hash."""
    each = [
        f"if(size(w) >= {b}, transform(sequence(0, size(w) div {b} - 1), j -> struct({b} as b, cast({b} * j as int) as at, xxhash64({b}, slice(w, cast({b} * j + 1 as int), {b})) as gram)), array())"
        for b in lengths
    ]
    return f"concat(array(struct(0 as b, -1 as at, cast(null as bigint) as gram)), {', '.join(each)})"


def _scanned(docs: DataFrame, grams: DataFrame, windows_of: dict[int, list[int]], id_col: str, text_col: str) -> DataFrame:
    """One row a document (b = 0) with its number of words, and one for each block found, with the words about it."""
    longest = reduce(lambda rest, b: F.when(F.col("x.b") == b, max(windows_of[b])).otherwise(rest), windows_of, F.lit(0))
    own = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col].cast("string")).alias("h"), words_of(docs[text_col]).alias("w"))
    own = own.select("doc", "h", "w", F.explode(F.expr(_blocks(sorted(windows_of)))).alias("x"))
    found = own.join(F.broadcast(grams.withColumn("known", F.lit(True))), F.col("x.gram") == F.col("gram"), "left").where("x.b = 0 or known")
    low = F.greatest(F.lit(0), F.col("x.at") + F.col("x.b") - longest)
    found = found.select("doc", "h", F.size("w").alias("n"), F.col("x.b").alias("b"), F.col("x.at").alias("at"), low.alias("low"), F.when(F.col("x.b") > 0, F.slice("w", low + 1, F.col("x.at") + longest - low)).alias("near"))
    return found


def window_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Table of documents (doc, h: hash of the text, n: words), a row each, and of distinct verified hits (doc, h, s: place of
    the first word, m: words, item)."""
    windows = stage_table(_windows(bench, item_col, item_text_col), "windows")
    lengths = [r.m for r in windows.select("m").distinct().collect()]  # WINDOW rows at most
    windows_of: dict[int, list[int]] = {}
    for m in lengths:
        windows_of.setdefault(block_words(m), []).append(m)
    if not windows_of:
        own = docs.select(docs[id_col].alias("doc"), F.xxhash64(docs[text_col].cast("string")).alias("h"), F.size(words_of(docs[text_col])).alias("n"))
        return own, own.limit(0).select("doc", "h", F.lit(0).alias("s"), F.lit(0).alias("m"), F.lit("").alias("item"))
    grams = stage_table(_grams(windows), "grams")
    n = grams.count()
    parts = -(-n // BROADCAST_GRAMS)
    scans = [_scanned(docs, grams.where(F.pmod("gram", F.lit(parts)) == p), windows_of, id_col, text_col).where(f"b > 0 or {p} = 0") for p in range(parts)]
    scan = stage_table(reduce(DataFrame.union, scans), "scan")
    own = scan.where("b = 0").select("doc", "h", "n")

    tried = []
    for b, sizes in windows_of.items():
        for m in sizes:
            places = F.expr(f"sequence(greatest(low, at + {b} - {m}), least(at, n - {m}))")
            tried.append(scan.where(f"b = {b} and least(at, n - {m}) >= greatest(low, at + {b} - {m})").select("doc", "h", "low", "near", F.lit(m).alias("m"), F.explode(places).alias("s")))
    tried = reduce(DataFrame.union, tried).select("doc", "h", "s", "m", F.expr("slice(near, s - low + 1, m)").alias("w")).distinct()
    known = windows.select("item", F.array_join("w", " ").alias("text"))
    if windows.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    hits = tried.select("doc", "h", "s", "m", F.array_join("w", " ").alias("text")).join(known, "text").select("doc", "h", "s", "m", "item")
    return own, stage_table(hits, "hits")


def hit_spans(hits: DataFrame) -> DataFrame:
    """Merged runs of hit words: doc, h, s (first word) and e (behind the last)."""
    places = hits.select("doc", "h", "s", (F.col("s") + F.col("m")).alias("e")).distinct()
    order = Window.partitionBy("doc", "h").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("new", F.coalesce((F.col("s") > before).cast("int"), F.lit(1)))
    places = places.withColumn("run", F.sum("new").over(order))
    return places.groupBy("doc", "h", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit (words inside a window's occurrence), n_items and items_sha256 (of the ids
    of items with such windows, sorted as strings, comma-joined), contaminated."""
    own, hits = window_hits(docs, bench, id_col, text_col, item_col, item_text_col)
    spans = hit_spans(hits).groupBy("doc", "h").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"))
    items = hits.groupBy("doc", "h").agg(F.array_sort(F.collect_set("item")).alias("items"))
    known = spans.alias("p").join(items.alias("q"), F.expr("p.doc <=> q.doc and p.h <=> q.h")).selectExpr("p.doc as k_doc", "p.h as k_h", "n_hit", "items")
    out = own.join(known, F.expr("doc <=> k_doc and h <=> k_h"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("doc").alias(id_col), F.col("n").cast("long").alias(fresh([id_col], "n_words")), hit.alias(fresh([id_col], "n_hit")), F.size(items).cast("long").alias(fresh([id_col], "n_items")),
        F.sha2(F.array_join(items, ","), 256).alias(fresh([id_col], "items_sha256")), (hit > 0).alias(fresh([id_col], "contaminated")),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, how: str = "spans", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the hit words (``spans``: each run goes with what stands between its words, the rest of the text stays
    as it is, and what a cut brings together is not looked at again) or without the documents that hold any (``documents``). Columns, other rows and null texts stay."""
    if how not in ("spans", "documents"):
        raise ValueError(f"how is spans or documents, not {how}")
    _, hits = window_hits(docs, bench, id_col, text_col, item_col, item_text_col)
    runs = hit_spans(hits).groupBy("doc", "h").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    names = [fresh(docs.columns, x) for x in ("hit_doc", "hit_h", "hit_runs")]
    runs = stage_table(runs.toDF(*names), "runs")
    small = F.broadcast(runs) if runs.count() <= BROADCAST_DOCS else runs
    same = docs[id_col].eqNullSafe(F.col(names[0])) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(F.col(names[1]))
    if how == "documents":
        return docs.join(small, same, "left_anti")
    both = docs.join(small, same, "left")
    text, spans = f"cast(`{text_col}` as string)", f"`{names[2]}`"
    pieces = f"zip_with(split({text}, r'{CASED_WORD}', -1), concat(regexp_extract_all({text}, r'{CASED_WORD}', 0), array('')), (gap, word) -> struct(gap, word))"
    cut = f"""array_join(transform({pieces}, (x, i) ->
        concat(if(exists({spans}, r -> i > r.s and i < r.e), '', x.gap), if(exists({spans}, r -> i >= r.s and i < r.e), '', x.word))), '')"""
    return both.select(*[F.when(F.col(names[2]).isNull(), F.col(f"`{c}`")).otherwise(F.expr(cut)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
