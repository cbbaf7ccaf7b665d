"""Vector-store rows as tables: append or upsert, update, delete, payload normalisation, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mebibytes
from .guards import require
from .retrieval import ranked_by

# Keys that stand both in a payload and in its metadata.
MIRRORED_KEYS = (
    "fact_id", "user_id", "sample_id", "created_at", "timestamp", "timestamp_epoch", "source_session_index", "source_session_id",
    "source_turn_index", "source_turn_id", "turn_id", "session_id", "turn_index", "speaker", "source_role", "role",
)


def append(store: DataFrame, fresh: DataFrame, order: str = "seq") -> DataFrame:
    """Rows added at the end, ids repeated or not: ordinals go on from the largest."""
    numbered = ranked_by(fresh, order, name="__n")
    last = store.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("__last"))  # one row
    added = numbered.crossJoin(F.broadcast(last)).withColumn("ordinal", (F.col("__last") + F.col("__n")).cast("long"))
    return store.unionByName(added.select(*store.columns))


def inserted(store: DataFrame, rows: DataFrame, dim: int | None = None, order: str = "seq", seed: str = "") -> DataFrame:
    """Rows (id, fact_id, vector, ...) added at the end under stable ids: a row's fact id, else the id that it was given.
    If any row has neither, all get new ones, drawn from a digest. A vector of another dimension, or one that is no list of
    numbers, raises."""
    stable = F.coalesce(F.col("fact_id").cast("string"), F.col("id").cast("string"))
    nameless = rows.agg(F.coalesce(F.max(stable.isNull()), F.lit(False)).alias("__nameless"))  # one row
    wide = store.agg(F.max(F.size("vector")).alias("__dim")) if dim is None else None
    own = rows.withColumn("vector", F.col("vector").cast("array<float>"))
    own = own.crossJoin(F.broadcast(wide)) if wide is not None else own.withColumn("__dim", F.lit(dim))
    fits = F.col("vector").isNotNull() & (F.col("__dim").isNull() | (F.size("vector") == F.col("__dim")))
    own = require(own, fits, F.concat(F.lit("vector dim "), F.coalesce(F.size("vector").cast("string"), F.lit("null")), F.lit(" does not match store dim "), F.coalesce(F.col("__dim").cast("string"), F.lit("null"))))
    own = own.crossJoin(F.broadcast(nameless)).withColumn("id", F.when(F.col("__nameless"), F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(order).cast("string")), 256)).otherwise(stable))
    return append(store, own.select(*[c for c in store.columns if c != "ordinal"], *([order] if order not in store.columns else [])), order)


def collection_info(store: DataFrame, name: str, backend: str, vector: str = "vector") -> DataFrame:
    """A collection's name, backend, number of vectors and dimension."""
    return store.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size(vector)).alias("embedding_dim")).select(F.lit(name).alias("name"), F.lit(backend).alias("backend"), "vectors", "embedding_dim")


def reset(store: DataFrame) -> DataFrame:
    """The store without rows."""
    return store.where(F.lit(False))


def require_inner_product(distance: str) -> None:
    """Collections know no other distance."""
    if distance != "inner_product":
        raise ValueError(f"distance must be inner_product, got {distance!r}")


def point_hits(points: DataFrame, id_key: str) -> DataFrame:
    """Points of an outside store (id, payload map, score, rank) as hits: the original id stands in the payload, which loses
    it; a missing score is 0 and distance is -score."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    payload = F.coalesce(F.col("payload"), F.create_map().cast("map<string,string>"))
    return points.select(F.coalesce(F.try_element_at(payload, F.lit(id_key)), F.col("id").cast("string")).alias("id"), F.map_filter(payload, lambda k, v: k != id_key).alias("payload"), score.alias("score"), (F.lit(0.0) - score).alias("distance"), "rank")


def upsert(store: DataFrame, fresh: DataFrame, order: str = "seq", key: str = "id") -> DataFrame:
    """Rows with new ids are appended, those with known ids replaced at their ordinal; of rows that repeat an id the
    last counts."""
    cols = [c for c in store.columns if c not in {key, "ordinal"}]
    newest = fresh.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__new"), F.min(order).alias(order))
    old = store.join(newest.select(key, "__new"), key, "left")
    kept = old.select(key, "ordinal", *[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in cols]).select(*store.columns)
    added = newest.join(store.select(key), key, "left_anti").select(key, order, *[F.col("__new")[c].alias(c) for c in cols])
    return append(kept, added, order)


def update(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of ``changes`` that are not null replace those of the row; an unknown id raises."""
    cols = [c for c in changes.columns if c != key]
    known = store.select(key, F.lit(True).alias("__known"))
    checked = require(changes.join(known, key, "left"), F.col("__known"), F.concat(F.lit("unknown id: "), F.col(key).cast("string"))).drop("__known")
    fresh = checked.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = store.join(fresh, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in store.columns])


def delete(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Without the rows of some ids; ordinals close up. Unknown ids do nothing."""
    left = store.join(ids.select(key), key, "left_anti")
    return ranked_by(left, "ordinal", name="__n").withColumn("ordinal", F.col("__n") - 1).select(*store.columns)


def payload_text(memory: str = "memory", data: str = "data", text: str = "text") -> dict[str, Column]:
    """The three text fields of a payload: each missing one takes the first that is filled."""
    filled = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (memory, data, text)], F.lit(""))
    return {c: F.coalesce(F.col(c), filled) for c in (memory, data, text)}


def mirrored(top: str, metadata: str, keys: Sequence[str] = MIRRORED_KEYS) -> tuple[Column, Column]:
    """Two string maps that share keys: each takes what it lacks (null or absent) from the other, for those keys."""
    def fill(own: str, other: str) -> Column:
        mine = F.map_filter(F.coalesce(F.col(own), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
        theirs = F.map_filter(F.coalesce(F.col(other), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & k.isin(*keys) & ~F.map_contains_key(mine, k))
        return F.map_concat(mine, theirs)

    return fill(top, metadata), fill(metadata, top)


def promoted(payload: str, metadata: str, primary: str, legacy: str) -> Column:
    """A value of the payload, else of its metadata by the new or the old key; without metadata the payload's old key."""
    top, inner = F.col(payload), F.col(metadata)
    fallback = F.when(inner.isNotNull(), F.coalesce(F.try_element_at(inner, F.lit(primary)), F.try_element_at(inner, F.lit(legacy)))).otherwise(F.try_element_at(top, F.lit(legacy)))
    return F.coalesce(F.try_element_at(top, F.lit(primary)), fallback)


def store_stats(store: DataFrame, vector: str = "vector", width: int = 4) -> DataFrame:
    """Rows, dimension and bytes of the vectors at a component width."""
    out = store.agg(F.count(F.lit(1)).alias("vector_count"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim"))
    return out.withColumn("matrix_bytes", F.col("vector_count") * F.col("dim") * width).withColumn("matrix_mb", mebibytes("matrix_bytes"))


def latest_memories(events: DataFrame) -> DataFrame:
    """Per user the last registered memory; a removal (null tokens) ends it."""
    last = events.groupBy("user_id").agg(F.max_by(F.struct("num_tokens", "num_bytes"), "seq").alias("m"))
    return last.where("m.num_tokens is not null").select("user_id", "m.*")


def memory_stats(events: DataFrame) -> DataFrame:
    return latest_memories(events).agg(F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("num_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, tokens, most layers, bytes, and the devices that hold them."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"), F.max("layers").alias("layers"), F.sum("bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("device")), ",").alias("devices"),
    )
