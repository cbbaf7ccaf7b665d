"""Collections of vector rows that last: immutable row files and versions that are committed by one atomic step.

A collection is a folder. ``versions/N.json`` is its N-th version: backend, distance, dimension, next ordinal and the parts of
which it is made, in order. A part holds rows (id, ordinal, vector, payload) or ids that are gone; of rows with one id that of
the latest part counts, unless a later part takes it away. Nothing is ever changed in place: an insert writes its rows alone,
an update the changed rows, a delete ids. A version appears by a step that fails if it is there already, so of two writers
that began with one version the second raises ``Conflict``, its parts are deleted, and readers never see half a change. A
reader stays with the version that it opened.

Ids are strings without repeats (an insert of a known id replaces the row at its ordinal, as ``store.upsert``); ordinals keep the
order of insertion and leave gaps where rows went, until ``compact`` writes one part and closes them. A null id, or a vector of
another dimension, raises. Files may lie in any file system that Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.written import hadoop_path
from .guards import require
from .retrieval import payload_matches, ranked_by, search
from .store import require_inner_product

ROWS = "id string, ordinal long, vector array<float>, payload map<string,string>"
#: Parts from which a collection should be compacted; reading costs a union and an anti-join for each.
MANY_PARTS = 64
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")


class Conflict(Exception):
    """Another writer committed the version that this one was going to."""


def _read_text(spark: SparkSession, path: str) -> str:
    at, fs = hadoop_path(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet; False if it is. The text is complete when the file appears."""
    jvm = spark.sparkContext._jvm
    draft, fs = hadoop_path(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    at, _ = hadoop_path(spark, path)
    try:
        if fs.getScheme() == "file":  # a local rename would replace the other's file; a link never does
            local = jvm.java.nio.file.Paths
            link = [local.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for p in (fs.makeQualified(at), fs.makeQualified(draft))]
            try:
                jvm.java.nio.file.Files.createLink(*link)
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            return True
        return not fs.exists(at) and bool(fs.rename(draft, at))
    finally:
        fs.delete(draft, False)


@dataclass(frozen=True)
class Collection:
    """One version of a collection."""

    spark: SparkSession
    path: str
    name: str
    version: int
    about: Mapping[str, Any]

    def rows(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Live rows: id, ordinal, vector, payload. Filters look into the payload."""
        parts = self.about["parts"]
        out = self.spark.createDataFrame([], f"{ROWS}, __part int")
        for i, part in enumerate(parts):
            if part["kind"] == "rows":
                out = out.union(self.spark.read.schema(ROWS).parquet(f"{self.path}/{part['at']}").withColumn("__part", F.lit(i)))
        if len(parts) > 1:  # what a later part replaces or takes away
            gone = None
            for i, part in enumerate(parts[1:], 1):
                ids = self.spark.read.schema("id string").parquet(f"{self.path}/{part['at']}").select(F.col("id").alias("__id"), F.lit(i).alias("__later"))
                gone = ids if gone is None else gone.union(ids)
            last = gone.groupBy("__id").agg(F.max("__later").alias("__later"))
            out = out.join(last, (F.col("id") == F.col("__id")) & (F.col("__part") < F.col("__later")), "left_anti")
        out = out.drop("__part")
        return out.where(payload_matches(filters, lambda key: F.try_element_at("payload", F.lit(key)))) if filters else out

    def info(self) -> DataFrame:
        """name, backend, distance, vectors, embedding_dim, version."""
        about = self.about
        return self.rows().agg(F.count(F.lit(1)).alias("vectors")).select(
            F.lit(self.name).alias("name"), F.lit(about["backend"]).alias("backend"), F.lit(about["distance"]).alias("distance"), "vectors", F.lit(about["dim"]).cast("int").alias("embedding_dim"), F.lit(self.version).alias("version"),
        )

    def search(self, query: list[float], k: int, filters: Mapping[str, Any] | None = None) -> DataFrame:
        if self.about["dim"] is not None and len(query) != self.about["dim"]:
            raise ValueError(f"query dim {len(query)} does not match store dim {self.about['dim']}")
        return search(self.rows(filters), query, k)

    def insert(self, rows: DataFrame, order: str = "seq") -> Collection:
        """Rows (id, vector, payload and the column that orders them): new ids go on behind the last ordinal, known ones replace
        their row; of rows that repeat an id the last in the order counts, at the place of the first."""
        own = rows.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by(F.struct(F.col("vector").cast("array<float>").alias("vector"), F.col("payload").cast("map<string,string>").alias("payload")), order).alias("new"), F.min(order).alias(order))
        own = own.select("id", "new.vector", "new.payload", order)
        known = self.rows().select("id", F.col("ordinal").alias("__ordinal"))
        part = f"parts/{uuid.uuid4().hex}"
        sized = own.join(known, "id", "left")
        old, new = sized.where("__ordinal is not null"), sized.where("__ordinal is null")
        placed = ranked_by(new, order, "id", name="__n").withColumn("__ordinal", F.col("__n") + (self.about["next"] - 1)).drop("__n")
        out = old.unionByName(placed).select("id", F.col("__ordinal").alias("ordinal"), "vector", "payload")
        return self._write(part, out)

    def update(self, changes: DataFrame) -> Collection:
        """Rows (id and any of vector and payload): what isn't null replaces the row's; an unknown id raises."""
        cols = [c for c in ("vector", "payload") if c in changes.columns]
        own = changes.select(F.col("id").cast("string").alias("id"), *[F.col(c).alias(f"__{c}") for c in cols])
        out = own.join(self.rows(), "id", "left")
        out = require(out, F.col("ordinal").isNotNull(), F.concat(F.lit("unknown id: "), F.coalesce("id", F.lit("null"))))
        kinds = {"vector": "array<float>", "payload": "map<string,string>"}
        out = out.select("id", "ordinal", *[F.coalesce(F.col(f"__{c}").cast(kinds[c]), c).alias(c) if c in cols else F.col(c) for c in kinds])
        return self._write(f"parts/{uuid.uuid4().hex}", out)

    def delete(self, ids: DataFrame) -> Collection:
        """Without the rows of some ids; unknown ids do nothing."""
        part = f"parts/{uuid.uuid4().hex}"
        ids.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct().write.parquet(f"{self.path}/{part}")
        return self._commit({"parts": [*self.about["parts"], {"kind": "gone", "at": part}]}, part)

    def reset(self) -> Collection:
        """Without rows; the next may have another dimension."""
        return self._commit({"parts": [], "dim": None, "next": 0}, None)

    def compact(self) -> Collection:
        """The same rows in one part, ordinals without gaps."""
        part = f"parts/{uuid.uuid4().hex}"
        rows = ranked_by(self.rows(), "ordinal", name="__n").select("id", (F.col("__n") - 1).alias("ordinal"), "vector", "payload")
        rows.write.parquet(f"{self.path}/{part}")
        count = self.spark.read.schema(ROWS).parquet(f"{self.path}/{part}").count()
        return self._commit({"parts": [{"kind": "rows", "at": part}], "next": count}, part)

    def refreshed(self) -> Collection:
        """The latest version."""
        return Collections(self.spark, self.path.rsplit("/", 1)[0]).open(self.name)

    def _write(self, part: str, rows: DataFrame) -> Collection:
        """Check rows and commit them as a part."""
        dim = self.about["dim"]
        fits = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        if dim is not None:
            fits &= F.size("vector") == dim
        said = F.concat(F.lit(f"a row needs an id and a vector of the store's dim ({dim}): "), F.coalesce("id", F.lit("null")))
        try:
            require(rows, fits, said).write.parquet(f"{self.path}/{part}")
            told = self.spark.read.schema(ROWS).parquet(f"{self.path}/{part}").agg(F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.max("ordinal").alias("last")).first()
            if told.low != told.high:
                raise ValueError("vectors of different dimensions")
        except Exception:
            self._drop(part)
            raise
        following = max(self.about["next"], told.last + 1) if told.last is not None else self.about["next"]
        return self._commit({"parts": [*self.about["parts"], {"kind": "rows", "at": part}], "dim": dim if told.high is None else told.high, "next": following}, part)

    def _commit(self, changed: dict[str, Any], part: str | None) -> Collection:
        about = {**self.about, **changed}
        if not _commit_text(self.spark, f"{self.path}/versions/{self.version + 1}.json", json.dumps(about)):
            if part:
                self._drop(part)
            raise Conflict(f"{self.name}: version {self.version + 1} is there already")
        return replace(self, version=self.version + 1, about=about)

    def _drop(self, part: str) -> None:
        at, fs = hadoop_path(self.spark, f"{self.path}/{part}")
        fs.delete(at, True)


class Collections:
    """Collections below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, name: str, dim: int | None = None, distance: str = "inner_product", backend: str = "local") -> Collection:
        """A new collection, or the one that is there if it has the same dimension and backend."""
        require_inner_product(distance)
        if not _NAME.fullmatch(name):
            raise ValueError(f"not a collection's name: {name!r}")
        about = {"backend": backend, "distance": distance, "dim": dim, "next": 0, "parts": []}
        at, fs = hadoop_path(self.spark, f"{self.root}/{name}/versions")
        fs.mkdirs(at)
        if _commit_text(self.spark, f"{self.root}/{name}/versions/0.json", json.dumps(about)):
            return Collection(self.spark, f"{self.root}/{name}", name, 0, about)
        found = self.open(name)
        if found.about["backend"] != backend or dim is not None and found.about["dim"] not in (None, dim):
            raise ValueError(f"{name} is there with backend {found.about['backend']} and dim {found.about['dim']}")
        return found

    def open(self, name: str, version: int | None = None) -> Collection:
        """A collection's latest version, or an older one."""
        at, fs = hadoop_path(self.spark, f"{self.root}/{name}/versions")
        if not fs.exists(at):
            raise KeyError(f"no collection {name!r}")
        found = [int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName()))]
        if not found or version is not None and version not in found:
            raise KeyError(f"no version {version} of {name!r}" if found else f"no collection {name!r}")
        last = max(found) if version is None else version
        return Collection(self.spark, f"{self.root}/{name}", name, last, json.loads(_read_text(self.spark, f"{self.root}/{name}/versions/{last}.json")))

    def names(self) -> list[str]:
        at, fs = hadoop_path(self.spark, self.root)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "versions/0.json")))

    def drop(self, name: str) -> bool:
        """Whether there was one."""
        at, fs = hadoop_path(self.spark, f"{self.root}/{name}")
        return fs.exists(at) and bool(fs.delete(at, True))
