"""Steps of a build that are counted and timed in the pass that writes, and independent jobs that run side by side."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark import InheritableThread  # noqa: F401  (job tags follow threads that inherit them)
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.files import replace_folder

T = TypeVar("T")


@dataclass(frozen=True)
class Step:
    """What a written step told of itself: seconds, and the metrics that were observed in the same pass."""

    name: str
    seconds: float
    metrics: Mapping[str, Any]


def observed_bytes(df: DataFrame) -> Column:
    """Bytes of the texts and binaries of a row, and of its arrays at 4 bytes a number."""
    sizes = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(c))
        elif kind in ("array<float>", "array<int>"):
            sizes.append(F.size(c) * 4)
        elif kind in ("array<double>", "array<bigint>"):
            sizes.append(F.size(c) * 8)
    return sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(0)).cast("long")


def written_step(df: DataFrame, path: str, name: str, more: Mapping[str, Column] | None = None) -> tuple[DataFrame, Step]:
    """Write a step's rows (whole or not at all) and read them back. Rows, bytes and nulls of each column, and the aggregates in
    ``more``, come from the writing job itself."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in df.columns]
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(observed_bytes(df)), F.lit(0)).alias("bytes"), *nulls, *[c.alias(k) for k, c in (more or {}).items()])
    began = time.perf_counter()
    replace_folder(df.sparkSession, path, lambda p: watched.write.parquet(p))
    took = time.perf_counter() - began
    return df.sparkSession.read.schema(df.schema).parquet(path), Step(name, took, dict(seen.get))


def build_metrics(spark: SparkSession, steps: Iterable[Step]) -> DataFrame:
    """step, metric, value of steps (seconds apart)."""
    rows = [(s.name, k, int(v)) for s in steps for k, v in s.metrics.items()]
    return spark.createDataFrame(rows, "step string, metric string, value long")


class Cancelled(Exception):
    """A job that was ended, or never begun, as another failed."""


def side_by_side(spark: SparkSession, jobs: Iterable[Callable[[], T]], workers: int = 4) -> list[T]:
    """Results of independent jobs in the jobs' order. At the first failure what runs is cancelled by its tag, what waits doesn't
    begin, and that failure is raised."""
    tag = f"side-by-side-{uuid.uuid4().hex}"
    stop = threading.Event()

    def run(job: Callable[[], T]) -> T:
        if stop.is_set():
            raise Cancelled
        spark.addTag(tag)
        try:
            return job()
        except Exception:
            first = not stop.is_set()
            stop.set()
            if not first:
                raise Cancelled from None
            raise
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(workers) as pool:
        running = [pool.submit(run, job) for job in jobs]
        done, left = wait(running, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done):
            stop.set()
            for f in left:
                f.cancel()
            while not all(f.done() for f in running):  # a job may begin another Spark job after the first was cancelled
                spark.interruptTag(tag)
                wait(running, timeout=0.2)
            failures = [f.exception() for f in running if not f.cancelled() and f.exception()]
            raise next((e for e in failures if not isinstance(e, Cancelled)), failures[0])
    return [f.result() for f in running]


def mapped_parts(spark: SparkSession, parts: Iterable[T], work: Callable[[T], DataFrame], path: str, workers: int = 4) -> DataFrame:
    """The rows of independent jobs, one for each part, in one table, which appears when all are done; a failing part stops the rest
    and leaves the old table, or none. Column ``part`` has each part's place."""
    items = list(parts)

    def write(target: str) -> None:
        side_by_side(spark, [lambda i=i, x=x: work(x).write.parquet(f"{target}/part={i}") for i, x in enumerate(items)], workers)

    replace_folder(spark, path, write)
    return spark.read.option("basePath", path).parquet(path)
