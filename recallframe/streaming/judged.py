"""Judged records of a run, appended batch by batch, and rewritten later by a job that may be cut off.

Each micro-batch is a folder of JSON lines named by its id, which is written beside its place and swapped in: a batch that is run
again after a failure replaces its own folder, so that every record stands once. What a judge could not say, and why, is kept in
the record (status unparsed, skipped or error, with a reason).

Later judgements make a new generation: folder after folder is judged and swapped in below the new generation's name, which
becomes the one that is read by a last, single step. A rewrite that was cut off goes on where it stopped; until its end readers see the
old generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import judge_payload
from ..sources.files import replace_folder
from ..sources.sinks import read_document, write_document
from ..sources.written import hadoop_path

Judge = Callable[[DataFrame], DataFrame]
JUDGE = "struct<correct:boolean,reason:string,raw:string,status:string>"


class JudgedRecords:
    """Records at a path; ``schema`` has their columns without the judge's."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def generation(self) -> int:
        return int(read_document(self.spark, f"{self.path}/current.json", {"generation": 0})["generation"])

    def _folder(self, generation: int) -> str:
        return f"{self.path}/generation-{generation}"

    def batches(self, generation: int) -> list[str]:
        """Names of the batches that are there whole."""
        at, fs = hadoop_path(self.spark, self._folder(generation))
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((x for x in found if x.startswith("batch=") and x[6:].isdigit()), key=lambda x: int(x[6:]))

    def read(self) -> DataFrame:
        """The records of the generation that holds now, each with its judge and batch."""
        at = self.generation()
        parts = self.batches(at)
        if not parts:
            return self.spark.createDataFrame([], f"{self.schema}, judge {JUDGE}, batch long")
        rows = self.spark.read.schema(f"{self.schema}, judge {JUDGE}").option("basePath", self._folder(at)).json([f"{self._folder(at)}/{b}" for b in parts])
        return rows.withColumn("batch", F.col("batch").cast("long"))

    def _judged(self, records: DataFrame, judge: Judge) -> DataFrame:
        """Records with the judge's struct; ``judge`` adds response, and may add error and skipped."""
        own = [c for c in records.columns if c not in ("judge", "batch")]
        said = judge(records)
        error = F.col("error") if "error" in said.columns else None
        skipped = F.col("skipped") if "skipped" in said.columns else None
        return said.select(*own, judge_payload("response", error, skipped).alias("judge"))

    def start(self, stream: DataFrame, judge: Judge, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Judge and append a stream of records."""

        def write(batch: DataFrame, number: int) -> None:
            replace_folder(self.spark, f"{self._folder(0)}/batch={number}", lambda p: self._judged(batch, judge).write.json(p))

        if self.generation():
            raise ValueError("the records have been rewritten: a stream can't append to them")
        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def rejudge(self, judge: Judge, everything: bool = False) -> int:
        """Judge the records that have no verdict (or all) once more; the number of batches written by this call."""
        now = self.generation()
        names, there = self.batches(now), set(self.batches(now + 1))
        for name in names:
            if name in there:
                continue
            rows = self.spark.read.schema(f"{self.schema}, judge {JUDGE}").json(f"{self._folder(now)}/{name}")
            again = F.lit(everything) | F.col("judge.correct").isNull()
            done = self._judged(rows.where(again), judge).unionByName(rows.where(~again))
            replace_folder(self.spark, f"{self._folder(now + 1)}/{name}", lambda p, done=done: done.write.json(p))
        if self.batches(now) != names:
            raise RuntimeError("records were appended during the rewrite")
        write_document(self.spark, f"{self.path}/current.json", {"generation": now + 1})
        at, fs = hadoop_path(self.spark, self._folder(now))
        fs.delete(at, True)
        return len(names) - len(there)
