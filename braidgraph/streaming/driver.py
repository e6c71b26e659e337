"""Continuous matching over a stream of update rows, micro-batch by micro-batch.

State is a table of present edges and, for each batch since it was written, the edges that the batch touched; every `compact`
batches they are written out as one table again. A batch thus writes what it changes, only edges that it touches are sorted
by update, and the others are scanned without a shuffle. A repeated batch reads what was there before it, so it gives the same state
and results. Matches of a batch come from the anchored plan: from its few changed edges outwards. Updates inside a batch keep their
order by update_id.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidgraph.functions.pattern import Pattern
from braidgraph.operators.stream import FOREVER, attach_updates
from braidgraph.plans.match import continuous_match

UPDATES = "update_id long, op string, src long, dst long, elabel int, src_label int, dst_label int"
EDGE = ["src", "dst", "elabel", "src_label", "dst_label"]


KEY = ["src", "dst", "elabel"]


class ContinuousMatcher:
    """Folders `state/batch=<n>`, `changes/batch=<n>`, `results/batch=<n>` and `costs/batch=<n>` under `folder` (a store that all
    executors share). view_only keeps the state alone, to tell its cost."""

    def __init__(self, spark: SparkSession, initial: DataFrame, pattern: Pattern, folder: str, mode: str = "anchored", keep: int = 2, limit: int | None = None, compact: int = 16, view_only: bool = False):
        self.spark, self.pattern, self.folder, self.mode, self.keep, self.limit = spark, pattern, folder.rstrip("/"), mode, keep, limit
        self.compact, self.view_only = compact, view_only
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._batches("state"):
            initial.select(*EDGE).write.mode("overwrite").parquet(self._path("state", -1))

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _batches(self, kind: str) -> list[int]:
        """Batches whose folder is complete."""
        path = self._jvm.org.apache.hadoop.fs.Path
        if not self._fs.exists(path(f"{self.folder}/{kind}")):
            return []
        found = [s.getPath() for s in self._fs.listStatus(path(f"{self.folder}/{kind}"))]
        return sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("batch=") and self._fs.exists(path(p, "_SUCCESS")))

    def _parts(self, upto: int, base: int) -> tuple[DataFrame, DataFrame | None]:
        """The table of batch `base`, and the last change up to a batch of each edge since (EDGE, present; None without any)."""
        since = [n for n in self._batches("changes") if base < n <= upto]
        table = self.spark.read.parquet(self._path("state", base))
        if not since:
            return table, None
        parts = [self.spark.read.parquet(self._path("changes", n)).withColumn("batch", F.lit(n)) for n in since]
        last = reduce(DataFrame.union, parts).groupBy(*KEY).agg(F.max_by(F.struct("src_label", "dst_label", "present"), "batch").alias("last"))
        return table, last.select(*KEY, "last.*")

    def present(self, upto: int | None = None, before: int | None = None) -> DataFrame:
        """The edges that are there after a batch (None: the last one), from the last table of a batch up to that one, or before `before`."""
        upto = max([*self._batches("state"), *self._batches("changes")]) if upto is None else upto
        table, last = self._parts(upto, max(n for n in self._batches("state") if n < (upto + 1 if before is None else before)))
        return table if last is None else table.join(last, KEY, "left_anti").select(*EDGE).union(last.where("present").select(*EDGE))

    def process(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: results, then what it changed."""
        began = time.monotonic()
        batch = batch.select("update_id", "op", *EDGE).persist()
        touched = batch.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "elabel").distinct()
        before = self.present(number - 1)
        changed = attach_updates(before.join(touched, KEY, "left_semi").select(*EDGE), batch).persist()
        if not self.view_only:
            rest = before.join(touched, KEY, "left_anti").select(*EDGE, F.lit(0).cast("long").alias("ins"), F.lit(FOREVER).alias("del"))
            continuous_match(changed.unionByName(rest), self.pattern, self.mode, self.limit).write.mode("overwrite").parquet(self._path("results", number))
        after = changed.where(f"del = {FOREVER}").select(*EDGE, F.lit(True).alias("there"))
        touched.join(after, KEY, "left").select(*EDGE, F.col("there").isNotNull().alias("present")).write.mode("overwrite").parquet(self._path("changes", number))
        base = max(n for n in self._batches("state") if n < number)
        if len([n for n in self._batches("changes") if base < n <= number]) >= self.compact:
            self.present(number, before=number).write.mode("overwrite").parquet(self._path("state", number))
        rows = batch.count()
        changed.unpersist()
        batch.unpersist()
        self._forget()
        cost = [(number, rows, int(1000 * (time.monotonic() - began)))]
        self.spark.createDataFrame(cost, "batch long, rows long, milliseconds long").coalesce(1).write.mode("overwrite").parquet(self._path("costs", number))

    def _forget(self) -> None:
        """Delete older tables than the last `keep`, and changes that the oldest kept one holds."""
        kept = self._batches("state")[-self.keep :]
        gone = [("state", n) for n in self._batches("state") if n < kept[0]] + [("changes", n) for n in self._batches("changes") if n <= kept[0]]
        for kind, n in gone:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(self._path(kind, n)), True)

    def start(self, updates: DataFrame, available_now: bool = True, **trigger) -> StreamingQuery:
        """Run over a streaming DataFrame of UPDATES."""
        writer = updates.writeStream.foreachBatch(lambda df, n: self.process(df, n)).option("checkpointLocation", f"{self.folder}/progress")
        return writer.trigger(**({"availableNow": True} if available_now else trigger)).start()

    def results(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/results").parquet(f"{self.folder}/results").drop("batch")

    def costs(self) -> DataFrame:
        """batch, rows and milliseconds of every batch."""
        return self.spark.read.parquet(*[self._path("costs", n) for n in self._batches("costs")])


def run_stream(spark: SparkSession, source: str, initial: DataFrame, pattern: Pattern, folder: str, files_per_batch: int = 1, timeout: int | None = None) -> DataFrame:
    """Match over a folder of Parquet update files, taken `files_per_batch` at a time; stops after `timeout` seconds."""
    matcher = ContinuousMatcher(spark, initial, pattern, folder)
    query = matcher.start(spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
    return matcher.results()
