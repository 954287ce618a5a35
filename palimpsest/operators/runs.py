"""An index that grows by runs: appended, merged without a shuffle, compacted by levels, read by snapshots.

All runs of an index lie in one table, partitioned by run and bucketed and sorted by
(term, block).  A scan of several runs gives a task the same bucket of each, so merging them
is a group-by inside a task: no exchange, and no list leaves its bucket.

A manifest, one small JSON file per state, lists the runs that count, with their level.
Appending writes a run, then a manifest with it; compacting merges ``FANOUT`` runs of a level to
one of the next and writes a manifest with that one in their place.  A manifest appears by a rename to a new number, so
a writer that fails leaves nothing to see, one that comes second fails and may
repeat, and a reader keeps the runs of the manifest it began with until ``vacuum``.
Each posting is rewritten once per level, log(runs) times in all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of one level that are merged to one of the next.
FANOUT = 4
COLUMNS = "term STRING, block BIGINT, freq BIGINT, n_docs BIGINT, postings ARRAY<STRUCT<docid: BIGINT, pos: BIGINT>>"


class Conflict(RuntimeError):
    """Another writer's state came first; the run isn't in the index."""


class Runs:
    """An index under ``path``; made there with so many buckets if there is none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._last() is None:
            self._publish(0, {"buckets": buckets, "runs": []})
        self.buckets = self.state()["buckets"]
        self.table = f"palimpsest_runs_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        self._files(f"{self.path}/runs", make=True)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({COLUMNS}, run STRING) USING parquet PARTITIONED BY (run) CLUSTERED BY (term, block) SORTED BY (term, block) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'")

    # --- states ---

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, folder: str, make: bool = False) -> list[str]:
        if make:
            self._fs.mkdirs(self._at(folder))
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []

    def _last(self) -> int | None:
        numbers = [int(n.removeprefix("state-").removesuffix(".json")) for n in self._files(self.path) if n.startswith("state-")]
        return max(numbers, default=None)

    def state(self, number: int | None = None) -> dict:
        """buckets, and the runs (name, level) of a state, the last one if not told."""
        n = self._last() if number is None else number
        stream = self._fs.open(self._at(f"{self.path}/state-{n:012d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(raw) | {"number": n}

    def _publish(self, number: int, state: dict) -> None:
        target, draft = self._at(f"{self.path}/state-{number:012d}.json"), self._at(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({k: state[k] for k in ("buckets", "runs")}).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"state {number} of {self.path} exists")

    # --- runs ---

    def _write(self, index: DataFrame, name: str, dealt: bool) -> None:
        wide = F.transform("postings", lambda p: F.struct(p["docid"].cast("long").alias("docid"), p["pos"].cast("long").alias("pos")))
        rows = index.select("term", F.col("block").cast("long").alias("block"), F.col("freq").cast("long").alias("freq"), F.col("n_docs").cast("long").alias("n_docs"), wide.alias("postings"), F.lit(name).alias("run"))
        # one file per bucket
        self._save(rows if dealt else rows.repartition(self.buckets, "term", "block"))

    def _save(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").partitionBy("run").bucketBy(self.buckets, "term", "block").sortBy("term", "block").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs as one index; lists of an equal term and block follow each other in the order of the runs."""
        rows = self.spark.table(self.table)
        rows = rows.where(F.col("run").isin(names)) if names else rows.where("false")
        # a short list: runs are few, by their levels
        place = F.array_position(F.array(*(F.lit(n) for n in names)).cast("array<string>"), F.col("run"))
        lists = F.array_sort(F.collect_list(F.struct(place.alias("place"), "postings")))
        return rows.groupBy("term", "block").agg(F.sum("freq").alias("freq"), F.sum("n_docs").alias("n_docs"), F.flatten(F.transform(lists, lambda x: x["postings"])).alias("postings"))

    def append(self, index: DataFrame, name: str | None = None, dealt: bool = False) -> str:
        """An index (term, block, freq, n_docs, postings) of documents that no run has yet, as the last run.

        ``name`` makes it repeatable: a run of that name that is, or ever was, in the index isn't added again.
        dealt: the index was built in as many parts as there are buckets, so its postings need no further exchange.
        """
        now = self.state()
        name = name or uuid.uuid4().hex
        if any(name in r["holds"] for r in now["runs"]):
            return name
        stored = f"{name}-{uuid.uuid4().hex[:8]}"  # an earlier try may have left files
        self._write(index, stored, dealt)
        self._publish(now["number"] + 1, now | {"runs": [*now["runs"], {"name": stored, "level": 0, "holds": [name]}]})
        return name

    def read(self, number: int | None = None) -> DataFrame:
        """The whole index of a state: one row per term and block; no exchange."""
        return self._merged([r["name"] for r in self.state(number)["runs"]])

    def compact(self, fanout: int | None = None) -> int:
        """Merge levels that are full, from fresh to old; how many runs were made."""
        fanout = fanout or FANOUT
        made = 0
        while True:
            now = self.state()
            levels: dict[int, list] = {}
            for r in now["runs"]:
                levels.setdefault(r["level"], []).append(r)
            full = min((k for k, v in levels.items() if len(v) >= fanout), default=None)
            if full is None:
                return made
            old = levels[full][:fanout]  # runs of a level stand side by side, the older ones first
            name = f"level{full + 1}-{uuid.uuid4().hex}"
            self._save(self._merged([r["name"] for r in old]).withColumn("run", F.lit(name)))
            new = {"name": name, "level": full + 1, "holds": [h for r in old for h in r["holds"]]}
            self._publish(now["number"] + 1, now | {"runs": [new if r is old[0] else r for r in now["runs"] if r is old[0] or r not in old]})
            made += 1

    def vacuum(self) -> None:
        """Delete runs and states that the last state doesn't need; for when no reader holds an older one."""
        now = self.state()
        keep = {f"run={r['name']}" for r in now["runs"]}
        for n in self._files(f"{self.path}/runs"):
            if n.startswith("run=") and n not in keep:
                self._fs.delete(self._at(f"{self.path}/runs/{n}"), True)
        for n in self._files(self.path):
            if n.startswith("state-") and n != f"state-{now['number']:012d}.json":
                self._fs.delete(self._at(f"{self.path}/{n}"), False)
        self.spark.catalog.refreshTable(self.table)
