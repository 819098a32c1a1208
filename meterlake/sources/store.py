"""The stored series: what log batches add to it lands once, and questions read days, not logs.

Tables below one folder, as Parquet, partitioned by day (of the record) and provider:

  usage       accepted records, by batch too: first wins by (message, request), over all batches
  sums        a batch's five-minute sums; label_sums: its hourly sums by label
  series      the five-minute series of a day; labels: its hourly sums by label. What is asked reads these
  limits      readings, by batch
and by provider and batch only: sessions (which project a session is in), errors, events, counters.

A merge appends a batch's own partitions and then writes anew the days they touch, each from all sums of
that day. Whatever step fails, the batch is merged again from its start and gives the same: its own partitions are
dropped first, records of the same or later batches are not looked at, and a day is a function of its sums. So late usage
rewrites only its day, and usage that comes twice lands once. A reader that meets a day while it is written
may have to ask again.

Repeats are found by probing the stored keys with the batch's; the batch is staged first, so Spark knows that it is the
small side. Days older than the retention go by prune().
"""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import fold, ingest
from . import logs, tail

DAY = 86_400
_TOKENS = ", ".join(f"{c} bigint" for c in fold.TOKENS)
_ALL = "usd decimal(38,11), unpriced bigint"
#: Columns of the tables, without their partitions.
TABLES = {
    "usage": f"path string, seq bigint, at_s bigint, session string, message string, request string, model string, project string, origin string, requests double, {_TOKENS}, usd decimal(38,11)",
    "sums": f"start bigint, {_TOKENS}, requests double, {_ALL}, last_at bigint",
    "series": f"start bigint, {_TOKENS}, requests double, {_ALL}, last_at bigint",
    "label_sums": f"dimension string, hour bigint, label string, {_TOKENS}, {_ALL}, records bigint, first_seq bigint",
    "labels": f"dimension string, hour bigint, label string, {_TOKENS}, {_ALL}, records bigint, first_seq bigint",
    "limits": "path string, seq bigint, limit_id string, observed_at bigint, window_minutes bigint, used_percent float, resets_at bigint",
    "sessions": "path string, seq bigint, at_s bigint, session string, project string",
    "errors": "path string, seq bigint, message string",
    "events": "path string, seq bigint, event string, count bigint",
    "counters": "files bigint, lines bigint, bytes bigint, records bigint, accepted bigint, duplicates_skipped bigint, invalid bigint, oversize bigint, refused bigint, rotations bigint, elapsed double",
}
BY = {
    "usage": ("day", "provider", "batch"), "sums": ("day", "provider", "batch"), "label_sums": ("day", "provider", "batch"), "limits": ("day", "provider", "batch"),
    "series": ("day", "provider"), "labels": ("day", "provider"),
    "sessions": ("provider", "batch"), "errors": ("provider", "batch"), "events": ("provider", "batch"), "counters": ("provider", "batch"),
}
_TYPES = {"day": "date", "provider": "string", "batch": "bigint"}
#: Paths whose errors are told.
ERROR_PATHS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's for checkpoints, or where none is set the warehouse; in local mode one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return tempfile.mkdtemp(prefix="meterlake-")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/meterlake"


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder: for a small table that is read several times but takes all logs to make."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _together(*writes: Callable[[], None]) -> None:
    """Jobs that don't wait for each other; an error of one is raised when all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(w) for w in writes]:
            done.result()


def day_of(at: Column) -> Column:
    """The UTC day of an instant, whatever the session's zone."""
    return F.date_from_unix_date(F.floor(at / DAY).cast("int"))


def _date(at: int) -> datetime.date:
    return datetime.datetime.fromtimestamp(at, datetime.UTC).date()


class Store:
    """The tables below a folder, of which nothing has to be there yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def scratch(cls, spark: SparkSession) -> Store:
        """A new store in the session's shared folder."""
        return cls(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _matching(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        return [str(x.getPath()) for x in self._fs().globStatus(path) or ()]

    def delete(self, pattern: str = "") -> None:
        """What matches below the store; all of it by default."""
        for found in self._matching(pattern) if pattern else [self.path]:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(found), True)

    def table(self, name: str) -> DataFrame:
        """A table with its partition columns; empty where nothing was written yet."""
        schema = TABLES[name] + "".join(f", {c} {_TYPES[c]}" for c in BY[name])
        if not self._matching(f"{name}/*"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _write(self, name: str, rows: DataFrame) -> None:
        typed = StructType.fromDDL(TABLES[name] + "".join(f", {c} {_TYPES[c]}" for c in BY[name]))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in typed))
        rows.write.partitionBy(*BY[name]).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")

    def add(self, key: str, lines: DataFrame, batch: int = 0, files: int | None = None) -> dict:
        """Merge a batch of log lines (path, seq, line, problem, maybe offset) of a provider; each line is parsed once. Its counters."""
        began = datetime.datetime.now()
        spec, read = logs.PROVIDERS[key], Observation()
        problem, line = F.col("problem"), F.col("line")
        counted = lines.observe(read, F.count("line").alias("lines"), F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).alias("bytes"),
            F.count_if(problem == "invalid UTF-8").alias("invalid"), F.count_if(problem == "oversize line").alias("oversize"), F.count_if(problem == tail.ROTATED).alias("rotations"))
        stage = f"{self.path}/stage/{key}-{batch}"
        spec.decode(counted).write.mode("overwrite").parquet(f"{stage}/decoded")
        decoded = self.spark.read.parquet(f"{stage}/decoded")
        events = decoded.where(problem.isin(*tail.EVENTS))
        count = F.col("offset") if "offset" in decoded.columns else F.lit(0)
        self.delete(f"events/provider={key}/batch={batch}")
        if not events.isEmpty():
            self._write("events", events.select("path", "seq", problem.alias("event"), count.alias("count"), F.lit(key).alias("provider"), F.lit(batch).alias("batch")))
        told = self.merge(key, spec.records(decoded), batch, stage)
        told = read.get | told | {"files": files, "elapsed": (datetime.datetime.now() - began).total_seconds()}
        told = {c: told.get(c) for c in (x.split()[0] for x in TABLES["counters"].split(", "))}
        self._write("counters", self.spark.createDataFrame([(*told.values(), key, batch)], TABLES["counters"] + ", provider string, batch bigint"))
        return told

    def merge(self, key: str, records: logs.Records, batch: int, stage: str | None = None) -> dict:
        """Merge a provider's records; those of a batch that was merged before are replaced."""
        stage = stage or f"{self.path}/stage/{key}-{batch}"
        own = f"provider={key}/batch={batch}"
        touched = {x.split("/day=")[1].split("/")[0] for x in self._matching(f"sums/day=*/{own}")}
        for name, by in BY.items():
            if "batch" in by and name not in ("events", "counters"):
                self.delete(f"{name}/{'day=*/' if 'day' in by else ''}{own}")
        mark = lambda df: df.drop("provider").withColumn("provider", F.lit(key)).withColumn("batch", F.lit(batch))
        refused, seen, kept = Observation(), Observation(), Observation()
        used = ingest.counted(records.usage).observe(seen, F.count("*").alias("records"))
        _together(
            lambda: self._write("sessions", mark(records.sessions)),
            lambda: self._write("errors", mark(records.errors).observe(refused, F.count("*").alias("refused"))),
            lambda: self._write("limits", mark(records.limits).withColumn("day", day_of(F.col("observed_at")))),
            lambda: ingest.dedup_first_wins(used).write.mode("overwrite").parquet(f"{stage}/usage"),
        )
        fresh = self._new(key, self.spark.read.parquet(f"{stage}/usage"), batch)
        fresh = mark(self._attributed(key, fresh, batch)).withColumn("day", day_of(F.col("at_s")))
        self._write("usage", fresh.observe(kept, F.count("*").alias("accepted")))
        accepted = self._batch("usage", key, batch)
        sums = fold.buckets(accepted, F.max("at_s").alias("last_at"))
        labels = fold.breakdown(accepted)
        _together(
            lambda: self._write("sums", sums.withColumn("day", day_of(F.col("start"))).withColumn("batch", F.lit(batch))),
            lambda: self._write("label_sums", labels.withColumn("day", day_of(F.col("hour"))).withColumn("batch", F.lit(batch))),
        )
        touched |= {x.split("/day=")[1].split("/")[0] for x in self._matching(f"sums/day=*/{own}")}
        self.refold(key, sorted(touched))
        self.delete(f"stage/{key}-{batch}")
        told = seen.get | kept.get | refused.get
        return told | {"duplicates_skipped": told["records"] - told["accepted"]}

    def _batch(self, name: str, key: str, batch: int) -> DataFrame:
        return self.table(name).where((F.col("provider") == key) & (F.col("batch") == batch))

    def _new(self, key: str, usage: DataFrame, batch: int) -> DataFrame:
        """The batch's usage without what an earlier batch has accepted."""
        by = ["message", "request"]
        known = self.table("usage").where((F.col("provider") == key) & (F.col("batch") < batch)).select(*by)
        again = known.join(usage.select(*by), by, "left_semi").distinct()
        return usage.join(again, by, "left_anti")

    def _attributed(self, key: str, usage: DataFrame, batch: int) -> DataFrame:
        """usage with its sessions' projects, from the session records up to this batch."""
        sessions = self.table("sessions").where((F.col("provider") == key) & (F.col("batch") <= batch))
        return ingest.attribute_sessions(usage, sessions.join(usage.select("session").distinct(), "session", "left_semi"))

    def refold(self, key: str, days: list[str]) -> None:
        """Write the series and labels of these days anew, each from all sums of the day."""
        if not days:
            return
        mine = (F.col("provider") == key) & F.col("day").isin(*(datetime.date.fromisoformat(d) for d in days))
        add = [F.sum(c).alias(c) for c in (*fold.TOKENS, "usd", "unpriced")]
        series = self.table("sums").where(mine).groupBy("day", "provider", "start").agg(*add, F.round(F.sum("requests"), 6).alias("requests"), F.max("last_at").alias("last_at"))
        labels = self.table("label_sums").where(mine).groupBy("day", "provider", "dimension", "hour", "label").agg(*add, F.sum("records").alias("records"), F.min("first_seq").alias("first_seq"))
        left = {x.split("/day=")[1].split("/")[0] for x in self._matching(f"sums/day=*/provider={key}/batch=*")}
        _together(lambda: self._write("series", series.repartition("day")), lambda: self._write("labels", labels.repartition("day")))
        for day in set(days) - left:
            self.delete(f"series/day={day}/provider={key}")
            self.delete(f"labels/day={day}/provider={key}")

    def _between(self, name: str, col: str, begin: int, end: int | None, provider: str | None) -> DataFrame:
        rows = self.table(name).where((F.col("day") >= F.lit(_date(begin))) & (F.col(col) >= begin))
        rows = rows if end is None else rows.where((F.col("day") <= F.lit(_date(end))) & (F.col(col) < end))
        rows = rows if provider is None else rows.where(F.col("provider") == provider)
        return rows.drop("day")

    def series(self, begin: int, end: int | None = None, provider: str | None = None) -> DataFrame:
        """Five-minute buckets that start in [begin, end); only the days of the range are read."""
        return self._between("series", "start", begin, end, provider)

    def labels(self, begin: int, end: int | None = None, provider: str | None = None) -> DataFrame:
        """Hourly sums by label of the hours in [begin, end)."""
        return self._between("labels", "hour", begin, end, provider)

    def usage(self, begin: int, end: int | None = None, provider: str | None = None) -> DataFrame:
        """Accepted usage of [begin, end), with its session's project."""
        return self._between("usage", "at_s", begin, end, provider).drop("batch")

    def limits(self) -> DataFrame:
        return self.table("limits").drop("day", "batch")

    def errors(self) -> DataFrame:
        """provider, path, seq, message of the errors that still stand: their file was not replaced or removed since."""
        ended = self.table("events").where(F.col("event").isin(tail.ROTATED, tail.REMOVED)).groupBy("provider", "path").agg(F.max("seq").alias("ended"))
        both = self.table("errors").join(ended, ["provider", "path"], "left")
        return both.where(F.col("ended").isNull() | (F.col("seq") > F.col("ended"))).select("provider", "path", "seq", "message")

    def backlog(self) -> DataFrame:
        """provider, waiting: files that a stream has found and not read yet."""
        told = self.table("events").where(F.col("event") == tail.BACKLOG)
        return told.groupBy("provider").agg(F.max_by("count", "seq").alias("waiting"))

    def counters(self) -> DataFrame:
        """A row a provider: what its batches have read and refused so far."""
        names = [x.split()[0] for x in TABLES["counters"].split(", ")]
        return self.table("counters").groupBy("provider").agg(*((F.max if c == "files" else F.sum)(c).alias(c) for c in names))

    def prune(self, now: int, retention: int) -> list[str]:
        """Drop the days that end before the retention begins; their names."""
        oldest = _date(now - retention).isoformat()
        gone = [x for name, by in BY.items() if "day" in by for x in self._matching(f"{name}/day=*") if x.split("/day=")[1] < oldest]
        for x in gone:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(x), True)
        return sorted({x.split("/day=")[1] for x in gone})
