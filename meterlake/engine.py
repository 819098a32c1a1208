"""The engine as Python methods: records of log folders in, state, history, settings and exports out."""

from __future__ import annotations

import datetime
import json
import os
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import BUCKET_SECONDS, HOUR_SECONDS
from .operators import alerts, burst, export, fold, pace, report, snapshot, windows
from .settings import Settings, chosen_ceilings
from .sources import logs
from .sources.store import ERROR_PATHS, Store

RETENTION = 32 * 86_400
MOMENT = "%Y-%m-%dT%H:%M:%SZ"


def month_bounds(now: int) -> tuple[int, int]:
    """The first second of now's month in UTC, and of the next one."""
    at = datetime.datetime.fromtimestamp(now, datetime.UTC).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    following = at.replace(year=at.year + at.month // 12, month=at.month % 12 + 1)
    return int(at.timestamp()), int(following.timestamp())


@dataclass(frozen=True)
class Engine:
    """Questions to a store of series as of `now`."""

    spark: SparkSession
    store: Store
    now: int
    settings: Settings = Settings()
    installed: tuple[str, ...] = tuple(logs.PROVIDERS)
    #: Why a provider that is there can't be read.
    closed: tuple[tuple[str, str], ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, roots: dict[str, str | list[str]], now: int, settings: Settings = Settings(), store: Store | None = None) -> Engine:
        """The engine over log roots, read once into `store` (one in the session's shared folder by default; close() drops it).

        A root that is missing is a provider that isn't installed; one that can't be listed is told as denied.
        """
        store, closed = store or Store.scratch(spark), {}
        there = logs.installed(roots)
        for key in there:
            if logs.access(roots[key]) == "denied":
                closed[key] = "permission-denied"
                continue
            files = logs.count_files(key, roots[key])
            if not files:
                closed[key] = "no-logs-found"
                continue
            store.add(key, logs.lines(spark, key, roots[key]), files=files)
        return cls(spark, store, now, settings, tuple(there), tuple(closed.items()))

    @classmethod
    def from_store(cls, spark: SparkSession, out: str, now: int, settings: Settings = Settings()) -> Engine:
        """The engine over what streams of `streaming.pipeline.ingest` have merged below `out`."""
        return cls(spark, Store(spark, out), now, settings)

    def close(self) -> None:
        """Drop the store's tables."""
        self.store.delete()

    def usage(self) -> DataFrame:
        """Accepted usage within the retention, with its session's project."""
        return self.store.usage(self.now - RETENTION)

    def series(self, begin: int | None = None) -> DataFrame:
        """The five-minute series since `begin`, or all of the retention."""
        return self.store.series(begin if begin is not None else (self.now - RETENTION) // BUCKET_SECONDS * BUCKET_SECONDS)

    def labels(self) -> DataFrame:
        return self.store.labels((self.now - RETENTION) // HOUR_SECONDS * HOUR_SECONDS)

    def limits(self) -> DataFrame:
        return self.store.limits()

    def scanning(self) -> bool:
        """Whether a stream has found files that it hasn't read yet."""
        return not self.store.backlog().where("waiting > 0").isEmpty()

    def plans(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.settings.plans.items()), "provider string, plan string")

    def windows(self) -> DataFrame:
        """Measured and estimated windows with their forecasts."""
        series = self.series()
        every = snapshot.all_windows(series, fold.latest_limits(self.limits()), chosen_ceilings(self.spark, self.plans()), self.now, *month_bounds(self.now))
        return snapshot.with_pace(every, pace.forecasts(series, every, self.now))

    def providers(self, windows_: DataFrame | None = None) -> DataFrame:
        """Where each provider stands, with why it is unavailable, what of its logs couldn't be read, and a burst of agents."""
        known = self.spark.createDataFrame([(p, p in self.installed, dict(self.closed).get(p)) for p in logs.PROVIDERS], "provider string, installed boolean, closed string")
        errors = report.provider_errors(self.store.errors(), ERROR_PATHS)
        state = snapshot.providers(self.series(), self.windows() if windows_ is None else windows_, known, self.now, errors)
        return state.join(burst.detect(self.labels(), self.now).select("provider", F.struct("since", "tokens", "usd", "unpriced", "factor").alias("burst")), "provider", "left")

    def history(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hours, breakdown with at most LABEL_CAP labels a dimension, records dropped for that)."""
        return fold.history(self.series(), 0, self.now + 1), *fold.capped(self.labels())

    def shares(self, days: int) -> DataFrame:
        """What each label had of the last days, the largest first; only labels within the cap."""
        return report.ranked_labels(report.breakdown_share(fold.capped(self.labels())[0], days, self.now))

    def csv(self) -> DataFrame:
        return report.export_rows(*self.history())

    def json(self, scanning: bool | None = None) -> str:
        windows_ = self.windows()
        moment = datetime.datetime.fromtimestamp(self.now, datetime.UTC).strftime(MOMENT)
        shown = export.provider_objects(self.providers(windows_), windows_, snapshot.trimmed(self.series(), windows_, self.now), self.now)
        return export.document(shown, export.history_objects(*self.history()), moment, self.scanning() if scanning is None else scanning)

    def exit_code(self, scanning: bool | None = None) -> int:
        return report.exit_code(self.windows(), self.scanning() if scanning is None else scanning).first()["exit_code"]

    def alerts(self, provider: str) -> DataFrame:
        """Crossings of a provider's thresholds, replayed over its readings; none while muted."""
        readings = self.limits().where(F.col("provider") == provider).withColumnRenamed("observed_at", "at_s")
        return alerts.replay(readings, self.settings.thresholds(provider), muted_until=self.settings.muted_until)

    def counters(self) -> DataFrame:
        """A row a provider: files, lines, bytes, records, repeats and refusals of all that was read; nothing is read again."""
        return self.store.counters()

    def provider_plans(self, provider: str) -> list[str]:
        return logs.PROVIDERS[provider].plans

    def set_plan(self, provider: str, plan: str | None) -> Engine:
        chosen = {k: v for k, v in self.settings.plans.items() if k != provider}
        return replace(self, settings=replace(self.settings, plans=chosen | ({provider: plan} if plan else {})))

    def set_thresholds(self, provider: str, thresholds: list[int]) -> Engine:
        return replace(self, settings=replace(self.settings, alerts=self.settings.alerts | {provider: thresholds}))

    def set_mute(self, until: int | None) -> Engine:
        return replace(self, settings=replace(self.settings, muted_until=until))

    def save_settings(self, path: str) -> None:
        held = asdict(self.settings)
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump({"plans": held["plans"], "alerts": held["alerts"], "mutedUntil": held["muted_until"]}, f)
        os.replace(path + ".new", path)
