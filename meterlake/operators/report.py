"""Second-stage folds for display and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell, dollars, instant, total
from .fold import TOKENS

EXIT_CODES = {"ok": 0, "error": 1, "near": 10, "full": 11, "no_reading": 20}


def horizon_columns(series: DataFrame, span: int, now: int, count: int) -> DataFrame:
    """provider, column, start, seconds, tokens, height: `count` dense slices of [now - span, now]."""
    begin = now - span
    hit = series.where((F.col("start") >= begin) & (F.col("start") <= now))
    index = F.least(F.floor((F.col("start") - begin) * count / F.lit(span)), F.lit(count - 1)).cast("int")
    sums = hit.groupBy("provider", index.alias("column")).agg(F.sum(total()).alias("tokens"))
    axis = series.select("provider").distinct().withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    full = axis.join(sums, ["provider", "column"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    most = F.max("tokens").over(W.partitionBy("provider"))
    height = F.when(F.col("tokens") == 0, 0.0).otherwise(F.greatest(F.col("tokens") / most, F.lit(0.06)))
    at = lambda k: F.lit(begin) + F.floor(k * span / F.lit(count))
    return full.select("provider", "column", at(F.col("column")).cast("long").alias("start"),
        (at(F.col("column") + 1) - at(F.col("column"))).cast("long").alias("seconds"), "tokens", F.round(height, 6).alias("height"))


def breakdown_share(breakdown: DataFrame, days: int, now: int) -> DataFrame:
    """Totals and shares by label over [now - days, now], closed; cost where every row is priced, else tokens."""
    rows = breakdown.where((F.col("hour") >= now - days * 86400) & (F.col("hour") <= now))
    sums = rows.groupBy("provider", "dimension", "label").agg(F.sum(total()).alias("tokens"), F.sum("usd").alias("usd"), F.sum("unpriced").alias("unpriced"))
    w = W.partitionBy("provider", "dimension")
    by_cost = F.max("unpriced").over(w) == 0
    sums = sums.withColumn("basis", F.when(by_cost, "cost").otherwise("tokens")).withColumn("value", F.when(by_cost, F.col("usd").cast("double")).otherwise(F.col("tokens").cast("double")))
    return sums.withColumn("share", F.round(F.coalesce(F.try_divide("value", F.sum("value").over(w)), F.lit(0.0)), 6)).drop("value")


def range_totals(hours: DataFrame, days: int, now: int) -> DataFrame:
    return hours.where((F.col("hour") >= now - days * 86400) & (F.col("hour") <= now)).groupBy("provider").agg(F.sum(total()).alias("tokens"),
        F.sum("usd").alias("usd"), F.sum("unpriced").alias("unpriced"))


def daily_heatmap(hours: DataFrame, days: int, now: int, zone: str) -> DataFrame:
    """provider, day, tokens, intensity: every local day of the range, empty ones too; 0 to 4 by share of the peak."""
    local = lambda at: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(at).cast("timestamp_ntz").cast("string"), zone))
    today = local(F.lit(now))
    sums = hours.groupBy("provider", local(F.col("hour")).alias("day")).agg(F.sum(total()).alias("tokens"))
    axis = hours.select("provider").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(today, days - 1), today)))
    full = axis.join(sums, ["provider", "day"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    share = F.try_divide("tokens", F.max("tokens").over(W.partitionBy("provider")))
    level = F.when(F.col("tokens") == 0, 0).when(share > 0.75, 4).when(share > 0.5, 3).when(share > 0.25, 2).otherwise(1)
    return full.select("provider", F.col("day").cast("string").alias("day"), "tokens", level.alias("intensity"))


def shortened_paths(paths: DataFrame) -> DataFrame:
    """path, short: each path's shortest tail of whole segments that no other path has."""
    parts = paths.select("path").distinct().withColumn("p", F.filter(F.split("path", r"[/\\]"), lambda x: x != ""))
    tails = parts.select("path", F.size("p").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1))),
        lambda k: F.array_join(F.reverse(F.slice(F.reverse("p"), F.lit(1), k)), "/"))).alias("k", "tail"))
    alone = tails.withColumn("c", F.count("*").over(W.partitionBy("tail")))
    return alone.groupBy("path").agg(F.coalesce(F.min_by("tail", F.when(F.col("c") == 1, F.col("k"))), F.max_by("tail", "k")).alias("short"))


def headline(windows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The fullest window of all; of equals the first by provider, then window."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("provider"))
    return windows.where("used_percent is not null").orderBy(F.desc("used_percent"), at, "window_minutes", "limit_id").limit(1)


def worst_window(windows: DataFrame) -> DataFrame:
    w = W.partitionBy("provider").orderBy(F.desc_nulls_last("used_percent"), "window_minutes", "limit_id")
    return windows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def exit_code(windows: DataFrame, scanning: bool = False) -> DataFrame:
    """One row: 20 without any reading or while scanning, 11 from 100 %, 10 from 90 %, else 0."""
    peak = F.max("used_percent")
    code = F.when(F.lit(scanning) | peak.isNull(), EXIT_CODES["no_reading"]).when(peak >= 100, EXIT_CODES["full"]).when(peak >= 90, EXIT_CODES["near"]).otherwise(EXIT_CODES["ok"])
    return windows.agg(code.alias("exit_code"))


#: The published column order.
CSV_COLUMNS = ("provider", "dimension", "start", "startUtc", "label", "input", "output", "cacheRead", "cacheCreation", "reasoning", "totalTokens", "costUsd",
    "unpricedTokens", "labelsDropped")


def export_rows(hours: DataFrame, breakdown: DataFrame, dropped: DataFrame) -> DataFrame:
    """The long-form export: hourly totals and the three dimensions, as text cells."""
    whole = hours.withColumn("dimension", F.lit("total")).withColumn("label", F.lit(None).cast("string"))
    cols = ["provider", "hour", "dimension", "label", *TOKENS, "usd", "unpriced"]
    rows = whole.select(*cols).unionByName(breakdown.select(*cols)).join(F.broadcast(dropped), ["provider", "dimension"], "left")
    drops = F.when(F.col("dimension") != "total", F.coalesce("labels_dropped", F.lit(0)))
    values = (F.col("provider"), F.col("dimension"), F.col("hour").cast("string"), instant(F.col("hour")), csv_cell(F.col("label")),
        *(F.col(c).cast("string") for c in TOKENS), total().cast("string"), dollars(F.col("usd"), F.col("unpriced")), F.col("unpriced").cast("string"),
        F.coalesce(drops.cast("string"), F.lit("")))
    return rows.select(*(v.alias(c) for v, c in zip(values, CSV_COLUMNS)))


def ranked_labels(shares: DataFrame) -> DataFrame:
    """Labels of breakdown_share in the order shown: by what they are measured in, then by tokens, the largest first."""
    value = F.when(F.col("basis") == "cost", F.col("usd").cast("double")).otherwise(F.col("tokens").cast("double"))
    return shares.orderBy("provider", "dimension", value.desc(), F.desc("tokens"), F.asc_nulls_first("label"))


def provider_errors(errors: DataFrame, cap: int, shown: int = 3) -> DataFrame:
    """provider, read_error: the first message of each of the first `shown` paths, and how many paths more have one.

    Of the paths only the `cap` whose errors came first can be shown, so no list grows beyond that.
    """
    first = errors.groupBy("provider", "path").agg(F.min_by("message", "seq").alias("message"), F.min("seq").alias("seq"))
    n = first.groupBy("provider").agg(F.count("*").alias("n"))
    kept = first.withColumn("k", F.row_number().over(W.partitionBy("provider").orderBy("seq", "path"))).where(F.col("k") <= cap)
    texts = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("path", "message"))), 1, shown), lambda x: x["message"])
    both = kept.groupBy("provider").agg(texts.alias("texts")).join(n, "provider")
    hidden = F.col("n") - F.size("texts")
    more = F.when(hidden > 0, F.array(F.concat(hidden.cast("string"), F.lit(" more log files with errors")))).otherwise(F.array().cast("array<string>"))
    return both.select("provider", F.array_join(F.concat("texts", more), " | ").alias("read_error"))


def since(before: DataFrame, now: DataFrame, counter: str, *keys: str) -> DataFrame:
    """keys and how much a growing counter has grown between two readings of it; a key that is new starts at 0."""
    was = before.select(*keys, F.col(counter).alias("__was"))
    return now.join(was, list(keys), "left").select(*keys, F.greatest(F.col(counter) - F.coalesce("__was", F.lit(0)), F.lit(0)).alias(counter))
