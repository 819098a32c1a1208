"""Where a window is heading: burn rate, hour-of-week shape, projection to its reset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import STALE_SECONDS, pace_risk, percent_of, total, week_slot

STEPS, MIN_PERCENT, MIN_DAYS, SHORT_HOURS = 48, 5.0, 14, 6
BINS, BIN_SECONDS, ALPHA, MIN_SCALE, MAX_SCALE = 16, 900, 0.3, 0.1, 10.0
_NANO = 1_000_000_000
KEY = ["provider", "limit_id", "window_minutes"]


def ewma(bins: Column) -> Column:
    """Per hour, from an array of bins, oldest first; the first positive bin seeds."""
    step = lambda acc, x: F.when(acc.isNotNull(), ALPHA * x + (1 - ALPHA) * acc).when(x > 0, x)
    return F.coalesce(F.aggregate(bins, F.lit(None).cast("double"), step), F.lit(0.0)) * (3600 / BIN_SECONDS)


def bin_sums(value: Column, now: int) -> Column:
    begin = now - BINS * BIN_SECONDS
    each = lambda i: F.sum(F.when((F.col("start") >= begin + i * BIN_SECONDS) & (F.col("start") < begin + (i + 1) * BIN_SECONDS), value).otherwise(0.0))
    return F.array(*(each(i) for i in range(BINS)))


def profile(series: DataFrame, now: int) -> DataFrame:
    """provider, slot, per_hour_usd, per_hour_tokens: means over the weeks observed, if two at least."""
    first = series.groupBy("provider").agg(F.min("start").alias("first"))
    slots = series.groupBy("provider", week_slot(F.col("start")).alias("slot")).agg(F.sum("usd").cast("double").alias("usd"), F.sum(total()).cast("double").alias("tokens"))
    weeks = (F.lit(now) - F.col("first")) / F.lit(7 * 86400.0)
    return slots.join(F.broadcast(first), "provider").where(F.lit(now) - F.col("first") >= MIN_DAYS * 86400).select("provider", "slot",
        (F.col("usd") / weeks).alias("per_hour_usd"), (F.col("tokens") / weeks).alias("per_hour_tokens"))


def _expected(spans: DataFrame, shape: DataFrame, keys: list[str]) -> DataFrame:
    """Profile integral over [from_ns, to_ns) of each row: whole seconds of each clock hour's slice."""
    hours = spans.withColumn("hour", F.explode(F.sequence(F.floor(F.col("from_ns") / (3600 * _NANO)), F.floor((F.col("to_ns") - 1) / (3600 * _NANO)))))
    begin = F.greatest("from_ns", F.col("hour") * 3600 * _NANO)
    end = F.least("to_ns", (F.col("hour") + 1) * 3600 * _NANO)
    hours = hours.withColumn("w", F.floor((end - begin) / _NANO) / 3600.0).withColumn("slot", week_slot(F.col("hour") * 3600))
    return hours.join(F.broadcast(shape), ["provider", "slot"],
        "left").groupBy(*keys).agg(F.sum(F.col("w") * F.coalesce(F.when(F.col("by_cost"), F.col("per_hour_usd")).otherwise(F.col("per_hour_tokens")),
        F.lit(0.0))).alias("expected"))


def forecasts(series: DataFrame, windows: DataFrame, now: int) -> DataFrame:
    """provider, limit_id, window_minutes, projected_percent, risk, exhausted_at for windows that allow one.

    `windows` is a short table (a few rows a provider) and is broadcast; the series is read in
    two aggregations, whatever the number of steps.
    """
    span = F.col("window_minutes") * 60
    anchor = F.least(F.coalesce("reported_at", F.lit(now)), F.lit(now))
    used = F.col("used_percent").cast("double")
    usable = windows.where((used >= MIN_PERCENT) & ~F.isnan(used) & (span > 0) & (F.lit(now) - anchor <= STALE_SECONDS) & (F.col("resets_at").isNull() | (F.col("resets_at") > now)))
    usable = usable.select(*KEY, "kind", used.alias("used"), anchor.alias("anchor"), span.alias("span"), "resets_at")
    start, usd, tokens = F.col("start"), F.col("usd").cast("double"), total().cast("double")
    within = lambda a, b: (start >= a) & (start < b)
    both = F.broadcast(usable).join(series, "provider", "left")
    at_anchor, at_now = within(F.col("anchor") - F.col("span"), F.col("anchor")), within(F.lit(now) - F.col("span"), F.lit(now))
    add = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    sums = both.groupBy(*KEY, "kind", "used", "anchor", "span", "resets_at").agg(
        add(at_anchor, usd).alias("a_usd"), add(at_anchor, F.col("unpriced").cast("double")).alias("a_open"), add(at_anchor, tokens).alias("a_tok"),
            add(at_now, usd).alias("n_usd"), add(at_now, tokens).alias("n_tok"),
        ewma(bin_sums(usd, now)).alias("rate_usd"), ewma(bin_sums(tokens, now)).alias("rate_tok"),
    )
    by_cost = (F.col("a_open") == 0) & (F.col("a_usd") > 0)
    pick = lambda a, b: F.when(F.col("by_cost"), F.col(a)).otherwise(F.col(b))
    gate = sums.withColumn("by_cost", by_cost).where("by_cost or a_tok > 0").withColumn("ceiling", pick("a_usd", "a_tok") / (F.col("used") / 100)).where("ceiling > 0")
    horizon = F.coalesce(F.col("resets_at") - now, F.col("span"))
    gate = gate.select(*KEY, "kind", "span", "by_cost", "ceiling", pick("n_usd", "n_tok").alias("spent"), pick("rate_usd", "rate_tok").alias("rate"),
        F.col("resets_at").isNull().alias("rolling"), horizon.alias("horizon"), F.floor(horizon * _NANO / STEPS).alias("step")).where("step > 0")
    gate = gate.withColumn("current", percent_of(F.col("ceiling"), F.col("spent")))

    shape = profile(series, now)
    typical = _expected(gate.select(*KEY, "by_cost", (F.lit(now * _NANO) - F.col("span") * _NANO).alias("from_ns"), F.lit(now * _NANO).alias("to_ns")), shape,
        KEY).withColumnRenamed("expected", "typical")
    gate = gate.join(F.broadcast(typical), KEY, "left")
    flat = (F.col("kind") == "session") | (F.col("horizon") <= SHORT_HOURS * 3600) | (F.coalesce("typical", F.lit(0.0)) <= 0)
    gate = gate.withColumn("scale", F.when(~flat, F.least(F.greatest(F.col("spent") / F.col("typical"), F.lit(MIN_SCALE)), F.lit(MAX_SCALE))))

    steps = gate.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    steps = steps.withColumn("from_ns", F.lit(now * _NANO) + (F.col("k") - 1) * F.col("step")).withColumn("to_ns", F.lit(now * _NANO) + F.col("k") * F.col("step"))
    shaped = _expected(steps.where("scale is not null").select(*KEY, "k", "by_cost", "from_ns", "to_ns"), shape, [*KEY, "k"])
    # What falls out at the far edge: a bucket belongs to the step whose shifted span holds its start.
    off = start - (F.lit(now) - F.col("span"))
    leaving = F.broadcast(gate.where("rolling").select(*KEY, "span", "step", "by_cost")).join(series, "provider").where((off >= 0) & (start < now))
    leaving = leaving.withColumn("k", F.ceil((off + 1) * _NANO / F.col("step")).cast("int")).groupBy(*KEY, "k").agg(F.sum(F.when(F.col("by_cost"), usd).otherwise(tokens)).alias("leaving"))
    walk = steps.join(shaped, [*KEY, "k"], "left").join(leaving, [*KEY, "k"], "left")
    come = F.when(F.col("scale").isNull(), F.col("rate") * F.floor(F.col("step") / _NANO) / 3600.0).otherwise(F.coalesce("expected", F.lit(0.0)) * F.col("scale"))
    running = F.col("spent") + F.sum(come - F.coalesce("leaving", F.lit(0.0))).over(W.partitionBy(*KEY).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    walk = walk.withColumn("percent", percent_of(F.col("ceiling"), F.greatest(running, F.lit(0.0))))
    out = walk.groupBy(*KEY).agg(F.greatest(F.max("current"), F.max("percent")).alias("projected_percent"),
        F.floor(F.min(F.when(F.col("percent") >= 100, F.col("to_ns"))) / _NANO).cast("long").alias("exhausted_at"))
    return out.select(*KEY, "projected_percent", pace_risk(F.col("projected_percent")).alias("risk"), "exhausted_at")
