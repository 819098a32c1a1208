"""An hour of agent spend that stands out against the user's own agent hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import total

MIN_HOURS, FACTOR, MIN_TOKENS = 6, 4.0, 200_000


def detect(breakdown: DataFrame, now: int, factor: float = FACTOR) -> DataFrame:
    """provider, since, tokens, usd, unpriced, factor, for providers in a burst; `breakdown` is by hour and label."""
    since = now - 3600
    agents = breakdown.where("dimension = 'agent' and label is not null and label <> 'main'")
    hours = agents.groupBy("provider", "hour").agg(F.sum(total()).alias("t"), F.sum("usd").alias("usd"), F.sum("unpriced").alias("unpriced"))
    before = hours.where((F.col("hour") >= 0) & (F.col("hour") < since)).groupBy("provider").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.5) within group (order by t)").alias("m"))
    present = hours.where((F.col("hour") >= since) & (F.col("hour") < now)).groupBy("provider").agg(F.sum("t").alias("tokens"), F.sum("usd").alias("usd"),
        F.sum("unpriced").alias("unpriced"))
    times = F.col("tokens") / F.greatest(F.col("m").cast("bigint"), F.lit(1))
    return present.where(F.col("tokens") >= MIN_TOKENS).join(before.where(F.col("n") >= MIN_HOURS), "provider").where(times >= factor).select("provider",
        F.lit(since).cast("long").alias("since"), "tokens", "usd", "unpriced", times.cast("float").alias("factor"))
