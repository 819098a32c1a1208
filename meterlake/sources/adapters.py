"""The driver's `events` table seen as usage, session and limit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds
from ..operators.pricing import PRICES, with_cost

PROVIDERS = ("claude-code", "codex", "copilot-cli")
MODELS = {"view": "claude-sonnet-4-5-20250929", "click": "anthropic.claude-opus-4-1-v1:0", "purchase": " Claude-Haiku-4-5 ", "error": "mystery-model"}


def _events(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    provider = F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.pmod(F.floor(F.col("event_id") / 2), F.lit(3)) + 1).cast("int"))
    return e.select("event_id", epoch_seconds(F.col("ts")).alias("at_s"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"), provider.alias("provider"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"))


def usage(spark, sf_dir: str, scale: int = 1) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type <> 'signup'")
    model = F.coalesce(*(F.when(F.col("event_type") == t, m) for t, m in MODELS.items()))
    out = e.select(
        "provider", F.col("event_id").alias("seq"), "at_s", "session",
            F.when(F.col("event_id") % 97 != 0, F.floor(F.col("event_id") / 2).cast("string")).alias("message"), F.lit("r").alias("request"),
        model.alias("model"), F.lit(None).cast("string").alias("project"),
            F.element_at(F.array(F.lit("main"), F.lit("subagent"), F.lit("workflow")), (F.col("user_id") % 3 + 1).cast("int")).alias("origin"),
        (F.floor(F.col("value") * 100) * scale).cast("long").alias("input"), (F.col("k") * scale).alias("output"),
            (F.col("event_id") % 1000 * scale).alias("cache_read"), (F.col("event_id") % 50 * scale).alias("cache_creation"),
        F.lit(0).cast("long").alias("reasoning"), F.lit(0.0).alias("requests"),
    )
    out = out.withColumn("cache_5m", F.col("cache_creation")).withColumn("cache_1h", F.lit(0).cast("long"))
    return with_cost(out).drop("cache_5m", "cache_1h")


def sessions(spark, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'signup'").select("provider", "session", F.col("event_id").alias("seq"), "at_s",
        F.concat(F.lit("/w/p"), F.col("k").cast("string")).alias("project"))


def limits(spark, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'error'")
    minutes = F.element_at(F.array(*map(F.lit, (300, 10080, 43200, 2880))), (F.col("event_id") % 4 + 1).cast("int")).cast("long")
    return e.select("provider", F.col("event_id").alias("seq"), F.concat("provider", F.lit("-limit")).alias("limit_id"), F.col("at_s").alias("observed_at"),
        minutes.alias("window_minutes"), F.pmod(F.col("value"), F.lit(100.0)).cast("float").alias("used_percent"),
        F.when(F.col("event_id") % 5 != 0, F.col("at_s") + minutes * 60).alias("resets_at"))


_RATES = ", ".join(f"('{k}', " + ", ".join(f"cast('{r}' as decimal(10,4))" for r in p) + ")" for k, p in PRICES.items())
_MODEL = "case event_type " + " ".join(f"when '{t}' then '{m}'" for t, m in MODELS.items()) + " end"

#: The same records for DuckDB, as common table expressions.
SQL = rf"""
with ev as (
  select event_id, cast(floor(epoch(ts)) as bigint) as at_s, user_id, event_type, value, cast(regexp_extract(props, '"k": ?(-?[0-9]+)', 1) as bigint) as k,
    list_value('claude-code', 'codex', 'copilot-cli')[(event_id // 2) % 3 + 1] as provider, 's' || user_id as session from events),
price(pkey, r1, r2, r3, r4, r5) as (values {_RATES}),
norm as (
  select m as model, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(m)), '^anthropic\.', ''), '^us\.', ''), '-v1:0$', ''), '-[0-9]{{8}}$', '') as n
  from (select distinct {_MODEL} as m from ev) where m is not null),
priced as (
  select model, n, pkey, r1, r2, r3, r4 from norm join price on starts_with(n, pkey)
  qualify row_number() over (partition by model order by length(pkey) desc) = 1),
use0 as (
  select provider, event_id as seq, at_s, session, case when event_id % 97 <> 0 then cast(event_id // 2 as varchar) end as message, {_MODEL} as model, cast(null as varchar) as project,
    list_value('main', 'subagent', 'workflow')[user_id % 3 + 1] as origin, cast(floor(value * 100) as bigint) * SCALE as input, k * SCALE as output, event_id %
        1000 * SCALE as cache_read, event_id % 50 * SCALE as cache_creation
  from ev where event_type <> 'signup'),
use as (
  select use0.*, input + output + cache_read + cache_creation as total,
    cast(cast(input * r1 + output * r2 + cache_read * r3 + cache_creation * r4 as decimal(30, 4)) * cast(0.000001 as decimal(7, 6)) as decimal(38, 11)) as usd
  from use0 left join priced using (model)),
ok as (
  select * from use where message is null
  union all select * from use where message is not null qualify row_number() over (partition by provider, message order by seq) = 1),
bucket as (
  select provider, cast(at_s // 300 * 300 as bigint) as start, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache_read)
      as bigint) as cache_read, cast(sum(cache_creation) as bigint) as cache_creation,
    cast(sum(total) as bigint) as total, cast(coalesce(sum(usd), 0) as decimal(38, 11)) as usd, cast(coalesce(sum(case when usd is null then total end), 0) as bigint) as unpriced
  from ok group by all),
lim as (
  select provider, event_id as seq, provider || '-limit' as limit_id, at_s as observed_at, cast(list_value(300, 10080, 43200, 2880)[event_id % 4 + 1] as bigint) as window_minutes,
    cast(value % 100 as float) as used_percent, case when event_id % 5 <> 0 then at_s + list_value(300, 10080, 43200, 2880)[event_id % 4 + 1] * 60 end as resets_at
  from ev where event_type = 'error'),
latest as (select * from lim qualify row_number() over (partition by provider, limit_id, window_minutes order by observed_at desc, seq) = 1)
"""
