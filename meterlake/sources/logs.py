"""Session logs: the three log formats as DataFrames of records.

A marker filter stands before the JSON parse, schemas are explicit and pruned, and a finished line that
can't be read or parsed is a row of `errors`, never a reason to drop its neighbours. Decoding (lines to
structs) and reading the structs are apart, so whoever needs several kinds of records decodes once and keeps that.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pricing import with_cost
from ..operators.snapshot import ESTIMATES
from ..operators.windows import DEFAULT_LIMIT, PLANS
from . import tail

TOKENS = ("input", "output", "cache_read", "cache_creation", "reasoning")


def lines(spark: SparkSession, key: str, roots: str | list[str], tail_bytes: int = 0, least_modified: int | None = None) -> DataFrame:
    """path, seq, line, problem, modified of a provider's finished log lines: newest file first, then path, then line.

    tail_bytes: only the lines of so many bytes at the end of each file. least_modified: only files changed since then.
    """
    tail.register(spark)
    source = spark.read.format(tail.LogSource.name()).option("places", places(key, roots))
    source = source.option("tailBytes", tail_bytes).option("parallelism", spark.sparkContext.defaultParallelism).load()
    source = source if least_modified is None else source.where(F.col("modified") >= least_modified)
    return source.select("path", F.col("place").alias("seq"), "line", "problem", "modified")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def origin_of(path: Column) -> Column:
    return F.when(path.rlike("/subagents/(.*/)?workflows/"), "workflow").when(path.rlike("/subagents/"), "subagent").otherwise("main")


def _at(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def _decoded(lines: DataFrame, schema: str, markers: tuple[str, ...], counters: tuple[str, ...] = (), times: tuple[str, ...] = (), more: Column | None = None) -> DataFrame:
    """path, seq, r (the parsed struct), problem, and offset if it is there: a row for each line that has a marker or couldn't be read.

    A line is refused whole if it is no JSON, repeats a key, has a counter that is null, negative or
    no whole number, or a time that can't be read.
    """
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.col("line").contains(marker)
    unread = F.col("problem").isNotNull() if "problem" in lines.columns else F.lit(False)
    rows = lines.where(hit | unread).withColumn("r", F.from_json("line", schema + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})).withColumn("v", F.try_parse_json("line"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("v").isNull()
    for c in counters:
        bad = bad | F.coalesce(F.is_variant_null(F.try_variant_get("v", f"$.{c}", "variant")), F.lit(False)) | F.coalesce(F.col(f"r.{c}") < 0, F.lit(False))
    for c in times:
        bad = bad | (F.col(f"r.{c}").isNotNull() & _at(F.col(f"r.{c}")).isNull())
    bad = bad | F.coalesce(more, F.lit(False)) if more is not None else bad
    why = F.when(unread, F.col("problem") if "problem" in lines.columns else F.lit("")).when(bad, "malformed record")
    return rows.select("path", "seq", "r", why.alias("problem"), *(c for c in ("offset",) if c in lines.columns))


def _sound(decoded: DataFrame) -> DataFrame:
    return decoded.where("problem is null").select("path", "seq", "r")


def _errors(decoded: DataFrame) -> DataFrame:
    told = F.col("problem").isNotNull() & ~F.col("problem").isin(*tail.EVENTS)
    return decoded.where(told).select("path", "seq", F.concat("problem", F.lit(" in "), "path").alias("message"))


def _count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _usage(df: DataFrame, provider: str, **columns: Column) -> DataFrame:
    base = {"message": F.lit(None).cast("string"), "request": F.lit(None).cast("string"), "model": F.lit(None).cast("string"),
        "project": F.lit(None).cast("string"), "origin": F.lit("main"), "requests": F.lit(0.0), "reasoning": F.lit(0).cast("long")} | columns
    out = df.select(F.lit(provider).alias("provider"), "path", "seq", *(v.alias(k) for k, v in base.items()))
    return out.where(F.col("at_s").isNotNull() & ((F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation") + F.col("reasoning") > 0) | (F.col("requests") != 0)))


@dataclass(frozen=True)
class Records:
    usage: DataFrame
    limits: DataFrame
    sessions: DataFrame
    errors: DataFrame


LIMITS = ["provider", "path", "seq", "limit_id", "observed_at", "window_minutes", "used_percent", "resets_at"]
SESSIONS = ["provider", "path", "seq", "at_s", "session", "project"]


def claude_code_lines(lines: DataFrame) -> DataFrame:
    schema = (
        "type STRING, timestamp STRING, at STRING, requestId STRING, sessionId STRING, cwd STRING, message STRUCT<id:STRING, model:STRING, usage:STRUCT<input_tokens:BIGINT, output_tokens:BIGINT, cache_read_input_tokens:BIGINT,"
        " cache_creation_input_tokens:BIGINT, cache_creation:STRUCT<ephemeral_5m_input_tokens:BIGINT, ephemeral_1h_input_tokens:BIGINT>>>, rate_limits STRUCT<five_hour:STRUCT<used_percentage:FLOAT, resets_at:BIGINT>, seven_day:STRUCT<used_percentage:FLOAT, resets_at:BIGINT>>"
    )
    spent = tuple(f"message.usage.{c}" for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens",
        "cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens"))
    read = [F.col(f"r.rate_limits.{w}") for w in ("five_hour", "seven_day")]
    partial = [w.isNotNull() & w["used_percentage"].isNull() for w in read]
    return _decoded(lines, schema, ('"usage"', '"rate_limits"'), spent, ("timestamp", "at"), partial[0] | partial[1])


def claude_code(decoded: DataFrame) -> Records:
    rows, errors = _sound(decoded), _errors(decoded)
    u, tier = "r.message.usage.", F.col("r.message.usage.cache_creation")
    five = F.when(tier.isNotNull(), _count(u + "cache_creation.ephemeral_5m_input_tokens")).otherwise(_count(u + "cache_creation_input_tokens"))
    hour = F.when(tier.isNotNull(), _count(u + "cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0).cast("long"))
    both = F.col("r.message.id").isNotNull() & F.col("r.requestId").isNotNull()
    usage = _usage(
        rows.where("r.message.usage is not null"), "claude-code", at_s=_at(F.col("r.timestamp")), session=F.coalesce("r.sessionId", file_stem(F.col("path"))),
            message=F.when(both, F.col("r.message.id")), request=F.when(both, F.col("r.requestId")),
        model=F.col("r.message.model"), project=F.col("r.cwd"), origin=origin_of(F.col("path")), input=_count(u + "input_tokens"),
            output=_count(u + "output_tokens"), cache_read=_count(u + "cache_read_input_tokens"), cache_creation=five + hour, cache_5m=five, cache_1h=hour,
    )
    read = lambda key, minutes: F.struct(F.lit(minutes).cast("long").alias("window_minutes"),
        F.col(f"r.rate_limits.{key}.used_percentage").alias("used_percent"), F.col(f"r.rate_limits.{key}.resets_at").alias("resets_at"))
    limits = rows.where("r.rate_limits is not null").select("path", "seq", F.coalesce(_at(F.col("r.at")), _at(F.col("r.timestamp"))).alias("observed_at"),
        F.explode(F.array(read("five_hour", 300), read("seven_day", 10080))).alias("x"))
    limits = limits.where("x.used_percent is not null and observed_at is not null").select(F.lit("claude-code").alias("provider"), "path", "seq",
        F.lit("claude").alias("limit_id"), "observed_at", "x.window_minutes", "x.used_percent", "x.resets_at")
    none = rows.where("false").select(F.lit("").alias("provider"), "path", "seq", F.lit(0).cast("long").alias("at_s"), F.lit("").alias("session"), F.lit("").alias("project"))
    return Records(with_cost(usage).drop("cache_5m", "cache_1h"), limits.select(*LIMITS), none.select(*SESSIONS), errors)


def codex_lines(lines: DataFrame) -> DataFrame:
    tokens = "STRUCT<total_tokens:BIGINT, input_tokens:BIGINT, cached_input_tokens:BIGINT, cache_write_input_tokens:BIGINT, output_tokens:BIGINT, reasoning_output_tokens:BIGINT>"
    window = "STRUCT<used_percent:FLOAT, window_minutes:BIGINT, resets_at:BIGINT>"
    schema = f"timestamp STRING, type STRING, payload STRUCT<type:STRING, cwd:STRING, info:STRUCT<total_token_usage:{tokens}, last_token_usage:{tokens}>, rate_limits:STRUCT<limit_id:STRING, primary:{window}, secondary:{window}>>"
    kinds = ("total_tokens", "input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
    spent = tuple(f"payload.info.{t}.{c}" for t in ("total_token_usage", "last_token_usage") for c in kinds)
    partial = [F.col(f"r.payload.rate_limits.{w}") for w in ("primary", "secondary")]
    partial = [w.isNotNull() & (w["used_percent"].isNull() | w["window_minutes"].isNull()) for w in partial]
    return _decoded(lines, schema, ('"token_count"', '"session_meta"'), spent, ("timestamp",), F.col("r.timestamp").isNull() | partial[0] | partial[1])


def codex(decoded: DataFrame) -> Records:
    rows, errors = _sound(decoded), _errors(decoded)
    rows = rows.withColumn("at_s", _at(F.col("r.timestamp")))
    stem, u = file_stem(F.col("path")), "r.payload.info.last_token_usage."
    counts = rows.where("r.payload.type = 'token_count' and r.payload.info.last_token_usage is not null")
    usage = _usage(
        counts, "codex", at_s=F.col("at_s"), session=stem, message=F.concat(stem, F.lit(":"),
            _count("r.payload.info.total_token_usage.total_tokens").cast("string")), request=_count(u + "total_tokens").cast("string"),
        input=F.greatest(_count(u + "input_tokens") - _count(u + "cached_input_tokens"), F.lit(0)), output=_count(u + "output_tokens"),
            cache_read=_count(u + "cached_input_tokens"), cache_creation=_count(u + "cache_write_input_tokens"), reasoning=_count(u + "reasoning_output_tokens"),
    ).withColumn("usd", F.lit(None).cast("decimal(38,11)"))
    limits = rows.where("r.payload.rate_limits is not null").select("path", "seq", "at_s",
        F.coalesce("r.payload.rate_limits.limit_id", F.lit("codex")).alias("limit_id"),
        F.explode(F.array("r.payload.rate_limits.primary", "r.payload.rate_limits.secondary")).alias("x")).where("x.window_minutes is not null and x.used_percent is not null")
    limits = limits.select(F.lit("codex").alias("provider"), "path", "seq", "limit_id", F.col("at_s").alias("observed_at"), "x.window_minutes", "x.used_percent", "x.resets_at")
    sessions = rows.where("r.type = 'session_meta' and r.payload.cwd is not null").select(F.lit("codex").alias("provider"), "path", "seq", "at_s",
        stem.alias("session"), F.col("r.payload.cwd").alias("project"))
    return Records(usage, limits.select(*LIMITS), sessions.select(*SESSIONS), errors)


def copilot_cli_lines(lines: DataFrame) -> DataFrame:
    metric = "STRUCT<totalNanoAiu:BIGINT, requests:STRUCT<cost:DOUBLE>, usage:STRUCT<inputTokens:BIGINT, outputTokens:BIGINT, cacheReadTokens:BIGINT, cacheWriteTokens:BIGINT, reasoningTokens:BIGINT>>"
    schema = f"type STRING, id STRING, timestamp STRING, data STRUCT<totalPremiumRequests:DOUBLE, errorCode:STRING, context:STRUCT<cwd:STRING>, modelMetrics:MAP<STRING,{metric}>>"
    kinds = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens")
    below = F.exists(F.map_values("r.data.modelMetrics"), lambda m: sum(((m["usage"][k] < 0).cast("int") for k in kinds), (m["totalNanoAiu"] < 0).cast("int")) > 0)
    nulls = F.col("line").rlike('"(?:' + "|".join((*kinds, "totalNanoAiu")) + r')"\s*:\s*null')
    return _decoded(lines, schema, ('"session.',), (), ("timestamp",), F.coalesce(below, F.lit(False)) | nulls)


def copilot_cli(decoded: DataFrame) -> Records:
    rows, errors = _sound(decoded), _errors(decoded)
    rows = rows.withColumn("at_s", _at(F.col("r.timestamp"))).withColumn("session", parent_name(F.col("path")))
    ends = rows.where("r.type = 'session.shutdown'")
    each = ends.select("path", "seq", "at_s", "session", F.col("r.id").alias("id"), F.explode("r.data.modelMetrics").alias("model", "m"))
    u = "m.usage."
    fresh = F.greatest(F.greatest(_count(u + "inputTokens") - _count(u + "cacheReadTokens"), F.lit(0)) - _count(u + "cacheWriteTokens"), F.lit(0))
    usage = _usage(
        each.withColumnRenamed("session", "s").withColumnRenamed("model", "k"), "copilot-cli", at_s=F.col("at_s"), session=F.col("s"),
            message=F.when(F.col("id").isNotNull(), F.concat("s", F.lit(":"), "id")), request=F.when(F.col("id").isNotNull(), F.col("k")), model=F.col("k"),
        input=fresh, output=_count(u + "outputTokens"), cache_read=_count(u + "cacheReadTokens"), cache_creation=_count(u + "cacheWriteTokens"),
            reasoning=_count(u + "reasoningTokens"), requests=F.coalesce("m.requests.cost", F.lit(0.0)),
        usd=(F.col("m.totalNanoAiu").cast("decimal(20,0)") * F.lit("0.00000000001").cast("decimal(12,11)")).cast("decimal(38,11)"),
    )
    zero = F.lit(0).cast("long")
    only = ends.where("coalesce(cardinality(r.data.modelMetrics), 0) <= 0 and r.data.totalPremiumRequests <> 0")
    only = _usage(only.withColumnRenamed("session", "s"), "copilot-cli", at_s=F.col("at_s"), session=F.col("s"), message=F.col("r.id"),
        request=F.lit("premium"), input=zero, output=zero, cache_read=zero, cache_creation=zero, requests=F.col("r.data.totalPremiumRequests"),
        usd=F.lit(None).cast("decimal(38,11)"))
    month = F.add_months(F.trunc(F.timestamp_seconds("at_s").cast("date"), "month"), 1)
    full = rows.where("r.type = 'session.error' and r.data.errorCode = 'quota_exceeded'")
    limits = full.select(F.lit("copilot-cli").alias("provider"), "path", "seq", F.lit("copilot").alias("limit_id"), F.col("at_s").alias("observed_at"),
        F.lit(43200).cast("long").alias("window_minutes"), F.lit(100.0).cast("float").alias("used_percent"),
        (F.datediff(month, F.lit("1970-01-01").cast("date")) * 86400).cast("long").alias("resets_at"))
    sessions = rows.where("r.type = 'session.start' and r.data.context.cwd is not null").select(F.lit("copilot-cli").alias("provider"), "path", "seq", "at_s",
        "session", F.col("r.data.context.cwd").alias("project"))
    return Records(usage.unionByName(only), limits.select(*LIMITS), sessions.select(*SESSIONS), errors)


@dataclass(frozen=True)
class ProviderSpec:
    """What there is to know of a tool: where it writes below the user's home, how its lines are read, what is estimated.

    side: a folder of readings that counts once the tool's own is there. estimate: how missing windows are filled, from
    rolling spend, the month's spend, or not at all.
    """

    key: str
    home: str
    globs: tuple[str, ...]
    decode: Callable[[DataFrame], DataFrame]
    records: Callable[[DataFrame], Records]
    estimate: str
    default_limit: str
    side: str | None = None

    def parse(self, lines: DataFrame) -> Records:
        return self.records(self.decode(lines))

    @property
    def plans(self) -> list[str]:
        return list(dict.fromkeys(plan for p, plan, *_ in PLANS if p == self.key))


#: Where each tool writes.
_CLAUDE = ("*/*.jsonl", "*/*/subagents/*.jsonl", "*/*/subagents/workflows/*/*.jsonl")
PROVIDERS = {
    p.key: p
    for p in (
        ProviderSpec("claude-code", ".claude/projects", _CLAUDE, claude_code_lines, claude_code, ESTIMATES["claude-code"], DEFAULT_LIMIT["claude-code"], ".meterlake/claude-code"),
        ProviderSpec("codex", ".codex/sessions", ("*/*/*/rollout-*.jsonl",), codex_lines, codex, ESTIMATES["codex"], DEFAULT_LIMIT["codex"]),
        ProviderSpec("copilot-cli", ".copilot/session-state", ("*/events.jsonl",), copilot_cli_lines, copilot_cli, ESTIMATES["copilot-cli"], DEFAULT_LIMIT["copilot-cli"]),
    )
}
#: Of a folder of readings.
SIDE_GLOBS = ("*.jsonl",)


def places(key: str, roots: str | list[str]) -> str:
    """The source's option `places`: a provider's log root with its globs, and further roots, of readings."""
    first, *more = [roots] if isinstance(roots, str) else roots
    return json.dumps([[first, PROVIDERS[key].globs], *([root, SIDE_GLOBS] for root in more)])


def discovered(home: str) -> dict[str, list[str]]:
    """provider -> its log root, whether it is there or not, and its folder of readings, if both are."""
    out = {}
    for key, spec in PROVIDERS.items():
        root, side = (f"{home.rstrip('/')}/{x}" if x else None for x in (spec.home, spec.side))
        out[key] = [root, side] if side and tail.access(root) != "missing" and tail.access(side) == "readable" else [root]
    return out


def access(roots: str | list[str]) -> str:
    """readable, denied or missing, of a provider's log root."""
    return tail.access(roots if isinstance(roots, str) else roots[0])


def count_files(key: str, roots: str | list[str]) -> int:
    """How many log files a provider has."""
    return len({path for root, globs in json.loads(places(key, roots)) for path in tail.found(root, globs)[0]})


def installed(roots: dict[str, str | list[str]]) -> list[str]:
    """Providers, in registry order, whose root is there, readable or not."""
    return [key for key in PROVIDERS if key in roots and access(roots[key]) != "missing"]


def read_provider(spark: SparkSession, roots: str | list[str], key: str) -> Records:
    """All records of one provider's logs; a file that two patterns match is read once."""
    return PROVIDERS[key].parse(lines(spark, key, roots))


def united(parts: list[Records]) -> Records:
    """The records of several providers as one."""
    whole = {f.name: getattr(parts[0], f.name) for f in fields(Records)}
    for part in parts[1:]:
        whole = {name: df.unionByName(getattr(part, name)) for name, df in whole.items()}
    return Records(**whole)


def last_lines(spark: SparkSession, key: str, roots: str | list[str], max_bytes: int = 256 << 10) -> DataFrame:
    """path, seq, line of the finished lines in the last max_bytes of each file, newest first; no more bytes are read."""
    return lines(spark, key, roots, max_bytes).select("path", "seq", "line").orderBy("path", F.desc("seq"))
