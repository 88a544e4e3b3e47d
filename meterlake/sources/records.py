"""From each source's rows to usage records: projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.functions import models
from meterlake.functions.times import duration_ms, iso_millis, iso_seconds, json_of, millis_of
from meterlake.operators.attribution import attributed
from meterlake.sources import lines


def _record(source: str, **columns: Column) -> list[Column]:
    given = {"source": F.lit(source), "outcome": F.lit("ok")} | columns
    return [given.get(f.name, F.lit(0 if f.name in schema.TOKENS else None)).cast(f.dataType).alias(f.name) for f in schema.RECORD.fields]


def _count(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _place() -> Column:
    """A number that orders lines as they were read: by the place of their file among all, then by offset (up to a TiB)."""
    return F.shiftleft("file", 40) + F.col("offset")


def transcripts(rows: DataFrame, now_iso: str, seen: Observation | None = None) -> DataFrame:
    """Answers in transcript lines that used tokens, but for local ones and those counted elsewhere; ``seen`` counts these."""
    usage, model = F.col("j.message.usage"), F.col("j.message.model")
    answer = (F.col("j.type") == "assistant") & usage.isNotNull()
    local, elsewhere = model.eqNullSafe("<synthetic>"), models.is_bridge_routed(model)
    j = lines.observed(rows, schema.TRANSCRIPT, seen, synthetic=answer & local, bridge_routed=answer & ~local & elsewhere)
    used = answer & ~local & ~elsewhere
    both = F.concat_ws(":", F.coalesce("j.sessionId", F.lit("undefined")), F.coalesce("j.message.id", F.lit("undefined")))
    key = F.coalesce("j.requestId", "j.uuid", both)
    kept = j.where(used).withColumn("key", key).where(F.col("key") != "")
    return kept.select(
        *_record(
            models.TRANSCRIPTS,
            source_id=F.col("key"), grain=F.lit("message"), ts=F.coalesce("j.timestamp", F.lit(now_iso)), model=model, project=F.col("j.cwd"),
            input_tokens=_count("j.message.usage.input_tokens"), output_tokens=_count("j.message.usage.output_tokens"),
            cache_read_tokens=_count("j.message.usage.cache_read_input_tokens"), cache_write_tokens=_count("j.message.usage.cache_creation_input_tokens"),
            cache_write_1h_tokens=_count("j.message.usage.cache_creation.ephemeral_1h_input_tokens"),
            raw=json_of(True, sessionId=F.col("j.sessionId"), messageId=F.col("j.message.id"), serviceTier=F.col("j.message.usage.service_tier")),
            session_id=F.col("j.sessionId"), seq=_place(),
        )
    )


def windows(rows: DataFrame) -> DataFrame:
    """Work windows: tool, project, start_ms, end_ms, seq; those without proper times are dropped."""
    j = lines.parsed(rows, schema.WINDOW)
    found = j.select(F.coalesce("j.tool", F.lit("unknown")).alias("tool"), F.col("j.project").alias("project"), millis_of(F.col("j.tsStart")).alias("start_ms"), millis_of(F.col("j.tsEnd")).alias("end_ms"), _place().alias("seq"))
    return found.where("start_ms is not null and end_ms is not null")


def bridge(rows: DataFrame, work: DataFrame, now_iso: str, seen: Observation | None = None) -> DataFrame:
    """Requests through the bridge, attributed to work windows; errors have no tokens. ``seen`` counts them, and those whose key is made of the line."""
    j = lines.observed(rows, schema.BRIDGE, seen, errors=F.col("j.event") == "error", keyless=F.col("j.request_id").isNull()).withColumns({"ts": F.coalesce("j.ts", F.lit(now_iso)), "seq": _place()})
    placed = attributed(j.withColumn("ts_ms", millis_of(F.col("ts"))), work, "ts_ms")
    failed = F.coalesce(F.col("j.event") == "error", F.lit(False))
    count = lambda name: F.when(failed, 0).otherwise(_count(f"j.{name}"))
    some = lambda name: F.nullif(F.col(f"j.{name}"), F.lit(""))
    error = json_of(False, errorType=F.col("j.error_type"), errorCode=F.col("j.error_code"), statusCode=F.col("j.status_code"), tsStart=F.col("j.ts_start"), tsEnd=F.col("j.ts_end"))
    success = F.nullif(json_of(True, tsStart=some("ts_start"), tsEnd=some("ts_end"), durationMs=F.col("j.duration_ms")), F.lit("{}"))
    return placed.select(
        *_record(
            "litellm",
            source_id=F.coalesce("j.request_id", F.xxhash64("value").cast("string")), grain=F.lit("message"), ts=F.col("ts"), model=F.col("j.model"),
            project=F.col("window_project"), sub_tool=F.col("tool"), outcome=F.when(failed, "error").otherwise("ok"),
            input_tokens=count("input_tokens"), output_tokens=count("output_tokens"), cache_read_tokens=count("cache_read_tokens"),
            cache_write_tokens=count("cache_write_tokens"), reasoning_tokens=count("reasoning_tokens"), duration_ms=F.col("j.duration_ms"),
            raw=F.when(failed, error).otherwise(success), seq=F.col("seq"),
        )
    )


def direct(rows: DataFrame, now_iso: str, seen: Observation | None = None) -> DataFrame:
    """Direct requests; rows without a request id have no key and are dropped. ``seen`` counts them and keeps one (see ``keyless``)."""
    j = lines.observed(rows, schema.DIRECT, seen, keyless=F.coalesce("j.request_id", F.lit("")) == "")
    count = lambda name: F.when(F.isnan(F.coalesce(f"j.{name}", F.lit(0.0))), 0).otherwise(_count(f"j.{name}"))
    raw = F.nullif(json_of(True, totalTokens=F.col("j.total_tokens"), bytes=F.col("j.bytes")), F.lit("{}"))
    return j.where(F.coalesce("j.request_id", F.lit("")) != "").select(
        *_record(
            "sideclaw-iu",
            source_id=F.col("j.request_id"), grain=F.lit("message"), ts=F.coalesce("j.ts", F.lit(now_iso)), model=F.col("j.model"), sub_tool=F.col("j.tool"),
            input_tokens=count("input_tokens"), output_tokens=count("output_tokens"), reasoning_tokens=count("reasoning_tokens"),
            duration_ms=F.col("j.latency_ms"), raw=raw, seq=_place(),
        )
    )


def keyless(rows: DataFrame) -> DataFrame:
    """Direct requests that have no request id."""
    return lines.parsed(rows, schema.DIRECT).where(F.coalesce("j.request_id", F.lit("")) == "").select("value")


def agent_sessions(source: str, rows: DataFrame, project: str) -> DataFrame:
    """Sessions of an agent's store; times are in seconds."""
    raw = json_of(
        False,
        endReason=F.col("end_reason"), messageCount=F.col("message_count"), toolCallCount=F.col("tool_call_count"), billingProvider=F.col("billing_provider"),
        costStatus=F.col("cost_status"), reportedEstimatedCostUsd=F.col("estimated_cost_usd"), reportedActualCostUsd=F.col("actual_cost_usd"),
    )
    return rows.select(
        *_record(
            source,
            source_id=F.col("id"), grain=F.lit("session"), ts=iso_seconds(F.col("started_at")), model=F.col("model"), project=F.lit(project), sub_tool=F.col("source"),
            duration_ms=duration_ms(F.col("started_at"), F.col("ended_at")), raw=raw,
            **{t: _count(t) for t in schema.TOKENS if t != "cache_write_1h_tokens"},
        )
    )


def coding_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of the coding agent's store; times are in milliseconds."""
    return rows.select(
        *_record(
            "opencode",
            source_id=F.col("id"), grain=F.lit("session"), ts=iso_millis(F.col("time_created")), model=F.col("model"), project=F.col("directory"),
            input_tokens=_count("tokens_input"), output_tokens=_count("tokens_output"), cache_read_tokens=_count("tokens_cache_read"),
            cache_write_tokens=_count("tokens_cache_write"), reasoning_tokens=_count("tokens_reasoning"),
            raw=json_of(False, slug=F.col("slug"), title=F.col("title"), agent=F.col("agent"), reportedCostUsd=F.col("cost")),
        )
    )


def session_env(rows: DataFrame) -> DataFrame:
    """The last base url that the log has of each session; the empty text and null are known values."""
    j = lines.parsed(rows, schema.SESSION_ENV)
    told = j.where((F.col("j.event") == "session_env") & (F.coalesce("j.data.session", F.lit("")) != ""))
    last = told.groupBy(F.col("j.data.session").alias("session")).agg(F.max_by(F.struct("j.data.base_url"), _place()).alias("v"))
    return last.select("session", F.col("v.base_url").alias("base_url"))
