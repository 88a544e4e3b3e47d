"""Column types of the ledger and of every input; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PRIMITIVE = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}


def struct(ddl: str) -> T.StructType:
    """A schema from text such as ``a string, b struct<c long>``; needs no session."""
    fields, depth, at = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = ddl[at:i].strip().split(" ", 1)
            inner = kind.startswith("struct<")
            fields.append(T.StructField(name, struct(kind[len("struct<") : -1]) if inner else _PRIMITIVE[kind]))
            at = i + 1
    return T.StructType(fields)


TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_1h_tokens", "reasoning_tokens")

#: What a source delivers; ``seq`` orders rows of the same key, the last one wins.
RECORD = struct(
    "source string, source_id string, grain string, ts string, model string, project string, workspace string, sub_tool string, "
    "outcome string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, "
    "cache_write_1h_tokens long, reasoning_tokens long, duration_ms double, raw string, session_id string, seq long"
)
#: The ledger of usage records, unique by source and source_id.
LEDGER = struct(
    "id long, source string, source_id string, grain string, ts string, model string, model_norm string, project string, "
    "workspace string, sub_tool string, billing string, machine string, outcome string, input_tokens long, output_tokens long, "
    "cache_read_tokens long, cache_write_tokens long, cache_write_1h_tokens long, reasoning_tokens long, duration_ms double, "
    "cost_usd double, cost_source string, raw string, ingested_at string, synced_at string"
)
STATE = struct("source string, cursor string, last_run_at string, last_status string, last_note string, records_total long")
#: Values of columns that older snapshots lack and that are never null.
DEFAULTS = {"outcome": "ok", "cache_write_1h_tokens": 0, "cost_source": "none"} | {t: 0 for t in TOKENS}

TRANSCRIPT = struct(
    "type string, requestId string, sessionId string, uuid string, timestamp string, cwd string, "
    "message struct<id string, model string, usage struct<input_tokens long, output_tokens long, cache_read_input_tokens long, "
    "cache_creation_input_tokens long, cache_creation struct<ephemeral_5m_input_tokens long, ephemeral_1h_input_tokens long>, service_tier string>>"
)
BRIDGE = struct(
    "ts string, ts_start string, ts_end string, duration_ms double, request_id string, model string, event string, error_type string, "
    "error_code string, status_code long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long"
)
DIRECT = struct(
    "ts string, request_id string, tool string, model string, input_tokens double, output_tokens double, reasoning_tokens double, "
    "total_tokens double, latency_ms double, bytes double"
)
WINDOW = struct("tool string, project string, tsStart string, tsEnd string")
SESSION_ENV = struct("event string, data struct<session string, base_url string>")
AGENT_SESSION = struct(
    "id string, source string, model string, started_at double, ended_at double, end_reason string, message_count long, tool_call_count long, "
    "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, billing_provider string, "
    "estimated_cost_usd double, actual_cost_usd double, cost_status string"
)
CODING_SESSION = struct(
    "id string, directory string, slug string, title string, agent string, model string, cost double, time_created long, tokens_input long, "
    "tokens_output long, tokens_reasoning long, tokens_cache_read long, tokens_cache_write long"
)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing ones are added, with their default where null is not allowed."""
    columns = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
