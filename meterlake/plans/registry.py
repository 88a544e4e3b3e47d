"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.functions import models, pricing
from meterlake.functions.times import cutoff, duration_ms, iso_millis, iso_seconds
from meterlake.operators import ledger as store
from meterlake.operators import reports, sync
from meterlake.operators.attribution import attributed
from meterlake.plans import inputs, usage
from meterlake.session import shared_folder
from meterlake.sources import records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Summed doubles are rounded, as the order of addition differs.
DIGITS = 9


def query(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key], ORACLES[key] = function, usage.sql(sql)
        return function

    return register


def _rounded(df: DataFrame, column: str = "cost_usd") -> DataFrame:
    return df.withColumn(column, F.round(column, DIGITS))


@query("""SELECT source, source_id, grain, ts, model, project, workspace, sub_tool, outcome, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
  cache_write_1h_tokens, reasoning_tokens, duration_ms, raw FROM base""")
def usage_projection(spark, sf_dir):
    columns = "source source_id grain ts model project workspace sub_tool outcome input_tokens output_tokens cache_read_tokens cache_write_tokens cache_write_1h_tokens reasoning_tokens duration_ms raw"
    return usage.base(spark, sf_dir).select(*columns.split())


@query("SELECT id, model, model_norm FROM named")
def normalize_model(spark, sf_dir):
    return usage.base(spark, sf_dir).select("id", "model", models.normalize_model(F.col("model")).alias("model_norm"))


@query("SELECT id, model FROM named WHERE source = 'claude-code' AND NOT bridged")
def bridge_filter(spark, sf_dir):
    return usage.base(spark, sf_dir).where((F.col("source") == models.TRANSCRIPTS) & ~models.is_bridge_routed(F.col("model"))).select("id", "model")


@query("SELECT id, source, model, session_id, billing FROM ledger")
def classify_billing(spark, sf_dir):
    return usage.ledger(spark, sf_dir).select("id", "source", "model", "session_id", "billing")


@query("SELECT id, model_norm, cost_usd, cost_source FROM ledger")
def compute_cost(spark, sf_dir):
    return usage.ledger(spark, sf_dir).select("id", "model_norm", "cost_usd", "cost_source")


@query("SELECT id, hour_tokens, cache_write_tokens - hour_tokens AS short_tokens FROM named")
def cache_clamp(spark, sf_dir):
    hour = pricing.hour_tokens(F.col("cache_write_tokens"), F.col("cache_write_1h_tokens"))
    return usage.base(spark, sf_dir).select("id", hour.alias("hour_tokens"), (F.col("cache_write_tokens") - hour).alias("short_tokens"))


@query("SELECT n.id, n.model_norm, coalesce(r_hour, r_write) AS hour_rate FROM named n JOIN rates r ON n.model_norm = r.model_norm")
def rate_fallback(spark, sf_dir):
    named = usage.base(spark, sf_dir).select("id", models.normalize_model(F.col("model")).alias("model_norm"))
    rates = pricing.rates(spark).select("model_norm", F.coalesce("rate_cache_write_1h", "rate_cache_write").alias("hour_rate"))
    return named.join(F.broadcast(rates), "model_norm").select("id", "model_norm", "hour_rate")  # the price list is of fixed size


_SUMS = """count(*) AS records, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, round(sum(cost_usd), 9) AS cost_usd"""
_KEYS = {
    "source": "source", "model": "coalesce(model_norm, '(unknown)')", "billing": "billing", "day": "substr(ts, 1, 10)",
    "machine": "coalesce(machine, '(unknown)')", "sub_tool": "coalesce(sub_tool, '(none)')",
}


def _stats(by: str) -> Query:
    return lambda spark, sf_dir: _rounded(reports.stats(usage.ledger(spark, sf_dir), by))


for _by, _key in _KEYS.items():
    query(f"SELECT {_key} AS key, {_SUMS} FROM ledger WHERE outcome = 'ok' GROUP BY 1", f"stats_by_{_by}")(_stats(_by))


@query(" UNION ALL ".join(f"SELECT '{by}' AS by, {key} AS key, {_SUMS} FROM ledger WHERE outcome = 'ok' GROUP BY 2" for by, key in _KEYS.items()))
def stats_all_keys(spark, sf_dir):
    return _rounded(reports.stats_all(usage.ledger(spark, sf_dir)))


@query(f"SELECT source AS key, {_SUMS} FROM ledger WHERE outcome = 'ok' AND ts >= '2024-01-24 00:00:00' GROUP BY 1")
def stats_since_days(spark, sf_dir):
    return _rounded(reports.stats(usage.ledger(spark, sf_dir), "source", 7, usage.NOW))


def _cut_ledger(spark: SparkSession, sf_dir: str, cut: str) -> store.Snapshots:
    """The ledger, stored with a folder for each period in its parts."""
    table = store.Store(spark, shared_folder(spark, "ledger"), buckets=2, cut=cut).records
    table.commit(store.align(usage.ledger(spark, sf_dir), store.LEDGER))
    return table


@query(f"SELECT source AS key, {_SUMS} FROM ledger WHERE outcome = 'ok' AND ts >= '2024-01-24 00:00:00' GROUP BY 1")
def stats_since_pruned(spark, sf_dir):
    """Statistics of the last days, for which folders of earlier days are not read."""
    rows = _cut_ledger(spark, sf_dir, "day").read(since=cutoff(usage.NOW, 7))
    return _rounded(reports.stats(rows, "source", 7, usage.NOW))


@query("SELECT round(sum(coalesce(cost_usd, 0)), 9) AS total_cost, count(*) FILTER (WHERE cost_usd IS NULL) AS unpriced_records FROM ledger WHERE outcome = 'ok'")
def total_cost(spark, sf_dir):
    good = usage.ledger(spark, sf_dir).where("outcome = 'ok'")
    return good.agg(F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), DIGITS).alias("total_cost"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_records"))


def _states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, None, "2024-01-30 00:00:00", "ok", None, i * 10) for i, s in enumerate((*usage.SOURCES, "other"))], store.STATE)


_STATE_SQL = ", ".join(f"('{s}', {i * 10})" for i, s in enumerate((*usage.SOURCES, "other")))


@query(f"""SELECT s.source, CAST(s.records AS BIGINT) AS records, 'ok' AS last_status, '2024-01-30 00:00:00' AS last_run_at, CAST(NULL AS VARCHAR) AS last_note,
  coalesce(o.errors, 0) AS errors, coalesce(o.total, 0) AS total, o.errors / o.total * 100 AS err_pct
FROM (VALUES {_STATE_SQL}) s(source, records) LEFT JOIN
  (SELECT source, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS total FROM base GROUP BY 1) o ON s.source = o.source""")
def source_status(spark, sf_dir):
    return reports.source_status(_states(spark), usage.base(spark, sf_dir))


@query("SELECT source, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS total, count(*) FILTER (WHERE outcome = 'error') / count(*) * 100 AS err_pct FROM base GROUP BY 1")
def error_rate(spark, sf_dir):
    return reports.outcomes(usage.base(spark, sf_dir)).withColumn("err_pct", F.col("errors") / F.col("total") * 100)


def _audit_sql(where: str = "TRUE") -> str:
    return f"""audited AS (
  SELECT json_extract_string(raw, '$.sessionId') AS session_id, count(*) AS records, coalesce(string_agg(DISTINCT model_norm, ',' ORDER BY model_norm), '') AS models,
    string_agg(DISTINCT billing, ',' ORDER BY billing) AS billings, round(sum(cost_usd), 9) AS cost_usd, min(ts) AS first_ts, max(ts) AS last_ts
  FROM ledger WHERE source = 'claude-code' AND json_extract_string(raw, '$.sessionId') IS NOT NULL AND {where} GROUP BY 1
), flagged AS (
  SELECT a.*, CASE WHEN e.session IS NULL THEN 'expired/missing' WHEN e.base_url <> '' THEN 'iu (ca)' ELSE 'max (c)' END AS live_label,
    contains(billings, ',') AS multi_billing, e.session IS NOT NULL AND billings <> CASE WHEN e.base_url <> '' THEN 'iu' ELSE 'max' END AS mismatch
  FROM audited a LEFT JOIN env e ON a.session_id = e.session
)"""


def _audit(spark: SparkSession, sf_dir: str, days: float | None = None, session: str | None = None) -> DataFrame:
    return _rounded(reports.billing_audit(usage.ledger(spark, sf_dir), usage.session_env(spark, sf_dir), days, session, usage.NOW))


def _audited(name: str, select: str, run: Query, where: str = "TRUE") -> None:
    QUERIES[name], ORACLES[name] = run, f"WITH {usage.SQL.strip()}, {_audit_sql(where)}\n{select}"


_audited("billing_audit", "SELECT * FROM flagged", lambda spark, sf_dir: _audit(spark, sf_dir))
_audited("billing_audit_since", "SELECT * FROM flagged", lambda spark, sf_dir: _audit(spark, sf_dir, 3), "ts >= '2024-01-28 00:00:00'")
_audited("billing_audit_pruned", "SELECT * FROM flagged", lambda spark, sf_dir: _rounded(reports.billing_audit(_cut_ledger(spark, sf_dir, "month").read(since=cutoff(usage.NOW, 3)), usage.session_env(spark, sf_dir), 3, None, usage.NOW)), "ts >= '2024-01-28 00:00:00'")
_audited("billing_audit_session", "SELECT * FROM flagged", lambda spark, sf_dir: _audit(spark, sf_dir, None, "s12"), "json_extract_string(raw, '$.sessionId') = 's12'")
_audited("audit_flags", "SELECT session_id, multi_billing, mismatch FROM flagged", lambda spark, sf_dir: _audit(spark, sf_dir).select("session_id", "multi_billing", "mismatch"))
_audited("audit_live_label", "SELECT live_label, count(*) AS sessions, count(*) FILTER (WHERE multi_billing OR mismatch) AS flagged FROM flagged GROUP BY 1", lambda spark, sf_dir: _audit(spark, sf_dir).groupBy("live_label").agg(F.count("*").alias("sessions"), F.count_if(F.col("multi_billing") | F.col("mismatch")).alias("flagged")))

_MATCHED = """(SELECT e.event_id, arg_min(w.tool, (w.end_ms - w.start_ms) * 1000000000 + w.seq) AS tool, arg_min(w.project, (w.end_ms - w.start_ms) * 1000000000 + w.seq) AS window_project
  FROM events e JOIN windows w ON (epoch_us(e.ts) // 1000) BETWEEN w.start_ms AND w.end_ms GROUP BY 1)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.events(spark, sf_dir).withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return attributed(rows, usage.windows(spark, sf_dir), "ts_ms")


@query(f"SELECT e.event_id, m.tool, m.window_project FROM events e LEFT JOIN {_MATCHED} m ON e.event_id = m.event_id")
def attribution_narrowest(spark, sf_dir):
    return _attributed(spark, sf_dir).select("event_id", "tool", "window_project")


@query(f"SELECT e.event_id FROM events e LEFT JOIN {_MATCHED} m ON e.event_id = m.event_id WHERE m.event_id IS NULL")
def attribution_unmatched(spark, sf_dir):
    return _attributed(spark, sf_dir).where("tool is null").select("event_id")


@query(f"SELECT coalesce(m.tool, '(none)') AS key, {_SUMS} FROM ledger l LEFT JOIN {_MATCHED} m ON l.id = m.event_id WHERE outcome = 'ok' GROUP BY 1")
def stats_by_attributed_tool(spark, sf_dir):
    tools = _attributed(spark, sf_dir).select(F.col("event_id").alias("id"), "tool")
    return _rounded(reports.stats(usage.ledger(spark, sf_dir).drop("sub_tool").join(tools, "id").withColumnRenamed("tool", "sub_tool"), "sub_tool"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose keys repeat: one for each user and source."""
    return usage.ledger(spark, sf_dir).withColumns({"source_id": F.col("session_id"), "seq": F.col("id")})


@query("SELECT source, session_id AS source_id, arg_max(input_tokens, id) AS input_tokens, arg_max(ts, id) AS ts FROM base GROUP BY 1, 2")
def dedupe_last_wins(spark, sf_dir):
    return store.latest(_keyed(spark, sf_dir)).select("source", "source_id", "input_tokens", "ts")


def _before_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A ledger without the signups, and a batch of signups, which are new, and of clicks, which come again with more tokens."""
    rows = usage.ledger(spark, sf_dir)
    batch = rows.where("sub_tool in ('signup', 'click')").drop("id", "synced_at", "ingested_at").withColumn("input_tokens", F.col("input_tokens") + 1)
    return store.align(rows.where("sub_tool is distinct from 'signup'"), store.LEDGER), batch


@query("""SELECT source, source_id, CASE WHEN sub_tool = 'signup' THEN (SELECT max(id) FROM base WHERE sub_tool IS DISTINCT FROM 'signup') ELSE id END AS least_id,
  CASE WHEN sub_tool IN ('signup', 'click') THEN input_tokens + 1 ELSE input_tokens END AS input_tokens,
  CASE WHEN sub_tool IN ('signup', 'click') THEN '2024-01-31 00:00:00' ELSE ingested_at END AS ingested_at, CASE WHEN sub_tool IS DISTINCT FROM 'signup' THEN synced_at END AS synced_at
FROM base""")
def upsert_merge(spark, sf_dir):
    old, batch = _before_and_batch(spark, sf_dir)
    top = old.agg(F.max("id").alias("top"))
    put = store.merged(old, batch, "2024-01-31 00:00:00").join(F.broadcast(top))
    new = F.col("id") > F.col("top")
    return put.select("source", "source_id", F.when(new, F.col("top")).otherwise(F.col("id")).alias("least_id"), "input_tokens", "ingested_at", "synced_at")


@query("SELECT source, count(*) AS new_rows FROM base WHERE sub_tool = 'signup' GROUP BY 1")
def upsert_new_rows(spark, sf_dir):
    old, batch = _before_and_batch(spark, sf_dir)
    return store.new_rows(old, batch).groupBy("source").agg(F.count("*").alias("new_rows"))


def _after_two_puts(spark: SparkSession, sf_dir: str) -> tuple[store.Store, int]:
    """A ledger after two batches, the second twice: all but signups; then signups, clicks with more tokens, and errors of even users that turned ok. And its greatest id after the first."""
    ledger = store.Store(spark, shared_folder(spark, "ledger"), buckets=8)
    rows = usage.ledger(spark, sf_dir).drop("id", "synced_at", "ingested_at")
    first = ledger.put(rows.where("sub_tool is distinct from 'signup'"), "2024-01-30 00:00:00", ("stream", 0))
    turned = (F.col("outcome") == "error") & (F.substring("session_id", 2, 20).cast("long") % 2 == 0)
    again = rows.where(F.col("sub_tool").isin("signup", "click") | turned).withColumns({"input_tokens": F.col("input_tokens") + 1, "outcome": F.lit("ok")})
    for at in ("2024-01-31 00:00:00", "2024-02-01 00:00:00"):  # the second time it is known and left out
        ledger.put(again, at, ("stream", 1))
    return ledger, first


_AGAIN = "(sub_tool IN ('signup', 'click') OR (outcome = 'error' AND user_number % 2 = 0))"
_USERS = "(SELECT *, CAST(substr(session_id, 2) AS BIGINT) AS user_number FROM base)"


@query(f"""SELECT source, source_id, sub_tool IS NOT DISTINCT FROM 'signup' AS fresh, CASE WHEN coalesce({_AGAIN}, false) THEN input_tokens + 1 ELSE input_tokens END AS input_tokens,
  CASE WHEN coalesce({_AGAIN}, false) THEN 'ok' ELSE outcome END AS outcome, CASE WHEN coalesce({_AGAIN}, false) THEN '2024-01-31 00:00:00' ELSE '2024-01-30 00:00:00' END AS ingested_at FROM {_USERS}""")
def ledger_puts(spark, sf_dir):
    ledger, first = _after_two_puts(spark, sf_dir)
    return ledger.records.read().select("source", "source_id", (F.col("id") > first).alias("fresh"), "input_tokens", "outcome", "ingested_at")


@query("SELECT count(*) AS records, count(*) AS ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id FROM base")
def ledger_ids(spark, sf_dir):
    ledger, _ = _after_two_puts(spark, sf_dir)
    return ledger.records.read().agg(F.count("*").alias("records"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"SELECT source, count(*) AS records_total, count(*) FILTER (WHERE outcome = 'error' AND NOT coalesce({_AGAIN}, false)) AS errors FROM {_USERS} GROUP BY 1")
def ledger_totals(spark, sf_dir):
    """Totals that the commits kept, without a scan of the ledger."""
    return _after_two_puts(spark, sf_dir)[0].totals()


@query("SELECT session_id AS session, arg_max(project, id) AS base_url FROM base GROUP BY 1")
def session_env_last_wins(spark, sf_dir):
    told = F.to_json(F.struct(F.lit("session_env").alias("event"), F.struct(F.col("session_id").alias("session"), F.col("project").alias("base_url")).alias("data")))
    return records.session_env(usage.base(spark, sf_dir).select(F.lit("log").alias("path"), F.col("id").alias("offset"), told.alias("value"), F.lit(0).cast("long").alias("file")))


_ELIGIBLE = "(synced_at IS NULL OR ingested_at > synced_at)"


@query(f"SELECT id, source, source_id FROM base WHERE {_ELIGIBLE}")
def sync_eligible(spark, sf_dir):
    return sync.eligible(usage.base(spark, sf_dir)).select("id", "source", "source_id")


@query(f"SELECT id, source, source_id FROM base WHERE {_ELIGIBLE} ORDER BY id LIMIT 500")
def sync_page(spark, sf_dir):
    return sync.pages(usage.base(spark, sf_dir), most=1).select("id", "source", "source_id")


@query(f"SELECT id, source, source_id, model_norm, billing, cost_source, json_extract_string(raw, '$.sessionId') AS session_id, CAST(input_tokens AS VARCHAR) AS input_tokens FROM ledger WHERE {_ELIGIBLE}")
def sync_payload(spark, sf_dir):
    sent = sync.payload(store.align(sync.eligible(usage.ledger(spark, sf_dir)), store.LEDGER))
    field = lambda path: F.get_json_object("body", f"$.{path}")
    return sent.select("id", "source", "source_id", field("model_norm").alias("model_norm"), field("billing").alias("billing"), field("cost_source").alias("cost_source"), field("raw.sessionId").alias("session_id"), field("input_tokens").alias("input_tokens"))


_SENT = [f for f in store.LEDGER.fields if f.name not in sync.HELD_BACK]
_SENT_SQL = ", ".join(f"round({f.name}, {DIGITS}) AS {f.name}" if f.name == "cost_usd" else f.name for f in _SENT if f.name != "raw")


@query(f"""SELECT {_SENT_SQL}, CASE WHEN readable THEN json_extract_string(raw, '$.sessionId') END AS raw_session, CASE WHEN readable THEN CAST(json_extract(raw, '$.n') AS BIGINT) END AS raw_n,
  CAST({len(_SENT)} AS BIGINT) AS fields FROM (SELECT *, id % 5 <> 0 AND id % 7 <> 0 AS readable FROM ledger) WHERE {_ELIGIBLE}""")
def sync_payload_fields(spark, sf_dir):
    """Every field that is sent, read back from the body; some records' ``raw`` is broken or empty, and null there."""
    raw = F.when(F.col("id") % 5 == 0, '{"broken').when(F.col("id") % 7 == 0, "").otherwise(F.col("raw"))
    sent = sync.payload(store.align(sync.eligible(usage.ledger(spark, sf_dir).withColumn("raw", raw)), store.LEDGER))
    told = schema.T.StructType([schema.T.StructField("raw", schema.struct("sessionId string, n long")) if f.name == "raw" else f for f in _SENT])
    rows = sent.select(F.from_json("body", told).alias("j"), F.size(F.json_object_keys("body")).cast("long").alias("fields"))
    read = rows.select(*[f"j.{f.name}" for f in _SENT if f.name != "raw"], F.col("j.raw.sessionId").alias("raw_session"), F.col("j.raw.n").alias("raw_n"), "fields")
    return _rounded(read)


@query("SELECT event_id, event_type FROM events WHERE event_id > 500")
def incremental_since_cursor(spark, sf_dir):
    return usage.events(spark, sf_dir).where("event_id > 500").select("event_id", "event_type")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS from_millis, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS from_seconds FROM events")
def epoch_to_iso(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return usage.events(spark, sf_dir).select("event_id", iso_millis(F.unix_millis(at)).alias("from_millis"), iso_seconds(F.unix_seconds(at).cast("double")).alias("from_seconds"))


@query("SELECT event_id, greatest(0, floor((value - 50) * 1000 + 0.5)) AS duration_ms FROM events")
def duration(spark, sf_dir):
    return usage.events(spark, sf_dir).select("event_id", duration_ms(F.lit(50.0), F.col("value")).alias("duration_ms"))


@query("SELECT id, json_extract_string(raw, '$.sessionId') AS session_id FROM base WHERE json_extract_string(raw, '$.sessionId') IS NOT NULL")
def raw_json_extract(spark, sf_dir):
    return reports.sessions(usage.base(spark, sf_dir)).select("id", "session_id")


@query("SELECT source, count(*) AS records_total FROM base GROUP BY 1")
def state_records_total(spark, sf_dir):
    return store.record_totals(usage.base(spark, sf_dir))


@query("SELECT CAST(event_id % 6 AS BIGINT) AS source_number, max((epoch_us(ts) // 1000)) AS last_cursor FROM events GROUP BY 1")
def source_cursor_max(spark, sf_dir):
    rows = usage.events(spark, sf_dir)
    return rows.groupBy((F.col("event_id") % 6).alias("source_number")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_cursor"))


@query("SELECT id, ts FROM base WHERE ts >= '2024-01-28 00:00:00'")
def recent_records(spark, sf_dir):
    return usage.base(spark, sf_dir).where(F.col("ts") >= cutoff(usage.NOW, 3)).select("id", "ts")


for _queries, _into in zip(inputs.registered(), (QUERIES, ORACLES), strict=True):
    _into.update(_queries)
