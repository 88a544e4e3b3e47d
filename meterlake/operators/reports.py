"""Reports over the ledger: grouped costs, source health, billing audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import models
from meterlake.functions.times import cutoff

SUMMED = ("input_tokens", "output_tokens", "cache_write_tokens", "reasoning_tokens", "cost_usd")


def keys() -> dict[str, Column]:
    """The expressions of all group keys."""
    return {
        "source": F.col("source"),
        "model": F.coalesce("model_norm", F.lit("(unknown)")),
        "billing": F.col("billing"),
        "day": F.substring("ts", 1, 10),
        "machine": F.coalesce("machine", F.lit("(unknown)")),
        "sub_tool": F.coalesce("sub_tool", F.lit("(none)")),
    }


def group(by: str) -> Column:
    """The expression of a group key."""
    known = keys()
    if by not in known:
        raise ValueError(f"cannot group by {by!r}; one of {', '.join(known)}")
    return known[by]


def recent(records: DataFrame, since_days: float | None, now: datetime) -> DataFrame:
    bound = cutoff(now, since_days)
    return records if bound is None else records.where(F.col("ts") >= bound)


def stats(records: DataFrame, by: str, since_days: float | None = None, now: datetime | None = None) -> DataFrame:
    """Counts, token sums and cost of the successful records by group; cache reads are not summed."""
    good = recent(records.where(F.col("outcome") == "ok"), since_days, now or datetime.now())
    return good.groupBy(group(by).alias("key")).agg(*_sums())


def _sums() -> list[Column]:
    return [F.count("*").alias("records"), *[F.sum(c).alias(c) for c in SUMMED]]


def stats_all(records: DataFrame, since_days: float | None = None, now: datetime | None = None) -> DataFrame:
    """The same for all keys at once, ``by`` telling which: one scan, and one aggregate over a grouping set for each key.

    A record is spread into one narrow row for each key, and those meet by (key, value) after they were summed in
    their tasks.
    """
    known = keys()
    good = recent(records.where(F.col("outcome") == "ok"), since_days, now or datetime.now())
    named = {by: f"_by_{by}" for by in known}
    rows = good.select(*[known[by].alias(c) for by, c in named.items()], *SUMMED)
    found = rows.groupingSets([[c] for c in named.values()], *named.values()).agg(F.grouping_id().alias("_set"), *_sums())
    bit = {by: (1 << len(named)) - 1 - (1 << len(named) - 1 - k) for k, by in enumerate(named)}
    by = F.coalesce(*[F.when(F.col("_set") == b, F.lit(name)) for name, b in bit.items()])
    key = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, b in bit.items():
        key = key.when(F.col("_set") == b, F.col(named[name]))
    return found.select(by.alias("by"), key.alias("key"), "records", *SUMMED)


def ordered_stats(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("cost_usd"), F.desc("records"), "key")


def outcomes(records: DataFrame) -> DataFrame:
    """Errors and all records by source."""
    return records.groupBy("source").agg(F.count_if(F.col("outcome") == "error").alias("errors"), F.count("*").alias("total"))


def source_status(state: DataFrame, records: DataFrame) -> DataFrame:
    """One row per source with state: its last run and its share of errors, null where nothing was seen."""
    return status_of(state, outcomes(records))


def status_of(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from counts (source, errors, total) that are known already."""
    joined = state.join(counts, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "total")})
    share = F.when(F.col("total") > 0, F.col("errors") / F.col("total") * 100)
    return joined.select(
        "source", F.coalesce("records_total", F.lit(0)).alias("records"), "last_status", "last_run_at", "last_note", "errors", "total", share.alias("err_pct")
    )


def sessions(records: DataFrame) -> DataFrame:
    """Transcript records with a session, and its name."""
    named = records.withColumn("session_id", F.get_json_object("raw", "$.sessionId"))
    return named.where((F.col("source") == models.TRANSCRIPTS) & F.col("session_id").isNotNull())


def billing_audit(records: DataFrame, env: DataFrame, since_days: float | None = 3, session: str | None = None, now: datetime | None = None) -> DataFrame:
    """One row per session: what was billed, what the session log says now, and whether they disagree.

    ``env`` has one row for each session. Errors are counted too.
    """
    rows = recent(sessions(records), since_days, now or datetime.now())
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    found = rows.groupBy("session_id").agg(
        F.count("*").alias("records"),
        F.array_join(F.array_sort(F.collect_set("model_norm")), ",").alias("models"),
        F.array_join(F.array_sort(F.collect_set("billing")), ",").alias("billings"),
        F.sum("cost_usd").alias("cost_usd"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    live = env.select(F.col("session").alias("session_id"), "base_url", F.lit(True).alias("present"))
    label = models.live_label(F.col("present"), F.col("base_url"))
    expected = F.when(F.col("present"), F.when(F.coalesce("base_url", F.lit("")) != "", "iu").otherwise("max"))
    return found.join(live, "session_id", "left").select(
        "session_id", "records", F.coalesce("models", F.lit("")).alias("models"), F.coalesce("billings", F.lit("")).alias("billings"), "cost_usd", "first_ts", "last_ts",
        label.alias("live_label"), F.coalesce("billings", F.lit("")).contains(",").alias("multi_billing"),
        F.coalesce(expected.isNotNull() & ~F.col("billings").eqNullSafe(expected), F.lit(False)).alias("mismatch"),
    )
