"""A run over all sources: read, enrich, put into the ledger, note the state; then export."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from meterlake.functions.times import stamp
from meterlake.operators import enrich, ledger, sync
from meterlake.sources import lines, records, registry

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Result:
    source: str
    status: str
    processed: int = 0
    new_rows: int = 0
    note: str | None = None
    #: Lines that were read, and those of each kind.
    seen: dict[str, int] = field(default_factory=dict)
    batches: int = 0


def put(store: ledger.Store, found: DataFrame, env: DataFrame, workspace: str | None, now: datetime, marker: tuple[str, int] | None = None) -> tuple[int, int]:
    """Put records into the ledger: how many there were, and how many keys were new.

    Of repeated keys the last counts. Records that come again replace all but id and synced_at.
    """
    batch = enrich.enriched(found, env, workspace, enrich.machine()).persist()
    try:
        processed = batch.count()
        if not processed:
            return 0, 0
        keys = batch.select(*ledger.KEY).dropna()
        return processed, store.put(ledger.latest(batch), stamp(now), marker, keys=keys)
    finally:
        batch.unpersist()


def _state(spark: SparkSession, store: ledger.Store, source: str, cursor: str | None, status: str, note: str | None, now: datetime) -> None:
    run = spark.createDataFrame([(source, cursor, stamp(now), status, note, 0)], ledger.STATE)
    with store.lock:
        store.state.commit(ledger.merged_state(store.state.read(), run, store.totals().drop("errors")))


def cursor_of(store: ledger.Store, source: str) -> str | None:
    row = store.state.read().where(f"source = '{source}'").select("cursor").first()
    return row[0] if row else None


def run_one(spark: SparkSession, store: ledger.Store, source: registry.Source, env: DataFrame, full: bool, now: datetime) -> Result:
    """One source; its failure is noted, keeps its cursor and stops no other.

    A long backlog is read in several batches, each with a commit and a cursor of its own.
    """
    if not source.available():
        return Result(source.name, "skipped", note="not present")
    cursor = None if full else cursor_of(store, source.name)
    processed, new, batches, seen, more = 0, 0, 0, {}, True
    try:
        while more:
            got = source.collect(spark, cursor, now)
            some, fresh = put(store, got.records, env, source.workspace, now)
            processed, new, batches, cursor, more = processed + some, new + fresh, batches + 1, got.cursor, got.more
            if got.seen is not None:
                seen = {k: seen.get(k, 0) + v for k, v in got.seen.get.items()}
            status = "skipped" if got.note and not processed else "ok"
            _state(spark, store, source.name, cursor, status, got.note, now)
        if source.drops_keyless and seen.get("keyless"):
            log.warning("%s: %d rows without request_id dropped", source.name, seen["keyless"])
        return Result(source.name, status, processed, new, got.note, seen, batches)
    except Exception as error:  # whatever a source does, the others run
        note = str(error).splitlines()[0] if str(error) else type(error).__name__
        log.error("%s: %s", source.name, note)
        _state(spark, store, source.name, cursor_of(store, source.name), "error", note, now)
        return Result(source.name, "error", note=note)


def side_by_side(spark: SparkSession, store: ledger.Store, found: list[registry.Source], env: DataFrame, full: bool, now: datetime) -> list[Result]:
    """Each source in a thread and a scheduler pool of its own; results in the order of the sources."""
    results: dict[str, Result] = {}

    def one(source: registry.Source) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", source.name)
        results[source.name] = run_one(spark, store, source, env, full, now)

    threads = [InheritableThread(target=one, args=(s,), session=spark) for s in found]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return [results.get(s.name) or Result(s.name, "error", note="its state could not be written") for s in found]


def kept_sessions(spark: SparkSession, store: ledger.Store, patterns: str) -> DataFrame:
    """The last value of every session that the log has ever told of; only its new lines are read."""
    known = {k: int(v) for k, v in store.sessions.notes().get("cursor", {}).items()}
    end, _ = lines.step(lines.files(patterns), known, None, lines.by_job(spark))
    if end != known:
        store.remember(records.session_env(lines.scan(spark, patterns, known, end)), end)
    return store.sessions.read()


def run(
    spark: SparkSession, store: ledger.Store, paths: registry.Paths, full: bool = False, only: str | None = None,
    transport: sync.Transport | None = None, now: datetime | None = None, most: int = registry.BATCH_BYTES, remember: bool = False,
) -> list[Result]:
    """All sources, or the one named; then the export, whose failure is only logged.

    Sources run side by side, each in a scheduler pool of its own name. With ``remember`` what the session log has
    told is kept, so that billing does not change when the log's lines expire.
    """
    found = registry.sources(paths, most)
    if only is not None and only not in found:
        raise ValueError(f'unknown source "{only}"')
    now = now or datetime.now(UTC)
    env = kept_sessions(spark, store, paths.session_env) if remember else records.session_env(lines.scan(spark, paths.session_env))
    results = side_by_side(spark, store, [s for s in found.values() if only in (None, s.name)], env, full, now)
    try:
        sync.sync(store, transport)
    except Exception as error:
        log.error("sync: %s", error)
    return results
