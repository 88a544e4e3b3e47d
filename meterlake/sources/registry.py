"""The sources: where each is found, how it is read, and what holds for all its records."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meterlake import schema
from meterlake.sources import lines, records, sqlite


#: Bytes of a log that are read and committed together.
BATCH_BYTES = 64 << 30


@dataclass(frozen=True)
class Paths:
    """Where the inputs are; patterns may be several, separated by commas."""

    transcripts: str
    bridge: str
    windows: str
    direct: str
    session_env: str
    coding: str
    hermes: str
    feuer: str
    feuer_container: str | None = None

    @classmethod
    def from_environment(cls, home: str | None = None) -> Paths:
        home = home or os.path.expanduser("~")
        env = lambda name, *parts: os.environ.get(name) or os.path.join(home, *parts)
        root, data = os.path.join(home, ".claude", "projects"), (".local", "share", "meterlake")
        return cls(
            transcripts=f"{root}/*/*.jsonl,{root}/*/*/subagents/*.jsonl",
            bridge=env("LITELLM_USAGE_LOG", *data, "litellm.jsonl"),
            windows=env("SIDECLAW_SESSIONS_LOG", *data, "sideclaw-sessions.jsonl"),
            direct=env("SIDECLAW_IU_USAGE_LOG", *data, "sideclaw-iu.jsonl"),
            session_env=os.path.join(home, ".claude", "logs", "*.jsonl"),
            coding=os.path.join(home, ".local", "share", "opencode", "opencode.db"),
            hermes=env("HERMES_DB", ".hermes", "state.db"),
            feuer_container=os.environ.get("FEUER_CONTAINER") or None,
            feuer=os.environ.get("FEUER_DB", ""),  # no default: without it the source is absent
        )


@dataclass(frozen=True)
class Collected:
    """Records of a batch, the cursor after them, and a note where something kept the source from being read.

    ``seen`` has counts of the lines once the records were read; ``more`` if there is more behind the cursor.
    """

    records: DataFrame
    cursor: str | None
    note: str | None = None
    seen: Observation | None = None
    more: bool = False


@dataclass(frozen=True)
class Source:
    name: str
    available: Callable[[], bool]
    collect: Callable[[SparkSession, str | None, datetime], Collected]
    workspace: str | None = None
    #: Whether rows without a key are dropped, and so to be told of.
    drops_keyless: bool = False


def iso(now: datetime) -> str:
    return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.RECORD)


def _by_lines(name: str, patterns: str, build: Callable[[SparkSession, DataFrame, str, Observation], DataFrame], most: int) -> Source:
    import json

    def collect(spark: SparkSession, cursor: str | None, now: datetime) -> Collected:
        begin, seen = lines.parse_cursor(cursor), Observation(name)
        end, more = lines.step(lines.files(patterns), begin, most, lines.by_job(spark))
        records = build(spark, lines.scan(spark, patterns, begin, end), iso(now), seen)
        return Collected(records, json.dumps(end, sort_keys=True), None, seen, more)

    return Source(name, lambda: bool(lines.listed(patterns)), collect, drops_keyless=name == "sideclaw-iu")


def agent_source(name: str, path: str, workspace: str, project: str) -> Source:
    """A source over an agent's session store, read whole each time as sessions grow."""

    def collect(spark: SparkSession, cursor: str | None, now: datetime) -> Collected:
        if note := sqlite.problem(path, "sessions", schema.AGENT_SESSION):
            return Collected(empty(spark), None, note)
        rows = sqlite.scan(spark, path, "sessions", schema.AGENT_SESSION)
        last = rows.agg(F.max("started_at")).first()[0]
        return Collected(records.agent_sessions(name, rows, project), None if last is None else str(last))

    return Source(name, lambda: os.path.exists(path), collect, workspace)


def container_source(name: str, container: str, workspace: str, project: str) -> Source:
    """A source over the session store in a container, which exports it as a JSON array; always there."""

    def collect(spark: SparkSession, cursor: str | None, now: datetime) -> Collected:
        try:
            told = exported(container)
        except (OSError, ValueError, subprocess.SubprocessError) as error:
            return Collected(empty(spark), cursor, str(error))
        rows = exported_sessions(spark, told)
        last = rows.agg(F.max("started_at")).first()[0]
        return Collected(records.agent_sessions(name, rows, project), None if last is None else str(last))

    return Source(name, lambda: True, collect, workspace)


def exported(container: str) -> list[str]:
    """One JSON object for each session in a container's store, by Python in it."""
    names = ", ".join(f.name for f in schema.AGENT_SESSION.fields)
    script = (
        "import json, sqlite3\ndb = sqlite3.connect('file:/opt/data/state.db?mode=ro', uri=True)\ndb.row_factory = sqlite3.Row\n"
        f"for row in db.execute('SELECT {names} FROM sessions'):\n    print(json.dumps(dict(row)))"
    )
    done = subprocess.run(["docker", "exec", container, "python3", "-c", script], capture_output=True, text=True, timeout=600, check=True)
    return done.stdout.splitlines()


def exported_sessions(spark: SparkSession, told: list[str]) -> DataFrame:
    """Sessions from JSON objects as text."""
    rows = spark.createDataFrame([(x,) for x in told], "value string")
    return rows.select(F.from_json("value", schema.AGENT_SESSION).alias("j")).select("j.*")


def coding_source(path: str) -> Source:
    def collect(spark: SparkSession, cursor: str | None, now: datetime) -> Collected:
        if note := sqlite.problem(path, "session", schema.CODING_SESSION):
            return Collected(empty(spark), None, note)
        rows = sqlite.scan(spark, path, "session", schema.CODING_SESSION)
        last = rows.agg(F.max("time_created")).first()[0]
        return Collected(records.coding_sessions(rows), None if last is None else str(last))

    return Source("opencode", lambda: os.path.exists(path), collect, "private")


def sources(paths: Paths, most: int = BATCH_BYTES) -> dict[str, Source]:
    """All sources in the order in which they run; logs are read in batches of about ``most`` bytes."""
    work = lambda spark: records.windows(lines.scan(spark, paths.windows))
    found = (
        _by_lines("claude-code", paths.transcripts, lambda spark, rows, now, seen: records.transcripts(rows, now, seen), most),
        agent_source("hermes", paths.hermes, "private", "hermes-agent"),
        container_source("feuer", paths.feuer_container, "work", "prometheus-feuer-agent") if paths.feuer_container else agent_source("feuer", paths.feuer, "work", "prometheus-feuer-agent"),
        coding_source(paths.coding),
        _by_lines("litellm", paths.bridge, lambda spark, rows, now, seen: records.bridge(rows, work(spark), now, seen), most),
        _by_lines("sideclaw-iu", paths.direct, lambda spark, rows, now, seen: records.direct(rows, now, seen), most),
    )
    return {s.name: s for s in found}
