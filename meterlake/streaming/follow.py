"""Growing logs as streams into the ledger, with Spark's checkpoint as the cursor."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from meterlake import ingest
from meterlake.operators.ledger import Store
from meterlake.sources import lines, records, registry


def builders(spark: SparkSession, paths: registry.Paths) -> dict[str, tuple[str, Callable[[DataFrame, str], DataFrame]]]:
    """The sources that are followed: their files, and how a batch of lines becomes records.

    Work windows are read anew for each batch, so they hold as of its run.
    """
    return {
        "claude-code": (paths.transcripts, records.transcripts),
        "litellm": (paths.bridge, lambda rows, now: records.bridge(rows, records.windows(lines.scan(spark, paths.windows)), now)),
        "sideclaw-iu": (paths.direct, records.direct),
    }


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps with its checkpoint; a new checkpoint, whose batches count from 0 again, has another."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


def putter(spark: SparkSession, store: Store, paths: registry.Paths, build: Callable[[DataFrame, str], DataFrame], name: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """What puts a batch of lines into the ledger, once for each batch of the stream ``name`` tells."""

    def put(rows: DataFrame, batch: int) -> None:
        now = datetime.now(UTC)
        env = records.session_env(lines.scan(spark, paths.session_env))
        ingest.put(store, build(rows, registry.iso(now)), env, None, now, (name(), batch))

    return put


def follow(spark: SparkSession, store: Store, paths: registry.Paths, source: str, checkpoint: str, every: str | None = None, most: int | None = None) -> StreamingQuery:
    """Put a source's new lines into the ledger: what there is now, or with ``every`` again and again.

    With ``most`` a batch has about so many bytes; without ``every`` that is one batch (see ``drain``).

    A batch that is repeated after a failure is put in once: the commit notes the stream and its batch.
    """
    patterns, build = builders(spark, paths)[source]
    put = putter(spark, store, paths, build, lambda: stream_id(spark, checkpoint))
    stream = lines.tail(spark, patterns, None, most).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()


def drain(spark: SparkSession, store: Store, paths: registry.Paths, source: str, checkpoint: str, most: int) -> int:
    """Put all that a source has now into the ledger, in batches of about ``most`` bytes; how many it took."""
    n = 0
    while True:
        query = follow(spark, store, paths, source, checkpoint, most=most)
        query.awaitTermination()
        if not sum(p["numInputRows"] for p in query.recentProgress):
            return n
        n += 1
