"""The ledger: a keyed table in Parquet snapshots, in parts by source and bucket of keys that replace each other whole.

A commit writes new snapshots of the parts that changed and then replaces the file ``CURRENT`` that
names the snapshot of every part, so readers see all of the commit or nothing. There is one writer
at a time. Paths may be on any file system that Spark writes; the pointer is handled through
Hadoop's file API.
"""

from __future__ import annotations

import json
import threading
import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.schema import LEDGER, STATE, align, struct
from meterlake.session import shared_folder

KEY = ("source", "source_id")
BUCKETS = 1024
#: Parts of each source, which a commit writes one by one, and rows of a file of a part.
LEDGER_BUCKETS, FILE_ROWS = 64, 5_000_000
ACK = "source string, source_id string, at string"
SESSIONS = struct("session string, base_url string")
TOTALS = "source string, records_total long, errors long"
#: Kept from the row that was there when its key comes again.
KEPT = ("id", "source", "source_id", "synced_at")
#: Periods that parts may be cut by, as lengths of the text that begins a time, and the period of rows whose ts begins
#: with no day. That one sorts behind all others, so no bound leaves it out.
PERIODS, UNDATED = {"month": 7, "day": 10}, "undated"


def period_of(ts: Column, cut: str) -> Column:
    """The period of a time in text. ``ts >= bound`` implies ``period >= period of bound``, as both are compared as text."""
    return F.when(ts.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(ts, 1, PERIODS[cut])).otherwise(F.lit(UNDATED))


def latest(batch: DataFrame) -> DataFrame:
    """The last row of each key by ``seq``; null counts as before all others.

    A hash aggregate finds the greatest order key of each record key, and rows that have it stay. The order key
    is one number, ``seq`` and then a hash of the row: rows of equal ``seq`` are told apart by that hash, and
    rows that are equal in all columns are one. Rows without source or source_id are none of the ledger's.
    """
    rest = [c for c in batch.columns if c not in (*KEY, "seq")]
    chance = F.shiftrightunsigned(F.xxhash64(*rest), 4).cast("decimal(38,0)") if rest else F.lit(0).cast("decimal(38,0)")
    ranked = batch.withColumn("_rank", (F.coalesce("seq", F.lit(-1)).cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + chance).cast("decimal(38,0)"))
    top = ranked.groupBy(*KEY).agg(F.max("_rank").alias("_rank"))
    return ranked.join(top, [*KEY, "_rank"], "left_semi").drop("seq").distinct().drop("_rank")  # still dealt by key and rank


def joined(old: DataFrame, batch: DataFrame, now: str, touch_unchanged: bool = True) -> DataFrame:
    """``old`` with the batch's rows put in by key: old keys keep id and synced_at, new ones have no id yet.

    ``_was`` is the outcome that a key had before, and null for a new one. Without ``touch_unchanged``
    rows that come again unchanged keep their ingested_at as well.
    """
    new = batch.select(*KEY, F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LEDGER.fields if f.name in batch.columns and f.name not in KEPT and f.name != "ingested_at"]).alias("n"))
    names = [f.name for f in new.schema["n"].dataType.fields]
    both = old.alias("o").join(new.alias("n"), list(KEY), "full")
    came = F.col("n.n").isNotNull()
    same = F.lit(False) if touch_unchanged else F.struct(*[F.col(f"o.{c}") for c in names]).eqNullSafe(F.struct(*[F.col(f"n.n.{c}") for c in names]))
    columns = {c: F.when(came, F.col(f"n.n.{c}")).otherwise(F.col(f"o.{c}")) for c in names}
    columns["ingested_at"] = F.when(came & ~same, F.lit(now)).otherwise(F.col("o.ingested_at"))
    put = both.select(*KEY, F.col("o.id").alias("id"), F.col("o.synced_at").alias("synced_at"), F.col("o.outcome").alias("_was"), *[columns.get(c, F.col(f"o.{c}")).alias(c) for c in LEDGER.names if c not in KEPT])
    return align(put, T.StructType([*LEDGER.fields, T.StructField("_was", T.StringType())]))


def numbered(put: DataFrame, top: int) -> DataFrame:
    """Rows of ``joined``, which were stored, with ids for the new ones: those after ``top``, dense, in order of their bucket and key.

    They are numbered in ``BUCKETS`` hash buckets, whose counts are then summed, so that no task
    holds them all and a repeated task numbers them alike.
    """
    fresh = put.where("id is null").withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)))
    sizes = fresh.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    given = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(*KEY)))
    placed = given.join(F.broadcast(before), "_bucket")  # BUCKETS rows at most
    return align(put.where("id is not null").unionByName(placed.withColumn("id", F.lit(top) + F.col("_before") + F.col("_n")).select(*put.columns)), LEDGER)


def merged(old: DataFrame, batch: DataFrame, now: str, touch_unchanged: bool = True) -> DataFrame:
    """``old``, a whole ledger, after the batch. The joined rows are stored once, and numbered from there."""
    spark = old.sparkSession
    put = joined(old, batch, now, touch_unchanged)
    path = shared_folder(spark, "merged")
    put.write.parquet(path)
    stored = spark.read.schema(put.schema).parquet(path)
    return numbered(stored, stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])


def changes(put: DataFrame) -> dict[str, tuple[int, int]]:
    """What ``joined`` rows add to each source's number of records and of errors; a record that turns from error to ok takes one away."""
    error = lambda c: F.coalesce(F.col(c) == "error", F.lit(False)).cast("long")
    new = F.col("id").isNull()
    found = put.groupBy("source").agg(F.count_if(new).alias("records"), F.sum(error("outcome") - F.when(new, 0).otherwise(error("_was"))).alias("errors"))
    return {r["source"]: (r["records"], r["errors"]) for r in found.collect()}  # one for each source


def new_rows(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The keys of the batch that the ledger does not have."""
    return batch.select(*KEY).distinct().join(old.select(*KEY), list(KEY), "left_anti")


def acknowledged(ledger: DataFrame, noted: DataFrame) -> DataFrame:
    """The ledger with synced_at set on the keys of ``noted`` (unique source and source_id, at)."""
    marked = ledger.join(noted.select(*KEY, F.col("at").alias("_at")), list(KEY), "left")
    return marked.withColumn("synced_at", F.coalesce("_at", "synced_at")).select(*LEDGER.names)


def record_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("source").agg(F.count("*").alias("records_total"))


def merged_state(state: DataFrame, runs: DataFrame, totals: DataFrame) -> DataFrame:
    """State by source with the runs' values put in, and the totals of their sources counted anew."""
    counted = runs.drop("records_total").join(totals, "source", "left").withColumn("records_total", F.coalesce("records_total", F.lit(0)))
    return align(state.join(runs.select("source"), "source", "left_anti"), STATE).unionByName(align(counted, STATE))


class Snapshots:
    """Versions of one table under a folder; with ``by`` each value of that column has versions of its own.

    With ``buckets`` the rows of a value are dealt over so many parts by a hash of ``bucket_by``, each sorted by that
    column and with versions of its own; a commit writes the parts that it names. The pointer also holds
    what belongs to a commit as a whole (``notes``): it changes with the parts or not at all.

    With ``cut`` (``month`` or ``day``) a part has a folder for each period of ``ts``, so that reading from a bound on
    leaves older folders alone. A version's name ends with its cut, so parts of different cuts, or without one, lie
    side by side and each takes the present cut when it is written next.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keep: int = 2, by: str | None = None, buckets: int = 0, bucket_by: str | None = None, cut: str | None = None):
        if cut is not None and (cut not in PERIODS or by is None):
            raise ValueError(f"a table in parts is cut by {' or '.join(PERIODS)}, not {cut!r}")
        self.spark, self.folder, self.schema, self.keep, self.by, self.buckets, self.bucket_by, self.cut = spark, folder.rstrip("/"), schema, keep, by, buckets, bucket_by, cut
        self.jvm = spark._jvm
        self.fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def current(self) -> str | None:
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self.fs.exists(pointer):
            return None
        stream = self.fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _pointer(self) -> tuple[dict[str | None, str], dict]:
        name = self.current()
        if name is None or not name.startswith("{"):
            return ({} if name is None else {None: name}), {}
        found = json.loads(name)
        if self.buckets:  # a table keeps the number that it was made with
            self.buckets = found.get("buckets", self.buckets)
        return (found["parts"], found["notes"]) if isinstance(found.get("parts"), dict) else (found, {})

    def parts(self) -> dict[str | None, str]:
        """The folder of every part's snapshot; a table in one part has it under ``None``."""
        return self._pointer()[0]

    def notes(self) -> dict:
        return self._pointer()[1]

    def part(self) -> Column:
        """The part that a row belongs to."""
        value = F.col(self.by)
        return F.concat(value, F.lit("#"), F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("string")) if self.buckets else value

    def touched(self, rows: DataFrame) -> list[str]:
        """The parts that rows belong to; no more than there are values and buckets."""
        self._pointer()
        return [r[0] for r in rows.select(self.part()).distinct().collect()]

    def _whole(self, parts: dict[str | None, str]) -> bool:
        """Whether the table is in parts of another kind, which the next commit takes apart."""
        return None in parts or bool(self.buckets) and any("#" not in p for p in parts)

    def _version(self, name: str, paths: list[str], since: str | None) -> DataFrame:
        cut = name.rsplit("-", 1)[-1]
        if cut not in PERIODS:
            return align(self.spark.read.parquet(*paths), self.schema)
        columns = T.StructType([*self.schema.fields, T.StructField("part", T.StringType()), T.StructField("period", T.StringType())])
        rows = self.spark.read.schema(columns).option("basePath", f"{self.folder}/{name}").parquet(*paths)
        return align(rows if since is None else rows.where(F.col("period") >= since[: PERIODS[cut]]), self.schema)

    def read(self, values: list[str] | None = None, since: str | None = None) -> DataFrame:
        """The table, or some parts. With ``since``, a time in text that begins with a year, periods before it are left out.

        Rows of its own period, and of parts that are not cut, are all there: ``since`` does not stand for a filter on ``ts``.
        """
        parts = self.parts()
        whole = self._whole(parts)
        by_version: dict[str, list[str]] = {}
        for value, name in parts.items():
            if values is None or whole or value in values:
                by_version.setdefault(name.split("/")[0], []).append(f"{self.folder}/{name}")
        if not by_version:
            return self.spark.createDataFrame([], self.schema)
        found = reduce(DataFrame.unionByName, [self._version(name, paths, since) for name, paths in by_version.items()])
        return found if values is None or self.by is None else found.where(self.part().isin(values))

    def commit(self, df: DataFrame, values: list[str] | None = None, notes: dict | None = None) -> None:
        """Write ``df``, which may read the current version, as the next one, of the table or of the parts ``values``.

        ``notes`` are put over those of the pointer; without them a whole table's are dropped, as they tell of other rows.
        """
        parts, noted = self._pointer()
        if values is not None and self._whole(parts):
            df, values = self.read().where(~self.part().isin(values)).unionByName(align(df, self.schema)), None
        noted = (noted if values is not None or notes is not None else {}) | (notes or {})
        last = max((int(n.split("-")[0][1:]) for n in parts.values()), default=0)
        name = f"v{last + 1:08d}-{uuid.uuid4().hex[:8]}" + (f"-{self.cut}" if self.cut else "")
        target = self._path(f"{self.folder}/{name}")
        if self.by is None:
            align(df, self.schema).write.parquet(f"{self.folder}/{name}")
            content = json.dumps({"parts": {"": name}, "notes": noted}, sort_keys=True) if noted else name
        else:
            rows, folders = align(df, self.schema).withColumn("part", self.part()), ["part"]
            if self.cut:
                rows, folders = rows.withColumn("period", period_of(F.col("ts"), self.cut)), ["part", "period"]
            if self.buckets:  # a large part, or period of one, is written by several tasks
                rows = rows.hint("rebalance", *folders).sortWithinPartitions(*folders, self.bucket_by)
            rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*folders).parquet(f"{self.folder}/{name}")
            written = [d.getPath().getName() for d in self.fs.listStatus(target) if d.isDirectory()]
            kept = {v: n for v, n in parts.items() if values is not None and v not in values}
            content = json.dumps({"parts": kept | {unquote(d.removeprefix("part=")): f"{name}/{d}" for d in written}, "notes": noted, "buckets": self.buckets}, sort_keys=True)
        self._point(name, content)
        used = {n.split("/")[0] for n in self.parts().values()}
        versions = sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(self.folder)) if x.isDirectory() and x.getPath().getName().startswith("v"))
        for old in versions[: -self.keep]:
            if old not in used:
                self.fs.delete(self._path(f"{self.folder}/{old}"), True)

    def _point(self, name: str, content: str) -> None:
        """Replace the pointer at once."""
        draft, pointer = self._path(f"{self.folder}/CURRENT.{name}"), self._path(f"{self.folder}/CURRENT")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(content.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(pointer), options)


class Store:
    """The ledger, the state of the sources and the acknowledgements not yet in the ledger, under one folder.

    The ledger's pointer notes the greatest id, the number of records and errors of each source, and the
    last batch of every stream that was put in, all as of its commit.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = LEDGER_BUCKETS, cut: str | None = None):
        self.spark, self.folder, self.acks = spark, folder.rstrip("/"), f"{folder.rstrip('/')}/acknowledged"
        self.records = Snapshots(spark, f"{self.folder}/usage_record", LEDGER, by="source", buckets=buckets, bucket_by="source_id", cut=cut)
        self.state = Snapshots(spark, f"{self.folder}/collector_state", STATE)
        self.sessions = Snapshots(spark, f"{self.folder}/session_env", SESSIONS)
        #: Held while a pointer is replaced: sources of one process may be put in side by side, as their parts differ.
        self.lock = threading.RLock()

    def put(self, batch: DataFrame, now: str, marker: tuple[str, int] | None = None, touch_unchanged: bool = True, keys: DataFrame | None = None) -> int:
        """Put a batch of unique keys into the ledger in one commit; how many keys are new.

        Only parts that the batch's keys belong to are read and written. The rows are joined once and stored
        beside the ledger, from where they are counted, numbered and committed. ``marker`` names a stream and
        its batch; a batch that has been put in before is left out. ``keys`` may have the same keys, told at less cost.
        """
        if self._applied(marker):
            return 0
        touched = self.records.touched(batch if keys is None else keys)
        staged, path = joined(self.records.read(touched), batch, now, touch_unchanged), self.records._path(f"{self.folder}/staged-{uuid.uuid4().hex}")
        try:
            staged.write.parquet(path.toString())
            rows = self.spark.read.schema(staged.schema).parquet(path.toString())
            added = changes(rows)
            new = sum(n for n, _ in added.values())
            with self.lock:
                if self._applied(marker):
                    return 0
                notes = self.records.notes()
                top, totals = self._top(notes), self._totals(notes)
                totals |= {s: [totals.get(s, [0, 0])[0] + n, totals.get(s, [0, 0])[1] + e] for s, (n, e) in added.items()}
                applied = notes.get("applied", {}) | ({marker[0]: marker[1]} if marker else {})
                self.records.commit(numbered(rows, top), touched, {"top": top + new, "totals": totals, "applied": applied})
        finally:
            self.records.fs.delete(path, True)
        return new

    def _applied(self, marker: tuple[str, int] | None) -> bool:
        return marker is not None and self.records.notes().get("applied", {}).get(marker[0], -1) >= marker[1]

    def remember(self, new: DataFrame, cursor: dict[str, int]) -> None:
        """Keep the last value of each session: those of ``new`` lines, read up to ``cursor``, before those known."""
        kept = self.sessions.read().join(new.select("session"), "session", "left_anti").unionByName(new.select("session", "base_url"))
        self.sessions.commit(kept, notes={"cursor": cursor})

    def _top(self, notes: dict) -> int:
        return notes["top"] if "top" in notes else self.records.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def _totals(self, notes: dict) -> dict[str, list[int]]:
        """Records and errors by source; a ledger that no ``put`` has noted them of is counted."""
        if "totals" in notes:
            return dict(notes["totals"])
        counted = self.records.read().groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"))
        return {r["source"]: [r["n"], r["errors"]] for r in counted.collect()}

    def totals(self) -> DataFrame:
        """Records, and errors among them, of each source, as the last commit left them; the ledger is not read."""
        return self.spark.createDataFrame([(s, n, e) for s, (n, e) in sorted(self._totals(self.records.notes()).items())], TOTALS)

    def acknowledge(self, keys: list[tuple[str, str]], now: str) -> None:
        """Note at once that records were sent; ``settle`` brings the notes into the ledger."""
        self.spark.createDataFrame([(*k, now) for k in keys], ACK).coalesce(1).write.mode("append").parquet(self.acks)

    def settle(self) -> int:
        """Mark what was acknowledged in the ledger, in one commit of the parts it is in; how many records."""
        path = self.records._path(self.acks)
        if not self.records.fs.exists(path):
            return 0
        noted = self.spark.read.schema(ACK).parquet(self.acks).groupBy(*KEY).agg(F.max("at").alias("at"))
        n = noted.count()
        if n:
            touched = self.records.touched(noted)
            self.records.commit(acknowledged(self.records.read(touched), noted), touched)
        self.records.fs.delete(path, True)
        return n
