"""Logs of JSON lines: a batch scan of whole files and a stream that follows files as they grow.

Spark's own file stream takes a file once. This one keeps a byte offset for each file, behind the
last line feed it has read, and so delivers appended lines, holds back an unfinished last line,
and starts a file anew when it has shrunk. Long stretches of a file are split over tasks, each of
which has the lines that begin in its range of bytes. Files may be on any file system that pyarrow
reads (bare paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

if TYPE_CHECKING:
    import pyarrow as pa

SCHEMA = "path string, offset long, value string, file long"
CHUNK = 4 << 20
#: Bytes of a file that one task reads at most.
SPLIT = 64 << 20
#: Tasks that stretches are dealt to if they are short, about, and the bytes that are too few for a task of their own.
TASKS, LEAST = 64, 256 << 10
#: Bytes that are read at first behind a stretch for the end of its last line.
REST = 4 << 10
#: Tasks that look for the ends of files' lines, at most.
JOB_TASKS = 1000


def place(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


class File(NamedTuple):
    path: str
    size: int
    changed: float


def files(patterns: str) -> list[File]:
    """The files of comma-separated patterns, by path. Beyond bare paths a pattern may vary in its last part only, and a folder is listed once."""
    found = {}
    for pattern in patterns.split(","):
        if "://" not in pattern:
            found |= {p: File(p, os.path.getsize(p), os.path.getmtime(p)) for p in glob.glob(pattern) if os.path.isfile(p)}
            continue
        from pyarrow import fs

        system, path = place(pattern)
        folder, _, name = path.rpartition("/")
        start = pattern[: len(pattern) - len(name)]
        infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found |= {(p := start + i.base_name): File(p, i.size, (i.mtime_ns or 0) / 1e9) for i in infos if i.is_file and fnmatch.fnmatch(i.base_name, name)}
    return [found[p] for p in sorted(found)]


def listed(patterns: str) -> list[str]:
    """The paths of ``files``."""
    return [f.path for f in files(patterns)]


def parse_cursor(cursor: str | None) -> dict[str, int]:
    """The offsets by file of a cursor; what is malformed counts as absent."""
    try:
        found = json.loads(cursor or "{}")
        return {k: int(v) for k, v in found.items()}
    except (ValueError, TypeError, AttributeError):
        return {}


def end_of_lines(path: str, start: int, stop: int | None = None) -> int:
    """The offset behind the last line feed from ``start`` to before ``stop`` or the end; ``start`` if there is none."""
    system, inner = place(path)
    with system.open_input_file(inner) as f:
        at = f.size() if stop is None else min(stop, f.size())
        while at > start:
            low = max(start, at - CHUNK)
            k = f.read_at(at - low, low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return start


def end_of_line(path: str, start: int) -> int:
    """The offset behind the first line feed from ``start`` on; -1 if there is none."""
    system, inner = place(path)
    with system.open_input_file(inner) as f:
        for at in range(start, f.size(), CHUNK):
            k = f.read_at(min(CHUNK, f.size() - at), at).find(b"\n")
            if k >= 0:
                return at + k + 1
    return -1


class Backlog(NamedTuple):
    """What of a file may be read next: from ``start`` to ``stop``; ``whole`` if that is its end, ``long`` if a line may go on behind it."""

    path: str
    start: int
    stop: int
    whole: bool
    long: bool = False


def admitted(found: list[File], known: dict[str, int], most: int | None = None) -> list[Backlog]:
    """What may be read of each file, ``most`` bytes in all, files that changed longest ago first; a file that shrank starts anew."""
    out, left = [], most
    for f in sorted(found, key=lambda f: (f.changed, f.path)):
        start = known.get(f.path, 0) if f.size >= known.get(f.path, 0) else 0
        stop = f.size if left is None else min(f.size, start + left)
        if left is not None:
            left -= stop - start
        out.append(Backlog(f.path, start, stop, stop == f.size))
    return out


def settled(backlog: Backlog) -> int:
    """The offset behind the whole lines of a backlog."""
    at = end_of_lines(backlog.path, backlog.start, None if backlog.whole else backlog.stop)
    return max(at, end_of_line(backlog.path, backlog.stop)) if backlog.long and at == backlog.start else at


def on_threads(some: list[Backlog]) -> dict[str, int]:
    """Where whole lines end, looked up side by side on the driver: for streams, whose sources have no session."""
    with ThreadPoolExecutor(16) as pool:
        return dict(zip([b.path for b in some], pool.map(settled, some), strict=True))


def by_job(spark: SparkSession) -> Callable[[list[Backlog]], dict[str, int]]:
    """The same by a job, so that tasks open the files."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = [Backlog(*r.values()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([settled(b) for b in rows], pa.int64())], ["path", "at"])

    def run(some: list[Backlog]) -> dict[str, int]:
        if not some:
            return {}
        rows = spark.createDataFrame(some, "path string, start long, stop long, whole boolean, long boolean").repartition(min(len(some), JOB_TASKS), "path")
        return {r["path"]: r["at"] for r in rows.mapInArrow(found, "path string, at long").collect()}  # offsets of the files, as the cursor holds them

    return run


Ends = Callable[[list[Backlog]], dict[str, int]]


def step(found: list[File], known: dict[str, int], most: int | None = None, ends: Ends = on_threads) -> tuple[dict[str, int], bool]:
    """Offsets up to which whole lines can be read now, ``most`` bytes further in all at most (and the rest of a line), and whether files go on behind them."""
    some = admitted(found, known, most)
    at = known | {b.path: b.start for b in some} | ends([b for b in some if b.stop > b.start])
    moved, cut = any(at[b.path] > b.start for b in some), [b for b in some if not b.whole]
    if cut and not moved:  # one line is longer than what was admitted: it is read whole
        at |= ends([cut[0]._replace(long=True)])
        moved = at[cut[0].path] > cut[0].start
    return at, bool(cut) and moved


def advanced(patterns: str, known: dict[str, int], most: int | None = None, ends: Ends = on_threads) -> dict[str, int]:
    return step(files(patterns), known, most, ends)[0]


class Stretch(InputPartition):
    """The lines of a file that begin from ``start`` to before ``stop``; ``inner`` if a line may lie across its start, ``file`` its place among all."""

    def __init__(self, path: str, start: int, stop: int, inner: bool = False, file: int = 0):
        self.path, self.start, self.stop, self.inner, self.file = path, start, stop, inner, file


def stretches(begin: dict[str, int], end: dict[str, int], split: int = SPLIT) -> list[Stretch]:
    """What to read between two sets of offsets; a file whose offset fell is read from its start."""
    out = []
    for k, (path, stop) in enumerate(sorted(end.items())):
        start = begin.get(path, 0)
        if stop < start:
            start = 0
        out += [Stretch(path, at, min(stop, at + split), at > start, k) for at in range(start, stop, split)]
    return out


class Load(InputPartition):
    """Stretches that one task reads."""

    def __init__(self, some: list[Stretch]):
        self.some = some


def loads(some: list[Stretch]) -> list[Load]:
    """Stretches dealt to tasks in their order. Short ones share a task, so that tasks grow with the bytes and not with the number of files or ranges."""
    most = min(SPLIT, max(LEAST, sum(s.stop - s.start for s in some) // TASKS))
    out, left = [], 0
    for s in some:
        size = s.stop - s.start
        if size > left:
            out.append(Load([]))
            left = most
        out[-1].some.append(s)
        left -= size
    return out


def read(load: Load) -> Iterator[pa.RecordBatch]:
    """The lines of a task's stretches; those of one file follow each other and share its handle."""
    for path, some in groupby(load.some, lambda s: s.path):
        system, inner = place(path)
        with system.open_input_file(inner) as f:
            for part in some:
                yield from lines_of(f, part)


def lines(part: Stretch) -> Iterator[pa.RecordBatch]:
    return read(Load([part]))


def lines_of(f: pa.NativeFile, part: Stretch) -> Iterator[pa.RecordBatch]:
    """The lines of a stretch but for empty ones, in batches. Of what lies behind the stretch no more is read than its last line may need."""
    at, held, size, whole = part.start - part.inner, [], 0, not part.inner  # a line that began before belongs to the stretch before
    rest = REST
    while at < part.stop:
        behind = at + size
        f.seek(behind)
        data = f.read(min(CHUNK, part.stop - behind if behind < part.stop else rest))
        # behind the stretch only the line that began in it goes on
        cut = (data.rfind(b"\n") if behind < part.stop else data.find(b"\n")) + 1
        if data and not cut:
            held.append(data)
            size += len(data)
            rest = min(CHUNK, 2 * rest) if behind >= part.stop else rest
            continue
        text = b"".join([*held, data[:cut]])
        yield _batch(part, at, text, whole)
        at, held, size, whole = at + len(text), [data[cut:]], len(data) - cut, True
        if not data:
            break


def _batch(part: Stretch, at: int, text: bytes, whole: bool) -> pa.RecordBatch:
    """Lines that begin at an offset; the first one only if it is ``whole``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = np.frombuffer(text, np.uint8)
    feeds = np.flatnonzero(raw == 10)
    stops = feeds if text.endswith(b"\n") else np.append(feeds, len(raw))
    starts = np.append(0, feeds + 1)[: len(stops)]
    places = np.append(starts - np.arange(len(starts)), len(raw) - len(feeds)).astype(np.int32)  # without the line feeds
    values = pa.StringArray.from_buffers(len(stops), pa.py_buffer(places), pa.py_buffer(raw[raw != 10]))
    try:
        values.validate(full=True)
    except pa.ArrowInvalid:
        values = pa.array([text[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.string())
    if b"\r" in text:
        values = pc.utf8_rtrim(values, "\r")
    kept = pc.greater(pc.binary_length(values), 0)
    if not whole:
        kept = pc.and_(kept, pa.array(np.arange(len(stops)) > 0))
    values, offsets = values.filter(kept), pa.array(at + starts, pa.int64()).filter(kept)
    return pa.RecordBatch.from_arrays([pa.repeat(part.path, len(values)), offsets, values, pa.repeat(pa.scalar(part.file, pa.int64()), len(values))], ["path", "offset", "value", "file"])


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.patterns, self.begin = options["path"], parse_cursor(options.get("cursor"))
        self.most = int(options["most"]) if options.get("most") else None
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return dict(self.begin)

    def latestOffset(self) -> dict:
        self.at = advanced(self.patterns, self.at if self.at is not None else self.begin, self.most)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Load]:
        if self.at is None:  # a restart goes on behind what the checkpoint has
            self.at = dict(end)
        return loads(stretches(start, end))

    def read(self, partition: Load) -> Iterator[pa.RecordBatch]:
        return read(partition)

    def commit(self, end: dict) -> None:
        pass


class LinesReader(DataSourceReader):
    """Reads from the offsets of a cursor to the last line feed of each file, once."""

    def __init__(self, options: dict):
        begin = parse_cursor(options.get("cursor"))
        end = parse_cursor(options["end"]) if "end" in options else advanced(options["path"], begin)
        self.parts = loads(stretches(begin, end, int(options.get("split", SPLIT))))

    def partitions(self) -> list[Load]:
        return self.parts or [Load([])]

    def read(self, partition: Load) -> Iterator[pa.RecordBatch]:
        return read(partition)


class GrowingLines(DataSource):
    """``format("growing_lines")`` with ``path`` (patterns), and optionally ``cursor``, ``end``, ``split`` and, for streams, ``most`` bytes of a batch."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return LinesReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TailReader(self.options)


def scan(spark: SparkSession, patterns: str, cursor: dict[str, int] | None = None, end: dict[str, int] | None = None, split: int = SPLIT) -> DataFrame:
    """The whole lines of files behind a cursor: path, offset, value."""
    spark.dataSource.register(GrowingLines)
    reader = spark.read.format("growing_lines").option("path", patterns).option("cursor", json.dumps(cursor or {})).option("split", split)
    return (reader.option("end", json.dumps(end)) if end is not None else reader).load()


def tail(spark: SparkSession, patterns: str, cursor: dict[str, int] | None = None, most: int | None = None) -> DataFrame:
    """The same as a stream, whose batches have at most ``most`` bytes (and the rest of a line)."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", patterns).option("cursor", json.dumps(cursor or {})).option("most", most or "").load()


def judged(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines as struct ``j`` beside path, offset, value and file, and whether they are blank or broken, that is no JSON object.

    A field of another type only makes that field null. A line is parsed once: it goes through ``explode``, past which
    Spark moves no filter, as each field that a filter names would be parsed for anew. The second parser, which
    is stricter with numbers that are none, is asked only about lines that the first had trouble with.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = rows.select(*rows.columns, F.explode(F.array(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))).alias("j"))
    blank = F.length(F.trim("value")) == 0
    plain = F.startswith("value", F.lit("{")) & F.col("j").isNotNull() & F.col("j._corrupt").isNull() & ~(F.contains("value", F.lit("NaN")) | F.contains("value", F.lit("INF")) | F.contains("value", F.lit("Infinity")))
    whole = F.when(plain, True).otherwise(F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False)))
    return read.withColumns({"blank": blank, "broken": ~blank & ~whole})


def parsed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines that are JSON objects, as struct ``j`` beside path, offset, value and file."""
    return judged(rows, schema).where("not blank and not broken").drop("blank", "broken")


def observed(rows: DataFrame, schema: T.StructType, seen: Observation | None, **kinds: Column) -> DataFrame:
    """The same, while ``seen`` counts lines, blank and broken ones, and those of each kind, in the pass that reads them."""
    told = judged(rows, schema)
    if seen is not None:
        whole = ~F.col("blank") & ~F.col("broken")
        counts = {"blank": F.col("blank"), "broken": F.col("broken")} | {k: whole & F.coalesce(c, F.lit(False)) for k, c in kinds.items()}
        told = told.observe(seen, F.count("*").alias("lines"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return told.where("not blank and not broken").drop("blank", "broken")
