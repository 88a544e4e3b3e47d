"""Attribution of requests to the narrowest work window that encloses their time, by a plane sweep.

Which window is the narrowest is a step function of time. Time is cut into cells of an hour; in each a
sweep over the windows in order of their start, with a heap of those that are open, yields disjoint
segments, each with its narrowest window. Requests then find one segment: both are sorted by time within
their cell and merged. However many windows enclose a request, it is one row throughout, and it is
shuffled once.

A window matters to the sweep of a cell if it begins or ends there. Of the windows that lie over the
whole of a cell only the narrowest does; so long windows are noted at the nodes of a binary tree over
the cells, at most two a level, and a cell looks at its own node and those above it. Only cells
that requests fall into are swept. A cell with very many requests is dealt in parts, each with a copy
of the cell's segments.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_MS = 3_600_000
#: Levels of the tree over cells: enough for any time that a long can hold.
LEVELS = 42
#: Requests of a cell that one task takes at most, and parts of those without a time.
PART_ROWS, TIMELESS_PARTS = 1_000_000, 512


def attributed(rows: DataFrame, windows: DataFrame, millis: str) -> DataFrame:
    """``rows`` with tool and window_project of their narrowest window, null without one.

    ``windows`` has tool, project, start_ms, end_ms and seq; of equally narrow ones the first by
    seq is taken. Both bounds belong to a window; turned ones are none. Rows without a time stay.
    """
    placed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("_row"), rows[millis].cast("long").alias("_at")).withColumn("_cell", _cell("_at"))
    cells = placed.where("_cell is not null").groupBy("_cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    steps = segments(windows, cells)
    hot = cells.where("_parts > 1").withColumnRenamed("_parts", "_of")  # no more than one for PART_ROWS requests
    parts = F.when(F.col("_cell").isNull(), F.lit(TIMELESS_PARTS)).otherwise(F.col("_of"))
    dealt = placed.join(F.broadcast(hot), "_cell", "left").withColumn("_part", F.when(parts > 1, F.pmod(F.xxhash64("_row"), parts)).otherwise(0).cast("long"))
    copies = steps.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    both = dealt.select("_cell", "_part", "_at", F.lit(1).alias("_kind"), "_row").unionByName(copies.select("_cell", "_part", "_at", F.lit(0).alias("_kind"), "_step"), allowMissingColumns=True)
    in_order = Window.partitionBy("_cell", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_step", ignorenulls=True).over(in_order)).where("_kind = 1")
    return found.select("_row.*", F.col("_found.tool").alias("tool"), F.col("_found.project").alias("window_project"))


def segments(windows: DataFrame, cells: DataFrame) -> DataFrame:
    """The steps of ``cells`` (_cell, _parts): from when on which window is the narrowest, a struct of nulls where none is."""
    given = windows.where("start_ms <= end_ms").select("tool", "project", F.col("start_ms").cast("long").alias("lo"), F.col("end_ms").cast("long").alias("hi"), "seq")
    ranked = given.withColumns({"width": F.col("hi") - F.col("lo"), "first": _cell("lo"), "last": _cell("hi")})
    window = F.struct("width", "seq", "tool", "project", "lo", "hi").alias("window")
    inside = ranked.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("_cell"), window).join(cells, "_cell")
    over = ranked.select(F.inline(_nodes(F.col("first") + 1, F.col("last"))), window).groupBy("level", "node").agg(F.min("window").alias("window"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")
    above = cells.select("_cell", "_parts", levels).withColumn("node", F.call_function("shiftright", "_cell", "level"))
    across = above.join(over, ["level", "node"]).groupBy("_cell", "_parts").agg(F.min("window").alias("window"))
    begin = F.greatest(F.col("window.lo"), F.col("_cell") * CELL_MS).alias("begin")
    pieces = inside.unionByName(across).select("_cell", "_parts", begin, "window.*")
    tool = "_step struct<tool:string,project:string>"
    # dealt by a hash of its own: Spark would take both sides as dealt by cell already, which no longer holds once it turns a side's join into a broadcast
    dealt = pieces.repartition(F.xxhash64("_cell")).sortWithinPartitions("_cell", "begin")
    return dealt.mapInArrow(_swept, f"_cell long, _parts long, _at long, {tool}")


def _cell(column: str) -> Column:
    return F.floor(F.col(column) / CELL_MS).cast("long")


def _nodes(first: Column, stop: Column) -> Column:
    """The nodes of the tree that together are the cells from ``first`` to before ``stop``."""
    down = lambda x, level: F.call_function("shiftright", x, level)

    def at(level: Column) -> Column:
        low, high = -down(-first, level), down(stop, level)
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), low)
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), high - 1)
        return F.array(F.struct(level.alias("level"), left.alias("node")), F.struct(level.alias("level"), right.alias("node")))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))
    return F.filter(every, lambda n: n["node"].isNotNull())


class Sweep:
    """The segments of one cell, from its windows in order of their begin."""

    def __init__(self) -> None:
        self.open: list[tuple] = []
        self.now: int | None = None
        self.winner: object = None
        self.steps: list[tuple[int, str | None, str | None]] = []

    def push(self, begin: int, width: int, seq: object, tool: str | None, project: str | None, hi: int) -> None:
        self.advance(begin)
        self.now = begin
        heapq.heappush(self.open, (width, seq is not None, seq, len(self.steps), hi, (tool, project, object())))

    def advance(self, to: int | None) -> None:
        """Tell the segments from now to before ``to``, or to the end of all open windows."""
        while self.open and (to is None or self.now < to):
            *_, hi, window = self.open[0]
            if hi < self.now:
                heapq.heappop(self.open)
                continue
            self._step(window)
            self.now = hi + 1 if to is None else min(hi + 1, to)
        if self.now is not None and (to is None or self.now < to):
            self._step((None, None, None))

    def _step(self, window: tuple) -> None:
        if window is not self.winner:
            self.steps.append((self.now, *window[:2]))
            self.winner = window


def _swept(batches: Iterator) -> Iterator:
    import pyarrow as pa

    now, sweep, out = None, Sweep(), []

    def told() -> None:
        sweep.advance(None)
        out.extend((*now, *s) for s in sweep.steps)

    def batch_of() -> pa.RecordBatch:
        cell, parts, at, tool, project = zip(*out, strict=True) if out else ((),) * 5
        step = pa.StructArray.from_arrays([pa.array(tool, pa.string()), pa.array(project, pa.string())], ["tool", "project"])
        made = pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(parts, pa.int64()), pa.array(at, pa.int64()), step], ["_cell", "_parts", "_at", "_step"])
        out.clear()
        return made

    for batch in batches:
        for cell, parts, begin, width, seq, tool, project, _, hi in zip(*[batch.column(k).to_pylist() for k in range(9)], strict=True):
            if (cell, parts) != now:
                if now is not None:
                    told()
                now, sweep = (cell, parts), Sweep()
            sweep.push(begin, width, seq, tool, project, hi)
        if len(out) > 10_000:
            yield batch_of()
    if now is not None:
        told()
    yield batch_of()
