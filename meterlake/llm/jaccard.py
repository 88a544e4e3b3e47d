"""Exact Jaccard join of documents on word shingles, as classes of linked documents.

Equal sets are found by a 128-bit signature first, and only one of them goes on. Tokens are ordered
by their hash but for the frequent ones, which come last, rarest first. Two linked sets share at least
``margin(n)`` tokens of their extended prefixes, so a set that shares fewer of its own with any
others is done; the rest meet in index lists, whose entries have the set's size and the token's
position in it. A list is read in blocks with bounds of both, and blocks that these rule out are
skipped: a link needs sizes in proportion, and a common token can't stand further apart in two
sets than they have other tokens. A pair is a candidate if it shares enough tokens over all short
lists. Sets with as many tokens in long lists meet again among themselves, where a long list ties
blocks that may be linked instead. Lists of very frequent tokens are split over tasks, whose runs of
tied blocks are tied in turn.

What is so tied is a group. Its sets are compared exactly in pairs of blocks of bounded size, and
only such as lie in the same or neighbouring bands of set size. There a set's overlaps with all
others are derived from those of the most similar set already answered, by the postings of the few
tokens that the two do not share.

Frequent tokens only decide the order and the splits, from per-task counts over all documents; any
order is exact. 64-bit hashes stand for shingles.

Defined results: null and wordless texts are empty sets, linked with nothing; fewer words than a
shingle are one shingle; repeated rows are copies and linked; equal doc_ids with different texts
are judged apart; a null doc_id is never a component_id unless its whole component has no other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import chosen_rows, lookup, slices, stored
from meterlake.llm.graph import components

SHINGLE = 3
PERCENT = 90
#: Tokens in one block of sets, for small and for large groups; a task compares two blocks at a time.
BLOCK_TOKENS, LARGE_BLOCK_TOKENS = 40_000, 1_000_000
#: Entries in a block of an index list, and documents of a token above which its list is split over tasks.
LIST_BLOCK, SPLIT = 32, 128
#: Sets in an index list whose pairs are counted; a longer one is a long list.
SHORT = 16
TIED = 1 << 40
#: Tokens counted together by a task, how often one must occur among them to be frequent, and how many can be.
COUNTED, FREQUENT, MOST_FREQUENT = 2_000_000, 6, 100_000


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles, A-Z in lower case."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    x = np.zeros(max(1, n - width + 1), np.uint64)
    for k in range(min(width, n)):
        x = (x + h[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    if n < width:
        x += np.uint64(n)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return np.unique(x)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """The signed halves of a set's 128-bit name: its node, and what tells nodes apart that are equal by chance."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(tokens.tobytes(), seed=len(tokens)))


def _least_overlap(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes are linked."""
    return -(-(sizes + size) * percent // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def margin(n: int) -> int:
    """Tokens of the extended prefixes that two linked sets share at least, by the smaller's size."""
    return n // 20 + 1


def extended_length(n: int, percent: int) -> int:
    return prefix_length(n, percent) + margin(n) - 1


def apart(size: int, percent: int) -> int:
    """How far apart a token can stand in two linked sets, the larger of which has this size."""
    return size * (100 - percent) // 100


class Order:
    """Frequent tokens and their ranks; a smaller rank is rarer. Lists of the most frequent are split."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by_token = np.argsort(tokens)
        self.tokens = tokens[by_token]
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
        self.rank = rank[by_token]
        self.splits = np.maximum(1, -(-counts[by_token] // SPLIT))

    def split(self, tokens: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The part of a split list that each entry goes to; -1 where the list is whole."""
        if not len(self.tokens):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        n = np.where(self.tokens[at] == tokens, self.splits[at], 1)
        return np.where(n > 1, (nodes.view(np.uint64) >> np.uint64(7)).astype(np.int64) % n, -1)

    def prefix(self, tokens: np.ndarray, length: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:length]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        frequent = self.tokens[at] == tokens
        rare = tokens[~frequent][:length]
        if len(rare) == length:
            return rare
        ranks = self.rank[at[frequent]]
        return np.concatenate([rare, tokens[frequent][np.argsort(ranks)][: length - len(rare)]])


def frequent_tokens(docs: DataFrame, width: int) -> Order:
    """The tokens that occur most, by counts that tasks make of all their documents."""
    import pyarrow as pa

    def some(batches: Iterator) -> Iterator:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"])

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append(shingles(text, width))
                n += len(held[-1])
                if n >= COUNTED:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(some, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    return Order(top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy())


def _described(batches: Iterator, order: Order, width: int, percent: int) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        nodes, checks, sizes, prefixes = [], [], [], []
        for text in batch.column(1).to_pylist():
            tokens = shingles(text, width)
            node, check = signature(tokens) if len(tokens) else (None, None)
            nodes.append(node)
            checks.append(check)
            sizes.append(len(tokens))
            prefixes.append(order.prefix(tokens, extended_length(len(tokens), percent)).tobytes() if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary())], ["doc_id", "node", "check", "size", "prefix"])


def _listed(batches: Iterator, order: Order) -> Iterator:
    """The index entries of sets: token, part of its list, size, position, node."""
    import pyarrow as pa

    for batch in slices(batches, 2000):
        tokens = [np.frombuffer(p, np.int64) for p in batch.column(2).to_pylist()]
        if tokens:
            counts = np.array([len(t) for t in tokens])
            every, node = np.concatenate(tokens), np.repeat(batch.column(0).to_numpy(), counts)
            position = np.arange(len(every)) - np.repeat(np.cumsum(counts) - counts, counts)
            part, size = order.split(every.view(np.uint64), node), np.repeat(batch.column(1).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(part), pa.array(size), pa.array(position), pa.array(node)], ["token", "part", "size", "position", "node"])


def index_lists(nodes: DataFrame, order, *by: str) -> DataFrame:
    """Index entries, lists in the given order; ``order`` is a broadcast ``Order``."""
    entries = nodes.select("node", "size", "prefix").mapInArrow(lambda b: _listed(b, order.value), "token long, part long, size long, position long, node long")
    return entries.select("token", "part", *by).repartition("token", "part").sortWithinPartitions("token", "part", *by)


def _shared(batches: Iterator) -> Iterator:
    """How many of its tokens each node shares with others, over rows ordered by token; split lists are shared."""
    import pyarrow as pa

    last_token, last_node, counted = None, None, True
    for batch in batches:
        token, part, node = (batch.column(k).to_numpy() for k in range(3))
        if not len(token):
            continue
        shared = part >= 0
        same = (token[1:] == token[:-1]) & (part[1:] == part[:-1])
        shared[1:] |= same
        shared[:-1] |= same
        found = []
        if last_token is not None and (token[0], part[0]) == last_token:
            shared[0] = True
            if not counted:
                found = [last_node]
        last_token, last_node, counted = (token[-1], part[-1]), node[-1], bool(shared[-1])
        nodes, n = np.unique(np.concatenate([node[shared], np.array(found, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n.astype(np.int64))], ["node", "n"])


def sharing(nodes: DataFrame, order, percent: int) -> DataFrame:
    """The nodes that share enough of their extended prefix to have any link."""
    counts = index_lists(nodes, order, "node").mapInArrow(_shared, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    least = F.floor(F.ceil(F.col("size") * percent / 100) / 20) + 1
    return nodes.join(counts, "node").where(F.col("n") >= least).drop("n")


class Run:
    """Sets of a list that are tied to the first, with the least and greatest of their sizes and positions."""

    def __init__(self, first: int, low: int, high: int, near: int, far: int):
        self.first, self.low, self.high, self.near, self.far = first, low, high, near, far


def tied_runs(blocks: Iterator[Run], percent: int, tie) -> Iterator[Run]:
    """Runs of blocks given by ascending ``low``; blocks that no member of a run can be linked with are skipped."""
    open_: list[Run] = []
    for block in blocks:
        run, rest = block, []
        for other in open_:
            reach = apart(max(block.high, other.high), percent)
            if other.high * 100 < block.low * percent:  # nor can any block that follows
                yield other
            elif block.near - other.far > reach or other.near - block.far > reach:
                rest.append(other)
            else:
                tie(other.first, run.first)
                run = Run(other.first, min(other.low, run.low), max(other.high, run.high), min(other.near, run.near), max(other.far, run.far))
        open_ = [*rest, run]
    yield from open_


def short_pairs(entries: list[tuple[int, int, int]], percent: int) -> Iterator[tuple[int, int, int]]:
    """Pairs of entries (size, position, node) by ascending size that may be linked: node, node and the smaller size.

    Blocks whose sizes or positions rule it out are skipped whole.
    """
    step = 4
    bounds = [(entries[k][0], min(e[1] for e in entries[k : k + step]), max(e[1] for e in entries[k : k + step])) for k in range(0, len(entries), step)]
    for k, (n, at, v) in enumerate(entries):
        reach = apart(n, percent)
        for b, (_, near, far) in enumerate(bounds[: k // step + 1]):
            last = entries[min(b * step + step, k) - 1][0] if b * step < k else 0
            if last * 100 < n * percent or near - at > reach or at - far > reach:
                continue
            for m, other, u in entries[b * step : min(b * step + step, k)]:
                if m * 100 >= n * percent and min(at, other) + min(n - at, m - other) >= -(-(n + m) * percent // (100 + percent)):
                    yield u, v, m


def _candidates(batches: Iterator, percent: int, tie: bool) -> Iterator:
    """Pairs by index list: how many tokens of short lists they share.

    In a long list blocks are tied where links are possible, or else, with no partner, sets are only
    told how many of their tokens are in long lists. Of split lists the runs are given too, with the
    token: a is the first of the run, b null, and n below 0.
    """
    import pyarrow as pa

    found: dict[tuple[int, int | None, int], int] = {}
    runs: list[tuple] = []
    names = ["a", "b", "size", "n", "token", "high", "near", "far"]

    def out() -> pa.RecordBatch:
        a, b, size = zip(*found, strict=True) if found else ((), (), ())
        columns = [pa.array([*x, *y], pa.int64()) for x, y in zip((a, b, size, found.values()), zip(*[(r[0], None, r[1], -1) for r in runs], strict=True) if runs else ((),) * 4, strict=True)]
        columns += [pa.array([*[None] * len(found), *y], pa.int64()) for y in (zip(*[r[2:] for r in runs], strict=True) if runs else ((),) * 4)]
        rows = pa.RecordBatch.from_arrays(columns, names)
        found.clear()
        runs.clear()
        return rows

    def linked(u: int, v: int) -> None:
        found[u, v, 0] = TIED

    def listed(token: int, part: int, entries: np.ndarray) -> None:
        if part < 0 and len(entries) <= SHORT:
            for u, v, m in short_pairs(list(map(tuple, entries.tolist())), percent):
                found[u, v, m] = found.get((u, v, m), 0) + 1
        elif not tie:
            for v in entries[:, 2].tolist():
                found[v, None, 0] = found.get((v, None, 0), 0) + 1
        else:
            made = tied_runs(blocks_of(entries, linked), percent, linked)
            runs.extend((x.first, x.low, token, x.high, x.near, x.far) for x in made if part >= 0)

    for token, part, entries in whole_lists(batches):
        listed(token, part, entries)
        if len(found) + len(runs) > 200_000:
            yield out()
    yield out()


def blocks_of(entries: np.ndarray, tie) -> Iterator[Run]:
    """Blocks of entries (size, position, node) by size and position, each tied to its first."""
    for at in range(0, len(entries), LIST_BLOCK):
        some = entries[at : at + LIST_BLOCK]
        first = int(some[0, 2])
        for v in some[1:, 2].tolist():
            tie(first, v)
        yield Run(first, int(some[0, 0]), int(some[-1, 0]), int(some[:, 1].min()), int(some[:, 1].max()))


def whole_lists(batches: Iterator) -> Iterator[tuple[int, int, np.ndarray]]:
    """Lists of two entries or more, or split ones: token, part and rows of size, position and node, from rows in that order."""
    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy() for k in range(5)], axis=1)
        if not len(rows):
            continue
        cuts = [0, *((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)).nonzero()[0] + 1, len(rows)]
        lengths = np.diff(cuts)
        if held and (held[-1][-1, :2] != rows[0, :2]).any():
            yield from _listable(np.concatenate(held))
            held = []
        if len(cuts) == 2:
            held.append(rows)
            continue
        if held:
            yield from _listable(np.concatenate([*held, rows[: cuts[1]]]))
        inner = (lengths[:-1] > 1) | (rows[np.array(cuts[:-2], np.int64), 1] >= 0)
        inner[0] &= not held
        for k in inner.nonzero()[0].tolist():
            yield from _listable(rows[cuts[k] : cuts[k + 1]])
        held = [rows[cuts[-2] :]]
    if held:
        yield from _listable(np.concatenate(held))


def _listable(rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    if len(rows) > 1 or rows[0, 1] >= 0:
        yield int(rows[0, 0]), int(rows[0, 1]), rows[:, 2:]


def _tied_again(batches: Iterator, percent: int) -> Iterator:
    """Ties between the runs of split lists, from rows (token, low, high, near, far, first) in order."""
    import pyarrow as pa

    now, held = None, []

    def out() -> pa.RecordBatch:
        pairs: set[tuple[int, int]] = set()
        for _ in tied_runs((Run(first, *bounds) for *bounds, first in held), percent, lambda u, v: pairs.add((u, v))):
            pass
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for token, *run in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
            if token != now and held:
                yield out()
                held = []
            now = token
            held.append(run)
    if held:
        yield out()


def _pairs(nodes: DataFrame, order, percent: int, tie: bool) -> DataFrame:
    schema = "a long, b long, size long, n long, token long, high long, near long, far long"
    return index_lists(nodes, order, "size", "position", "node").mapInArrow(lambda b: _candidates(b, percent, tie), schema)


def summed(pairs: DataFrame) -> DataFrame:
    return pairs.where("token is null").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def candidates(nodes: DataFrame, order, percent: int) -> DataFrame:
    """Edges (a, b) such that any linked pair is connected by them.

    A pair that shares ``margin`` tokens in all shares so many less those of either set in long
    lists in the short ones. Only if both have that many in long lists may they share no other;
    such sets meet again among themselves, where long lists tie them.
    """
    least = F.floor(F.col("size") / 20) + 1
    counted = stored(summed(_pairs(nodes, order, percent, False)), "pairs")
    in_long = counted.where("b is null").select(F.col("a").alias("node"), F.col("n").alias("long"))
    pairs = counted.where("b is not null")
    for side in ("a", "b"):
        pairs = pairs.join(in_long.select(F.col("node").alias(side), F.col("long").alias(f"long_{side}")), side, "left")
    spared = F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0)))
    near = pairs.where((spared < least) & (F.col("n") >= least - spared)).select("a", "b")
    heavy = nodes.join(in_long, "node").where(F.col("long") >= F.floor(F.ceil(F.col("size") * percent / 100) / 20) + 1).drop("long")
    lists = stored(_pairs(stored(heavy, "heavy"), order, percent, True), "ties")
    tied = summed(lists).where(F.col("n") >= least).select("a", "b")
    runs = lists.where("token is not null").select("token", F.col("size").alias("low"), "high", "near", "far", F.col("a").alias("first"))
    again = runs.repartition("token").sortWithinPartitions("token", "low", "first").mapInArrow(lambda b: _tied_again(b, percent), "a long, b long")
    return near.unionByName(tied).unionByName(again).where("a <> b").distinct()


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set its overlaps with all, derived where it pays from those of a similar set.

    Sets are answered in an order that keeps similar ones together; the last answers are kept.
    """
    sizes = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_token = np.argsort(inverse, kind="stable")
    holders, starts = owner[by_token], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(tokens)))])
    ids = np.split(inverse, np.cumsum(sizes)[:-1])

    def summed(some: np.ndarray) -> np.ndarray:
        lengths = starts[some + 1] - starts[some]
        at = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(holders[at], minlength=len(sets))

    answered: dict[int, np.ndarray] = {}
    for i in range(len(sets)):
        near = -1
        if answered:
            known = np.fromiter(answered, np.int64, len(answered))
            shared = np.array([answered[k][i] for k in known])
            near = int(known[np.argmax(shared)])
        if near >= 0 and 4 * answered[near][i] > 3 * sizes[i]:
            gone = np.setdiff1d(ids[near], ids[i], assume_unique=True)
            come = np.setdiff1d(ids[i], ids[near], assume_unique=True)
            answer = answered[near] + (summed(come) if len(come) else 0) - (summed(gone) if len(gone) else 0)
        else:
            answer = summed(ids[i])
            if len(answered) >= 16:
                answered.pop(next(iter(answered)))
            answered[i] = answer
        yield i, answer


def _compared(nodes: list[int], halves: list[int], copies: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int, int]]:
    """For each set its links (copies counted) and the first set of its class here.

    With two halves, only sets of different halves are compared.
    """
    n = len(nodes)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes, weight, half = np.array([len(s) for s in sets]), np.array(copies), np.array(halves)
    cross, links = len(set(halves)) > 1, [0] * n
    for i, overlap in _overlaps(sets):
        linked = overlap >= _least_overlap(sizes, int(sizes[i]), percent)
        linked[i] = False
        if cross:
            linked &= half != half[i]
        partners = linked.nonzero()[0]
        links[i] = int(weight[partners].sum())
        for j in partners[partners < i].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(nodes[i], nodes[find(i)], links[i]) for i in range(n)]


def _joined(batches: Iterator, percent: int) -> Iterator:
    """Rows ordered by block pair: compares each pair's sets once they are all there."""
    import pyarrow as pa

    key, held = None, {}

    def out() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        rows = sorted(held.items(), key=lambda x: (len(x[1][2]), x[0]))
        if len({h for _, (h, _, _) in rows}) == 1 and key[1] != key[2]:
            return None
        found = _compared([k for k, _ in rows], [h for _, (h, _, _) in rows], [c for _, (_, c, _) in rows], [s for _, (_, _, s) in rows], percent)
        found = [f for f in found if f[2]]
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "links"])

    for batch in batches:
        for group, low, high, node, half, copies, tokens in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if (group, low, high) != key:
                if key is not None and (result := out()) is not None:
                    yield result
                key, held = (group, low, high), {}
            held[node] = (half, copies, np.frombuffer(tokens, np.uint64))
    if key is not None and (result := out()) is not None:
        yield result


def _sets(batches: Iterator, width: int) -> Iterator:
    """Recomputes the sets of candidates and drops rows of another text with the same doc_id."""
    import pyarrow as pa

    for batch in slices(batches):
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        rows = []
        for *given, check, text in zip(*columns, strict=True):
            tokens = shingles(text, width)
            if len(tokens) and signature(tokens)[1] == check:
                rows.append((*given, tokens.tobytes()))
        if rows:
            types = (*[batch.column(k).type for k in range(batch.num_columns - 2)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*batch.schema.names[:-2], "tokens"])


def size_band(size, percent: int):
    """Bands of set size such that linked sets are in the same or neighbouring ones."""
    return F.floor(F.log(size) / (math.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else size.cast("long")


def block_pairs(docs: DataFrame, nodes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Every candidate set once for each pair of blocks that it is compared in: label, low, high, node, half, copies, tokens.

    A group's blocks lie in bands of set size; a block meets those of its own band and of the neighbouring ones.
    """
    members = groups.unionByName(groups.select(F.col("label").alias("node"), "label").distinct())
    chosen = stored(members.join(nodes.select("node", "check", "first", "copies", "size"), "node").withColumn("band", size_band(F.col("size"), percent)), "members")
    blocks = chosen.groupBy("label", "band").agg(F.count("*").alias("weight"), F.sum("size").alias("tokens"))
    tokens = F.col("tokens")
    blocks = blocks.withColumn("blocks", F.ceil(tokens / F.least(F.greatest(tokens / 16, F.lit(BLOCK_TOKENS)), F.lit(LARGE_BLOCK_TOKENS))))
    beside = blocks.select("label", F.inline(F.array(*[F.struct((F.col("band") + k).alias("band"), F.lit(k).alias("side"), F.col("blocks").alias("blocks")) for k in (-1, 0, 1)])))
    # of each band of a group the blocks of its own, of the one above (from which it is one below) and of the one below
    n = lambda k: F.coalesce(F.max(F.when(F.col("side") == -k, F.col("blocks"))), F.lit(0))
    around = beside.groupBy("label", "band").agg(n(0).alias("own"), n(1).alias("above"), n(-1).alias("below")).where("own > 0")
    around = around.join(blocks.select("label", "band", "weight"), ["label", "band"])
    keyed = around.select(F.struct("label", "band").alias("at"), "weight", "own", "above", "below")
    placed = lookup(chosen.withColumn("at", F.struct("label", "band")), keyed, "at", "weight", chosen.count())
    low_bits = F.lit(1 << 24).cast("long")
    run = lambda band, n: F.when(n > 0, F.sequence(band * low_bits, band * low_bits + n - 1)).otherwise(F.array().cast("array<long>"))
    band = F.col("band")
    others = F.concat(run(band, F.col("own")), run(band + 1, F.col("above")), run(band - 1, F.col("below")))
    meets = placed.select("node", "label", "copies", (band * low_bits + F.pmod(F.xxhash64("node"), F.col("own"))).alias("block"), others.alias("others"), "check", "first")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    with_text = texts.join(meets, F.col("_id").eqNullSafe(F.col("first"))).select("node", "label", "copies", "block", "others", "check", "text")
    sets = with_text.mapInArrow(lambda b: _sets(b, width), "node long, label long, copies long, block long, others array<long>, tokens binary")
    pairs = sets.withColumn("other", F.explode("others"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return pairs.select("label", low.alias("low"), high.alias("high"), "node", (F.col("block") > F.col("other")).cast("long").alias("half"), "copies", "tokens")


def distinct_sets(described: DataFrame) -> DataFrame:
    """Stored: a row for each node; ``other`` is not ``check`` if its sets differ."""
    sets = described.where("node is not null").groupBy("node").agg(
        F.min("check").alias("check"), F.max("check").alias("other"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("prefix").alias("prefix")
    )
    return stored(sets, "nodes")


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: the size of its set, its class and its number of links."""
    order = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, width))
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, node long, check long, size long, prefix binary"
    described = stored(given.mapInArrow(lambda b: _described(b, order.value, width, percent), schema), "sets")
    nodes = distinct_sets(described)
    while nodes.where("check <> other").head(1):  # sets whose nodes are equal by chance get others
        described = stored(described.withColumn("node", F.xxhash64("node", "check")), "sets")
        nodes = distinct_sets(described)
    edges = candidates(stored(sharing(nodes, order, percent), "sharing"), order, percent)
    keyed = block_pairs(docs, nodes, components(edges), width, percent)
    ordered = keyed.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
    found = stored(ordered.mapInArrow(lambda b: _joined(b, percent), "a long, b long, links long"), "links")
    order.destroy()
    labels = components(found.select("a", "b").distinct())
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    classed = nodes.select("node", "first", "copies").join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classed = stored(classed, "classes")
    first = classed.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("w"))
    named = lookup(classed, first, "label", "w", classed.count()).select("node", "component_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = described.select("doc_id", "node", F.col("size").alias("n_shingles"))
    out = lookup(rows.where("node is not null"), named, "node", "copies", described.count())
    empty = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links").unionByName(empty)


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class, all columns kept.

    Rows that repeat such a doc_id and text are returned once.
    """
    classes = stored(join(docs, width, percent).select("doc_id", "component_id"), "classes")
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")
    kept = chosen_rows(docs, F.col("doc_id").cast("long"), first.distinct(), "left_semi")
    return kept if first.count() == first.distinct().count() else kept.dropDuplicates(["doc_id", "text"])
