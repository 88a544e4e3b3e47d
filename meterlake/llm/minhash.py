"""Near duplicates by many universal hash minima, banded; links are confirmed on whole sets.

Each document's set of word shingles is hashed by ``BANDS * ROWS`` universal functions, whose minima
are its signature. Equal sets are found first and only one of them goes on. Sets whose minima agree in
a whole band are in one bucket. Two sets with a similarity of 0.8 share no bucket with a probability of
``(1 - 0.8 ** ROWS) ** BANDS``, 7e-10.

No bucket is expanded into its pairs. First each set is held against one leader, of the least sets of its
buckets the one that it shares most buckets with: signatures first, then, where these allow a link, whole sets. Components of these links settle
most buckets: where all sets are in one component, no pair can add anything. In the others the sets of
the largest component and the rest make blocks of bounded size; blocks of the rest meet each other
and those of the component, which never meet among themselves. Signatures in a pair of blocks tell which
sets may have a link to another component (five and more deviations below the limit rule it out); of
these alone whole sets are fetched and compared, until they are joined or no candidate is left. What
follows are components again, by alternating large-star and small-star steps.

Hot buckets: counts and least members are aggregated before the shuffle, their rows find them by broadcast,
and leaders and blocks are dealt in parts.

Defined results: null and wordless texts are empty sets, linked with nothing; fewer words than a
shingle are one shingle; repeated rows are copies and linked; equal doc_ids with different texts
are judged apart; a null doc_id is never a component_id unless its whole component has no other;
an empty table gives no rows; other columns are ignored; of very long texts the whole set counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import MOST_KEYS, chosen_rows, lookup, slices, stored
from meterlake.llm.graph import components
from meterlake.llm.jaccard import shingles, signature

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 40, 4
#: Bits of a bucket's key that number its band.
BAND = 63
HASHES = BANDS * ROWS
#: Sets that meet a copy of their leader, and sets in a block.
STAR_ROWS, BLOCK_ROWS = 1000, 2000
#: By how many deviations an estimate may be below the limit.
DEVIATIONS = 6
#: Odd multipliers and offsets of the universal functions, from a generator with a stated seed.
_RANDOM = np.random.default_rng(20_001)
MULTIPLIERS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2)


def minima(tokens: np.ndarray) -> np.ndarray:
    """The least of each universal function over a set's tokens, its upper 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(tokens), 256):
        hashed = tokens[at : at + 256, None] * MULTIPLIERS
        hashed += OFFSETS
        np.minimum(least, hashed.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def sketch(tokens: np.ndarray) -> bytes:
    """A set's size and minima."""
    return np.concatenate([np.array([len(tokens)], np.uint32), minima(tokens)]).tobytes()


def sketches(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(blobs), np.uint32).reshape(-1, HASHES + 1)
    return rows[:, 0].astype(np.int64), rows[:, 1:]


def least_agreement(percent: int) -> int:
    """Minima that linked sets have in common, but for a deviation that does not occur."""
    share = percent / 100
    return int(HASHES * share - DEVIATIONS * (HASHES * share * (1 - share)) ** 0.5)


def band_keys(minima_: np.ndarray) -> np.ndarray:
    """A hash of each band of each row, whose last bits are the band's number."""
    x = minima_.reshape(len(minima_), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for k in range(ROWS):
        key = (key ^ x[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xC4CEB9FE1A85EC53)
        key ^= key >> np.uint64(29)
    key = (key & ~np.uint64(BAND)) | np.arange(BANDS, dtype=np.uint64)
    return key.view(np.int64)


def _described(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        nodes, checks, sizes, blobs = [], [], [], []
        for text in batch.column(1).to_pylist():
            tokens = shingles(text, width)
            node, check = signature(tokens) if len(tokens) else (None, None)
            nodes.append(node)
            checks.append(check)
            sizes.append(len(tokens))
            blobs.append(sketch(tokens) if len(tokens) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "node", "check", "size", "sketch"])


def _banded(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches, 2000):
        if batch.num_rows:
            keys = band_keys(sketches(batch.column(1).to_pylist())[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "node"])


def _nodes(described: DataFrame) -> DataFrame:
    """Stored: a row for each distinct set; ``other`` is not ``check`` if sets of equal node differ."""
    made = described.where("node is not null").groupBy("node").agg(
        F.min("check").alias("check"), F.max("check").alias("other"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")
    )
    return stored(made, "nodes")


def buckets(nodes: DataFrame) -> DataFrame:
    """Stored: key, node, ``low``, the bucket's least node, and ``weight``: of buckets with the same members the first band's stays for as many."""
    rows = nodes.select("node", "sketch").mapInArrow(_banded, "key long, node long")
    named = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    shared = stored(named.groupBy("n", "low", "high", "sum").agg(F.min_by("key", F.col("key").bitwiseAND(BAND)).alias("key"), F.count("*").alias("weight")).select("key", "n", "low", "weight"), "buckets")
    return stored(lookup(rows, shared, "key", "n", BANDS * nodes.count()).where("low is not null"), "members")


def _held_against(batches: Iterator, judge) -> Iterator:
    """Pairs that ``judge`` lets pass, over rows (a, part, lead, node, data) with the leader's first."""
    import pyarrow as pa

    leader = None
    for batch in slices(batches):
        found = []
        for a, _, lead, node, data in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
            if lead:
                leader = data
            elif judge(leader, data):
                found.append((a, node))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def with_leaders(edges: DataFrame, data: DataFrame, judge) -> DataFrame:
    """The ``edges`` (leader a, node b) that pass; a leader of many is sent to parts of them."""
    n = F.count("*").alias("n")
    parts = stored(edges.groupBy("a").agg(n).withColumn("parts", F.ceil(F.col("n") / STAR_ROWS)), "leaders")
    placed = lookup(edges, parts, "a", "n", edges.count()).select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(False).alias("lead"))
    leads = parts.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(True).alias("lead"))
    sent = placed.unionByName(leads).join(data, "node").select("a", "part", "lead", "node", "data")
    together = sent.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("lead"))
    return together.mapInArrow(lambda b: _held_against(b, judge), "a long, b long")


def sizes_allow(one, other, percent: int):
    return np.minimum(one, other) * 100 >= np.maximum(one, other) * percent


def agree(one: bytes, other: bytes, percent: int) -> bool:
    (sizes, rows) = sketches([one, other])
    return bool(sizes_allow(sizes[0], sizes[1], percent)) and int((rows[0] == rows[1]).sum()) >= least_agreement(percent)


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted tokens have that similarity."""
    least = -(-(len(one) + len(other)) * percent // (100 + percent))
    if min(len(one), len(other)) < least:
        return False
    at = np.searchsorted(one, other)
    return int((one[np.minimum(at, len(one) - 1)] == other).sum()) >= least


def _tokens(batches: Iterator, width: int) -> Iterator:
    """The sets of chosen documents; rows of another text with the same doc_id go."""
    import pyarrow as pa

    for batch in slices(batches, 200):
        found = []
        for node, check, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            tokens = shingles(text, width)
            if len(tokens) and signature(tokens)[1] == check:
                found.append((node, tokens.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["node", "data"])


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Stored: the whole sets of the nodes in the one column of ``wanted``, each once, made again from the texts."""
    asked = stored(wanted.toDF("node").distinct().join(nodes.select("node", "check", "first"), "node"), "asked")
    asked = F.broadcast(asked) if asked.count() <= MOST_KEYS else asked.hint("shuffle_merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    rows = texts.join(asked, F.col("_id").eqNullSafe(F.col("first"))).select("node", "check", F.col("_text").alias("text"))
    return stored(rows.mapInArrow(lambda b: _tokens(b, width), "node long, data binary").dropDuplicates(["node"]), "token-sets")


def leader_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Stored: confirmed links of each set to a leader, that least set of its buckets which it shares most of them with."""
    met = members.where("node <> low").groupBy("node", "low").agg(F.sum("weight").alias("weight"))
    rank = F.shiftleft("weight", 40) + F.shiftrightunsigned(F.xxhash64("low"), 24)  # by buckets in common, then by chance
    edges = stored(met.groupBy(F.col("node").alias("b")).agg(F.max_by("low", rank).alias("a")), "stars")
    likely = stored(with_leaders(edges, nodes.select("node", F.col("sketch").alias("data")), lambda x, y: agree(x, y, percent)), "likely")
    sets = sets_of(docs, nodes, likely.select("a").union(likely.select("b")), width)
    exact = lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
    return stored(with_leaders(likely, sets, exact), "star-links")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets with several components, once for each pair of blocks that they are compared in: key, low, high, half, node, label."""
    labelled = stored(members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    shares = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    by_key = shares.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.lit(1))
    sized = stored(by_key.select("key", "n", "main", blocks(F.col("n") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("of_main")), "unsettled")
    placed = lookup(labelled, sized, "key", "n", labelled.count()).where("main is not null")
    at = lambda n: F.pmod(F.xxhash64("node"), n)
    in_main = F.col("label") == F.col("main")
    zero = F.lit(0).cast("long")
    block = F.when(in_main, F.col("rest") + at(F.col("of_main"))).otherwise(at(F.col("rest")))
    others = F.sequence(zero, F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("of_main")) - 1)
    met = placed.select("key", "node", "label", block.alias("block"), F.explode(others).alias("other"))
    return met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("half"), "node", "label")


BLOCK = ["key", "low", "high"]


def _block_pairs(batches: Iterator) -> Iterator[tuple[tuple, list[tuple]]]:
    """Pairs of blocks from rows (key, low, high, half, node, label, data) in order; a node that is there twice counts once."""
    now, held = None, {}
    for batch in slices(batches, 2000):
        for key, low, high, half, node, label, data in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if (key, low, high) != now:
                if len(held) > 1:
                    yield now, list(held.values())
                now, held = (key, low, high), {}
            held[node, half] = (half, node, label, data)
    if len(held) > 1:
        yield now, list(held.values())


def _partners(pair: tuple, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, halves: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set those before it, of another component, which signatures allow to be linked; the likeliest first.

    Two sets are partners only in the bucket of the first band that they have in common.
    """
    least, cross, band = least_agreement(percent), pair[1] != pair[2], pair[0] & BAND
    bands = rows.reshape(len(rows), BANDS, ROWS)
    for i in range(1, len(rows)):
        able = (labels[:i] != labels[i]) & sizes_allow(sizes[:i], sizes[i], percent)
        if cross:
            able &= halves[:i] != halves[i]
        others = able.nonzero()[0]
        if len(others):
            n = (rows[others] == rows[i]).sum(axis=1)
            others, n = others[n >= least], n[n >= least]
            here = (bands[others] == bands[i]).all(axis=2).argmax(axis=1) == band
            others, n = others[here], n[here]
            if len(others):
                yield i, others[np.argsort(-n, kind="stable")]


def _likely(batches: Iterator, percent: int) -> Iterator:
    """Of each pair of blocks the rows that may be linked to another component."""
    import pyarrow as pa

    kinds = {"key": pa.int64(), "low": pa.int64(), "high": pa.int64(), "half": pa.bool_(), "node": pa.int64(), "label": pa.int64()}
    for pair, held in _block_pairs(batches):
        sizes, rows = sketches([h[3] for h in held])
        halves, labels = np.array([h[0] for h in held]), np.array([h[2] for h in held])
        kept: set[int] = set()
        for i, others in _partners(pair, rows, sizes, labels, halves, percent):
            kept.add(i)
            kept.update(others.tolist())
        found = [(*pair, *held[k][:3]) for k in sorted(kept)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds))


def _confirmed(batches: Iterator, percent: int) -> Iterator:
    """Links that join components, of the rows of each pair of blocks."""
    import pyarrow as pa

    for pair, held in _block_pairs(batches):
        sets = [np.frombuffer(h[3], np.uint64) for h in held]
        rows, sizes = np.stack([minima(s) for s in sets]), np.array([len(s) for s in sets])
        halves, labels = np.array([h[0] for h in held]), np.array([h[2] for h in held])
        root = {x: x for x in labels.tolist()}

        def find(x: int, root: dict[int, int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found = []
        for i, others in _partners(pair, rows, sizes, labels, halves, percent):
            for j in others.tolist():
                a, b = find(held[i][2]), find(held[j][2])
                if a != b and linked(sets[i], sets[j], percent):
                    root[a] = b
                    found.append((held[i][1], held[j][1]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def further_links(docs: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """Stored: links that join components in buckets which leaders have not settled."""
    rows = unsettled(members, labels).join(nodes.select("node", F.col("sketch").alias("data")), "node").select(*BLOCK, "half", "node", "label", "data")
    in_blocks = lambda df: df.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    likely = stored(in_blocks(rows).mapInArrow(lambda b: _likely(b, percent), "key long, low long, high long, half boolean, node long, label long"), "likely-rows")
    sets = sets_of(docs, nodes, likely.select("node"), width)
    compared = in_blocks(likely.join(sets, "node").select(*BLOCK, "half", "node", "label", "data"))
    return stored(compared.mapInArrow(lambda b: _confirmed(b, percent), "a long, b long"), "block-links")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: the size of its set, its class, and whether it is the one of its class that stays."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = stored(given.mapInArrow(lambda b: _described(b, width), "doc_id long, node long, check long, size long, sketch binary"), "sketches")
    nodes = _nodes(described)
    while nodes.where("check <> other").head(1):  # sets whose nodes are equal by chance get others
        described = stored(described.withColumn("node", F.xxhash64("node", "check")), "sketches")
        nodes = _nodes(described)
    members = buckets(nodes)
    stars = leader_links(docs, nodes, members, width, percent)
    more = further_links(docs, nodes, members, components(stars), width, percent)
    labels = components(stars.union(more))
    classed = stored(nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "classes")
    names = classed.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("w"))
    named = lookup(classed, names, "label", "w", classed.count()).select("node", "component_id", "copies")
    rows = described.select("doc_id", "node", F.col("size").alias("n_shingles"))
    out = lookup(rows.where("node is not null"), named, "node", "copies", described.count()).select("doc_id", "n_shingles", "component_id")
    empty = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one for each class, all columns kept; a row that repeats doc_id and text is returned once."""
    first = stored(near_duplicates(docs, width, percent).where("kept").select("doc_id"), "kept")
    kept = chosen_rows(docs, F.col("doc_id").cast("long"), first.distinct(), "left_semi")
    return kept if first.count() == first.distinct().count() else kept.dropDuplicates(["doc_id", "text"])
