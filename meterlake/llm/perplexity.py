"""Quality rules: word and line counts, and perplexity under a modified Kneser-Ney model.

The model is over code points, five to an n-gram, in lower case with one space for white space and
one digit for all; every language has its own. A 5-gram counts as often as it has different left
neighbours, as lower orders do, so copies of a text add nothing. What is counted, every distinct
6-gram, grows with the corpus, and no part of the model is held whole:

1. Each task finds the distinct 6-grams of its part of an input file and deals them to shards by a hash
   of language and the second to fourth code points of the context.
2. A shard files what it is dealt. It has every n-gram of its contexts at orders 5 and 4, and tells their counts
   of counts and, as different shards see different left neighbours, its part of the counts at order 3.
3. Those parts, dealt by a hash of language and order 3's context, are added up and go back to the shards that
   asked. Counts of counts are summed by language, so discounts do not depend on the number of shards.
4. A shard answers each file's 6-grams with their 5-grams' log probabilities, with the uniform distribution below order 3.
5. A file's answers are one sorted hash array in the shared folder, in which the file's documents look
   up their 5-grams.

An input that is not read from files, or from very large ones, is stored with block numbers first.
A document is rejected when its log perplexity leaves the band of its language, whose ends lie
``BELOW`` and ``ABOVE`` interquartile ranges beyond the quartiles over all distinct texts of the language.

Defined results: null text counts as empty and fails the base rules; a null language is a language
of its own; a language without bands accepts what passes the base rules; repeated rows are judged
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import files
from meterlake.llm.common import chosen_rows, lookup, shared_folder, slices, stored

if TYPE_CHECKING:
    import pyarrow as pa

ORDER, LOWEST = 5, 3
#: Code points of a text handled at a time.
SLICE = 1 << 20
#: Code points in which a task looks for distinct 6-grams at a time, and distinct ones that it holds before it deals them to the shards.
GROUP, HELD = 1 << 20, 1_500_000
#: Code points of the corpus to a shard, and shards at most; beyond that shards grow.
SHARD_CHARS, MOST_SHARDS = 1 << 24, 1 << 18
#: Code points of a file from which the input is stored in blocks first.
FILE_CHARS = 1 << 31
#: Interquartile ranges between a quartile and the lower and upper end of the band, by labels.
BELOW, ABOVE = 3.0, 3.0
#: The least interquartile range that a band is built on, for languages of few or nearly equal texts.
LEAST_RANGE = 0.005
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MARKED = b"#*$%&|<>"
WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SPACE = np.uint32(32)
UNIFORM = 1.0 / 0x110000
ANSWER = np.dtype([("key", "<u8"), ("log_p", "<f4")])
#: A trigram with its count, or a part of it, and the sum and the numbers of counts of 1, 2 and more in its context.
PART = np.dtype([("key", "<u8"), ("n", "<u4")])
THIRD = np.dtype([("key", "<u8"), ("n", "<u4"), ("total", "<u8"), ("ones", "<u4"), ("twos", "<u4"), ("more", "<u4")])
ENTRY = struct.Struct("<IQ")


def _folded() -> np.ndarray:
    """Code points up to the last white space, with one for all white space and one for all digits."""
    fold = np.arange(0x3001, dtype=np.uint32)
    fold[48:58] = 48
    # The code points of white space.
    fold[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return fold


FOLD = _folded()


def chars(texts: list[str], first: bool = True, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's code points of texts one after the other, the place of each that ends an n-gram, and its text's number.

    Before every text stand five spaces, and it ends with one. Only of a text in parts a part is not ``first`` or ``last``.
    """
    given = [x.lower() for x in texts]
    a = np.frombuffer("".join([" " * (ORDER * first) + x + " " * last for x in given]).encode("utf-32-le", "replace"), np.uint32)
    a = np.where(a < len(FOLD), FOLD[np.minimum(a, len(FOLD) - 1)], a)
    sizes = np.fromiter(map(len, given), np.int64, len(given)) + ORDER * first + last
    start = np.cumsum(sizes) - sizes
    lead = np.zeros(len(a), bool)
    lead[(start[:, None] + np.arange(ORDER)).ravel()] = True
    kept = (a != SPACE) | np.roll(a != SPACE, 1) | lead  # of white space the first
    return a[kept], (~lead[kept]).nonzero()[0], np.repeat(np.arange(len(texts)), sizes)[kept & ~lead]


def parts(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``chars`` of one long text, in parts that each begin with the last five code points before."""
    tail = ""
    for at in range(0, len(text), SLICE):
        some = tail + text[at : at + SLICE]
        a, ends, owner = chars([some], not at, at + SLICE >= len(text))
        yield a, ends, owner
        tail = "".join(map(chr, a[-ORDER:].tolist()))


def grouped(batches: Iterator, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of batches by the length of their texts; a longer text is alone."""
    import pyarrow.compute as pc

    for batch in slices(batches):
        n = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def coded(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return parts(texts[0]) if len(texts) == 1 and len(texts[0]) > SLICE else iter([chars(texts)] if texts else [])


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h += c
        h += np.uint64(1)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def windows(a: np.ndarray, order: int) -> list[np.ndarray]:
    """The columns of all runs of ``order`` code points."""
    return [a[k : len(a) - order + 1 + k] for k in range(order)]


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each key stands first."""
    import pandas as pd

    return (~pd.Series(keys).duplicated().to_numpy()).nonzero()[0]


class Distinct:
    """The distinct 6-grams of texts, as rows of six code points."""

    def __init__(self):
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, ORDER + 1), np.uint32)

    def add(self, a: np.ndarray, ends: np.ndarray) -> None:
        keys = mixed(windows(a, ORDER + 1))[ends - ORDER]
        at = firsts(keys)
        keys, ends = np.concatenate([self.keys, keys[at]]), ends[at]
        at = firsts(keys)[len(self.keys) :]
        ends = ends[at - len(self.keys)]
        self.keys = np.concatenate([self.keys, keys[at]])
        self.rows = np.concatenate([self.rows, np.stack([a[ends + k] for k in range(-ORDER, 1)], axis=1)])


def _dealt(batches: Iterator, shards: int) -> Iterator:
    """From rows (block, lang, text), for each shard, block and language its 6-grams."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    block, found = None, {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, distinct in found.items():
            y = distinct.rows
            if not len(y):
                continue
            seed = np.full(len(y), _seed(lang), np.uint32)
            shard = (mixed([seed, y[:, 2], y[:, 3], y[:, 4]]) % np.uint64(shards)).astype(np.int64)
            wide = y.astype(np.uint64)
            high = (wide[:, 3] << np.uint64(42)) | (wide[:, 4] << np.uint64(21)) | wide[:, 2]
            low = (wide[:, 1] << np.uint64(42)) | (wide[:, 5] << np.uint64(21)) | wide[:, 0]
            order = np.lexsort((low, high, shard))
            y, shard = y[order], shard[order]
            starts = np.append(np.nonzero(np.diff(shard, prepend=-1))[0], len(y))
            rows = [(int(shard[a]), block, lang, pack(np.ascontiguousarray(y[a:b].T).tobytes())) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], ["shard", "block", "lang", "grams"])
        found.clear()

    for batch in grouped(batches, 2, GROUP):
        texts: dict[tuple, list[str]] = {}
        for key, lang, text in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if text:
                texts.setdefault((key, lang), []).append(text)
        for (key, lang), some in texts.items():
            if key != block or sum(len(d.keys) for d in found.values()) > HELD:
                yield from out()
                block = key
            for a, ends, _ in coded(some):
                found.setdefault(lang, Distinct()).add(a, ends)
    yield from out()


def _seed(lang: str | None) -> int:
    return struct.unpack("<I", hashlib.blake2b(b"" if lang is None else b"=" + lang.encode("utf-8", "replace"), digest_size=4).digest())[0]


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What counts of 0, 1, 2 and more lose, by the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    ratio = lambda a, b: a / b if b else 1.0
    d = np.clip([0.0, 1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)], 0, [0, 0.95, 1.9, 2.9])
    d[1:] = np.where(d[1:] > 0, d[1:], 0.4)
    return d


def distinct(lists: Iterable[np.ndarray]) -> np.ndarray:
    """The distinct rows of lists of 6-grams; besides them ``HELD`` rows and a list are held."""
    held: list[np.ndarray] = []
    n, limit = 0, HELD

    def once() -> np.ndarray:
        y = np.concatenate(held)
        return y[np.unique(mixed([y[:, k] for k in range(ORDER + 1)]), return_index=True)[1]]

    for y in lists:
        held.append(y)
        n += len(y)
        if n > limit:
            held = [once()]
            n = len(held[0])
            limit = n + HELD
    return once()


def counted(y: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From distinct 6-grams the sorted keys of their n-grams, a row of each, and counts: of different left neighbours."""
    _, first = np.unique(mixed([y[:, k] for k in range(ORDER - order, ORDER + 1)]), return_index=True)
    keys, at, counts = np.unique(mixed([y[first, k] for k in range(ORDER + 1 - order, ORDER + 1)]), return_index=True, return_counts=True)
    return keys, first[at], counts


def trigrams(y: np.ndarray) -> np.ndarray:
    """The last three code points of rows in one number each, in order of their contexts."""
    wide = y[:, ORDER - 2 :].astype(np.uint64)
    return (wide[:, 0] << np.uint64(42)) | (wide[:, 1] << np.uint64(21)) | wide[:, 2]


def estimated(y: np.ndarray, third: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """From distinct 6-grams that share no context of orders 5 and 4 with any others, the sorted keys of their 5-grams and log probabilities.

    ``third`` has their trigrams, sorted, and ``counts`` the language's counts of counts, four by four from the lowest order.
    """
    d = discounts(*counts[:4])
    left = d[1] * third["ones"] + d[2] * third["twos"] + d[3] * third["more"]
    p = third["key"], (third["n"] - d[np.minimum(third["n"], 3)] + left * UNIFORM) / third["total"]
    for order in range(LOWEST + 1, ORDER + 1):
        keys, at, n = counted(y, order)
        _, context = np.unique(mixed([y[at, k] for k in range(ORDER + 1 - order, ORDER)]), return_inverse=True)
        cut = discounts(*counts[4 * (order - LOWEST) :][:4])[np.minimum(n, 3)]
        total = np.bincount(context, weights=n)[context]
        left = np.bincount(context, weights=cut)[context] / total
        shorter = trigrams(y[at]) if order == LOWEST + 1 else mixed([y[at, k] for k in range(ORDER + 2 - order, ORDER + 1)])
        p = keys, (n - cut) / total + left * p[1][np.searchsorted(p[0], shorter)]
    return p[0], np.log(p[1])


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _listed(path: str) -> Iterator[tuple[str, np.ndarray]]:
    """The blocks of a shard's file, each with its 6-grams."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    with files.random_access(path) as f:
        while head := f.read(ENTRY.size):
            name, size = ENTRY.unpack(head)
            yield f.read(name).decode(), np.frombuffer(unpack(f.read(size)), np.uint32).reshape(ORDER + 1, -1).T


def _gathered(batches: Iterator, folder: str, shards: int) -> Iterator:
    """From rows (shard, lang, block, grams) ordered by shard and language, a row for each with its file and counts of counts, and rows of trigrams for parts."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("part", pa.int64()), ("grams", pa.binary()), ("path", pa.string()), ("counts", pa.list_(pa.int64()))])
    for (shard, lang), some in groupby(_rows(batches), key=lambda r: r[:2]):
        path = _path(f"{folder}/shards", f"{shard} {lang!r}")
        with files.writing(path) as target:
            for _, _, block, data in some:
                name = block.encode()
                target.write(ENTRY.pack(len(name), len(data)) + name + data)
        y = distinct(grams for _, grams in _listed(path))
        found = [[0] * 4] + [counts_of_counts(counted(y, order)[2]) for order in range(LOWEST + 1, ORDER + 1)]
        _, at, n = counted(y, LOWEST)
        three = np.empty(len(at), PART)
        three["key"], three["n"] = trigrams(y[at]), n
        part = (mixed([np.full(len(at), _seed(lang), np.uint32), y[at, 3], y[at, 4]]) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((three["key"], part))
        three, part = three[order], part[order]
        starts = np.append(np.nonzero(np.diff(part, prepend=-1))[0], len(part))
        rows = [(shard, lang, int(part[a]), pack(three[a:b].tobytes()), None, None) for a, b in zip(starts, starts[1:], strict=False)]
        rows.append((shard, lang, None, None, path, sum(found, [])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _thirds(batches: Iterator) -> Iterator:
    """From rows (part, lang, shard, grams) ordered by part and language, each shard's trigrams with what is known of all, and a row of counts of counts."""
    import pyarrow as pa
    import zstandard

    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("counts", pa.list_(pa.int64()))])
    for (_, lang), some in groupby(_rows(batches), key=lambda r: r[:2]):
        given = [(shard, np.frombuffer(unpack(data), PART)) for _, _, shard, data in some]
        every = np.concatenate([x for _, x in given])
        keys, at = np.unique(every["key"], return_inverse=True)
        n = np.bincount(at, weights=every["n"]).astype(np.int64)
        _, context = np.unique(keys >> np.uint64(21), return_inverse=True)
        third = np.empty(len(keys), THIRD)
        third["key"], third["n"] = keys, n
        for name, weights in (("total", n), ("ones", n == 1), ("twos", n == 2), ("more", n > 2)):
            third[name] = np.bincount(context, weights=weights)[context]
        rows = [(shard, lang, pack(third[np.searchsorted(keys, x["key"])].tobytes()), None) for shard, x in given]
        rows.append((None, lang, None, counts_of_counts(n) + [0] * 4 * (ORDER - LOWEST)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _answered(batches: Iterator) -> Iterator:
    """From rows (shard, lang, grams, path, counts) ordered by shard, language and path, the 5-grams of each block's rows with their log probabilities."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for (_, lang), some in groupby(_rows(batches), key=lambda r: r[:2]):
        three = []
        for _, _, data, path, counts in some:
            if path is None:
                three.append(np.frombuffer(unpack(data), THIRD))
                continue
            third = np.concatenate(three)
            third = third[np.argsort(third["key"])]
            sorted_keys, log_p = estimated(distinct(grams for _, grams in _listed(path)), third, counts)
            seed = np.uint64(_seed(lang))
            for block, y in _listed(path):
                own = np.unique(mixed([y[:, k] for k in range(1, ORDER + 1)]))
                answer = np.empty(len(own), ANSWER)
                answer["key"], answer["log_p"] = own ^ seed, log_p[np.searchsorted(sorted_keys, own)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.string()), pa.array([answer.tobytes()], pa.binary())], ["block", "answer"])


def _filed(batches: Iterator, folder: str) -> Iterator:
    """Writes the answers of each block, rows of which follow each other, as one sorted array."""
    import pyarrow as pa

    block, parts = None, []

    def out() -> pa.RecordBatch:
        every = np.concatenate([np.frombuffer(x, ANSWER) for x in parts])
        _, first = np.unique(every["key"], return_index=True)
        with files.writing(_path(folder, block)) as target:
            target.write(every[first].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([block], pa.string()), pa.array([len(first)], pa.int64())], ["block", "n"])

    for batch in batches:
        for key, answer in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != block:
                if parts:
                    yield out()
                block, parts = key, []
            parts.append(answer)
    if parts:
        yield out()


def _path(folder: str, block: str) -> str:
    return f"{folder}/{hashlib.sha1(block.encode()).hexdigest()}.grams"


def blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, lang, text, block), where a block's rows lie together, and the code points of all.

    A block is an input file. Other inputs are stored with a block number for each task.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    named = given.withColumn("block", F.input_file_name())
    sizes = named.groupBy("block").agg(F.sum(F.length("text")).alias("n")).agg(F.sum("n"), F.max("n"), F.min("block")).first()
    total, most, least = sizes
    if total and (not least or most > FILE_CHARS):
        named = stored(given.withColumn("block", F.spark_partition_id().cast("string")), "blocks")
    return named, total or 0


def model(rows: DataFrame, total: int) -> str:
    """Estimate the model of ``rows`` and file each block's part of it; the folder of the files."""
    folder = shared_folder(rows.sparkSession, "grams")
    shards = min(MOST_SHARDS, max(1, -(-total // SHARD_CHARS)))
    dealt = rows.select("block", "lang", "text").mapInArrow(lambda b: _dealt(b, shards), "shard long, block string, lang string, grams binary")
    by_shard = dealt.select("shard", "lang", "block", "grams").repartition("shard").sortWithinPartitions("shard", "lang")
    gathered = stored(by_shard.mapInArrow(lambda b: _gathered(b, folder, shards), "shard long, lang string, part long, grams binary, path string, counts array<long>"), "gathered")
    by_part = gathered.where("part is not null").select("part", "lang", "shard", "grams").repartition("part").sortWithinPartitions("part", "lang")
    thirds = stored(by_part.mapInArrow(_thirds, "shard long, lang string, grams binary, counts array<long>"), "thirds")
    told = gathered.select("lang", "counts").unionAll(thirds.select("lang", "counts")).where("counts is not null")
    sums = told.groupBy("lang").agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(4 * (ORDER - LOWEST + 1))]).alias("counts"))
    asking = gathered.where("path is not null").select("shard", F.col("lang").alias("of"), "path").join(sums, F.col("of").eqNullSafe(F.col("lang")))
    asking = asking.select("shard", "lang", F.lit(None).cast("binary").alias("grams"), "path", "counts")
    told_back = thirds.where("shard is not null").select("shard", "lang", "grams", F.lit(None).cast("string").alias("path"), F.lit(None).cast("array<long>").alias("counts"))
    answers = told_back.unionAll(asking).repartition("shard").sortWithinPartitions("shard", "lang", "path").mapInArrow(_answered, "block string, answer binary")
    stored(answers.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _filed(b, folder), "block string, n long"), "filed")
    return folder


def base_counts(texts: pa.Array) -> np.ndarray:
    """A row for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    import pandas as pd
    import pyarrow.compute as pc

    n = len(texts)
    texts = pc.fill_null(texts.cast("large_string"), "")
    per_text = lambda mask, owner: np.bincount(owner[mask], minlength=n)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    of_byte = np.repeat(np.arange(n), sizes)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    kind = KIND[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]] if ends[-1] else np.zeros(0, np.uint8)
    split = pc.ascii_split_whitespace(texts)
    count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, words = np.repeat(np.arange(n), count), split.flatten()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    coded = words.dictionary_encode()
    owner, word, m = owner[real], coded.indices.to_numpy()[real].astype(np.int64), len(coded.dictionary)
    repeated = np.zeros(len(word), bool)
    if len(word) > 3:
        if n * m**3 < 1 << 62:
            key = ((owner[2:] * m + word[:-2]) * m + word[1:-1]) * m + word[2:]
        else:
            pair = pd.factorize(word[:-2] * m + word[1:-1])[0]
            key = owner[2:] * len(word) + pd.factorize(pair * m + word[2:])[0]
        whole = owner[2:] == owner[:-2]
        twice = np.zeros(len(key), bool)
        twice[whole] = pd.Series(key[whole]).duplicated(keep=False).to_numpy()
        for k in range(3):
            repeated[k : k + len(key)] |= twice
    split = pc.split_pattern(texts, "\n")
    of_line = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    lines = split.flatten().dictionary_encode()
    blank = pc.equal(pc.ascii_trim_whitespace(lines.dictionary), "").to_numpy(zero_copy_only=False)
    line = lines.indices.to_numpy().astype(np.int64)
    again = pd.Series(of_line * len(blank) + line).duplicated().to_numpy() & ~blank[line]
    return np.stack([np.bincount(owner, minlength=n), per_text(kind > 0, of_byte), per_text(kind == 2, of_byte), per_text(again, of_line), per_text(repeated, owner)], axis=1)


def _kinds() -> np.ndarray:
    """Of bytes in UTF-8: 0 begins no character of a word, 1 does, 2 is a symbol."""
    kind = np.ones(256, np.uint8)
    kind[list(WHITE)] = 0
    kind[0x80:0xC0] = 0
    kind[list(MARKED)] = 2
    return kind


KIND = _kinds()


class Answers:
    """A block's sorted keys, found by their first bits."""

    def __init__(self, data: bytes):
        answer = np.frombuffer(data, ANSWER)
        self.keys, self.log_p = answer["key"].copy(), answer["log_p"].copy()
        bits = max(1, len(self.keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities; every key must be there."""
        at = self.start[keys >> self.shift]
        todo = np.arange(len(keys))
        while len(todo):
            if at[todo].max() >= len(self.keys):
                raise ValueError("the documents are not those that the model was made of")
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] += 1
        return self.log_p[at]


def _measured(batches: Iterator, folder: str) -> Iterator:
    import pyarrow as pa

    block, answers = None, None
    names = ["doc_id", "lang", "text_key", *[x.split()[0] for x in BASE.split(", ")], "log_perplexity"]
    for batch in grouped(batches, 3):
        total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        texts: dict[tuple, list[tuple[int, str]]] = {}
        for k, (key, lang, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in (4, 1, 3)], strict=True)):
            if text:
                texts.setdefault((key, lang), []).append((k, text))
        for (key, lang), some in texts.items():
            places, seed = np.array([k for k, _ in some]), np.uint64(_seed(lang))
            for a, ends, owner in coded([x for _, x in some]):
                if not len(ends):
                    continue
                if key != block:
                    block, answers = key, Answers(files.read_whole(_path(folder, key)))
                log_p = answers.of(mixed(windows(a, ORDER))[ends - ORDER + 1] ^ seed)
                total[places] -= np.bincount(owner, weights=log_p, minlength=len(some))
                n[places] += np.bincount(owner, minlength=len(some))
        loss = pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
        counts = base_counts(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in counts.T], loss], names)


def measured(docs: DataFrame) -> DataFrame:
    """Base counts and mean negative log probability of every document's code points."""
    rows, total = blocks(docs)
    folder = model(rows, total)
    given = rows.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text", "block")
    return given.mapInArrow(lambda b: _measured(b, folder), f"doc_id long, lang string, text_key long, {BASE}, log_perplexity double")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def banded(rows: DataFrame, below: float, above: float) -> DataFrame:
    """Rows with the ends of their language's band, from the distinct texts that pass the base rules, so that copies shift no quartile."""
    rows = rows.withColumn("lang_key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    quartiles = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10_000)
    texts = rows.where("not base_failed").groupBy("lang_key", "text_key").agg(F.first("log_perplexity").alias("log_perplexity"))
    weights = rows.groupBy("lang_key").agg(F.count("*").alias("weight"))
    q = texts.groupBy("lang_key").agg(quartiles.alias("q"))
    range_ = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    ends = weights.join(q, "lang_key", "left").select("lang_key", "weight", (F.col("q")[0] - below * range_).alias("log_lower"), (F.col("q")[1] + above * range_).alias("log_upper"))
    return lookup(rows, stored(ends, "bands"), "lang_key", "weight", rows.count())


def judged(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per document with its counts, its perplexity, the band of its language and the verdict."""
    rows = stored(measured(docs), "perplexity").withColumn("base_failed", base_failed())
    inside = F.coalesce(F.col("log_perplexity").between(F.col("log_lower"), F.col("log_upper")), F.lit(True))
    return banded(rows, below, above).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"),
        F.exp("log_lower").alias("perplexity_lower"), F.exp("log_upper").alias("perplexity_upper"),
    )


def passing(docs: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rows with the same doc_id and text are judged alike and each kept; a hash of the text tells
    others with the same doc_id apart.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    kept = judged(docs.select(key.alias("doc_id"), "lang", "text"), below, above).where("kept").select("doc_id").distinct()
    return chosen_rows(docs, key, kept, "left_semi")
