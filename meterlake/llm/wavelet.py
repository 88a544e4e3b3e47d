"""Token ids in wavelet matrices: one compressed file per shard of documents in ascending doc_id order.

A wavelet matrix holds one bit of every token per plane, most significant first, and orders the
tokens of the next plane stably by that bit. With ranks and selects over the planes it gives any
token, the count of an id in any range, and the places where an id occurs, without unpacking the ids.

File: a magic word, the lengths of a zstd-compressed JSON header and of the directory, both of these,
then the document ids and token counts, then the planes in frames of ``FRAME_BITS``, each compressed
by zstd. The directory has for every frame its place in the file and the one bits of its plane
before it, so a rank or select reads the directory once and then a frame of a few KB.

Defined results: a null text has only the end id; repeated rows are all written; rows with equal
doc_id follow each other, ordered by a hash of their text; null doc_ids come first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm import files, tokens
from meterlake.llm.common import release, shared_folder, stored, whole

END = 2
MAGIC = b"WAVELET2"
#: Tokens in one shard file at most, but for a longer document.
SHARD_TOKENS = 6_000_000
#: Bits of a frame of a plane, and frames of a file that a reader keeps.
FRAME_BITS, KEPT = 1 << 15, 256
MANIFEST = "shard long, part long, path string, n_docs long, n_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Ranked:
    """Ranks, selects and what follows from them, over frames of bit planes.

    ``n`` ids below ``2 ** bits``; ``zeros`` has the zero bits of each plane, ``ones`` of each plane the one bits before every frame.
    """

    n: int
    bits: int
    zeros: list[int]
    ones: np.ndarray

    def frame(self, level: int, k: int) -> np.ndarray:
        """The bytes of a plane's frame."""
        raise NotImplementedError

    def rank1(self, level: int, i: int) -> int:
        """One bits among the first ``i`` of a plane."""
        k, rest = divmod(i, FRAME_BITS)
        ones = int(self.ones[level][k]) if k < self.ones.shape[1] else self.n - self.zeros[level]
        if rest:
            data = self.frame(level, k)
            ones += int(np.bitwise_count(data[: rest >> 3]).sum())
            if rest & 7:
                ones += (int(data[rest >> 3]) & ((1 << (rest & 7)) - 1)).bit_count()
        return ones

    def select(self, level: int, k: int, bit: bool) -> int:
        """The place of the ``k``-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(self.ones.shape[1]) * FRAME_BITS - self.ones[level]
        at = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.frame(level, at), bitorder="little").view(bool)
        return at * FRAME_BITS + int((bits == bit).nonzero()[0][k - int(before[at])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            k, rest = divmod(i, FRAME_BITS)
            one = int(self.frame(level, k)[rest >> 3]) >> (rest & 7) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if one else i - ones
            value = 2 * value + one
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, start), self.rank1(level, stop)
            if symbol >> (self.bits - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs among the tokens from ``start`` to ``stop``."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, start, self.n if stop is None else stop)
        return b - a

    def locate(self, symbol: int, k: int) -> int:
        """The place of the ``k``-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(symbol >> (self.bits - 1 - level) & 1)
            i = self.select(level, i - self.zeros[level] if one else i, one)
        return i


class WaveletMatrix(Ranked):
    """All bit planes in memory."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros, self.bits = n, planes, zeros, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        import pyarrow as pa

        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(bits - 1, -1, -1):
            plane = np.packbits((now & (1 << level)) != 0, bitorder="little")
            planes.append(plane)
            # a plane has the layout of Arrow's booleans, by which Arrow filters
            low, high = (pa.array(now).filter(pa.Array.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(x)])).to_numpy() for x in (~plane, plane))
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(ids), planes, zeros)

    def frame(self, level: int, k: int) -> np.ndarray:
        return self.planes[level][k * FRAME_BITS // 8 : (k + 1) * FRAME_BITS // 8]

    @cached_property
    def ones(self) -> np.ndarray:
        width, n = FRAME_BITS // 8, -(-self.n // FRAME_BITS)
        filled = np.zeros((self.bits, n * width), np.uint8)
        for row, plane in zip(filled, self.planes, strict=True):
            row[: len(plane)] = plane
        each = np.bitwise_count(filled).reshape(self.bits, n, width).sum(axis=2, dtype=np.int64)
        return np.cumsum(each, axis=1) - each

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up: each plane says which token of the next one comes next."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        below = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            bit, z = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool), self.zeros[level]
            here = np.empty(self.n, dtype)
            here[~bit] = below[:z]
            here[bit] = below[z:] | dtype(1 << (self.bits - 1 - level))
            below = here
        return below


def dumped(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of a shard file."""
    import zstandard

    matrix = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    lists = [pack(x.tobytes()) for x in (np.array([d or 0 for d in doc_ids], "<i8"), np.packbits(known), np.array(lengths, "<i8"))]
    frames = [pack(matrix.frame(level, k).tobytes()) for level in range(matrix.bits) for k in range(matrix.ones.shape[1])]
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    directory = pack(np.stack([np.cumsum(sizes) - sizes, sizes, matrix.ones.ravel()]).astype("<i8").tobytes())
    header = pack(json.dumps({"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "frame": FRAME_BITS, "lists": [len(x) for x in lists]}).encode())
    return b"".join([MAGIC, len(header).to_bytes(8, "little"), len(directory).to_bytes(8, "little"), header, directory, *lists, *frames])


class ShardFile(Ranked):
    """A shard file that is read by frames, as ranks and selects ask for them."""

    def __init__(self, source):
        import zstandard

        self.source = source
        head = self._bytes(0, 24)
        if head[:8] != MAGIC:
            raise ValueError("no wavelet shard")
        self.unpack = zstandard.ZstdDecompressor().decompress
        n_header, n_directory = (int.from_bytes(head[k : k + 8], "little") for k in (8, 16))
        data = self._bytes(24, n_header + n_directory)
        header = json.loads(self.unpack(data[:n_header]))
        if header["frame"] != FRAME_BITS:
            raise ValueError("frames of another size")
        self.n, self.zeros, self.docs, self.lists = header["n"], header["zeros"], header["docs"], header["lists"]
        self.bits, self.at = len(self.zeros), 24 + n_header + n_directory
        directory = np.frombuffer(self.unpack(data[n_header:]), "<i8").reshape(3, self.bits, -1)
        self.starts, self.sizes, self.ones = directory[0] + self.at + sum(self.lists), directory[1], directory[2]
        self.frame = lru_cache(KEPT)(self._frame)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, level: int, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack(self._bytes(int(self.starts[level][k]), int(self.sizes[level][k]))), np.uint8)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The document ids and token counts."""
        data, parts, at = self._bytes(self.at, sum(self.lists)), [], 0
        for n in self.lists:
            parts.append(np.frombuffer(self.unpack(data[at : at + n]), np.uint8))
            at += n
        known = np.unpackbits(parts[1], count=self.docs)
        return [int(d) if k else None for d, k in zip(parts[0].view("<i8"), known, strict=True)], parts[2].view("<i8")

    def matrix(self) -> WaveletMatrix:
        """All planes, read at once."""
        data, first = self._bytes(int(self.starts[0][0]), int(self.sizes.sum())) if self.n else b"", 0
        planes = []
        for sizes in self.sizes:
            ends = first + np.cumsum(sizes)
            planes.append(np.frombuffer(b"".join([self.unpack(data[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]), np.uint8))
            first = int(ends[-1]) if len(ends) else first
        return WaveletMatrix(self.n, planes, self.zeros)


def _written(batches: Iterator, folder: str, path: str, end: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    words, last = tokens.words_of(path), end.to_bytes(4, "little")
    shard, part, held, doc_ids, lengths, total = TaskContext.get().partitionId(), 0, [], [], [], 0

    def flushed() -> pa.RecordBatch:
        target = f"{folder}/shard-{shard:08d}-{part:05d}.wm"
        data = dumped(np.frombuffer(b"".join(held), "<u4"), doc_ids, lengths)
        with files.writing(target) as out:
            out.write(data)
        return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": target, "n_docs": len(doc_ids), "n_tokens": total}])

    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.packed(batch.column(1), words), strict=True):
            ids += last
            held.append(ids)
            doc_ids.append(doc_id)
            lengths.append(len(ids) // 4)
            total += len(ids) // 4
            if total >= SHARD_TOKENS:
                yield flushed()
                part, held, doc_ids, lengths, total = part + 1, [], [], [], 0
    if doc_ids:
        yield flushed()
    release()


def write_shards(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """Write all documents in ascending doc_id order; a stored row per shard file, whose name has its place."""
    folder, path = shared_folder(docs.sparkSession, "wavelet"), path or tokens.default_path()
    keyed = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    ordered = keyed.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(lambda b: _written(b, folder, path, end), MANIFEST), "wavelet-manifest")


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with files.random_access(path) as source:
                shard = ShardFile(source)
                (doc_ids, lengths), ids = shard.documents(), shard.matrix().decode().astype("<u4")
            at, crcs = 0, []
            for n in lengths.tolist():
                crcs.append(zlib.crc32(ids[at : at + n]))
                at += n
            starts = base + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, all from the shard files."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    parts = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return based.repartition(parts).mapInArrow(_read, SCHEMA)
