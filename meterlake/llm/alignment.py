"""Alignment of two tokenizers over whole texts: groups of tokens between common ends, and which ids meet.

A is a byte-level BPE vocabulary over a space and the text, B a SentencePiece model over the text,
to which it adds that space itself. Texts of an Arrow batch lie one after the other in one run of
bytes, each document at its offset. The ends of all A and of all B tokens are counted at their byte
once (``bincount``); where both have an end, groups are cut. Prefix sums over those counts number
tokens, groups and links, and their differences at the documents' offsets are the documents' own.
Between two neighbouring ends of either side exactly one A and one B token overlap, and no two such
stretches have the same two, so those stretches are the links.

How often ids are linked in the whole corpus grows with the corpus. Some texts of a task together
make a chunk, a row of a stored table: its distinct pairs of ids, and for each link which of them it
is. Spark sums the pairs of all chunks by key, each chunk gets back the sums of its own pairs, and
counts its documents' links with them; no task holds the table of all pairs. The best count of a B id
is broadcast, as there are no more of them than the model has pieces.

Defined results: null and empty texts, and those whose tokens' bytes are not those of a space and the
text (a literal U+2581, characters that the model normalizes), have no tokens: zeros and an empty
digest. Strings of special tokens are plain text. Repeated rows count each by itself; a null doc_id is
kept; an empty table gives no rows; other columns are ignored. A text of any length is aligned whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import lookup, release, slices, stored
from meterlake.llm.tokens import VOCABULARY, default_path, encoded, ragged, words_of

if TYPE_CHECKING:
    import pyarrow as pa

MODEL = "piece_bpe_32k.model"
#: Bytes of texts that are aligned together, and of those that make a chunk; a longer text is one by itself.
GROUP_BYTES, CHUNK_BYTES = 2 << 20, 4 << 20


class Table:
    """The bytes of all tokens of a vocabulary, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.start[ids], self.length[ids])]


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of a worker, from the bytes of their files."""

    def __init__(self, vocabulary: bytes, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.words = words_of(vocabulary, True)
        letters = byte_letters()
        size = self.words.tokenizer.get_vocab_size()
        names = [self.words.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.a = Table([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        self.pieces = SentencePieceProcessor(model_proto=model)
        self.n_pieces = self.pieces.get_piece_size()
        self.b = Table([self._piece(i) for i in range(self.n_pieces)])
        self.pair = np.uint32 if size * self.n_pieces < 1 << 32 else np.int64
        self.decimal = np.zeros((max(size, self.n_pieces), 7), np.uint8)
        digits = [str(i).encode() for i in range(len(self.decimal))]
        self.n_digits = np.array([len(d) for d in digits])
        for i, d in enumerate(digits):
            self.decimal[i, : len(d)] = np.frombuffer(d, np.uint8)

    def _piece(self, i: int) -> bytes:
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace("▁", " ").encode()

    def a_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        parts = list(encoded(texts, self.words, follows=True))
        return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([np.diff(p[1]) for p in parts])

    def b_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for the model, which no piece carries over the space before a word: distinct words are encoded once.

        Texts with a space at an end or beside another go to the library whole.
        """
        import pyarrow.compute as pc

        split = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(per_text) - per_text
        numbered = split.flatten().dictionary_encode()
        number = numbered.indices.to_numpy(zero_copy_only=False)
        lists = self.pieces.encode(numbered.dictionary.to_pylist(), num_threads=1)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        lengths = n[number]
        loose = np.add.reduceat(lengths == 0, first) > 0
        lengths[np.repeat(loose, per_text)] = 0
        starts = (np.cumsum(n) - n)[number]
        whole = self.pieces.encode(texts.filter(loose).to_pylist(), num_threads=1) if loose.any() else []
        of_whole = np.fromiter(map(len, whole), np.int64, len(whole))
        starts[first[loose]], lengths[first[loose]] = n.sum() + np.cumsum(of_whole) - of_whole, of_whole
        ids = np.fromiter(chain(chain.from_iterable(lists), chain.from_iterable(whole)), np.int64, int(n.sum() + of_whole.sum()))
        return ids[ragged(starts, lengths)], np.add.reduceat(lengths, first)


@lru_cache(maxsize=1)
def tokenizers(vocabulary: bytes, model: bytes) -> Tokenizers:
    return Tokenizers(vocabulary, model)


class Aligned(NamedTuple):
    """Some texts one after the other; ``rows`` tells which of those given have tokens. Offsets of those are in bytes, links, tokens and cuts."""

    rows: np.ndarray
    at: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    #: The bytes at which groups end, and how many A and B tokens end up to there.
    cuts: np.ndarray
    a_cum: np.ndarray
    b_cum: np.ndarray
    #: The A and the B token of each link, and the number of links, A and B tokens and groups before each text.
    links: tuple[np.ndarray, np.ndarray]
    before: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _content(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts, each after a space."""
    import pyarrow as pa
    import pyarrow.compute as pc

    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(empty, texts, space)
    return np.frombuffer(spaced.buffers()[2], np.uint8)[: int(pc.sum(pc.binary_length(spaced)).as_py() or 0)]


def aligned(texts: pa.Array, both: Tokenizers) -> Aligned:
    """Texts, none of them null or empty, cut where tokens of both end."""
    import pyarrow.compute as pc

    rows = np.arange(len(texts))
    (a, n_a), (b, n_b) = both.a_ids(texts), both.b_ids(texts)
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    content = _content(texts)

    def chosen(good: np.ndarray) -> None:
        nonlocal rows, a, b, n_a, n_b, content, size
        if not good.all():
            a, b, content = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], content[np.repeat(good, size)]
            rows, n_a, n_b, size = rows[good], n_a[good], n_b[good], size[good]

    def per_text(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        after = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(n)
        return after[ends] - after[ends - n]

    chosen((per_text(both.a.length[a], n_a) == size) & (per_text(both.b.length[b], n_b) == size))
    for table, of in ((both.a, "a"), (both.b, "b")):
        chosen(per_text(table.joined(a if of == "a" else b) != content, size) == 0)
    at = np.concatenate([[0], np.cumsum(size)])
    a_ends, b_ends = np.cumsum(both.a.length[a]), np.cumsum(both.b.length[b])
    in_a, in_b = (np.bincount(x, minlength=at[-1] + 1).astype(np.int8) for x in (a_ends, b_ends))
    a_sum, b_sum = np.cumsum(in_a, dtype=np.int64), np.cumsum(in_b, dtype=np.int64)
    ends, cuts = (in_a | in_b).nonzero()[0], (in_a & in_b).nonzero()[0]
    before = (np.searchsorted(ends, at, "right"), a_sum[at], b_sum[at], np.searchsorted(cuts, at, "right"))
    return Aligned(rows, at, a, b, a_ends, b_ends, cuts, a_sum[cuts], b_sum[cuts], (a_sum[ends - 1], b_sum[ends - 1]), before)


def digests(found: Aligned, both: Tokenizers) -> list[str]:
    """For each text the hash of its groups as ``a1,a2|b1;a3|b2,b3``."""
    if not len(found.rows):
        return []
    a_before, b_before = np.concatenate([[0], found.a_cum[:-1]]), np.concatenate([[0], found.b_cum[:-1]])
    n_a, n_b = found.a_cum - a_before, found.b_cum - b_before
    ids, mark = np.empty(len(found.a) + len(found.b), np.int64), np.full(len(found.a) + len(found.b), ord(","), np.uint8)
    ids[np.arange(len(found.a)) + np.repeat(b_before, n_a)] = found.a
    ids[np.arange(len(found.b)) + np.repeat(found.a_cum, n_b)] = found.b
    mark[found.a_cum + b_before - 1], mark[found.a_cum + found.b_cum - 1] = ord("|"), ord(";")
    n = both.n_digits[ids]
    letters = both.decimal[ids]
    letters[np.arange(len(ids)), n] = mark
    flat = letters[np.arange(letters.shape[1]) <= n[:, None]]
    after = np.concatenate([[0], np.cumsum(n + 1)])[found.before[1] + found.before[2]].tolist()
    return [hashlib.sha256(flat[i : j - 1]).hexdigest() for i, j in zip(after, after[1:], strict=False)]


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded bytes, or of one long text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES)))
        yield at, stop
        at = stop


def _some(batches: Iterator, both: Tokenizers) -> Iterator[tuple[pa.Array, np.ndarray, Aligned | None]]:
    """doc_ids of some documents, which of them have a text, and these aligned."""
    import pyarrow.compute as pc

    for batch in slices(batches, 2000):
        texts = batch.column(1).cast("large_string")
        for at, stop in _groups(texts):
            some = texts.slice(at, stop - at)
            filled = pc.fill_null(pc.greater(pc.binary_length(some), 0), False)
            yield batch.column(0).slice(at, stop - at), filled.to_numpy(zero_copy_only=False).nonzero()[0], aligned(some.filter(filled), both) if pc.any(filled).as_py() else None


CHUNK = "chunk string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, counts binary, links binary"


def _chunked(batches: Iterator, both: Tokenizers) -> Iterator:
    """Chunks of documents: a pair of ids is ``a * pieces + b``; ``links`` are places in the chunk's sorted distinct pairs, in the order of documents."""
    import pyarrow as pa

    held: list[tuple[pa.Array, np.ndarray, list[str], np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        numbered = pa.array(np.concatenate([h[3] for h in held])).dictionary_encode()
        pairs, places = numbered.dictionary.to_numpy(), numbered.indices.to_numpy()
        order = np.argsort(pairs)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs, places = pairs[order], rank[places]
        counts = np.bincount(places, minlength=len(pairs))
        numbers = np.concatenate([h[1] for h in held], axis=1)
        columns = [pa.concat_arrays([h[0] for h in held]), *map(pa.array, numbers), pa.array(list(chain.from_iterable(h[2] for h in held)), pa.string())]
        offsets = pa.array([0, len(columns[0])], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, c) for c in columns]
        blobs = [pairs.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), pa.compress(places.astype("<u4").tobytes(), codec="zstd", asbytes=True)]
        names = [c.split(" ")[0] for c in CHUNK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *[pa.array([b], pa.binary()) for b in blobs]], names)

    for ids, filled, found in _some(batches, both):
        numbers, hashes, pairs = np.zeros((4, len(ids)), np.int64), [""] * len(ids), np.empty(0, both.pair)
        if found is not None:
            rows = filled[found.rows]
            links, *rest = found.before
            numbers[:, rows] = np.stack([np.diff(x) for x in (*rest, links)])
            for k, h in zip(rows.tolist(), digests(found, both), strict=True):
                hashes[k] = h
            pairs = (found.a[found.links[0]] * both.n_pieces + found.b[found.links[1]]).astype(both.pair)
            size += int(found.at[-1])
        held.append((ids, numbers, hashes, pairs))
        size += 64 * len(ids)
        if size >= CHUNK_BYTES:
            yield out()
            held, size = [], 0
            release()
    if held:
        yield out()


def _files(docs: DataFrame, vocabulary: str | None, model: str | None):
    """Both files' bytes, broadcast, as executors may not see the driver's paths."""
    from pathlib import Path

    paths = (vocabulary or default_path(VOCABULARY), model or default_path(MODEL))
    return docs.sparkSession.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in paths))


def chunks(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Stored: a row for each chunk of documents."""
    files = _files(docs, vocabulary, model)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(given.mapInArrow(lambda b: _chunked(b, tokenizers(*files.value)), CHUNK), "aligned")


def _unpacked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for chunk, pairs, counts in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            codes = np.frombuffer(pairs, "<i8")
            yield pa.RecordBatch.from_arrays([pa.repeat(chunk, len(codes)), pa.array(codes), pa.array(np.frombuffer(counts, "<i8"))], ["chunk", "pair", "n"])


def linked_ids(pairs: DataFrame, n_pieces: int) -> DataFrame:
    """Each linked pair of ids: how many links it has, whether no other A id has more with its B id, and in how many chunks it is."""
    totals = stored(pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).withColumn("b_id", F.pmod("pair", F.lit(n_pieces))), "id-pairs")
    best = totals.groupBy("b_id").agg(F.max("n").alias("most"))  # no more rows than the model has pieces
    return totals.join(F.broadcast(best), "b_id").select("pair", F.col("n").alias("total"), (F.col("n") == F.col("most")).alias("best"), "chunks")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(chunk: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of one chunk, with the sums of its pairs."""
    import pyarrow as pa

    (row,) = chunk.to_pylist()
    known = sums.sort_by("pair")
    total, best = known.column("total").to_numpy(), known.column("best").to_numpy().astype(np.int64)
    ends = np.cumsum(row["n_links"])
    places = np.frombuffer(pa.decompress(row["links"], decompressed_size=4 * int(ends[-1]), codec="zstd"), "<u4") if ends[-1] else np.empty(0, np.uint32)
    sums_to = [np.concatenate([[0], np.cumsum(x[places])])[np.concatenate([[0], ends])] for x in (best, total)]
    n_best, count_sum = (np.diff(x) for x in sums_to)
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum, row["groups_sha256"]]
    return pa.table([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(columns)], names=[c.split(" ")[0] for c in RESULT.split(", ")])


def alignment(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row per document: its tokens, groups and links, and how its links stand in the whole corpus."""
    from sentencepiece import SentencePieceProcessor

    n_pieces = SentencePieceProcessor(model_file=model or default_path(MODEL)).get_piece_size()
    parts = chunks(docs, vocabulary, model)
    pairs = parts.select("chunk", "pairs", "counts").mapInArrow(_unpacked, "chunk string, pair long, n long")
    known = linked_ids(pairs, n_pieces)
    n_pairs = parts.agg(F.sum(F.length("pairs"))).first()[0] or 0
    sums = lookup(pairs.select("pair", "chunk"), known, "pair", "chunks", n_pairs // 8).select("chunk", "pair", "total", "best")
    return parts.drop("pairs", "counts").groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(lambda x, y: _counted(x, y), RESULT)


def _listed(batches: Iterator, both: Tokenizers) -> Iterator:
    import pyarrow as pa

    for ids, filled, found in _some(batches, both):
        if found is None:
            continue
        rows = filled[found.rows]
        per_text = np.diff(found.before[3])
        first = np.concatenate([[0], found.cuts[:-1]])
        start = np.repeat(found.at[:-1], per_text)
        sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cum]), pa.int32()), pa.array(x)) for cum, x in ((found.a_cum, found.a), (found.b_cum, found.b))]
        number = np.arange(len(found.cuts)) - np.repeat(found.before[3][:-1], per_text)
        doc = ids.take(pa.array(np.repeat(rows, per_text)))
        yield pa.RecordBatch.from_arrays([doc, pa.array(number), pa.array(first - start), pa.array(found.cuts - start), *sides], ["doc_id", "place", "start", "end", "a_ids", "b_ids"])


def groups(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """One row per group: its place in the document, its bytes in space and text, and its ids of both tokenizers."""
    files = _files(docs, vocabulary, model)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return given.mapInArrow(lambda b: _listed(b, tokenizers(*files.value)), "doc_id long, place long, start long, end long, a_ids array<long>, b_ids array<long>")
