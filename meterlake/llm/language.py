"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a logistic classifier over hashed byte
n-grams predicts the bit; decoding weighs each classifier's loss by how well it did on the
language and takes the codeword of the least total loss. A small gap to the second-best codeword
flags the answer as ambiguous.

Only the classifiers are fitted on a bounded sample of the labelled rows, at most about
``MAX_TRAINING_ROWS`` in all, shared evenly by the languages; whole texts are used throughout.

Defined results: null text or one without a letter gives ``und`` and score 0; repeated rows are
judged alike; ties between codewords go to the first language by name; an empty table gives no
rows; with no labelled rows every text is ``und``; a null doc_id is not held out and no training
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import slices

UNKNOWN = "und"
MAX_TRAINING_ROWS = 4000
BUCKETS = 2048
#: Bytes folded at a time, so that a very long text needs no more memory than a short one.
SLICE = 1 << 20
#: Mean loss by which the best codeword must lead the second.
AMBIGUOUS_BELOW = 0.05
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, lang_second string, ambiguous boolean"


def _folding() -> np.ndarray:
    fold = np.full(256, 32, np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    fold[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return fold


FOLD = _folding()


def folded(data: bytes, before: int = 0, space: bool = False) -> np.ndarray:
    """Lower-case letters with one space for each run of other ASCII; ``before`` is the byte before, ``space`` if it gave one."""
    given = np.frombuffer(data, np.uint8)
    b = FOLD[given]
    previous = np.concatenate([[np.uint8(before)], given[:-1]])
    b[(b >= 0x80) & (b < 0x9F) & (previous == 0xC3)] += 0x20  # capital Latin-1 letters in UTF-8
    blank = b == 32
    return b[~(blank & np.concatenate([[space], blank[:-1]]))]


def features(text: str) -> np.ndarray:
    """Shares of the hashed bigrams, trigrams and 4-grams of the folded bytes."""
    data = b" " + text.encode("utf-8", "replace") + b" "
    counts, tail, n = np.zeros(BUCKETS, np.int64), np.empty(0, np.uint32), 0
    for at in range(0, len(data), SLICE):
        new = folded(data[at : at + SLICE], data[at - 1] if at else 0, bool(len(tail)) and tail[-1] == 32)
        n += len(new)
        b = np.concatenate([tail, new.astype(np.uint32)])
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(8191) + b[2:] * np.uint32(131)
        for k, grams in ((1, two), (2, three), (3, three[:-1] * np.uint32(31) + b[3:])):
            new_ones = grams[max(0, len(tail) - k) :]  # those that end in this slice
            counts += np.bincount((new_ones * np.uint32(2654435761)) >> np.uint32(21), minlength=BUCKETS)
        tail = b[-3:]
    total = counts.sum()
    return np.sqrt(counts / total).astype(np.float32) if n > 3 else np.zeros(BUCKETS, np.float32)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords: every way to part up to five languages, else dense codes kept far apart."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if row == 0 or (b >> (row - 1)) & 1 else -1 for b in range(bits)] for row in range(n)], np.float32)
    rng, length, best, apart = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, length))
        near = (length - code @ code.T) / 2
        distance = near[~np.eye(n, dtype=bool)].min()
        if distance > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, distance
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of every codeword for each row of features."""
        margins = np.c_[x, np.ones(len(x), np.float32)] @ self.weights
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)


def _trained(x: np.ndarray, labels: np.ndarray, n: int, rounds: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, ...]:
    """Logistic classifiers of all bits by accelerated gradient steps; rows of each language weigh alike."""
    code = codewords(n)
    x = np.c_[x, np.ones(len(x), np.float32)]
    y = code[labels]
    weight = (1.0 / (n * np.bincount(labels, minlength=n)[labels])).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    step, before = 2.0, w
    for k in range(rounds):
        ahead = w + (k / (k + 3)) * (w - before)
        slope = x.T @ (-y * weight / (1 + np.exp(np.clip(y * (x @ ahead), -30, 30)))) + ridge * ahead
        before, w = w, ahead - step * slope
    right = ((x @ w) * y > 0).astype(np.float32)
    trust = np.stack([right[labels == k].mean(axis=0) for k in range(n)]) + 1e-3
    return code, w, trust / trust.sum(axis=1, keepdims=True)


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model | None:
    """Fit on labelled documents that are not held out."""
    import pyarrow as pa

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return None
    share = max(1, max_rows // len(names))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    bound = F.create_map(*[F.lit(v) for k in names for v in (k, int(min(1.0, share / counts[k]) * (1 << 20)))])
    sample = known.where(chosen < F.element_at(bound, F.col("lang"))).select("lang", F.col("text").cast("string").alias("text"))

    def measured(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            rows = [features(t).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])

    got = sample.mapInArrow(measured, "lang string, x binary").toArrow()
    labels = np.array([names.index(v) for v in got.column("lang").to_pylist()], np.int64)
    seen = sorted(set(labels.tolist()))
    if not seen:
        return None
    x = np.stack([np.frombuffer(v, np.float16) for v in got.column("x").to_pylist()]).astype(np.float32)
    code, weights, trust = _trained(x, np.searchsorted(seen, labels), len(seen))
    return Model(tuple(names[k] for k in seen), code, weights.astype(np.float32), trust.astype(np.float32))


def _judged(batches: Iterator, model: Model | None) -> Iterator:
    import pyarrow as pa
    import regex

    letter = regex.compile(r"\p{L}").search
    for rows in slices(batches):
        part = rows.column(2).to_pylist()
        known = np.array([model is not None and t is not None and letter(t) is not None for t in part])
        pred, score = [UNKNOWN] * len(part), [0.0] * len(part)
        second, unsure = [None] * len(part), [True] * len(part)
        if known.any():
            where = known.nonzero()[0]
            loss = model.losses(np.stack([features(part[i]) for i in where]))
            order = np.argsort(loss, axis=1, kind="stable")
            odds = np.exp((loss.min(axis=1, keepdims=True) - loss) * model.code.shape[1])
            odds = odds.max(axis=1) / odds.sum(axis=1)
            for row, i in enumerate(where.tolist()):
                best = order[row]
                pred[i], score[i] = model.languages[best[0]], float(odds[row])
                unsure[i] = False
                if len(best) > 1:
                    second[i] = model.languages[best[1]]
                    unsure[i] = bool(loss[row, best[1]] - loss[row, best[0]] < AMBIGUOUS_BELOW)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(pred), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(unsure)],
            ["doc_id", "held_out", "lang_pred", "score", "lang_second", "ambiguous"],
        )


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of every text; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return given.mapInArrow(lambda b: _judged(b, shared.value), SCHEMA)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose language is known and not ambiguous, with their own columns."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def chosen(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            n = batch.num_rows
            keyed = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), batch.column(columns.index("text"))], ["a", "b", "c"])
            keep = [p != UNKNOWN and not u for out in _judged([keyed], shared.value) for p, u in zip(out.column(2).to_pylist(), out.column(5).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(chosen, docs.schema)
