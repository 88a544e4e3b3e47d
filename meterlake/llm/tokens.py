"""Token ids of whole texts by a public byte-level BPE vocabulary, with a bounded memo of words.

The vocabulary's pattern always parts a text before a single space that stands between two
characters that are no white space, and around a lone line feed between such characters. So words
can be encoded once each: Arrow splits the texts, numbers their words and finds them in the memo;
new words go to the library together, one to a line, as the ids of a line feed tell them apart
again; the ids of the texts are gathered from those of the words. A text where a space has white
space beside it, or that begins with one, is encoded in the pieces between safe spaces instead. A
text with the string of a special token goes to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    import pyarrow as pa

VOCABULARY = "byte_bpe_50k.json"
#: Words whose ids a worker keeps, about 40 bytes each; when more come, those go that were not used in two groups of texts.
MEMO_WORDS = 300_000
#: Bytes of the texts whose words are looked up together, and words that go to the library as one text.
GROUP_BYTES, LINES = 2 << 20, 100
#: Characters of a piece of a text that is encoded apart from the memo.
PIECE = 4096
SAFE = re.compile(r"(?<=\S) (?=\S)")
# The characters of white space, as a class.
WHITE = "[\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LOOSE = f"^{WHITE}|{WHITE}$|^$"
MARKS = ".,;:!?'\"()[]{}<>#$%&*+-/=@^_`|~\\"
ENDING = "[\\p{L}\\p{N}]$"


class Words:
    """The ids of words with the space before them, kept as one array; a length of -1 marks a word that can't be encoded alone."""

    def __init__(self, vocabulary: str | bytes, plain: bool = False):
        import pyarrow as pa

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary) if isinstance(vocabulary, str) else Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.line,) = self.flat(["\n"])[0].tolist()
        self.words = pa.array([], pa.large_string())
        self.at, self.n, self.uses = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        self.first: dict[str, np.ndarray] = {}

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and how many each has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n

    def encode(self, text: str) -> np.ndarray:
        return self.flat([text])[0]

    def starts(self, heads: list[str]) -> list[np.ndarray]:
        """The ids of the first words of texts."""
        if len(self.first) > 50_000:
            self.first.clear()
        new = list({h for h in heads if h not in self.first})
        ids, n = self.flat(new)
        self.first.update(zip(new, np.split(ids, np.cumsum(n)), strict=False))
        return [self.first[h] for h in heads]

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The places of distinct words in the memo, which takes in those that are new."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.words) > MEMO_WORDS:
            self._forget()
        at, new = self._found(distinct)
        if len(new):
            at[at < 0] = self._added(new)
        self.uses[at] += 1
        return at

    def _found(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The places of words in the memo, and the words that it lacks."""
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.words)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), pc.filter(words, pc.is_null(found))

    def _added(self, new: pa.Array) -> np.ndarray:
        """The places of words that the memo now takes in; those of a word and marks after it are joined from both."""
        import pyarrow as pa
        import pyarrow.compute as pc

        heads = pc.utf8_rtrim(new, MARKS)
        n_marks = pc.subtract(pc.binary_length(new), pc.binary_length(heads)).to_numpy(zero_copy_only=False)
        marked = (n_marks > 0) & (n_marks < 9)
        some = heads.filter(pa.array(marked))
        marked[marked] = (pc.match_substring_regex(some, ENDING).to_numpy(zero_copy_only=False)) & ~(pc.match_substring_regex(some, WHITE).to_numpy(zero_copy_only=False))
        base = pc.if_else(pa.array(marked), heads, new).dictionary_encode()
        place, absent = self._found(base.dictionary)
        place[place < 0] = len(self.words) + np.arange(len(absent))
        self._learn(absent)
        at = place[base.indices.to_numpy()]
        if marked.any():
            words, after = new.filter(pa.array(marked)), n_marks[marked]
            tail = np.empty(len(words), np.int64)
            known: dict[str, int] = {}
            for k in np.unique(after).tolist():
                marks = pc.utf8_slice_codeunits(words.filter(pa.array(after == k)), -k).dictionary_encode()
                tail[after == k] = np.array([known.setdefault(x, len(known)) for x in marks.dictionary.to_pylist()])[marks.indices.to_numpy()]
            ids, n = self.flat(list(known))
            starts, sizes = np.empty(2 * len(words), np.int64), np.empty(2 * len(words), np.int64)
            starts[::2], sizes[::2] = self.at[at[marked]], self.n[at[marked]]
            starts[1::2], sizes[1::2] = (len(self.ids) + np.cumsum(n) - n)[tail], n[tail]
            joined, n = np.concatenate([self.ids, ids])[ragged(starts, sizes)], sizes[::2] + sizes[1::2]
            at[marked] = len(self.words) + np.arange(len(words))
            self._keep(words, len(self.ids) + np.cumsum(n) - n, n, [joined])
        return at

    def _keep(self, new: pa.Array, at: np.ndarray, n: np.ndarray, ids: list[np.ndarray]) -> None:
        import pyarrow as pa

        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, *ids])
        self.at, self.n = np.concatenate([self.at, at]), np.concatenate([self.n, n.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def _forget(self) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = (self.uses > 1).nonzero()[0]
        if 2 * len(kept) > MEMO_WORDS:
            kept = kept[:0]
        self.words = pc.take(self.words, pa.array(kept))
        self.ids = self.ids[ragged(self.at[kept], np.maximum(self.n[kept], 0))]
        self.n, self.uses = self.n[kept], np.zeros(len(kept), np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.maximum(self.n, 0), dtype=np.int64)])[: len(kept)]

    def _learn(self, new: pa.Array) -> None:
        """Take in words by the library."""
        import pyarrow.compute as pc

        at, n = np.zeros(len(new), np.int64), np.full(len(new), -1, np.int32)
        loose = pc.match_substring_regex(new, LOOSE).to_numpy(zero_copy_only=False)
        spaced = pc.match_substring_regex(new, WHITE).to_numpy(zero_copy_only=False) & ~loose
        feeds = pc.count_substring(new, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        if spaced.any():  # lone line feeds are safe, other white space goes alone
            spaced &= pc.match_substring_regex(new, f"{WHITE}{WHITE}|{WHITE.replace(chr(92) + 'n', '', 1)}").to_numpy(zero_copy_only=False)
        held, base = [], len(self.ids)
        for alone, which in ((False, (~loose & ~spaced).nonzero()[0]), (True, spaced.nonzero()[0])):
            words = new.take(which).to_pylist() if len(which) else []
            if alone:
                ids, sizes = self.flat([" " + w for w in words])
                starts = np.cumsum(sizes) - sizes
            else:
                ids, _ = self.flat(["".join(["\n " + w for w in words[k : k + LINES]]) for k in range(0, len(words), LINES)])
                lines = (ids == self.line).nonzero()[0]
                if len(lines) != len(words) + feeds[which].sum():
                    raise ValueError("the vocabulary does not keep line feeds apart")
                starts = lines[np.cumsum(1 + feeds[which]) - 1 - feeds[which]]
                sizes = np.diff(np.append(starts, len(ids))) - 1
                starts = starts + 1
            at[which], n[which] = base + starts, sizes
            held.append(ids)
            base += len(ids)
        self._keep(new, at, n, held)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    lengths = lengths.astype(np.int64)
    after = np.cumsum(lengths)
    return np.repeat(starts - after + lengths, lengths) + np.arange(after[-1] if len(after) else 0)


@lru_cache(maxsize=2)
def words_of(vocabulary: str | bytes, plain: bool = False) -> Words:
    """A worker's memo for a vocabulary, given by its path or its bytes; if ``plain``, strings of special tokens are text."""
    return Words(vocabulary, plain)


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(texts: pa.Array, words: Words, follows: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of whole texts, some texts at a time: all their ids, and where each text's begin and the last's end.

    If ``follows``, each text is encoded with a space before it.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast("large_string"), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES)))
        if ends[stop - 1] - before > 2 * GROUP_BYTES:  # one long text, in parts
            text = texts[at].as_py()
            if any(s in text for s in words.special):
                ids = words.encode(" " * follows + text)
            else:
                parts = enumerate(pieces(text, GROUP_BYTES))
                ids = np.concatenate([_encoded(pa.array([p], pa.large_string()), words, follows or k > 0)[0] for k, p in parts])
            yield ids, np.array([0, len(ids)])
        else:
            yield _encoded(texts.slice(at, stop - at), words, follows)
        at = stop


def packed(texts: pa.Array, words: Words) -> Iterator[bytes]:
    """The ids of each text, 4 little-endian bytes an id; null is the empty text."""
    for ids, at in encoded(texts, words):
        data, bounds = ids.tobytes(), (4 * at).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield data[a:b]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of a text of about ``size`` characters; the space between two is left out."""
    at = 0
    while (cut := SAFE.search(text, at + size)) is not None:
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _encoded(texts: pa.Array, words: Words, follows: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, and their bounds; such as follow a safe space begin with that."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, " ")
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = split.flatten()
    numbered = flat.dictionary_encode()
    number = numbered.indices.to_numpy(zero_copy_only=False)
    own = np.ones(len(number), bool)
    own[first[:-1]] = follows
    used = np.zeros(len(numbered.dictionary), bool)
    used[number[own]] = True
    place = np.zeros(len(used), np.int64)
    place[used] = words.numbers(numbered.dictionary.filter(pa.array(used)))
    starts, lengths = np.zeros(len(number), np.int64), np.zeros(len(number), np.int32)
    known = place[number[own]]
    starts[own], lengths[own] = words.at[known], words.n[known]
    odd = np.add.reduceat(lengths < 0, first[:-1]) > 0
    heads = [] if follows else flat.take(first[:-1]).to_pylist()
    odd |= np.array([not h or h[-1].isspace() for h in heads] if heads else [False] * len(texts), bool)
    special = np.zeros(len(texts), bool)
    for token in words.special:
        special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    odd |= special
    lengths[np.repeat(odd, np.diff(first))] = 0
    begin = words.starts(["" if o else h for h, o in zip(heads, odd.tolist(), strict=True)]) if heads else [words.ids[:0]] * len(texts)
    for k in odd.nonzero()[0].tolist():  # the ids of such a text come in the place of those of its first word
        text = texts[k].as_py()
        begin[k] = words.encode(" " * follows + text) if special[k] else words.flat([" " * (j > 0 or follows) + p for j, p in enumerate(pieces(text))])[0]
    n = np.fromiter(map(len, begin), np.int64, len(begin))
    put = n > 0
    starts[first[:-1][put]], lengths[first[:-1][put]] = (len(words.ids) + np.cumsum(n) - n)[put], n[put]
    after = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return np.concatenate([words.ids, *begin])[ragged(starts, lengths)], after[first]
