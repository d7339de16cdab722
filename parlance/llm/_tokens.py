"""Byte-level BPE ids for whole batches of texts, by the tokenizers library.

Byte-level BPE first cuts a text into words and never merges across a cut, so
the ids of a text are the ids of its chunks one after the other. A chunk here
is a word with the single space before it: a cut before a space that is followed
by a non-space character is always one of the tokenizer's own cuts. Each worker
keeps the words it has met, so the library sees a word once, not once per use.
The memory is bounded: the store starts anew beyond ``MAX_PIECES`` pieces.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of chunks (words, marks) that one Python worker remembers before it starts anew.
MAX_PIECES = 600_000
END_ID = 0

_UNSAFE = re.compile(r" (?:\s|\Z)")
#: The same for pyarrow's expressions, or more: a text that is taken for unsafe without need is only slower.
_UNSAFE_ARROW = r" ([\s\p{Z}\x{1c}-\x{1f}\x{85}]|\z)"
_MARKS = ",.;:!?*%&$#|"
_JOIN = 256


class _Table:
    """Growing arrays of numbers, one row per key."""

    def __init__(self, columns: int):
        self.rows = np.zeros((columns, 1 << 16), np.int64)
        self.used = 0

    def add(self, values: np.ndarray) -> None:
        n = values.shape[1]
        if self.used + n > self.rows.shape[1]:
            self.rows = np.concatenate((self.rows[:, : self.used], np.zeros((len(self.rows), max(self.used, 2 * n)), np.int64)), axis=1)
        self.rows[:, self.used : self.used + n] = values
        self.used += n


class BatchTokenizer:
    """Ids of whole texts; ``encode`` returns flat uint32 ids and a length per text.

    A chunk is one or two pieces (a word of letters, and the marks after it);
    a piece is a run in the flat array of ids. Piece 0 is empty.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; more threads only cost time on others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: Added tokens that stand for themselves wherever they occur cut a text; others leave it to the library whole.
        self.cuts = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added)
        self.added_token = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.opens_word = np.zeros(self.size, bool)
        for token, i in vocabulary.items():
            self.opens_word[i] = token.startswith("Ġ")
        self._reset()

    def _reset(self) -> None:
        # Key: a word of letters (it has a space before it), or "\1" and the text as it is.
        self.pieces: dict[str, int] = {"": 0}
        self.spans = _Table(2)
        self.spans.used = 1
        self.flat = _Table(1)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: list[str], ids: list[list[int]]) -> None:
        """Remembers pieces and their ids."""
        if keys:
            self._add_flat(keys, np.array([i for x in ids for i in x], np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _add_flat(self, keys: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.pieces.update(zip(keys, range(self.spans.used, self.spans.used + len(keys)), strict=True))
        self.spans.add(np.stack((self.flat.used + np.cumsum(lengths) - lengths, lengths)))
        self.flat.add(flat[None])

    def _words(self, words: list[str]) -> None:
        """Remembers words of letters: many in one call, told apart by the ids that open a word."""
        groups = [words[at : at + _JOIN] for at in range(0, len(words), _JOIN)]
        odd: list[str] = []
        for group, ids in zip(groups, self._library([" " + " ".join(g) for g in groups]), strict=True):
            flat = np.array(ids, np.int64)
            cuts = np.flatnonzero(self.opens_word[flat])
            if len(cuts) == len(group):
                self._add_flat(group, flat, np.diff(np.append(cuts, len(flat))))
            else:
                odd += group
        self._add(odd, self._library([" " + w for w in odd]))

    def _known(self, keys: pa.Array, words: bool = False) -> np.ndarray:
        """Pieces of many keys, all words or all other texts; fresh ones are learnt."""
        told = keys.dictionary_encode()
        names = told.dictionary.to_pylist()
        got = np.fromiter(map(self.pieces.get, names, repeat(-1)), np.int64, len(names))
        at = np.flatnonzero(got < 0)
        fresh = [names[i] for i in at.tolist()]
        if fresh and words:
            self._words(fresh)
        elif fresh:
            self._add(fresh, self._library([x[1:] for x in fresh]))
        got[at] = np.fromiter(map(self.pieces.__getitem__, fresh), np.int64, len(fresh))
        return got[np.asarray(told.indices)]

    def _parts(self, chunks: pa.Array) -> np.ndarray:
        """The two pieces of each chunk: a word of letters and the marks after it, or the whole chunk and the empty piece.

        A chunk is given without the space before it; "\0" marks one that has none.
        """
        words = pc.utf8_rtrim(chunks, characters=_MARKS)
        letters = pc.utf8_is_alpha(words)
        out, plain = np.zeros((2, len(chunks)), np.int64), np.asarray(letters)
        marked = np.asarray(pc.and_(letters, pc.not_equal(pc.binary_length(words), pc.binary_length(chunks))))
        join = lambda *parts: pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in parts], pa.scalar("", pa.large_string()))
        out[0, plain] = self._known(words.filter(letters), words=True)
        if marked.any():
            out[1, marked] = self._known(join("\1", pc.replace_substring_regex(chunks.filter(pa.array(marked)), f"^[^{_MARKS}]+", "")))
        if not plain.all():
            rest = chunks.filter(pa.array(~plain))
            out[0, ~plain] = self._known(join("\1", pc.if_else(pc.starts_with(rest, "\0"), pc.utf8_slice_codeunits(rest, 1), join(" ", rest))))
        return out

    def _chunks(self, text: str) -> list[str]:
        if "\0" in text:  # the mark below must stay ours
            return ["\0" + text]
        if self.added_token and self.added_token.search(text):
            if not self.cuts:
                return ["\0" + text]
            around = self.added_token.split(text)
            return [c for k, x in enumerate(around) if x for c in (["\0" + x] if k % 2 else self._chunks(x))]
        parts = text.split(" ")
        if _UNSAFE.search(text):
            whole, parts = parts, []
            for p in whole:
                if parts and (not p or p[0].isspace()):
                    parts[-1] += " " + p
                else:
                    parts.append(p)
        parts[0] = "\0" + parts[0]
        return parts

    def _coded(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two pieces of each distinct chunk, the chunks of all texts as places among these, and how many chunks each text has.

        Ordinary texts are cut and their chunks told apart by pyarrow; only a batch's distinct
        words are looked up here. Texts with runs of white space or with added tokens of the vocabulary (which
        the library takes as they are, and which cut a text) are cut one by one.
        """
        if len(self.pieces) > MAX_PIECES:
            self._reset()
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        column = pc.fill_null(column.cast(pa.large_string()), "")
        odd = np.asarray(pc.or_(pc.match_substring_regex(column, _UNSAFE_ARROW), pc.match_substring(column, "\0")))
        for token in self.added:
            odd = odd | np.asarray(pc.match_substring(column, token))
        some = np.asarray(pc.binary_length(column)) > 0
        counts = np.zeros(len(column), np.int64)
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), column.filter(pa.array(~odd & some)), pa.scalar("", pa.large_string()))
        chunks = pc.split_pattern(marked, " ")
        counts[~odd & some] = np.asarray(pc.list_value_length(chunks))
        told = chunks.flatten().dictionary_encode()
        pieces, codes = self._parts(told.dictionary), np.asarray(told.indices)
        if odd.any():
            lists = [self._chunks(x) for x in column.filter(pa.array(odd)).to_pylist()]
            counts[odd] = [len(x) for x in lists]
            own = np.repeat(odd, counts)
            told = pa.array([c for x in lists for c in x], pa.large_string()).dictionary_encode()
            every = np.empty(len(own), codes.dtype)
            every[~own], every[own] = codes, np.asarray(told.indices) + pieces.shape[1]
            pieces, codes = np.concatenate((pieces, self._parts(told.dictionary)), axis=1), every
        return pieces, codes, counts

    def cut(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, two of each chunk, and how many chunks each text has."""
        pieces, codes, counts = self._coded(texts)
        return pieces[:, codes], counts

    def encode(self, texts: pa.Array | list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and a length per text; null is an empty text. ``end`` is appended to each text.

        The ids of a batch's distinct chunks are put together once, so each use of a chunk is one run.
        """
        pieces, codes, counts = self._coded(texts)
        begins, lengths = self.spans.rows[:, pieces.T.ravel()]
        own = self.flat.rows[0][_runs(begins, lengths)].astype(np.uint32)
        sizes = (lengths[::2] + lengths[1::2]).astype(np.int32)
        if end is not None:  # the end is one more chunk, after each text's own
            own, sizes = np.append(own, np.uint32(end)), np.append(sizes, np.int32(1))
            every = np.full(len(codes) + len(counts), len(sizes) - 1, np.int32)
            last = np.zeros(len(every), bool)
            last[np.cumsum(counts + 1) - 1] = True
            every[~last] = codes
            codes, counts = every, counts + 1
        begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        lengths = sizes[codes]
        total = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
        return own[_runs(begins[codes], lengths)], np.diff(total, prepend=0)


def _runs(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(lengths, dtype=begins.dtype)
    return np.arange(ends[-1] if len(ends) else 0, dtype=begins.dtype) + np.repeat(begins - (ends - lengths), lengths)


_kept: dict[str, BatchTokenizer] = {}


def release() -> None:
    """Gives back the chunks of earlier work: a Python worker goes on to other operators' tasks, which need the memory."""
    _kept.clear()


def tokenizer(path: str) -> BatchTokenizer:
    """This worker's tokenizer for a vocabulary file."""
    if path not in _kept:
        _kept[path] = BatchTokenizer(path)
    return _kept[path]
