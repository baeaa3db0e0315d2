"""Byte-level BPE by dynamic programming over prefixes.

For a vocabulary of ranks, every prefix of a word has exactly one valid last
token: the last one of the prefix's own encoding. Token ``t`` ends the prefix
of ``i`` bytes if its bytes end there and it may follow the last token ``s``
of the prefix before it, which is so when the bytes of ``s`` and ``t`` together
encode to just these two. Keeping the last token of every prefix makes

* encoding one pass over the bytes, the ids being read from the end;
* appending exact: only the new bytes are worked on;
* edits local: prefixes before the edit stay, and words behind it are reused
  from the first word border that both versions share.

Texts are split into words by a pattern first, and each word is encoded by
itself; a word that is itself a token of the vocabulary is that token.
"""

from __future__ import annotations

import base64
import struct
import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import plain_names

#: How far behind its end the border of a word can depend on the text: a contraction of three, or a blank and the next character.
REACH = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by rank, with the memory of which token may follow which."""

    def __init__(self, ranks: dict[bytes, int], pairs: int = 500_000):
        self.ranks, self.pairs = ranks, pairs
        self.bytes_of = {i: t for t, i in ranks.items()}
        # tokens whose bytes do not encode to themselves can only be whole words, never parts of one
        inner = {t: i for t, i in ranks.items() if len(t) == 1 or self.merged(t) == [i]}
        if any(bytes([b]) not in inner for b in range(256)):
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        # finds all inner tokens in a word, those that end at the same byte longest first; bytes are given as Latin-1
        self.found = ahocorasick.Automaton()
        for token, i in inner.items():
            self.found.add_word(token.decode("latin-1"), (i, len(token)))
        self.found.make_automaton()
        self.longest = max(map(len, inner))
        self._may_follow: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes, border: int = -1) -> list[int]:
        """Ids by the definition: the adjacent pair of least rank, leftmost first, is joined until none is left.

        Ends with an empty list as soon as a join crosses ``border``.
        """
        rank, none = self.ranks.get, 1 << 32
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [rank(piece[k : k + 2], none) for k in range(len(piece) - 1)]
        cross = border - 1  # the pair that stands across the border
        while pairs:
            least = min(pairs)
            if least == none:
                break
            k = pairs.index(least)
            if k == cross:
                return []
            cross -= k < cross
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, s: int, t: int) -> bool:
        known = self._may_follow.get((s, t))
        if known is None:
            known = self.merged(self.bytes_of[s] + self.bytes_of[t], len(self.bytes_of[s])) == [s, t]
            if len(self._may_follow) < self.pairs:
                self._may_follow[s, t] = known
        return known


class Prefixes:
    """The last token of every prefix of one word, which can be appended to and cut back."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: list[int] | None = None):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        if last is not None:
            self.data, self.last = data, [-1, *last]
        else:
            self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Adds bytes; the work is that of the added bytes alone."""
        data, last = self.data + more, self.last
        known, may_follow = self.vocabulary._may_follow, self.vocabulary.may_follow
        done = len(self.data)
        # tokens that end in the new bytes begin at most the longest token's length before them
        from_ = max(0, done - self.vocabulary.longest)
        i = done  # prefixes up to here have their last token
        for end, (t, n) in self.vocabulary.found.iter(data[from_:].decode("latin-1")):
            at = from_ + end + 1 - n
            if from_ + end < i:  # this prefix is done already
                continue
            if from_ + end > i:
                raise AssertionError(f"no token ends at byte {i + 1}")
            if at:
                s = last[at]
                ok = known.get((s, t))
                if ok is None:
                    ok = may_follow(s, t)
                if not ok:
                    continue
            last.append(t)
            i += 1
        if i < len(data):
            raise AssertionError(f"no token ends at byte {i + 1}")
        self.data = data
        return self

    def cut(self, length: int) -> Prefixes:
        """Keeps the first ``length`` bytes; nothing is worked out again."""
        self.data = self.data[:length]
        del self.last[length + 1 :]
        return self

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        return self.inner_ids() if whole is None else [whole]

    def inner_ids(self) -> list[int]:
        """The word's ids by joins of its bytes."""
        found, at = [], len(self.data)
        while at:
            t = self.last[at]
            found.append(t)
            at -= len(self.vocabulary.bytes_of[t])
        return found[::-1]


class Memory(dict):
    """What ``make`` gives for a key, kept for at most ``most`` keys of at most ``longest`` characters."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 128):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) < self.most and len(key) <= self.longest:
            self[key] = found
        return found


class Encoder:
    """Ids of texts. Words met before come from a memory of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int = 250_000):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.words = Memory(self._word, words)

    def _word(self, word: str) -> bytes:
        data = word.encode()
        whole = self.vocabulary.ranks.get(data)
        ids = Prefixes(self.vocabulary, data).inner_ids() if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def borders(self, text: str, start: int = 0) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, ids) of the words from ``start``, which must be a word's border."""
        at = start
        for word in self.split(text[start:]):
            yield at, at + len(word), self.words[word]
            at += len(word)

    def table(self, text: str) -> tuple[list[int], list[bytes]]:
        """Ends of all words, and their ids: what :meth:`edited` starts from."""
        found = list(self.borders(text))
        return [e for _, e, _ in found], [i for _, _, i in found]

    def edited(self, old: str, table: tuple[list[int], list[bytes]], start: int, end: int, new: str) -> tuple[str, tuple[list[int], list[bytes]], int]:
        """The text with ``old[start:end]`` replaced, its table, and how many characters were split again.

        Words that end ``REACH`` characters before the edit stay. From there
        words are split until one ends, behind the edit, where a word of the
        old text ended; what follows is taken from the old table.
        """
        ends, ids = table
        first = int(np.searchsorted(np.array(ends, dtype=np.int64), start - REACH, side="right")) if ends else 0
        at = begun = ends[first - 1] if first else 0
        text, shift = old[:start] + new + old[end:], len(new) - (end - start)
        old_at = {e: k for k, e in enumerate(ends) if e >= end}
        new_ends, new_ids = ends[:first], ids[:first]
        size = 256
        while at < len(text):
            # words of a stretch are sure up to REACH characters before its end; a longer stretch where none is
            stretch = text[at : at + size]
            whole = at + size >= len(text)
            progress = at
            for word in self.split(stretch):
                if not whole and progress + len(word) > at + len(stretch) - REACH:
                    break
                progress += len(word)
                new_ends.append(progress)
                new_ids.append(self.words[word])
                k = old_at.get(progress - shift) if progress >= start + len(new) else None
                if k is not None:
                    return text, (new_ends + [e + shift for e in ends[k + 1 :]], new_ids + ids[k + 1 :]), progress - begun
            size = 2 * size if progress == at else 256
            at = progress
        return text, (new_ends, new_ids), at - begun


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept as long as the process lives: a Python worker runs many tasks, and the package's own modules are sent anew with each."""
    found = sys.modules.setdefault("_kept_by_this_process", SimpleNamespace(found={})).found
    if name not in found:
        found[name] = make()
    return found[name]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time, so that results of a large batch are not in memory together."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "_ids") -> DataFrame:
    """All columns of ``docs`` with ``ids_col``: the text's ids as little-endian unsigned 32-bit bytes.

    ``ranks`` is a rank file that all executors can read, ``pattern`` splits
    texts into words. No special tokens are known: their strings are ordinary
    text. A null text counts as empty and has no ids. Rows that repeat are
    encoded each. Texts are encoded whole, one at a time; the memory of words
    is bounded. An input column named like the added one is replaced; others
    may have any name.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder {ranks} {pattern}", lambda: Encoder(read_ranks(ranks), pattern))
        for batch in slices(batches):
            at = batch.schema.get_field_index("_text")
            found = pa.array([encoder.encode(t.as_py() or "") for t in batch.column(at)], pa.binary())
            yield batch.remove_column(at).append_column("_ids", found)

    plain, names, new = plain_names(docs, (ids_col,))
    sent = plain.withColumn("_text", F.col(new[text_col]).cast("string"))
    return sent.mapInArrow(tasks, plain.schema.add("_ids", "binary")).toDF(*names, ids_col)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "_ids", bytes_col: str = "_bytes") -> DataFrame:
    """All columns with ``bytes_col``: the bytes of the ids; null for null ids. An id outside the vocabulary raises."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = kept(f"tokens {ranks}", lambda: {i: t for t, i in read_ranks(ranks).items()})
        for batch in slices(batches):
            at = batch.schema.get_field_index("_sent")
            found = pa.array([decoded(i.as_py(), bytes_of) if i.is_valid else None for i in batch.column(at)], pa.binary())
            yield batch.remove_column(at).append_column("_bytes", found)

    plain, names, new = plain_names(encoded, (bytes_col,))
    sent = plain.withColumn("_sent", F.col(new[ids_col]).cast("binary"))
    return sent.mapInArrow(tasks, plain.schema.add("_bytes", "binary")).toDF(*names, bytes_col)


def decoded(ids: bytes, bytes_of: dict[int, bytes]) -> bytes:
    try:
        return b"".join(map(bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    except KeyError as e:
        raise ValueError(f"id {e} is not in the vocabulary") from None
