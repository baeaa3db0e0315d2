"""Best-fit packing of token pieces by linear grouping.

The scheme, for a capacity ``C``:

1. Documents become pieces of at most ``C`` tokens. Full pieces are sequences
   of their own.
2. Linear grouping: the other pieces longer than ``C * small`` are ordered by
   length and cut into groups of equal cardinality; each group's lengths are
   rounded up to its largest.
3. The few sizes that remain are packed as configurations, each used as often
   as its sizes last (a knapsack over bit sets finds the fullest one).
4. The actual pieces take the places of the rounded ones.
5. The small pieces go by best fit, longest first, into the gaps.

Steps 3 and 5 see only histograms of lengths, at most ``C`` numbers whatever
the size of the data. Places are given to pieces by their rank within their
length, which Spark computes with salted windows; no task or driver ever holds
all pieces.

Documents that come in an order to be kept, such as a mix of sources, are
packed by the same scheme in stretches of that order, see
:func:`pack_in_order`.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise, salted_rank

SALTS = 128
STRETCH = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


class Words(dict):
    """Ids of words after a blank, kept up to a number of words.

    It doesn't refer to its encoder, so both are freed with a task's last
    reference: a worker that runs many tasks would else hold several of them
    until cycles are collected.
    """

    def __init__(self, bpe, most: int):
        super().__init__()
        self.bpe, self.most = bpe, most

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.bpe.encode_ordinary(" " + word), dtype="<u4").tobytes()
        if len(self) < self.most:
            self[word] = found
        return found


class PieceEncoder:
    """Byte-level BPE ids of texts as little-endian unsigned 32-bit bytes.

    The ids are those of ``tokenizers`` for the same file, with ``added_tokens``
    as at its default setting: the file's added tokens within a text are single
    ids; without it they are encoded like other characters. A text is encoded
    word by word, and words met before come from a bounded memory. A text with
    a white-space run around a blank is encoded in one go, since there the cut
    at blanks would move word borders.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    RUN = re.compile(r"  |\s (?:\s|\Z)")

    def __init__(self, path: str, words: int = 500_000, added_tokens: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, special = file["model"]["vocab"], {t["content"] for t in file.get("added_tokens", ())}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.bpe = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

        if added_tokens and any(t.get(c) for t in file.get("added_tokens", ()) for c in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in file.get("added_tokens", ())} if added_tokens else {}
        longest = sorted(self.added, key=len, reverse=True)
        self.border = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

        self.words = Words(self.bpe, words)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.border is None or not self.border.search(text):
            return self.encode_part(text)
        return b"".join(self.added[x] if k % 2 else self.encode_part(x) for k, x in enumerate(self.border.split(text)) if x)

    def encode_part(self, text: str) -> bytes:
        if self.RUN.search(text):
            return self.encode_whole(text)
        head, *rest = text.split(" ")
        return self.encode_whole(head) + b"".join(map(self.words.__getitem__, rest))


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False, place_col: str | None = None
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, and ``place`` if the documents have a ``place_col``.

    A document is its ids and a closing id 0; a null text counts as empty and
    gives one piece of length 1. Only documents longer than ``capacity`` are
    cut; then all pieces but the first are full. Rows that repeat a doc_id are
    separate documents; a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tokenizer, added_tokens=added_tokens)
        end = b"\0\0\0\0"
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            for doc, text, *place in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                starts = [0, *range(first, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), *place)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds.values())], names=[*kinds])

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"place": pa.int64()} if place_col else {})
    read = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.col(place_col).cast("long").alias("place")] if place_col else [])]
    return docs.select(*read).mapInArrow(cut, PIECES + ", place long" * bool(place_col))


# ---------------------------------------------------------------- plans over histograms


def linear_groups(counts: np.ndarray, small: int, groups: int) -> tuple[int, list[tuple[int, int]]]:
    """Group size and the rounded (size, number) of each group, longest first. counts[l]: pieces of length l."""
    lengths = np.arange(len(counts))[:small:-1]
    numbers = counts[lengths]
    total = int(numbers.sum())
    if not total:
        return 1, []
    size = -(-total // groups)
    ends = np.cumsum(numbers)
    firsts = np.arange(0, total, size)
    tops = lengths[np.searchsorted(ends, firsts, side="right")]
    return size, [(int(t), int(min(size, total - a))) for t, a in zip(tops, firsts)]


def fullest(capacity: int, sizes: list[int], left: list[int]) -> dict[int, int]:
    """Indexes into sizes and how many of each, filling capacity as far as can be; larger sizes first among equals. sizes ascend."""
    mask = (1 << (capacity + 1)) - 1
    reach = [1]
    for s, n in zip(sizes, left):
        bits, more = reach[-1], reach[-1]
        for _ in range(min(n, capacity // s)):
            more = (more << s) & mask
            if not more:
                break
            bits |= more
        reach.append(bits)
    target = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(sizes) - 1, -1, -1):
        for c in range(min(left[i], target // sizes[i]), -1, -1):
            if reach[i] >> (target - c * sizes[i]) & 1:
                if c:
                    chosen[i] = c
                    target -= c * sizes[i]
                break
    return chosen


def configurations(capacity: int, groups: list[tuple[int, int]]) -> list[tuple[int, dict[int, int]]]:
    """(times, {group: pieces in each}) until every group is used up. Each begins with the largest size left."""
    left = [n for _, n in groups]
    found = []
    for g, (size, _) in enumerate(groups):
        while left[g]:
            left[g] -= 1
            open_ = [i for i in range(len(groups) - 1, g - 1, -1) if left[i] and groups[i][0] <= capacity - size]
            chosen = fullest(capacity - size, [groups[i][0] for i in open_], [left[i] for i in open_])
            left[g] += 1
            one = {open_[i]: c for i, c in chosen.items()}
            one[g] = one.get(g, 0) + 1
            times = min(left[i] // c for i, c in one.items())
            for i, c in one.items():
                left[i] -= c * times
            found.append((times, one))
    return found


def large_places(group_size: int, used: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, int]:
    """Rows (first rank, first sequence, times), by rank among the large pieces, and the number of sequences."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for times, one in used:
        for g, c in one.items():
            rows.append((g * group_size + taken[g], base, times))
            taken[g] += c * times
        base += times
    rows.sort()
    return np.array(rows or [(0, 0, 1)], dtype=np.int64), base


def small_places(capacity: int, gaps: dict[int, int], counts: list[tuple[int, int]]) -> tuple[np.ndarray, int]:
    """Best fit of small pieces, longest first, into gaps.

    gaps: number of sequences by free tokens. counts: (length, number), longest
    first. Rows are (first rank among small pieces, class, first sequence of
    the class, pieces in each): a class is the free tokens before any small
    piece came, or -1 for new sequences, whose number is the second result.
    """
    free: dict[int, list[tuple[int, int, int]]] = {f: [(f, 0, n)] for f, n in gaps.items() if n}
    rows, rank, new = [], 0, 0
    for length, number in counts:
        for f in sorted(k for k in free if k >= length):
            each = f // length
            kept = []
            for origin, lo, hi in free.pop(f):
                full = min(hi - lo, number // each)
                if full:
                    rows.append((rank, origin, lo, each))
                    rank, number = rank + full * each, number - full * each
                    free.setdefault(f - each * length, []).append((origin, lo, lo + full))
                if lo + full < hi and 0 < number < each:
                    rows.append((rank, origin, lo + full, number))
                    free.setdefault(f - number * length, []).append((origin, lo + full, lo + full + 1))
                    rank, number, full = rank + number, 0, full + 1
                if lo + full < hi:
                    kept.append((origin, lo + full, hi))
            if kept:
                free.setdefault(f, []).extend(kept)
            if not number:
                break
        if number:
            each = capacity // length
            whole, rest = divmod(number, each)
            rows.append((rank, -1, new, each))
            if whole:
                free.setdefault(capacity - each * length, []).append((-1, new, new + whole))
            if rest:
                free.setdefault(capacity - rest * length, []).append((-1, new + whole, new + whole + 1))
            rank, new = rank + number, new + whole + bool(rest)
    return np.array(rows or [(0, -1, 0, 1)], dtype=np.int64), new


def offsets(counts: list, lengths: int, salts: int) -> np.ndarray:
    """Rank of the first row of each (length, salt), longest length first."""
    n = np.zeros((lengths, salts), dtype=np.int64)
    for length, salt, k in counts:
        n[length, salt] = k
    ahead = np.zeros_like(n)
    flat = n[::-1].ravel()
    ahead[::-1] = (np.cumsum(flat) - flat).reshape(n.shape)
    return ahead


# ---------------------------------------------------------------- the operator


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def with_columns(batch: pa.RecordBatch, kept: list[str], **more: np.ndarray) -> pa.RecordBatch:
    """The kept columns as they are, nulls too, and more long columns."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v.astype(np.int64)) for v in more.values())], names=[*kept, *more])


def pack(pieces: DataFrame, capacity: int = 2048, small: float = 1 / 8, groups: int = 512) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset`` there.

    ``pieces`` has ``doc_id, piece, start, length, ids_crc32`` and is read
    several times, so it should be a written table. Sequences hold at most
    ``capacity`` tokens without gaps. Equal rows are interchangeable; an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    border = int(capacity * small)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity)
    ranked, counted = salted_rank(pieces.where(F.col("length") < capacity), ["length"], order, "_rank", SALTS)
    counts = [tuple(r) for r in counted.collect()]  # at most capacity * SALTS rows
    ahead = offsets(counts, capacity, SALTS)
    per_length = np.zeros(capacity, dtype=np.int64)
    for length, _, n in counts:
        per_length[length] += n

    group_size, sizes = linear_groups(per_length, border, groups)
    big, n_big = large_places(group_size, configurations(capacity, sizes))
    n_large = int(per_length[border + 1 :].sum())
    shared = spark.sparkContext.broadcast((ahead, big))  # 2 MB at most, by capacity and SALTS

    def place_large(batches):
        ahead, big = shared.value
        for b in batches:
            rank = ahead[numbers(b, "length"), numbers(b, "_salt")] + numbers(b, "_rank")
            row = big[np.maximum(np.searchsorted(big[:, 0], rank, side="right") - 1, 0)]
            yield with_columns(b, columns, _rank=rank, sequence_id=row[:, 1] + (rank - row[:, 0]) % row[:, 2])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, "_salt", "_rank").mapInArrow(place_large, PIECES + ", _rank long, sequence_id long")
    placed = materialise(placed, "pack-ranked")
    large = placed.where(F.col("length") > border).select(*columns, "sequence_id")

    gaps = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("_gap"))
    numbered, gap_counts = salted_rank(gaps.where(F.col("_gap") > 0), ["_gap"], ["sequence_id"], "_rank", SALTS)
    found = [tuple(r) for r in gap_counts.collect()]  # at most capacity * SALTS rows
    by_gap: dict[int, int] = defaultdict(int)
    gap_ahead = np.zeros((capacity, SALTS), dtype=np.int64)
    for gap, salt, n in sorted(found):
        gap_ahead[gap, salt] = by_gap[gap]
        by_gap[gap] += n
    little, _ = small_places(capacity, by_gap, [(length, int(per_length[length])) for length in range(border, 0, -1) if per_length[length]])
    shared_small = spark.sparkContext.broadcast((gap_ahead, little))

    def place_small(batches):
        _, little = shared_small.value
        for b in batches:
            rank = numbers(b, "_rank") - n_large
            row = little[np.maximum(np.searchsorted(little[:, 0], rank, side="right") - 1, 0)]
            yield with_columns(b, columns, _class=row[:, 1], _nth=row[:, 2] + (rank - row[:, 0]) // row[:, 3])

    def number_gaps(batches):
        ahead, _ = shared_small.value
        for b in batches:
            yield with_columns(b, ["_class", "sequence_id"], _nth=ahead[numbers(b, "_class"), numbers(b, "_salt")] + numbers(b, "_nth"))

    tiny = placed.where(F.col("length") <= border).select(*columns, "_rank").mapInArrow(place_small, PIECES + ", _class long, _nth long")
    own = tiny.where(F.col("_class") < 0).select(*columns, (F.col("_nth") + n_big).alias("sequence_id"))
    spots = numbered.select(F.col("_gap").cast("long").alias("_class"), F.col("_rank").alias("_nth"), "_salt", "sequence_id").mapInArrow(number_gaps, "_class long, sequence_id long, _nth long")
    joined = tiny.where(F.col("_class") >= 0).join(spots, ["_class", "_nth"]).select(*columns, "sequence_id")

    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order)
    before = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shares = large.unionByName(own).unionByName(joined).withColumn("offset", before)
    alone = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id")).withColumn("offset", F.lit(0).cast("long"))
    return shares.unionByName(alone).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Tokenise, cut and pack the documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(materialise(token_pieces(docs, tokenizer, capacity, id_col, text_col, added_tokens), "pack-pieces"), capacity)


# ---------------------------------------------------------------- documents in an order


def stretch_sequences(length: np.ndarray, capacity: int, border: int, groups: int) -> np.ndarray:
    """The sequence, from 0, of each piece of a stretch; lengths are under the capacity and descend."""
    counts = np.bincount(length, minlength=capacity)
    size, sizes = linear_groups(counts, border, groups)
    big, n_big = large_places(size, configurations(capacity, sizes))
    n_large = int(counts[border + 1 :].sum())
    rank = np.arange(n_large)
    row = big[np.searchsorted(big[:, 0], rank, side="right") - 1]
    large = row[:, 1] + (rank - row[:, 0]) % row[:, 2]

    gap = np.full(n_big, capacity)
    np.subtract.at(gap, large, length[:n_large])
    by_gap = dict(enumerate(np.bincount(gap, minlength=1).tolist()))
    little, _ = small_places(capacity, {g: n for g, n in by_gap.items() if g}, [(k, int(counts[k])) for k in range(border, 0, -1) if counts[k]])
    rank = np.arange(len(length) - n_large)
    row = little[np.searchsorted(little[:, 0], rank, side="right") - 1]
    nth = row[:, 2] + (rank - row[:, 0]) // row[:, 3]
    spots = np.argsort(gap, kind="stable")
    into = row[:, 1] >= 0
    tiny = n_big + nth
    tiny[into] = spots[np.searchsorted(gap[spots], row[into, 1]) + nth[into]]
    return np.concatenate([large, tiny])


def pack_in_order(pieces: DataFrame, capacity: int = 2048, small: float = 1 / 8, groups: int = 512, stretch: int = STRETCH) -> DataFrame:
    """Pack pieces of documents that have an order, a different ``place`` each, so that it stays that of the sequences.

    ``sequence_id`` ascends in the order: a sequence stands where its first
    document does, its documents follow each other by place, and a document's
    pieces come one after the other. A sequence of several pieces takes them
    from one stretch of ``stretch`` places, so each document stays within a
    stretch of its place. A stretch has at most one piece a document that is not
    full, which bounds a task; full pieces are sequences of their own, unshuffled.
    """
    border = int(capacity * small)
    bits = (2**31 // capacity).bit_length()  # of a piece's number: a text has under 2^31 bytes
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def fill(table: pa.Table) -> pa.Table:
        length, place = (table.column(c).to_numpy() for c in ("length", "place"))
        longest = np.lexsort((place, -length))
        sequence = np.empty_like(length)
        sequence[longest] = stretch_sequences(length[longest], capacity, border, groups)
        by_place = np.lexsort((place, sequence))
        length, place, sequence = length[by_place], place[by_place], sequence[by_place]
        firsts = np.flatnonzero(np.diff(sequence, prepend=-1))
        before = np.cumsum(length) - length
        each = np.diff(firsts, append=len(length))
        found = table.select(columns).take(pa.array(by_place))
        found = found.append_column("sequence_id", pa.array(np.repeat(place[firsts] << bits, each)))
        return found.append_column("offset", pa.array(before - np.repeat(before[firsts], each)))

    kinds = PIECES + ", sequence_id long, offset long"
    shares = pieces.where(F.col("length") < capacity).groupBy(F.floor(F.col("place") / stretch)).applyInArrow(fill, kinds)
    full = pieces.where(F.col("length") == capacity)
    alone = full.select(*columns, F.shiftleft("place", bits).bitwiseOR(F.col("piece").cast("long")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shares.unionByName(alone)


def pack_documents_in_order(
    docs: DataFrame, tokenizer: str, place_col: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False, stretch: int = STRETCH
) -> DataFrame:
    """Tokenise, cut and pack documents in the order of ``place_col``, whole numbers from 0; see :func:`token_pieces` and :func:`pack_in_order`."""
    pieces = materialise(token_pieces(docs, tokenizer, capacity, id_col, text_col, added_tokens, place_col), "pack-pieces")
    return pack_in_order(pieces, capacity, stretch=stretch)
