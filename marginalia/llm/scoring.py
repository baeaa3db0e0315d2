"""Cross-entropy difference of documents under matched target and background bigram models.

Both models share one vocabulary, all words of the corpus, and one smoothing:

    P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + (1 - a - b) / V

The background is counted over all documents, the target over the documents of
interest. A document is never judged by its own bigrams: its counts are taken
off before the probabilities are formed. The score is the mean over tokens of
``log P_background - log P_target``; the lower, the more like the target. V is
the number of distinct words and two more.

There is no table of bigrams. Every bigram of every document is dealt once to a
part, where all its occurrences meet: counting and scoring are one pass.

* The most frequent words, at most 65,534, have short codes and their counts
  are broadcast. Bigrams of two such words are dealt by both. Other bigrams are
  dealt by their rare word, which no part can have too many of, and that
  word's counts are summed in its part.
* The most frequent bigrams, a bounded number proposed by a sample and counted
  over all documents, are scored where the document is read, so no bigram is
  hot. The proposal changes where a bigram is scored, never its score.
* Bigrams of two rare words that also occur elsewhere, a small rest, lack the
  count of their context in that part. They join the table of words by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.jaccard import marked
from marginalia.llm.shared import materialise
from marginalia.llm.shingles import mix

START, END = 0, 1  # codes; those of frequent words follow from 2
SHORT = 1 << 16  # short codes are below
FEW = 1 << 21  # ids
RARE = 1 << 63  # the highest bit of the hash of every word
ALL, TARGET, LAST, TARGET_LAST = range(4)  # what a count is of: words anywhere, or at the end of a document
COUNTED = "word long, kind int, n long"
SENT = "part int, kind int, row binary, docs binary, target binary, v binary, w binary, own binary"
FOUND = "kind int, row long, doc_id long, n long, target double, background double, v long, b long, t long, other_b double, other_t double, rows array<long>, ns array<int>, owns array<int>, flags array<int>"
BOTH_SHORT, WITH_RARE, HEADER = range(3)  # kinds of records sent; of rows found: 0 a document, 1 a sum, 2 a bigram that lacks its context


class WordCodes(dict):
    """Codes of words: the short one of a frequent word, else the word's hash; those met first are kept, up to a bound."""

    def __init__(self, short: dict[int, int], kept: int = 200_000):
        super().__init__()
        self.short, self.kept = short, kept

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word) | RARE
        found = self.short.get(h, h)
        if len(self) < self.kept:
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Lexicon(NamedTuple):
    """What every task knows: frequent words, frequent bigrams, totals. Its size is bounded by the operator's parameters."""

    short: dict[int, int]  # hash of a frequent word -> its code
    words: np.ndarray  # background and target: counts by code
    contexts: np.ndarray  # the same, as contexts
    pairs: np.ndarray  # frequent bigrams as numbers of two codes, sorted
    pair_counts: np.ndarray  # background and target
    totals: tuple[int, int]
    n_words: int


def contexts_of(w: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(START), w[:-1])[: len(w)]


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A positive number for a bigram of word hashes; never 0, and never that of a word."""
    return mix(mix(v, 7) + w, 8) >> np.uint64(1) | np.uint64(1)


def places(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are among sorted ones, and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def flagged(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, in_target``; only rows that may be in the target enter the join with its ids."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    wanted = materialise(wanted, "scoring-target")
    if wanted.count() <= FEW:  # checked: a few dozen MB go to the texts; beyond, texts that may be in the target meet it by a shuffle
        known = texts.join(F.broadcast(wanted.withColumn("_in", F.lit(True))), "doc_id", "left")
        return known.select("doc_id", "text", F.coalesce("_in", F.lit(False)).alias("in_target"))
    maybe = marked(texts, "doc_id", wanted)
    others = maybe.where(~F.col("_maybe")).select("doc_id", "text", F.lit(False).alias("in_target"))
    some = maybe.where("_maybe").join(wanted.withColumn("_in", F.lit(True)), "doc_id", "left")
    return others.unionByName(some.select("doc_id", "text", F.coalesce("_in", F.lit(False)).alias("in_target")))


def most_frequent(counts: DataFrame, n: str, most: int) -> list:
    """The rows with the largest counts, at most ``most`` of them: all above a border, which a histogram gives."""
    level = F.floor(F.log2(F.col(n)) * 64)
    border, left = -1, 0
    for at, rows in sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True):
        left += rows
        if left > most:
            border = at
            break
    return counts.where(level > border).collect()


def proposed_pairs(texts: DataFrame, n_docs: int, most: int, sample: int) -> np.ndarray:
    """Word hashes of the ``most`` most frequent bigrams of about ``sample`` documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pairs = WordCodes({}), []
        for batch in batches:
            for text in batch.column(0):
                w = codes.of(text.as_py())
                pairs.append(np.stack([contexts_of(w), w]))
        if pairs:
            v, w = np.concatenate(pairs, axis=1)
            _, first, n = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
            top = np.argsort(-n, kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (v[first[top]].view(np.int64), w[first[top]].view(np.int64), n[top])], names=["v", "w", "n"])

    drawn = texts.select("text").sample(min(1.0, sample / max(1, n_docs)), seed=1)
    found = materialise(drawn.mapInArrow(rows, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n")), "scoring-sample")
    return np.array([(r["v"], r["w"]) for r in most_frequent(found, "n", most)], dtype=np.int64).reshape(-1, 2).view(np.uint64)


def counted(texts: DataFrame, pairs: np.ndarray, flush: int) -> DataFrame:
    """``word, b, t, last_b, last_t``: counts of all words by their hash, of START, and of the given bigrams by theirs."""
    keys = np.sort(pair_hash(pairs[:, 0], pairs[:, 1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, targets, n = WordCodes({}), [], [], 0

        def flushed():
            for texts, words, last in ((held, ALL, LAST), ([w for w, t in zip(held, targets) if t], TARGET, TARGET_LAST)):
                if not texts:
                    continue
                w = np.concatenate(texts)
                v, often = np.concatenate([contexts_of(x) for x in texts]), np.zeros(len(keys), dtype=np.int64)
                for lo in range(0, len(w), 1 << 16):
                    at, there = places(keys, pair_hash(v[lo : lo + (1 << 16)], w[lo : lo + (1 << 16)]))
                    often += np.bincount(at[there], minlength=len(keys))
                del v
                some = np.flatnonzero(often)
                found = [(words, *np.unique(w, return_counts=True)), (last, *np.unique(np.array([x[-1] for x in texts]), return_counts=True))]
                found += [(words, np.array([START], dtype=np.uint64), np.array([len(texts)])), (words, keys[some], often[some])]
                for kind, word, count in found:
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), kind, dtype=np.int32)), pa.array(count.astype(np.int64))], names=["word", "kind", "n"])

        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist()):
                w = codes.of(text.as_py())
                if len(w):
                    held.append(w)
                    targets.append(target)
                    n += len(w)
                if n >= flush:
                    yield from flushed()
                    held, targets, n = [], [], 0
        yield from flushed()

    sums = (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0).cast("long")).alias(name) for k, name in enumerate(("b", "t", "last_b", "last_t")))
    return texts.select("text", "in_target").mapInArrow(rows, COUNTED).groupBy("word").agg(*sums)


def lexicon(counts: DataFrame, pairs: np.ndarray, size: int) -> Lexicon:
    n_words, *totals = counts.where(F.col("word") < 0).agg(F.count("word"), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    start = counts.where(F.col("word") == START).select("b", "t").collect()  # one row
    top = most_frequent(counts.where(F.col("word") < 0), "b", size - 2)
    by_pair = {r["word"]: (r["b"], r["t"]) for r in counts.where(F.col("word") > 0).select("word", "b", "t").collect()}  # proposed pairs
    short = {r["word"] + (1 << 64): k + 2 for k, r in enumerate(top)}
    words = np.array([(0, 0), (0, 0), *((r["b"], r["t"]) for r in top)], dtype=np.int64).T
    contexts = np.array([tuple(start[0]) if start else (0, 0), (0, 0), *((r["b"] - r["last_b"], r["t"] - r["last_t"]) for r in top)], dtype=np.int64).T
    coded = {}
    for v, w in pairs.tolist():
        a, b = START if v == START else short.get(v), short.get(w)
        if a is not None and b is not None:
            key = int(pair_hash(np.array([v], dtype=np.uint64), np.array([w], dtype=np.uint64))[0])
            coded[a << 16 | b] = by_pair.get(key, (0, 0))
    keys = sorted(coded)
    pair_counts = np.array([coded[k] for k in keys], dtype=np.int64).reshape(-1, 2).T
    return Lexicon(short, words, contexts, np.array(keys, dtype=np.uint64), pair_counts, tuple(totals), n_words)


def surprise(pair: np.ndarray, context: np.ndarray, other: np.ndarray, bigram: float) -> np.ndarray:
    """``-log P`` from a bigram's and its context's count, both without the document's own, and the other terms of P."""
    return -np.log(np.where(context > 0, bigram * np.maximum(pair, 0) / np.maximum(context, 1), 0.0) + other)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    change = np.zeros(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.append(0, np.flatnonzero(change) + 1)[: len(columns[0])]


def smallest(x: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def numbers(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // count}") if count else np.empty(0, dtype=np.uint8)


def rate_of(counts: np.ndarray, model: int, lex: Lexicon, unigram: float, uniform: float) -> np.ndarray:
    return unigram * counts / max(lex.totals[model], 1) + uniform


class Sender:
    """Codes the bigrams of documents and packs them by part, many documents in one record."""

    def __init__(self, lex: Lexicon, parts: int, rates: tuple[float, float, float]):
        self.lex, self.parts, self.rates = lex, parts, rates
        self.codes = WordCodes(lex.short)
        self.alone = [-np.log(rate_of(lex.words[model], model, lex, rates[1], rates[2])) for model in (0, 1)]
        self.clear()

    def clear(self) -> None:
        self.words: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.n = 0

    def add(self, row: int, doc_id: int | None, target: bool, text: str | None) -> None:
        w = self.codes.of(text)
        v = contexts_of(w)
        if len(w):
            _, at, often = np.unique(v, return_inverse=True, return_counts=True)
            self.own.append(often[at])
        self.words.append(w)
        self.contexts.append(v)
        self.docs.append((row, doc_id, target))
        self.n += len(w) + 8

    def scored_here(self, doc, key, own, target, n_docs: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Which bigrams are among the frequent ones, and their sums by document for background and target."""
        lex, (bigram, unigram, uniform) = self.lex, self.rates
        at, here = places(lex.pairs, key)
        order = np.flatnonzero(here)
        order = order[np.lexsort((at[order], doc[order]))]
        at, doc, own = at[order], doc[order], own[order]
        first = runs(at, doc)
        n = np.diff(np.append(first, len(at)))
        at, doc, own = at[first], doc[first], own[first]
        v, w = (lex.pairs[at] >> np.uint64(16)).astype(np.int64), (lex.pairs[at] & np.uint64(SHORT - 1)).astype(np.int64)
        sums = []
        for model, off in ((0, np.ones(len(at), dtype=np.int64)), (1, target[doc].astype(np.int64))):
            other = rate_of(lex.words[model][w], model, lex, unigram, uniform)
            each = surprise(lex.pair_counts[model][at] - n * off, lex.contexts[model][v] - own * off, other, bigram)
            sums.append(np.bincount(doc, weights=n * each, minlength=n_docs).astype(np.float64))
        return here, tuple(sums)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        size = np.array([len(w) for w in self.words])
        v, w = np.concatenate(self.contexts), np.concatenate(self.words)
        own = np.concatenate(self.own) if self.own else np.empty(0, dtype=np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        row = np.array([d[0] for d in self.docs], dtype=np.int64)
        target = np.array([d[2] for d in self.docs], dtype=bool)
        short = (v < SHORT) & (w < SHORT)
        key = np.where(short, v << np.uint64(16) | w, np.uint64(RARE))
        here, (background, wanted) = self.scored_here(doc, key, own, target, len(size))
        plain = np.flatnonzero((w < SHORT) & ~here)  # scored as if the bigram were in no other document; the part sends the difference
        for model, sums in ((0, background), (1, wanted)):
            sums += np.bincount(doc[plain], weights=self.alone[model][w[plain].astype(np.int64)], minlength=len(size))

        out: list[tuple] = []
        sums = np.stack([wanted, background]).tobytes()
        known = np.array([d[1] is not None for d in self.docs], dtype=np.uint8)
        ids = np.array([d[1] or 0 for d in self.docs], dtype=np.int64)
        out.append((int(row[0] % self.parts), HEADER, row.tobytes(), size.astype(np.int64).tobytes(), known.tobytes(), ids.tobytes(), sums, b""))

        ends = np.flatnonzero(size)
        last = np.cumsum(size)[ends] - 1
        ends = ends[w[last] >= SHORT]  # rare words at the end of a document: the bigram (word, END) tells their part
        last = w[np.cumsum(size)[ends] - 1]
        some = np.flatnonzero(short & ~here)
        rare = np.flatnonzero(~short)
        groups = (
            (BOTH_SHORT, doc[some], key[some], np.empty(0, dtype=np.uint64), own[some], key[some]),
            (WITH_RARE, np.append(doc[rare], ends), np.append(v[rare], last), np.append(w[rare], np.full(len(last), END, dtype=np.uint64)), np.append(own[rare], np.zeros(len(last), dtype=np.int64)), None),
        )
        for kind, d, a, b, mine, dealt in groups:
            if not len(d):
                continue
            part = mix(np.where(b >= SHORT, b, a) if dealt is None else dealt, 5) % np.uint64(self.parts)
            if kind == WITH_RARE:  # the ends go to their documents
                order = np.lexsort((d, part))
            else:
                order = np.argsort(part.astype(np.min_scalar_type(self.parts)), kind="stable")
            part, d, a, mine = part[order], d[order], a[order], mine[order]
            b = b[order] if len(b) else b
            cuts = np.append(runs(part), len(part))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                first = runs(d[lo:hi])
                mined = d[lo:hi][first]
                lengths = np.diff(np.append(first, hi - lo))
                codes = (a[lo:hi].astype("<u4").tobytes(), b"") if kind == BOTH_SHORT else (a[lo:hi].tobytes(), b[lo:hi].tobytes())
                out.append((int(part[lo]), kind, row[mined].tobytes(), smallest(lengths), target[mined].astype(np.uint8).tobytes(), *codes, smallest(mine[lo:hi])))
        self.clear()
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "kind", "row", "docs", "target", "v", "w", "own"])


def table_of(kind: int, rows: int, /, **columns: np.ndarray) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "rows": pa.list_(pa.int64()), **dict.fromkeys(("ns", "owns", "flags"), pa.list_(pa.int32())), **dict.fromkeys(("target", "background", "other_b", "other_t"), pa.float64())}
    names = [c.split()[0] for c in FOUND.split(", ")]
    columns["kind"] = np.full(rows, kind, dtype=np.int32)
    arrays = [pa.nulls(rows, types.get(c, pa.int64())) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c]).cast(types.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def headers(record: dict) -> pa.RecordBatch:
    row = np.frombuffer(record["row"], dtype=np.int64)
    known = np.frombuffer(record["target"], dtype=np.uint8) == 1
    target, background = np.frombuffer(record["w"], dtype=np.float64).reshape(2, -1)
    ids = pa.array(np.frombuffer(record["v"], dtype=np.int64), mask=~known)
    return table_of(0, len(row), row=row, doc_id=ids, n=np.frombuffer(record["docs"], dtype=np.int64), target=target, background=background)


def judged(records: list[dict], kind: int, lex: Lexicon, rates: tuple[float, float, float], at_once: int, found: list) -> Iterator[pa.RecordBatch]:
    """Counts and scores the bigrams of one part and kind, about ``at_once`` of them together.

    Sums by document go to ``found``; bigrams of two rare words that lack their context are returned.
    """
    if kind == HEADER:
        yield from map(headers, records)
        return
    row = np.concatenate([np.frombuffer(r["row"], dtype=np.int64) for r in records])
    target = np.concatenate([np.frombuffer(r["target"], dtype=np.uint8) for r in records])
    length = np.concatenate([numbers(r["docs"], len(r["target"])) for r in records]).astype(np.int64)
    doc = np.repeat(np.arange(len(row), dtype=np.uint32), length)
    width = 4 if kind == BOTH_SHORT else 8
    own = np.concatenate([numbers(r["own"], len(r["v"]) // width) for r in records])
    v = np.concatenate([np.frombuffer(r["v"], dtype=f"<u{width}") for r in records])
    w = np.concatenate([np.frombuffer(r["w"], dtype=np.uint64) for r in records])
    records.clear()
    sums = np.zeros((2, len(row)))
    groups = -(-len(v) // at_once)
    owner = v if kind == BOTH_SHORT else np.where(w >= SHORT, w, v)
    group = (mix(owner, 9) % np.uint64(groups)).astype(np.uint16) if groups > 1 else np.zeros(len(v), dtype=np.uint16)
    del owner
    for g in range(groups):
        some = np.flatnonzero(group == g)
        yield from counted_and_scored(kind, row, target, doc[some].astype(np.int64), v[some], w[some] if len(w) else w, own[some].astype(np.int64), lex, rates, sums)
    some = np.flatnonzero(sums.any(axis=0))
    found.append((row[some], sums[:, some]))


def together(found: list) -> Iterator[pa.RecordBatch]:
    """The sums of a part, by row."""
    if found:
        row, at = np.unique(np.concatenate([r for r, _ in found]), return_inverse=True)
        target, background = (np.bincount(at, weights=np.concatenate([x[k] for _, x in found]), minlength=len(row)) for k in (0, 1))
        found.clear()
        yield table_of(1, len(row), row=row, target=target, background=background)


def counted_and_scored(kind: int, row, target, doc, v, w, own, lex: Lexicon, rates: tuple[float, float, float], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds to ``sums`` what these bigrams, with all their occurrences, change for the documents."""
    bigram, unigram, uniform = rates
    known: tuple = (np.empty(0, dtype=np.uint64), np.zeros((2, 0), dtype=np.int64), np.zeros((2, 0), dtype=np.int64))
    key = v
    if kind == WITH_RARE:
        key = pair_hash(v, w)
        wanted = target[doc] == 1
        mine = w >= SHORT
        words, at = np.unique(w[mine], return_inverse=True)
        often = np.stack([np.bincount(at, minlength=len(words)), np.bincount(at[wanted[mine]], minlength=len(words))])
        ends = w == END
        at = np.searchsorted(words, v[ends])
        final = np.stack([np.bincount(at, minlength=len(words)), np.bincount(at[wanted[ends]], minlength=len(words))])
        known = (words, often, often - final)

    order = np.argsort(key, kind="stable")  # bigrams of one document stay together
    key, doc, own = key[order], doc[order], own[order]
    first = runs(key, doc)
    n = np.diff(np.append(first, len(key)))
    if kind == BOTH_SHORT:
        v, w = key[first].astype(np.uint64) >> np.uint64(16), key[first].astype(np.uint64) & np.uint64(SHORT - 1)
    else:
        v, w = v[order][first], w[order][first]
    key, doc, own = key[first], doc[first], own[first]
    of = target[doc].astype(np.int64)
    group = runs(key)
    size = np.diff(np.append(group, len(key)))
    b, t = (np.repeat(np.add.reduceat(x, group), size) if len(key) else x for x in (n, n * of))
    b, t = b - n, t - n * of  # in other documents
    scored = (w != END) & ((b + t > 0) | (w >= SHORT))
    key, v, w, n, doc, own, of, b, t = (x[scored] for x in (key, v, w, n, doc, own, of, b, t))

    def looked_up(code, short, long):
        """The counts of words in both models, by code or from this part."""
        place, _ = places(known[0], code)
        return np.where(code < SHORT, short[:, np.where(code < SHORT, code, 0).astype(np.int64)], long[:, place] if long.size else 0)

    word_b, word_t = looked_up(w, lex.words, known[1])
    context_b, context_t = looked_up(v, lex.contexts, known[2])
    other_b, other_t = rate_of(word_b, 0, lex, unigram, uniform), rate_of(word_t, 1, lex, unigram, uniform)
    lacking = (b + t > 0) & (v >= SHORT) & (w >= SHORT)
    done = np.flatnonzero(~lacking)
    for total, pair, context, other in ((sums[0], t, context_t - own * of, other_t), (sums[1], b, context_b - own, other_b)):
        each = surprise(pair, context, other, bigram)[done]
        each = np.where(w[done] < SHORT, each + np.log(other[done]), each)  # the sender has added the rest
        total += np.bincount(doc[done], weights=n[done] * each, minlength=len(row))
    if lacking.any():  # a row for each bigram, with the documents that have it
        key, v, n, doc, own, of, b, t, other_b, other_t = (x[lacking] for x in (key, v, n, doc, own, of, b, t, other_b, other_t))
        first = runs(key)
        offsets = np.append(first, len(key)).astype(np.int32)
        lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x)) for c, x in (("rows", row[doc]), ("ns", n.astype(np.int32)), ("owns", own.astype(np.int32)), ("flags", of.astype(np.int32)))}
        yield table_of(2, len(first), v=v[first].view(np.int64), b=(b + n)[first], t=(t + n * of)[first], other_b=other_b[first], other_t=other_t[first], **lists)


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, size: int = 1 << 16, bigram: float = 0.6, unigram: float = 0.35, part_rows: int = 1 << 22, pairs: int = 1 << 16, sample: int = 1 << 14, flush: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, target_entropy, background_entropy, score`` of every row, in nats per token.

    ``target_ids`` has a column ``doc_id``; ids that are not in ``docs``, and
    repeated ones, do no harm. ``size``, at most 65,536, bounds the words with
    short codes, ``pairs`` the bigrams that are scored where they are read, as
    proposed by about ``sample`` documents; all leave the results as they
    are. ``part_rows`` is about the number of bigrams of a part, a sixteenth
    of which is worked on at once. A text without
    words has 0 tokens and null entropies and score. Rows that repeat a doc_id
    are scored each by its own text; a null doc_id is never in the target. With
    an empty target its model is uniform.
    """
    if not 2 < size <= SHORT:
        raise ValueError("there are 3 to 65,536 short codes")
    spark = docs.sparkSession
    texts = flagged(docs, target_ids, id_col, text_col)
    proposed = proposed_pairs(docs.select(F.col(text_col).cast("string").alias("text")), docs.count(), pairs, sample)
    counts = materialise(counted(texts, proposed, 4 * flush), "scoring-words")
    lex = lexicon(counts, proposed, size)
    parts = max(16, -(-lex.totals[0] // part_rows))
    rates = (bigram, unigram, (1 - bigram - unigram) / (lex.n_words + 2))
    shared = spark.sparkContext.broadcast(lex)  # ``size`` words and ``pairs`` bigrams

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(shared.value, parts, rates)
        for batch in batches:
            for row, doc_id, target, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                sender.add(row, doc_id, target, text.as_py())
                if sender.n >= flush:
                    yield from sender.flush()
        yield from sender.flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, [], []
        for batch in batches:
            names = batch.schema.names[2:]
            for k, at in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if at != now and held:
                    yield from judged(held, now[1], shared.value, rates, part_rows // 16, sums)
                    held = []
                    if at[0] != now[0]:
                        yield from together(sums)
                now = at
                held.append({c: batch.column(c)[k].as_buffer() for c in names})
        if held:
            yield from judged(held, now[1], shared.value, rates, part_rows // 16, sums)
        yield from together(sums)

    keyed = texts.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "in_target", "text")
    sent = keyed.mapInArrow(send, SENT).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = materialise(sent.mapInArrow(judge, FOUND), "scoring-sums")

    counts = counts.select(F.col("word").alias("v"), (F.col("b") - F.col("last_b")).alias("cb"), (F.col("t") - F.col("last_t")).alias("ct"))
    lacking = found.where("kind = 2").select("v", "b", "t", "other_b", "other_t", "rows", "ns", "owns", "flags").join(counts, "v")
    lacking = lacking.select("b", "t", "other_b", "other_t", "cb", "ct", F.inline(F.arrays_zip("rows", "ns", "owns", "flags")))
    n = F.col("ns")

    def loss(pair, context, other):
        return -n * F.log(F.when(context > 0, bigram * pair / F.when(context > 0, context)).otherwise(0.0) + F.col(other))

    target = loss(F.col("t") - n * F.col("flags"), F.col("ct") - F.col("owns") * F.col("flags"), "other_t")
    late = lacking.select(F.col("rows").alias("row"), target.alias("target"), loss(F.col("b") - n, F.col("cb") - F.col("owns"), "other_b").alias("background"), F.lit(0).alias("copies"))
    documents = found.where("kind = 0").select("row", "doc_id", "n", F.col("target").alias("_t"), F.col("background").alias("_b"))
    zero = F.lit(0.0)
    each = found.where("kind = 1").select("row", "target", "background", F.lit(0).alias("copies"))
    each = each.unionByName(late).unionByName(documents.select("row", zero.alias("target"), zero.alias("background"), F.lit(1).alias("copies")))
    sums = each.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("target", "background", "copies")))  # equal rows have equal sums
    tokens = F.when(F.col("n") > 0, F.col("n"))
    target, background = ((F.col(f"_{c[0]}") + F.col(c) / F.col("copies")) / tokens for c in ("target", "background"))
    return documents.join(sums, "row").select("doc_id", F.col("n").alias("n_tokens"), target.alias("target_entropy"), background.alias("background_entropy"), (target - background).alias("score"))
