"""Line deduplication by range partitioning, returning keep bitmaps.

Line hashes are range-partitioned with their documents and sorted within
partitions by hash, document and position. A single pass over each sorted
partition keeps the first document of every hash. A hash met in a third of
all documents spans several ranges; the few rows at the borders of ranges are
settled afterwards by the smallest document of their hash. Texts never travel
with the lines: the result is one compressed bitmap per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.shared import materialise, plain_names

BLANKS = b" \t\n\x0b\x0c\r"
DROPPED, UNDECIDED, LAST = 0, 1, 2
RECORD = "h1 long, h2 long, doc_id long, slot long"
STREAMED = "kind int, h1 long, h2 long, doc_id long, slot long"


def line_hashes(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line whose key has at least ``least`` code points.

    The key is the line stripped of blanks and lower-cased in ASCII; its hash
    has 128 bits. ``slot`` holds the CRC of the text in its upper half, so that
    rows that repeat a doc_id with other texts stay apart, and the position.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            digests, docs_, slots = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_buffer().to_pybytes() if text.is_valid else b""
                found, places = [], []
                for k, line in enumerate(value.split(b"\n")):
                    key = line.strip(BLANKS).lower()
                    if len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least):
                        found.append(digest(key))
                        places.append(k)
                if found:
                    digests += found
                    docs_.append(np.full(len(found), doc, dtype=np.int64))
                    slots.append(np.array(places, dtype=np.int64) | np.int64(zlib.crc32(value)) << np.int64(32))
            if digests:
                h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                columns = (h[:, 0], h[:, 1], np.concatenate(docs_), np.concatenate(slots))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["h1", "h2", "doc_id", "slot"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return chosen.where(F.col("doc_id").isNotNull()).mapInArrow(rows, RECORD)


def stream_first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: lines of later documents, and what its borders leave open.

    Rows of the first hash that belong to its first document here are
    UNDECIDED, as an earlier range may end with the same hash. The LAST row
    gives the last hash and its first document here.
    """
    key, first, opening = None, 0, True

    def out(kind, h1, h2, doc, slot):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, dtype=np.int32)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (h1, h2, doc, slot))], names=["kind", "h1", "h2", "doc_id", "slot"])

    for batch in batches:
        h1, h2, doc, slot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "doc_id", "slot"))
        if not len(doc):
            continue
        starts = np.empty(len(doc), dtype=bool)
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts[0] = key != (h1[0], h2[0])
        if starts[0] and key is not None:
            opening = False
        at = np.maximum.accumulate(np.where(starts, np.arange(len(doc)), -1))
        firsts = np.where(at < 0, first, doc[np.maximum(at, 0)])
        gone = doc > firsts
        if opening:
            later = np.flatnonzero(starts[1:])
            end = later[0] + 1 if len(later) else len(doc)
            unsure = np.flatnonzero(~gone[:end])
            if len(unsure):
                yield out(UNDECIDED, h1[unsure], h2[unsure], doc[unsure], slot[unsure])
            opening = not len(later)
        if gone.any():
            yield out(DROPPED, h1[gone], h2[gone], doc[gone], slot[gone])
        key, first = (h1[-1], h2[-1]), firsts[-1]
    if key is not None:
        yield out(LAST, [key[0]], [key[1]], [first], [0])


def dropped_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, slot`` of every line to drop, written in the shared folder."""
    ordered = line_hashes(docs, least, id_col, text_col).repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "slot")
    streamed = materialise(ordered.mapInArrow(stream_first_documents, STREAMED), "lines-streamed")
    borders = streamed.where(F.col("kind") != DROPPED)
    smallest = borders.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))  # two hashes a range at most
    settled = borders.where(F.col("kind") == UNDECIDED).join(F.broadcast(smallest), ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
    return streamed.where(F.col("kind") == DROPPED).select("doc_id", "slot").unionByName(settled.select("doc_id", "slot"))


@F.pandas_udf(T.BinaryType())
def bitmap(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    def one(n, positions):
        bits = np.ones(n, dtype=bool)
        if positions is not None:
            bits[np.asarray(positions, dtype=np.int64)] = False
        return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)

    return pd.Series([one(n, p) for n, p in zip(n_lines, gone)], dtype=object)


@F.pandas_udf(T.StringType())
def kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(value, packed):
        if value is None or packed is None:
            return value
        lines = value.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), dtype=np.uint8), count=len(lines), bitorder="little")
        return "\n".join([line for line, bit in zip(lines, bits.tolist()) if bit])

    return pd.Series([one(t, k) for t, k in zip(text, keep)], dtype=object)


def keep_bitmaps(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (doc_id, text): ``doc_id, text_crc, n_lines, n_dropped, keep``.

    A line goes if its key, of at least ``least`` code points, occurs in a
    document with a smaller doc_id. ``keep`` is the zlib-compressed bitmap of
    the lines that stay, lowest bit first; it is null where all stay. A null or
    empty text is one empty line. Rows with a null doc_id keep all lines and
    have no bitmap. Repeated rows share a bitmap.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    ).where(F.col("doc_id").isNotNull())
    low, half = F.lit(0xFFFFFFFF).cast("long"), F.lit(32)
    gone = dropped_lines(docs, least, id_col, text_col).select("doc_id", F.call_function("shiftrightunsigned", "slot", half).alias("text_crc"), F.col("slot").bitwiseAND(low).cast("int").alias("line"))
    lists = gone.groupBy("doc_id", "text_crc").agg(F.collect_set("line").alias("gone"))  # lines of one document
    joined = facts.dropDuplicates(["doc_id", "text_crc"]).join(lists, ["doc_id", "text_crc"], "left")
    n = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select("doc_id", "text_crc", "n_lines", F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_dropped"), F.when(F.col("gone").isNotNull(), bitmap("n_lines", "gone")).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, every column, with only the kept lines; rows without a bitmap stay as they are.

    Adds ``_n_lines`` and ``_n_dropped``.
    """
    added = ("_n_lines", "_n_dropped")
    plain, names, at = plain_names(docs, added)
    known = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_crc").alias("_crc"), F.col("n_lines").alias("_n_lines"), F.col("n_dropped").alias("_n_dropped"), F.col("keep").alias("_keep"))
    text = F.col(at[text_col]).cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    joined = plain.join(known, (F.col(at[id_col]).cast("long") == F.col("_id")) & (crc == F.col("_crc")), "left")
    kept = F.when(F.col("_keep").isNull(), text).otherwise(kept_lines(text, "_keep"))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = joined.withColumns({at[text_col]: kept, "_n_lines": F.coalesce("_n_lines", lines, F.lit(1)), "_n_dropped": F.coalesce("_n_dropped", F.lit(0))})
    return out.select(*plain.columns, *added).toDF(*names, *added)
