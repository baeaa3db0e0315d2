"""Fill-in-the-middle: texts cut into prefix, middle and suffix at token borders, and put in another order.

A text is decoded to its code points. A token is a run of letters A-Z and a-z,
or any other single code point, so a token begins wherever a code point or its
left neighbour is no such letter: one comparison of neighbouring classes and
one ``flatnonzero`` give all borders. Two borders are chosen by ranks that
come from a hash of the seed and the document's id; the pieces between them
are slices, encoded again and joined with the sentinels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import plain_names

PLAIN, PSM, SPM = "plain", "psm", "spm"
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = ("_fim_text", "_form", "_n_tokens", "_prefix_chars", "_middle_chars")


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """The sentinels, if no text without them can make one appear at a seam."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(b.endswith(a[:k]) for k in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} may overlap, so texts could not be restored")
    return sentinels


def token_borders(points: np.ndarray) -> np.ndarray:
    """Where each token begins, and the end of the text."""
    lower = points | 32
    letter = (lower >= 97) & (lower <= 122)
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    return np.append(np.flatnonzero(begins), len(points))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers below 2**32 from the hash of seed, colon and id; a null id counts as an empty string."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm_rate: int = 20, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``_fim_text, _form, _n_tokens, _prefix_chars, _middle_chars``.

    ``rate`` and ``spm_rate`` are per cent: of texts that are transformed, and
    of these in the order suffix, prefix, middle. Empty texts and texts that
    hold a sentinel stay plain, with null lengths of pieces; so
    :func:`restored` is always exact. A null text counts as empty and a null
    id as an empty string. Rows that repeat an id draw the same ranks. A text
    is handled whole, in memory in proportion to its length. Columns of the
    input that are named like added ones are replaced; others may have any
    name.
    """
    sentinels = checked(sentinels)
    p, s, m = sentinels

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_id, at_text = None, None
        for batch in batches:
            if at_id is None:
                at_id, at_text = (batch.schema.get_field_index(c) for c in ("_id", "_text"))
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(at_id).to_pylist(), batch.column(at_text)):
                text = text.as_py() or ""
                points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                borders = token_borders(points)
                n = len(borders) - 1
                h1, h2, h3, h4 = draws(doc, seed)
                if not text or h3 % 100 >= rate or any(x in text for x in sentinels):
                    row = (text, PLAIN, n, None, None)
                else:
                    a, b = sorted((int(borders[h1 % (n + 1)]), int(borders[h2 % (n + 1)])))
                    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, b), (b, len(points))))
                    form = SPM if h4 % 100 < spm_rate else PSM
                    row = ("".join((s, suffix, p, prefix, m, middle) if form == SPM else (p, prefix, s, suffix, m, middle)), form, n, a, b - a)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            kept = [batch.column(k) for k in range(batch.num_columns) if k not in (at_id, at_text)]
            names = [x for x in batch.schema.names if x not in ("_id", "_text")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*names, *ADDED])

    plain, names, new = plain_names(docs, ADDED)
    sent = plain.withColumn("_id", F.col(new[id_col]).cast("long")).withColumn("_text", F.col(new[text_col]).cast("string"))
    schema = plain.schema
    for name, kind in zip(ADDED, ("string", "string", "long", "long", "long")):
        schema = schema.add(name, kind)
    return sent.mapInArrow(cut, schema).toDF(*names, *ADDED)


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text that :func:`fill_in_middle` was given (a null one as empty), from its output and form alone."""
    parts = F.split(text, "|".join(map(_literal, checked(sentinels))), -1)
    return F.when(form == PLAIN, text).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).when(form == SPM, F.concat(parts[2], parts[3], parts[1]))


def _literal(sentinel: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", sentinel)
