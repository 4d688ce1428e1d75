"""Statistics of whole texts, vectorised over the bytes of many texts. Words are runs of non-white-space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernstone.llm.bytewise import NON_SPACE, Texts, chunks, grouped, owners, table, windows
from quernstone.llm.store import small_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _LOWERS, _DIGIT = table((0x41, 0x5A)), table((0x61, 0x7A)), table((0x30, 0x39))
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,;:?")] = True

#: Counts, in this order; the first five are those of the quality rules.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_lower", "n_digits",
    "n_marks", "n_stops", "n_wide", "n_distinct", "n_top", "n_twice",
)


def _unique(owner: np.ndarray, h: np.ndarray, n: int):
    return grouped(owner, h, max(1, int(n - 1).bit_length()))


def counts(t: Texts) -> np.ndarray:
    """(texts, COUNTS) as integers."""
    d, n = t.data, len(t)
    inside = NON_SPACE[d]
    begin, end, first = t.spans(inside)
    h = t.hashes(d, begin, end)
    owner = owners(first)
    out = np.zeros((n, len(COUNTS)), np.int64)
    put = dict(zip(COUNTS, out.T, strict=True))
    points = (d & 0xC0) != 0x80
    put["n_words"][:] = np.diff(first)
    put["word_chars"][:] = t.sums(points & inside)
    put["n_chars"][:] = t.sums(points)
    for name, mask in (("n_symbols", SYMBOLS), ("n_upper", _UPPER), ("n_lower", _LOWERS), ("n_digits", _DIGIT), ("n_stops", _STOPS)):
        put[name][:] = t.sums(mask[d])
    put["n_marks"][:] = t.sums(d == 0x21)
    put["n_wide"][:] = t.sums(d >= 0xC0)
    # Lines with a word, and those equal to an earlier one.
    b, e, line_first = t.spans(d != 0x0A)
    worded = np.searchsorted(begin, e) > np.searchsorted(begin, b)
    line_owner = owners(line_first)[worded]
    put["n_lines"][:] = np.bincount(line_owner, minlength=n)
    own, _, c, _ = _unique(line_owner, t.hashes(d, b[worded], e[worded]), n)
    put["n_dup_lines"][:] = np.bincount(own, c - 1, n)
    # Words inside a window of three that is found twice or more.
    at, w = windows(h, first, 3)
    _, _, c, back = _unique(owner[at], w, n)
    again = at[c[back] > 1] if len(at) else at
    marked = np.zeros(len(h), bool)
    for k in range(3):
        marked[again + k] = True
    put["n_repeat_words"][:] = np.bincount(owner[marked], minlength=n)
    own, _, c, _ = _unique(owner, h, n)
    put["n_distinct"][:] = np.bincount(own, minlength=n)
    np.maximum.at(put["n_top"], own, c)
    twice = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1]))
    put["n_twice"][:] = np.bincount(owner[twice], minlength=n)
    return out


def with_counts(docs: DataFrame, names: tuple[str, ...] = COUNTS, *, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The kept columns (new name: old name) and the named counts of each row's whole text; a null text counts as empty."""
    small_batches(docs.sparkSession)
    keep = {"doc_id": "doc_id"} if keep is None else keep
    narrow = docs.select(docs[text_col].alias("__text"), *[docs[old].alias(new) for new, old in keep.items()])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[1:]] + [f"{c} bigint" for c in names])
    wanted = [COUNTS.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch.column(0)):
                part, found = batch.slice(t.first, len(t)), counts(t)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(found[:, k]) for k in wanted)], names=[*part.schema.names[1:], *names])

    return narrow.mapInArrow(run, schema)
