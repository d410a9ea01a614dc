"""Columns of string similarity, loudness and time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters that a row of bits holds, with room for the carry.
BITS = 61


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def letter_masks(b: Column) -> Column:
    """Each letter of b, with its places as the bits of a number."""
    letters = F.transform(F.split(b, ""), lambda y, i: F.struct(y.alias("y"), _bit(i).alias("bit")))
    places = lambda x: F.aggregate(letters, F.lit(0).cast("long"), lambda m, y: F.when(y.y == x, m.bitwiseOR(y.bit)).otherwise(m))
    return F.map_from_entries(F.transform(F.array_distinct(F.split(b, "")), lambda x: F.struct(x, places(x))))


def _lcs_by_masks(letters: Column, masks: Column, length: Column) -> Column:
    """A row of the table per letter, each a row of bits."""
    whole = _bit(length) - 1

    def step(row: Column, x: Column) -> Column:
        same = row.bitwiseAND(F.coalesce(F.try_element_at(masks, x), F.lit(0).cast("long")))
        return (row + same).bitwiseOR(row - same).bitwiseAND(whole)

    return length - F.bit_count(F.aggregate(letters, whole, step))


def lcs_length(a: Column, b: Column, letters: Column | None = None, masks: Column | None = None) -> Column:
    """Length of the longest common subsequence: by rows of bits if b has up to 61 characters, as
    callsigns do, else by rows of numbers. Joins of many pairs hand over the letters of a and the
    letter masks of b, made once per row."""
    if masks is None:
        bits = F.get(F.transform(F.array(letter_masks(b)), lambda m: _lcs_by_masks(F.split(a, ""), m, F.length(b))), F.lit(0))
    else:
        bits = _lcs_by_masks(letters, masks, F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).when(F.length(b) <= BITS, bits).otherwise(_lcs_of_long(a, b))


def _lcs_of_long(a: Column, b: Column) -> Column:
    """The same with rows of len(b) + 1 numbers, each folded over b with the value to the left."""
    letters = F.split(b, "")
    empty = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)),
            F.array(F.lit(0)),
            lambda out, j: F.concat(out, F.array(F.when(F.get(letters, j - 1) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(out, j - 1))))),
        )

    rows = F.aggregate(F.split(a, ""), empty, next_row)
    return F.get(rows, F.length(b))


def indel_ratio(a: Column, b: Column, letters: Column | None = None, masks: Column | None = None) -> Column:
    """Normalised insert-delete similarity, 0 to 100; letters and masks as for lcs_length."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b, letters, masks) / total)


def _codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    """Characters as numbers, a column per string, filled up with pad."""
    lengths = np.array([len(x) for x in strings])
    codes = np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width).T.astype(np.int64)
    codes[np.arange(width)[:, None] >= lengths] = pad
    return codes


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Longest common subsequences of pairs of strings, a table row for all pairs at a time. Pairs of
    like length go together, so that a long string does not widen the others."""
    sizes = np.array([max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)], dtype=np.int64)
    out, low = np.zeros(len(a), dtype=np.int64), 0
    for width in (8, 16, 64, int(sizes.max(initial=0))):
        at = np.flatnonzero((sizes > low) & (sizes <= width))
        low = max(low, width)
        step = max(1, (1 << 16) // width)
        for part in (at[i : i + step] for i in range(0, len(at), step)):
            left, right = _codes([a[i] for i in part], width, -1), _codes([b[i] for i in part], width, -2)
            row = np.zeros((width + 1, len(part)), dtype=np.int16 if width < 1 << 15 else np.int64)
            for letter in left:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(right == letter, row[:-1] + 1, 0)), axis=0)
            out[part] = row[-1]
    return out


class Names:
    """Strings that others are compared with, all at once: a row of the table of common subsequences is a
    row of bits per name, in order of their length and then of `order`."""

    def __init__(self, names: list[str], order: np.ndarray):
        sizes = np.array([len(x) for x in names], dtype=np.int64)
        self.groups = []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(order[at], kind="stable")]
            part = [names[i] for i in at]
            masks: dict[str, np.ndarray] = {}
            if 0 < size <= 64:
                kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)) if size <= n)
                codes = _codes(part, size, -1)
                for place in range(size):
                    for code in np.unique(codes[place]).tolist():
                        mask = masks.setdefault(chr(code), np.zeros(len(at), dtype=kind))
                        mask[codes[place] == code] |= kind(1 << place)
            self.groups.append((size, at, part, masks))

    @staticmethod
    def _common(text: str, size: int, part: list[str], masks: dict[str, np.ndarray]) -> np.ndarray:
        """Lengths of the longest common subsequences of text and the names of one length."""
        if size > 64:
            return lcs_lengths([text] * len(part), part)
        if not size:
            return np.zeros(len(part), dtype=np.uint8)
        whole = next(iter(masks.values())).dtype.type((1 << size) - 1)
        row = np.full(len(part), whole)
        for letter in text:
            if letter in masks:
                same = row & masks[letter]
                row = (row + same) | (row - same)
        return size - np.bitwise_count(row & whole)

    def best(self, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the k names that are most alike, or of some more."""
        found, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for size, at, part, masks in self.groups:
            common, left = self._common(text, size, part, masks), k
            for value in range(int(common.max()), -1, -1):
                hits = np.flatnonzero(common == value)[:left]
                found.append(at[hits])
                scores.append(np.full(len(hits), 200.0 * value / (len(text) + size) if text or size else 100.0))
                left -= len(hits)
                if not left:
                    break
        return np.concatenate(found), np.concatenate(scores)

    def above(self, text: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of all names that are as similar as `least`."""
        found, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for size, at, part, masks in self.groups:
            if not text and not size:
                score = np.full(len(at), 100.0)
            else:
                score = 200.0 * np.arange(size + 1) / (len(text) + size)
                enough = int(np.searchsorted(score, least))
                common = self._common(text, size, part, masks)
                at = at[hits := np.flatnonzero(common >= enough)]
                score = score[common[hits]]
            at, score = at[score >= least], score[score >= least]
            found.append(at)
            scores.append(score)
        return np.concatenate(found), np.concatenate(scores)


@F.pandas_udf(DoubleType())
def indel_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """indel_ratio of very many pairs, in Arrow batches: some hundred times the speed of folds over
    arrays."""
    known = a.notna() & b.notna()
    left, right = a[known].tolist(), b[known].tolist()
    total = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], dtype=np.float64)
    score = np.where(total > 0, 200.0 * lcs_lengths(left, right) / np.where(total > 0, total, 1), 100.0)
    return pd.Series(score, index=a.index[known], dtype="float64").reindex(a.index)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped to 0 to 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))


def level(rms_col: Column, full: float = 8000) -> Column:
    """Loudness on a logarithmic scale: 0 at an RMS of 1, below it and without one, 1 from `full` on."""
    return F.when(rms_col > 1, F.least(F.lit(1.0), F.log10(rms_col) / F.log10(F.lit(full)))).otherwise(F.lit(0.0))


def after_ms(start: Column, offset_ms: Column) -> Column:
    """The time that lies offset_ms milliseconds after start, in ISO form to the millisecond."""
    return F.date_format(F.timestamp_millis(F.unix_millis(start.cast("timestamp")) + offset_ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
