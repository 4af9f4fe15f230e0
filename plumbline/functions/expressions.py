"""Column expressions for cleaning, labelling and encoding. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are spelled out because \w covers ASCII only in Java regular expressions.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"


def parse_int_array(col: Column, separator: str = ":") -> Column:
    """``'1:20:3'`` -> ``[1, 20, 3]``."""
    return F.split(col, separator).cast("array<int>")


def normalise_array(col: Column, divisor: float) -> Column:
    return F.transform(col, lambda v: v.cast("double") / F.lit(float(divisor)))


def safe_log(col: Column) -> Column:
    """Natural logarithm with ``0 -> 0``; negative values give NaN, nulls stay null."""
    x = col.cast("double")
    return F.when(x == 0, F.lit(0.0)).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def number(col: Column) -> Column:
    """The column as a double, NaN being a missing value like null."""
    return F.nullif(col.cast("double"), F.lit(float("nan")))


def positive_flag(col: Column) -> Column:
    """``col > 0`` where a null or NaN counts as false."""
    return F.coalesce(number(col) > 0, F.lit(False))


def binarize(col: Column, classes: Sequence) -> Column:
    """Encode the second of two classes as 1.0 and everything else, nulls included, as 0.0."""
    if len(classes) != 2:
        raise ValueError("binarize needs exactly two classes")
    return col.eqNullSafe(F.lit(classes[1])).cast("double")


def add_separator_join(cols: Sequence[Column], separator: str = " ") -> Column:
    """Concatenate with a separator; one null makes the whole result null."""
    parts: list[Column] = []
    for i, col in enumerate(cols):
        if i:
            parts.append(F.lit(separator))
        parts.append(col)
    return F.concat(*parts)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    An expression repeated in a lambda is otherwise evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def word_ngrams(text: Column, low: int = 1, high: int = 3) -> Column:
    """All word n-grams of ``low..high`` words, lower-cased, over the whole text."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(1))

    def grams_of_length(tokens: Column, n: int) -> Column:
        starts = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
        grams = F.slice(tokens, F.lit(1), starts)
        for shift in range(1, n):
            following = F.slice(tokens, F.lit(shift + 1), starts)
            grams = F.zip_with(grams, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return grams

    return bind(words, lambda t: F.concat(*[grams_of_length(t, n) for n in range(low, high + 1)]))


def hash_code(gram: Column, buckets: int) -> Column:
    """A code in ``0 .. 2*buckets-1`` from the first nine hex digits of the md5.

    Codes below ``buckets`` add one to bucket ``code``; the others take one from ``code - buckets``.
    """
    return (F.conv(F.substring(F.md5(gram), 1, 9), 16, 10).cast("bigint") % (2 * buckets)).cast("int")


#: n-grams that one counting step takes at once; a longer text is a step of its own.
STEP = 1 << 18


def hashed_ngrams(
    text: Column, buckets: int = 100, low: int = 1, high: int = 3, normalise: bool = True
) -> Column:
    """Signed n-gram counts by hash bucket as ``array<struct<pos,value>>``, without zeros, in order of the buckets;
    L2-normalised on request.

    Tokens, n-grams and hashes are built-in expressions; only the counting of the small integer codes leaves the JVM.
    It costs as much as there are n-grams, however many buckets there are.
    """
    codes = F.transform(word_ngrams(text, low, high), lambda g: hash_code(g, buckets))
    return _bucket_counter(buckets, normalise)(codes)


def _bucket_counter(buckets: int, normalise: bool):
    @F.arrow_udf("array<struct<pos:int,value:double>>")
    def count_buckets(codes: pa.Array) -> pa.Array:
        lengths = codes.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        flat = codes.flatten().to_numpy()
        # no more entries than codes; each step fills in its own, and pages that none reaches take no memory
        places, values = np.empty(len(flat), np.int32), np.empty(len(flat), np.float64)
        sizes = np.zeros(len(lengths) + 1, np.int32)
        first = filled = 0
        while first < len(lengths):
            last = max(int(np.searchsorted(ends, ends[first] + STEP, side="right")) - 1, first + 1)
            part = flat[ends[first] : ends[last]].astype(np.int64)
            rows = np.repeat(np.arange(last - first), lengths[first:last])
            cells, number = np.unique(rows * buckets + part % buckets, return_inverse=True)
            sums = np.bincount(number, np.where(part < buckets, 1.0, -1.0), len(cells))
            cells, sums = cells[sums != 0], sums[sums != 0]
            rows = cells // buckets
            if normalise:
                sums = sums / np.sqrt(np.bincount(rows, sums**2, last - first))[rows]
            sizes[first + 1 : last + 1] = np.bincount(rows, minlength=last - first)
            places[filled : filled + len(cells)] = cells % buckets
            values[filled : filled + len(cells)] = sums
            filled += len(cells)
            first = last
        offsets = np.cumsum(sizes, dtype=np.int32)  # the codes' offsets are 32 bits wide too
        held = [pa.array(places[:filled]), pa.array(values[:filled])]
        entries = pa.StructArray.from_arrays(held, names=["pos", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets), entries)

    return count_buckets
