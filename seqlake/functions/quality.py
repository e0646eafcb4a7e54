"""Column functions over base qualities."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import let

# Name, lowest and highest byte, offset, whether values are on the Solexa scale; in the order of guessing.
ENCODINGS: dict[str, tuple[int, int, int, bool]] = {
    "Sanger": (33, 126, 33, False),
    "Solexa": (59, 126, 64, True),
    "Illumina-1.3+": (64, 126, 64, False),
    "Illumina-1.5+": (66, 126, 64, False),
    "Illumina-1.8+": (33, 126, 33, False),
}
UNKNOWN = "Unknown"
#: Bytes that a quality may hold.
PRINTABLE = range(33, 127)


def phred_to_solexa(q: Column) -> Column:
    """Values below 0 are an error; 0 becomes -5."""
    bad = F.raise_error(F.lit("invalid Phred quality")).cast("double")
    return F.when(q == 0, F.lit(-5.0)).when(q < 0, bad).otherwise(F.greatest(F.lit(-5.0), 10 * F.log10(F.pow(F.lit(10.0), q / 10) - 1)))


def solexa_to_phred(q: Column) -> Column:
    """Values below -5 are an error."""
    return F.when(q < -5, F.raise_error(F.lit("invalid Solexa quality")).cast("double")).otherwise(10 * F.log10(F.pow(F.lit(10.0), q / 10) + 1))


def _letters(qual: Column) -> Column:
    return F.filter(F.split(qual, ""), lambda c: c != "")


def quality_values(qual: Column, encoding: str = "Sanger") -> Column:
    """array of values: bytes less the encoding's offset."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown quality encoding {encoding!r}")
    return F.transform(_letters(qual), lambda c: F.ascii(c) - ENCODINGS[encoding][2])


@lru_cache
def _counter() -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [(x or "").encode("latin-1", "replace") for x in batch]
            of = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            n = np.bincount(of * 256 + np.frombuffer(b"".join(texts), np.uint8), minlength=len(texts) * 256).reshape(-1, 256)[:, PRINTABLE.start : PRINTABLE.stop]
            yield pd.Series([None if x is None else row for x, row in zip(batch, n.astype(np.int32), strict=True)])

    return counts


def letter_counts(qual: Column) -> Column:
    """array of how often each printable letter ('!' first) stands in the text; one pass over a batch's bytes."""
    return _counter()(qual)


def _printable(qual: Column) -> Column:
    return ~F.rlike(qual, F.lit("[^!-~]"))


def total_quality(qual: Column, encoding: str = "Sanger") -> Column:
    """Sum of the values, from the letters' counts."""
    offset = ENCODINGS[encoding][2]
    values = F.transform(letter_counts(qual), lambda x, i: x.cast("long") * (i + PRINTABLE[0] - offset))
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


@lru_cache
def _letters_to(source: str, target: str, force: bool) -> bytes | None:
    """A table of 256 bytes, 0 where a byte is no value of the source's scale; None: nothing changes."""
    if source == target or UNKNOWN in (source, target):
        return None
    (_, _, offset, from_solexa), (_, _, new_offset, to_solexa) = ENCODINGS[source], ENCODINGS[target]
    table = bytearray(256)
    for b in PRINTABLE:
        q = b - offset
        if force and source == "Illumina-1.8+" and target == "Sanger":
            q = min(q, 40)
        if source == "Illumina-1.5+" and q == 2:
            q = 0
        if from_solexa and not to_solexa:
            q = None if q < -5 else int(10 * math.log10(10 ** (q / 10) + 1))
        elif to_solexa and not from_solexa:
            q = None if q < 0 else -5 if q == 0 else int(max(-5, 10 * math.log10(10 ** (q / 10) - 1)))
        if q is not None and q + new_offset >= 0:
            table[b] = q + new_offset
    return bytes(table)


@lru_cache
def _converter(force: bool) -> Callable[[Column, Column, Column], Column]:
    def changed(text: str | None, source: str | None, target: str | None) -> str | None:
        if text is None or source is None or target is None:
            return None
        table = _letters_to(source, target, force)
        if table is None:
            return text
        out = text.encode().translate(table)
        return None if 0 in out else out.decode("latin-1")

    @F.pandas_udf("string")
    def converted(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([changed(*row) for row in zip(*columns, strict=True)], dtype=object)

    return converted


def convert_quality(qual: Column, source: str | Column, target: str | Column, force: bool = False) -> Column:
    """The quality in another encoding: a letter for a letter. Values between the scales are cut to whole numbers.

    source, target: encodings' names, or columns of them. force: values over 40 become 40 from Illumina-1.8+ to Sanger. The
    value 2 of Illumina-1.5+ becomes 0. Nothing happens if both are the same or one is unknown. Letters that are no value of
    the source's scale are an error.
    """
    if isinstance(source, str) and isinstance(target, str) and _letters_to(source, target, force) is None:
        return qual
    source, target = (F.lit(x) if isinstance(x, str) else x for x in (source, target))
    out = _converter(force)(qual, source, target)
    error = F.raise_error(F.concat(F.lit("a letter is no quality of "), source)).cast("string")
    return F.when(out.isNull() & qual.isNotNull() & source.isNotNull() & target.isNotNull(), error).otherwise(out)


def guess_encodings(qual: Column, most_common: int = 2) -> Column:
    """array of the encodings whose range holds all bytes. Illumina-1.5+ is out if @ or A occur, and the only one if B
    is among the most common bytes (at equal numbers the smaller byte counts first). Empty: all but none; a byte that is
    no printable letter: none."""

    def guessed(n: Column) -> Column:
        used = F.filter(F.transform(n, lambda x, i: F.struct((-x).alias("n"), (i + PRINTABLE[0]).alias("b"))), lambda x: x["n"] < 0)

        def of_used(u: Column) -> Column:
            codes = F.transform(u, lambda x: x["b"])
            low, high = F.coalesce(F.array_min(codes), F.lit(126)), F.coalesce(F.array_max(codes), F.lit(0))
            fits = {name: (low >= a) & (high <= b) for name, (a, b, _, _) in ENCODINGS.items()}
            fits["Illumina-1.5+"] = fits["Illumina-1.5+"] & ~F.array_contains(codes, ord("@")) & ~F.array_contains(codes, ord("A"))
            enriched = fits["Illumina-1.5+"] & F.exists(F.slice(F.array_sort(u), 1, most_common), lambda x: x["b"] == ord("B"))
            return F.when(enriched, F.array(F.lit("Illumina-1.5+"))).otherwise(F.array_compact(F.array(*[F.when(ok, F.lit(name)) for name, ok in fits.items()])))

        return let(used, of_used)

    none = F.array().cast("array<string>")
    return F.when(_printable(qual), guessed(letter_counts(qual))).when(qual.isNotNull(), none)


def mean_quality(qual: Column, encoding: str = "Sanger") -> Column:
    """-10 log10 of the mean error probability, from the letters' counts; 0 without a quality."""
    offset = ENCODINGS[encoding][2]
    errors = F.transform(letter_counts(qual), lambda x, i: x * F.pow(F.lit(10.0), -(i + PRINTABLE[0] - offset) / 10))
    total = F.aggregate(errors, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.coalesce(F.length(qual), F.lit(0)) <= 0, 0.0).otherwise(-10 * F.log10(total / F.length(qual)))
