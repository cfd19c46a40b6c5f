"""Column functions: text cleaning, sequences, coordinates, rounding."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Chromosomes in their natural order.
CHROMOSOMES = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY"]
#: The letters of a base.
_BASES = np.frombuffer("ACGTacgt".encode("utf-32-le"), np.uint32)


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal comma; null where it is none."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def strip_version(c: Column) -> Column:
    """An accession without its version: every dot with the digits after it goes."""
    return F.regexp_replace(c, r"\.[0-9]+", "")


def before_bar(c: Column) -> Column:
    return F.regexp_replace(c, r"\|.*", "")


def drop_first(c: Column, literal: str) -> Column:
    """Without the first occurrence of a literal."""
    at = F.instr(c, literal)
    n = len(literal)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + n, F.length(c)))).otherwise(c)


def class_and_family(c: Column, sep: str = "/") -> tuple[Column, Column]:
    """The parts of ``class/family``; the family is null without a separator."""
    parts = F.split(c, sep)
    return F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(2))


def accession(c: Column) -> Column:
    """The second field of ``db|accession|name``."""
    return F.try_element_at(F.split(c, r"\|"), F.lit(2))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def row_sum(cols: list[Column]) -> Column:
    return reduce(add, cols)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose names the pattern finds."""
    import re

    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def bases_only(c: Column) -> Column:
    """A, C, G, T in capitals; every other letter goes."""
    return F.regexp_replace(F.upper(c), "[^ACGT]", "")


def base_digits(c: Column) -> Column:
    return F.translate(c, "ACGT", "0123")


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def gc_percent(c: Column) -> Column:
    """Share of G and C among A, C, G, T in percent; 0 when there are none."""
    s = bases_only(c)
    n = F.length(s)
    return F.when(n > 0, F.length(F.regexp_replace(s, "[AT]", "")) * 100.0 / n).otherwise(0.0)


def strand_position(at: Column, length: Column, span: int) -> Column:
    """1-based signed position of a window in a sequence and its appended reverse complement (0-based ``at``)."""
    return F.when(at < length, at + 1).otherwise(-(2 * length - at - span + 1))


def opposite_position(at: Column, length: Column, span: int) -> Column:
    """Where the same window starts on the other strand, in the doubled sequence."""
    return 2 * length - at - span


@F.pandas_udf(T.StringType())
def _laid_over(sample: pd.Series, template: pd.Series) -> pd.Series:
    out = []
    for letters, text in zip(sample, template, strict=True):
        places = text and np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not text or not (base := np.isin(places, _BASES)).any():
            out.append(text)
        elif letters is None:
            out.append(None)
        else:
            new = np.frombuffer(letters.encode("utf-32-le"), np.uint32)
            n = int(base.sum())
            made, at = places.copy(), np.flatnonzero(base)
            made[at[: len(new)]] = new[:n]
            out.append(np.delete(made, at[len(new) :]).tobytes().decode("utf-32-le"))
    return pd.Series(out, dtype=object)


def with_gaps(sample: Column, template: Column) -> Column:
    """The letters of a sampled string laid over a template; what is no base in the template stays.

    A text costs in proportion to its length. Bases beyond the end of the sample go.
    """
    return _laid_over(sample, template)


def resized(start: Column, stop: Column, width: int) -> tuple[Column, Column]:
    """An interval of a fixed width about the centre of another; may be fractional."""
    spare = (F.lit(width) - (stop - start)) / 2.0
    return start - spare, stop + spare


def chromosome_rank(c: Column) -> Column:
    """1..24 in natural order, null for other names."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CHROMOSOMES)), c), F.lit(0))
