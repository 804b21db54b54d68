"""Row filters with NaN-safe bounds, null audits and membership tests."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


@dataclass(frozen=True)
class Bound:
    """A bound on one column; null and NaN never satisfy it."""

    name: str
    value: float
    upper: bool = False
    strict: bool = False

    def column(self) -> Column:
        c = F.col(f"`{self.name}`").cast("double")
        test = (c < self.value if self.strict else c <= self.value) if self.upper else (c > self.value if self.strict else c >= self.value)
        return c.isNotNull() & ~F.isnan(c) & test


def at_least(name: str, value: float) -> Bound:
    return Bound(name, value)


def at_most(name: str, value: float) -> Bound:
    return Bound(name, value, upper=True)


def inside(name: str, low: float, high: float) -> list[Bound]:
    """Strictly between two bounds."""
    return [Bound(name, low, strict=True), Bound(name, high, upper=True, strict=True)]


def apply_filters(df: DataFrame, filters: Iterable[Bound], fail_if_empty: bool = False) -> DataFrame:
    """All bounds as one conjunction that can reach the scan; a missing column raises KeyError."""
    keep = F.lit(True)
    for f in filters:
        if f.name not in df.columns:
            raise KeyError(f"no column {f.name} in {df.columns}")
        keep = keep & f.column()
    out = df.where(keep)
    if fail_if_empty and out.isEmpty():
        raise ValueError("no row passes the filters")
    return out


#: The default quality bounds of a segment, in order; one column may be bounded twice.
QUALITY = (
    Bound("missed_chars_percentage__segments", 0.065, upper=True),
    Bound("char_norm_word_dist_80__segments", 0.3, upper=True),
    Bound("std_norm_word_dist_with_gaps__segments", 0.334, upper=True),
    Bound("recognized_sound_coverage__segments", 0.625),
    Bound("std_char_duration__segments", 0.175, upper=True),
    Bound("avg_char_duration__segments", 0.175, upper=True),
    Bound("char_norm_word_dist_with_gaps_90__segments", 0.795, upper=True, strict=True),
    Bound("avg_norm_word_dist__segments", 0.165, upper=True, strict=True),
    Bound("duration__segments", 54, upper=True, strict=True),
    Bound("duration__segments", 0.81, strict=True),
    Bound("missed_words_percentage__segments", 0.118, upper=True, strict=True),
    Bound("missed_chars_percentage__segments", 0.052, upper=True, strict=True),
    Bound("char_norm_word_dist_with_gaps_60__segments", 0.11, upper=True, strict=True),
    Bound("median_norm_word_dist__segments", 0.01, upper=True, strict=True),
)


def quality_bounds(**values: float) -> list[Bound]:
    """``QUALITY`` with other values: by column name, followed by _ub or _lb where a column has both kinds."""
    out = []
    for b in QUALITY:
        side = "_ub" if b.upper else "_lb"
        out.append(replace(b, value=values.get(b.name + side, values.get(b.name, b.value))))
    unknown = set(values) - {b.name + side for b in QUALITY for side in ("", "_ub", "_lb")}
    if unknown:
        raise KeyError(f"no bounds on {sorted(unknown)}")
    return out


def member(df: DataFrame, keys: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    """Rows whose key is (not) among ``keys``; a null key is in no list."""
    return df.join(keys.select(*on).distinct(), on, "left_anti" if negate else "left_semi")


def excluded_by(column: Column, patterns: list[str]) -> Column:
    """True where none of the patterns is found."""
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~column.rlike(p)
    return keep


def null_audit(df: DataFrame, words: tuple[str, ...] = ("", "None", "NULL", "null", "NaN")) -> DataFrame:
    """(column, bad): nulls, NaNs and strings that stand for null, in one pass over all columns."""
    tests = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        bad = c.isNull()
        if isinstance(f.dataType, (DoubleType, FloatType)):
            bad = bad | F.isnan(c)
        if isinstance(f.dataType, StringType):
            bad = bad | F.trim(c).isin(*words)
        tests.append(F.count_if(bad).alias(f.name))
    row = df.agg(*tests)
    names = ", ".join(f"'{f.name}', `{f.name}`" for f in df.schema.fields)
    return row.select(F.expr(f"stack({len(df.columns)}, {names}) as (column, bad)"))


def null_total(df: DataFrame) -> DataFrame:
    """All bad cells of a table in one number."""
    return null_audit(df).agg(F.sum("bad").alias("bad"))
