"""Column helpers that the operators share. All of them are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(key: str, ts: str) -> WindowSpec:
    """Rows of one key in time order. All frames over it share one exchange and one sort."""
    return Window.partitionBy(key).orderBy(ts)


def trailing(spec: WindowSpec, n: int, *, current: bool = True) -> WindowSpec:
    """The last n rows, with the current one or only those before it."""
    return spec.rowsBetween(-n + 1, 0) if current else spec.rowsBetween(-n, -1)


def full(value: Column, counted: Column, n: int, frame: WindowSpec) -> Column:
    """A windowed value, null until the frame has n non-null rows."""
    return F.when(F.count(counted).over(frame) == n, value)


def ratio(a: Column, b: Column, *, positive: bool = False) -> Column:
    """a / b; null where b is null, zero or, with `positive`, below zero."""
    return F.when(b > 0 if positive else b != 0, a / b)


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent from a positive value."""
    return F.when(before > 0, (now / before - 1) * 100)


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (value - mean) / std)


def bands(value: Column, steps: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """The label of the first step that the value reaches; steps go from high to low."""
    out = None
    for low, label in steps:
        out = F.when(value >= low, label) if out is None else out.when(value >= low, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def clean_number(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Round columns last, after all that derives from them; to nine digits first, so that
    the order of a sum, which moves its last bits, doesn't decide a tie."""
    return df.withColumns({c: F.round(F.round(c, 9), n) for c, n in digits.items() if c in df.columns})


def flag(condition: Column) -> Column:
    """A condition whose unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], *, n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order (Spark limits each group ahead of the shuffle)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
