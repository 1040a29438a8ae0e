"""Encoding of a table: factor levels, ranges, null mask, codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)
FACTOR = (T.StringType, T.BooleanType)
#: Levels up to which codes come from a literal map; more are joined.
MAP_LEVELS = 2000


@dataclass
class Encoding:
    """What a table says about its variables."""

    numeric: list[str] = field(default_factory=list)
    factors: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def code(self, factor: str, level: str) -> int:
        return self.levels[factor].index(str(level))


def fine(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def kinds(df: DataFrame, variables: Sequence[str], as_factor: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric variables and factors, by column type."""
    numeric, factors = [], []
    for v in variables:
        if v not in df.columns:
            raise KeyError(f"the table has no column {v!r}")
        kind = df.schema[v].dataType
        if v in as_factor or isinstance(kind, FACTOR):
            factors.append(v)
        elif isinstance(kind, NUMERIC):
            numeric.append(v)
        else:
            raise TypeError(f"column {v!r} has the type {kind.simpleString()}, which is neither numeric nor a factor")
    return numeric, factors


def learn(df: DataFrame, variables: Sequence[str], as_factor: Sequence[str] = (), codebook: dict[str, dict[str, int]] | None = None) -> Encoding:
    """Ranges and levels in one job, over all rows, also those that a null drops later."""
    numeric, factors = kinds(df, variables, as_factor)
    wanted = []
    for v in numeric:
        clean = F.when(fine(v), F.col(v).cast("double"))
        wanted += [F.min(clean).alias(f"low_{v}"), F.max(clean).alias(f"high_{v}")]
    for v in factors:
        wanted.append(F.array_sort(F.collect_set(F.col(v).cast("string"))).alias(f"levels_{v}"))  # as many as coefficients
    row = df.agg(*wanted).first() if wanted else None
    levels = {}
    for v in factors:
        levels[v] = list(row[f"levels_{v}"])
        if codebook and v in codebook:
            book = {str(k): c for k, c in codebook[v].items()}
            if sorted(book.values()) != list(range(len(book))) or set(levels[v]) - set(book):
                raise ValueError(f"the codebook of {v!r} doesn't number all its levels from 0")
            levels[v] = sorted(book, key=book.get)
    return Encoding(numeric, factors, {v: (row[f"low_{v}"], row[f"high_{v}"]) for v in numeric}, levels)


def code(df: DataFrame, v: str, levels: list[str], to: str) -> DataFrame:
    """Column ``to`` with the level's number; null for null and unseen levels."""
    if len(levels) <= MAP_LEVELS:
        table = F.create_map(*[x for k, lev in enumerate(levels) for x in (F.lit(lev), F.lit(k))]) if levels else None
        return df.withColumn(to, F.try_element_at(table, F.col(v).cast("string")) if levels else F.lit(None).cast("int"))
    table = df.sparkSession.createDataFrame(list(enumerate(levels)), f"`{to}` int, _level string")
    return df.join(table, F.col(v).cast("string") == F.col("_level"), "left").drop("_level")


def encode(df: DataFrame, enc: Encoding, responses: Sequence[Column] = (), keep: Sequence[str] = (), drop_null: bool = True) -> DataFrame:
    """``y0``, ``y1``, ... , ``n_<numeric>`` as double, ``c_<factor>`` as codes (-1 unseen) and ``keep``."""
    made = df.withColumns({f"y{k}": y.cast("double") for k, y in enumerate(responses)}) if responses else df
    for v in enc.factors:
        made = code(made, v, enc.levels[v], f"c_{v}")
    made = made.withColumns({f"n_{v}": F.col(v).cast("double") for v in enc.numeric}) if enc.numeric else made
    if drop_null:
        good = F.lit(True)
        for k in range(len(responses)):
            good &= fine(f"y{k}")
        for v in enc.numeric:
            good &= fine(f"n_{v}")
        for v in enc.factors:
            good &= F.col(v).isNotNull()
        made = made.where(good)
    names = [*(f"y{k}" for k in range(len(responses))), *(f"n_{v}" for v in enc.numeric)]
    return made.select(*names, *(F.coalesce(F.col(f"c_{v}"), F.lit(-1)).alias(f"c_{v}") for v in enc.factors), *[c for c in keep if c not in names])


def na_mask(df: DataFrame, variables: Sequence[str]) -> Column:
    """True where no variable is null or NaN."""
    good = F.lit(True)
    for v in variables:
        numeric = isinstance(df.schema[v].dataType, NUMERIC)
        good &= fine(v) if numeric else F.col(v).isNotNull()
    return good


def lagged(df: DataFrame, series: str, order: Sequence[str], column: str, by: int | str, to: str) -> DataFrame:
    """``column`` a number of rows earlier in the series, null before its start: a shift by ``by`` rows.

    ``by`` is a number or a column of the series' event place; then the rows are joined on (series, place).
    """
    own = Window.partitionBy(series).orderBy(*order)
    if isinstance(by, int):
        return df.withColumn(to, F.lag(column, by).over(own))
    placed = df.withColumn("_place", F.row_number().over(own) - 1)
    source = placed.select(F.col(series).alias("_series"), F.col("_place").alias("_from"), F.col(column).alias(to))
    met = placed.join(source, (F.col(series) == F.col("_series")) & (F.col("_place") - F.col(by) == F.col("_from")), "left")
    return met.drop("_place", "_series", "_from")
