"""One scan for what the profile, the regression and the daily job each want to add up.

The table is grouped by day once. A day's row holds counts, ranges and sums of all columns, the sums of products of the
regression's columns (the Gram matrix of shifted values), and the statistics of the value column. All of these can be
added, so the days themselves are the daily job, and their total is the rest. Least squares follow from the Gram matrix.
"""

from __future__ import annotations

from functools import cached_property
from threading import Lock

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import identifier, is_numeric, present, quoted
from tableprobe.functions.timestamps import parse_timestamp

MOST_FEATURES = 12  # beyond, products of pairs make an aggregate that is no longer compiled
MOST_COLUMNS = 24


def gram_sql(size: int) -> list[str]:
    """Sums over columns z0.. of shifted values, 0 in rows that don't count, and ``ok``, 1 in those that do."""
    sums = ["sum(ok) AS n", *[f"sum(z{i}) AS s{i}" for i in range(size)]]
    return sums + [f"sum(z{i} * z{j}) AS p{i}_{j}" for i in range(size) for j in range(i, size)]


def shifted_sql(df: DataFrame, columns: list[str], origin: list[float]) -> list[str]:
    """``ok`` and z0..: the columns minus an origin, so that large offsets don't drown the sums of squares."""
    types = {f.name: f.dataType for f in df.schema.fields}
    whole = " AND ".join(present(c, types[c]) for c in columns)
    return [f"bigint({whole}) AS ok"] + [
        f"CASE WHEN {whole} THEN double({identifier(c)}) - ({o!r}D) ELSE 0D END AS z{i}"
        for i, (c, o) in enumerate(zip(columns, origin))]


def origin_of(df: DataFrame, columns: list[str]) -> list[float] | None:
    """The columns of some row that misses none of them as finite doubles; None if there is no such row."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.where(" AND ".join(present(c, types[c]) for c in columns)).selectExpr(
        *[f"double({identifier(c)}) AS z{i}" for i, c in enumerate(columns)]).first()
    return None if row is None else [v if np.isfinite(v) else 0.0 for v in row]


def least_squares(sums: dict, origin: list[float]) -> dict:
    """Coefficients, intercept, rmse and r2 of the last column on the others, from `gram_sql`.

    Columns that others determine share their part: of all solutions the shortest in standard units is taken.
    """
    size, n = len(origin), sums["n"]
    s = np.array([sums[f"s{i}"] for i in range(size)]) / n
    product = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            product[i, j] = product[j, i] = sums[f"p{i}_{j}"] / n
    covariance = product - np.outer(s, s)
    variance = np.maximum(np.diag(covariance), 0)
    varies = variance > 1e-14 * np.maximum(np.diag(product), 1e-300)
    spread = np.where(varies, np.sqrt(np.where(varies, variance, 1)), 1.0)
    scaled = covariance / np.outer(spread, spread) * np.outer(varies, varies)
    if not np.isfinite(scaled).all():
        return {"coefficients": [float("nan")] * (size - 1), "intercept": float("nan"), "rmse": float("nan"), "r2": float("nan")}
    beta = np.linalg.pinv(scaled[:-1, :-1], rcond=1e-12, hermitian=True) @ scaled[:-1, -1]
    slopes = beta * spread[-1] / spread[:-1]
    means = s + np.array(origin)
    error = max(0.0, 1 - 2 * beta @ scaled[:-1, -1] + beta @ scaled[:-1, :-1] @ beta) if varies[-1] else 0.0
    return {"coefficients": slopes.tolist(), "intercept": float(means[-1] - slopes @ means[:-1]),
            "rmse": float(spread[-1] * error ** 0.5) if varies[-1] else 0.0,
            "r2": float(1 - error) if varies[-1] else float("nan")}


class SharedScan:
    """The sums of one table, taken once and when first asked for; to be closed."""

    def __init__(self, df: DataFrame, columns: list[str], date_col: str, value_col: str):
        self.df, self.columns, self.date_col, self.value_col = df, columns, date_col, value_col
        self._lock, self._kept = Lock(), None

    @staticmethod
    def fits(df: DataFrame, columns: list[str]) -> bool:
        """Whether the table is narrow enough for one compiled aggregate."""
        return len(df.columns) <= MOST_COLUMNS and len(columns) <= MOST_FEATURES + 1

    @cached_property
    def origin(self) -> list[float]:
        return origin_of(self.df, self.columns) or [0.0] * len(self.columns)

    def by_day(self) -> DataFrame:
        """One row per day (null for rows without one): `gram_sql`, d_count.. of the value, n{c}, lo{c}, hi{c}, t{c}."""
        with self._lock:
            if self._kept is None:
                self._kept = self._grouped().persist(StorageLevel.MEMORY_AND_DISK)
            return self._kept

    def _grouped(self) -> DataFrame:
        df, value = self.df, identifier(self.value_col)
        here = present(self.value_col, df.schema[self.value_col].dataType)
        day = F.to_date(parse_timestamp(df, self.date_col)).alias("day")
        cells = [F.expr(e) for e in shifted_sql(df, self.columns, self.origin)]
        cells += [quoted(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
        cells.append(F.expr(f"CASE WHEN {here} THEN double({value}) END AS value"))
        measures = ["count(1) AS rows", *gram_sql(len(self.columns)), "count(value) AS d_count", "sum(value) AS d_sum",
                    "min(value) AS d_min", "max(value) AS d_max"]
        for i, field in enumerate(df.schema.fields):
            measures.append(f"count(c{i}) AS n{i}")
            if is_numeric(field.dataType):
                measures += [f"double(min(c{i})) AS lo{i}", f"double(max(c{i})) AS hi{i}", f"sum(double(c{i})) AS t{i}"]
        return df.select(day, *cells).groupBy("day").agg(*map(F.expr, measures))

    def close(self) -> None:
        with self._lock:
            if self._kept is not None:
                self._kept.unpersist()

    def days(self) -> DataFrame:
        """What `daily_stats` gives."""
        return self.by_day().where("day IS NOT NULL AND d_count > 0").select(
            "day", F.col("d_count").alias("count"), (F.col("d_sum") / F.col("d_count")).alias("mean_value"),
            F.col("d_min").alias("min_value"), F.col("d_max").alias("max_value"), F.col("d_sum").alias("sum_value"))

    def regression(self) -> dict | None:
        """What `least_squares` gives, and None if every row misses a value."""
        names = [e.rsplit(" AS ", 1)[1] for e in gram_sql(len(self.columns))]
        sums = self.by_day().agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
        return least_squares(sums, self.origin) if sums["n"] else None

    def stats(self) -> DataFrame:
        """One row per column: rows, pos, column, type, present, min, max, mean (rounded to 6 decimals)."""
        fields = self.df.schema.fields
        totals, cells = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")], []
        for i, field in enumerate(fields):
            totals.append(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"))
            if is_numeric(field.dataType):
                totals += [F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"),
                           F.round(F.sum(f"t{i}") / F.sum(f"n{i}"), 6).alias(f"t{i}")]
                cells.append(f"{i}, n{i}, lo{i}, hi{i}, t{i}")
            else:
                cells.append(f"{i}, n{i}, double(null), double(null), double(null)")
        turned = self.by_day().agg(*totals).selectExpr(
            "rows", f"stack({len(cells)}, {', '.join(cells)}) AS (pos, present, min, max, mean)")
        place = F.col("pos") + 1
        return turned.select(
            "rows", "pos", F.element_at(F.lit(self.df.columns), place).alias("column"),
            F.element_at(F.lit([f.dataType.simpleString() for f in fields]), place).alias("type"),
            "present", "min", "max", "mean")


def moments(df: DataFrame, columns: list[str]) -> dict | None:
    """`least_squares` of the last column on the others over the rows that miss none, from one scan; None without any."""
    origin = origin_of(df, columns)
    if origin is None:
        return None
    sums = df.select(*[F.expr(e) for e in shifted_sql(df, columns, origin)]).where("ok = 1").agg(
        *[F.expr(e) for e in gram_sql(len(columns))])
    return least_squares(sums.first().asDict(), origin)

