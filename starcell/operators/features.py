"""Scaling and encoding fitted on one frame and applied to others."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions.numeric import exact_sum, fixed_point
from starcell.plans.ordering import number_in_order
from starcell.plans.sizing import broadcast_if_small
from starcell.session import write_and_read

# Levels of a category up to which they are looked up in the row; others are joined.
INLINE_LEVELS = 100


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per column."""

    stats: Mapping[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, digits: Mapping[str, int | None]) -> Scaling:
        """One aggregate; sums are exact where the column's decimals are known."""
        parts = []
        for name, places in digits.items():
            parts += [F.count(name).alias(f"{name}__n"), exact_sum(name, places).alias(f"{name}__s")]
            if places is None:
                parts.append(F.stddev_pop(name).alias(f"{name}__q"))
            else:
                unit = fixed_point(name, places).cast("decimal(19,0)")
                parts.append(F.sum(unit * unit).alias(f"{name}__q"))
        if not parts:
            return Scaling({})
        row = df.agg(*parts).first()
        return Scaling({name: _mean_and_deviation(
            row[f"{name}__n"], row[f"{name}__s"], row[f"{name}__q"], places)
            for name, places in digits.items()})

    def column(self, name: str) -> Column:
        mean, deviation = self.stats[name]
        return (F.col(name).cast("double") - mean) / (deviation or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.stats})


def _mean_and_deviation(n, total, squares, places) -> tuple[float, float]:
    if not n:
        raise ValueError("cannot scale a column without values")
    if places is None:
        return total / n, squares
    n, total, squares = int(n), int(total), int(squares)
    unit = float(10**places)
    return total / n / unit, math.sqrt(n * squares - total * total) / n / unit


@dataclass(frozen=True)
class OneHot:
    """Levels per category; the first in order has no column, unknown and NULL ones are all zero.

    `levels` (name, level, place) is a stored table of any length; only how many levels
    each category has (`sizes`) is held by the driver.
    """

    levels: DataFrame
    sizes: Mapping[str, int]

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> OneHot:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level"))
                          for c in columns])
        found = df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct()
        return OneHot._of(number_in_order(found, ["name", "level"], "place"), columns)

    @staticmethod
    def _of(numbered: DataFrame, columns: Sequence[str] | None = None) -> OneHot:
        """From levels (name, level, place) whose places grow by one within a category."""
        numbered = write_and_read(numbered.select("name", "level", F.col("place").cast("bigint")), "levels")
        first = numbered.groupBy("name").agg(F.min("place").alias("__first"), F.count("level").alias("n"))
        spans = {r["name"]: r for r in first.collect()}
        order = columns or sorted(spans, key=lambda name: spans[name]["__first"])
        # One row per category.
        levels = numbered.join(F.broadcast(first.drop("n")), "name").select(
            "name", "level", (F.col("place") - F.col("__first")).alias("place"))
        return OneHot(levels, {c: spans[c]["n"] if c in spans else 0 for c in order})

    def encoded(self) -> list[str]:
        """The categories that have columns."""
        return [name for name, size in self.sizes.items() if size > 1]

    def width(self) -> int:
        return sum(self.sizes[name] - 1 for name in self.encoded())

    def names(self) -> DataFrame:
        """(place, feature) of every column, in the order of the vector."""
        return self._shifted({name: self.sizes[name] - 1 for name in self.encoded()}).where("place > 0").select(
            (F.col("__before") + F.col("place") - 1).alias("place"),
            F.concat_ws("_", "name", "level").alias("feature"))

    def _shifted(self, widths: Mapping[str, int]) -> DataFrame:
        """Levels with `__before`, the sum of the widths of the categories before theirs."""
        before, branch = 0, F.lit(None).cast("bigint")
        for name, width in widths.items():
            branch = F.when(F.col("name") == name, F.lit(before).cast("bigint")).otherwise(branch)
            before += width
        return self.levels.withColumn("__before", branch).where(F.col("__before").isNotNull())

    def with_indexes(self, df: DataFrame, prefix: str) -> DataFrame:
        """Adds one double per encoded category: the place of its column, -1 for none.

        Levels of a category with few of them are looked up in the row; those of others
        are joined, by broadcast where their table is proven small.
        """
        names = self.encoded()
        few = [n for n in names if self.sizes[n] <= INLINE_LEVELS]
        held = {n: [] for n in few}
        if few:
            for row in self.levels.where(F.col("name").isin(few)).orderBy("name", "place").collect():
                held[row["name"]].append(row["level"])
        for i, name in enumerate(names):
            index = f"{prefix}{i}"
            if name in held:
                place = F.array_position(F.array(*map(F.lit, held[name])), F.col(name).cast("string")) - 1
                df = df.withColumn(index, F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(-1)).cast("double"))
                continue
            side = self.levels.where(F.col("name") == name).select(
                F.col("level").alias("__level"), (F.col("place") - 1).cast("double").alias(index))
            df = df.join(broadcast_if_small(side), F.col(name).cast("string") == F.col("__level"), "left")
            df = df.drop("__level").fillna(-1.0, [index])
        return df

    def vectors(self, df: DataFrame, prefix: str, out: str) -> DataFrame:
        """One sparse vector per encoded category, from the indexes of `with_indexes`."""
        names = self.encoded()
        if not names:
            return df
        inputs = [f"{prefix}{i}" for i in range(len(names))]
        # Sizes are fitted on one row that holds the last index of each category.
        last = df.sparkSession.createDataFrame(
            [tuple(float(self.sizes[n] - 2) for n in names)], ", ".join(f"{c} double" for c in inputs))
        # An index outside (-1) gives an empty vector: "keep" adds a place, which dropLast takes away.
        encoder = OneHotEncoder(inputCols=inputs, outputCols=[f"{out}{i}" for i in range(len(names))],
                                handleInvalid="keep", dropLast=True).fit(last)
        return encoder.transform(df)


@dataclass(frozen=True)
class Preprocessor:
    """Scaled numerics followed by encoded categories, as one vector."""

    scaling: Scaling
    encoding: OneHot

    @staticmethod
    def fit(train: DataFrame, numeric: Mapping[str, int | None], categorical: Sequence[str]) -> Preprocessor:
        return Preprocessor(Scaling.fit(train, numeric), OneHot.fit(train, categorical))

    def width(self) -> int:
        return len(self.scaling.stats) + self.encoding.width()

    def names(self) -> DataFrame:
        """(place, feature), one row per place of the vector, from 0."""
        numeric = list(enumerate(self.scaling.stats))
        first = self.encoding.levels.sparkSession.createDataFrame(numeric, "place bigint, feature string")
        return first.unionByName(self.encoding.names().withColumn("place", F.col("place") + len(numeric)))

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep` columns and a `features` vector, sparse where that is shorter."""
        rows = self.encoding.with_indexes(df, "__i")
        numeric = {f"__n{i}": self.scaling.column(name) for i, name in enumerate(self.scaling.stats)}
        indexes = [f"__i{i}" for i in range(len(self.encoding.encoded()))]
        rows = rows.select(*keep, *[c.alias(n) for n, c in numeric.items()], *indexes)
        rows = self.encoding.vectors(rows, "__i", "__v")
        inputs = [*numeric, *[f"__v{i}" for i in range(len(indexes))]]
        rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
        return rows.select(*keep, "features")

    def as_rows(self, spark) -> DataFrame:
        """The fitted values as a table, to be stored."""
        rows = [(place, n, None, m, d) for place, (n, (m, d)) in enumerate(self.scaling.stats.items())]
        numeric = spark.createDataFrame(
            rows, "place bigint, name string, level string, mean double, deviation double")
        levels = self.encoding._shifted(self.encoding.sizes).select(
            (F.col("__before") + F.col("place") + len(rows)).alias("place"), "name", "level",
            F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("deviation"))
        return numeric.unionByName(levels)

    @staticmethod
    def from_rows(stored: DataFrame) -> Preprocessor:
        """Read back; the driver sees the numerics and one row per category.

        The order of features is that of the models' coefficients, so it is stored too.
        """
        numeric = stored.where(F.col("level").isNull()).orderBy("place").collect()
        return Preprocessor(Scaling({r["name"]: (r["mean"], r["deviation"]) for r in numeric}),
                            OneHot._of(stored.where(F.col("level").isNotNull())))
