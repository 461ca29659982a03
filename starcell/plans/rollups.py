"""Stored partial aggregates of a fact, and the choice of the smallest table that can answer.

A rollup holds the parts of measures per combination of some foreign keys, attributes and a
unit of time. It is read in place of the fact: the keys are the same, so dimensions are
joined as before, and `timestamp` is the start of the unit. Parts merge, so a load only adds
rows for what it brought, and several rows of one combination do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcell.plans.measures import ROW_COUNT, Measure

# Units of time that a rollup may be cut to, from fine to coarse; weeks and months are made of days.
GRAINS = ("minute", "hour", "day")


def coarse_enough(held: str | None, needed: str | None) -> bool:
    """Whether times cut to `held` still decide what `needed` decides."""
    return held is not None and needed is not None and GRAINS.index(held) <= GRAINS.index(needed)


@dataclass(frozen=True)
class Shape:
    """What a rollup is grouped by: fact keys, attributes by name, and a unit of time.

    `sketched` are columns of the fact whose different values are kept as sketches.
    """

    keys: Sequence[str]
    names: Sequence[str] = ()
    grain: str | None = None
    sketched: Sequence[str] = ()

    def build(self, star, block: Sequence[Measure]) -> DataFrame:
        """The parts of the block per combination, under their stored names."""
        by = [F.col(c) for c in (*self.keys, *self.names)]
        if self.grain:
            start = F.date_trunc(self.grain, star.attributes["timestamp"].column)
            by.append(start.cast("timestamp_ntz").alias("timestamp"))
        if star.day_column:
            by.append(F.col(star.day_column))
        parts = {p.stored: p.first for m in block for p in m.parts}
        return star.rows(self.names).groupBy(*by).agg(*[c.alias(n) for n, c in parts.items()])


# Fixed shapes of the two marts: few rows for questions without cells, daily rows with them.
CUSTOMER_SHAPES = {
    "rollup_customer_profile": Shape(
        ("plan_key",), ("tenure_band", "gender", "senior_citizen", "partner", "dependents", "churn_flag")),
}
NETWORK_SHAPES = {
    "rollup_network_hour": Shape(("region_key", "technology_key"), (), "hour",
                                 ("cell_key", "region_key", "technology_key")),
    "rollup_network_day": Shape(("cell_key", "region_key", "technology_key"), (), "day"),
}


@dataclass(frozen=True)
class Rollup:
    name: str
    frame: DataFrame
    keys: Sequence[str]
    names: Sequence[str] = ()
    grain: str | None = None


@dataclass
class Rollups:
    """The rollups of one fact. They are counted once, when one of them could answer for the first time.

    A rollup that does not stand for as many rows as the fact has (a load that broke off, or
    one that was told to keep none) is left out. Loads that replace a fact empty its rollups
    first, so equal counts never belong to different rows.
    """

    fact: DataFrame
    tables: Sequence[Rollup]
    _sizes: Mapping[str, int] | None = field(default=None, repr=False)

    def sizes(self) -> Mapping[str, int]:
        if self._sizes is None:
            rows = self.fact.count()
            found = {}
            for table in self.tables:
                line = table.frame.agg(F.count(F.lit(1)).alias("size"), F.sum(ROW_COUNT).alias("rows")).first()
                if (line["rows"] or 0) == rows:
                    found[table.name] = line["size"]
            self._sizes = found
        return self._sizes

    def smallest(self, names: Iterable[str]) -> str | None:
        names = list(names)
        if not names:
            return None
        sizes = self.sizes()
        return min((n for n in names if n in sizes), key=lambda n: (sizes[n], n), default=None)
