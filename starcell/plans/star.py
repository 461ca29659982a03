"""Star schemas: a fact, its dimensions and the names callers use for attributes.

`Star.aggregate` is the one plan behind every cube operator:

* predicates on the fact reach its scan, and only named dimensions are joined;
* a dimension that a count proves small, whole or after its filter, is broadcast
  before aggregation, so the fact is not shuffled and a hot key is combined inside
  each map task;
* any other dimension is joined after the fact has been aggregated per foreign key.
  That aggregation is hash-partitioned by the key the join needs and holds one row
  per key, so a key with a third of the fact meets the join as one row;
* where stored partial aggregates can answer, the smallest such table stands in for the
  fact (`plans.rollups`), and the rest of the plan is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcell.functions import arguments
from starcell.plans.measures import Measure, finish, first_pass, second_pass, stored_pass
from starcell.plans.rollups import Rollups, coarse_enough
from starcell.plans.sizing import BROADCAST_ROWS, fits_broadcast


@dataclass(frozen=True)
class Attribute:
    """A name callers may group or filter by.

    `home` names the dimension that holds it (None: the fact itself). `equals`
    turns a value into a predicate; the default compares the column. `grain` is the
    unit of time that decides it, for attributes made from the time of the fact.
    """

    column: Column
    home: str | None = None
    parse: Callable = arguments.text
    domain: tuple | None = None
    equals: Callable[[object], Column] | None = None
    grain: str | None = None

    def checked(self, name: str, value):
        parsed = self.parse(value)
        if self.domain is not None and parsed not in self.domain:
            raise ValueError(f"invalid {name} {value!r}; expected one of {sorted(self.domain)}")
        return parsed

    def predicate(self, parsed) -> Column:
        return self.equals(parsed) if self.equals else self.column == parsed


@dataclass
class Dimension:
    """A lookup table reached by `fact[fact_key] = frame[key]`, key unique."""

    frame: DataFrame
    fact_key: str
    key: str
    max_rows: int = BROADCAST_ROWS
    _fits: bool | None = field(default=None, repr=False)

    def fits(self, whole: DataFrame) -> bool:
        """Whether the key with all attributes may be broadcast; checked once per star."""
        if self._fits is None:
            self._fits = fits_broadcast(whole, self.max_rows)
        return self._fits


@dataclass(frozen=True)
class Condition:
    """A predicate and the table it applies to (None: the fact).

    One that compares an attribute keeps its name and value; one decided by a unit of time keeps that.
    """

    test: Column
    home: str | None = None
    name: str | None = None
    value: object = None
    grain: str | None = None


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    dimensions: Mapping[str, Dimension]
    attributes: Mapping[str, Attribute]
    # The fact's partition column holding the day of an observation, if it has one.
    day_column: str | None = None
    # Stored partial aggregates of this fact.
    rollups: Rollups | None = None

    def with_broadcast_rows(self, max_rows: int) -> Star:
        dims = {n: Dimension(d.frame, d.fact_key, d.key, max_rows) for n, d in self.dimensions.items()}
        return replace(self, dimensions=dims)

    def with_attribute(self, name: str, attribute: Attribute) -> Star:
        return replace(self, attributes={**self.attributes, name: attribute})

    def names(self) -> list[str]:
        """Attributes open to slicing and grouping; the raw timestamp is not one."""
        return [n for n in self.attributes if n != "timestamp"]

    def conditions(self, name: str, value) -> list[Condition]:
        """The attribute equals the value; a calendar day also prunes the fact's files."""
        attribute = self.attributes[name]
        parsed = attribute.checked(name, value)
        found = [Condition(attribute.predicate(parsed), attribute.home, name, parsed, attribute.grain)]
        if name == "date" and self.day_column:
            day = F.lit(str(value).strip()).cast("date")
            found.append(Condition(F.col(self.day_column) == day, grain="day"))
        return found

    def time_conditions(self, start: str | None = None, end: str | None = None) -> list[Condition]:
        """Observations from `start` to `end`, both inclusive and optional."""
        ts = self.attributes["timestamp"]
        found = []
        for bound, compare in ((start, Column.__ge__), (end, Column.__le__)):
            if bound is None or not arguments.text(bound):
                continue
            edge = F.lit(arguments.text(bound)).cast("timestamp_ntz")
            found.append(Condition(compare(ts.column, edge), ts.home))
            if self.day_column:
                found.append(Condition(compare(F.col(self.day_column), edge.cast("date"))))
        return found

    def _side(self, home: str, names: Sequence[str], where: Sequence[Condition]) -> DataFrame:
        """The key and the wanted attributes of one dimension, filtered."""
        dim = self.dimensions[home]
        side = dim.frame
        for condition in where:
            if condition.home == home:
                side = side.where(condition.test)
        return side.select(dim.frame[dim.key].alias(f"__{home}"),
                           *[self.attributes[n].column.alias(n) for n in names
                             if self.attributes[n].home == home])

    def _sides(self, names: Sequence[str], where: Sequence[Condition],
               ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """The dimensions in use: those counted small, to broadcast, and the others."""
        small, large = {}, {}
        homes = [self.attributes[n].home for n in names] + [c.home for c in where]
        for home in dict.fromkeys(h for h in homes if h is not None):
            dim = self.dimensions[home]
            side = self._side(home, names, where)
            filtered = any(c.home == home for c in where)
            if dim.fits(self._side(home, list(self.attributes), ())) or (
                    filtered and fits_broadcast(side, dim.max_rows)):
                small[home] = F.broadcast(side)
            else:
                large[home] = side
        return small, large

    def _attach(self, rows: DataFrame, sides: Mapping[str, DataFrame]) -> DataFrame:
        for home, side in sides.items():
            match = rows[self.dimensions[home].fact_key] == side[f"__{home}"]
            rows = rows.join(side, match).drop(f"__{home}")
        return rows

    def _facts(self, names: Sequence[str], where: Sequence[Condition]) -> DataFrame:
        """Filtered fact rows with the fact's own attributes."""
        fact = self.fact
        for condition in where:
            if condition.home is None:
                fact = fact.where(condition.test)
        own = {n: self.attributes[n].column.alias(n) for n in names
               if self.attributes[n].home is None}
        return fact.select(*[c for c in fact.columns if c not in own], *own.values())

    def rows(self, names: Sequence[str] = (), where: Sequence[Condition] = ()) -> DataFrame:
        """Fact rows that pass `where`, widened by the named attributes."""
        small, large = self._sides(names, where)
        return self._attach(self._facts(names, where), {**small, **large})

    def _over(self, rollup, by: Sequence[str], where: Sequence[Condition],
              ) -> tuple[Star, list[Condition]] | None:
        """This star with the rollup for its fact, and the conditions on it; None where it cannot answer."""
        def reaches(home: str | None, grain: str | None) -> bool:
            if home is not None:
                return self.dimensions[home].fact_key in rollup.keys
            return coarse_enough(rollup.grain, grain)

        own = {n: Attribute(F.col(n)) for n in rollup.names}
        if not all(n in own or reaches(self.attributes[n].home, self.attributes[n].grain) for n in by):
            return None
        moved = []
        for condition in where:
            if condition.name in own:
                moved.append(Condition(F.col(condition.name) == condition.value))
            elif reaches(condition.home, condition.grain):
                moved.append(condition)
            else:
                return None
        return replace(self, fact=rollup.frame, attributes={**self.attributes, **own}, rollups=None), moved

    def answering(self, block: Sequence[Measure], by: Sequence[str] = (), where: Sequence[Condition] = (),
                  keys: Sequence[str] = ()) -> tuple[Star, Sequence[Condition], Callable]:
        """The star to ask, its conditions and its first pass: the smallest rollup that holds it all, or the fact.

        `keys` are columns of the fact that are grouped by.
        """
        # A star whose fact was replaced keeps no claim on the rollups of the old one.
        if self.rollups is None or self.rollups.fact is not self.fact:
            return self, where, first_pass
        stored = {p.stored for m in block for p in m.parts}
        fitting = {}
        for rollup in self.rollups.tables:
            if stored <= set(rollup.frame.columns) and set(keys) <= set(rollup.keys):
                found = self._over(rollup, by, where)
                if found is not None:
                    fitting[rollup.name] = found
        name = self.rollups.smallest(fitting)
        return (self, where, first_pass) if name is None else (*fitting[name], stored_pass)

    def aggregate(self, block: Sequence[Measure], by: Sequence[str] = (),
                  where: Sequence[Condition] = ()) -> DataFrame:
        """One row of measures per combination of the attributes in `by`."""
        star, where, first = self.answering(block, by, where)
        small, large = star._sides(by, where)
        rows = star._attach(star._facts(by, where), small)
        if not large:
            return finish(first(rows, by, block), by, block)
        early = [n for n in by if star.attributes[n].home not in large]
        keys = dict.fromkeys(star.dimensions[h].fact_key for h in large)
        parts = star._attach(first(rows, [*keys, *early], block), large)
        return finish(second_pass(parts, by, block), by, block)
