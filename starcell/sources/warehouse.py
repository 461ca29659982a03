"""The warehouse folder: one Parquet table per dimension and fact."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from starcell.plans.marts import customer_star, network_star
from starcell.plans.rollups import CUSTOMER_SHAPES, NETWORK_SHAPES, Rollup, Rollups, Shape
from starcell.plans.star import Star

CUSTOMER_TABLES = ("dim_customer", "dim_plan", "fact_customer_churn")
NETWORK_TABLES = ("dim_cell", "dim_region", "dim_network_tech", "dim_time", "fact_network_kpi")


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        try:
            self.read(name)
        except AnalysisException:
            return False
        return True

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str, reset: bool = True, partition_by: str | None = None,
              ) -> DataFrame:
        """Replace the table, or add to it; returns it as stored."""
        writer = df.write.mode("overwrite" if reset else "append")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        # A partitioned table of no rows has no file that tells its columns.
        return self.read(name) if self.exists(name) else self.spark.read.schema(df.schema).parquet(self.path(name))

    def _with_rollups(self, star: Star, shapes: Mapping[str, Shape]) -> Star:
        tables = [Rollup(name, self.read(name), shape.keys, shape.names, shape.grain)
                  for name, shape in shapes.items() if self.exists(name)]
        return replace(star, rollups=Rollups(star.fact, tables)) if tables else star

    def customer_star(self, rollups: bool = True) -> Star:
        """The customer mart; `rollups` lets stored partial aggregates answer where they can."""
        star = customer_star(self.read("fact_customer_churn"), self.read("dim_customer"),
                             self.read("dim_plan"))
        return self._with_rollups(star, CUSTOMER_SHAPES) if rollups else star

    def network_star(self, rollups: bool = True) -> Star:
        star = network_star(self.read("fact_network_kpi"), self.read("dim_cell"),
                            self.read("dim_region"), self.read("dim_network_tech"),
                            self.read("dim_time"))
        return self._with_rollups(star, NETWORK_SHAPES) if rollups else star
