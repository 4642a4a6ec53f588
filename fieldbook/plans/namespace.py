"""The analysis namespace: documented views, their catalog, and bounded ad-hoc SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Relation:
    name: str
    grain: str
    meaning: str
    rows: DataFrame
    time: str = ""
    private: bool = False
    caveats: str = ""


class Namespace:
    """Lazily evaluated relations under a prefix; SQL sees them as temporary views."""

    def __init__(self, spark: SparkSession, relations: list[Relation], prefix: str = "analysis_"):
        self.spark, self.prefix = spark, prefix
        self.relations = {r.name: r for r in relations}
        if len(self.relations) < len(relations):
            raise ValueError("a relation is named twice")
        for r in relations:
            r.rows.createOrReplaceTempView(prefix + r.name)
        self.catalog().createOrReplaceTempView(f"{prefix}catalog")
        self.column_catalog().createOrReplaceTempView(f"{prefix}column_catalog")

    def catalog(self) -> DataFrame:
        """One row per relation: grain, meaning, which clock its times follow, caveats."""
        rows = [(r.name, r.grain, r.meaning, r.time, r.private, r.caveats) for r in self.relations.values()]
        return self.spark.createDataFrame(rows, "object_name string, grain string, meaning string, temporal_semantics string, private boolean, caveats string")

    def column_catalog(self) -> DataFrame:
        """One row per column, from the schemas: nothing is scanned."""
        rows = [(r.name, f.name, k, f.dataType.simpleString()) for r in self.relations.values() for k, f in enumerate(r.rows.schema, 1)]
        return self.spark.createDataFrame(rows, "object_name string, column_name string, ordinal int, data_type string")

    def search(self, text: str) -> DataFrame:
        """Relations whose name or description holds every word."""
        rows = self.catalog()
        for word in text.lower().split():
            rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "object_name", "grain", "meaning", "caveats")), F.lit(word)))
        return rows

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(text, args=args)

    def bounded(self, queries: dict[str, str], max_rows: int = 200, max_chars: int = 200) -> dict[str, dict]:
        """Each query's first rows, with cells cut to a length, and whether there are more."""
        out = {}
        for name, text in queries.items():
            frame = self.sql(text)
            found = frame.limit(max_rows + 1).collect()
            cells = [[_shown(v, max_chars) for v in row] for row in found[:max_rows]]
            out[name] = {"columns": frame.columns, "rows": cells, "truncated": len(found) > max_rows}
        return out


def _shown(value, most: int):
    if isinstance(value, float):
        return float(f"{value:.6g}")
    if isinstance(value, str) and len(value) > most:
        return value[: most - 1] + "…"
    return value
