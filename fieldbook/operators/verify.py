"""Verification: every check is a DataFrame of its violations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


@dataclass
class Check:
    """Rows for which the predicate holds violate the check; the subject columns name them."""

    name: str
    rows: DataFrame
    violated: Column
    subject: Sequence[str]

    def frame(self) -> DataFrame:
        subject = F.concat_ws(":", *[F.col(c).cast("string") for c in self.subject])
        return self.rows.filter(self.violated).select(F.lit(self.name).alias("check_name"), subject.alias("subject"))


def violations(checks: Iterable[Check]) -> DataFrame:
    """(check_name, subject) of everything that is wrong; empty if all checks pass."""
    return reduce(DataFrame.unionAll, [c.frame() for c in checks])


def require_clean(checks: Iterable[Check], shown: int = 20) -> None:
    found = violations(checks).limit(shown).collect()
    if found:
        raise ValueError("; ".join(f"{name}: {subject}" for name, subject in found))


def retention_plan(inventory: DataFrame, references: DataFrame, key: str, in_grace: Column) -> DataFrame:
    """The inventory with its action: referenced, grace or delete."""
    used = references.select(F.col(key), F.lit(True).alias("_used")).distinct()
    action = F.when(F.col("_used"), "referenced").when(in_grace, "grace").otherwise("delete")
    return inventory.join(used, key, "left").withColumn("action", action).drop("_used")


def schema_paths(schema: DataType, trail: str = "$") -> list[tuple[str, str, DataType]]:
    """(path, name, type) of every field of a nested schema; maps are open, their keys are data."""
    if isinstance(schema, ArrayType):
        return schema_paths(schema.elementType, trail + "[]")
    if isinstance(schema, MapType):
        return schema_paths(schema.valueType, trail + "{}")
    if not isinstance(schema, StructType):
        return []
    return [x for f in schema for x in [(f"{trail}.{f.name}", f.name, f.dataType), *schema_paths(f.dataType, f"{trail}.{f.name}")]]


def unpublishable(documents: DataFrame, allowed: set[str], forbidden_keys: Sequence[str], forbidden_values: Sequence[str], subject: str) -> DataFrame:
    """(subject, path, problem) of what a public document must not hold.

    Keys are checked on the schema, once. Values are matched where they are: every string at
    any depth, in maps too, in the rows that have it.
    """
    fields = schema_paths(documents.schema)
    bad = [(path, "private key") for path, name, _ in fields if any(x in name for x in forbidden_keys)]
    bad += [(path, "not in the contract") for path, name, _ in fields if name not in allowed and (path, "private key") not in bad]
    spark = documents.sparkSession
    found = spark.createDataFrame([("*", *b) for b in bad], "subject string, path string, problem string")
    pattern = "|".join(f"(?:{p})" for p in forbidden_values)
    for field in documents.schema if pattern else ():
        for path, texts in _strings(field.dataType, F.col(f"`{field.name}`"), f"$.{field.name}"):
            hit = documents.filter(F.exists(texts, lambda x: x.rlike(pattern)))
            found = found.unionAll(hit.select(F.col(subject).cast("string").alias("subject"), F.lit(path).alias("path"), F.lit("private value").alias("problem")))
    return found


def _strings(kind: DataType, value: Column, trail: str) -> list[tuple[str, Column]]:
    """(path, array of its strings) of every string at any depth: in structs, arrays, and maps,
    whose keys are text like any other."""
    if isinstance(kind, StringType):
        return [(trail, F.array(value))]
    if isinstance(kind, StructType):
        return [x for f in kind for x in _strings(f.dataType, value[f.name], f"{trail}.{f.name}")]
    if isinstance(kind, MapType):
        keys = [(trail + "{key}", F.map_keys(value))] if isinstance(kind.keyType, StringType) else []
        return [*keys, *_strings(ArrayType(kind.valueType), F.map_values(value), trail + "{}")]
    if isinstance(kind, ArrayType):
        element, trail = kind.elementType, trail if trail.endswith("{}") else trail + "[]"
        if isinstance(element, StringType):
            return [(trail, value)]
        inner = [p for p, _ in _strings(element, F.lit(None).cast(element), trail)]
        return [(path, F.flatten(F.transform(value, _part(element, trail, k)))) for k, path in enumerate(inner)]
    return []


def _part(element: DataType, trail: str, k: int):
    return lambda x: _strings(element, x, trail)[k][1]
