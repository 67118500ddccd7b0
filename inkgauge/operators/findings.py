"""The finding row and the registry of check families.

A family reads columns of one shredded row and yields an array of findings, so a whole audit is a
narrow job: no family shuffles, and a long table is only an explode away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

PATCH = "struct<type:string,target:string,before:string,after:string,rationale:string>"
FINDING = (
    "struct<check_id:string,layer:string,severity:string,evidence:string,truth_badge:string,"
    f"missing:array<string>,patch:{PATCH}>"
)


def finding(
    check_id: Column | str,
    layer: str,
    severity: Column | str,
    badge: str,
    evidence: Column | str,
    when: Column | None = None,
    missing: Column | None = None,
    patch: Column | None = None,
) -> Column:
    """One finding, or NULL when its condition does not hold."""

    def col(value):
        return F.lit(value) if isinstance(value, str) else value

    row = F.struct(
        col(check_id).alias("check_id"),
        F.lit(layer).alias("layer"),
        col(severity).alias("severity"),
        col(evidence).alias("evidence"),
        F.lit(badge).alias("truth_badge"),
        (F.lit(None) if missing is None else missing).cast("array<string>").alias("missing"),
        (F.lit(None) if patch is None else patch).cast(PATCH).alias("patch"),
    ).cast(FINDING)
    return row if when is None else F.when(when, row)


def collect(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


@dataclass(frozen=True)
class Family:
    """``measures`` adds the numbers the checks compare; ``findings`` turns them into rows."""

    name: str
    measures: Callable[[DataFrame], DataFrame]
    findings: Callable[[], Column]


_BUILT: dict[tuple, tuple] = {}


def all_found(families: list[Family]) -> Column:
    """The findings of several families in one array.

    Building the expression takes thousands of calls into the JVM and depends on nothing but the families, so it is built
    once per session and used again by every audit, round and micro-batch.
    """
    jvm = SparkContext._active_spark_context._jvm
    key = (id(jvm), *map(id, families))
    if key not in _BUILT:
        # The families and the JVM are kept beside it, so that their numbers stay theirs.
        _BUILT[key] = (F.concat(*[family.findings() for family in families]), jvm, list(families))
    return _BUILT[key][0]


def run_family(shredded: DataFrame, family: Family, key: str = "doc_id") -> DataFrame:
    """Findings of one family as a long table, numbered in the order they are raised."""
    return explode_findings(family.measures(shredded).withColumn("found", family.findings()), key)


def rows_of(df: DataFrame, keys: list[str], array: Column | str, position: str, value: str) -> DataFrame:
    """One row per array entry, numbered from 0.

    The outer form plus a filter on its own output: the plain form makes the optimizer add a "not empty"
    filter below the explode, which would compute the whole array expression a second time.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(position, value)).filter(F.col(position).isNotNull())


def explode_findings(df: DataFrame, key: str = "doc_id", column: str = "found") -> DataFrame:
    return rows_of(df, [key], column, "ord", "f").select(key, "ord", "f.*")
