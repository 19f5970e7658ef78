"""Rule tables as relations and as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.rules.tables import Rule

RULE_COLUMNS = ("ord", "key", "algorithm", "vulnerability_class", "severity", "is_vulnerable")


def sql_literal(value: object) -> str:
    """A literal that Spark and DuckDB read alike; backslashes need a raw string in Spark (see `values_relation`)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_relation(spark: SparkSession, rows: Iterable[Sequence[object]], columns: Sequence[str]) -> DataFrame:
    """A constant table of a fixed, small number of rows, planned as a local relation."""

    def spark_literal(value: object) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"
        return sql_literal(value)

    body = ", ".join("(" + ", ".join(map(spark_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def first_match(rules: Sequence[Rule], test: Callable[[Rule], Column], field: str = "ord") -> Column:
    """A field of the first rule whose test holds, else null: one CASE, left at the first hit, in generated code."""
    chain = None
    for rule in rules:
        value = F.lit(getattr(rule, field))
        chain = F.when(test(rule), value) if chain is None else chain.when(test(rule), value)
    return chain


def pick(rules: Sequence[Rule], ord_: Column, field: str) -> Column:
    """A rule's field by its ord (null stays null); the fields are a constant array."""
    return F.element_at(F.array(*[F.lit(getattr(r, field)) for r in rules]), ord_)


def with_rule(df: DataFrame, rules: Sequence[Rule], ord_: Column) -> DataFrame:
    """Keeps rows that some rule matches and adds the finding columns of that rule."""
    hit = df.withColumn("rule_ord", ord_).where("rule_ord IS NOT NULL")
    o = F.col("rule_ord")
    return hit.withColumns(
        {
            "algorithm_detected": pick(rules, o, "algorithm"),
            "vulnerability_class": pick(rules, o, "vulnerability_class"),
            "severity": pick(rules, o, "severity"),
            "is_quantum_vulnerable": pick(rules, o, "is_vulnerable"),
        }
    )
