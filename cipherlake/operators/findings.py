"""The finding row: its columns, derived columns, filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlake.functions.text import strip
from cipherlake.rules.tables import LANGUAGE_ORDER, SEVERITIES

FINDING_COLUMNS = (
    "file_path", "line_number", "column_start", "column_end", "language", "algorithm_detected", "code_snippet",
    "is_quantum_vulnerable", "vulnerability_class", "severity",
)
RECOMMENDATION = "struct<primary_algorithm:string,hybrid_transition_recommended:boolean,migration_notes:string,nist_reference:string>"
#: Columns that enrichment and review fill in later.
LATER_COLUMNS = {
    "usage_context": "string", "pqc_recommendation": RECOMMENDATION, "pqc_replacement": "string",
    "migration_complexity": "string", "human_reviewed": "boolean", "false_positive": "boolean",
}


def complete(findings: DataFrame) -> DataFrame:
    """Adds the later columns that are missing: null, or false for the two flags."""
    have = set(findings.columns)
    new = {c: (F.lit(False) if t == "boolean" else F.lit(None).cast(t)) for c, t in LATER_COLUMNS.items() if c not in have}
    return findings.withColumns(new) if new else findings


def valid(findings: DataFrame) -> DataFrame:
    """Rows that the data model admits: a snippet that isn't blank, and a line from 1."""
    return findings.where((strip(F.col("code_snippet")) != "") & (F.col("line_number") >= 1))


def fingerprint() -> Column:
    return F.sha2(F.concat_ws(":", "file_path", F.col("line_number").cast("string"), "algorithm_detected"), 256)


def is_enriched() -> Column:
    return F.col("usage_context").isNotNull() & F.col("pqc_recommendation").isNotNull()


def synced_replacement() -> Column:
    """The replacement, or where it is empty the recommendation's algorithm."""
    return F.coalesce(F.nullif("pqc_replacement", F.lit("")), F.col("pqc_recommendation.primary_algorithm"))


def severity_rank(column: str = "severity") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column)).cast("int")


def parser_rank() -> Column:
    """Languages in scanning order; manifests (unknown) last."""
    at = F.array_position(F.array(*[F.lit(x) for x in LANGUAGE_ORDER]), F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language")))
    return F.when(at == 0, len(LANGUAGE_ORDER) + 1).otherwise(at).cast("int")


def by_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)


def by_file(findings: DataFrame, file_path: str) -> DataFrame:
    return findings.where(F.col("file_path") == file_path)


def unenriched(findings: DataFrame) -> DataFrame:
    return findings.where(~is_enriched())


def place_order() -> list[Column]:
    """The order of one parser's findings: file, line, column."""
    return [F.col("file_path"), F.col("line_number"), F.col("column_start").asc_nulls_first(), F.col("algorithm_detected")]


def report_order(findings: DataFrame, documented: bool = False) -> DataFrame:
    """Scanning order (the default), or by severity and file as documented."""
    return findings.orderBy(severity_rank() if documented else parser_rank(), *place_order())


def dedupe(findings: DataFrame) -> DataFrame:
    """One row per fingerprint: the first by snippet. An extension."""
    return first_by_snippet(findings.withColumn("fingerprint", fingerprint()))


def first_by_snippet(with_print: DataFrame) -> DataFrame:
    rest = [c for c in with_print.columns if c != "fingerprint"]
    best = with_print.groupBy("fingerprint").agg(F.min(F.struct("code_snippet", *[c for c in rest if c != "code_snippet"])).alias("row"))
    return best.select("fingerprint", *[F.col(f"row.{c}") for c in rest])


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of one scan that the other doesn't have, by fingerprint, with `change` added or removed. An extension."""
    a, b = (x.withColumn("fingerprint", fingerprint()) for x in (before, after))
    added = b.join(a.select("fingerprint"), "fingerprint", "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b.select("fingerprint"), "fingerprint", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def store_scan(findings: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Keeps a scan as a table (in the warehouse, or at `path`), bucketed and sorted by fingerprint, one row each, for
    `diff_with_stored`.

    Findings are shuffled once: they are dealt to buckets first, and one per fingerprint is chosen within its bucket. Choose
    `buckets` so that one holds some 100 MB, and the same for all scans of a series.
    """
    dealt = findings.withColumn("fingerprint", fingerprint()).repartition(buckets, "fingerprint")
    out = first_by_snippet(dealt).write.bucketBy(buckets, "fingerprint").sortBy("fingerprint").mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(table)


def diff_with_stored(spark: SparkSession, before: str, after: str) -> DataFrame:
    """`diff` of two stored scans, one row for each fingerprint: with equal buckets neither side is shuffled."""
    a, b = spark.table(before), spark.table(after)
    added = b.join(a.select("fingerprint"), "fingerprint", "left_anti").withColumn("change", F.lit("added"))
    removed = a.join(b.select("fingerprint"), "fingerprint", "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)
