"""Report aggregates: the cryptographic bill of materials."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cipherlake.operators.findings import complete, is_enriched
from cipherlake.rules.tables import LANGUAGE_ORDER, SEVERITIES


def progress(enriched: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * enriched / total, 2))


def summary_columns() -> list[Column]:
    """total_findings, quantum_vulnerable_count, critical_findings_count, ai_enriched_count, enrichment_progress_pct,
    algorithms_detected; false positives count everywhere but in the second."""
    total, enriched = F.count(F.lit(1)), F.count_if(is_enriched())
    return [
        total.alias("total_findings"),
        F.count_if(F.col("is_quantum_vulnerable") & ~F.col("false_positive")).alias("quantum_vulnerable_count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_findings_count"),
        enriched.alias("ai_enriched_count"),
        progress(enriched, total).alias("enrichment_progress_pct"),
        F.sort_array(F.collect_set("algorithm_detected")).alias("algorithms_detected"),
    ]


def breakdown_map() -> Column:
    """Counts of all five severities, zeros included."""
    return F.map_from_arrays(F.array(*[F.lit(s) for s in SEVERITIES]), F.array(*[F.count_if(F.col("severity") == s) for s in SEVERITIES]))


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """One row of aggregates, or one per key; partial sums are combined map-side, and the sets are of algorithm names."""
    return complete(findings).groupBy(*keys).agg(*summary_columns(), breakdown_map().alias("severity_breakdown"))


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """(severity, n) for all five levels."""
    one = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return one.select(F.explode(F.create_map(*[x for s in SEVERITIES for x in (F.lit(s), F.col(s))])).alias("severity", "n"))


def languages_scanned() -> Column:
    """Languages with findings in scanning order, TypeScript as JavaScript, then registered ones by name; manifests alone
    give [unknown]."""
    seen = F.collect_set(F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language")))
    order = F.array(*[F.lit(x) for x in LANGUAGE_ORDER])
    further = F.array_sort(F.filter(seen, lambda x: ~F.array_contains(order, x) & (x != "unknown")))
    known = F.concat(F.filter(order, lambda x: F.array_contains(seen, x)), further)
    return F.when((F.size(known) == 0) & (F.count(F.lit(1)) > 0), F.array(F.lit("unknown"))).otherwise(known)


def metadata(findings: DataFrame) -> DataFrame:
    """languages_scanned; files_scanned, which counts findings in source files; and source_files, which counts files."""
    source = F.col("language") != "unknown"
    return findings.agg(
        languages_scanned().alias("languages_scanned"),
        F.count_if(source).alias("files_scanned"),
        F.count_distinct(F.when(source, F.col("file_path"))).alias("source_files"),
    )


def report(findings: DataFrame, project_name: str, scan_root: str | None = None, with_findings: bool = False) -> DataFrame:
    """The report as one row: name, metadata, status, aggregates and, for reports of bounded size, the findings.

    `with_findings` gathers every finding into the row, as one project's JSON document needs; at scale the findings stay
    a table beside the report.
    """
    full = complete(findings)
    aggregates = [*summary_columns(), breakdown_map().alias("severity_breakdown"), languages_scanned().alias("languages_scanned"), F.count_if(F.col("language") != "unknown").alias("files_scanned")]
    if with_findings:
        aggregates.append(F.sort_array(F.collect_list(F.struct("file_path", "line_number", "column_start", *[c for c in full.columns if c not in ("file_path", "line_number", "column_start")]))).alias("findings"))
    one = full.agg(*aggregates)
    meta = F.struct(F.lit(project_name).alias("project_name"), F.lit(scan_root).cast("string").alias("scan_root"), "languages_scanned", "files_scanned")
    return one.select(F.lit(project_name).alias("project_name"), meta.alias("metadata"), F.lit("COMPLETE").alias("status"), *[c for c in one.columns if c not in ("languages_scanned", "files_scanned")])


def watched(findings: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """The findings, and counters that the action that runs over them fills on its way: attempted, enriched, failed,
    critical. No second pass: `observation.get` has them once the findings have been written."""
    observation = Observation(name)
    n, good = F.count(F.lit(1)), F.count_if(is_enriched())
    counters = [n.alias("attempted"), good.alias("enriched"), (n - good).alias("failed"), F.count_if(F.col("severity") == "CRITICAL").alias("critical")]
    return complete(findings).observe(observation, *counters), observation


def timed(report_row: DataFrame) -> DataFrame:
    """The report, computed now, with scan_duration_seconds in its metadata: the driver's clock around the whole scan."""
    began = time.monotonic()
    rows = report_row.collect()  # one row
    made = report_row.sparkSession.createDataFrame(rows, report_row.schema)
    return made.withColumn("metadata", F.col("metadata").withField("scan_duration_seconds", F.lit(time.monotonic() - began)))


def to_json(report_row: DataFrame) -> DataFrame:
    return report_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
