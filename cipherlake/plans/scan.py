"""Whole scans: files to nodes to findings to report, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from cipherlake.operators.enrichment import apply_responses
from cipherlake.operators.findings import complete, fingerprint, report_order
from cipherlake.operators.lookups import find_in_nodes
from cipherlake.operators.manifest import scan_manifests
from cipherlake.operators.nodes import extract_nodes, register_extractor
from cipherlake.operators.report import report, timed, to_json
from cipherlake.sources.corpus import EXTRA_EXTENSIONS, directory, manifests, mock_corpus, sources, uploaded


def scan_texts(source_texts: DataFrame, manifest_texts: DataFrame) -> DataFrame:
    """Findings of sources (file_path, language, text) and manifests (file_path, text), in no order: one pass each."""
    return find_in_nodes(extract_nodes(source_texts), source_texts).unionByName(scan_manifests(manifest_texts))


def scan_files(files: DataFrame) -> DataFrame:
    """Findings of (file_path, rel_path, content), in no order."""
    return scan_texts(sources(files), manifests(files))


def enriched(findings: DataFrame, responses: DataFrame | None) -> DataFrame:
    """With recorded responses (fingerprint, tier, raw); without any, findings stay unenriched."""
    if responses is None:
        return complete(findings)
    return apply_responses(findings.withColumn("fingerprint", fingerprint()), responses, "fingerprint")


def scan_local(spark: SparkSession, project: str, root: str, responses: DataFrame | None = None, with_findings: bool = False) -> DataFrame:
    """The report row of a directory."""
    return report(enriched(scan_texts(*directory(spark, root)), responses), project, root, with_findings)


def scan_upload(spark: SparkSession, name: str | None, content: bytes, with_findings: bool = False) -> DataFrame:
    return report(enriched(scan_files(uploaded(spark, name, content)), None), name or "uploaded_file", with_findings=with_findings)


def scan_mock(spark: SparkSession, domain: str, with_findings: bool = False) -> DataFrame:
    """The report row of the mock corpus, which stands in for a web scan without a network."""
    return report(enriched(scan_files(mock_corpus(spark)), None), domain, with_findings=with_findings)


def scan(spark: SparkSession, target: str, scan_type: str = "local", with_findings: bool = False) -> DataFrame:
    """One project's JSON report, computed now and timed: `local` scans a directory, `web` the mock corpus; other types
    are refused. The row is of bounded size: findings stay out of it, unless `with_findings` asks for a small project's;
    `write_reports` makes whole documents of any size."""
    if scan_type == "local":
        return to_json(timed(scan_local(spark, target, target, with_findings=with_findings)))
    if scan_type == "web":
        return to_json(timed(scan_mock(spark, target, with_findings)))
    raise ValueError(f"unknown scan type: {scan_type}")


def register_language(name: str, extensions: tuple[str, ...], extract: Callable[[str], Iterable[dict]]) -> None:
    """Adds a language to all scans: its lower-case suffixes with dots, and the function that gives a text's nodes.

    Nodes are dicts as `Source.node` makes them. Detections for the language are added by `lookups.register`.
    """
    EXTRA_EXTENSIONS[name] = tuple(extensions)
    register_extractor(name, extract)


def ordered_findings(files: DataFrame, documented: bool = False) -> DataFrame:
    return report_order(scan_files(files), documented)
