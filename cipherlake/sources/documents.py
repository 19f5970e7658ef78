"""A sink for JSON documents, one file each, written as streams of parts and committed together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from cipherlake.operators.findings import complete
from cipherlake.operators.report import languages_scanned, summary
from cipherlake.shipping import ship_package


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Finished documents of a task: where they wait, and where they belong."""

    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.list_name = options["path"].rstrip("/"), options.get("list", "items")
        self.waiting = f"{self.path}/_uncommitted-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Parts come sorted by document; one part is held at a time."""
        system, _ = _open(self.path)
        folder = f"{_open(self.waiting)[1]}/{TaskContext.get().taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        moves: list[tuple[str, str]] = []
        out, document, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.write(b"]}")
                out.close()

        try:
            for batch in iterator:
                for name, part, json in zip(*(batch.column(c).to_pylist() for c in ("document", "part", "json")), strict=True):
                    if out is None or name != document:
                        close()
                        document, n = name, 0
                        file = f"{quote(name, safe='')}.json"
                        moves.append((f"{folder}/{len(moves)}", f"{_open(self.path)[1]}/{file}"))
                        out = system.open_output_stream(moves[-1][0])
                        head = json if part == 0 else "{}"
                        out.write(f"{head[:-1]}{',' if head != '{}' else ''}\"{self.list_name}\":[".encode())
                        if part == 0:
                            continue
                    out.write((("," if n else "") + json).encode())
                    n += 1
        finally:
            close()
        return Written(moves)

    def commit(self, messages: list[Written]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for source, target in message.moves if message else []:
                system.move(source, target)
        system.delete_dir(_open(self.waiting)[1])

    def abort(self, messages: list[Written]) -> None:
        system, place = _open(self.waiting)
        if system.get_file_info(place).type == pafs.FileType.Directory:
            system.delete_dir(place)


class JsonDocuments(DataSource):
    """`df.write.format("json_documents").option("path", ...)` of (document, part, json), sorted by document and part within
    its task: part 0 is the document's head, an object; the others go into its list (option `list`).

    Files are written aside and moved to `<path>/<document>.json` when the job commits; a failed task leaves none. A
    document that is there already is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return "document string, part int, json string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_reports(findings: DataFrame, project: str, path: str) -> None:
    """Each project's report as a JSON document: its aggregates, and its findings in the order of their places.

    Findings are streamed, so that no row holds a project's findings; a project's document is one task's, being one file.
    `findings` is read twice: give a table.
    """
    spark = findings.sparkSession
    ship_package(spark)
    spark.dataSource.register(JsonDocuments)
    full = complete(findings)
    if "column_start" not in full.columns:
        full = full.withColumn("column_start", F.lit(None).cast("int"))
    aggregates = summary(full, project).join(full.groupBy(project).agg(languages_scanned().alias("languages_scanned")), project)
    body = F.struct(F.col(project).cast("string").alias("project_name"), F.lit("COMPLETE").alias("status"), *[c for c in aggregates.columns if c != project])
    keep_nulls = {"ignoreNullFields": "false"}
    no_place = [F.lit(None).cast(t).alias(f"k{k}") for k, t in enumerate(("string", "int", "int", "string"))]
    heads = aggregates.select(F.col(project).cast("string").alias("document"), F.lit(0).alias("part"), F.to_json(body, keep_nulls).alias("json"), *no_place)
    places = [c.alias(f"k{k}") for k, c in enumerate((F.col("file_path"), F.col("line_number").cast("int"), F.col("column_start").cast("int"), F.col("algorithm_detected")))]
    items = full.select(F.col(project).cast("string").alias("document"), F.lit(1).alias("part"), F.to_json(F.struct(*[c for c in full.columns if c != project]), keep_nulls).alias("json"), *places)
    order = ["document", "part", "k0", "k1", "k2", "k3"]
    dealt = heads.unionByName(items).where("document IS NOT NULL").repartition("document").sortWithinPartitions(*order)
    dealt.select("document", "part", "json").write.format("json_documents").option("path", path).option("list", "findings").mode("append").save()
