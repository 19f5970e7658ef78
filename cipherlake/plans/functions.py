"""The SQL surface: node extraction as a table function, for lateral joins over any table of texts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cipherlake.operators import nodes as N
from cipherlake.shipping import ship_package

#: The function's columns: those of a table of nodes, but for the file's.
COLUMNS = N.NODE_SCHEMA.replace("file_path string, language string, text_id long, ", "")
_NAMES = ("seq", "node_type", "text", "line_number", "column_start", "column_end", "start", "stop", "root_module", "idents", "segments", "ancestors")


def register_functions(spark: SparkSession, name: str = "source_nodes") -> None:
    """Registers `source_nodes(language, text)`: `SELECT ... FROM files f, LATERAL source_nodes(f.language, f.text) n`.

    Its extractors are those of all languages known now, `register_language`'s included; they go to the executors with
    the function, so register it again after adding one. A text whose language is unknown or null, or whose extractor
    fails, gives no rows; a null text is empty. Rows cross to Python in Arrow batches.
    """
    registered = dict(N._REGISTERED)

    class SourceNodes:
        def eval(self, language: str, text: str) -> Iterator[tuple]:
            try:
                nodes = N.nodes_of(text or "", language, registered)
            except (IndexError, KeyError, ValueError, RecursionError, MemoryError):
                return
            for seq, node in enumerate(nodes):
                around = node.get("ancestors")
                around = around and [tuple(a[k] for k in ("type", "start", "stop", "marked", "child_idents")) for a in around]
                yield (seq, *(node.get(c) for c in _NAMES[1:-1]), around)

    ship_package(spark)
    spark.udtf.register(name, F.udtf(SourceNodes, returnType=COLUMNS, useArrow=True))
