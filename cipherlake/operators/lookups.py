"""From syntax nodes to findings: each detection is a lookup of a node's key in an ordered rule table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.text import quoted, strip
from cipherlake.operators.findings import FINDING_COLUMNS
from cipherlake.operators.nodes import text_id
from cipherlake.rules import tables as T
from cipherlake.rules.expressions import RULE_COLUMNS, first_match, values_relation
from cipherlake.rules.tables import Rule


def strip_chars(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


@dataclass(frozen=True)
class Detector:
    """One kind of lookup: which nodes it takes, their key in a rule table, and how a hit becomes a finding.

    The columns are expressions over a row of nodes; in `rename` also over the joined rule. `span` is the interval of the
    file that the finding shows (the node's own by default), at most `limit` characters of it, unless `snippet` gives
    something else; key sizes are looked for in all of the interval.
    """

    name: str
    languages: tuple[str, ...]
    takes: Column
    rules: tuple[Rule, ...]
    key: Column
    snippet: Column | None = None
    context: Column | None = None
    rename: Column | None = None
    sizes: Mapping[str, Mapping[int, str]] | None = None
    size_pattern: str = T.OTHER_SIZE_PATTERN
    span: Column | None = None
    limit: int | None = None


def _case(detectors: Sequence[Detector], value, default: Column) -> Column:
    chain = None
    for d in detectors:
        v = value(d)
        if v is not None:
            test = F.col("detector") == d.name
            chain = F.when(test, v) if chain is None else chain.when(test, v)
    return default if chain is None else chain.otherwise(default)


def detect(nodes: DataFrame, detectors: Sequence[Detector], texts: DataFrame) -> DataFrame:
    """Nodes with a rule, as findings; one pass over the nodes however many detectors there are.

    A node belongs to one detector, whose key is looked up by an equi-join with the detectors' rule tables in one
    relation of a few hundred constant rows, which is why it is broadcast. `texts` (file_path, text) are the files: what
    a hit shows is cut out of its file by an equi-join, so texts meet hits only. Hits are few, and adaptive execution
    broadcasts them while their measured size allows. A file that occurs repeatedly gives its findings each time.
    """
    which = None
    for d in detectors:
        test = F.col("language").isin(*d.languages) & d.takes
        which = F.when(test, d.name) if which is None else which.when(test, d.name)
    own = nodes.withColumn("detector", which).where("detector IS NOT NULL")
    own = own.withColumn("rule_key", _case(detectors, lambda d: d.key, F.lit(None).cast("string")))
    rows = [(d.name, *r) for d in detectors for r in d.rules]
    table = values_relation(nodes.sparkSession, rows, ("detector", *RULE_COLUMNS))
    table = table.select("detector", F.col("key").alias("rule_key"), F.col("algorithm").alias("algorithm_detected"), "vulnerability_class", "severity", F.col("is_vulnerable").alias("is_quantum_vulnerable"))
    hit = own.join(F.broadcast(table), ["detector", "rule_key"]).where(_case(detectors, lambda d: d.context, F.lit(True)))
    hit = hit.withColumn("algorithm_detected", F.coalesce(_case(detectors, lambda d: d.rename, F.lit(None).cast("string")), "algorithm_detected"))
    hit = hit.withColumn("span", _case(detectors, lambda d: d.span, F.struct("start", "stop")))
    hit = hit.drop("ancestors", "idents", "segments", "root_module", "rule_key").distinct()
    files = texts.select("file_path", text_id().alias("text_id"), F.col("text").alias("_file"))
    hit = hit.join(files, ["file_path", "text_id"])
    shown = strip(F.substring("_file", F.col("span.start") + 1, F.col("span.stop") - F.col("span.start")))
    # Nodes of registered extractors may come without an interval.
    hit = hit.withColumn("shown", F.coalesce(shown, strip(F.col("text")))).drop("_file")
    base = F.upper(F.element_at(F.split("algorithm_detected", "-"), 1))
    size = _case(detectors, lambda d: F.regexp_extract("shown", d.size_pattern, 1) if d.sizes else None, F.lit(""))
    hit = hit.withColumn("sized", F.concat_ws("-", base, size))
    refined = _case(detectors, lambda d: F.element_at(_size_table(d.sizes), F.col("sized")) if d.sizes else None, F.lit(None).cast("string"))
    hit = hit.withColumn("refined", refined)
    hit = hit.withColumns(
        {
            "algorithm_detected": F.when(F.col("refined").isNotNull(), F.col("sized")).otherwise(F.col("algorithm_detected")),
            "severity": F.coalesce("refined", "severity"),
            "code_snippet": _case(detectors, lambda d: d.snippet if d.snippet is not None else F.substring("shown", 1, d.limit) if d.limit else None, F.col("shown")),
        }
    )
    return hit.where(strip(F.col("code_snippet")) != "").select(*FINDING_COLUMNS)


def _size_table(sizes: Mapping[str, Mapping[int, str]]) -> Column:
    """`base-size` to severity, as a constant map."""
    return F.create_map(*[x for base, by in sizes.items() for n, severity in by.items() for x in (F.lit(f"{base}-{n}"), F.lit(severity))])


def _is(*kinds: str) -> Column:
    return F.col("node_type").isin(*kinds)


def _nearest(levels: int, kinds: Sequence[str]) -> Column:
    """The interval of the nearest of the first ancestors that is of one of the kinds, else the node's own."""
    found = F.get(F.filter(F.slice("ancestors", 1, levels), lambda a: a["type"].isin(*kinds)), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found["start"].alias("start"), found["stop"].alias("stop"))).otherwise(F.struct("start", "stop"))


def _member() -> Column:
    """The algorithm of the first imported name that stands for one, else of the first such segment of a dotted name."""
    names = F.create_map(*[F.lit(x) for pair in T.PYTHON_MEMBERS.items() for x in pair])
    tried = F.transform(F.concat("idents", "segments"), lambda x: F.element_at(names, F.lower(x)))
    found = F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.col("node_type") == "import_from_statement", found)


def java_import_key(text: Column) -> Column:
    """The first key within the import."""
    return first_match(T.JAVA_IMPORTS, lambda r: F.contains(text, F.lit(r.key)), "key")


def java_hint(text: Column) -> Column:
    lower, chain = F.lower(text), None
    for key, name in T.JAVA_HINTS:
        test = F.contains(lower, F.lit(key))
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def go_import_path(text: Column) -> Column:
    return strip(strip_chars(text, '"'))


def go_import_key(path: Column) -> Column:
    """An equal key, else the first key within the path."""
    exact = first_match(T.GO_IMPORTS, lambda r: path == r.key, "key")
    return F.coalesce(exact, first_match(T.GO_IMPORTS, lambda r: F.contains(path, F.lit(r.key)), "key"))


def csharp_using_key(text: Column) -> Column:
    """The first namespace within the directive."""
    return first_match(T.CSHARP_NAMESPACES, lambda r: F.contains(text, F.lit(r.key)), "key")


GO_CALL = r"^([a-z0-9]+)\.([A-Za-z0-9]+)\s*\("
CSHARP_NEW = r"^new\s+([A-Za-z0-9_<>]+)"
CSHARP_CALL = r"^([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\s*\("


def builtin_detectors() -> dict[str, Detector]:
    """The detections of the five languages, by name."""
    text = F.col("text")
    js = ("javascript", "typescript")
    java_methods = F.array(*[F.lit(m) for m in T.JAVA_METHODS])
    short = T.MAX_SNIPPET
    found = [
        Detector("python_import", ("python",), _is("import_statement", "import_from_statement"), T.PYTHON_MODULES, F.col("root_module"), rename=_member(), sizes=T.PYTHON_SIZES, size_pattern=T.PYTHON_SIZE_PATTERN),
        # Keys hold no slash, so a module's last path segment decides.
        Detector("js_module", js, _is("import_statement") | (_is("call_expression") & text.startswith("require(")), T.JS_MODULES, F.element_at(F.split(F.lower(quoted(text)), "/"), -1)),
        Detector(
            "js_literal", js, _is("string"), T.JS_LITERALS, F.lower(strip_chars(text, "\"'`")),
            span=_nearest(4, ("expression_statement", "variable_declaration", "lexical_declaration", "call_expression")),
            context=F.exists(F.slice("ancestors", 1, 5), lambda a: a["type"].isin("call_expression", "new_expression", "member_expression", "arguments") & a["marked"]),
        ),
        Detector("java_import", ("java",), _is("import_declaration"), T.JAVA_IMPORTS, java_import_key(text), rename=java_hint(text)),
        Detector(
            "java_literal", ("java",), _is("string_literal"), T.JAVA_LITERALS, F.lower(strip_chars(text, "\"'")),
            span=_nearest(3, ("expression_statement", "local_variable_declaration", "method_invocation", "variable_declarator")),
            context=F.exists(F.slice("ancestors", 1, 4), lambda a: a["type"].isin("method_invocation", "object_creation_expression") & F.arrays_overlap(F.transform(a["child_idents"], lambda x: F.lower(x)), java_methods)),
            sizes=T.OTHER_SIZES,
        ),
        # An alias stays part of the path: such imports match by substring and keep it in the snippet.
        Detector("go_import", ("go",), _is("import_spec"), T.GO_IMPORTS, go_import_key(go_import_path(text)), snippet=F.concat(F.lit('import "'), go_import_path(text), F.lit('"'))),
        Detector("go_call", ("go",), _is("call_expression"), T.GO_CALLS, F.lower(F.concat_ws(".", F.regexp_extract("text", GO_CALL, 1), F.regexp_extract("text", GO_CALL, 2))), limit=short, sizes=T.OTHER_SIZES),
        Detector("csharp_using", ("csharp",), _is("using_directive"), T.CSHARP_NAMESPACES, csharp_using_key(text)),
        Detector("csharp_creation", ("csharp",), _is("object_creation_expression"), T.CSHARP_CLASSES, F.lower(F.regexp_extract("text", CSHARP_NEW, 1)), limit=short, sizes=T.OTHER_SIZES),
        Detector("csharp_invocation", ("csharp",), _is("invocation_expression"), T.CSHARP_CLASSES, F.lower(F.regexp_extract("text", CSHARP_CALL, 1)), limit=short, context=F.lower(F.regexp_extract("text", CSHARP_CALL, 2)).isin(*T.CSHARP_METHODS), sizes=T.OTHER_SIZES),
        Detector(
            "csharp_literal", ("csharp",), _is("string_literal"), T.CSHARP_LITERALS, F.lower(strip_chars(text, '"')),
            span=_nearest(4, ("expression_statement", "local_declaration_statement", "invocation_expression")),
            context=F.exists(F.slice("ancestors", 1, 4), lambda a: a["marked"] | a["type"].isin("argument_list", "invocation_expression")),
        ),
    ]
    return {d.name: d for d in found}


#: Further detections, by name; `register` adds to it.
_REGISTERED: dict[str, Detector] = {}


def register(detector: Detector) -> None:
    _REGISTERED[detector.name] = detector


def find_in_nodes(nodes: DataFrame, texts: DataFrame, *names: str) -> DataFrame:
    """Findings over the nodes of texts (file_path, text), of all detectors or of the named ones."""
    known = builtin_detectors() | _REGISTERED
    return detect(nodes, [known[n] for n in names or known], texts)
