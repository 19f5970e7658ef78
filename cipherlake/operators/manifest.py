"""Findings in dependency manifests: lines, JSON sections, and the ordered signatures."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.needles import has_bit, pattern_bits
from cipherlake.functions.text import lines, strip
from cipherlake.operators.findings import FINDING_COLUMNS
from cipherlake.rules.expressions import first_match, with_rule
from cipherlake.rules.tables import DEPENDENCY_SECTIONS, MANIFEST_RULES, MAX_SNIPPET

COMMENT = r"^(#|//|<!--|\*|;)"


#: Letters that case folding takes for a plain one, though their lower case is another.
ODD_LETTERS = ("\u017f", "\u0131", "\u0130")


def needles(key: str) -> list[str]:
    """Of a signature, the texts of which a match holds one."""
    return re.sub(r"\\b|\\s\*=", "", key).replace("\\.", ".").split("|")


def manifest_rule(text: Column, low: Column, odd: Column, bits: Column | None = None) -> Column:
    """The first signature that occurs in the text, by number; word boundaries know all letters, on any Java version.

    `low` is the text in lower case, and `odd` whether it may hold ODD_LETTERS: a signature's pattern is tried only where
    a substring search finds one of its needles, or where that would not tell. `bits` (`manifest_bits` of the whole file)
    leave out signatures of which the file has no needle.
    """
    def test(rule) -> Column:
        near = reduce(or_, [F.contains(low, F.lit(n)) for n in needles(rule.key)])
        if bits is not None:
            near = has_bit(bits, rule.ord - 1) & near
        return (odd | near) & text.rlike(f"(?iU){rule.key}")

    return first_match(MANIFEST_RULES, test)


def manifest_bits(text: Column) -> Column:
    """By one pass over a file: which signatures some line of it may match."""
    return pattern_bits(text, [needles(rule.key) for rule in MANIFEST_RULES])


def is_odd(text: Column) -> Column:
    return reduce(or_, [F.contains(text, F.lit(x)) for x in ODD_LETTERS])


def manifest_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds line_number and line for each stripped line that is neither blank nor a comment."""
    each = files.select("*", F.posexplode(lines(F.col(text_col))).alias("_pos", "_raw"))
    stripped = each.withColumn("line", strip(F.col("_raw"))).withColumn("line_number", F.col("_pos") + 1)
    return stripped.where((F.col("line") != "") & ~F.col("line").rlike(COMMENT)).drop("_pos", "_raw")


def _finding(df: DataFrame, snippet: Column) -> DataFrame:
    return df.withColumns({"language": F.lit("unknown"), "column_start": F.lit(None).cast("int"), "column_end": F.lit(None).cast("int"), "code_snippet": snippet})


def scan_lines(files: DataFrame, *keep: str) -> DataFrame:
    """At most one finding a line, from (file_path, text); columns in `keep` are carried."""
    each = manifest_lines(files.select("file_path", "text", *keep))
    found = with_rule(each, MANIFEST_RULES, manifest_rule(F.col("line"), F.lower("line"), is_odd(F.col("line"))))
    return _finding(found, F.substring("line", 1, MAX_SNIPPET)).select(*FINDING_COLUMNS, *keep)


def json_names(text: Column) -> Column:
    """The names in a JSON manifest's four sections, in section order; sections that are no objects are passed over."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.json_object_keys(F.get_json_object(text, f"$.{s}")), empty) for s in DEPENDENCY_SECTIONS])


def scan_manifests(files: DataFrame) -> DataFrame:
    """Findings of manifests (file_path, text), in one pass over the texts.

    Each text becomes an array of candidates: a `.json` name (lower case) that parses gives its dependency names, with
    the first line that contains each; other texts give their lines, without comments unless the name is `.json`.
    """
    is_json = F.col("file_path").endswith(".json")
    parsed = is_json & F.try_parse_json("text").isNotNull()
    files = files.select("file_path", lines(F.col("text")).alias("_lines"), is_json.alias("_json"), parsed.alias("_parsed"), F.when(parsed, json_names(F.col("text"))).alias("_names"), is_odd(F.col("text")).alias("_odd"), manifest_bits(F.col("text")).alias("_bits"))
    # A file without any needle has no line to look at.
    files = files.where("_odd OR _bits != 0")
    by_name = F.expr("transform(_names, d -> named_struct('line_number', greatest(cast(array_position(transform(_lines, l -> instr(l, d) > 0), true) as int), 1), 'line', d))")
    stripped = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line_number"), strip(x).alias("line")))
    by_line = F.filter(stripped, lambda x: (x["line"] != "") & (F.col("_json") | ~x["line"].rlike(COMMENT)))
    # Lower case is made before the explosion, as a filter would otherwise make it once for every signature.
    folded = F.transform(F.when(F.col("_parsed"), by_name).otherwise(by_line), lambda x: F.struct(x["line_number"].alias("line_number"), x["line"].alias("line"), F.lower(x["line"]).alias("low")))
    each = files.select("file_path", "_parsed", "_odd", "_bits", F.explode(folded).alias("_c"))
    each = each.select("file_path", "_parsed", "_odd", "_bits", "_c.line_number", "_c.line", "_c.low")
    found = with_rule(each, MANIFEST_RULES, manifest_rule(F.col("line"), F.col("low"), F.col("_odd"), F.col("_bits")))
    return _finding(found, F.when(F.col("_parsed"), F.col("line")).otherwise(F.substring("line", 1, MAX_SNIPPET))).select(*FINDING_COLUMNS)
