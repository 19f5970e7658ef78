"""Migration guidance: hybrid advice, documents, static context, prompts, and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlake.functions.text import strip
from cipherlake.functions.urls import usable_context
from cipherlake.rules.tables import COMPLEXITIES, DEFAULT_CONTEXT, NIST_DOCUMENTS, RESPONSE_KEYS, STATIC_CONTEXT, SYMMETRIC_PREFIXES


def should_recommend_hybrid(replacement: Column, complexity: Column) -> Column:
    return (complexity == "HIGH") | ~F.upper(replacement).rlike("^(" + "|".join(SYMMETRIC_PREFIXES) + ")")


def nist_reference(replacement: Column) -> Column:
    """The document of an algorithm, by the first family whose name it contains; null for others."""
    upper, chain = F.upper(replacement), None
    for names, document in NIST_DOCUMENTS:
        test = F.lit(False)
        for name in names:
            test = test | F.contains(upper, F.lit(name))
        chain = F.when(test, document) if chain is None else chain.when(test, document)
    return chain


def static_context(algorithm: Column) -> Column:
    lower, chain = F.lower(algorithm), None
    for key, text in STATIC_CONTEXT:
        test = F.contains(lower, F.lit(key))
        chain = F.when(test, text) if chain is None else chain.when(test, text)
    return chain.otherwise(DEFAULT_CONTEXT)


def web_context(algorithm: Column, live: Column | None = None) -> Column:
    """The context for a prompt: a live page's excerpt if it is usable, else the static text. None stands for no live search."""
    fixed = static_context(algorithm)
    return fixed if live is None else F.coalesce(usable_context(live), fixed)


def clean_response(raw: Column) -> Column:
    """Without white space and byte order marks around it, and without code fences."""
    bare = F.regexp_replace(strip(raw), "^\ufeff+", "")
    return strip(F.regexp_replace(bare, r"(?m)^```(?:json)?\s*|\s*```$", ""))


def response_object(raw: Column) -> Column:
    """The JSON object of a response as text, or null: the cleaned text if it is JSON at all, else its widest {...} part."""
    cleaned = clean_response(raw)
    braces = F.regexp_extract(cleaned, r"(\{[\s\S]*\})", 1)
    text = F.when(F.try_parse_json(cleaned).isNotNull(), cleaned).otherwise(braces)
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def response_fields(text: Column) -> Column:
    """The required fields of a JSON object as a struct of strings; null where one is missing or no string."""
    whole = F.try_parse_json(text)

    def field(key: str) -> Column:
        value = F.try_variant_get(whole, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(whole, f"$.{key}", "string")).alias(key)

    return F.struct(*[field(k) for k in RESPONSE_KEYS])


def valid_response(parsed: Column) -> Column:
    """All fields there and not blank; a known complexity in any case."""
    ok = F.lit(True)
    for key in RESPONSE_KEYS:
        ok = ok & F.coalesce(strip(parsed[key]) != "", F.lit(False))
    return ok & F.coalesce(F.upper(strip(parsed["migration_complexity"])).isin(*COMPLEXITIES), F.lit(False))


#: What a model is told first.
SYSTEM_PROMPT = (
    "You plan migrations from classical to NIST post-quantum cryptography. For the code you are shown, answer with one JSON object and nothing else, no markup around it. "
    "Its keys: " + ", ".join(RESPONSE_KEYS) + ". usage_context: one sentence on what the code does with the algorithm. pqc_replacement: the standardised algorithm or library call to move to. "
    "migration_complexity: " + ", ".join(COMPLEXITIES) + " (LOW for larger keys or another hash, MEDIUM where calls change but the pattern stays, HIGH where the design must change). "
    "reasoning: one sentence of justification. Rely on the background given; where it names no replacement, refer to the vendor's documentation and answer HIGH."
)


def user_prompt(algorithm: Column, language: Column, path: Column, line: Column, snippet: Column, context: Column) -> Column:
    """The request for a model, one fact a line; the snippet should have been sanitized."""
    background = F.coalesce(F.nullif(context, F.lit("")), F.lit("none; recommend with care"))
    place = F.concat(path, F.lit(":"), line.cast("string"))
    facts = (("Finding", algorithm), ("Written in", language), ("Place", place), ("Background", background), ("Code", snippet))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit(""))) for name, value in facts])
