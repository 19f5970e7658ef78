"""URL and file-name functions of discovery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cipherlake.functions.text import strip
from cipherlake.rules.tables import FILE_EXTENSIONS, MAX_CONTEXT_CHARS, MAX_FILE_KB, MIN_FILE_CHARS


def is_file_url(url: Column) -> Column:
    """A /blob/ URL, or one whose last segment has a dot but doesn't start with one; query and fragment don't count."""
    clean = F.regexp_extract(url, "^([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(clean, "/+$", ""), "/"), -1)
    return F.contains(clean, F.lit("/blob/")) | (F.contains(last, F.lit(".")) & ~last.startswith("."))


def raw_url(url: Column) -> Column:
    out = F.replace(url, F.lit("github.com"), F.lit("raw.githubusercontent.com"))
    return F.replace(F.replace(out, F.lit("/blob/"), F.lit("/")), F.lit("/tree/"), F.lit("/"))


def filename_from_url(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    name = F.element_at(F.split(last, "\\?"), 1)
    return F.when((name != "") & F.contains(name, F.lit(".")), name).otherwise("scraped_file.py")


def allowed_extension(name: Column) -> Column:
    return F.lower(name).rlike("\\.(" + "|".join(e[1:] for e in FILE_EXTENSIONS) + ")$")


def passes_size_gates(content: Column) -> Column:
    """Not tiny once stripped, and not above the limit."""
    return F.when(F.length(content) / 1024 <= MAX_FILE_KB, F.length(strip(content)) >= MIN_FILE_CHARS).otherwise(False)


def company_label(domain: Column) -> Column:
    return F.lower(F.element_at(F.split(domain, "\\."), 1))


def safe_dir_name(domain: Column) -> Column:
    return F.translate(domain, "./", "__")


def basename(path: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "[/\\\\]"), -1)
    return F.when(name == "", "uploaded_file").otherwise(name)


def html_context(html: Column, status: Column | None = None) -> Column:
    """A page's text without tags, white space collapsed, up to the excerpt's length; null for failed or tiny pages."""
    text = strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "\\s+", " "))
    ok = F.length(html) > 50 if status is None else (status == 200) & (F.length(html) > 50)
    return F.when(ok, F.substring(text, 1, MAX_CONTEXT_CHARS))


def usable_context(context: Column) -> Column:
    """Contexts are used only with more than 100 characters; others fall back to the static one."""
    return F.when(F.length(strip(context)) > 100, context)
