"""Discovery over recorded search results and fetched files: unions, budgets and unique names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherlake.functions.urls import allowed_extension, company_label, filename_from_url, is_file_url, passes_size_gates, raw_url
from cipherlake.rules.expressions import values_relation
from cipherlake.rules.tables import KNOWN_FILES, KNOWN_HOST, MAX_RESULTS, MAX_SAVED_FILES, SEARCHES


def known_files(spark: SparkSession) -> DataFrame:
    """(company, known_ord, url): a constant dimension of 35 rows."""
    rows = [(company, k + 1, KNOWN_HOST + path) for company, paths in KNOWN_FILES.items() for k, path in enumerate(paths)]
    return values_relation(spark, rows, ("company", "known_ord", "url"))


def search_queries(domains: DataFrame) -> DataFrame:
    """(domain, query_no, query): the searches for each domain's company, the domain's first label as it is written."""
    company = F.element_at(F.split("domain", "\\."), 1)
    texts = F.array(*[F.concat(*[company if part is None else F.lit(part) for part in parts]) for parts in SEARCHES])
    each = domains.select("domain").distinct().select("domain", F.posexplode(texts).alias("query_no", "query"))
    return each.select("domain", "query_no", "query")


def cap_results(results: DataFrame, limit: int = MAX_RESULTS) -> DataFrame:
    """The first `limit` of each query of (domain, query_no, pos, url)."""
    place = Window.partitionBy("domain", "query_no").orderBy("pos", "url")
    return results.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= limit).drop("_n")


def candidate_urls(results: DataFrame) -> DataFrame:
    """(domain, place, url): known files of the domain's company first, then the other distinct results."""
    found = cap_results(results).groupBy("domain", "url").agg(F.min(F.struct("query_no", "pos")).alias("at"))
    domains = results.select("domain").distinct()
    known = domains.join(F.broadcast(known_files(results.sparkSession)), company_label(F.col("domain")) == F.col("company"))
    known = known.select("domain", F.lit(0).alias("is_result"), F.col("known_ord").alias("a"), F.lit(0).alias("b"), "url")
    other = found.join(known.select("domain", "url"), ["domain", "url"], "left_anti")
    other = other.select("domain", F.lit(1).alias("is_result"), F.col("at.query_no").alias("a"), F.col("at.pos").alias("b"), "url")
    place = Window.partitionBy("domain").orderBy("is_result", "a", "b", "url")
    return known.unionByName(other).withColumn("place", F.row_number().over(place).cast("int")).select("domain", "place", "url")


def file_urls(candidates: DataFrame) -> DataFrame:
    return candidates.where(is_file_url(F.col("url"))).withColumn("raw_url", raw_url(F.col("url"))).withColumn("filename", filename_from_url(F.col("raw_url")))


def within_budget(fetched: DataFrame, budget: int = MAX_SAVED_FILES) -> DataFrame:
    """The first `budget` files of each domain that would be saved, of (domain, place, filename, content): failures,
    tiny and large ones don't count."""
    good = fetched.where(F.col("content").isNotNull() & allowed_extension(F.col("filename")) & passes_size_gates(F.col("content")))
    place = Window.partitionBy("domain").orderBy("place")
    return good.withColumn("save_no", F.row_number().over(place).cast("int")).where(F.col("save_no") <= budget)


def unique_names(files: DataFrame) -> DataFrame:
    """Adds saved_name: the file name, then name_1 to name_99, then name_dup for all further ones of a domain."""
    place = Window.partitionBy("domain", "filename").orderBy("place")
    n = F.row_number().over(place) - 1
    return files.withColumn("_n", n).withColumn("saved_name", suffixed(F.col("filename"), F.col("_n"))).drop("_n")


def suffixed(name: Column, n: Column) -> Column:
    ext = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(n == 0, name).when(n < 100, F.concat(stem, F.lit("_"), n.cast("string"), ext)).otherwise(F.concat(stem, F.lit("_dup"), ext))


def top_link(results: DataFrame) -> DataFrame:
    """(query_id, link): of (query_id, pos, link), the first that names a preferred host, else the first https one."""
    preferred = F.contains("link", F.lit("nist.gov")) | F.contains("link", F.lit("open-quantum-safe"))
    usable = results.where(preferred | F.col("link").startswith("https://"))
    best = usable.groupBy("query_id").agg(F.min(F.struct((~preferred).alias("other"), "pos", "link")).alias("best"))
    return best.select("query_id", "best.link")


def model_tiers(spark: SparkSession, base_url: str, keys: list[str], models: list[str]) -> DataFrame:
    """(tier, model, api_key) of the configured endpoints: keys go round, incomplete ones are left out."""
    rows = [(k + 1, m, keys[k % len(keys)] if keys else "") for k, m in enumerate(models)]
    table = spark.createDataFrame(rows, "tier int, model string, api_key string")
    return table.where(F.lit(base_url).startswith("http") & (F.length("api_key") > 8) & (F.col("model") != ""))
