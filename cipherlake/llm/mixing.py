"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace

#: 52 bits of a hash fill a double's mantissa.
HASH_DIGITS = 13


def unit_uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: the first 52 bits of their MD5, at the cell's middle."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(16**HASH_DIGITS))


def source_rates(
    docs: DataFrame, source_col: str, weights: Mapping[str, float] | None, temperature: float, budget: float
) -> DataFrame:
    """source, n_source, rate: the mean number of copies of each document of the source.

    The target share of a source is its weight over the sum of weights; without weights, its row count to the
    power `temperature` over the sum of these. A source missing from `weights` has weight 0. The target number of
    rows is `budget` times all rows.
    """
    counts = docs.groupBy(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_source")
    )
    if weights is None:
        weight = F.pow(F.col("n_source").cast("double"), F.lit(float(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (str(k), float(v))]) if weights else None
        weight = F.coalesce(table[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    weighted = counts.select("source", "n_source", weight.alias("weight"))
    # The total is one row.
    total = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n_source").alias("all_rows"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(total)).select(
        "source", "n_source", (share * F.col("all_rows") * F.lit(float(budget)) / F.col("n_source")).alias("rate")
    )


def reach(rate: Column) -> Column:
    """A count that no 52-bit uniform gets beyond."""
    return F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)).cast("int")


def poisson_cdf(rates: DataFrame) -> DataFrame:
    """source, cdf: for each source with a rate the Poisson distribution function at 0, 1, 2, ... up to its `reach`.

    Terms are built from logarithms, so that large rates do not underflow. Factorials and the function itself are running
    sums over one row per count, so the work is linear in the rate.
    """
    terms = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), reach(F.col("rate")))).alias("k"))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_fact = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(so_far)
    terms = terms.withColumn("log_fact", log_fact).withColumn("term", F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_fact")))
    terms = terms.withColumn("cdf", F.sum("term").over(so_far))
    listed = terms.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("steps"))
    return listed.select("source", F.transform("steps", lambda x: x["cdf"]).alias("cdf"))


def mix_sources(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    budget: float = 1.0,
    seed: int = 17,
    broadcast_rows: int = 10_000,
    broadcast_steps: int = 1_000_000,
) -> DataFrame:
    """The input rows, each repeated a Poisson number of times, in a global random order.

    A document's count inverts the Poisson distribution with its source's rate at a uniform number hashed from
    seed and id, so a rerun or another partitioning gives the same mixture. Added columns: `mix_copy` (0, 1, ...)
    and `mix_order` (hex digest of seed, id and copy; the global order). Rows are dealt by that digest to the
    shuffle's partitions and sorted within them, so a hot source or a hot text spreads evenly.

    The sources' distribution functions are broadcast only if there are at most `broadcast_rows` sources and
    `broadcast_steps` values in all (8 MB), which is counted first; else they are joined by a shuffle of written tables,
    where adaptive execution splits a hot source.

    A null source is the source with an empty name. Null ids hash as an empty string and share one count. Repeated
    rows (same id) share count and order. Sources with weight 0 give no rows. Columns of `docs` named mix_copy or
    mix_order are replaced. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rates = ws.save(source_rates(docs, source_col, weights, temperature, budget), "rates")
    size = rates.agg(F.count(F.lit(1)).alias("sources"), F.sum(reach(F.col("rate")).cast("long") + 1).alias("steps")).first()
    few = size.sources <= broadcast_rows and (size.steps or 0) <= broadcast_steps
    table = ws.save(poisson_cdf(rates), "functions").select(F.col("source").alias("_mix_source"), F.col("cdf").alias("_mix_cdf"))
    key = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_order")]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    joined = base.join(F.broadcast(table) if few else table, key == F.col("_mix_source"))
    u = unit_uniform(F.lit(seed), F.col(f"`{id_col}`"))
    count = F.coalesce(F.size(F.filter("_mix_cdf", lambda c: c < u)), F.lit(0))
    copies = joined.withColumn("_mix_n", F.when(F.col("_mix_cdf").isNotNull(), count).otherwise(F.lit(0))).where("_mix_n > 0")
    exploded = copies.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_mix_n") - 1)))
    order = F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col("mix_copy")))
    out = exploded.withColumn("mix_order", order).drop("_mix_n", "_mix_source", "_mix_cdf")
    return out.repartition(F.col("mix_order")).sortWithinPartitions("mix_order")
