"""Sharding by sampled splitters."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlake.llm._frames import Workspace, text_or_empty
from cipherlake.shipping import ship_package


#: A row's key: the hash of its text, of its id, and of its place in the written table, which no other row has.
Key = tuple[int, int, int]


def sample_keys(keys: DataFrame, n_sample: int) -> list[Key]:
    """About `n_sample` keys, each row drawn on its own with a chance in proportion to `size`.

    The chances sum to `n_sample` at most, so the driver gets that many keys, give or take a few square roots, however
    large the table is.
    """
    total = keys.agg(F.sum("size").alias("total")).first().total or 1
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "h1", "h2", "h3"), 12).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(float(2**52))
    drawn = keys.where(u < F.col("size") * F.lit(n_sample / total)).select("h1", "h2", "h3")
    return sorted((r.h1, r.h2, r.h3) for r in drawn.collect())


def quantile_splitters(keys: list[Key], n_ranges: int) -> list[Key]:
    """At most n_ranges - 1 distinct boundaries from sorted keys; the draw was weighted, so sample ranks stand for bytes."""
    return sorted({keys[len(keys) * k // n_ranges] for k in range(1, n_ranges)}) if keys else []


def places(splitters: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row of `keys` the number of rows of `splitters` (sorted, all columns) at or below it: a binary search on
    the first column, then on the next ones for rows that are equal to a splitter in it, once per such value."""
    first = splitters[:, 0]
    low, high = np.searchsorted(first, keys[:, 0], side="left"), np.searchsorted(first, keys[:, 0], side="right")
    if splitters.shape[1] == 1:
        return high
    out = low.copy()
    tied = np.flatnonzero(low < high)
    for at in np.unique(low[tied]):
        rows = tied[low[tied] == at]
        out[rows] = at + places(splitters[at : high[rows[0]], 1:], keys[rows, 1:])
    return out


def range_of(splitters: list[Key]) -> Column:
    """The number of splitters at or below the key (h1, h2, h3), by binary search."""
    table = np.array(splitters, dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf("int")
    def search(h1: pd.Series, h2: pd.Series, h3: pd.Series) -> pd.Series:
        return pd.Series(places(table, np.stack([h1.to_numpy(), h2.to_numpy(), h3.to_numpy()], axis=1)).astype(np.int32))

    return search("h1", "h2", "h3")


def find_splitters(keys: DataFrame, n_ranges: int, n_sample: int, overfull: float, max_rounds: int) -> list[Key]:
    """Quantiles of a size-weighted sample; ranges above `overfull` times the mean in bytes or rows are subdivided at
    splitters drawn within them, up to `max_rounds` times."""
    splitters = quantile_splitters(sample_keys(keys, n_sample), n_ranges)
    for _ in range(max_rounds):
        ranged = keys.withColumn("range", range_of(splitters))
        totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        all_bytes, all_rows = sum(r.bytes for r in totals), sum(r.rows for r in totals)
        full = [r for r in totals if r.bytes > overfull * all_bytes / n_ranges or r.rows > overfull * all_rows / n_ranges]
        if not full:
            break
        inside = ranged.where(F.col("range").isin([r.range for r in full]))
        # Rows weigh as bytes do here: a range may be overfull in either.
        mean = max(1, all_bytes // max(1, all_rows))
        sample = sample_keys(inside.withColumn("size", F.col("size") + F.lit(mean)), n_sample)
        cuts = set(splitters)
        by_range: dict[int, list] = {}
        for key in sample:
            by_range.setdefault(bisect.bisect_right(splitters, key), []).append(key)
        for r in full:
            pieces = int(np.ceil(max(r.bytes * n_ranges / all_bytes, r.rows * n_ranges / all_rows))) + 1
            cuts.update(quantile_splitters(by_range.get(r.range, []), pieces))
        if len(cuts) == len(splitters):
            break
        splitters = sorted(cuts)
    return splitters


def row_keys(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, size, text_crc32 and the key (h1, h2, h3) of each row."""
    text = text_or_empty(text_col)
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("id"), F.col(f"`{id_col}`")).alias("h2"),
        F.xxhash64(F.lit("row"), F.monotonically_increasing_id()).alias("h3"),
    )


def shard_bytes(
    df: DataFrame,
    n_shards: int = 8,
    text_col: str = "text",
    id_col: str = "doc_id",
    n_ranges: int = 64,
    range_rows: int = 1_000_000,
    n_sample: int = 20_000,
    overfull: float = 2.0,
    max_rounds: int = 4,
) -> DataFrame:
    """One row per input row, with its shard 0 .. n_shards - 1 under the law `bytes`: shard sizes differ by little more than one row's size.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard (null).

    The key is the text's hash, then the id's, then one of the row's place: equal texts stand together in one shard,
    unless their group crosses a shard's end, where it is cut by id, and repeated rows are cut as any others. Splitters
    are quantiles of size-weighted keys; every row is range-partitioned by binary search. There are as many ranges as it
    takes for one to hold about `range_rows` rows, by the counted rows, but `n_ranges` at least; the sample has about
    `n_sample` keys, or 32 a range. Ranges above `overfull` times the mean in bytes or rows are subdivided at splitters
    drawn within them, up to `max_rounds` times, so a group of equal texts of any size is spread too. Exact byte totals of
    the ranges turn each row's place in its range into a global byte offset, and the shard is that offset's share of the
    total. What the driver sees grows with the number of ranges only: some 10 MB for 10 billion rows.

    Null text is empty (size 1). Null ids sort as id hash of null. Repeated rows follow one another in an order
    that depends on the input's order. Other columns are not read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "sharding")
    # Written once: the last hash depends on a row's place in the input.
    keys = ws.save(row_keys(df, text_col, id_col), "keys")

    n_ranges = max(n_ranges, -(-keys.count() // range_rows))
    n_sample = max(n_sample, 32 * n_ranges)
    splitters = find_splitters(keys, n_ranges, n_sample, overfull, max_rounds)
    ranged = keys.withColumn("range", range_of(splitters))
    totals = sorted(
        ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect(),
        key=lambda r: r.range,
    )
    all_bytes, before, offsets = sum(r.bytes for r in totals), [0, 0], []
    for r in totals:
        offsets.append((r.range, *before))
        before = [before[0] + r.bytes, before[1] + r.rows]
    starts = spark.createDataFrame(offsets, "range int, bytes_before long, rows_before long")

    at = Window.partitionBy("range").orderBy("h1", "h2", "h3")
    placed = (
        ranged.join(F.broadcast(starts), "range")
        .withColumn("end", F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, 0)) + F.col("bytes_before"))
        .withColumn("row", F.row_number().over(at) + F.col("rows_before") - 1)
    )
    middle = F.col("end") - F.col("size") / F.lit(2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * F.lit(n_shards) / F.lit(max(all_bytes, 1)))).cast("int")
    placed = ws.save(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"), "placed")
    ws.drop("keys")
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
