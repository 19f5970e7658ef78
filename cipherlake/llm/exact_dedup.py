"""Exact deduplication by skew-safe combining, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.llm._frames import ROW, Workspace, text_or_empty

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = "[ \\x09-\\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, "")


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are equal without white space. The longest original text (code points) stays,
    then the smallest id, of any type that sorts; a null id comes after every other.

    Three combining stages, each grouping by digest *and* full content, so equal digests never merge different
    texts: within each input partition (map-side), per digest and salt, and over salts. The salt is the input
    partition's number, so a hot text reaches the salted stage as at most one row per partition, dealt over
    `salts` tasks, and the last stage as at most `salts` rows. The decisions are then joined back by digest over
    rows without text; adaptive execution splits a hot digest there.

    Nothing depends on a row's place in the input, which may differ between two readings of it: rows that are equal in
    digest, id and length are counted, joined as one, and told off again, the first of the winners as kept.

    Null text counts as empty; empty texts form a group of their own. Repeated rows (same id, same text) count
    each in group_size, and exactly one of them is kept. Input columns other than the two named are not read.
    An empty table gives an empty result.
    """
    rows = digests(df, text_col, id_col, F.lit(0), salts)
    groups = decisions(rows)
    alike = rows.groupBy("digest", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    winner = (F.col("n_chars") == F.col("keep_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return (
        alike.join(groups, F.col("digest") == F.col("group_digest"))
        .withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select("doc_id", "keep_id", "group_size", (winner & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def digests(df: DataFrame, text_col: str, id_col: str, rid: Column, salts: int) -> DataFrame:
    """doc_id, n_chars, rid (orders rows of one length and id), salt, norm, digest."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        text_or_empty(text_col).alias("raw"),
        rid.alias("rid"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    ).select("doc_id", F.char_length("raw").alias("n_chars"), "rid", "salt", normalised(F.col("raw")).alias("norm"))
    return rows.withColumn("digest", F.sha2("norm", 256))


def decisions(rows: DataFrame) -> DataFrame:
    """One row per group, written: group_digest, keep_id, keep_chars, keep_rid, group_size."""
    place = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    # Different contents under one SHA-256 digest: never seen, but reported rather than merged.
    groups = (
        groups.select("digest", "best", "n")
        .groupBy("digest")
        .agg(F.min("best").alias("best"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("contents"))
        .select(
            F.col("digest").alias("group_digest"),
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.short")).alias("keep_chars"),
            F.col("best.rid").alias("keep_rid"),
            F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
            .otherwise(F.col("group_size"))
            .alias("group_size"),
        )
    )
    # Written first: the join then has two plain shuffles, of which adaptive execution can split a hot digest's part.
    return Workspace(rows.sparkSession, "exact-dedup").save(groups, "groups")


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = 32) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, with all their columns: one of each group, whatever its id.

    The rows are written with keys first, as ids may be null or repeated.
    """
    docs = Workspace(docs.sparkSession, "exact-dedup").keyed(docs, "rows")
    kept = decisions(digests(docs, text_col, id_col, F.col(ROW), salts)).select(F.col("keep_rid"))
    return docs.join(kept, F.col(ROW) == F.col("keep_rid"), "left_semi").drop(ROW)
