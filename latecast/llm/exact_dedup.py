"""Exact dedup: two passes with a Bloom filter; only possibly repeated hashes shuffle.

Pass 1 scans the texts once, keeps (id, hash, digest) and builds the filter of hashes that may occur
twice. Pass 2 lets every row the filter does not name pass straight through as a group of its own and
groups the others by digest. Filters are bounded: beyond ``MOST_BITS`` the hash space is cut into
ranges with one filter each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latecast.llm import bloom
from latecast.llm.shared import Work, normalised, numbered

BITS_PER_ROW = 16
MOST_BITS = 1 << 29


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the normalised text, and a 64-bit hash made from the digest."""
    digest = F.sha2(normalised(text_col).cast("binary"), 256)
    return docs.select(F.col(id_col).alias("id"), digest.alias("sha")).withColumn(
        "hash", F.xxhash64("sha")
    )


def _grouped(rows: DataFrame, work: Work, name: str) -> DataFrame:
    """Rows that may repeat: counted by (digest, id) first, so that a hot text is a few rows."""
    counted = rows.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    groups = work.table(
        counted.groupBy("sha").agg(first.alias("first"), F.sum("n").alias("group_size"))
        .where("group_size > 1").select("sha", F.col("first.id").alias("keep_id"), "group_size"),
        f"groups-{name}",
    )
    joined = counted.join(groups, "sha", "left")
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return joined.select("id", "sha", keep.alias("keep_id"), size.alias("group_size"),
                         copies.alias("copy")).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha",
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    bits_per_row: int = BITS_PER_ROW, most_bits: int = MOST_BITS,
) -> DataFrame:
    """Per row: id, keep_id (smallest id of the equal texts), group_size, kept, sha.

    Null and empty texts are equal. A null id sorts last. Of rows that repeat with the same id and
    text one is kept. Very long texts are hashed whole. No rows give no rows. Other columns, whatever
    their names, are not looked at. Beyond one filter, rows are written by range of their hash once, and
    each range reads its own.
    """
    spark = docs.sparkSession
    work = Work(spark, "exact-dedup")
    light = work.table(signed(docs, id_col, text_col), "signed")
    bits, rounds = bloom.filter_bits(light.count(), bits_per_row, most_bits)

    def groups_of(part: DataFrame, name: str) -> DataFrame:
        may = bloom.contains(spark, bloom.filter_of(part.select("hash"), bits))
        marked = work.table(part.withColumn("may", may("hash")), f"marked-{name}")
        alone = marked.where("not may").select(
            "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "sha",
        )
        return alone.unionByName(_grouped(marked.where("may"), work, name))

    if rounds == 1:
        found = groups_of(light, "0")
        work.drop("signed")
        return found
    at = F.pmod(F.shiftrightunsigned("hash", 17), F.lit(rounds)).cast("int")
    dealt = work.partitioned(light.withColumn("range", at), "ranges", "range")
    work.drop("signed")
    each = (groups_of(dealt.where(F.col("range") == i).drop("range"), str(i)) for i in range(rounds))
    return work.appended(each, "groups")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns: of equal texts one row with the smallest id.

    Only rows whose id a filter of the dropped ids names shuffle; all others go straight through. Of
    rows that repeat with the same id and text one stays. Nulls and very long texts are as in
    ``exact_groups``; no rows give no rows; columns may have any names.
    """
    plain, (id_, text) = numbered(docs, id_col, text_col)
    return _without_copies(plain, id_, text).toDF(*docs.columns)


def _without_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    groups = exact_groups(docs, id_col, text_col)
    work = Work(docs.sparkSession, "copies")
    listed = work.table(
        groups.where("group_size > 1").groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
        .agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
        .where("not __kept or __n > 1"), "listed",
    )
    named = bloom.named_by(listed.select(F.xxhash64("__id").alias("h")))
    rows = docs.withColumn("__may", named(F.xxhash64(id_col)))
    straight = rows.where("not __may").drop("__may")
    sha = F.sha2(normalised(text_col).cast("binary"), 256)
    suspects = rows.where("__may").drop("__may").withColumn("__sha2", sha)
    match = suspects[id_col].eqNullSafe(listed["__id"]) & (F.col("__sha2") == F.col("__sha"))
    single = suspects.join(listed, match, "left_anti").drop("__sha2")
    again = suspects.join(listed.where("__kept"), match, "left_semi")
    again = again.dropDuplicates([id_col, "__sha2"]).drop("__sha2")
    return straight.unionByName(single).unionByName(again)
