"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions alone.

A HyperLogLog sketch of the sites of each line hash is built by aggregation and merged in the shuffle.
Lines clearly above the limit are boilerplate; those whose estimate is near it get an exact distinct
count. Boilerplate lines are removed from all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latecast.llm.shared import Work, numbered, whole_text

#: A line on so many sites is boilerplate.
LEAST_SITES = 10
PRECISION = 10  # 2 ** 10 registers: a standard error of 3.25 %
MARGIN = 6 * 1.04 / 2 ** (PRECISION / 2)
#: So many hashes are broadcast at most (16 MB); beyond that the join shuffles.
BROADCAST_ROWS = 1 << 20
BLANKS = " \t\x0b\x0c\r"


def split_lines(column: str) -> Column:
    return F.split(whole_text(column), "\n", -1)


def line_hash(line: Column) -> Column:
    """64 bits of the trimmed line; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def bounded(table: DataFrame) -> DataFrame:
    """A written table of hashes, marked for broadcast only if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def boilerplate(
    docs: DataFrame, work: Work, *, text_col: str = "text", site_col: str = "source",
    least: int = LEAST_SITES,
) -> DataFrame:
    """Hashes of the lines that occur on at least ``least`` sites; a null site is one of them."""
    site = F.when(F.col(site_col).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("s"), F.col(site_col).cast("string"))
    )
    hashes = F.array_distinct(F.transform(split_lines(text_col), line_hash))
    lines = docs.select(site.alias("site"), F.explode(hashes).alias("hash")).where("hash is not null")
    spread = work.table(
        lines.groupBy("hash").agg(F.hll_sketch_agg("site", PRECISION).alias("sketch"))
        .select("hash", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= least * (1 - MARGIN) - 1), "spread",
    )
    near = work.table(
        spread.where(F.col("sites") <= least * (1 + MARGIN) + 1).select("hash"), "near"
    )
    exact = lines.join(bounded(near), "hash", "left_semi").distinct().groupBy("hash").count()
    above = spread.where(F.col("sites") > least * (1 + MARGIN) + 1).select("hash")
    return work.table(above.unionByName(exact.where(F.col("count") >= least).select("hash")), "boilerplate")


def without_boilerplate(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    least: int = LEAST_SITES, lines_col: str = "n_lines", removed_col: str = "n_removed",
) -> DataFrame:
    """All columns with the boilerplate lines taken out of the text, and two counts.

    ``n_lines`` counts a text's lines that are not blank, ``n_removed`` those taken out. Null and empty
    texts stay as they are. Blank lines stay. Lines are compared without blanks at their ends. Rows
    that repeat an id are cleaned each by its own text. Very long texts are split whole. Columns named
    like the counts are replaced; others may have any names. No rows give no rows.
    """
    rest = docs.drop(lines_col, removed_col)
    plain, (id_, text, site) = numbered(rest, id_col, text_col, site_col)
    return _without_boilerplate(plain, id_, text, site, least).toDF(*rest.columns, lines_col, removed_col)


def _without_boilerplate(docs: DataFrame, id_col: str, text_col: str, site_col: str, least: int) -> DataFrame:
    lines_col, removed_col = "n_lines", "n_removed"
    work = Work(docs.sparkSession, "line-dedup")
    found = boilerplate(docs, work, text_col=text_col, site_col=site_col, least=least)
    key = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"),
           F.col(id_col).isNull().alias("__none"), F.xxhash64(whole_text(text_col)).alias("__text")]
    names = ["__id", "__none", "__text"]
    lines = docs.select(*key, F.posexplode(F.transform(split_lines(text_col), line_hash)).alias("__at", "hash"))
    hits = work.table(
        lines.where("hash is not null").join(bounded(found), "hash", "left_semi")
        .groupBy(*names).agg(F.collect_set("__at").alias("__hits")), "hits",
    )
    rows = docs
    joined = rows.select("*", *key).join(hits, names, "left")
    left = F.filter(split_lines(text_col), lambda _, i: ~F.array_contains("__hits", i))
    text = F.when(F.col("__hits").isNotNull(), F.array_join(left, "\n")).otherwise(F.col(text_col))
    full = F.size(F.filter(split_lines(text_col), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in rows.columns],
        full.cast("long").alias(lines_col),
        F.coalesce(F.size("__hits"), F.lit(0)).cast("long").alias(removed_col),
    )
