"""Mixing sources to target weights: hash-random order, range bins, distributed prefix sums, a cut.

Every row gets a hash-random key from its id. Within a source the keys are cut into ranges by their
leading hex digits; prefix sums of the ranges, level by level (at most ``FAN`` rows of a source in a
window), lead to the range where the source's budget ends, and only that range's rows are sorted. The
last epoch of a source ends exactly at its budget: the row on the cut gives its first words only. All
other rows are compared with that row's place, so neither they nor their texts shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latecast.llm.shared import WORD, Work, whole_text, word_count

DIGITS = 2
FAN = 16**DIGITS
ROWS_PER_RANGE = 1 << 14
MOST_REPEATS = 3
SEED = 7


def _placed(source_col: Column, id_col: Column, text_col: Column, seed: int) -> dict[str, Column]:
    """A row's source, size, and its place: the hash-random key of its id, then a digest of source, id and
    text, which only equal rows share. Rows without id get their key from the text."""
    digest = F.sha2(whole_text(text_col).cast("binary"), 256)
    name = id_col.cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name, F.concat(F.lit("text:"), digest))).cast("binary"))
    source = F.coalesce(source_col.cast("string"), F.lit(""))
    parts = [F.coalesce(name, F.lit("")), source]
    flags = [F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")) for c in (id_col, source_col)]
    own = F.md5(F.concat(*flags, *[F.sha2(c.cast("binary"), 256) for c in parts], digest).cast("binary"))
    return {"none": source_col.isNull(), "source": source, "size": word_count(text_col),
            "place": F.concat(key, own)}


def budgets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Targets of sources (none, source, source_size): weights repeat by code point, null last.

    A target stops at ``most`` times its source's size; what that frees is shared by weight. Sorted by
    the share at which they stop, the sources that stop are a prefix, so running sums find the level.
    """
    everything = Window.orderBy("none", "source")
    turn = (F.row_number().over(everything) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    full = F.col("source_size") * most
    ranked = sizes.withColumn("w", weight).withColumn("full", full)
    order = Window.orderBy((F.col("full") / F.col("w")), "none", "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    sums = ranked.select(
        "*",
        F.coalesce(F.sum("full").over(before), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("stopped_w"),
        F.sum("source_size").over(whole).alias("total"),
        F.sum("w").over(whole).alias("total_w"),
    ).select(
        "*", (F.col("total") - F.col("stopped")).alias("rest"),
        (F.col("total_w") - F.col("stopped_w")).alias("rest_w"),
    )
    stops = F.col("full") * F.col("rest_w") < F.col("rest") * F.col("w")
    level = F.min(F.when(~stops, F.struct(F.col("full") / F.col("w"), "none", "source", "rest", "rest_w")))
    found = sums.withColumn("stops", stops).withColumn("level", level.over(whole))
    share = F.col("level.rest") * F.col("w")
    target = F.when(F.col("stops"), F.col("full").cast("double")).otherwise(
        share.cast("double") / F.col("level.rest_w")
    )
    exact = F.when(F.col("stops"), F.col("full")).otherwise(F.expr("level.rest * w div level.rest_w"))
    return found.select("none", "source", "source_size", target.alias("target"),
                        exact.cast("long").alias("budget"))


def _levels(rows: int) -> int:
    levels = 1
    while rows > ROWS_PER_RANGE * FAN**levels:
        levels += 1
    return levels


def _cuts(light: DataFrame, work: Work, weights: tuple[int, ...], most: int) -> DataFrame:
    """Per source (none, source): source_size, target, epochs, and the cut of the last epoch: the place ``at``,
    how many equal rows stand there (n), and how many words they give (left).

    Prefix sums of the ranges lead down to the one range that holds the cut, digit by digit; only its
    rows are sorted, equal rows counted as one.
    """
    levels = _levels(light.count())
    names = [f"d{i}" for i in range(levels)]
    digits = [F.substring("place", 1 + i * DIGITS, DIGITS).alias(n) for i, n in enumerate(names)]
    light = light.select("none", "source", "size", "place", *digits)
    ranges = work.table(
        light.groupBy("none", "source", *names).agg(F.sum("size").alias("range_size")), "ranges"
    )
    sizes = ranges.groupBy("none", "source").agg(F.sum("range_size").alias("source_size"))
    totals = work.table(
        budgets(sizes, weights, most).withColumn(
            "epochs", F.expr("if(source_size = 0, 0, budget div source_size)")
        ), "budgets",
    )
    upper = ["none", "source"]
    down = totals.where("source_size > 0").select(*upper, F.expr("budget % source_size").alias("rest"))
    for here in names:
        sums = ranges.groupBy(*upper, here).agg(F.sum("range_size").alias("sum")).join(down, upper)
        before = Window.partitionBy(*upper).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        inside = sums.where("before <= rest and rest < before + sum")
        upper = [*upper, here]
        down = inside.select(*upper, (F.col("rest") - F.col("before")).alias("rest"))
    equal = light.join(down, upper).groupBy("none", "source", "rest", "place", "size").agg(
        F.count(F.lit(1)).alias("n")
    )
    before = Window.partitionBy("none", "source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    cut = equal.where("before <= rest and rest < before + n * size").select(
        "none", "source", F.col("place").alias("at"), "n", (F.col("rest") - F.col("before")).alias("left")
    )
    return work.table(totals.drop("budget").join(cut, ["none", "source"], "left"), "cuts")


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    placed = _placed(F.col(source_col), F.col(id_col), F.col(text_col), seed)
    return docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in placed.items()])


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """Per row: id, source, size, source_size, target, taken (words taken, repeats counted).

    A null or empty text has size 0 and gives nothing; a null source is a source, the last; ids of any
    type are taken, and rows without one have the key of their text. Ties of keys are sorted by a digest of source, id and
    text; rows equal in all three share what is taken of them in turn. Very long texts are counted whole, and taken in part only where
    the budget ends. No rows give no rows; other columns, whatever their names, are not looked at. Reruns
    agree, whatever the partitioning.
    """
    work = Work(docs.sparkSession, "mixing")
    light = work.table(_light(docs, id_col, text_col, source_col, seed), "sizes")
    rows = light.join(_cuts(light, work, weights, most), ["none", "source"])
    whole = rows.where("at is null or place != at").withColumn(
        "last", F.expr("if(place < at, size, cast(0 as bigint))")
    )
    cut = rows.where("place = at").groupBy(*[c for c in rows.columns if c not in ("place", "at")]).agg(
        F.count(F.lit(1)).alias("rows")
    )
    cut = cut.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn(
        "last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("turn") * F.col("size")))
    )
    out = whole.select("id", "none", "source", "size", "source_size", "target", "epochs", "last").unionByName(
        cut.select("id", "none", "source", "size", "source_size", "target", "epochs", "last")
    )
    taken = F.col("epochs") * F.col("size") + F.coalesce("last", F.lit(0))
    return out.select(
        "id", F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size",
        "target", taken.cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS,
                    seed: int = SEED) -> DataFrame:
    """The mix itself: a document is there once for each full epoch, and the one on the cut once more
    with its first words only, joined by single spaces.

    Documents without words stay as they are, since they cost no budget; null ids and sources, ties and
    very long texts are as in ``mix``. Of equal rows on the cut, one gives what the last epoch takes of them all.
    No rows give no rows. All columns are kept, whatever their names. Texts do not shuffle: each row is
    compared with its source's cut.
    """
    work = Work(docs.sparkSession, "mix")
    light = work.table(_light(docs, "doc_id", "text", "source", seed), "sizes")
    cuts = _cuts(light, work, weights, most)
    placed = _placed(F.col("source"), F.col("doc_id"), F.col("text"), seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, *[c.alias(n) for n, c in placed.items()]).join(cuts, ["none", "source"])
    full = F.expr("if(size = 0, 1, epochs + if(place < at, 1, 0))")
    each = rows.select(
        "row", F.coalesce(full, F.col("epochs")).cast("long").alias("full"),
        F.expr("if(size > 0 and place = at and n = 1, left, 0)").alias("part"),
    )
    listed = each
    if not cuts.where("n > 1 and left > 0").isEmpty():
        shared = rows.where("place = at and n > 1 and left > 0").groupBy("place", "size", "left").agg(
            F.first("row").alias("row")
        )
        listed = each.unionByName(shared.select(
            "row", F.expr("left div size").alias("full"), F.expr("left % size").alias("part")
        ))
    one = F.lit(1).cast("long")
    copies = F.col("full") + (F.coalesce("part", F.lit(0)) > 0).cast("long")
    listed = listed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(one, copies))))
    words = F.regexp_extract_all(whole_text(F.col("row.text")), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("part").cast("int"), F.lit(1))), " ")
    on_cut = F.col("copy") > F.col("full")
    shown = {"text": F.when(on_cut, cut).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(on_cut, F.length(cut).cast("long")).otherwise(F.col("row.n_chars"))
    return listed.select(*[shown.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
