"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

Each source gets a target number of words; its documents then all have the same
fractional number of copies. The whole part is taken; the fraction is rounded by
the pivotal method: two documents of like size play for their fractions, the one
takes as much of the other's as makes one of the two whole. Documents meet in
blocks, what a block leaves over meets the leavings of ``FAN`` blocks, and so on up
a tree, so the sum of copies is kept to the last step and no group is ever large.

Defined cases: a null text has size 0; a null source is a source of its own, the last
in order; rows equal in id, source and size form one unit whose copies are spread over
its rows; null ids are allowed; no words at all give targets of 0; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, partitions, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Documents or leavings that meet in one block.
FAN = 64
_UNIT = "struct<doc_id:bigint,size:bigint,p:double>"


def sized(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id, source, size, rows``: words per document, one row for rows alike."""
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))


def ranked_sources(units: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, units, weight``; weights go round by code point order, null last.

    Places are counted per range of sources and the ranges' totals added up, so that
    even very many sources are never in one task.
    """
    spark = units.sparkSession
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    last = F.col("source").isNull()
    spread = sums.repartitionByRange(partitions(spark), last, "source").withColumn("range", F.spark_partition_id())
    spread = stored(spread, "sources")
    totals = spread.groupBy("range").count()  # one row per partition
    before = totals.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(last, "source")) - 1 + F.col("before")
    rest = F.pmod(place, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), rest + 1).cast("double")
    return spread.join(before, "range").select("source", "source_size", "units", weight.alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight; no source gets above ``most`` times its size, the excess is shared again.

    Each round brings two sums to the driver and fixes the sources that were above; it ends when none is.
    """
    sources = stored(sources, "weighted")
    cap = F.col("source_size") * most
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t * share
    level = -1.0
    while True:
        full = (cap <= F.col("weight") * level) if level >= 0 else F.lit(False)
        held, weight = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / weight if weight else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * max(level, 0.0)))


def _chance(*parts: Column) -> Column:
    """A number below 1 drawn from the values given."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def _play(units: Column, level: int, seed: int) -> Column:
    """Pivotal rounding down a sorted array of units: those decided, and the one left with a fraction."""
    nobody = F.lit(None).cast(_UNIT)

    def step(state: Column, new: Column) -> Column:
        old = state["left"]
        both = old["p"] + new["p"]
        draw = _chance(F.lit(seed), F.lit(level), old["doc_id"], old["size"], new["doc_id"], new["size"])
        # both below 1: one takes all; else one is filled up and the other keeps the rest
        first = F.when(both < 1, draw * both < old["p"]).otherwise(draw * (2 - both) < 1 - new["p"])

        def with_p(unit: Column, p: Column) -> Column:
            return F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), p.alias("p"))

        small = both < 1
        done = F.when(small & first, with_p(new, F.lit(0.0))).when(small, with_p(old, F.lit(0.0))).when(first, with_p(old, F.lit(1.0))).otherwise(with_p(new, F.lit(1.0)))
        left = F.when(small & first, with_p(old, both)).when(small, with_p(new, both)).when(first, with_p(new, both - 1)).otherwise(with_p(old, both - 1))
        start = old.isNull()
        return F.struct(
            F.when(start, state["done"]).otherwise(F.concat(state["done"], F.array(done))).alias("done"),
            F.when(start, with_p(new, new["p"])).otherwise(left).alias("left"),
        )

    start = F.struct(F.array().cast(f"array<{_UNIT}>").alias("done"), nobody.alias("left"))
    return F.aggregate(units, start, step)


def rounded(parts: DataFrame, seed: int = 0) -> DataFrame:
    """``source, doc_id, size, up`` for ``parts`` (source, doc_id, size, p, units): whether a fraction becomes one."""
    largest = parts.agg(F.max("units")).first()[0] or 0
    blocks = F.ceil(F.col("units") / float(FAN)).cast("long")
    hashed = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), blocks)
    level, waiting, decided = 0, parts.select("source", "doc_id", "size", "p", hashed.alias("block")), []
    for level in range(max(1, math.ceil(math.log(max(largest, 2), FAN)) + 1)):
        # like sizes meet; the hash decides among equal ones
        order = F.struct(F.col("size"), F.xxhash64("doc_id", F.lit(seed + 1)).alias("h"), F.col("doc_id"), F.col("p"))
        groups = waiting.groupBy("source", "block").agg(F.array_sort(F.collect_list(order)).alias("units"))
        units = F.transform("units", lambda u: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["p"].alias("p")))
        played = stored(groups.select("source", "block", _play(units, level, seed).alias("r")), f"level{level}")
        decided.append(played.select("source", F.explode("r.done").alias("u")))
        waiting = played.select("source", F.col("r.left.doc_id").alias("doc_id"), F.col("r.left.size").alias("size"), F.col("r.left.p").alias("p"), F.floor(F.col("block") / FAN).alias("block"))
    up = [d.select("source", "u.doc_id", "u.size", (F.col("u.p") > 0.5).alias("up")) for d in decided]
    draw = _chance(F.lit(seed), F.lit(-1), F.col("source"), F.col("doc_id"), F.col("size"))
    out = waiting.select("source", "doc_id", "size", (draw < F.col("p")).alias("up"))
    for d in up:
        out = out.union(d)
    return out


def mixed(docs: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """``doc_id, source, size, rows, source_size, target, copies, more``: of a unit's rows, ``more`` are taken ``copies + 1`` times, the others ``copies`` times."""
    units = stored(sized(docs, **columns), "units")
    by_source = stored(targets(ranked_sources(units)), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = by_source.withColumnRenamed("source", "of")
    known = units.join(of, units.source.eqNullSafe(of.of)).drop("of").withColumn("share", share)
    # a unit of n rows: n times the share, whole copies for each row, whole rows with one more, and a fraction to play for
    extra = F.col("rows") * (F.col("share") - F.floor("share"))
    known = stored(known.withColumns({"copies": F.floor("share"), "sure": F.floor(extra), "p": extra - F.floor(extra)}), "known")
    played = rounded(known.filter("p > 0").select("source", "doc_id", "size", "p", "units"), seed)
    a, b = known.alias("a"), played.alias("b")
    match = F.expr("a.source <=> b.source and a.doc_id <=> b.doc_id and a.size = b.size")
    return a.join(b, match, "left").select(
        "a.doc_id", "a.source", "a.size", "a.rows", "a.source_size", "a.target", "a.copies",
        (F.col("a.sure") + F.coalesce(F.col("b.up"), F.lit(False)).cast("long")).alias("more"),
    )


def taken(docs: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per document; ``taken`` counts words, repeats included."""
    units = mixed(docs, seed, **columns).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("copies") + (F.col("nth") <= F.col("more")).cast("long")
    return units.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def repeat_rows(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` mixed: rows are left out, stay, or are repeated. Columns as in ``docs``."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    a = docs.withColumn("flowlens_size", size).alias("a")
    b = mixed(docs, seed).alias("b")
    match = F.expr("a.doc_id <=> b.doc_id and a.source <=> b.source and a.flowlens_size = b.size")
    joined = a.join(b, match).select("a.*", F.col("b.rows").alias("flowlens_rows"), F.col("b.copies").alias("flowlens_copies"), F.col("b.more").alias("flowlens_more"))
    single = joined.filter("flowlens_rows = 1").withColumn("flowlens_nth", F.lit(1))
    # rows alike are numbered; after exact dedup there are none
    key = Window.partitionBy("doc_id", "source", "flowlens_size").orderBy("text", F.to_json(F.struct(*docs.columns)))
    several = joined.filter("flowlens_rows > 1").withColumn("flowlens_nth", F.row_number().over(key))
    copies = (F.col("flowlens_copies") + (F.col("flowlens_nth") <= F.col("flowlens_more")).cast("long")).cast("int")
    each = single.union(several).withColumn("flowlens_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return each.select(*docs.columns)
