"""Operator 9, mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of equal words.

Every source's documents are put in a shuffled order (by the md5 of their id) and cut into blocks of ``block`` words. The golden
ratio's points, mapped through the cumulative shares of the sources, say which source each slot of the schedule reads; the n-th slot
of a source reads its n-th block, from the start again once the source is used up. A source's last slot ends at its target.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
CELLS = 4096  # of the unit interval, to find a point's source by equality
CHUNK = 1 << 16  # slots ranked together
GOLDEN = 618033988749894848  # the golden ratio's fraction, times 10^18
UNIT = 10 ** 18


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: str) -> Column:
    """A source as a join key: never null, and a missing source is not an empty one."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source_size, target and number (by code point, a missing source last) of every source of (key, source_size).

    Sources share ``share`` of all words by weight; a target stops at ``most`` times its source, and the excess is shared again by
    weight. That ends at one level for all sources below their stop, found here by looking at sources in the order in which they
    reach it. A row per source meets in one task.
    """
    whole = Window.orderBy(F.col("key") == "", "key")
    rows = (sizes.withColumn("number", F.row_number().over(whole) - 1)
            .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
            .withColumn("stop", most * F.col("source_size")))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    every = by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(every) - (F.sum("stop").over(by_stop) - F.col("stop"))) / (
        F.sum("weight").over(every) - F.sum("weight").over(by_stop) + F.col("weight"))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by_stop))
    below = F.when(F.col("stop") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    return (rows.withColumn("level", F.min(below).over(every)["level"])
            .select("key", "source_size", "number",
                    F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("stop").cast("double")), F.col("stop").cast("double")).alias("target")))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, key, epoch, block, words: which block of which source each slot reads, and how many of its words."""
    plan = (sources.where("source_size > 0").withColumn("take", F.round("target").cast("long"))
            .withColumn("blocks", F.ceil(F.col("source_size") / block))
            .withColumn("epochs", F.expr("take div source_size")).withColumn("rest", F.col("take") % F.col("source_size"))
            .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block)))
    by_number = Window.orderBy("number")
    plan = written(plan.withColumn("upto", F.sum("slots").over(by_number)).withColumn("count", F.count("*").over(Window.partitionBy())), "mix-plan")
    total = plan.agg(F.max("upto")).first()[0] or 0
    cell = F.explode(F.sequence(F.floor((F.col("upto") - F.col("slots")) * CELLS / F.lit(max(total, 1))).cast("long"),
                                F.floor(F.col("upto") * CELLS / F.lit(max(total, 1))).cast("long")))
    spans = plan.where("slots > 0").select("key", "upto", "slots", cell.alias("cell"))
    point = F.expr(f"cast((cast(id AS decimal(19,0)) * {GOLDEN}bd) % {UNIT}bd AS double) / 1e18")
    points = plan.sparkSession.range(total).select(F.col("id").alias("slot"), (point * total).alias("at"))
    dealt = (points.withColumn("cell", F.floor(F.col("at") * CELLS / F.lit(max(total, 1))).cast("long")).join(spans, "cell")
             .where("at >= upto - slots AND at < upto").select("slot", "key", F.expr(f"slot div {CHUNK}").alias("chunk")))
    dealt = written(dealt, "mix-slots")
    chunks = dealt.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("chunk")) - F.col("n"))
    ranked = dealt.join(chunks, ["key", "chunk"]).select(
        "key", "slot", (F.col("before") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1).alias("rank"))
    have = chunks.groupBy("key").agg(F.sum("n").alias("have"))
    short = (plan.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
             .select("key", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"), "have", "number", "count")
             .select("key", (total + (F.col("rank") - F.col("have")) * F.col("count") + F.col("number")).alias("slot"), "rank"))
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block,
                    F.when(F.col("epoch") < F.col("epochs"), F.lit(block)).otherwise(F.col("rest") - F.col("block") * block))
    return (ranked.unionByName(short).join(plan, "key").where("rank < slots")
            .withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.col("rank") % F.col("blocks"))
            .select("slot", "key", "epoch", "block", words.alias("words")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK) -> DataFrame:
    """doc_id, size (words), source_size, target and taken (words the mix takes, repeats counted) of every row.

    A null or empty text has size 0 and takes nothing; a missing source is a source of its own, the last; a null doc_id is kept.
    Rows that share doc_id, source and size are placed one after the other, so their order does not matter; ids decide the shuffle
    and reruns agree. Other columns are not read; an empty table gives an empty result. Positions in a source are sums within md5
    prefixes and then over prefixes, and slots are ranked by chunks, so no source meets in one task.
    """
    rows = docs.select(_source_key("source").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("size"))
    groups = rows.groupBy("key", "doc_id", "size").agg(F.count("*").alias("n"))
    order = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    groups = written(groups.withColumn("order", order).withColumn("prefix", F.substring("order", 1, 3)), "mix-documents")
    prefixes = groups.groupBy("key", "prefix").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    sources = written(targets(prefixes.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")
    prefixes = (prefixes.withColumn("before", F.sum("words").over(Window.partitionBy("key").orderBy("prefix")) - F.col("words"))
                .join(sources, "key").select("key", "prefix", "before", "source_size", "target"))
    inside = Window.partitionBy("key", "prefix").orderBy("order", "doc_id", "size")
    placed = (groups.join(prefixes, ["key", "prefix"])
              .withColumn("start", F.col("before") + F.sum(F.col("size") * F.col("n")).over(inside) - F.col("size") * F.col("n"))
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
              .withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
              .select("key", "doc_id", "size", "source_size", "target", "copy", "start", (F.col("start") + F.col("size")).alias("end")))
    cut = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(end - 1) div {block}")))
    pieces = placed.withColumn("block", F.explode_outer(cut))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("end") - F.col("block") * block, F.lit(block))
    reads = schedule(sources, block).groupBy("key", "block", "words").agg(F.count("*").alias("n"))
    reads = reads.groupBy("key", "block").agg(F.collect_list(F.struct("words", "n")).alias("reads"))  # whole, and at most one that ends early
    reads = written(reads, "mix-reads")  # apart from the documents: one plan of both takes the driver much memory
    taken = F.aggregate("reads", F.lit(0).cast("long"),
                        lambda a, r: a + r["n"] * F.greatest(F.lit(0), F.least(r["words"], F.col("high")) - F.col("low")))
    return (pieces.withColumn("low", low).withColumn("high", high).join(reads, ["key", "block"], "left")
            .withColumn("taken", F.coalesce(taken, F.lit(0)))
            .groupBy("key", "doc_id", "size", "copy", "source_size", "target").agg(F.sum("taken").cast("long").alias("taken"))
            .select("key", "doc_id", "size", "source_size", "target", "taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes its words, to the nearest whole number of times.

    Only where a source's target ends is a document taken in part, so rounding moves one document of a source. Rows that share doc_id,
    source and size are taken equally often. Rows without words are not taken.
    """
    key = F.struct(_source_key("source").alias("a"), F.col("doc_id").cast("long").alias("b"), n_words("text").alias("c"))
    taken = mixed(docs, **options).where("size > 0").groupBy(F.struct(F.col("key").alias("a"), F.col("doc_id").alias("b"), F.col("size").alias("c")).alias("mix_key"))
    taken = written(taken.agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("times")).where("times > 0"), "mix-times")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("mix_key"))
    return rows.join(taken.hint("merge"), "mix_key").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - (sum(cap) OVER o - cap)) / ((SELECT sum(weight) FROM w) - sum(weight) OVER o + weight) AS lvl,
  row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min_by(lvl, place) AS lvl FROM l WHERE cap > lvl * weight),
t AS (SELECT l.source, source_size, coalesce(least(f.lvl * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS take,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
    ROWS UNBOUNDED PRECEDING) - d.size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE take // source_size * size
  + greatest(0, least(size, take % source_size - start)) END AS BIGINT) AS taken FROM p"""
