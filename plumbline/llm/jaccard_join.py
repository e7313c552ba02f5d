"""Operator 3, n-gram Jaccard join by vertical partitioning.

Texts with the same set of n-grams form a class, and classes are compared. In a global order of n-grams, two sets as similar as asked
share one of the first few n-grams of each: the prefix. A first order goes by hash, but for a fifth of all hashes by how many classes
hold the n-gram, the rarest first; it chooses the classes that can be linked at all. A second order goes by how many of the chosen
classes hold the n-gram, and gives the pairs. The n-grams are cut into fragments by ranges of their hash; the overlap of a
candidate pair is counted in each fragment on its own and summed per pair; the first fragments already end most pairs that share little.

A group of many near copies is not expanded into all pairs. Each prefix n-gram's classes are first compared with two of them, the
one that has it earliest and the last one, and the links found are joined into components; then only classes that share a prefix
n-gram and still lie in different components are compared. That finds the same components as comparing all pairs.

Joins of tables that grow alike, on keys that stand once, say that they merge: broadcast while they are small, each would build a map on the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffles_removed, written
from .components import components, drop
from .line_dedup import LOWER, UPPER
from .quality_rules import SPACE, words_of

REGION = -(1 << 63) + (1 << 64) // 5  # hashes below are counted
FRAGMENT_BITS = 3
FIRST = 2  # fragments that are counted before the others


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, same (hash of the text) and grams, the sorted distinct hashes of the ``width``-word sequences of every row.

    With fewer words the whole sequence is the only one; without words there is none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", UPPER, LOWER))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
            .withColumn("same", F.xxhash64("text")).withColumn("text", lower).withColumn("words", words_of("text")).drop("text")
            .withColumn("n", F.size("words")))
    every = F.transform(F.sequence(F.lit(0), F.col("n") - width), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]))
    few = F.array(F.xxhash64(F.col("words")))
    grams = F.when(F.col("n") >= width, every).when(F.col("n") > 0, few).otherwise(F.array().cast("array<bigint>"))
    return rows.select("doc_id", "same", F.sort_array(F.array_distinct(grams)).alias("grams"))


def _prefix(n: Column, percent: int) -> Column:
    """How many of a set's first n-grams hold one that is shared with any set as similar as ``percent``."""
    return n - F.ceil(n * percent / 100) + 1


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y) of rows (cid, n, pos, other, m, at) that can be similar, once. Both hold an n-gram, at ``pos`` and ``at`` of their orders.

    The sizes must allow it, and so must what is left of both from their first shared n-gram on.
    """
    fit = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("cid") != F.col("other"))
    rest = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return rows.where(fit & rest).select(F.least("cid", "other").alias("x"), F.greatest("cid", "other").alias("y")).distinct()


def _held(grams: DataFrame) -> DataFrame:
    """gram, df of the n-grams that several sets hold. Written, so that the shuffle that counts them is gone before the next one."""
    return written(grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1"), "ngram-held")


def _entries(grams: DataFrame, held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """cid, n, gram, pos of the prefix n-grams that several sets share, with two of their holders: ``plain`` and ``last``.

    ``grams`` holds the n-grams whose holders are counted, ``held`` those that several sets hold, and ``sizes`` (cid, n, known, more) how
    many a set has of them and the n-grams that follow them in its prefix. Counted ones go first, the rarest before the others, so those that one set alone holds use the
    prefix up first. The smaller set of a pair shares an n-gram within a shorter prefix, so an n-gram that nobody has there finds nothing.
    """
    p = _prefix(F.col("n"), percent)
    shared = grams.join(held, "gram").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    rows = sizes.join(shared, "cid", "left").withColumn("alone", F.col("known") - F.coalesce(F.size("shared"), F.lit(0)))
    first = F.transform(F.slice("shared", 1, F.greatest(p - F.col("alone"), F.lit(0)).cast("int")), lambda s: s["gram"])
    rows = rows.withColumn("first", F.coalesce(first, F.array().cast("array<bigint>")))
    rows = rows.select("cid", "n", "alone", "known", F.size("first").alias("k"), F.posexplode(F.concat("first", "more")).alias("at", "gram"))
    at = F.when(F.col("at") < F.col("k"), F.col("alone") + F.col("at")).otherwise(F.col("known") + F.col("at") - F.col("k"))
    rows = rows.select("cid", "n", "gram", at.alias("pos"))
    early = (F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")
    several = rows.groupBy("gram").agg(
        F.count("*").alias("holders"), F.min(F.when(early, F.struct("pos", "cid", "n"))).alias("plain"),
        F.max(F.when(early, F.struct("cid", "n", "pos"))).alias("last")).where("holders > 1 AND plain IS NOT NULL")
    return rows.join(several.drop("holders"), "gram")


def _shared(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """x, y and shared: the n-grams that pairs share in the given segments, counted by fragment and summed. Pairs that share none are left out."""
    left = segments.select(F.col("cid").alias("x"), "fragment", F.col("part").alias("a"))
    right = segments.select(F.col("cid").alias("y"), "fragment", F.col("part").alias("b"))
    return (pairs.join(left, "x").join(right, ["y", "fragment"]).select("x", "y", F.size(F.array_intersect("a", "b")).alias("shared"))
            .groupBy("x", "y").agg(F.sum("shared").alias("shared")))


def _linked(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs of (x, y) similar enough: overlaps are counted by fragment and summed.

    ``sizes`` holds n and head, a set's n-grams in the first fragments. These are counted first. Where the sum would not do
    even if all the other n-grams of the smaller rest were shared, the pair does not meet the other fragments.
    """
    def enough(shared: Column) -> Column:
        return shared * 100 >= (F.col("nx") + F.col("ny") - shared) * percent

    sized = pairs.join(sizes.toDF("x", "nx", "hx"), "x").join(sizes.toDF("y", "ny", "hy"), "y")
    first = F.col("fragment") < FIRST
    sized = sized.join(_shared(pairs, segments.where(first)).hint("merge"), ["x", "y"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    remaining = written(sized.where(enough(F.col("shared") + F.least(F.col("nx") - F.col("hx"), F.col("ny") - F.col("hy")))), "ngram-open")
    rest = _shared(remaining.select("x", "y"), segments.where(~first)).withColumnRenamed("shared", "more")
    links = written(remaining.join(rest.hint("merge"), ["x", "y"], "left").where(enough(F.col("shared") + F.coalesce("more", F.lit(0)))).select("x", "y"), "ngram-links")
    drop(remaining)
    return links


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, same (xxhash64 of the text), n_shingles, component (a number; null without words) and component_id of every row.

    Documents link when 100 * shared >= ``percent`` * all of their n-grams, so copies, and rows that are repeated, always link.
    component_id is the smallest doc_id reachable, the row's own included; a null doc_id is no candidate for it unless all of the
    component are null. A null or empty text has no n-grams, links with nothing and keeps its own doc_id. An empty table gives an
    empty one, and other columns are not read.
    """
    with shuffles_removed(docs.sparkSession):
        return _classes(docs, width, percent)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    p = _prefix(F.col("n"), percent)
    c1, c2 = F.xxhash64("grams"), F.xxhash64(F.lit(3), F.col("grams"))
    rows = (_sets(docs, width).withColumn("n", F.size("grams"))
            .withColumn("counted", F.filter("grams", lambda g: g < F.lit(REGION)))
            .withColumn("more", F.greatest(p - F.size("counted"), F.lit(0)).cast("int")))
    words = F.col("n") > 0
    table = written(rows.select("doc_id", "same", "n", F.when(words, c1).alias("c1"), F.when(words, c2).alias("c2"),
                                F.monotonically_increasing_id().alias("cid"), "counted",
                                F.slice("grams", F.size("counted") + 1, F.col("more")).alias("more")), "ngram-sets")
    classes = written(table.where("n > 0").groupBy("c1", "c2").agg(F.min("cid").alias("cid"), F.min("doc_id").alias("least_doc"), F.min("n").alias("n")),
                      "ngram-classes")
    # sets too small to lack one n-gram of a set one larger link only when equal; a set that can link with a smaller one passes too
    able = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).select("cid")
    heads = table.join(able, "cid", "left_semi")
    grams = heads.select("cid", F.explode("counted").alias("gram"))
    sizes = heads.select("cid", "n", F.size("counted").alias("known"), "more")
    held = _held(grams)
    chosen = written(_entries(grams, held, sizes, percent).select("cid", "n").distinct(), "ngram-chosen")
    drop(held)
    # one row of each chosen class is read again, by its doc_id and text
    key = [F.xxhash64("doc_id", "same").alias("k1"), F.xxhash64(F.lit(3), F.col("doc_id"), F.col("same")).alias("k2")]
    wanted = table.select("cid", "doc_id", "same").join(chosen.select("cid"), "cid", "left_semi").select("cid", *key)
    texts = _text(docs).withColumn("same", F.xxhash64("text")).select("text", *key).join(wanted, ["k1", "k2"])
    texts = texts.groupBy("k1", "k2").agg(F.first("cid").alias("doc_id"), F.first("text").alias("text"))
    fragment = F.explode(F.transform(F.sequence(F.lit(0), F.lit((1 << FRAGMENT_BITS) - 1)), lambda f: F.struct(
        f.alias("fragment"), F.filter("grams", lambda g: F.shiftright(g, 64 - FRAGMENT_BITS) + (1 << FRAGMENT_BITS - 1) == f).alias("part"))))
    segments = written(_sets(texts, width).select(F.col("doc_id").alias("cid"), fragment.alias("s")).select("cid", "s.fragment", "s.part")
                       .where(F.size("part") > 0), "ngram-segments")
    first = segments.where(F.col("fragment") < FIRST).groupBy("cid").agg(F.sum(F.size("part")).alias("head"))
    sized = written(chosen.join(first, "cid", "left").select("cid", "n", F.coalesce("head", F.lit(0)).alias("head")), "ngram-sizes")
    none = F.array().cast("array<bigint>")
    grams = segments.select("cid", F.explode("part").alias("gram"))
    held = _held(grams)
    entries = written(_entries(grams, held, chosen.select("cid", "n", F.col("n").alias("known"), none.alias("more")), percent), "ngram-prefixes")
    drop(held)
    pivots = F.explode(F.array(*[F.struct(F.col(f"{p}.cid").alias("other"), F.col(f"{p}.n").alias("m"), F.col(f"{p}.pos").alias("at")) for p in ("plain", "last")]))
    pairs = written(_pairs(entries.select("cid", "n", "pos", pivots.alias("p")).select("cid", "n", "pos", "p.*"), percent), "ngram-pairs")
    links = _linked(pairs, segments, sized, percent)
    labels = components(links)
    marked = entries.select("cid", "n", "pos", "gram").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    counted = marked.groupBy("gram", "component").agg(F.count("*").alias("k"))
    mixed = counted.groupBy("gram").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    marked = written(marked.join(mixed, "gram").select("gram", "cid", "n", "pos", "component", (F.col("component") != F.col("main")).alias("apart")), "ngram-mixed")
    apart = marked.where("apart").select("gram", F.col("cid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("component").alias("others"))
    rest = written(_pairs(marked.join(apart, "gram").where("component <> others"), percent).join(pairs.hint("merge"), ["x", "y"], "left_anti"), "ngram-pairs")
    if not rest.isEmpty():  # else no link is missing, and the labels stand
        more = _linked(rest, segments, sized, percent)
        labels = components(links.unionByName(more))
        drop(more)
    drop(segments, sized, entries, pairs, rest, marked, chosen, links)  # labels are written; nothing below reads these
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    named = named.join(least, "component").select("c1", "c2", "component", "component_id")
    return (table.select("doc_id", "same", F.col("n").cast("long").alias("n_shingles"), "c1", "c2").join(named, ["c1", "c2"], "left")
            .select("doc_id", "same", "n_shingles", "component",
                    F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each component: the smallest doc_id, of rows that share it the smallest text hash; null ids come last.

    Rows without words link with nothing and all stay. Rows equal in doc_id and text are one document, and one row of it stays.
    """
    def key(doc_id: str, same: Column) -> Column:
        return F.struct(F.col(doc_id).cast("long").isNull().alias("a"), F.col(doc_id).cast("long").alias("b"), same.alias("c"))

    with shuffles_removed(docs.sparkSession):  # written, so that what names components is planned and run once
        found = written(_classes(docs, width, percent).select("doc_id", "same", "component"), "ngram-found")
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min(key("doc_id", F.col("same"))).alias("kept_key"))
    best = best.select("kept_key").unionByName(found.where("component IS NULL").select(key("doc_id", F.col("same")).alias("kept_key")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       key("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("kept_key"),
                       (F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE)) == "").alias("blank"))
    first = F.row_number().over(Window.partitionBy("kept_key").orderBy("kept_key"))
    kept = rows.join(best.hint("merge"), "kept_key", "left_semi").withColumn("first", first).where((F.col("first") == 1) | F.col("blank"))
    return kept.select("row.*")


# Words are split and compared as text, all pairs that share a sequence are counted, and components grow by recursion.
JACCARD_SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM t),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY 1, 2 HAVING count(*) * 100 >= 90 * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT doc_id AS start, doc_id AS reached FROM s UNION SELECT r.start, l.y FROM r JOIN l ON r.reached = l.x)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT start, min(reached) AS component_id FROM r GROUP BY 1) c ON s.doc_id = c.start"""
