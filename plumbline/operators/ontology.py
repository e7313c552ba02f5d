"""Taxonomy, placement of assets on pages, glossary, and the lookup of business terms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few_or_merged, written
from .textjoin import contains_pairs

HIT = ("match_type", "matched", "definition", "domain", "subdomain", "page", "page_name", "object_full_name",
       "object_kind", "field")


# ---------------------------------------------------------------- taxonomy
def nodes(domains: DataFrame, subdomains: DataFrame, pages: DataFrame) -> DataFrame:
    """Domain, subdomain and page nodes with parent and ``A > B > C`` path.

    ``domains``: id, name. ``subdomains``: id, domain, name. ``pages``: id, subdomain, name. Other columns
    (description, owner) are kept when present on all three.
    """
    extra = [c for c in domains.columns if c not in ("id", "name") and c in subdomains.columns and c in pages.columns]
    nothing = F.lit(None).cast("string")

    def node(df, kind, parent, domain, subdomain, path):
        return df.select(F.col("id").alias("node_id"), F.lit(kind).alias("node_type"), parent.alias("parent_id"),
                         domain.alias("domain_id"), subdomain.alias("subdomain_id"), F.col("name"), *extra, path.alias("path"))

    names = domains.select(F.col("id").alias("domain"), F.col("name").alias("_domain"))
    subs = subdomains.join(names, "domain")
    above = subs.select(F.col("id").alias("subdomain"), "domain", "_domain", F.col("name").alias("_subdomain"))
    leaves = pages.join(above, "subdomain")
    return (node(domains, "domain", nothing, F.col("id"), nothing, F.col("name"))
            .unionByName(node(subs, "subdomain", F.col("domain"), F.col("domain"), F.col("id"),
                              F.concat_ws(" > ", "_domain", "name")))
            .unionByName(node(leaves, "page", F.col("subdomain"), F.col("domain"), F.col("subdomain"),
                              F.concat_ws(" > ", "_domain", "_subdomain", "name"))))


def place(assets: DataFrame, pins: DataFrame, kept: DataFrame, claims: DataFrame) -> DataFrame:
    """asset, page, source, confidence, candidates: one page per asset.

    A pin wins, then the page kept from the certified model, then the page claimed when claims name only one; with
    several or none the asset is pending. ``pins``: asset, page. ``kept`` and ``claims``: asset, page, confidence.
    """
    best = claims.groupBy("asset", "page").agg(F.max("confidence").alias("confidence"))
    one = best.groupBy("asset").agg(F.count(F.lit(1)).alias("candidates"),
                                    F.max_by(F.struct("page", "confidence"), F.struct("confidence", "page")).alias("claim"))
    pinned = pins.groupBy("asset").agg(F.min("page").alias("pin"))
    held = kept.groupBy("asset").agg(F.max_by(F.struct("page", "confidence"), F.struct("confidence", "page")).alias("old"))
    joined = (assets.select("asset").distinct().join(pinned, "asset", "left").join(held, "asset", "left")
              .join(one, "asset", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("bigint"))))
    single = F.col("candidates") == 1
    source = (F.when(F.col("pin").isNotNull(), "user").when(F.col("old").isNotNull(), "certified")
              .when(single, "agent").otherwise("pending"))
    page = (F.when(source == "user", F.col("pin")).when(source == "certified", F.col("old.page"))
            .when(source == "agent", F.col("claim.page")))
    confidence = (F.when(source == "user", F.lit(1.0)).when(source == "certified", F.col("old.confidence"))
                  .when(source == "agent", F.col("claim.confidence")))
    return joined.select("asset", page.alias("page"), source.alias("source"), confidence.cast("double").alias("confidence"), "candidates")


def placement_problems(assets: DataFrame, placed: DataFrame, pages: DataFrame) -> DataFrame:
    """asset, problem: unplaced, out of scope, on more than one page, or on a page with another path.

    ``assets``: asset. ``placed``: asset, page, subdomain, domain. ``pages``: page, subdomain, domain.
    """
    true_path = pages.select("page", F.col("subdomain").alias("_s"), F.col("domain").alias("_d"))
    wrong = (F.col("_s").isNull() | ~F.col("subdomain").eqNullSafe(F.col("_s")) | ~F.col("domain").eqNullSafe(F.col("_d")))
    held = (placed.join(true_path, "page", "left")
            .groupBy("asset").agg(F.count(F.lit(1)).alias("pages"), F.count_if(wrong).alias("wrong")))
    scope = assets.select("asset").distinct().withColumn("_known", F.lit(True))
    both = scope.unionByName(held, allowMissingColumns=True).groupBy("asset").agg(
        F.max("_known").alias("known"), F.max("pages").alias("pages"), F.max("wrong").alias("wrong"))
    problem = (F.when(F.col("pages").isNull(), "unplaced").when(F.col("known").isNull(), "out of scope")
               .when(F.col("pages") > 1, "on more than one page").when(F.col("wrong") > 0, "wrong path"))
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("asset", "problem")


def empty_pages(pages: DataFrame, placed: DataFrame) -> DataFrame:
    return pages.select("page").join(placed.select("page"), "page", "left_anti")


def low_confidence(placed: DataFrame, floor: float = 0.6) -> DataFrame:
    """Placements an agent made below the floor; no confidence counts as none."""
    return placed.where((F.col("source") == "agent") & (F.coalesce("confidence", F.lit(0.0)) < floor))


# ---------------------------------------------------------------- glossary
def merge_glossary(user: DataFrame, measures: DataFrame, placed: DataFrame) -> DataFrame:
    """The glossary table: term, definition, synonyms, page_id, linked_object, linked_field, source, one row per link.

    ``user``: term, definition, synonyms, links (array of struct object, field). ``measures``: view, measure,
    display_name, comment, synonyms. Names are compared without case. A user term keeps its definition and synonyms; the
    links of both are united, a term without any keeps one row. Synonyms of measures that share a name are united. The
    page is that of the first link that is placed, the user's links first.
    """
    name = F.coalesce("display_name", "measure")
    link = F.struct(F.col("view").alias("object"), F.col("measure").alias("field"))
    auto = measures.select(F.lower(name).alias("key"), name.alias("term"), F.coalesce("comment", name).alias("definition"),
                           F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), link.alias("link"))
    heads = auto.groupBy("key").agg(F.min_by(F.struct("term", "definition"), F.struct("link", "term")).alias("head"))
    # Words are made distinct before they are gathered: what is gathered are the synonyms of one name, as people wrote them.
    words = (auto.select("key", F.explode("synonyms").alias("word")).distinct()
             .groupBy("key").agg(F.array_sort(F.collect_list("word")).alias("words")))
    mine = user.select(F.lower("term").alias("key"), F.struct("term", "definition", "synonyms").alias("own"))
    declared = F.col("own").isNotNull()
    terms = heads.join(words, "key", "left").join(mine, "key", "full_outer").select(
        "key", F.when(declared, F.col("own.term")).otherwise(F.col("head.term")).alias("term"),
        F.when(declared, F.col("own.definition")).otherwise(F.col("head.definition")).alias("definition"),
        F.coalesce(F.when(declared, F.col("own.synonyms")).otherwise(F.col("words")), F.array().cast("array<string>")).alias("synonyms"),
        F.when(declared, "user").otherwise("metric_view").alias("source"))
    # Links stay rows; a link both sides have counts at its place among the user's.
    given = user.select(F.lower("term").alias("key"), F.posexplode("links").alias("at", "link"))
    links = (given.select("key", "link", F.struct(F.lit(0).alias("rank"), "at").alias("order"))
             .unionByName(auto.select("key", "link", F.struct(F.lit(1).alias("rank"), F.lit(0).alias("at")).alias("order")))
             .groupBy("key", "link").agg(F.min("order").alias("order")))
    homes = (links.select("key", "order", "link", F.col("link.object").alias("asset"))
             .join(placed.select("asset", "page"), "asset").groupBy("key").agg(F.min_by("page", F.struct("order", "link")).alias("page_id")))
    return (terms.join(homes, "key", "left").join(links.select("key", "link"), "key", "left")
            .select("term", "definition", "synonyms", "page_id", F.col("link.object").alias("linked_object"),
                    F.col("link.field").alias("linked_field"), "source"))


def explode_links(glossary: DataFrame) -> DataFrame:
    """One row per link; a term without links keeps one row with nulls."""
    return (glossary.withColumn("_link", F.explode_outer("links"))
            .select("term", "definition", "synonyms", F.col("page").alias("page_id"), F.col("_link.object").alias("linked_object"),
                    F.col("_link.field").alias("linked_field"), "source"))


def one_definition(glossary_rows: DataFrame) -> DataFrame:
    """term, definition, page_id: one per term, the smallest link deciding which row speaks for it."""
    order = F.struct(F.coalesce("linked_object", F.lit("")), F.coalesce("linked_field", F.lit("")), F.col("definition"))
    return glossary_rows.groupBy("term").agg(F.min_by(F.struct("definition", "page_id"), order).alias("r")).select("term", "r.*")


# ---------------------------------------------------------------- lookup
def _hits_glossary(glossary: DataFrame, exact: Column) -> DataFrame:
    return glossary.select("term_id", F.when(exact, 1).otherwise(3).alias("rank"), F.lit("glossary").alias("match_type"),
                           F.col("term").alias("matched"), "definition", F.col("page_id").alias("page"),
                           F.col("linked_object").alias("object_full_name"), F.col("linked_field").alias("field"))


def _members(objects: DataFrame) -> DataFrame:
    """node_id of every object's page, subdomain and domain, so that belonging is an equi join."""
    return objects.select(F.explode(F.array_distinct(F.array("page_id", "subdomain_id", "domain_id"))).alias("node_id"),
                          "page_id", "object_full_name")


def _placed(hits: DataFrame, nodes_: DataFrame, objects: DataFrame) -> DataFrame:
    pages = (nodes_.where(F.col("node_type") == "page")
             .select(F.col("node_id").alias("page"), F.col("domain_id").alias("domain"), F.col("subdomain_id").alias("subdomain"),
                     F.col("name").alias("page_name")))
    kinds = objects.select("object_full_name", "object_kind")
    return (hits.join(few_or_merged(pages), "page", "left").join(kinds.hint("merge"), "object_full_name", "left")
            .select("term_id", "rank", *HIT))


def lookup(spark: SparkSession, term: str, nodes_: DataFrame, objects: DataFrame, glossary: DataFrame) -> DataFrame:
    """What one business term means and where it lives: rank and the columns of :data:`HIT`.

    Rank 1 exact term, synonym or node; 2 exact object; 3 part of a term, synonym or node name; 4 part of an object
    name. A blank term finds nothing. ``%`` and ``_`` in the term are plain characters.
    """
    t = term.strip().lower()
    if not t:
        t_filter = F.lit(False)
        t = ""
    else:
        t_filter = F.lit(True)
    needle = F.lit(t)
    word = F.lower("term")
    syns = F.coalesce("synonyms", F.array().cast("array<string>"))
    g = glossary.where(t_filter & (word.contains(needle) | F.exists(syns, lambda s: F.lower(s).contains(needle)))).withColumn("term_id", needle)
    from_terms = _hits_glossary(g, (word == needle) | F.exists(syns, lambda s: F.lower(s) == needle))
    name = F.lower("name")
    n = nodes_.where(t_filter & (name.contains(needle) | (F.col("node_id") == needle)))
    from_nodes = n.join(_members(objects), "node_id").select(
        needle.alias("term_id"), F.when((name == needle) | (F.col("node_id") == needle), 1).otherwise(3).alias("rank"),
        F.col("node_type").alias("match_type"), F.col("name").alias("matched"),
        _described(nodes_).alias("definition"), F.col("page_id").alias("page"), "object_full_name", F.lit(None).cast("string").alias("field"))
    short = F.lower(F.substring_index("object_full_name", ".", -1))
    from_objects = objects.where(t_filter & short.contains(needle)).select(
        needle.alias("term_id"), F.when(short == needle, 2).otherwise(4).alias("rank"), F.lit("object").alias("match_type"),
        F.col("object_full_name").alias("matched"), F.lit(None).cast("string").alias("definition"), F.col("page_id").alias("page"),
        "object_full_name", F.lit(None).cast("string").alias("field"))
    return _placed(from_terms.unionByName(from_nodes).unionByName(from_objects), nodes_, objects).drop("term_id")


def _described(nodes_: DataFrame) -> Column:
    return F.col("description") if "description" in nodes_.columns else F.lit(None).cast("string")


def lookup_all(terms: DataFrame, nodes_: DataFrame, objects: DataFrame, glossary: DataFrame) -> DataFrame:
    """:func:`lookup` for a table of terms (column term): term, rank and the columns of :data:`HIT`.

    Partial matches are found through :func:`contains_pairs`, so no term is compared with every name. What is as long as the terms, objects or
    glossary is merged, since the registry's files are far smaller than its rows; only what is counted and few is broadcast.
    """
    asked = terms.select("term", F.lower(F.trim("term")).alias("needle")).where(F.col("needle") != "").distinct()
    folded_nodes = nodes_.withColumn("text", F.lower("name"))
    # A glossary row is found by its term or any of its synonyms; keyed so that its rows can be told apart.
    keyed = glossary.withColumn("_id", F.struct("term", F.coalesce("linked_object", F.lit("")).alias("o"),
                                                F.coalesce("linked_field", F.lit("")).alias("f"), "definition"))
    words = keyed.select("_id", F.explode(F.array_distinct(F.transform(F.concat(
        F.array("term"), F.coalesce("synonyms", F.array().cast("array<string>"))), F.lower))).alias("text"))
    folded_objects = objects.withColumn("text", F.lower(F.substring_index("object_full_name", ".", -1)))
    every_text = words.select("text").unionByName(folded_nodes.select("text")).unionByName(folded_objects.select("text"))
    # Three kinds of hits read the pairs; written once, they are not found three times.
    pairs = written(contains_pairs(asked, "needle", every_text, "text"), "pairs")

    exact = F.col("needle") == F.col("text")
    matched_words = (pairs.join(words.hint("merge"), "text").groupBy("needle", "_id").agg(F.max(exact).alias("exact")))
    from_terms = matched_words.join(keyed.select("_id", "term", "definition", "page_id", "linked_object", "linked_field").hint("merge"), "_id")
    from_terms = _hits_glossary(from_terms.withColumnRenamed("needle", "term_id"), F.col("exact"))

    by_name = pairs.join(few_or_merged(folded_nodes.select("text", "node_id")), "text").select("needle", "node_id", exact.alias("exact"))
    by_id = asked.join(few_or_merged(nodes_.select("node_id", F.col("node_id").alias("needle"))), "needle").select(
        "needle", "node_id", F.lit(True).alias("exact"))
    matched_nodes = by_name.unionByName(by_id).groupBy("needle", "node_id").agg(F.max("exact").alias("exact"))
    about = nodes_.select("node_id", "node_type", "name", _described(nodes_).alias("description"))
    matched_nodes = written(matched_nodes.join(few_or_merged(about), "node_id"), "matched")
    from_nodes = (_members(objects).join(few_or_merged(matched_nodes), "node_id")
                  .select(F.col("needle").alias("term_id"), F.when(F.col("exact"), 1).otherwise(3).alias("rank"),
                          F.col("node_type").alias("match_type"), F.col("name").alias("matched"),
                          F.col("description").alias("definition"), F.col("page_id").alias("page"), "object_full_name",
                          F.lit(None).cast("string").alias("field")))
    from_objects = pairs.join(folded_objects.select("text", "page_id", "object_full_name").hint("merge"), "text").select(
        F.col("needle").alias("term_id"), F.when(exact, 2).otherwise(4).alias("rank"), F.lit("object").alias("match_type"),
        F.col("object_full_name").alias("matched"), F.lit(None).cast("string").alias("definition"), F.col("page_id").alias("page"),
        "object_full_name", F.lit(None).cast("string").alias("field"))
    found = _placed(from_terms.unionByName(from_nodes).unionByName(from_objects), nodes_, objects)
    return found.withColumnRenamed("term_id", "needle").join(few_or_merged(asked), "needle").select("term", "rank", *HIT)


def lookup_failures(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """Probes (kind term or page, term, page) that the lookup did not answer.

    A term needs a glossary hit of its own name, on its page if it has one; a page needs any hit on it.
    """
    named = (F.col("match_type") == "glossary") & (F.lower("matched") == F.lower("term"))
    nowhere = F.lit(None).cast("string")

    def answer(kind, page):
        return F.struct(F.lit(kind).alias("_kind"), F.col("term").alias("_term"), page.alias("_page"))

    found = F.when(named, F.array(answer("page", F.col("page")), answer("term", F.col("page")), answer("term", nowhere))).otherwise(
        F.array(answer("page", F.col("page"))))
    answers = hits.select(F.inline(found)).distinct()
    same = ((F.col("kind") == F.col("_kind")) & (F.col("term") == F.col("_term")) & F.col("page").eqNullSafe(F.col("_page")))
    return probes.join(answers.hint("merge"), same, "left_anti")
