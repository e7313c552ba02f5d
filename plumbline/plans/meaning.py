"""Taxonomy, placement, glossary and lookup; sensitivity and descriptions."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDER, weak
from ..operators import classify, ontology
from ..session import written
from .registry import query, text_list


# ---------------------------------------------------------------- taxonomy: region > nation > segment, customers as assets
def homes(t):
    """Customers with their domain, subdomain and page."""
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_name", "r_name", F.lower("r_name").alias("domain_id"),
                    F.lower("n_name").alias("subdomain_id"), F.concat_ws(":", F.lower("n_name"), F.lower("c_mktsegment")).alias("page_id")))


def taxonomy(t):
    domains = t.region.select(F.lower("r_name").alias("id"), F.col("r_name").alias("name"))
    subdomains = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("id"), F.lower("r_name").alias("domain"), F.col("n_name").alias("name"))
    pages = homes(t).select(F.col("page_id").alias("id"), F.col("subdomain_id").alias("subdomain"),
                            F.initcap(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("name")).distinct()
    return ontology.nodes(domains, subdomains, pages)


def objects(t, least=None):
    """Customers as objects on the page of their segment; with ``least``, those with a smaller balance are on the building page."""
    page = F.col("page_id") if least is None else F.when(F.col("c_acctbal") >= least, F.col("page_id")).otherwise(F.concat("subdomain_id", F.lit(":building")))
    return homes(t).select(page.alias("page_id"), "subdomain_id", "domain_id", full_name().alias("object_full_name"), F.lit("table").alias("object_kind"))


RICH = 7000


def full_name():
    return F.concat_ws(".", F.col("domain_id"), F.col("subdomain_id"), F.lower("c_name"))


_HOME = """SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name, r_name, lower(r_name) AS domain_id, lower(n_name) AS subdomain_id,
  lower(n_name) || ':' || lower(c_mktsegment) AS page_id, lower(r_name) || '.' || lower(n_name) || '.' || lower(c_name) AS object_full_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_PAGE_NAME = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' ' || upper(left(n_name, 1)) || lower(substr(n_name, 2))"
_NODES = f"""SELECT lower(r_name) AS node_id, 'domain' AS node_type, CAST(NULL AS VARCHAR) AS parent_id, lower(r_name) AS domain_id, CAST(NULL AS VARCHAR) AS subdomain_id,
    r_name AS name, r_name AS path FROM region
  UNION ALL SELECT lower(n_name), 'subdomain', lower(r_name), lower(r_name), lower(n_name), n_name, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT page_id, 'page', subdomain_id, domain_id, subdomain_id, {_PAGE_NAME}, r_name || ' > ' || n_name || ' > ' || {_PAGE_NAME} FROM ({_HOME})"""
_OBJECTS = f"SELECT page_id, subdomain_id, domain_id, object_full_name, 'table' AS object_kind FROM ({_HOME})"
_RICH_OBJECTS = f"SELECT CASE WHEN c_acctbal >= 7000 THEN page_id ELSE subdomain_id || ':building' END AS page_id FROM ({_HOME})"


@query("taxonomy_nodes", _NODES)
def taxonomy_nodes(t):
    return taxonomy(t)


@query("placement", """WITH best AS (SELECT l_partkey, l_suppkey % (l_partkey % 3 + 1) AS page, max(l_discount) AS conf FROM lineitem GROUP BY ALL),
  one AS (SELECT l_partkey, COUNT(*) AS n, any_value(page) AS page, max(conf) AS conf FROM best GROUP BY 1)
  SELECT p_partkey AS asset, CASE WHEN p_size = 1 THEN 1 WHEN p_size = 2 THEN 2 WHEN n = 1 THEN page END AS page,
    CASE WHEN p_size = 1 THEN 'user' WHEN p_size = 2 THEN 'certified' WHEN n = 1 THEN 'agent' ELSE 'pending' END AS source,
    CASE WHEN p_size = 1 THEN 1.0::DOUBLE WHEN p_size = 2 THEN 0.75::DOUBLE WHEN n = 1 THEN conf END AS confidence, coalesce(n, 0) AS candidates
  FROM part LEFT JOIN one ON l_partkey = p_partkey""")
def placement(t):
    """Parts as assets, order lines as claims for one to three pages of an asset, dealt by supplier."""
    claims = t.lineitem.select(F.col("l_partkey").alias("asset"), (F.col("l_suppkey") % (F.col("l_partkey") % 3 + 1)).alias("page"), F.col("l_discount").alias("confidence"))
    asset = F.col("p_partkey").alias("asset")
    pins = t.part.where("p_size = 1").select(asset, F.lit(1).cast("bigint").alias("page"))
    kept = t.part.where("p_size IN (1, 2)").select(asset, F.lit(2).cast("bigint").alias("page"), F.lit(0.75).alias("confidence"))
    return ontology.place(t.part.select(asset), pins, kept, claims)


@query("one_page_per_asset", f"""SELECT asset, CASE WHEN balance IS NULL THEN 'out of scope' WHEN balance < 0 THEN 'unplaced' WHEN balance > 9000 THEN 'on more than one page' ELSE 'wrong path' END AS problem
  FROM (SELECT object_full_name AS asset, c_acctbal AS balance FROM ({_HOME}) WHERE c_acctbal < 500 OR c_acctbal > 9000
    UNION ALL SELECT lower(s_name), NULL FROM supplier)""")
def one_page_per_asset(t):
    """Customers placed on their page; some twice, some under another nation, some not at all; suppliers are out of scope."""
    h = homes(t).withColumn("asset", full_name())
    moved = F.when(F.col("c_acctbal") < 500, "nowhere").otherwise(F.col("subdomain_id"))
    placed = h.where("c_acctbal >= 0").select("asset", F.col("page_id").alias("page"), moved.alias("subdomain"), F.col("domain_id").alias("domain"))
    twice = h.where("c_acctbal > 9000").select("asset", F.col("page_id").alias("page"), F.col("subdomain_id").alias("subdomain"), F.col("domain_id").alias("domain"))
    strangers = t.supplier.select(F.lower("s_name").alias("asset"), F.lit("p").alias("page"), F.lit("s").alias("subdomain"), F.lit("d").alias("domain"))
    pages = h.select(F.col("page_id").alias("page"), F.col("subdomain_id").alias("subdomain"), F.col("domain_id").alias("domain")).distinct()
    return ontology.placement_problems(h, placed.unionByName(twice).unionByName(strangers), pages)


@query("empty_pages", f"SELECT DISTINCT page_id AS page FROM ({_HOME}) WHERE page_id NOT IN (SELECT page_id FROM ({_RICH_OBJECTS}))")
def empty_pages(t):
    return ontology.empty_pages(homes(t).select(F.col("page_id").alias("page")).distinct(), objects(t, RICH).select(F.col("page_id").alias("page")))


@query("low_confidence", "SELECT l_partkey AS asset, l_orderkey AS page, l_discount AS confidence FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.06")
def low_confidence(t):
    placed = t.lineitem.select(F.col("l_partkey").alias("asset"), F.col("l_orderkey").alias("page"),
                               F.when(F.col("l_returnflag") == "A", "agent").otherwise("user").alias("source"), F.col("l_discount").alias("confidence"))
    return ontology.low_confidence(placed, 0.06).drop("source")


# ---------------------------------------------------------------- glossary: brands as metric views, part names as measures
def part_measures(t):
    return t.part.select(F.concat(F.lit("v_"), F.col("p_brand")).alias("view"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("measure"),
                         F.initcap("p_name").alias("display_name"), F.lit(None).cast("string").alias("comment"), F.array(F.lower("p_type")).alias("synonyms")).distinct()


def user_terms(t):
    red = t.part.where("p_name LIKE 'red %'").select(F.upper("p_name").alias("term"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun")).distinct()
    link = F.struct(F.lit("v_Brand#9").alias("object"), F.replace(F.lower("term"), F.lit(" "), F.lit("_")).alias("field"))
    return red.select("term", F.concat(F.lit("Red goods: "), "noun").alias("definition"), F.array(F.concat(F.lit("crimson "), "noun")).alias("synonyms"),
                      F.when(F.col("noun") != "bolt", F.array(link)).alias("links"))


def placed_views(t):
    return t.part.where("p_brand < 'Brand#3'").select(F.concat(F.lit("v_"), F.col("p_brand")).alias("asset"),
                                                       F.concat(F.lit("page_"), F.col("p_brand")).alias("page")).distinct()


def glossary(t):
    return ontology.merge_glossary(user_terms(t), part_measures(t), placed_views(t))


_GLOSSARY = """WITH m AS (SELECT DISTINCT 'v_' || p_brand AS view, replace(p_name, ' ', '_') AS measure, p_name, lower(p_type) AS syn FROM part),
  auto AS (SELECT p_name, list_sort(list(DISTINCT syn)) AS syns, list_sort(list(DISTINCT view)) AS views FROM m GROUP BY 1)
  SELECT CASE WHEN p_name LIKE 'red %' THEN upper(p_name) ELSE upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) END AS term,
    CASE WHEN p_name LIKE 'red %' THEN 'Red goods: ' || split_part(p_name, ' ', 2) END AS red_definition,
    CASE WHEN p_name LIKE 'red %' THEN ['crimson ' || split_part(p_name, ' ', 2)] ELSE syns END AS synonyms,
    CASE WHEN p_name LIKE 'red %' AND p_name <> 'red bolt' THEN list_prepend('v_Brand#9', list_filter(views, lambda v: v <> 'v_Brand#9')) ELSE views END AS views,
    replace(p_name, ' ', '_') AS field, CASE WHEN p_name LIKE 'red %' THEN 'user' ELSE 'metric_view' END AS source FROM auto"""
GLOSSARY_SQL = f"""SELECT term, coalesce(red_definition, term) AS definition, synonyms, views, field, source,
  'page_' || substr(list_filter(views, lambda v: v < 'v_Brand#3')[1], 3) AS page FROM ({_GLOSSARY})"""


_ROWS = """SELECT term, definition, synonyms, page AS page_id, v AS linked_object, field AS linked_field, source
  FROM (SELECT *, unnest(views) AS v FROM ({g}))"""


@query("glossary_merge", f"SELECT * REPLACE (array_to_string(synonyms, ',') AS synonyms) FROM ({_ROWS.format(g=GLOSSARY_SQL)})")
def glossary_merge(t):
    return glossary(t).withColumn("synonyms", text_list("synonyms"))


@query("glossary_links", """SELECT DISTINCT upper(p_name) AS term, 'Red goods: ' || split_part(p_name, ' ', 2) AS definition, CAST(NULL AS VARCHAR) AS page_id,
  CASE WHEN p_name <> 'red bolt' THEN 'v_Brand#9' END AS linked_object, CASE WHEN p_name <> 'red bolt' THEN replace(p_name, ' ', '_') END AS linked_field, 'user' AS source
  FROM part WHERE p_name LIKE 'red %'""")
def glossary_links(t):
    """One row per link of the declared terms; the term without a link keeps one row."""
    declared = user_terms(t).withColumn("page", F.lit(None).cast("string")).withColumn("source", F.lit("user"))
    return ontology.explode_links(declared).drop("synonyms")


@query("glossary_terms", f"SELECT term, definition, page AS page_id FROM ({GLOSSARY_SQL})")
def glossary_terms(t):
    return ontology.one_definition(glossary(t))


# ---------------------------------------------------------------- lookup
def registry(t, least=None):
    """The three registry tables a lookup reads, as written tables."""
    return (written(taxonomy(t), "nodes"), written(objects(t, least), "objects"), written(glossary(t), "glossary"))


_NULL = "CAST(NULL AS VARCHAR)"


def _lookup_sql(terms: str, objects: str = "") -> str:
    """One relation of names, by what they name, and one join; an object's name ranks behind the others."""
    return f"""WITH o AS ({objects or _OBJECTS}), nd AS ({_NODES}), g AS ({_ROWS.format(g=GLOSSARY_SQL)}),
  named AS (SELECT 'glossary' AS match_type, unnest(list_prepend(term, coalesce(synonyms, []))) AS word, FALSE AS whole, term AS matched, definition,
      page_id AS page, linked_object AS object_full_name, linked_field AS field FROM g
    UNION ALL SELECT nd.node_type, unnest([nd.name, nd.node_id]), unnest([FALSE, TRUE]), nd.name, {_NULL}, o.page_id, o.object_full_name, {_NULL}
      FROM (SELECT *, unnest([page_id, subdomain_id, domain_id]) AS belongs FROM o) o JOIN nd ON nd.node_id = o.belongs
    UNION ALL SELECT 'object', split_part(object_full_name, '.', 3), FALSE, object_full_name, {_NULL}, page_id, object_full_name, {_NULL} FROM o),
  hit AS (SELECT asked.term, min(CASE WHEN lower(word) = lower(trim(asked.term)) THEN 1 ELSE 3 END + CASE match_type WHEN 'object' THEN 1 ELSE 0 END) AS rank,
      match_type, matched, definition, page, object_full_name, field
    FROM (SELECT DISTINCT term FROM ({terms}) WHERE trim(term) <> '') asked JOIN named
      ON CASE WHEN whole THEN word = lower(trim(asked.term)) ELSE contains(lower(word), lower(trim(asked.term))) END GROUP BY ALL)
  SELECT hit.*, home.domain_id AS domain, home.subdomain_id AS subdomain, home.name AS page_name, o.object_kind
  FROM hit LEFT JOIN (SELECT * FROM nd WHERE node_type = 'page') home ON home.node_id = hit.page LEFT JOIN o USING (object_full_name)"""


def _single(name, term):
    @query(name, f"SELECT * EXCLUDE (term) FROM ({_lookup_sql(f'''SELECT '{term}' AS term''')})")
    def plan(t):
        return ontology.lookup(t.spark, term, *registry(t))
    return plan


ontology_lookup = _single("ontology_lookup", " Nation_1 ")
ontology_lookup_word = _single("ontology_lookup_word", "crimson widget")
ontology_lookup_blank = _single("ontology_lookup_blank", "  ")
ontology_lookup_escape = _single("ontology_lookup_escape", "%_")

_TERMS = """SELECT r_name AS term FROM region UNION SELECT n_name FROM nation UNION SELECT p_name FROM part UNION SELECT p_type FROM part
  UNION SELECT c_name FROM customer UNION SELECT ' ' || lower(c_mktsegment) FROM customer"""


def search_terms(t):
    parts = [t.region.select(F.col("r_name").alias("term")), t.nation.select("n_name"), t.part.select("p_name"), t.part.select("p_type"),
             t.customer.select("c_name"), t.customer.select(F.concat(F.lit(" "), F.lower("c_mktsegment")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@query("ontology_lookup_bulk", _lookup_sql(_TERMS))
def ontology_lookup_bulk(t):
    return ontology.lookup_all(search_terms(t), *registry(t))


@query("lookup_failures", f"""SELECT 'page' AS kind, name AS term, node_id AS page FROM ({_NODES}) WHERE node_type = 'page' AND node_id NOT IN (SELECT page_id FROM ({_RICH_OBJECTS}))
  UNION ALL SELECT 'term', term || '!', page FROM ({GLOSSARY_SQL}) WHERE source = 'user'""")
def lookup_failures(t):
    """Page names and terms as probes; pages without objects and misspelt terms stay unanswered."""
    nodes, placed, words = registry(t, RICH)
    pages = nodes.where("node_type = 'page'").select(F.lit("page").alias("kind"), F.col("name").alias("term"), F.col("node_id").alias("page"))
    terms = words.select(F.lit("term").alias("kind"), "term", F.col("page_id").alias("page"), "source").distinct()
    wrong = terms.where("source = 'user'").withColumn("term", F.concat("term", F.lit("!")))
    probes = pages.unionByName(terms.unionByName(wrong).drop("source"))
    return ontology.lookup_failures(probes, ontology.lookup_all(probes.select("term").distinct(), nodes, placed, words))


# ---------------------------------------------------------------- sensitivity and descriptions
RULES = (("^red |^green ", "restricted"), ("ring$|gear$", "personal"), ("blue", "internal"))
CLASSES = ("public", "internal", "personal", "restricted")


@query("sensitivity_rules", """SELECT CASE WHEN p_name LIKE 'red %' OR p_name LIKE 'green %' THEN 'restricted' WHEN p_name LIKE '%ring' OR p_name LIKE '%gear' THEN 'personal'
  WHEN contains(p_name, 'blue') THEN 'internal' END AS class, COUNT(*) AS n FROM part GROUP BY 1""")
def sensitivity_rules(t):
    return t.part.groupBy(classify.rule_class(F.col("p_name"), RULES).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("sensitivity_consistent", """WITH p AS (SELECT p_partkey, p_name, ['public', 'internal', 'personal', 'restricted', 'unheard'][p_size % 5 + 1] AS cls, p_size % 5 AS rk,
    CASE WHEN p_size > 10 THEN 'agent' ELSE 'rule' END AS src FROM part WHERE p_size < 30),
  s AS (SELECT p_name, max(p_size % 3) AS fixed FROM part WHERE p_size >= 30 AND p_type = 'PROMO' AND p_name < 'n' GROUP BY 1),
  h AS (SELECT p_name, max(rk) FILTER (WHERE rk < 4) AS high FROM p GROUP BY 1),
  j AS (SELECT p.*, ['public', 'internal', 'personal', 'restricted'][coalesce(fixed, high) + 1] AS want FROM p LEFT JOIN s USING (p_name) LEFT JOIN h USING (p_name))
  SELECT p_partkey AS table_name, p_name AS column_name, CASE WHEN src = 'agent' AND want IS NOT NULL AND want <> cls THEN want ELSE cls END AS sensitivity,
    CASE WHEN src = 'agent' AND want IS NOT NULL AND want <> cls THEN 'consistency' ELSE src END AS sensitivity_source FROM j""")
def sensitivity_consistent(t):
    labels = F.array(*[F.lit(c) for c in (*CLASSES, "unheard")])
    proposals = t.part.where("p_size < 30").select(
        F.col("p_partkey").alias("table_name"), F.col("p_name").alias("column_name"), F.get(labels, F.col("p_size") % 5).alias("sensitivity"),
        F.when(F.col("p_size") > 10, "agent").otherwise("rule").alias("sensitivity_source"))
    settled = t.part.where("p_size >= 30 AND p_type = 'PROMO' AND p_name < 'n'").select(F.col("p_name").alias("column_name"), F.get(labels, F.col("p_size") % 3).alias("sensitivity"))
    return classify.make_consistent(proposals, settled, CLASSES)


_FOLDED = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_WEAK = f"""CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'missing'
  WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < {{n}} THEN 'short'
  WHEN {_FOLDED.format('text')} IN ({_FOLDED.format('name')}, {_FOLDED.format('name')} || 's') THEN 'restates the name'
  WHEN regexp_matches(text, '{PLACEHOLDER}') THEN 'placeholder' END"""


@query("weak_text", f"SELECT lang, {_WEAK.format(n=150)} AS reason, COUNT(*) AS n FROM (SELECT lang, text, source AS name FROM documents) GROUP BY ALL")
def weak_text(t):
    return t.documents.groupBy("lang", weak(F.col("text"), F.col("source"), 150).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("weak_comment", f"""SELECT p_partkey, {_WEAK.format(n=8)} AS reason FROM (SELECT p_partkey, p_name AS name, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '  ' WHEN p_size = 3 THEN 'part'
    WHEN p_size = 4 THEN upper(replace(p_name, ' ', '_')) || 'S ' WHEN p_size = 5 THEN 'To be added later' WHEN p_size = 6 THEN ' n/a     ' ELSE 'A ' || p_name || ' of type ' || p_type END AS text FROM part)""")
def weak_comment(t):
    size = F.col("p_size")
    text = (F.when(size == 1, None).when(size == 2, "  ").when(size == 3, "part").when(size == 4, F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("S ")))
            .when(size == 5, "To be added later").when(size == 6, " n/a     ").otherwise(F.concat(F.lit("A "), "p_name", F.lit(" of type "), "p_type")))
    return t.part.select("p_partkey", weak(text, F.col("p_name"), 8).alias("reason"))


@query("keep_existing", """SELECT c_custkey, CASE WHEN length(c_mktsegment) >= 9 THEN c_mktsegment ELSE 'proposed' END AS comment, coalesce(nullif(c_mktsegment, 'BUILDING'), 'proposed') AS tag FROM customer""")
def keep_existing(t):
    """Live values stay unless they are missing or too weak."""
    live = F.col("c_mktsegment")
    return t.customer.select("c_custkey", classify.keep_existing(live, F.lit("proposed"), weak(live, F.lit("segment"), 9)).alias("comment"),
                             classify.keep_existing(F.nullif(live, F.lit("BUILDING")), F.lit("proposed")).alias("tag"))
