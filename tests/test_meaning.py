"""Metrics, governance, ontology, evaluation and operations on small frames."""
import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.functions.compare import close_relative, close_to_truth, principal_kind, verdict
from plumbline.functions.masks import mask
from plumbline.operators import evaluate, governance, metrics, ontology, ops, protection, statements, textjoin, tools
from plumbline.plans import kpis
from plumbline.specs import Field, Join, MaskPolicy, MetricView, Parameter, RowPolicy, Tile, Tool
from pyspark.sql import functions as F


# ---------------------------------------------------------------- metrics
VIEW = MetricView("v", "f", (Field("d", "upper(d)"), Field("name", "dim.name")), (Field("n", "SUM(n)"), Field("c", "COUNT(DISTINCT id)")),
                  (Join("dim", "dim", {"id": "id"}),), filter="n > 0")


@pytest.fixture
def sources(spark):
    return {"f": spark.createDataFrame([("a", 1, 5), ("A", 2, 1), (None, 9, 2), ("b", 1, -5)], "d STRING, id INT, n INT"),
            "dim": spark.createDataFrame([(1, "one"), (2, "two")], "id INT, name STRING")}


def test_query_joins_only_what_it_needs(sources, rows):
    plain = metrics.query(VIEW, sources, ["d"], ["n", "c"])
    assert rows(plain) == [("A", 6, 2), (None, 2, 1)]
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    joined = metrics.query(VIEW, sources, ["name"], ["n"])
    assert rows(joined) == [("one", 5), ("two", 1), (None, 2)]


def test_query_filters_on_dimensions_not_shown(sources, rows):
    assert rows(metrics.query(VIEW, sources, [], ["n"], lambda d: d["name"] == "two")) == [(1,)]
    with pytest.raises(ValueError):
        metrics.query(VIEW, sources, ["nope"], ["n"])


def test_definitions_are_checked_before_they_run(sources, spark):
    assert metrics.view_problems(VIEW, sources) == []
    assert metrics.view_problems(VIEW, sources, bronze=["f"]) == ["source f is bronze"]
    twice = MetricView("v", "f", (Field("n", "d"),), (Field("n", "SUM(n)"),))
    assert metrics.view_problems(twice, sources) == ["field n is defined twice"]
    wrong = MetricView("v", "f", (), (Field("n", "SUM(zzz)"),))
    assert "zzz" in metrics.view_problems(wrong, sources)[0]
    sources["f"].createOrReplaceTempView("facts")
    assert metrics.reference_problems(spark, VIEW, "SELECT d, SUM(n) AS value FROM facts GROUP BY d", ["d"], "metrics") == []
    assert metrics.reference_problems(spark, VIEW, "SELECT SUM(n) AS v FROM facts", ["x"]) == ["x is not a dimension", "returns no column value", "returns no column x"]
    assert "independent" in metrics.reference_problems(spark, VIEW, "SELECT 1 AS value FROM metrics.v", [], "metrics")[0]


def test_reconcile_keeps_null_and_empty_groups_apart(spark, rows):
    a = spark.createDataFrame([(None, 1.0), ("", 2.0), ("z", None)], "g STRING, value DOUBLE")
    b = spark.createDataFrame([(None, 1.0000005), ("", 3.0), ("z", None), ("only", None)], "g STRING, value DOUBLE")
    got = metrics.reconcile(a, b, ["g"])
    assert rows(got, "g", "problem") == [("", "values differ"), ("only", "group only on one side"), ("z", None), (None, None)]
    v = metrics.reconcile_verdict(got).first()
    assert (v.groups, v.mismatches, v.ok) == (4, 2, False)


def test_the_two_tolerances(spark):
    r = spark.range(1).select(
        close_relative(F.lit(1e6), F.lit(1e6 + 1), 1e-6).alias("a"), close_relative(F.lit(0.0), F.lit(0.0), 1e-6).alias("b"),
        close_relative(F.lit(None).cast("double"), F.lit(0.0), 1e-6).alias("c"), close_to_truth(F.lit(1.009), F.lit(1.0)).alias("d"),
        close_to_truth(F.lit(1e9 + 900), F.lit(1e9)).alias("e"), close_to_truth(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("f")).first()
    assert tuple(r) == (True, True, False, True, True, True)


def test_tile_shapes():
    bad = [Tile("counter", ("revenue", "orders")), Tile("counter", ("revenue",), "region"), Tile("line", ("revenue",), "region"), Tile("bar", ("revenue",)),
           Tile("bar", ("revenue", "orders"), "region", "category"), Tile("table", ("revenue",), "region", "category"), Tile("bar", ("revenue",), "region", "region"),
           Tile("bar", ("nothing",), "region"), Tile("bar", ("revenue",), "nothing"), Tile("bar", ("revenue", "orders", "units", "avg_order_value"), "region")]
    assert all(metrics.tile_problem(t, kpis.SALES) for t in bad)
    good = [Tile("counter", ("revenue",)), Tile("line", ("revenue",), "order_month", "region"), Tile("table", ("revenue", "orders", "units", "avg_order_value"), "region")]
    assert not any(metrics.tile_problem(t, kpis.SALES) for t in good)


def test_registered_views_are_complete(spark):
    assert metrics.field_gaps(metrics.field_rows(spark, kpis.VIEWS)).count() == 0
    views = spark.createDataFrame([(v.name, v.comment) for v in kpis.VIEWS], "view STRING, comment STRING")
    assert metrics.thin_comments(views).count() == 0


def test_compare_keyed_reports_each_side(spark, rows):
    got = spark.createDataFrame([("a", 1.004, "x"), ("b", 2.0, "x")], "k STRING, n DOUBLE, t STRING")
    want = spark.createDataFrame([("a", 1.0, "y"), ("c", 2.0, "x")], "k STRING, n DOUBLE, t STRING")
    assert rows(metrics.compare_keyed(got, want, ["k"], ["n", "t"]), "k", "column", "problem") == [
        ("a", "t", "differs"), ("b", None, "not in the matching rows"), ("c", None, "missing from the result")]


# ---------------------------------------------------------------- tools
def test_table_function_defaults_quotes_and_unknown_arguments(spark, rows):
    spark.createDataFrame([("it's", 1), ("b", 2)], "k STRING, n INT").createOrReplaceTempView("tool_rows")
    tool = Tool("pick", (Parameter("k", "STRING", "all", True), Parameter("least", "INT", 0, True)), {"k": "STRING", "n": "INT"},
                "SELECT k, n FROM tool_rows WHERE (pick.k = 'all' OR k = pick.k) AND n >= pick.least")
    tools.create_tool(spark, tool)
    assert rows(tools.call_tool(spark, tool, {})) == [("b", 2), ("it's", 1)]
    assert rows(tools.call_tool(spark, tool, {"k": "it's"})) == [("it's", 1)]
    assert rows(tools.call_tool(spark, tool, {"least": 2})) == [("b", 2)]
    with pytest.raises(ValueError):
        tools.call_tool(spark, tool, {"nope": 1})
    assert tools.unused_parameters(tool) == []


def test_query_texts(spark, rows):
    q = spark.createDataFrame([(1, "SELECT 'a.b.c' FROM `x`.y . z JOIN p.q.r"), (2, "delete from a.b.c; select 1")], "query_id INT, sql STRING")
    ok = spark.createDataFrame([("x.y.z",)], "full_name STRING")
    assert rows(tools.outside_reads(q, ok)) == [(1, "p.q.r"), (2, "a.b.c")]
    assert rows(tools.statement_problems(q), "query_id", "problem") == [(2, "more than one statement"), (2, "not a SELECT"), (2, "writes")]


# ---------------------------------------------------------------- governance
@pytest.mark.parametrize("sql, names", [
    ("SELECT 1", []),
    ("select a from x.y.z, payroll p, `hr`.`people`", ["hr.people", "payroll", "x.y.z"]),
    ("SELECT * FROM a.b.c -- , d.e.f\n, g /* FROM h */ JOIN i.j ON a.x = (SELECT max(k) FROM l, m)", ["a.b.c", "g", "i.j", "l", "m"]),
    ("SELECT ',' || \"FROM n\", 'it''s FROM o, p', 'x\\' FROM q' FROM r", ["r"]),
    ("WITH a AS (SELECT 1), b(c) AS (SELECT * FROM a, d) SELECT EXTRACT(year FROM e), SUBSTRING(f FROM 2) FROM a, x.a, b JOIN LATERAL (SELECT g FROM h) ORDER BY i, j", ["d", "h", "x.a"]),
    ("SELECT * FROM (a JOIN b ON true), (c) WHERE d IN (e, f) AND g IS DISTINCT FROM h GROUP BY i, j UNION ALL SELECT k, l FROM m LATERAL VIEW explode(n) o, p", ["a", "b", "c", "m", "p"]),
    ("SELECT * FROM range(5), explode(x) t, VALUES (1), (2)", []),
    ("FROM s.t.u SELECT v", ["s.t.u"]),
    ("SELECT a--FROM b\nFROM c", ["c"]), ("", []), (None, None)])
def test_relations_of_a_statement(spark, sql, names):
    found = statements.with_reads(spark.createDataFrame([(sql,)], "sql STRING"), "sql").first().relations
    assert (sorted(found) if found is not None else None) == names


def test_long_names_are_read_wherever_they_stand(spark):
    sql = "SELECT fn.in.schema(x), 'no.no.no', a . b . `c d`.e /* no.no.yes */ FROM t"
    found = statements.with_reads(spark.createDataFrame([(sql,)], "sql STRING"), "sql").first().full_names
    assert sorted(found) == ["a.b.cd", "fn.in.schema"]


def test_masks_refuse_wrong_types(spark):
    with pytest.raises(ValueError):
        mask(F.col("n"), "hash", "bigint")
    df = spark.createDataFrame([("a", 1)], "s STRING, n BIGINT")
    with pytest.raises(ValueError):
        governance.secure_view(df, "p", [], [MaskPolicy("null", column="n")])
    with pytest.raises(ValueError):
        governance.secure_view(df, "p", [], [MaskPolicy("null", column="s"), MaskPolicy("hash", column="s")])
    with pytest.raises(ValueError):
        governance.secure_view(df, "p", [], [MaskPolicy("redact", tag=("k", "v"))], tags={"n": {"k": "v"}})


def test_a_principal_in_no_group_sees_no_rows(spark, rows):
    df = spark.createDataFrame([("EU",), ("US",), (None,)], "region STRING")
    policy = RowPolicy("region", {"eu_team": ("EU",), "ann@example.com": ("US",)}, exempt=("admins",))
    see = lambda who, groups: rows(governance.secure_view(df, who, groups, rows=policy))
    assert see("bob@example.com", []) == []
    assert see("bob@example.com", ["eu_team"]) == [("EU",)]
    assert see("ann@example.com", ["eu_team"]) == [("EU",), ("US",)]
    assert len(see("root", ["admins"])) == 3


def test_principal_kinds(spark):
    r = spark.range(1).select(principal_kind(F.lit("a@b.c")), principal_kind(F.lit("0a1b2c3d-0000-1111-2222-333344445555")), principal_kind(F.lit("team"))).first()
    assert tuple(r) == ("user", "service_principal", "group")


# ---------------------------------------------------------------- ontology
@pytest.fixture
def registry(spark):
    nodes = spark.createDataFrame([("d", "domain", "d", None, "Sales"), ("s", "subdomain", "d", "s", "Orders 100%"), ("p", "page", "d", "s", "Order_book"), ("q", "page", "d", "s", "Returns")],
                                  "node_id STRING, node_type STRING, domain_id STRING, subdomain_id STRING, name STRING")
    objects = spark.createDataFrame([("p", "s", "d", "c.s.orders", "table"), ("q", "s", "d", "c.s.returns", "table")],
                                    "page_id STRING, subdomain_id STRING, domain_id STRING, object_full_name STRING, object_kind STRING")
    glossary = spark.createDataFrame([("Revenue", "money in", ["turnover", "Sales"], "p", "c.s.orders", "revenue"), ("Spend", "money out", ["turnover"], None, None, None),
                                      ("AOV", "x", None, "p", "c.s.orders", "aov")],
                                     "term STRING, definition STRING, synonyms ARRAY<STRING>, page_id STRING, linked_object STRING, linked_field STRING")
    return nodes, objects, glossary


def hits(spark, registry, rows, term):
    return rows(ontology.lookup(spark, term, *registry), "rank", "match_type", "matched", "page", "object_full_name")


def test_lookup_ranks(spark, registry, rows):
    assert hits(spark, registry, rows, " turnover ") == [(1, "glossary", "Revenue", "p", "c.s.orders"), (1, "glossary", "Spend", None, None)]
    assert hits(spark, registry, rows, "sales") == [(1, "domain", "Sales", "p", "c.s.orders"), (1, "domain", "Sales", "q", "c.s.returns"), (1, "glossary", "Revenue", "p", "c.s.orders")]
    assert hits(spark, registry, rows, "orders") == [(2, "object", "c.s.orders", "p", "c.s.orders"), (3, "subdomain", "Orders 100%", "p", "c.s.orders"), (3, "subdomain", "Orders 100%", "q", "c.s.returns")]
    assert hits(spark, registry, rows, "") == [] and hits(spark, registry, rows, "   ") == []


def test_lookup_takes_wildcards_as_characters(spark, registry, rows):
    assert [h[2] for h in hits(spark, registry, rows, "%")] == ["Orders 100%", "Orders 100%"]
    assert hits(spark, registry, rows, "_") == [(3, "page", "Order_book", "p", "c.s.orders")]
    assert hits(spark, registry, rows, "o%s") == []


def test_bulk_lookup_equals_single(spark, registry, rows):
    terms = ["turnover", "Sales", "or", "%", "_", "o", "d", "returns", "zzz", " ", "r", "Order"]
    bulk = ontology.lookup_all(spark.createDataFrame([(t,) for t in terms], "term STRING"), *registry)
    single = []
    for t in terms:
        single += [(t, *r) for r in rows(ontology.lookup(spark, t, *registry))]
    assert rows(bulk) == sorted(single, key=lambda r: [(v is None, str(v)) for v in r])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("abé", min_size=0, max_size=4), min_size=1, max_size=8), st.lists(st.text("abé", min_size=0, max_size=9), min_size=1, max_size=8))
def test_contains_pairs_against_every_pair(spark, needles, texts):
    got = textjoin.contains_pairs(spark.createDataFrame([(n,) for n in needles], "n STRING"), "n", spark.createDataFrame([(t,) for t in texts], "t STRING"), "t")
    assert {tuple(r) for r in got.collect()} == {(n, t) for n in needles for t in texts if n and n in t}
    assert got.count() == got.distinct().count()


def test_one_long_text_is_cut_and_found_whole(spark):
    long = "".join(f"{i:07d} " for i in range(131072))  # 1 MB
    needles = ["0000511 0000512", "131071 ", long[4090:4102], long[4000:8300], long[-9000:], "0131072", "1", "x", "\u00e9", None, ""]
    got = textjoin.contains_pairs(spark.createDataFrame([(n,) for n in needles], "n STRING"), "n",
                                  spark.createDataFrame([(long,), (long[:5000],), ("\u00e9" * 4097 + "x",), (None,), ("",)], "t STRING"), "t")
    pairs = {(r["needle"], len(r["text"])) for r in got.collect()}
    whole = {(n, len(long)) for n in needles[:5] + ["1"]}
    assert pairs == whole | {(long[4090:4102], 5000), ("0000511 0000512", 5000), ("1", 5000), ("x", 4098), ("\u00e9", 4098)}


def test_needles_of_one_form_meet_their_own_texts_only(spark):
    names = spark.range(3000).selectExpr("format_string('customer#%09d', id) AS text")
    wanted = names.select(names.text.alias("needle"), textjoin.window_size(names.text).alias("size"))
    met = textjoin.met_pairs(wanted, names.selectExpr("text", "xxhash64(text) AS key"))
    assert met.count() == 3000


def test_placement_order(spark, rows):
    a = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "asset STRING")
    pins = spark.createDataFrame([("a", "p1")], "asset STRING, page STRING")
    kept = spark.createDataFrame([("a", "p2", 0.5), ("b", "p2", 0.5)], "asset STRING, page STRING, confidence DOUBLE")
    claims = spark.createDataFrame([("b", "p3", 0.9), ("c", "p3", 0.2), ("c", "p3", 0.7), ("d", "p1", 0.9), ("d", "p2", 0.1)], "asset STRING, page STRING, confidence DOUBLE")
    got = ontology.place(a, pins, kept, claims)
    assert rows(got) == [("a", "p1", "user", 1.0, 0), ("b", "p2", "certified", 0.5, 1), ("c", "p3", "agent", 0.7, 1), ("d", None, "pending", None, 2), ("e", None, "pending", None, 0)]


def test_glossary_unites_links_and_the_user_wins(spark, rows):
    measures = spark.createDataFrame([("v1", "rev", "Revenue", "c1", ["sales"]), ("v2", "rev", "revenue", "c2", ["turnover", "sales"]), ("v3", "aov", None, None, None)],
                                     "view STRING, measure STRING, display_name STRING, comment STRING, synonyms ARRAY<STRING>")
    user = spark.createDataFrame([("REVENUE", "mine", ["cash"], [("v9", "x"), ("v2", "rev")]), ("Churn", "lost", None, None)],
                                 "term STRING, definition STRING, synonyms ARRAY<STRING>, links ARRAY<STRUCT<object: STRING, field: STRING>>")
    placed = spark.createDataFrame([("v1", "p1"), ("v2", "p2")], "asset STRING, page STRING")
    got = ontology.merge_glossary(user, measures, placed)
    assert rows(got.withColumn("synonyms", F.array_join("synonyms", ","))) == [
        ("Churn", "lost", "", None, None, None, "user"), ("REVENUE", "mine", "cash", "p2", "v1", "rev", "user"), ("REVENUE", "mine", "cash", "p2", "v2", "rev", "user"),
        ("REVENUE", "mine", "cash", "p2", "v9", "x", "user"), ("aov", "aov", "", None, "v3", "aov", "metric_view")]
    auto = ontology.merge_glossary(user.where("false"), measures, placed)
    assert rows(auto.withColumn("synonyms", F.array_join("synonyms", ",")), "term", "synonyms", "page_id", "linked_object") == [
        ("Revenue", "sales,turnover", "p1", "v1"), ("Revenue", "sales,turnover", "p1", "v2"), ("aov", "", None, "v3")]


# ---------------------------------------------------------------- evaluation
def test_truth_needs_one_to_fifty_rows(spark, rows):
    got = evaluate.truth({"none": spark.range(0), "some": spark.range(50), "many": spark.range(500)})
    assert rows(got) == [("many", 51, "more than 50 rows"), ("none", 0, "no rows"), ("some", 50, None)]


@pytest.mark.parametrize("answer,ok", [
    ("8.46M", True), ("It was 8,461,249.08 USD", True), ("$8.5 million", True), ("8461 thousand", True), ("8.3M", False), ("none", False), (None, False)])
def test_judge_units(spark, answer, ok):
    a = spark.createDataFrame([(1, answer)], "id INT, answer STRING")
    e = spark.createDataFrame([(1, Decimal("8461249.08"))], "id INT, value DECIMAL(12,2)")
    assert evaluate.judge_numbers(a, e, ["id"]).first().correct is ok


def test_judge_wants_every_figure_and_reads_percent(spark):
    a = spark.createDataFrame([(1, "95.7%"), (2, "95.7% and 3")], "id INT, answer STRING")
    e = spark.createDataFrame([(1, 0.957), (1, 3.0), (2, 0.957), (2, 3.0)], "id INT, value DOUBLE")
    assert {r.id: (r.matched, r.correct) for r in evaluate.judge_numbers(a, e, ["id"]).collect()} == {1: (1, False), 2: (2, True)}


def test_ungrounded_lets_years_small_and_shortened_numbers_go(spark, rows):
    a = spark.createDataFrame([(1, "In 2024: 1,234 of 99, then -555 and 777.5", "1234.56 and 777.1"), (2, "999", None)], "id INT, answer STRING, evidence STRING")
    assert rows(evaluate.ungrounded(a, ["id"])) == [(1, "-555"), (2, "999")]


def test_pass_rate_is_judged_unrounded(spark):
    res = spark.createDataFrame([("a", i < 18) for i in range(20)] + [("b", i < 89999) for i in range(100000)], "target STRING, correct BOOLEAN")
    thr = spark.createDataFrame([("a", 0.9), ("b", 0.9)], "target STRING, threshold DOUBLE")
    got = {r.target: r for r in evaluate.pass_rate(res, thr).collect()}
    assert (got["a"].passed, got["a"].needed, got["a"].shortfall) == (True, 18, 0)
    assert (got["b"].pass_rate, got["b"].passed, got["b"].shortfall) == (0.9, False, 1)


def test_dedupe_folds_case_space_and_question_mark(spark, rows):
    df = spark.createDataFrame([(2, " What  IS it?"), (1, "what is it"), (3, "what is it!")], "id INT, q STRING")
    assert rows(evaluate.dedupe_text(df, "q", ["id"]), "id", "copies") == [(1, 2), (3, 1)]


# ---------------------------------------------------------------- operations
@pytest.mark.parametrize("observed,expect,ok", [(0, "== 0", True), (None, "== 0", False), (3, ">=  2.5", True), (3, "!= 3", False), (3, "about 3", False), (3, "< 3", False), (3, "> 1.2.3", False)])
def test_verdict(spark, observed, expect, ok):
    assert spark.range(1).select(verdict(F.lit(observed).cast("double"), F.lit(expect)).alias("v")).first().v is ok


def test_milestones_build_on_each_other(spark):
    need = {"A": ((), ("g1",)), "B": (("A",), ("g2", "g3"))}
    assert ops.required_goals("B", need) == ["g1", "g2", "g3"]
    status = spark.createDataFrame([("x", "g1", "certified"), ("x", "g2", "certified"), ("y", "g1", "ready"), ("y", "other", "certified")], "system STRING, goal_id STRING, status STRING")
    got = {(r.system, r.milestone): (r.certified, r.released, r.reached) for r in ops.milestone_progress(status, need).collect()}
    assert got == {("x", "A"): (1, 1, True), ("x", "B"): (2, 2, False), ("y", "A"): (0, 1, False), ("y", "B"): (0, 1, False)}


def test_validity_reasons(spark, rows):
    d = lambda n: dt.datetime(2024, 1, n)
    goals = spark.createDataFrame([("g0", "h", "certified"), ("g1", "h2", "certified"), ("g2", "h", "ready")], "goal_id STRING, config_hash STRING, status STRING")
    certs = spark.createDataFrame([("g0", "h", d(5), d(20)), ("g1", "h", d(2), d(8)), ("g1", "h", d(1), d(30))], "goal_id STRING, config_hash STRING, certified_at TIMESTAMP, expires_at TIMESTAMP")
    needs = spark.createDataFrame([("g1", "g0"), ("g1", "g2"), ("g1", "g9")], "goal_id STRING, prerequisite STRING")
    assert rows(ops.validity(goals, certs, needs, F.lit(d(10)))) == [
        ("g0", True, None), ("g1", False, "certification expired"), ("g1", False, "configuration changed since certification"),
        ("g1", False, "prerequisite g0 re-certified"), ("g1", False, "prerequisite g2 is ready"), ("g1", False, "prerequisite g9 is unknown")]


def test_doc_headings(spark, rows):
    text = "## Get access\nx\n### ask QUESTIONS  \n# Dashboards\n" + "y" * 400
    docs = spark.createDataFrame([(1, "onboarding", text), (2, "other", None)], "doc_id INT, kind STRING, text STRING")
    assert rows(ops.doc_problems(docs, ["Access"])) == [(1, "no section Dashboards"), (1, "no section Get help"), (2, "does not mention Access"), (2, "too short")]


# ---------------------------------------------------------------- definitions as rows, masks as SQL functions
def test_definitions_with_nulls_and_empty_tables(spark, rows):
    views = spark.createDataFrame([("v", "s"), ("w", None), ("v", "s")], "view STRING, source STRING")
    joins = spark.createDataFrame([], "view STRING, name STRING, source STRING")
    fields = spark.createDataFrame([("v", "dimension", "a", None), ("v", "measure", "m", "sum(x) + `Y` + max(z.x) + \'q\'"), ("v", "measure", "k", "CASE WHEN source.x IS NULL THEN 1 END")],
                                   "view STRING, kind STRING, name STRING, expr STRING")
    refs = spark.createDataFrame([("v", "m", None, None, None), ("v", "k", "SELECT 1 AS value FROM a.`metrics`.t", ["a"], ["value", "a"])],
                                 "view STRING, measure STRING, sql STRING, by ARRAY<STRING>, returns ARRAY<STRING>")
    columns = spark.createDataFrame([("s", "silver", "X"), ("s", "silver", "y")], "source STRING, layer STRING, column STRING")
    got = metrics.definition_problems(views, joins, fields, refs, columns, "METRICS")
    assert rows(got) == sorted([("v", "a", "no expression"), ("v", "k", "reads METRICS; it must be independent"), ("v", "m", "no statement"),
                                ("v", "m", "returns no column value"), ("v", "m", "unknown name z.x"), ("v", "v", "view is defined twice"),
                                ("w", None, "source is unknown")], key=lambda r: [(v is None, str(v)) for v in r])
    nothing = metrics.definition_problems(*[df.limit(0) for df in (views, joins, fields, refs, columns)], "metrics")
    assert rows(nothing) == []


def test_protected_view_shows_what_secure_view_shows(spark, rows):
    df = spark.createDataFrame([(1, "a\'b", 2.5, "x"), (2, None, None, "y"), (3, "c@d.e", 1.0, None)], "id INT, `full name` STRING, pay DOUBLE, seg STRING")
    df.createOrReplaceTempView("staff")
    spark.createDataFrame([("ana", "hr"), ("bo", "it\'s"), ("bo", "hr"), (None, "hr")], "principal STRING, group_name STRING").createOrReplaceTempView("staff_groups")
    masks = [MaskPolicy("last4", column="full name", exempt=("it\'s",)), MaskPolicy("redact", column="pay", type="double", exempt=("zoe",))]
    filters = RowPolicy("seg", {"hr": ("x",), "it\'s": ("y", "z"), "none": ()}, exempt=("boss",))
    spark.sql("DECLARE OR REPLACE VARIABLE who STRING")
    for policy in (filters, None, RowPolicy(condition="pay > 1 OR seg = \'y\'", exempt=("boss",))):
        protection.protect(spark, "staff seen", "staff", "staff_groups", masks, policy, writers=("loader",), identity="who")
        for who, groups in (("ana", ["hr"]), ("bo", ["hr", "it\'s"]), ("zoe", []), ("boss", []), ("loader", [])):
            spark.sql(f"SET VAR who = \'{who}\'")
            want = governance.secure_view(df, who, groups, masks, policy, writers=("loader",))
            assert rows(spark.sql("SELECT * FROM `staff seen`")) == rows(want), (who, policy)
        spark.sql("SET VAR who = NULL")
        assert policy is None or policy.condition or spark.table("`staff seen`").count() == 0
    protection.protect(spark, "mine", "staff", "staff_groups", masks, filters)  # Spark's own user belongs to no group here
    assert spark.table("mine").count() == 0
    with pytest.raises(ValueError, match="more than one method"):
        protection.protect(spark, "mine", "staff", "staff_groups", [*masks, MaskPolicy("hash", column="full name")])
    with pytest.raises(ValueError, match="no column"):
        protection.protect(spark, "mine", "staff", "staff_groups", rows=RowPolicy("gone", {"hr": ("x",)}))
