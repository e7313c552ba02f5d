"""Quality, language, lines, near copies, mixing and the pipeline against brute force and SQL."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import jaccard_join, quality_rules
from plumbline.llm.components import components
from plumbline.llm.jaccard_join import jaccard_classes, one_of_each
from plumbline.llm.language_id import Model, language
from plumbline.llm.line_dedup import LineRuns, line_dedup
from plumbline.llm.mixing import mix, mixed, schedule, targets
from plumbline.llm.quality_classifier import quality_scores
from plumbline.llm.quality_rules import accepted, judged
from plumbline.llm.queries import oracles, queries
from plumbline.llm.tables import table
from tests.oracle import connect, problems

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(oracles()))
def test_sql(name, spark, folder):
    assert problems(queries()[name](spark, folder), connect(folder), oracles()[name]) == []


# ---------------------------------------------------------------- quality
def base(text):
    text = text or ""
    w = WORD.findall(text)
    found, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if found[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD = [(1, None), (None, ""), (2, "a b c a b c " * 30), (3, "\x1ca  b\n\n a\n a"), (3, "\x1ca  b\n\n a\n a"), (4, "x " * 60), (5, "p q r\n" * 3 + "é" * 500)]


def test_base_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = judged(docs, table(spark, folder, "labels"), buckets=1 << 10).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, dup, rep = base(r.row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)


def test_rules_tell_good_from_bad(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id: (r.base_failed, r.kept) for r in judged(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    good = [k for d, (b, k) in kept.items() if labels.get(d) == 1 and not b]
    bad = [k for d, (_, k) in kept.items() if labels.get(d) == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_all_trusted_documents_count(spark):
    """More labels than any bound of old: every one is counted, and the threshold is the exact percentile of the other half."""
    ids = spark.range(50_000)
    docs = ids.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(9))).alias("text")).unionByName(
        spark.createDataFrame([(-1, "x y z"), (-2, None), (None, "w")], "doc_id long, text string"))
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    ratios, threshold = quality_rules.fitted(docs, labels, 1 << 10)
    half = ids.withColumn("counts", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(2)) == 0)
    word = spark.range(1).select(F.pmod(F.xxhash64(F.lit("w")), F.lit(1 << 10)).cast("int")).first()[0]
    n, good = 50_001 + 0.5, half.where("counts").count() + 0.5
    words = 50_000 * 2 + 4, 2 * (good - 0.5)  # and as many pairs
    assert abs(ratios[word] - (math.log(good / n) + math.log((2 * words[0] + 512) / (2 * words[1] + 512)))) < 1e-9
    scored = quality_rules._scored(docs.join(half.where("NOT counts"), F.col("doc_id") == F.col("id")).withColumn("words", quality_rules.words_of("text")), ratios)
    assert abs(threshold + quality_rules.MARGIN - scored.agg(F.percentile("score", quality_rules.TAIL)).first()[0]) < 1e-12


@pytest.mark.parametrize("scores", [[], [None], [1.5], [0.0, 0.0], [-3.0, 7.25], [i * i / 7 for i in range(-400, 401)], [i * 1e-6 for i in range(1000)]])
def test_the_threshold_is_the_exact_percentile(spark, scores):
    df = spark.createDataFrame([(x,) for x in scores], "score double")
    want = df.agg(F.percentile("score", 0.005)).first()[0]
    got = quality_rules._low(df, 0.005)
    assert got == want if want is None else abs(got - want) < 1e-9


def test_rules_without_trusted_documents(spark, folder):
    docs = spark.createDataFrame([(1, "few words", "x"), (9, " ".join(f"w{i}" for i in range(80)), "x")], "doc_id long, text string, score string")
    none = table(spark, folder, "labels").limit(0)
    assert [r.doc_id for r in accepted(docs, none).collect()] == [9]
    assert accepted(docs.limit(0), none).count() == 0 and accepted(docs, none).columns == docs.columns


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_classifier(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in rows)
    judged_rows = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged_rows) >= 0.93 * len(judged_rows)


def test_classifier_learns_nothing_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(quality_scores(docs, flipped, sample=60).collect()) == sorted(quality_scores(docs, labels, sample=60).collect())


def test_classifier_of_odd_rows(spark, folder):
    docs = spark.createDataFrame([(1, None, 0.3), (None, "", 0.2), (2, "words " * 30000, 0.1), (2, "words " * 30000, 0.1)], "doc_id long, text string, score double")
    rows = quality_scores(docs, table(spark, folder, "labels")).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert {r.score for r in quality_scores(docs, table(spark, folder, "labels").limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), table(spark, folder, "labels")).count() == 0


def test_a_repeated_document_teaches_once(spark, monkeypatch):
    """Three thousand rows of one doc_id among few others: it is one document of the sample, whatever its rows."""
    from plumbline.llm import language_id, quality_classifier
    few = [(i, f"plain text of number {i} " * 4, "en" if i % 2 else "de", i % 2) for i in range(40)]
    docs = spark.createDataFrame(few + [(7, f"again {i % 5} and again", "en", 1) for i in range(3000)], "doc_id long, text string, lang string, quality long")
    labels = docs.select("doc_id", "quality").distinct()
    rows = quality_classifier._sampled(docs, labels, F.lit(True), 10).collect()
    assert len(rows) == len({r.id for r in rows}) == 20 and all(r.text == "again 0 and again" for r in rows if r.id == 7)
    taught = {}
    monkeypatch.setattr(language_id, "Model", lambda texts: taught.update(texts))
    language_id.learned(docs, F.lit(True), 10)
    hashed = {lang: [d for _, d in sorted((r.h, r.doc_id) for r in docs.where(F.col("lang") == lang).select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect())[:10]]
              for lang in ("de", "en")}
    least = {i: text.encode() for i, text, _, _ in few} | {7: b"again 0 and again"}
    assert {lang: sorted(parts) for lang, parts in taught.items()} == {lang: sorted(least[i] for i in ids) for lang, ids in hashed.items()}


def test_windows_of_long_texts_cost_what_the_text_costs(monkeypatch):
    from plumbline.llm import language_id
    texts = [b"some words of a text " * 50, b"", b"abc", b"other words", b"x" * 64]
    model = Model({"a": [texts[0]], "b": [b"no such thing here"]})
    whole = model.bits(texts)
    for size in (1, 3, 64, 100):
        monkeypatch.setattr(language_id, "WINDOW", size)
        assert model.bits(texts) == pytest.approx(whole, rel=1e-9)


def test_language(spark):
    docs = table(spark, SF, "documents")
    known = {r.doc_id: r.lang for r in docs.collect()}
    rows = language(docs).collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) >= 0.97 * len(tested)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (None, " 12 !", "en", 1), (3, "hello there " * 3, "en", 1), (3, "hello there " * 3, None, 1), (4, "été à où " * 9, "fr", 1)],
                                 "doc_id long, text string, lang string, score int")
    assert sorted((r.doc_id or -1, r.lang_pred) for r in language(docs).collect()) == [(-1, "und"), (1, "und"), (3, "en"), (3, "en"), (4, "fr")]
    assert language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_code_lengths_by_hand():
    model = Model({"a": [b"aab"], "b": [b"b"]})
    slow = slow_bits({"a": [b"aab"], "b": [b"b"]}, [b"aab", b"bz", b""])
    for got, want in zip(model.bits([b"aab", b"bz", b""]), slow):
        assert list(got) == pytest.approx(want, abs=1e-4)


def slow_bits(texts, asked, order=3):
    import math
    out = []
    for t in asked:
        row = []
        for lang in sorted(texts):
            counts = defaultdict(Counter)
            for x in texts[lang]:
                x = b"\n" * order + x
                for i in range(order, len(x)):
                    for k in range(order + 1):
                        counts[x[i - k:i]][x[i]] += 1
            bits, x = 0.0, b"\n" * order + t
            for i in range(order, len(x)):
                for k in range(order, -1, -1):
                    seen = counts.get(x[i - k:i])
                    if seen and x[i] in seen:
                        bits -= math.log2(seen[x[i]] / (sum(seen.values()) + len(seen)))
                        break
                    if seen:
                        bits -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
                else:
                    bits += 8
            row.append(bits)
        out.append(row)
    return out


# ---------------------------------------------------------------- lines
LINE = "This line is long enough to be counted, forty or more."


def test_lines_of_odd_rows(spark):
    text = f"  {LINE.upper()}\n a\n{LINE}\t\n"
    docs = spark.createDataFrame([(i, text, 1) for i in (1, 2, 3, 4, 5, 5)] + [(None, LINE, 1), (None, None, 1), (7, "", 1)], "doc_id long, text string, n_lines int")
    got = sorted((r.doc_id or -1, r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs).collect())
    assert got == sorted([(i, 4, 2, " a\n") for i in (1, 2, 3, 4)] + [(5, 4, 0, text)] * 2 + [(-1, 1, 1, ""), (-1, 1, 0, ""), (7, 1, 0, "")])
    assert line_dedup(docs.limit(0)).count() == 0
    assert {r.row.n_lines for r in line_dedup(docs, carry=True).collect()} == {1}


def test_below_the_limits_all_stay(spark):
    docs = spark.createDataFrame([(i, f"{LINE}\n{'s' * 39}\nx") for i in range(4)] + [(i, "s" * 39) for i in range(10, 20)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup(docs).collect()} == {0}


def test_repeated_rows_of_a_document_count_once(spark):
    other = LINE.replace("This", "That")
    four = [(1, f"{LINE}\n{i}") for i in range(9)] + [(i, LINE) for i in (2, 3, 4)]
    five = [(i, other) for i in (11, 11, 12, 13, 14)] + [(15, f"{other}\n{other}")] * 3
    got = sorted((r.doc_id, r.n_dropped) for r in line_dedup(spark.createDataFrame(four + five, "doc_id long, text string")).collect())
    assert got == [(1, 0)] * 9 + [(2, 0), (3, 0), (4, 0), (11, 1), (11, 1), (12, 1), (13, 1), (14, 1)] + [(15, 0)] * 3


def test_runs_are_levelled(spark):
    index = LineRuns(spark, fanout=2)
    for b in range(5):
        index.add(spark.createDataFrame([(h, h, 1, 100 - b) for h in range(b, b + 3)], "h1 long, h2 long, n long, keeper long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert sorted((r.h1, r.n, r.keeper) for r in index.table().collect()) == [
        (0, 1, 100), (1, 2, 100), (2, 3, 100), (3, 3, 99), (4, 3, 98), (5, 2, 97), (6, 1, 96)]


# ---------------------------------------------------------------- near copies
def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(str(d), len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed):
    pick = random.Random(seed)
    bases = [[pick.choice("abcdefghijklmnopqrstuvwxyz") * pick.randint(1, 3) for _ in range(pick.choice([2, 12, 40, 120]))] for _ in range(10)]
    rows = []
    for i in range(260):
        w = list(pick.choice(bases[:3] if i % 2 else bases))
        for _ in range(pick.choice([0, 0, 1, 2, 3, 5])):
            w[pick.randrange(len(w))] = pick.choice(["zz", "qq", "ww", "A b"])
        rows.append((i if i % 50 else None, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows + [(1, ""), (7, None), (None, None), (3, " \n"), (3, "one"), (3, "one")]


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_classes(spark, width, percent, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    got = [(str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_classes(docs, width, percent).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, width, percent), key=str)
    assert jaccard_classes(docs.limit(0), width, percent).count() == 0


@pytest.mark.parametrize("width,percent,words", [(3, 90, 11), (5, 80, 8)])
def test_small_sets_link_with_a_larger_one(spark, width, percent, words):
    text = [f"w{i}" for i in range(words)]
    rows = [(1, " ".join(text)), (2, " ".join([*text, "more"])), (3, " ".join(["less", *text])), (4, " ".join(text[:-1])), (5, " ".join([*text[:-1], "x"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()}
    assert got == {i: (n, c) for i, n, c in ((int(i), n, c) for i, n, c in brute(rows, width, percent))} and got[2][1] == 1


def test_one_of_each(spark):
    docs = spark.createDataFrame([(2, "one two three four five six", 1), (1, "one two three four five six", 2), (1, "one two three four five six", 2),
                                  (None, "one two three four five six", 3), (None, "alone", 4), (5, "", 5), (6, None, 6), (6, None, 6)], "doc_id long, text string, component int")
    assert sorted(r.component for r in one_of_each(docs).collect()) == [2, 4, 5, 6, 6]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(5, 3)], "x long, y long")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0 if i <= 20 else 21) for i in range(41)}


# ---------------------------------------------------------------- mixing
def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (None, None, "s"), (2, "", "s"), (3, "x", ""), (None, "y z", "s")], "doc_id long, text string, source string")
    docs = docs.withColumn("taken", docs.doc_id)
    for block in (1, 2, 4096):
        rows = mixed(docs, block=block).collect()
        assert len(rows) == 6 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
        by = defaultdict(int)
        for r in rows:
            by[r.key] += r.taken
        assert all(abs(by[r.key] - r.target) <= 0.5 for r in rows)
    assert mixed(docs.limit(0)).count() == 0 and mix(docs).columns == docs.columns


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 1000), ("", 0)], "key string, source_size long")
    got = {r.key: r.target for r in targets(sizes).collect()}
    total, free = 1.5 * 2010, {"sb": 1, "sc": 2}
    level = (total - 20) / 3
    if level * 2 > 2000:
        level, free = total - 20 - 2000, {"sb": 1}
    assert got == {"sa": 20.0, "": 0.0, "sc": 2000.0, **{k: level * w for k, w in free.items()}}


def test_schedule_is_spread(spark):
    sources = spark.createDataFrame([("a", 1000, 0, 1000.0), ("b", 3000, 1, 3000.0)], "key string, source_size long, number int, target double")
    slots = sorted(schedule(sources, block=10).collect(), key=lambda r: r.slot)
    assert Counter(r.key for r in slots) == {"a": 100, "b": 300}
    assert all(abs(sum(r.key == "a" for r in slots[:n]) - n / 4) < 4 for n in range(0, 400, 7))
    assert sorted(r.block for r in slots if r.key == "a") == list(range(100))


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark, folder):
    from plumbline.session import written
    docs = table(spark, folder, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder), f"test-{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
        if name == "mixing":
            want = Counter({r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixed(before).where("size > 0").collect()})
            assert Counter(r.doc_id for r in docs.collect()) == +want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    assert counts[1] < counts[0] and counts[3] < counts[2]


def test_pipeline_of_an_empty_table(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_shared_ngrams_are_written_before_they_are_joined_and_texts_travel_once(spark, monkeypatch):
    """No query both counts all n-grams and joins them, so their shuffles do not lie on the disk together; of a text only its blankness goes beside its row."""
    plans, write = {}, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    docs = spark.range(60).selectExpr("id AS doc_id", "CASE WHEN id < 2 THEN ' ' ELSE concat_ws(' ', transform(sequence(0, 30), i -> 'w' || (i + id DIV 20 * 5))) || repeat(' x', CAST(id % 2 AS INT)) END AS text")
    kept = jaccard_join.one_of_each(docs)
    counted = [name for name, plan in plans.items() if "count(1) AS df" in plan]
    assert counted == ["ngram-held"]
    window = kept._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1].split("\n")[0:3]
    assert "body" not in str(window)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 20, 40]


def test_plans_of_the_pipeline_stay_small_for_the_driver(spark, folder, monkeypatch):
    """The driver keeps the text of every plan: no table of ratios stands in one, and what names components or schedules is not planned with the rows."""
    from plumbline.llm import components, line_dedup, mixing
    plans = {}

    def note(name, df):
        plans[name] = max(plans.get(name, ""), df._jdf.queryExecution().toString(), key=len)
        return df

    write = quality_rules.written
    for module in (quality_rules, line_dedup, jaccard_join, components, mixing):
        monkeypatch.setattr(module, "written", lambda df, name: write(note(name, df), name))
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write(note(name, stage(spark, docs, folder)), f"test-{name}")
    assert max(map(len, plans.values())) < 100_000, {name: len(plan) for name, plan in plans.items()}
    final = {name: plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Join ") for name, plan in plans.items()}
    assert final["jaccard_join"] == 1 and final["mixing"] == 1


def test_runs_of_lines_are_merged_not_broadcast(spark, monkeypatch):
    plans = []
    write = LineRuns._write
    monkeypatch.setattr(LineRuns, "_write", lambda self, rows, level: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(self, rows, level)))
    index = LineRuns(spark)
    for _ in range(2):
        index.add(spark.range(10).selectExpr("id AS h1", "id AS h2", "1L AS n", "id AS keeper"))
    assert "SortMergeJoin" in plans[1] and "Broadcast" not in plans[1]


def test_ratios_give_the_same_scores_as_a_literal_would(spark):
    ratios = [math.sin(i) for i in range(64)]
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["x"])], "doc_id long, words array<string>")
    literal = F.array(*map(F.lit, ratios))
    total = F.aggregate(F.transform(quality_rules._features(64), lambda b: F.get(literal, b)), F.lit(0.0), lambda a, r: a + r)
    want = rows.withColumn("score", F.when(F.size("words") > 0, total / (2 * F.size("words"))))
    got = quality_rules._scored(rows, ratios)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
