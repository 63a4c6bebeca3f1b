"""Hand-computed cases, truth tables, round trips and properties of the text engine."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import layout, text
from lexiforge.operators import boolean, codec, correct, errmodel, gate, index, lm, trie
from lexiforge.plans import saved
from lexiforge.sources import crawl, querylog
from lexiforge.streaming import stream

DOCS = [(0, "red bolt"), (1, "Red gear"), (2, "blue gear bolt"), (3, "foo_bar"), (4, "")]
CASES = {
    "red&bolt": [0], "red|gear": [0, 1, 2], "!red": [2, 3, 4], "bolt&!red": [2], "red|!gear": [0, 1, 3, 4], "!red&!gear": [3, 4], "foo_bar": [3], " RED & bolt ": [0],
    "!red|!gear": [0, 2, 3, 4], "!!(red&bolt)": [0], "red|!zzz": [0, 1, 2, 3, 4], "zzz": [], "red|bolt&gear": [0, 1, 2], "(red|bolt)&gear": [1, 2], "bolt&!!red": [0],
}
LOG = ["red bolt", "red bot\tred bolt", "blu gear\tblue gear", "red gear", "redbolt\tred bolt", "bojt\tbolt"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def log(spark):
    lines = spark.createDataFrame([(x,) for x in LOG], "value string")
    return querylog.parse_lines(lines).withColumn("qid", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def models(log):
    uni = lm.unigrams(lm.tokens(log))
    pairs = errmodel.word_pairs(log)
    return uni, lm.bigrams(log, uni), lm.meta(lm.tokens(log)), errmodel.edit_costs(errmodel.edit_counts(pairs)), errmodel.seen_contexts(pairs), trie.trie(uni)


def found(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("query", CASES)
def test_boolean_cases(docs, query):
    tree, p = boolean.parse(query), index.postings(docs)
    assert found(boolean.search(tree, p, docs)) == CASES[query]
    assert found(boolean.search_scan(tree, docs)) == CASES[query]
    assert found(boolean.search_sets(tree, p, docs)) == CASES[query]
    assert found(boolean.search_arrays(tree, index.posting_lists(p), docs)) == CASES[query]


@pytest.mark.parametrize("query", ["red bolt", "red&", "(red", "?", "", "a?", ")", "a||b"])
def test_parse_errors(query):
    with pytest.raises(boolean.QueryError):
        boolean.parse(query)


def test_truth_tables(spark):
    """Every tree of depth 2 over three terms, in one batch, against plain evaluation."""
    terms = ["a", "b", "c"]
    docs = [(i, " ".join(t for j, t in enumerate(terms) if i >> j & 1)) for i in range(8)]
    level = [t for x in terms for t in (x, f"!{x}")]
    level += [f"{n}({a}{o}{b})" for a, b in itertools.product(level, repeat=2) for o in "&|" for n in ("", "!")]
    queries = level + [f"{a}{o}{b}" for a, b in random.Random(1).choices(list(itertools.product(level, repeat=2)), k=60) for o in "&|"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["qid"], r["doc_id"]) for r in boolean.search_batch(list(enumerate(queries)), index.postings(df), df).collect()}
    want = {(q, i) for q, s in enumerate(queries) for i, t in docs if eval(s.replace("!", " not ").replace("&", " and ").replace("|", " or "), {}, {x: x in t for x in terms})}
    assert got == want


def test_batch_errors(docs):
    rows = boolean.search_batch([(0, "red"), (1, "red bolt")], index.postings(docs), docs).collect()
    assert {(r["qid"], r["doc_id"], r["error"] is None) for r in rows} == {(0, 0, True), (0, 1, True), (1, None, False)}


def test_index_prunes(spark, docs, tmp_path):
    index.sorted_postings(docs).write.parquet(str(tmp_path / "i"))
    plan = boolean.search(boolean.parse("red&bolt"), spark.read.parquet(str(tmp_path / "i")), docs)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan


def test_simple9():
    assert codec.encode([0, 1, 5, 40, 20000]) == [0x80004E20, 0x55014080] and codec.encode([20000]) == [0x80004E20]
    edges = [0, 1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 127, 128, 511, 512, 16383, 16384, 2**28 - 1]
    rnd = random.Random(0)
    lists = [edges, [], *[[e] for e in edges], *[sorted(rnd.sample(range(top), min(n, top))) for top in (2, 30, 600, 2**28) for n in (1, 2, 7, 28, 29, 300)]]
    for x in lists:
        assert codec.decode(codec.encode(x), len(x)) == x
    with pytest.raises(ValueError):
        codec.encode([2**28])


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(layout.swap(F.lit("ghbdtn")).getField("text")) == "привет" and get(layout.swap(F.lit("руддщ")).getField("text")) == "hello"
    assert get(layout.swap(F.lit("???")).getField("changed")) is False
    assert get(text.restore_case(F.lit("AbC"), F.lit("xyz"))) == "XyZ" and get(text.restore_case(F.lit("Abc"), F.lit("xy"))) == "xy"
    assert get(text.separators(F.lit("a, b!"))) == [", ", "!"]
    assert get(text.extract_url(F.lit("https://x.y"))) is None and get(text.extract_url(F.lit("h http://x.y/z?q=1 "))) == "http://x.y/z?q=1"
    assert get(text.clean_text(F.lit(".a b\nc"))) == "a b c"
    assert get(text.query_words(F.lit("Foo_bar Ё1"))) == ["foo", "bar", "ё1"] and get(text.query_words_cased(F.lit("Foo_b"))) == ["Foo", "b"]
    assert len(set(layout.LATIN)) == len(set(layout.CYRILLIC)) == 74
    assert get(text.restore_separators(F.lit("ab cd"), F.array(F.lit("ab"), F.lit("cd")), F.array(F.lit(", ")), F.array(F.lit("Xy"), F.lit("zW")))) == "Ab, cD"


def test_log_and_language_model(log, models):
    assert [(r["wrong"], r["right"], r["ncols"]) for r in log.orderBy("qid").collect()][1] == ("red bot", "red bolt", 2)
    assert querylog.labelled(log).count() == 10
    uni, bi, facts, *_ = models
    assert {r["word"]: r["cnt"] for r in uni.collect()} == {"red": 4, "bolt": 4, "gear": 2, "blue": 1}
    assert {(r["w1"], r["w2"]): r["p"] for r in bi.collect()} == {("red", "bolt"): 0.75, ("blue", "gear"): 0.5, ("red", "gear"): 0.5}
    queries = uni.sparkSession.createDataFrame([(0, "red bolt"), (1, "blue gear"), (2, "blue bolt"), (3, "zzz"), (4, "")], "qid long, text string")
    got = {r["qid"]: r["prob"] for r in lm.query_probability(queries, uni, bi, facts).collect()}
    assert got == pytest.approx({0: 3 / 11, 1: 1 / 11, 2: 4 / 121, 3: 1 / 11, 4: 0})


def test_repeated_and_null_ids(spark, models):
    """Rows of equal or null ids are rows of their own."""
    uni, bi, facts, *_ = models
    texts = [(1, "red bolt"), (1, "red bolt"), (1, "blue"), (None, "red bolt"), (None, None), (2, ""), (3, "  !")]
    queries = spark.createDataFrame([(i, t, "x") for i, t in texts], "qid long, text string, prob string")
    got = sorted((str(r["qid"]), round(r["prob"], 9)) for r in lm.query_probability(queries, uni, bi, facts).collect())
    p = {"red bolt": 3 / 11, "blue": 1 / 11}
    assert got == sorted((str(i), round(p.get(t, 0.0), 9)) for i, t in texts)
    found = [(r["qid"], round(r["prob"], 9), r["n_chars"], r["n_words"], r["n_other"], r["n_known"]) for r in lm.features(queries, uni, bi, facts).collect()]
    want = [(i, round(p.get(t, 0.0), 9), len(t or ""), len((t or "").strip(" !").split()), sum(c in " !" for c in t or ""), (t or "").count("red") + (t or "").count("bolt")) for i, t in texts]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_lines_of_three_columns(spark):
    log = querylog.parse_lines(spark.createDataFrame([("a b\tc d\te f",), ("bot\tbolt",), ("red",)], "value string")).withColumn("qid", F.lit(0))
    assert {(r["text"], r["need_fix"]) for r in querylog.labelled(log).collect()} == {("a b", 0), ("bot", 1), ("bolt", 0), ("red", 0)}
    assert [(r["right"], r["wrong"]) for r in errmodel.word_pairs(log).collect()] == [("bolt", "bot")]


def test_close_words(spark):
    rnd = random.Random(4)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 7))) for _ in range(70)} | {"abcd", "abxy", "xbcy"})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, last = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(last[j] + (c != d), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "word string")
    for most in (1, 2, 3):
        got = {tuple(r) for r in trie.close_words(df, df, most).collect()}
        assert got == {(a, b) for a in words for b in words if distance(a, b) <= most}


def test_argmax_and_lookahead(spark, models):
    uni, bi, facts, *_ = models
    rows = [(1, 0, "zzz", 0.5), (1, 1, "red", 0.5), (1, 2, "bolt", 0.5), (2, 0, "red bolt", 0.1), (2, 1, "gear", 0.2), (3, 1, "bolt", 0.3), (3, 0, "red", 0.3), (4, 0, "", 0.0)]
    got = {tuple(r) for r in lm.argmax(spark.createDataFrame(rows, "qid long, idx int, text string, score double"), uni, facts, ["qid"]).collect()}
    assert got == {(1, "red"), (2, "gear"), (3, "red"), (4, "")}
    cands = spark.createDataFrame([(1, 0, 0, "red"), (1, 0, 1, "blue"), (1, 1, 0, "bolt"), (1, 1, 1, "gear")], "qid long, pos int, idx int, word string")
    found = {r["word"]: r["score"] for r in lm.lookahead(cands, uni, bi, facts).collect()}
    assert found == pytest.approx({"red": 3 / 11, "blue": 1 / 11})


def test_simple9_blobs(spark):
    rnd = random.Random(5)
    rows = [(t, i) for t, top in (("a", 40), ("b", 10**6), ("c", 2**40), ("d", 70_000)) for i in sorted({rnd.randrange(top) for _ in range(500)})]
    df = spark.createDataFrame(rows, "term string, doc_id long").repartition(3)
    blobs = codec.blocks(df)
    assert sorted(map(tuple, codec.postings_of(blobs).collect())) == sorted(rows)
    for r in blobs.collect():
        own = [i - r["part"] * codec.RANGE for t, i in rows if t == r["term"] and i // codec.RANGE == r["part"]]
        assert r["n"] == len(own) and [int.from_bytes(r["words"][k : k + 4], "little") for k in range(0, len(r["words"]), 4)] == codec.encode(own)


def test_saved_index_and_models(spark, docs, log, models, tmp_path):
    """What was written is found by a session that knows the folder alone; the gate decides as it did."""
    urls = spark.createDataFrame([(i, f"http://u/{i}") for i, _ in DOCS], "doc_id long, url string")
    saved.save_index(docs, urls, str(tmp_path / "i"))
    own = saved.load_index(spark.newSession(), str(tmp_path / "i"))
    for query, want in CASES.items():
        assert found(boolean.search(boolean.parse(query), own.postings, own.ids)) == want
    assert sorted(map(tuple, codec.postings_of(own.blobs).collect())) == sorted(map(tuple, own.postings.select("term", "doc_id").collect()))
    assert [r["line"] for r in boolean.result_lines(boolean.search(boolean.parse("red"), own.postings, own.ids), own.urls).collect()] == ["2", "http://u/0", "http://u/1"]
    uni, bi, facts, costs, contexts, nodes = models
    rows = lm.features(querylog.labelled(log).withColumn("qid", F.monotonically_increasing_id()), uni, bi, facts)
    trained = gate.train(rows, 3)
    saved.save_models(saved.Models(uni, bi, costs, contexts, nodes, trained), str(tmp_path / "m"))
    m = saved.load_models(spark.newSession(), str(tmp_path / "m")).collected()
    assert m.counts == correct.collect_model(uni, bi, costs, contexts, nodes).counts
    for r in gate.predict(trained, rows).join(rows, "qid").collect():
        assert m.gate.p_fine([r[c] for c in gate.COLUMNS]) == pytest.approx(r["p_fine"])
    saved.save_models(saved.Models(uni, bi, costs, contexts, nodes), str(tmp_path / "m2"))
    assert saved.load_models(spark, str(tmp_path / "m2")).gate is None


def test_model_bound(models, monkeypatch):
    uni, bi, _, costs, contexts, nodes = models
    monkeypatch.setattr(correct, "MAX_ROWS", 5)
    with pytest.raises(ValueError):
        correct.collect_model(uni, bi, costs, contexts, nodes)


def test_correction_uses_all_tasks(spark, models):
    uni, bi, _, costs, contexts, nodes = models
    m = correct.collect_model(uni, bi, costs, contexts, nodes)
    words = spark.createDataFrame([(f"word{i}",) for i in range(200)], "text string")
    tasks = correct._over_distinct(spark, words, m, lambda x, t: [(t,)], "text string, same string", tasks=7).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == 7


def test_error_model(models, log):
    *_, costs, contexts, _ = models
    assert {(r["ctx"], r["tgt"]): r["cost"] for r in costs.collect()} == {("ol", "o_"): 0.5, ("ol", "oj"): 0.5, ("ue", "u_"): 0.0}
    assert {r["ctx"] for r in contexts.collect()} == set("ed re ^r lt ol bo ^b ue lu bl ar ea ge ^g".split())
    one = {(r["ctx"], r["tgt"], r["cnt"]) for r in errmodel.single_edit_counts(errmodel.word_pairs(log)).collect()}
    assert one == {("ol", "o_", 2), ("ol", "oj", 2), ("ue", "u_", 2)}
    assert errmodel.edit_keys("abc", "xabc") == [("^_", "^x")] and errmodel.edit_keys("abc", "") == [("^a", "^_"), ("ab", "a_"), ("bc", "b_")]
    got = {r["wrong"]: r["prob"] for r in errmodel.edit_probability(errmodel.word_pairs(log), costs).collect()}
    assert got["bot"] == pytest.approx(1.2**-0.5) and got["red"] == pytest.approx(1 / 1.2)


def test_edit_scripts_rebuild():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(2))
        out, at = [], 0
        for op, i, j in errmodel.edit_script(a, b):
            out.append(a[at:i])
            at = i + (op != "insert")
            out.append("" if op == "delete" else b[j])
        assert "".join(out) + a[at:] == b


def test_trie(models):
    assert {r["prefix"]: r["cnt"] for r in models[-1].collect()} == {p: n for n, ps in ((4, "r re red"), (5, "b"), (4, "bo bol bolt"), (1, "bl blu blue"), (2, "g ge gea gear")) for p in ps.split()}


def test_correction(spark, models, log):
    uni, bi, _, costs, contexts, nodes = models
    m = correct.collect_model(uni, bi, costs, contexts, nodes)
    assert m.probability(["red", "bolt"]) == pytest.approx(3 / 11)
    assert "bolt" in [w for _, w in correct.fuzzy_search(m, "bojt")] and correct.fuzzy_search(m, "abc") == [(0.0, "abc")]
    assert correct.correct(m, "Red, Bojt!") == "Red, Bolt!"
    assert correct.correct(m, "кув ищде") == "red bolt"
    assert correct.correct(m, "") == "" and correct.correct(m, "a b c d e f g h i") == "a b c d e f g h i"
    assert m.known("red") and not m.known("blue")
    m.gate = lambda f: True
    assert correct.correct(m, "Red, Bojt!") == "Red, Bojt!"
    m.gate = None
    rows = spark.createDataFrame([(1, "red bojt"), (2, "red bojt"), (3, None)], "qid long, text string")
    assert {(r["qid"], r["fixed"]) for r in correct.correct_queries(spark, rows, m).collect()} == {(1, "red bolt"), (2, "red bolt"), (3, None)}


def test_score_matches_column(spark, models):
    uni, bi, _, costs, contexts, nodes = models
    m = correct.collect_model(uni, bi, costs, contexts, nodes)
    got = spark.range(1).select(lm.score(F.lit(0.5), F.lit(4), F.lit(4 / 11))).first()[0]
    assert got == pytest.approx(m.score(0.5, 4, "bolt")) and got == pytest.approx(0.025 * 2 - 0.5 * math.log2(1.2) + 25 * math.log2(1 + 4 / 11))


def test_folds_and_balance(spark):
    rows = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "qid long, need_fix int")
    for train, test in gate.folds(rows, 3):
        n = {r["need_fix"]: r["count"] for r in train.groupBy("need_fix").count().collect()}
        assert test.count() and abs(n[0] - n[1]) < 40


def test_crawl(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.gz").write_bytes(crawl.write_records([("h http://a/1 x", ".one\ntwo"), ("x", ".y")]))
    (tmp_path / "b" / "c.gz").write_bytes(crawl.write_records([("http://b/2", ".three")]))
    paths = [str(tmp_path / "a.gz"), str(tmp_path / "b")]
    rows = [(r["doc_id"], r["url"], r["text"]) for r in crawl.read_crawl(spark, paths).orderBy("doc_id").collect()]
    assert rows == [(0, "http://a/1 x", "one two"), (1, None, ""), (2, "http://b/2", "three")]
    assert crawl.read_crawl(spark, [paths[0], paths[0]]).count() == 4


def test_streams_match_batch(spark, docs, models, log, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("red&bolt\n\n!red\nred bolt\nred&bolt\n")
    stream.search_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), index.postings(docs), docs)
    rows = sorted((r["line"], r["query"], r["doc_id"], r["error"] is None) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [(0, "red&bolt", 0, True), (2, "!red", 2, True), (2, "!red", 3, True), (2, "!red", 4, True), (3, "red bolt", None, False), (4, "red&bolt", 0, True)]
    uni, bi, _, costs, contexts, nodes = models
    m = correct.collect_model(uni, bi, costs, contexts, nodes)
    stream.correct_stream(spark, str(tmp_path / "in"), str(tmp_path / "o2"), str(tmp_path / "ck2"), m)
    texts = ["red&bolt", "", "!red", "red bolt", "red&bolt"]
    assert [(r["line"], r["text"], r["fixed"]) for r in spark.read.parquet(str(tmp_path / "o2")).orderBy("file", "line").collect()] == [(i, t, correct.correct(m, t)) for i, t in enumerate(texts)]


def test_projection_and_f1(spark, log, models):
    """Projected rows have the lengths and angles that the singular values give; folds have their F1."""
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["red bolt", "red gear", "blue gear", "blue bolt gear", "red red bolt"])], "qid long, text string")
    vectors = gate.tfidf(texts)[1]
    rows = {r["qid"]: list(r[1:]) for r in gate.projected(vectors, 4).collect()}
    full = {r["qid"]: r["vector"].toArray() for r in vectors.collect()}
    for a in rows:
        for b in rows:
            assert sum(x * y for x, y in zip(rows[a], rows[b])) == pytest.approx(float(full[a] @ full[b]))
    rows = spark.createDataFrame([(i, float(i % 2), 1, 1, 1, 1, i % 2) for i in range(40)], "qid long, prob double, n_chars int, n_words int, n_other int, n_known int, need_fix int")
    assert [r["f1"] for r in gate.f1_of_folds(rows, 2, 2).collect()] == [1.0, 1.0]


def test_tfidf_by_hand(spark):
    """log((1 + n) / (1 + df)) + 1, times counts, scaled to length 1; single characters are no words."""
    texts = ["red bolt a", "red red gear", "Blue"]
    model, vectors = gate.tfidf(spark.createDataFrame(list(enumerate(texts)), "qid long, text string"))
    df = {"red": 2, "bolt": 1, "gear": 1, "blue": 1}
    for r in vectors.collect():
        words = [w for w in texts[r["qid"]].lower().split() if len(w) > 1]
        raw = {w: words.count(w) * (math.log(4 / (1 + df[w])) + 1) for w in words}
        size = math.sqrt(sum(x * x for x in raw.values()))
        got = {model.stages[1].vocabulary[i]: x for i, x in enumerate(r["vector"].toArray().tolist()) if x}
        assert got == pytest.approx({w: x / size for w, x in raw.items()})


def test_tfidf_keeps_all_words(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i * 1000 + j}" for j in range(1000))) for i in range(18)], "qid long, text string")
    model, vectors = gate.tfidf(texts)
    assert len(model.stages[1].vocabulary) == 18_000
    assert [round(r["singular_value"], 6) for r in gate.svd(vectors, 3).collect()] == [1.0, 1.0, 1.0]
