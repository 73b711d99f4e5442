import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchloom.operators import agreement, corpus, curate, dataset, evaluate, html_extract, match, mining, retrieve, sampling, split, topics
from searchloom.plans.ordering import running_totals
from searchloom.sources import readers, writers


def test_clean_questions(spark):
    rows = [(1, "¿que es el sol"), (2, "que es el sol"), (3, "qué es el sol"), (4, "dos palabras"), (5, "mi cancion de hoy letra")]
    got = curate.clean_questions(spark.createDataFrame(rows, "id int, question string"), ["id"])
    assert [(r["id"], r["question"]) for r in got.collect()] == [(3, "qué es el sol")]


def test_passages_are_numbered_after_filtering(spark):
    rows = spark.createDataFrame([("7", "Portal:Oaxaca", "uno dos tres\nuno dos tres cuatro\n\n a  b c\td ")], "id string, title string, text string")
    got = [tuple(r) for r in corpus.passages(rows).collect()]
    assert got == [("7#0", "Portal: Oaxaca", "uno dos tres cuatro"), ("7#1", "Portal: Oaxaca", "a b c d")]


def test_match_prefers_held_then_longest(spark):
    answers = spark.createDataFrame(
        [(1, "T", "hello world"), (2, "T", "hello there"), (3, "T", "!!"), (4, "Portal: P", "sun moon")], "answer_id int, title string, answer string"
    )
    passages = spark.createDataFrame(
        [("a#0", "T", 0, "well, hello"), ("a#1", "T", 1, "say Hello World now"), ("a#2", "T", 2, "hello world"), ("p#0", "Portal: P/x", 0, "the sun moon")],
        "docid string, title string, passage_ix int, text string",
    )
    got = {r["answer_id"]: (r["docid"], round(r["score"], 3)) for r in match.match(answers, passages).collect()}
    assert got == {1: ("a#1", 1.0), 2: ("a#1", 0.545), 4: ("p#0", 1.0)}


def brute_closure(edges, initial):
    train = set(initial)
    while True:
        queries = {q for q, a in edges if a in train}
        more = {a for q, a in edges if q in queries}
        if more <= train:
            return train & {a for _, a in edges}
        train |= more


def test_leakage_closure_is_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(30)]
    initial = [0, 5, 9]
    rows = spark.createDataFrame(edges, "query int, article int")
    got = split.split_by_closure(rows, spark.createDataFrame([(a,) for a in initial], "article int")).collect()
    want = brute_closure(edges, initial)
    assert {r["article"] for r in got if r["split"] == "train"} == want
    train, test = ({(r["query"], r["article"]) for r in got if r["split"] == s} for s in ("train", "test"))
    assert not {q for q, _ in train} & {q for q, _ in test} and not {a for _, a in train} & {a for _, a in test}


def test_running_totals(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("v")).repartition(5)
    got = {r["id"]: r["t"] for r in running_totals(rows, ["id"], "v", "t").collect()}
    total = 0
    for i in range(100):
        total += i % 7
        assert got[i] == total
    ids = sorted((r["id"], r["n"]) for r in corpus.dense_ids(rows, [F.desc("id")], "n", 10).collect())
    assert ids[99] == (99, 10) and ids[0] == (0, 109)


@pytest.mark.parametrize("block_values", [1 << 20, 6])
def test_dense_topk_is_a_full_sort(spark, block_values):
    rng = random.Random(1)
    vectors = [[rng.random() for _ in range(3)] for _ in range(20)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "docid long, embedding array<float>").repartition(3)
    queries = rows.withColumnRenamed("docid", "qid").where("qid < 5")
    got = retrieve.dense_topk(queries, rows, 4, block_values).collect()
    matrix = np.array(vectors, np.float32).astype(np.float64)
    scores = matrix @ matrix.T
    for q in range(5):
        want = sorted(range(20), key=lambda d: (-round(scores[q, d], 9), d))[:4]
        assert [r["docid"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_perfect_ranking_scores_one(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("r", "c", 1)], "qid string, docid string, rel int")
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, docid string, rank int")
    rows = {r["qid"]: r for r in evaluate.per_query(run, qrels, 10).collect()}
    assert rows["q"]["ndcg"] == rows["q"]["recall"] == rows["q"]["ap"] == rows["q"]["rr"] == 1.0
    assert rows["r"]["ndcg"] == rows["r"]["recall"] == 0.0
    judged = evaluate.summary(run, qrels, [10]).first()
    evaluated = evaluate.summary(run, qrels, [10], "evaluated").first()
    assert judged["recall"] == 0.5 and evaluated["recall"] == 1.0


def test_fewer_negatives_are_filled(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, docid long, rank int")
    qrels = spark.createDataFrame([(1, 10, 1), (1, 12, 1)], "qid long, docid long, rel int")
    queries = spark.createDataFrame([(1, "q")], "qid long, query string")
    row = mining.training_samples(queries, run, qrels, 4, 50).first()
    ids = row["negatives"]["doc_id"]
    assert len(ids) == len(set(ids)) == 4 and 11 in ids and not {10, 12} & set(ids)
    assert row["positives"]["doc_id"] == [10, 12]


def test_strong_positives(spark):
    row = spark.createDataFrame([([1, 2, 3], [0.5, 0.9, 0.1], [0.2])], "d array<int>, s array<double>, n array<double>")
    assert row.select(mining.strong_positives(F.col("d"), F.col("s"), F.col("n")).alias("x")).first()["x"] == [1, 2]


PAGES = {
    "feat": ('<h2>Fragmento destacado de la web</h2><div><div role="heading"><span>long <b>short</b></span></div><div class="g"><a href="u">x</a></div></div>', ("feat_snip", "short", "long short", "u")),
    "links": ('<h2>Fragmento destacado de la web</h2><div><div role="heading"><span>a<div>site › x</div>b</span></div><a href="u">x</a></div>', ("feat_snip", None, "ab", "u")),
    "list": ('<h2>fragmento destacado de la web</h2><div><b>s</b><ol><li>1</li><li>2</li></ol><a href="u"></a></div>', ("rich_list", "s", "1\n2", "u")),
    "set": ('<h2>fragmento destacado de la web</h2><div><ol role="x"></ol><ul><li>1</li></ul></div>', ("rich_set", None, "1", None)),
    "snip": ("<h2>fragmento destacado de la web</h2><div><b>s</b></div>", ("rich_snip", "s", None, None)),
    "unit": ("<h2>Conversor de unidades</h2>", ("unit_conv", "", None, None)),
    "money": ('<div><h2>conversor de divisas</h2><select><option>x</option></select><input value="5"><option selected="1">EUR</option></div>', ("curr_conv", "5 EUR", None, None)),
    "words": ('<div><h2>translation result</h2><pre id="tw-target-text">hi</pre></div>', ("tr_result", "hi", None, None)),
    "time": ('<div><h2>hora local</h2><div class="vk_bk x"> 5:00 </div></div>', ("localtime", "5:00", None, None)),
    "conv": ('<div><h2>conversión de hora local</h2><div class="vk_bk"> 5 </div></div>', ("time_conv", " 5 ", None, None)),
    "date": ('<div><h2>resultado de fechas</h2><div><div role="heading"><div><div>d1</div><div>d2</div></div></div></div></div>', ("date", "d1", "d1 - d2", None)),
    "know": ('<div class="kp-header"><div class="gsrt"><div>A</div></div></div><div><span>L</span><a href="k"></a></div>', ("knowledge", "A", "L", "k")),
    "bare": ('<div class="kp-header"><div class="gsrt"><div>A</div></div></div>', ("knowledge", "A", None, None)),
    "desc": ('<div data-attrid="description"><h3>Descripción</h3><span>D</span><a href="k"></a></div>', ("descript", None, "D", "k")),
    "over": ('<h2>Overview</h2><a href="z">first</a>', ("overview", "first", None, None)),
    "none": ("<p>nothing</p>", ("no_answer", None, None, None)),
    "people": ("<h2>People also ask</h2>", ("no_answer", None, None, None)),
    "local": ("<h2>resultados locales</h2>", ("local_rst", None, None, None)),
    "health": ('<div><h2>resultados adicionales</h2><div><a href="?p=medical_conditions"></a></div></div>', ("other_health", None, None, None)),
    "other": ("<div><h2>resultados adicionales</h2><div></div></div>", ("other", None, None, None)),
    "unknown": ("<h2>otra cosa</h2>", (None, None, None, None)),
}


@pytest.mark.parametrize("name", PAGES)
def test_html_rules(name):
    page, want = PAGES[name]
    kind, short, long, _, url, expanded = html_extract.extract(page)
    assert (kind, short, long, url) == want and expanded is False


def test_html_over_rows(spark):
    rows = spark.createDataFrame([("<p>Se incluyen resultados de x</p>",), (None,)], "html string")
    got = [r["a"] for r in rows.select(html_extract.extract_answer("html").alias("a")).collect()]
    assert got[0]["expanded_search"] is True and got[1]["answer_type"] is None
    assert html_extract.page_body('<div id="rcnt">x<b>y</b></div>') == "xy"


def test_ratings(spark):
    rows = spark.createDataFrame([("a", 1, "1", "0", "1"), ("b", 1, "x", "0", "1"), ("c", 1, "2", "0", "1")], "rater string, item int, correct string, unambiguous string, relevant string")
    assert [r["rater"] for r in agreement.valid_ratings(rows).collect()] == ["a"]
    votes = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1)], "item int, f int")
    assert {r["item"]: r["f"] for r in agreement.majority(votes, ["f"]).collect()} == {1: 0, 2: 1}


def test_identical_raters_have_kappa_one(spark):
    rows = spark.createDataFrame([(i, r, i % 2) for i in range(6) for r in ("a", "b")], "item int, rater string, value int")
    assert agreement.pairwise(rows).first()["kappa"] == 1.0 and agreement.pairwise(rows).first()["f1"] == 1.0
    assert agreement.fleiss_kappa(rows).first()["kappa"] == 1.0


def test_unknown_answers_raise(spark):
    records = spark.sql("SELECT '1' AS id, map('v', array(struct('u' AS user_id, 'quizás' AS value))) AS responses")
    with pytest.raises(Exception, match="unknown answer"):
        agreement.flat_annotations(records, ["v"]).collect()


@settings(max_examples=5, deadline=None)
@given(st.integers(1, 5), st.integers(1, 4))
def test_samples_dont_overlap(spark, parts, each):
    rows = sampling.disjoint(spark.range(60).withColumnRenamed("id", "k"), "k", 3, parts, each).collect()
    assert len({r["k"] for r in rows}) == len(rows) == 3 + parts * each


def test_reshaping(spark):
    rows = spark.createDataFrame([("q", ["a", "b"], [0.2, 0.1])], "qid string, ids array<string>, sims array<double>")
    assert [(r["rank"], r["ids"]) for r in sampling.unpacked(rows, ["qid"], ["ids", "sims"]).collect()] == [(1, "a"), (2, "b")]
    order = spark.createDataFrame([("z",), ("full",), ("a",)], "c string").orderBy(*sampling.custom_order(F.col("c"), ["full"]))
    assert [r["c"] for r in order.collect()] == ["full", "a", "z"]


def test_clusters_and_components(spark):
    rows = spark.createDataFrame([(i, [float(i > 4) * 9, float(i % 2), 1.0]) for i in range(10)], "id int, v array<float>")
    got = topics.clusters(rows, "v", 2).collect()
    assert len({r["topic"] for r in got if r["id"] > 4}) == 1
    assert len(topics.reduced(rows, "v", 2).first()["reduced"]) == 2


def test_merges_are_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    batch = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "id int, x string, y int")
    once = writers.upsert(target, batch, "id", ["x"])
    assert sorted(map(tuple, writers.upsert(once, batch, "id", ["x"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 9)]
    repeated = batch.union(spark.createDataFrame([(3, "e", 8)], batch.schema))
    assert sorted(map(tuple, writers.insert_ignore(target, repeated, "id", ["y"]).collect())) == [(1, "a", 1), (2, "b", 2), (3, "e", 8)]


def test_files_come_back(spark, tmp_path):
    (tmp_path / "questions_mx.txt").write_text("que es\t2024-01-02\t5\t1\nque no\t2024-01-03\n")
    got = sorted(map(tuple, readers.questions(spark, str(tmp_path / "questions_*.txt")).select("question", "relevance", "country").collect()))
    assert got == [("que es", 5, "mx"), ("que no", None, "mx")]
    assert [r["question"] for r in readers.previous_results(spark, str(tmp_path / "questions_mx.txt")).orderBy("question").collect()] == ["que es", "que no"]
    (tmp_path / "x.log").write_text("prefix='que ': searching\nnoise\n** 'que a': localization_works=False\nprefix='que ': searching\n")
    assert [r["prefix"] for r in readers.past_queries(spark, str(tmp_path / "*.log")).collect()] == ["que "]
    assert [r["prefix"] for r in readers.past_general_prefixes(spark, str(tmp_path / "*.log")).collect()] == ["que a"]
    (tmp_path / "preds.tsv").write_text("q\td\t3\nq\te\t1\t0.5\n")
    assert {(r["pid"], r["score"]) for r in readers.predictions(spark, str(tmp_path / "preds.tsv")).collect()} == {("d", 0.3333), ("e", 0.5)}
    (tmp_path / "bm25_mx.txt").write_text("recall_100 all 0.5\nmap all 0.1\nndcg_cut_10 all 0.25\n")
    assert sorted(map(tuple, readers.evaluations(spark, str(tmp_path / "bm25_mx.txt")).collect())) == [("bm25", "mx", "ndcg_cut_10", 0.25), ("bm25", "mx", "recall_100", 0.5)]
    rows = spark.createDataFrame([("1", "T", "x")], "docid string, title string, text string")
    writers.jsonl_shards(rows, str(tmp_path / "docs"))
    assert list(map(tuple, readers.passages(spark, str(tmp_path / "docs")).collect())) == [("1", "T", "x")]
    run = spark.createDataFrame([("q", "d", 1, 0.5)], "qid string, docid string, rank int, score double")
    writers.write_run(run, str(tmp_path / "run"))
    assert readers.run(spark, str(tmp_path / "run")).first()["docid"] == "d"


def test_corrupt_batches_are_skipped(spark, tmp_path):
    import gzip

    (tmp_path / "mx_htmls_1.json.gz").write_bytes(gzip.compress(b'[{"id": 1, "date": "2024-01-01", "html": "<p>"}]'))
    (tmp_path / "htmls_2.json.gz").write_bytes(gzip.compress(b'[{"id": 2, "date": "2024-01-01", "html": "<b>"}]'))
    (tmp_path / "ar_htmls_3.json.gz").write_bytes(b"not gzip")
    got = sorted((r["id"], r["country"]) for r in readers.page_batches(spark, str(tmp_path / "*.json.gz")).collect())
    assert got == [(1, "mx"), (2, "")]


def test_encoding_resumes(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "bb")], "id string, text string")
    stored = spark.createDataFrame([("2",)], "id string")
    new = corpus.not_encoded(rows, stored)
    got = corpus.embed_batches(new, lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [(r["id"], r["embedding"]) for r in got] == [("1", [1.0])]


def test_plans(spark, folder):
    from searchloom.plans import catalogue

    plan = catalogue.queries()["anti_join_incremental"](spark, folder)._jdf.queryExecution().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan
    plan = catalogue.queries()["prefix_topk_per_group"](spark, folder)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = catalogue.queries()["star_join_matched"](spark, folder)._jdf.queryExecution().toString()
    assert "GreaterThan(l_discount,0.05)" in plan and "CartesianProduct" not in plan


def test_judged_dataset(spark):
    queries = spark.createDataFrame([(1, "que es", "general"), (2, "como brainly", "mx"), (3, "por que", "mx")], "id int, question string, country string").selectExpr("*", "DATE'2024-01-01' AS date")
    pages = spark.sql("SELECT id, DATE'2024-02-01' AS date FROM VALUES 1, 2, 3 AS t(id)")
    found = spark.createDataFrame([(1, "a#1", 0.50001, True, "feat_snip"), (2, "a#1", 0.9, False, "descript"), (3, "a#1", 0.5, False, "descript")], "id int, corpus_docid string, match_score double, expanded_search boolean, answer_type string")
    passages = spark.createDataFrame([("a#1", "T", "x"), ("a#1", "T", "x")], "docid string, title string, text string")
    (row,) = dataset.judged_dataset(queries, pages, found, passages).collect()
    assert (row["country"], row["docid_text"], row["match_score"]) == ("no_country", "x", 0.5)
    contents, ids = dataset.training_passages(passages.distinct())
    assert ids.first()["new_id"] == "0" and contents.first()["contents"] == "x"


def test_collections(spark):
    rows = spark.createDataFrame([("q", "d1 d2 d1")], "qid string, ids string")
    assert {r["docid"] for r in dataset.listed_qrels(rows, "qid", "ids").collect()} == {"d1", "d2"}
    wide = spark.createDataFrame([(1, "q", 7, "t"), (1, "q", 8, "u"), (1, "q", 7, "t")], "qid int, q string, d int, t string")
    corpus_, topics_, qrels = dataset.wide_collection(wide, "qid", "q", "d", "t")
    assert (corpus_.count(), topics_.count(), qrels.count()) == (2, 1, 2)
    triples = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "qid string, positive string")
    assert tuple(dataset.triples_stats(triples, spark.createDataFrame([("a",)], "qid string")).first()) == (1, 1)


def test_token_bounds(spark):
    import public_tokenizers

    from searchloom.functions import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([("one two three",), ("",), (None,)], "t string")
    got = rows.select(tokens.token_length(path, 2)("t").alias("n"), tokens.truncated(path, 2)("t").alias("c")).collect()
    assert [tuple(r) for r in got] == [(2, "one two"), (0, ""), (None, None)]


def test_reduction_and_clusters(spark, folder):
    """Components keep what numpy's do; every vector is in the cluster of the nearest mean."""
    import numpy as np

    from searchloom.operators import topics

    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    given = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    data = np.stack([given[i] for i in sorted(given)])
    got = {r["vec_id"]: np.array(r["reduced"]) for r in topics.reduced(rows, "embedding", 8).collect()}
    kept = np.var(np.stack([got[i] for i in sorted(got)]), axis=0).sum()
    centred = data - data.mean(axis=0)
    want = (np.linalg.svd(centred, compute_uv=False)[:8] ** 2).sum() / len(data)
    assert abs(kept - want) < 1e-6 * want
    labels = {r["vec_id"]: r["topic"] for r in topics.clusters(rows, "embedding", 5).collect()}
    means = {t: np.mean([given[i] for i in given if labels[i] == t], axis=0) for t in set(labels.values())}
    near = sum(min(means, key=lambda t: ((given[i] - means[t]) ** 2).sum()) == labels[i] for i in given)
    assert len(means) == 5 and near >= 0.95 * len(given)
