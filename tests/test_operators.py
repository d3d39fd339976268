import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import bm25, conversion, corpus, dense, evaluation, finetune, fusion, graphs, ranking, rerank, significance

RUN = "topic_id string, visual_id string, score double"
QRELS = "topic_id string, visual_id string, grade int"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ties_are_broken_by_id_as_string(spark):
    run = frame(spark, [("t", "10", 1.0), ("t", "9", 1.0), ("t", "8", 2.0)], RUN)
    got = {r["visual_id"]: r["rank"] for r in ranking.ranked(run).collect()}
    assert got == {"8": 1, "9": 2, "10": 3}
    assert ranking.truncate(run, 0).count() == 3 and ranking.truncate(run, 2).count() == 2


def test_minmax_of_a_constant_is_one(spark):
    run = frame(spark, [("t", "a", 3.0), ("t", "b", 3.0), ("u", "a", 1.0), ("u", "b", 2.0), ("u", "c", 4.0)], RUN)
    got = {(r["topic_id"], r["visual_id"]): r["norm"] for r in ranking.minmax(run).collect()}
    assert got[("t", "a")] == got[("t", "b")] == 1.0 and got[("u", "b")] == pytest.approx(1 / 3)


def test_measures_by_hand(spark):
    qrels = frame(spark, [("t", "a", 3), ("t", "b", 2), ("t", "c", 0), ("t", "d", 1), ("v", "a", 2)], QRELS)
    run = frame(spark, [("t", "x", 9.0), ("t", "c", 8.0), ("t", "a", 7.0), ("t", "d", 6.0), ("w", "a", 1.0)], RUN)
    got = {r["topic_id"]: r for r in evaluation.per_topic(run, qrels).collect()}
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert got["t"]["ndcg"] == pytest.approx((3 / math.log2(3) + 1 / 2) / ideal)
    assert got["t"]["ap"] == pytest.approx((1 / 2) / 2) and got["t"]["p10"] == 0.1 and got["v"]["ndcg"] == 0
    cuts = {r["topic_id"]: r for r in evaluation.at_cuts(run, qrels, mode="standard").collect()}
    assert cuts["t"]["bpref"] == pytest.approx((1 - 1 / 2) / 2) and cuts["t"]["map_5"] == pytest.approx((1 / 3) / 2) and cuts["t"]["p_5"] == 0.2
    judged = {r["topic_id"]: r["judged_at_10"] for r in evaluation.judged_at_10(run, qrels).collect()}
    assert judged == {"t": 0.3, "v": 0.0}
    assert [r["topic_id"] for r in evaluation.missing_topics(run, qrels).collect()] == ["v"]
    assert [r["topic_id"] for r in evaluation.unknown_topics(run, qrels).collect()] == ["w"]


def test_a_perfect_ranking_and_order_invariance(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{t}", f"d{i}", int(g)) for t in range(3) for i, g in enumerate(rng.integers(0, 4, 30))]
    qrels = frame(spark, rows, QRELS)
    run = qrels.select("topic_id", "visual_id", F.col("grade").cast("double").alias("score"))
    got = evaluation.per_topic(run.repartition(7), qrels).collect()
    assert all(r["ndcg"] == pytest.approx(1) and r["ap"] == pytest.approx(1) for r in got)


def test_cut_comes_before_the_prime_filter(spark):
    qrels = frame(spark, [("t", "a", 3)], QRELS)
    run = frame(spark, [("t", "x", 9.0), ("t", "y", 8.0), ("t", "a", 7.0)], RUN)
    assert evaluation.per_topic(run, qrels, depth=2).first()["ndcg"] == 0 and evaluation.per_topic(run, qrels, depth=3).first()["ndcg"] == 1


def test_rrf_depends_on_ranks_only(spark):
    a = frame(spark, [("t", "a", 3.0), ("t", "b", 2.0), ("t", "c", 1.0)], RUN)
    b = frame(spark, [("t", "c", 30.0), ("t", "d", 10.0)], RUN)
    one = {r["visual_id"]: r["score"] for r in fusion.rrf([a, b]).collect()}
    two = {r["visual_id"]: r["score"] for r in fusion.rrf([a.withColumn("score", F.exp("score")), b]).collect()}
    assert one == two and one["c"] == pytest.approx(1 / 63 + 1 / 61)
    assert {r["visual_id"]: r["score"] for r in fusion.linear([a, b]).collect()}["c"] == pytest.approx(0.5)


def test_tuned_weight_prefers_the_balanced(spark):
    rows = [("t", w, 0.5) for w in fusion.GRID]
    assert fusion.best_weight(frame(spark, rows, "topic_id string, w double, ndcg double")).first()["w"] == 0.5


def test_bm25_by_hand(spark):
    docs = frame(spark, [("1", ["a", "b", "a"]), ("2", ["b"]), ("3", []), ("4", None)], "visual_id string, tokens array<string>")
    topics = frame(spark, [("q", ["a", "zz", "a"]), ("r", ["zz"])], "topic_id string, tokens array<string>")
    index = bm25.build(docs)
    assert index.params.first() == (4, 1.0)  # empty documents count towards the mean
    got = bm25.search(index, topics).collect()
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert [(r["topic_id"], r["visual_id"]) for r in got] == [("q", "1")]
    assert got[0]["score"] == pytest.approx(2 * idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3)))
    cand = frame(spark, [("q", "2"), ("q", "1")], "topic_id string, visual_id string")
    assert {r["visual_id"]: r["score"] > 0 for r in bm25.score_candidates(index, topics, cand).collect()} == {"2": False, "1": True}


def test_bm25_index_round_trip(spark, tmp_path):
    docs = frame(spark, [("1", ["a", "b", "a"]), ("2", ["b"])], "visual_id string, tokens array<string>")
    topics = frame(spark, [("q", ["a", "b"])], "topic_id string, tokens array<string>")
    index = bm25.build(docs)
    index.save(str(tmp_path))
    assert bm25.search(bm25.Index.load(spark, str(tmp_path)), topics).collect() == bm25.search(index, topics).collect()


@pytest.mark.parametrize("k,normalise", [(5, False), (40, True)])
def test_dense_topk_against_numpy(spark, k, normalise, monkeypatch):
    rng = np.random.default_rng(1)
    q, c = rng.standard_normal((6, 8)), np.repeat(rng.standard_normal((50, 8)), 4, axis=0)  # every vector four times: ties
    qs = frame(spark, [(f"q{i}", v.tolist()) for i, v in enumerate(q)], "topic_id string, vector array<double>")
    cs = frame(spark, [(f"{i}", v.tolist()) for i, v in enumerate(c)] + [("none", None)], "visual_id string, vector array<double>").repartition(7)
    monkeypatch.setattr(dense, "BLOCK_VALUES", 16)  # two queries a block
    got = {}
    for r in dense.topk(qs, cs, k, normalise=normalise).collect():
        got.setdefault(r["topic_id"], []).append((r["rank"], r["visual_id"]))
    unit = (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)) if normalise else (lambda m: m)
    s = np.round(unit(q) @ unit(c).T, 6)
    for i in range(6):
        order = sorted(range(200), key=lambda j: (s[i, j], str(j)), reverse=True)[:k]
        assert [v for _, v in sorted(got[f"q{i}"])] == [str(j) for j in order]


def test_dense_scans_are_few_rows_after_the_task(spark):
    cs = frame(spark, [(str(i), [float(i), 1.0]) for i in range(1000)], "visual_id string, vector array<double>")
    cut = dense.with_distractors(cs.where("visual_id < '2'"), cs, 10)
    assert cut.count() == cs.where("visual_id < '2'").count() + 10


def test_merge_reports_missing_ids(spark):
    raw = "id long, post_id long, thread_id long, type string, comment_id string, old_visual_id string, visual_id string, issue string, formula string"
    row = lambda i, issue, f: (i, 1, 1, "answer", " ", "v", "v", issue, f)
    latex, opt, slt = frame(spark, [row(1, "v", " x "), row(2, None, None)], raw), frame(spark, [row(1, "d", " "), row(2, None, "<m/>")], raw), frame(spark, [row(1, None, "<n/>")], raw)
    assert [(r["id"], r["in_slt"]) for r in corpus.merge_mismatches(latex, opt, slt).collect()] == [(2, 0)]
    with pytest.raises(Exception, match="all three"):
        corpus.merge(latex, opt, slt).collect()
    r = corpus.merge(latex, opt, slt, strict=False).first()
    assert (r["issue"], r["retrievable"], r["latex"], r["opt"], r["slt"], r["comment_id"]) == ("dv", False, "x", None, "<n/>", None)


def test_representatives(spark):
    schema = "id long, post_id long, type string, visual_id string, retrievable boolean, latex string, opt string, slt string"
    rows = [(1, 1, "answer", "v", True, "a", None, "s"), (9, 1, "comment", "v", True, "b", "o", "s"), (7, 1, "question", "v", True, "c", "o", "s"), (5, 1, "answer", "v", False, "d", "o", "s"), (2, 1, "answer", "w", False, "e", "o", "s"), (3, 1, "comment", "x", True, "f", None, None), (4, 1, None, "x", True, "g", None, None)]
    got = {r["visual_id"]: (r["formula_id"], r["n_instances"]) for r in corpus.representatives(frame(spark, rows, schema)).collect()}
    assert got == {"v": (7, 3), "x": (4, 2)}  # markup first, then no comment, then the least id


def test_export_closes_ranks(spark):
    run = frame(spark, [("t", "a", 3.0), ("t", "b", 2.0), ("t", "c", 1.0)], RUN)
    reps = frame(spark, [("a", 1, 11), ("c", 3, 33)], "visual_id string, formula_id long, post_id long")
    got = [(r["formula_id"], r["rank"]) for r in conversion.export_submission(run, reps, "r").orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2)] and conversion.dropped_by_export(run, reps).count() == 1


def test_run_id_is_checked(spark):
    run = frame(spark, [("t", "a", 3.0)], RUN)
    with pytest.raises(Exception, match="bad run id"):
        conversion.to_lines(run, "no spaces").collect()


def test_rerank_keeps_first_stage_order_in_ties_and_below(spark):
    run = frame(spark, [("t", v, s) for v, s in (("a", 5.0), ("b", 4.0), ("c", 3.0), ("d", 2.0), ("e", 1.0))], RUN)
    scored = frame(spark, [("t", "a", 0.0), ("t", "c", 1.0), ("t", "d", 1.0), ("t", "e", 9.0)], "topic_id string, visual_id string, model double")
    order = lambda depth, alpha: [r["visual_id"] for r in rerank.rerank(run, scored, depth, alpha).orderBy(F.desc("score")).collect()]
    assert order(4, 1.0) == ["c", "d", "a", "b", "e"] and order(4, 0.0) == ["a", "c", "d", "b", "e"] and order(5, 1.0)[0] == "e"
    assert {r["score"] for r in rerank.rerank(run, scored, 4, 1.0).collect()} == {1.0, 2.0, 3.0, 4.0, 5.0}


def test_pairwise_regression_is_at_the_minimum(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 2)) * [1, 5]
    grade = np.clip(np.round(x[:, 0] + 0.1 * x[:, 1] + rng.standard_normal(40)) + 1, 0, 3).astype(int)
    rows = [("t", f"d{i}", int(g), float(a), float(b), 1.0) for i, ((a, b), g) in enumerate(zip(x, grade))]
    data = frame(spark, rows, "topic_id string, visual_id string, grade int, f double, g double, k double")
    c = 0.1
    model = rerank.fit(data, ["f", "g", "k"], c)
    assert model.scale[2] == 1.0
    z = x / x.std(axis=0)
    d = np.array([z[i] - z[j] for i in range(40) for j in range(40) if grade[i] > grade[j]])
    w = np.array(model.weights[:2])
    slope = w - c * (d / (1 + np.exp(d @ w))[:, None]).sum(axis=0)
    assert np.abs(slope).max() < 1e-4 * len(d) * c
    model.save(str(tmp_path / "m.json"))
    assert rerank.Reranker.load(str(tmp_path / "m.json")) == model
    assert rerank.pairs(data, ["f"], most=7).count() == 7


def test_significance():
    d = np.array([0.1, 0.2, 0.05, 0.3, 0.15, 0.2, 0.1, 0.12])
    assert significance.randomisation_p(d) < 0.02 and significance.randomisation_p(np.zeros(4)) == 1 and significance.randomisation_p(np.array([])) == 1
    low, high = significance.bootstrap_interval(d)
    assert low < d.mean() < high


def test_significance_needs_equal_topics(spark):
    a = frame(spark, [("m", "t", 1.0)], "measure string, topic_id string, value double")
    b = frame(spark, [("m", "u", 1.0)], "measure string, topic_id string, value double")
    with pytest.raises(Exception, match="different topics"):
        significance.differences(a, b).collect()


def test_encode_a_graph(spark):
    from ranksmith.functions.trees import slt_graph
    from ranksmith.schema import GRAPH

    g = slt_graph("<math><msup><mi>x</mi><mn>77</mn></msup><mo>?</mo></math>")
    table = spark.createDataFrame([(0, (g.tags, g.symbols, g.edges)), (1, None)], f"i int, g {GRAPH.simpleString()}")
    tags = graphs.as_map({"<pad>": 0, "<unk>": 1, "mi": 2, "mn": 3})
    symbols = graphs.as_map({s: i for i, s in enumerate([*graphs.SPECIAL_SYMBOLS, "x"])})
    enc = lambda **k: table.select(graphs.encode(F.col("g"), tags, symbols, graphs.SLT_EDGES, **k).alias("e"), graphs.describe(F.col("g")).alias("d")).collect()
    full, none = enc()
    assert none["e"] is None and full["d"] == ["x -sup-> 77", "x -next-> ?"]
    assert full["e"]["tag"] == [2, 3, 1] and full["e"]["symbol"] == [10, 4, 1] and not full["e"]["truncated"]
    assert [tuple(e) for e in full["e"]["edges"]] == [(0, 1, 1), (0, 2, 0), (1, 0, 14), (2, 0, 13)]
    cut = enc(max_nodes=2, both_ways=False)[0]["e"]
    assert cut["truncated"] and [tuple(e) for e in cut["edges"]] == [(0, 1, 1)] and len(cut["tag"]) == 2


def test_finetune(spark):
    with pytest.raises(ValueError):
        finetune.check_split("train+dev", "dev")
    qrels = frame(spark, [("a", "1", 3), ("a", "2", 2), ("a", "3", 0), ("b", "1", 0), ("c", "1", 3), ("d", "1", 3)], QRELS)
    topics = frame(spark, [("a", True), ("b", True), ("c", False)], "topic_id string, has_graph boolean")
    store = frame(spark, [("1",), ("2",), ("3",)], "visual_id string")
    ex = finetune.examples(qrels, topics, store)
    assert {r["topic_id"]: r["reason"] for r in ex.collect()} == {"a": "used", "b": "no_positive", "c": "no_query_graph", "d": "no_topic"}
    got = finetune.triples(ex, 50).collect()
    assert len(got) == 50 and {r["negative"] for r in got} == {"3"} and {r["anchor"] for r in got} == {None, "1", "2"}
    assert all(r["anchor"] != r["positive"] for r in got)
    assert sorted(got, key=str) == sorted(finetune.triples(ex.repartition(3), 50).collect(), key=str)
    batch = finetune.batches(topics, 2, 5).groupBy("step").agg(F.count_distinct("topic_id").alias("n")).collect()
    assert {r["n"] for r in batch} == {2} and len(batch) == 5


def test_no_cartesian_and_early_group_limit(spark, small):
    from ranksmith.plans.flagship import sparse_search

    plan = sparse_search(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["structural_features", "tree_edit_pairs"])
def test_graphs_are_not_broadcast(spark, small, name):
    """Files are hundreds of times smaller than the graphs parsed from them, so their size says nothing."""
    from ranksmith.plans.queries import QUERIES

    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_training_pairs_are_not_formed_as_rows(spark):
    rows = [("t" if i < 60 else "u", str(i), i % 4, float(i)) for i in range(64)] + [(None, "x", 3, 1.0), ("t", "y", None, 1.0), ("t", "z", -1, 1.0)]
    got = rerank.pairs(frame(spark, rows, "topic_id string, visual_id string, grade int, f double"), ["f"], most=20, seed=3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    import hashlib

    want = []
    for topic in "tu":
        judged = [r for r in rows if r[0] == topic and r[2] is not None and r[2] >= 0]
        both = sorted((hashlib.md5(f"3|{a[1]}|{b[1]}".encode()).hexdigest(), a, b) for a in judged for b in judged if a[2] > b[2])
        want += [(topic, a[1], b[1], a[3] - b[3]) for _, a, b in both[:20]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pairwise_regression_over_topics(spark):
    schema = "topic_id string, visual_id string, grade int, f double, g double"
    rng = np.random.default_rng(8)
    rows = [(f"t{i % 3}", f"d{i}", int(i % 5 > 2) + (i % 7 == 0), float(i % 5 + rng.standard_normal()), float(rng.standard_normal())) for i in range(90)]
    data = frame(spark, rows, schema)
    model = rerank.fit(data, ["f", "g"], 0.5)
    z = np.array([r[3:] for r in rows]) / model.scale
    d = np.array([z[i] - z[j] for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and a[2] > b[2]])
    w = np.array(model.weights)
    assert np.abs(w - 0.5 * (d / (1 + np.exp(d @ w))[:, None]).sum(axis=0)).max() < 1e-5
    assert rerank.fit(data.where("grade = 0"), ["f", "g"]).weights == [0.0, 0.0]  # no pairs
    with pytest.raises(Exception, match="not finite"):
        rerank.fit(data.withColumn("g", F.when(F.col("visual_id") != "d7", F.col("g"))), ["f", "g"])
