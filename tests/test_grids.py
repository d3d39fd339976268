"""Grids, samplers, one-pass searches and features against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.functions import augment, encoder, trees
from ranksmith.operators import bm25, evaluation, finetune, fusion, pairwise, ranking, rerank
from ranksmith.operators.features import base_names, proto_names
from ranksmith.operators.settings import Best
from ranksmith.sources import readers, writers


@pytest.fixture(scope="module")
def runs(spark):
    """Two runs with many ties, and judgments, of which one topic has no run and one run has no judgments."""
    rng = random.Random(4)
    pick = lambda n, topics: sorted({(rng.choice(topics), f"d{rng.randrange(40)}"): None for _ in range(n)})
    a = [(t, d, float(rng.randrange(6))) for t, d in pick(90, ["t1", "t2", "t4"])]
    b = [(t, d, float(rng.randrange(4))) for t, d in pick(80, ["t1", "t2", "t4"])]
    q = [(t, d, rng.randrange(4)) for t, d in pick(60, ["t1", "t2", "t3"])]
    run = "topic_id string, visual_id string, score double"
    return spark.createDataFrame(a, run), spark.createDataFrame(b, run), spark.createDataFrame(q, "topic_id string, visual_id string, grade int")


def by_topic(df, *keys):
    return {tuple(r[k] for k in (*keys, "topic_id")): tuple(round(r[m], 9) for m in ("ndcg", "ap", "p10")) for r in df.collect()}


def test_fusion_grid_is_fusion_and_evaluation(runs):
    a, b, q = runs
    for depth in (1000, 7):
        got = by_topic(fusion.grid(a, b, q, weights=(0.0, 0.3, 1.0), depth=depth), "w")
        for w in (0.0, 0.3, 1.0):
            want = by_topic(evaluation.per_topic(fusion.linear([a, b], [1 - w, w], depth=depth, digits=6), q, depth))
            assert {k[1:]: v for k, v in got.items() if k[0] == w} == want and len(want) == 3


def test_rerank_grid_is_rerank_and_evaluation(runs):
    a, b, q = runs
    scored = {0.1: b.withColumnRenamed("score", "model"), 1.0: b.select("topic_id", "visual_id", (-F.col("score")).alias("model")).where("visual_id < 'd3'")}
    got = rerank.grid(a, scored, q, [5, 9], [0.5, 1.0])
    rows = by_topic(got, "c", "depth", "alpha")
    for (c, model), depth, alpha in ((m, d, x) for m in scored.items() for d in (5, 9) for x in (0.5, 1.0)):
        want = by_topic(evaluation.per_topic(rerank.rerank(a, model, depth, alpha), q))
        assert {k[3:]: v for k, v in rows.items() if k[:3] == (c, depth, alpha)} == want
    means = {}
    for (c, d, x, _), v in rows.items():
        means.setdefault((c, d, x), []).append(v)
    best = max(means, key=lambda s: tuple(round(sum(v[i] for v in means[s]) / 3, 9) for i in (0, 1)))
    pick = rerank.select_setting(got).first()
    assert (pick["c"], pick["depth"], pick["alpha"]) == best
    # depths beyond what the reranker covers are one setting
    assert {r["depth"] for r in rerank.grid(a, scored, q, [200, 5, 300], [1.0]).collect()} == {5, max(r["count"] for r in b.groupBy("topic_id").count().collect())}


def test_cross_validation_leaves_the_fold_out(runs, spark):
    a, b, q = runs
    got = rerank.grid(a, {1.0: b.withColumnRenamed("score", "model")}, q, [3, 30], [0.0, 1.0])
    folds = ranking.topic_folds(["t1", "t2", "t3"], 3)
    assert sorted(folds.values()) == [0, 1, 2] and folds == ranking.topic_folds(["t3", "t1", "t2"], 3)
    held = {r["topic_id"]: (r["depth"], r["alpha"], round(r["ndcg"], 9)) for r in rerank.cross_validate(got, spark.createDataFrame(list(folds.items()), "topic_id string, fold int")).collect()}
    rows = [(r["topic_id"], r["n"], r["depth"], r["alpha"], r["ndcg"], r["ap"]) for r in got.collect()]
    for topic in folds:
        score = {}
        for t, n, d, x, ndcg, ap in rows:
            if t != topic:
                s = score.setdefault((n, d, x), [0.0, 0.0])
                s[0] += ndcg / 2
                s[1] += ap / 2
        n, d, x = min(score, key=lambda k: (-round(score[k][0], 9), -round(score[k][1], 9), k[0]))
        assert held[topic] == (d, x, round(next(r[4] for r in rows if r[0] == topic and r[1] == n), 9))


def test_one_pass_bm25_is_the_index_search(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["the"] * 20
    docs = spark.createDataFrame([(str(i), None if i % 17 == 0 else [rng.choice(words) for _ in range(rng.randrange(12))]) for i in range(120)], "visual_id string, tokens array<string>").repartition(5)
    topics = spark.createDataFrame([(f"t{i}", [rng.choice([*words, "unheard"]) for _ in range(5)]) for i in range(9)] + [("none", []), ("t0", ["w1"])], "topic_id string, tokens array<string>")
    plain = lambda df: sorted((r["topic_id"], r["visual_id"], r["score"], r["rank"]) for r in df.collect())
    want = plain(bm25.search(bm25.build(docs), topics, 7, digits=6))
    assert plain(bm25.search_corpus(docs, topics, 7, digits=6)) == want and want
    monkeypatch.setattr(bm25, "MOST_TERMS", 10)  # several blocks of topics
    assert plain(bm25.search_corpus(docs, topics, 7, digits=6)) == want
    assert bm25.search_corpus(docs, topics.where("topic_id = 'none'")).count() == 0 == bm25.search_corpus(docs.limit(0), topics).count()


def test_best_keeps_the_first_of_all():
    rng = np.random.default_rng(0)
    best, rows = Best(["q"], 6), []
    for _ in range(20):
        v, d = rng.integers(0, 5, 9).astype(float), np.array([f"d{i}" for i in rng.integers(0, 10**6, 9)], object)
        best.add(0, v, d)
        rows += zip(v, d, strict=True)
    (batch,) = best.batches()
    assert sorted(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True), reverse=True) == sorted(rows, reverse=True)[:6]


def test_samples_are_those_of_their_hash(spark):
    df = spark.range(500).repartition(7)
    h = lambda seed, i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest()
    assert sorted(r["id"] for r in ranking.hash_sample(df, 20, "id", 3).collect()) == sorted(sorted(range(500), key=lambda i: h(3, i))[:20])
    assert sorted(r["id"] for r in ranking.every_nth(df, 9, "id").collect()) == [i for i in range(500) if int(h(0, i)[:12], 16) % 9 == 0]
    assert ranking.hash_sample(df, 900, "id").count() == 500


def test_random_negatives_come_from_the_whole_corpus(spark):
    rows = spark.createDataFrame([(f"t{i}", "used", ["a", "b"], []) for i in range(40)], "topic_id string, reason string, positives array<string>, negatives array<string>")
    corpus = spark.createDataFrame([(f"f{i}",) for i in range(60)], "visual_id string")
    got = finetune.triples(rows, 10, corpus=corpus).collect()
    ring = sorted((hashlib.md5(f"0|f{i}".encode()).hexdigest(), f"f{i}") for i in range(60))
    for r in got:
        at = hashlib.md5(f"0|{r['topic_id']}|{r['draw']}|corpus".encode()).hexdigest()
        assert r["negative"] == next((v for h, v in ring if h >= at), ring[0][1])
    assert len({r["negative"] for r in got}) > 40
    one = finetune.triples(rows, 3, corpus=corpus.limit(1)).collect()
    assert len({r["negative"] for r in one}) == 1 and finetune.triples(rows, 3).first()["negative"] is None


def formula(x, n):
    return trees.slt_graph(f"<math><msup><mi>{x}</mi><mn>{n}</mn></msup><mo>+</mo><mi>y</mi></math>")


def test_pair_features_by_hand():
    """x^2 + y against z^3 + y: edges sup, next, next; paths x-next-+ -next- y."""
    q, c = pairwise.Prepared(formula("x", 2)), pairwise.Prepared(formula("z", 3))
    base, proto = pairwise.compare(q, c)
    got = dict(zip(base_names()[: len(base)], base, strict=True)) | dict(zip(proto_names()[: len(proto)], proto, strict=True))
    assert got["slt_exact_edge_recall"] == pytest.approx(1 / 3) and got["slt_exact_path_f1"] == 0.0
    assert got["slt_unified_edge_f1"] == got["slt_structure_path_recall"] == 1.0
    assert got["slt_ted_exact"] == pytest.approx(1 - 2 / 4) and got["slt_ted_unified"] == 1.0 and got["slt_size_ratio"] == 1.0 and got["slt_missing"] == 0.0
    assert got["slt_alpha_edge_recall"] == pytest.approx(2 / 3) and got["slt_alpha_path_f1"] == 1.0 and got["slt_ted_alpha_canon"] == pytest.approx(1 - 1 / 4)
    assert got["slt_exact_path3_f1"] == 1.0  # neither has a path of three edges
    weigh = lambda level, kind, t: 3.0 if t == ("mo:+", "next", "mi:y") else 1.0
    proto = dict(zip(proto_names()[: len(proto)], pairwise.compare(q, c, weigh)[1], strict=True))
    assert proto["slt_idf_exact_edge_recall"] == pytest.approx(3 / 5) and proto["slt_idf_exact_path_precision"] == 0.0
    none = pairwise.compare(None, c)
    assert none[0][-1] == 1.0 and not any(none[0][:-1]) and not any(none[1])


def test_idf_tables_in_blocks_give_the_same_features(spark):
    from ranksmith.functions.udfs import parse_formulas, register

    rows = [(str(i), f"<math><msup><mi>{'abc'[i % 3]}</mi><mn>{i % 4}</mn></msup><mo>+</mo><mi>{'xyz'[i % 2]}</mi></math>", None) for i in range(24)]
    f = parse_formulas(spark.createDataFrame(rows, "id string, slt string, opt string")).select("id", "slt_graph", "opt_graph").cache()
    register(spark)
    f.createOrReplaceTempView("__formulas")
    tuples = spark.sql("SELECT id, t.level, t.kind, t.tuple FROM __formulas, LATERAL graph_tuples(slt_graph) t")
    pairs = f.select(F.col("id").alias("q"), F.col("slt_graph").alias("q_slt"), F.col("opt_graph").alias("q_opt")).crossJoin(f.where("id = '0'").select("id", F.col("slt_graph").alias("c_slt"), F.col("opt_graph").alias("c_opt")))
    names = [n for n in proto_names() if n.startswith("slt_idf")]

    def features(most):
        out, blocks = {}, 0
        for part, table in pairwise.idf_tables(tuples, "id", pairs, "q", most):
            blocks += 1
            out |= {(r["q"], r["id"]): [r[n] for n in names] for r in pairwise.pair_features(part, table).collect()}
        return out, blocks

    (whole, one), (parts, many) = features(10_000), features(30)
    assert one == 1 < many and whole == parts and len(whole) == pairs.count()
    assert any(0 < v[0] < 1 for v in whole.values())
    t = pairwise.idf_table(tuples, "id")
    df = sum(1 for i in range(24) if i % 3 == 0)
    assert t.n == 24 and t.weight("exact", "edge", ("mi:a", "next", "mo:+")) == pytest.approx(math.log1p((24 - df + 0.5) / (df + 0.5))) and t.weight("exact", "edge", ("no",)) == pytest.approx(math.log1p(49))


def test_batches_of_pairs_and_triples():
    c = encoder.EncoderConfig(hidden=4, heads=2, n_edge_types={"slt": 6, "opt": 4})
    g = lambda n: {"tag": [1] * n, "symbol": [2] * n, "src": [0] * (n - 1), "dst": [*range(1, n)], "type": [1] * (n - 1)}
    view = lambda n, m: {"slt": g(n) if n else None, "opt": g(m) if m else None}
    a, docs = encoder.collate_triples([(view(2, 0), view(3, 1), view(1, 0)), (view(0, 0), view(2, 2), view(4, 0))], c)
    assert a["size"] == 2 and a["opt"] is None and a["slt"]["present"].tolist() == [0] and a["slt"]["type"].tolist() == [1, 4]
    assert docs["size"] == 4 and np.bincount(docs["slt"]["graph"]).tolist() == [3, 2, 1, 4] and docs["opt"]["present"].tolist() == [0, 1]
    left, right = encoder.collate_pair([(view(1, 1), view(2, 1)), (view(0, 3), view(2, 0))], c)
    assert left["slt"]["present"].tolist() == [0] and right["slt"]["graph"].tolist() == [0, 0, 1, 1]


def test_encoder_layers_have_biases():
    """A view without any graph is the learned vectors through two layers, by hand."""
    c = encoder.EncoderConfig(hidden=4, layers=1, heads=2, out_dim=3, n_tags={"slt": 3, "opt": 3}, n_symbols={"slt": 3, "opt": 3}, n_edge_types={"slt": 4, "opt": 4})
    w = encoder.random_weights(c, 1)
    x = np.concatenate([w["slt.missing"], w["opt.missing"]]).astype(float)
    mid = [sum(x[i] * float(w["fuse1"][i, j]) for i in range(8)) + float(w["fuse1.bias"][j]) for j in range(8)]
    mid = [0.5 * m * (1 + math.erf(m / math.sqrt(2))) for m in mid]
    out = np.array([sum(mid[i] * float(w["fuse2"][i, j]) for i in range(8)) + float(w["fuse2.bias"][j]) for j in range(3)])
    assert np.allclose(encoder.encode([{"slt": None, "opt": None}], w, c)[0], out / np.linalg.norm(out), atol=1e-9)
    one = {"tag": [1], "symbol": [2], "src": [], "dst": [], "type": []}
    w2 = dict(w) | {"slt.readout.bias": w["slt.readout.bias"] + 1}
    assert not np.allclose(encoder.encode([{"slt": one, "opt": None}], w, c), encoder.encode([{"slt": one, "opt": None}], w2, c))


def test_configurations(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"augment": {"p_crop": 0.5, "other": 1}, "p_rename": 0.1}')
    c = augment.config_from(augment.Augmentation, str(p), p_rename=None, max_crop=0.2)
    assert (c.p_crop, c.p_rename, c.max_crop, c.p_numbers) == (0.5, 0.1, 0.2, 0.3)
    assert augment.config_from(augment.Augmentation) == augment.Augmentation()
    with pytest.raises(ValueError, match="nope"):
        augment.config_from(augment.Augmentation, nope=1)


def test_files_that_must_be_one_and_strict_grades(spark, tmp_path):
    (tmp_path / "Topics_a.xml").write_text("<Topics/>")
    assert readers.only_file(spark, str(tmp_path), "Topics*.xml").endswith("Topics_a.xml")
    (tmp_path / "Topics_b.xml").write_text("<Topics/>")
    for pattern in ("Topics*.xml", "none*"):
        with pytest.raises(ValueError, match="one file"):
            readers.only_file(spark, str(tmp_path), pattern)
    (tmp_path / "q").write_text("t 0 a 1\nt 0 b x\n")
    assert readers.qrels(spark, str(tmp_path / "q")).count() == 1
    with pytest.raises(Exception, match="line 2"):
        readers.qrels(spark, str(tmp_path / "q"), strict=True).collect()


def test_text_report(spark):
    df = spark.createDataFrame([("a", 0.25, "x" * 100), ("bb", None, None)], "k string, v double, t string").orderBy("k")
    lines = writers.text_report(df, "title", width=10).splitlines()
    assert lines == ["title", "k   v       t", "a   0.2500  xxxxxxxxx…", "bb"]
