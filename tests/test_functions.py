import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.functions import augment, columns, encoder, mathml, trees, udfs


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c.alias("x")).first()["x"]


def test_columns(spark):
    assert one(spark, columns.union_flags("a", "b"), a="v", b="dv") == "dv" and one(spark, columns.union_flags("a"), a=None) is None
    assert one(spark, columns.blank_to_null("a"), a=" \t ") is None and one(spark, columns.blank_to_null("a"), a=" x\n") == "x"
    assert one(spark, columns.retrievable("a"), a=None) and not one(spark, columns.retrievable("a"), a="dv")
    assert one(spark, columns.clean_id("a"), a=" NaN ") is None and one(spark, columns.clean_id("a"), a=" 7 ") == "7"
    assert one(spark, columns.latex_tokens("a"), a=r"\frac{a}{12}+x ") == ["\\frac", "a", "1", "2", "+", "x"]
    assert one(spark, columns.with_bigrams(columns.latex_tokens("a")), a="ab") == ["a", "b", "a b"] and one(spark, columns.with_bigrams(columns.latex_tokens("a")), a="") == []
    assert one(spark, columns.safe_run_id("a"), a="my run#1") == "my-run-1"
    for s, want in {"7": "<int1>", "12345678": "<int5>", "3.5": "<decimal>", ".5": "<decimal>", "1,5": "<decimal>", "1e5": "<number>"}.items():
        assert one(spark, columns.number_bucket("a"), a=s) == want
    for s in ["a", "Z", "π", "ς", "ω", "Ω", "e", "i", "x1", "", "10", "1", "0", "077", "é"]:
        assert one(spark, columns.variable_class("a"), a=s) == trees.variable_class(s)
        assert one(spark, columns.number_class("a"), a=s) == trees.number_class(s)


def test_sanitize_agrees_with_the_worker_side(spark):
    for xml in ['<?xml version="1.0"?><math alttext="a<b"/>', "<math alttext='x'><mo><</mo>&</math>", "<mpadded a='1'>&lt;</mpadded>", " <a>&#x3C;</a> "]:
        assert one(spark, columns.sanitize("a"), a=xml) == mathml.repair(xml)


def test_latex_keys_and_similarity(spark):
    assert one(spark, columns.latex_key("a"), a="a%\n {b} \\% &lt; c") == r"ab\%<c"
    bucket = lambda latex, slt: one(spark, columns.mismatch_bucket("l", columns.alttext("s")), l=latex, s=slt)
    assert bucket("x", "<math/>") == "no_alttext" and bucket("{x}", '<math alttext="x">') == "match"
    assert bucket("x", '<math alttext="\\displaystyle x.">') == "cosmetic"
    assert bucket(r"a\le b", '<math alttext="(a)\\leq[b]">') == "same_symbols" and bucket("a", '<math alttext="b">') == "different"
    sim = lambda a, b: one(spark, columns.jaccard(columns.trigrams(columns.formula_text("a")), columns.trigrams(columns.formula_text("b"))), a=a, b=b)
    assert sim("", "") == 1.0 and sim("$a b$", "ab") == 1.0 and sim("abcd", "abce") == pytest.approx(1 / 3)


XML = "<math><msup><mi>x</mi><mn>2</mn></msup></math>"
OPT = "<math><apply><csymbol>superscript</csymbol><ci>x</ci><cn>2</cn></apply></math>"


def test_one_pass_parse_and_sql_functions(spark):
    rows = spark.createDataFrame([("1", XML, OPT), ("2", "<math><mi>", None), ("3", None, "<math/>")], "id string, slt string, opt string")
    got = {r["id"]: r for r in udfs.parse_formulas(rows).collect()}
    assert got["1"]["slt_symbols"] == ["x", "2"] and got["1"]["slt_graph"]["edges"][0]["type"] == "sup" and got["1"]["opt_graph"]["tags"] == ["csymbol", "ci", "cn"]
    assert got["2"]["slt_symbols"] is None and got["2"]["slt_graph"] is None and got["3"]["opt_graph"]["tags"] == ["math"]
    udfs.register(spark)
    rows.createOrReplaceTempView("formulas")
    assert spark.sql("select mathml_canonical(slt) c from formulas where id = '1'").first()["c"] == XML
    n = spark.sql("select t.* from (select slt_graph(slt) g from formulas where id = '1') f, lateral graph_tuples(f.g) t").collect()
    assert {(r["level"], r["kind"], r["tuple"], r["n"]) for r in n} >= {("exact", "edge", "mi:x\x1fsup\x1fmn:2", 1), ("alpha", "edge", "mi:V1\x1fsup\x1fmn:2", 1), ("unified", "edge", "mi:VAR\x1fsup\x1fmn:NUM", 1)}
    assert spark.sql("select normalize_symbol(' 𝑥 ') s, nfkc('ﬁ') n, html_unescape('&lt;&alpha;') h").first() == ("x", "fi", "<α")


VOCAB = {r: {"tags": {t: i for i, t in enumerate(["<pad>", "<unk>", "mi", "mn", "ci", "cn", "mo"])}, "symbols": {s: i for i, s in enumerate(["<pad>", "<unk>", "a", "b", "c", "x", "12", "34", "0", "e"])}} for r in ("slt", "opt")}


def view(tags, symbols, edges):
    return {"tag": np.array(tags), "symbol": np.array(symbols), "src": np.array([e[0] for e in edges], int), "dst": np.array([e[1] for e in edges], int), "type": np.zeros(len(edges), int)}


def test_augmentation():
    a = augment.Augmenter(VOCAB, augment.Augmentation(p_rename=1, p_numbers=1, p_crop=0, p_drop_modality=0))
    graphs = {"slt": view([2, 2, 3, 2], [2, 3, 6, 2], [(0, 1), (1, 2), (2, 3)]), "opt": view([4, 4, 5], [2, 3, 6], [(0, 1), (0, 2)])}
    one, two = a.pair(graphs, 0, 1, 2)
    again, _ = a.pair(graphs, 0, 1, 2)
    assert (one["slt"]["symbol"] == again["slt"]["symbol"]).all()
    for v in (one, two):
        s, o = v["slt"]["symbol"], v["opt"]["symbol"]
        assert s[0] == s[3] != s[1] and s[0] == o[0] and s[1] == o[1] and s[2] == o[2]  # injective and consistent
        assert set(s[[0, 1]]) <= {2, 3, 4, 5} and s[2] in (6, 7)
    crop = augment.Augmenter(VOCAB, augment.Augmentation(p_rename=0, p_numbers=0, p_crop=1, p_drop_modality=0))
    chain = {"slt": view([2] * 10, [2] * 10, [(i, i + 1) for i in range(9)]), "opt": None}
    for i in range(20):
        got = crop.view(chain, np.random.default_rng(i))["slt"]
        assert 6 <= len(got["tag"]) <= 10 and all(d < len(got["tag"]) for d in got["dst"])
    drop = augment.Augmenter(VOCAB, augment.Augmentation(p_rename=0, p_numbers=0, p_crop=0, p_drop_modality=1))
    assert sum(g is None for g in drop.view(graphs, np.random.default_rng(0)).values()) == 1
    assert drop.view(chain, np.random.default_rng(0))["slt"] is not None


def test_encoder():
    c = encoder.EncoderConfig(hidden=16, layers=2, heads=4, out_dim=8, n_tags={"slt": 7, "opt": 7}, n_symbols={"slt": 10, "opt": 10}, n_edge_types={"slt": 2, "opt": 2})
    w = encoder.random_weights(c)
    g, h = view([2, 3, 4], [2, 6, 3], [(0, 1), (0, 2)]), view([2], [5], [])
    views = [{"slt": g, "opt": h}, {"slt": None, "opt": g}, {"slt": None, "opt": None}, {"slt": h, "opt": None}]
    v = encoder.encode(views, w, c)
    assert np.allclose(np.linalg.norm(v, axis=1), 1)
    assert np.allclose(v[0], encoder.encode(views[:1], w, c)[0])  # batching changes nothing
    turned = view([2, 4, 3], [2, 3, 6], [(0, 2), (0, 1)])
    assert np.allclose(v[1], encoder.encode([{"slt": None, "opt": turned}], w, c)[0])  # node order changes nothing
    with pytest.raises(ValueError):
        encoder.EncoderConfig(hidden=10, heads=4)


def test_training_quantities():
    eye = np.eye(3)
    loss, acc = encoder.info_nce(eye, eye, 0.0)
    assert acc == 1 and loss == pytest.approx(np.log(np.e + 2) - 1)
    assert encoder.info_nce(eye, np.vstack([eye, eye]), 0.0)[0] == pytest.approx(np.log(2 * np.e + 4) - 1)
    assert encoder.learning_rate_factor(0, 10, 100) == 0.1 and encoder.learning_rate_factor(10, 10, 110) == 1 and encoder.learning_rate_factor(110, 10, 110) == pytest.approx(0)


def test_encoder_jobs(spark, small, tmp_path):
    from ranksmith.plans.queries import QUERIES

    rows = QUERIES["corpus_embedding"](spark, small).collect()
    assert len(rows) > 0 and all(np.isclose(np.linalg.norm(r["vector"]), 1, atol=1e-5) for r in rows)
    a = {r["visual_id"]: tuple(r) for r in QUERIES["augmented_views"](spark, small).collect()}
    assert a == {r["visual_id"]: tuple(r) for r in QUERIES["augmented_views"](spark, small).repartition(3).collect()}
    assert any(r[1] != r[3] for r in a.values())
    c = encoder.EncoderConfig(hidden=8, layers=1, heads=2, out_dim=4, n_tags={"slt": 3, "opt": 3}, n_symbols={"slt": 3, "opt": 3}, n_edge_types={"slt": 2, "opt": 2})
    w = encoder.random_weights(c)
    encoder.save(str(tmp_path / "w.npz"), w, c)
    w2, c2 = encoder.load(str(tmp_path / "w.npz"))
    assert c2 == c and all(np.array_equal(w[k], w2[k]) for k in w)
