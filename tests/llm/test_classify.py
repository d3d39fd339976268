import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ranksmith.llm import classify, kernel, linear

from .helpers import empty, odd


def tables(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("op,label,mod,held", [(classify.op1_quality, "quality", 3, 1), (classify.op4_toxicity, "toxic", 5, 0)])
def test_held_out_accuracy_and_columns(spark, middle, op, label, mod, held):
    docs, labels = tables(spark, middle)
    got = op(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % mod == held) for i, h in zip(got.doc_id, got.held_out))
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    share = (known.predicted == known[label]).mean()
    assert share >= max(known[label].mean(), 1 - known[label].mean())
    if label == "quality":
        assert share > 0.97


def test_labels_of_the_held_out_fold_are_not_used(spark, small):
    docs, labels = tables(spark, small)
    from pyspark.sql import functions as F

    from ranksmith.llm.shared import fold

    other = labels.withColumn("quality", F.when(fold(3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classify.op1_quality(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (labels, other))
    assert np.array_equal(a, b)


def test_reruns_and_partitions_agree(spark, small):
    docs, labels = tables(spark, small)
    a = classify.op4_toxicity(docs, labels).toPandas().sort_values("doc_id").score.to_numpy()
    b = classify.op4_toxicity(docs.repartition(7), labels.repartition(3)).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("task", [classify.QUALITY, classify.TOXIC])
def test_odd_rows_extra_columns_empty_tables(spark, small, task):
    docs, labels = tables(spark, small)
    fitted = classify.fit(docs, labels, task)
    rows = fitted.score(odd(spark, ["score", "predicted", "held_out", "label"]))
    assert rows.columns.count("score") == 1 and "label" in rows.columns
    got = rows.collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert len(blank) == 1  # null, empty and blank texts score alike
    assert len({r["score"] for r in got if r["doc_id"] in (5, 10)}) == 1
    assert fitted.score(empty(spark)).count() == 0
    none = classify.fit(empty(spark), labels.limit(0), task)
    assert {r["score"] for r in none.score(odd(spark)).collect()} == {0.5}
    one_class = labels.where(f"{task.label} = 1")
    assert all(r["score"] > 0.5 for r in classify.fit(docs, one_class, task).score(odd(spark)).collect())


def test_sample_is_bounded(spark, middle):
    from dataclasses import replace

    docs, labels = tables(spark, middle)
    assert classify.fit(docs, labels, replace(classify.QUALITY, most_rows=40)).trained_on <= 40


def test_grams_match_a_plain_version():
    spec = linear.GramSpec(words=((), (1,), (2,)), presence=True)
    texts = ["One two three!! four", "", "one  two", "!!", "é two"]
    piece = next(kernel.slices(pa.array(texts, pa.large_string())))
    g = linear.grams(piece, spec)
    # words: One two three !! four = 5 singles, 4 neighbours, 3 skips; "one two": 2 + 1; "!!": 1; "é two": 2 + 1
    assert np.bincount(g.row, minlength=5).tolist() == [12, 0, 3, 1, 3]
    first = {c for r, c in zip(g.row, g.col) if r == 0}
    assert {c for r, c in zip(g.row, g.col) if r == 2} <= first  # the same words without regard to case and spaces


def test_ftrl_separates_and_is_sparse():
    rng = np.random.default_rng(0)
    spec = linear.GramSpec(words=((),), presence=True, dim=1 << 10)
    y = rng.integers(0, 2, 400)
    rows = [(np.unique(np.append(rng.integers(10, 1000, 20), 3 if t else 4)).astype(np.int32), None) for t in y]
    rows = [(c, np.ones(len(c), np.float32)) for c, _ in rows]
    m = linear.train(rows, y.astype(float), spec, linear.Ftrl(alpha=1.0, l1=3.0))
    w = m.dense()
    assert w[3] > 0 > w[4] and len(m.index) < 100


def plain_hash(word):
    """The kernel's hash of bytes, in whole numbers."""
    mask, h = (1 << 64) - 1, 0
    for i, b in enumerate(word):
        h += (b + 1) * pow(kernel._BASE, i, 1 << 64)
    h = (h + len(word)) & mask
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
    return h ^ h >> 32


def plain_combine(*parts):
    mask = (1 << 64) - 1
    h = len(parts)
    for p in parts:
        h = (h ^ p) * 0x9FB21C651E98DF25 & mask
        h ^= h >> 29
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask
    return h ^ h >> 32


def plain_grams(text, spec):
    """Gram index -> occurrences, and the number of words."""
    raw = (text or "").encode()
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)
    hashes = [plain_hash(w.lower()) for w in found]
    shapes = []
    for i, w in enumerate(found):
        caps = sum(65 <= b <= 90 for b in w)
        kind = 1 if w[:1].isalnum() or w[0] >= 128 else 2
        shapes.append(kind * 8 + (0 if not caps else 2 if caps * 2 > len(w) else 1) * 2 + (i > 0 and hashes[i] == hashes[i - 1]))
    out = {}
    for view, values, families in ((1, hashes, spec.words), (2, shapes, spec.shapes)):
        for number, gaps in enumerate(families):
            for i in range(len(values) - sum(gaps)):
                at = [i + sum(gaps[:j]) for j in range(len(gaps) + 1)]
                col = plain_combine(view * 64 + number, *(values[j] for j in at)) % spec.dim
                out[col] = out.get(col, 0) + 1
    return out, len(found)


@pytest.mark.parametrize("task", [classify.QUALITY, classify.TOXIC])
def test_scores_against_plain_dot_products(spark, small, task):
    docs, labels = tables(spark, small)
    fitted = classify.fit(docs, labels, task)
    w = dict(zip(fitted.model.index.tolist(), fitted.model.weight.tolist(), strict=True))
    assert w
    text = {r["doc_id"]: r["text"] for r in [*docs.collect(), *odd(spark).where("doc_id not in (5, 10)").collect()]}
    frame = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    for r in fitted.score(frame).collect():
        grams, n = plain_grams(text[r["doc_id"]], task.spec)
        dot = sum(w.get(c, 0.0) * (1 if task.spec.presence else k * task.spec.scale / max(n, 1)) for c, k in grams.items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, fitted.model.bias + dot)))), abs=1e-5)


def test_ftrl_against_the_update_rule():
    """One coordinate after the other, as McMahan et al. (2013) write it."""
    rng = np.random.default_rng(2)
    spec, how = linear.GramSpec(words=((),), dim=64), linear.Ftrl(alpha=0.4, beta=0.7, l1=0.3, l2=0.02, epochs=3, seed=5)
    y = rng.integers(0, 2, 40).astype(float)
    rows = [(np.unique(rng.integers(0, 64, 9)).astype(np.int32), None) for _ in y]
    rows = [(c, rng.random(len(c)).astype(np.float32)) for c, _ in rows]
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(zi, ni, l1):
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((how.beta + math.sqrt(ni)) / how.alpha + how.l2)

    order = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for i in order.permutation(len(y)):
            x = dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True))
            w = {j: weight(z.get(j, 0.0), n.get(j, 0.0), how.l1) for j in x}
            b = weight(*bias, 0.0)
            g0 = 1 / (1 + math.exp(-(sum(w[j] * v for j, v in x.items()) + b))) - y[i]
            for j, v in [*x.items()]:
                g, nj = g0 * v, n.get(j, 0.0)
                z[j] = z.get(j, 0.0) + g - (math.sqrt(nj + g * g) - math.sqrt(nj)) / how.alpha * w[j]
                n[j] = nj + g * g
            bias = [bias[0] + g0 - (math.sqrt(bias[1] + g0 * g0) - math.sqrt(bias[1])) / how.alpha * b, bias[1] + g0 * g0]
    got = linear.train(rows, y, spec, how)
    want = np.array([weight(z.get(j, 0.0), n.get(j, 0.0), how.l1) for j in range(64)])
    assert np.allclose(got.dense(), want, atol=1e-5) and got.bias == pytest.approx(weight(*bias, 0.0), abs=1e-6) and (want == 0).any()


def test_grams_of_the_sample_are_bounded(spark, middle):
    """Rows that the grams left over have no room for stay out; reruns agree."""
    from dataclasses import replace

    docs, labels = tables(spark, middle)
    few = replace(classify.QUALITY, most_grams=3000)
    a, b = classify.fit(docs, labels, few), classify.fit(docs.repartition(6), labels, few)
    assert 0 < a.trained_on < classify.fit(docs, labels, classify.QUALITY).trained_on
    assert a.trained_on == b.trained_on and np.array_equal(a.model.index, b.model.index)
