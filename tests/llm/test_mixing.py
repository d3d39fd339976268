import pytest

from ranksmith.llm import mixing

from .helpers import empty, odd, words


def plain_targets(sizes, weights, share, most):
    """Water-filling by its definition: stop what is above, share the excess again by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, got = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in got]
        left = budget - sum(got.values())
        if not free:
            return got
        level = left / sum(w[s] for s in free)
        above = [s for s in free if w[s] * level > most * sizes[s]]
        if not above:
            return got | {s: w[s] * level for s in free}
        got |= {s: most * sizes[s] for s in above}


def test_against_the_definition(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = mixing.op2_mixing(docs).toPandas()
    rows = docs.toPandas()
    size = {i: len(words(t)) for i, t in zip(rows.doc_id, rows.text)}
    source = dict(zip(rows.doc_id, rows.source))
    total = {}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    want = plain_targets(total, (5, 2, 1), 1.5, 2)
    taken = {s: 0 for s in total}
    largest = {s: max(size[i] for i in size if source[i] == s) for s in total}
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = mixing.op2_mixing(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = mixing.op2_mixing(docs.repartition(9)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)


def test_odd_rows(spark):
    rows = mixing.op2_mixing(odd(spark)).toPandas()
    assert len(rows) == 12 and (rows.taken <= 2 * rows["size"]).all()
    assert (rows[rows.doc_id.isin([2, 3, 4])]["size"] == 0).all()
    # null is the last source: a 5, b 2, c 1, null 5
    assert set(rows[rows.doc_id == 2].source_size) == {8}
    wide = mixing.mix(odd(spark, ["size", "taken", "Copies"]))
    assert [c.lower() for c in wide.columns].count("size") == 1 and wide.count() == 12
    assert mixing.op2_mixing(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r["target"], r["taken"]) for r in mixing.op2_mixing(blank).collect()} == {(0.0, 0)}


def test_repeated_rows_keep_their_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.op2_mixing(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in copies.items() if c}


def test_rows_without_a_key_are_chosen_by_their_text(spark):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('word number ', id) as text", "if(id % 4 = 0, 'a', 'b') as source")
    a, b = (mixing.mix(d).select("text", "copies", "target", "source").toPandas().sort_values("text").reset_index(drop=True) for d in (docs, docs.repartition(9)))
    assert a.equals(b) and a[a.source == "b"].copies.nunique() == 2
