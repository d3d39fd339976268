import corpus_pipeline
from ranksmith.llm import classify, mixing

from .helpers import ODD, SCHEMA, lower, odd
from .test_simhash import plain_components, plain_fingerprint
from .test_winnow import plain as plain_hits


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, small)
    assert good.columns == docs.columns
    labels = spark.read.parquet(f"{small}/labels.parquet")
    want = {r["doc_id"] for r in classify.op1_quality(docs, labels).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {k for k, _ in rows} == want
    kept = stage["near_duplicates"](spark, good, small)
    fps = [(k, plain_fingerprint(t)) for k, t in rows]
    first = {k for (k, _), c in zip(fps, plain_components(fps)) if k == c}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and {k for k, _ in rows} == first and len(rows) == len(first)
    clean = stage["decontamination"](spark, kept, small)
    want = {k for (k, _), p in zip(rows, plain_hits(rows, bench)) if not p[4]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want and clean.count() == len(want)
    mixed = stage["mixing"](spark, clean, small)
    copies = {r["doc_id"]: r["copies"] for r in mixing.op2_mixing(clean).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    out = stage["sharding"](spark, mixed, small)
    assert out.count() == sum(copies.values())
    assert corpus_pipeline.run(spark, small).count() == sum(copies.values())


def test_stages_take_odd_and_empty_tables(spark, small):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, f in corpus_pipeline.STAGES:
            got = f(spark, docs, small)
            assert got.count() >= 0 and (name == "sharding" or got.columns == docs.columns)


def test_stages_carry_clashing_columns(spark, small):
    extra = ["score", "predicted", "size", "taken", "copies", "same", "fp", "component_id", "c0", "c1", "__k2"]
    docs = odd(spark, extra)
    for _, f in corpus_pipeline.STAGES[:-1]:
        got = f(spark, docs, small)
        assert got.columns == docs.columns and {tuple(r) for r in got.select(*extra).distinct().collect()} <= {("mine",) * len(extra)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 12


def test_decontamination_removes_rows_by_their_own_text(spark, small):
    """Clean rows without a key, or under the key of a contaminated one, stay."""
    leak = next(r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) >= 10)
    rows = [(k, t, "en", "a", 1) for k in (None, 1) for t in (leak, "wholly unrelated clean words", None)] + [(2, leak, "en", "a", 1)]
    got = dict(corpus_pipeline.STAGES)["decontamination"](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), small).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in rows if r[1] != leak)


def test_near_duplicates_take_rows_of_one_key_apart(spark, small):
    """Unrelated texts under one doc_id belong to different groups; each group keeps one row."""
    a, b, c = "one two three four five six", "red green blue pink grey black", "dog cat cow hen pig fox"
    rows = [(k, t, "en", "a", 1) for k, t in [(1, a), (1, b), (1, b), (2, a), (2, c), (3, c), (None, a)]]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), small).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == sorted([(1, a), (1, b), (2, c), (0, a)])


def test_helpers_lower():
    assert lower("ÀB") == "Àb"


def test_stages_do_not_depend_on_the_partitions(spark, small):
    """Equal and missing keys over different texts, exact copies and benchmark passages: the same rows stay, however dealt."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    leak = next(r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r["text"] and len(r["text"].split()) >= 10)
    odd_rows = [(k, t, "en", "a", 1) for k in (None, 1, 2) for t in (leak, "one two three four five", "six seven eight nine ten", None)] * 2
    docs = docs.unionByName(spark.createDataFrame(odd_rows, docs.schema))
    stage = dict(corpus_pipeline.STAGES)
    for name in ("near_duplicates", "decontamination"):
        one, two = (sorted(map(repr, map(tuple, stage[name](spark, docs.repartition(n), small).collect()))) for n in (2, 9))
        assert one == two and 0 < len(one) < docs.count()


def test_few_names_move_no_text(spark, small):
    """The plans that filter the texts have no shuffle of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for name in ("near_duplicates", "decontamination"):
        plan = stage[name](spark, docs, small)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
