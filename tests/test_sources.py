import pytest

from ranksmith.operators import conversion
from ranksmith.sources import readers, writers

HEAD = "id\tpost_id\tthread_id\ttype\tcomment_id\told_visual_id\tvisual_id\tissue\tformula\n"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_raw_tables(spark, tmp_path):
    put(tmp_path / "1.tsv", HEAD + '1\t2\t3\tanswer\t\t7\t8\td\t"a\n""b"" c"\n2\t2\t3\tcomment\t5\t7\t8\t\t \n3\t2\t3\tanswer\t\t7\t8\n')
    rows = {r["id"]: r for r in readers.raw_table(spark, str(tmp_path)).collect()}
    assert rows[1]["formula"] == 'a\n"b" c' and rows[1]["issue"] == "d" and rows[3]["formula"] is None and len(rows) == 3


def test_qrels(spark, tmp_path):
    p = put(tmp_path / "q", "topic 0 doc grade\nt 0 a 2.0\nt 0 b\nt\t0\ta\t1\n\nt 0 c 3.9\r\nt 0 d x\n")
    assert {(r["visual_id"], r["grade"]) for r in readers.qrels(spark, p).collect()} == {("a", 1), ("c", 3)}
    assert readers.formula_qrels(spark, p).count() == 3


def test_runs(spark, tmp_path):
    p = put(tmp_path / "r", "t Q0 a 1 2.5 one\n\nt Q0 b 2 1.5 one\nt Q0 a 3 0.5 two\n")
    assert {(r["visual_id"], r["score"], r["run_id"]) for r in readers.run(spark, p).collect()} == {("a", 0.5, "two"), ("b", 1.5, "two")}
    with pytest.raises(Exception, match="line 2"):
        readers.run(spark, put(tmp_path / "bad", "t Q0 a 1 2.5 one\nt Q0 b 2 1.5\n")).collect()


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("t", "10", 1.0), ("t", "9", 1.0), ("s", "x", 0.1)], "topic_id string, visual_id string, score double")
    writers.run_file(run, "my-run", str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == ["s Q0 x 1 0.1 my-run", "t Q0 9 1 1.0 my-run", "t Q0 10 2 1.0 my-run"]
    back = readers.run(spark, str(tmp_path / "out"))
    assert {(r["topic_id"], r["visual_id"], r["score"]) for r in back.collect()} == {tuple(r) for r in run.collect()}


def test_submissions(spark, tmp_path):
    p = put(tmp_path / "s", "topic\tformula\tpost\trank\tscore\trun\nt\t5\t1\t1\t2.0\tx\nt\t6\t1\t2\t2.0\tx\nt\t7\t1\t3\t1.0\tx\nt\t99\t1\t4\t0.5\tx\n")
    sub = readers.submission(spark, p)
    mapping = spark.createDataFrame([("5", "v"), ("6", "v"), ("7", "w")], "formula_id string, visual_id string")
    assert {(r["visual_id"], r["score"]) for r in conversion.import_run(sub, mapping).collect()} == {("v", 2.0), ("w", 1.0)}
    assert [r["formula_id"] for r in conversion.unmapped(sub, mapping).collect()] == ["99"]
    reps = spark.createDataFrame([("v", 5, 1)], "visual_id string, formula_id long, post_id long")
    writers.submission_file(conversion.export_submission(conversion.import_run(sub, mapping), reps, "r"), str(tmp_path / "o"))
    assert [x for f in (tmp_path / "o").glob("part-*") for x in f.read_text().splitlines()] == ["t\t5\t1\t1\t2.0\tr"]


def test_topics(spark, tmp_path):
    x = put(tmp_path / "Topics.xml", '<?xml version="1.0"?><Topics><Topic number="B.1"><Formula_Id>q_1</Formula_Id><Latex>a+b</Latex></Topic><Topic><Formula_Id>q_2</Formula_Id></Topic><Topic number="B.3"><Latex>z</Latex></Topic></Topics>')
    t = readers.topics(spark, x, 2)
    assert [tuple(r) for r in t.collect()] == [("B.1", 2, "q_1", "a+b")]
    f = readers.topic_formulas(spark, put(tmp_path / "slt.tsv", "id\ttopic_id\tthread_id\ttype\tslt\nq_1\tB.1\t1\ttitle\t<old/>\nq_1\tB.1\t1\ttitle\t<m/>\nq_2\tB.2\n"), "slt")
    assert [tuple(r) for r in f.collect()] == [("q_1", "<m/>")]
    both = readers.with_markup(t, f, f.withColumnRenamed("slt", "opt"))
    assert both.columns == ["topic_id", "year", "formula_id", "latex", "slt", "opt"] and both.first()["slt"] == "<m/>"


def test_splits_and_paths():
    assert readers.resolve_split("train+dev+train") == [1, 2]
    with pytest.raises(ValueError):
        readers.resolve_split("train+x")
    assert "converted" in readers.qrels_path("r", 1) and "all" in readers.qrels_path("r", 3, "all")
    for bad in ((1, "x"), (9, "all")):
        with pytest.raises(ValueError):
            readers.qrels_path("r", *bad)


def test_tables_features_cache_and_vocabularies(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", 1, 0.5, 0.25)], "topic_id string, visual_id string, grade int, f double, g double")
    writers.table(rows, str(tmp_path / "f"))
    writers.table(rows.limit(0), str(tmp_path / "f"))  # exists: left alone
    assert readers.features(spark, str(tmp_path / "f"), ["g"]).columns == ["topic_id", "visual_id", "grade", "g"]
    assert readers.features(spark, str(tmp_path / "f")).count() == 1
    with pytest.raises(Exception, match="nope"):
        readers.features(spark, str(tmp_path / "f"), ["nope"])
    made = []
    make = lambda: made.append(1) or rows
    for _ in range(2):
        assert writers.cached(spark, str(tmp_path / "c"), "m1", make).count() == 1
    writers.cached(spark, str(tmp_path / "c"), "m2", make)
    assert len(made) == 2
    writers.vocabularies({"slt": {"tags": {"π": 1}}}, str(tmp_path / "v.json"))
    assert writers.load_vocabularies(str(tmp_path / "v.json"))["slt"]["tags"] == {"π": 1}
    writers.report(rows, str(tmp_path / "r"))
    writers.conflicts_file(rows, str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_incremental_ingest(spark, tmp_path):
    from ranksmith.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "1.tsv", HEAD + "1\t2\t3\tanswer\t\t7\t8\td\t<math><mi>x</mi></math>\n")

    def run():
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return sorted((r["id"], r["retrievable"], r["slt_symbols"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, False, ["x"])]
    put(tmp_path / "in" / "2.tsv", HEAD + "2\t2\t3\tanswer\t\t7\t8\t\t<math><mi>\n")
    assert run() == run() == [(1, False, ["x"]), (2, True, None)]


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    """A file read by many tasks: the last line of a pair counts, file order holds, and a bad line is named by its number."""
    lines = [f"t{i % 7} 0 d{i % 11} {i}" for i in range(900)]
    path = put(tmp_path / "q", "\n\n".join(lines) + "\n")
    runs = put(tmp_path / "r", "\r\n".join([f"t Q0 d{i % 5} 1 {i} r{i}" for i in range(700)] + ["t Q0 d9 1 2.0"]))
    subs = put(tmp_path / "s", "\n".join(f"t\t{i}\t1\t1\t{i % 3}\tx" for i in range(700)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        got = {(r["topic_id"], r["visual_id"]): r["grade"] for r in readers.qrels(spark, path).collect()}
        assert got == {(x.split()[0], x.split()[2]): i for i, x in enumerate(lines)}
        with pytest.raises(ValueError, match="line 701: six"):
            readers.run(spark, runs)
        assert [r["formula_id"] for r in readers.submission(spark, subs).orderBy("pos").collect()] == [str(i) for i in range(700)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
