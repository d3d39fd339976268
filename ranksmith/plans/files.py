"""Registered queries of the readers and writers: whole tables are written in the files' formats and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..operators import bm25, conversion, graphs, rerank
from ..sources import readers, writers
from ..sources.scratch import scratch
from . import standins as S
from .queries import _BM25, _order_graphs, _with, query


@query("SRC1", r"""SELECT o_orderkey AS id, o_custkey AS post_id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' END AS issue, o_orderstatus || chr(10) || '"' || o_orderpriority || '" a' || chr(9) || 'b' AS formula FROM orders""")
def read_raw_table(spark, d):
    """Formulas with line breaks, tabs and doubled quotes inside quoted fields."""
    o, path = S.table(spark, d, "orders"), scratch(spark, "raw")
    formula = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('" a\tb'))
    k = F.col("o_orderkey")
    rows = o.select(k.alias("id"), F.col("o_custkey").alias("post_id"), k.alias("thread_id"), F.lit("answer").alias("type"), F.lit(None).cast("string").alias("comment_id"), k.alias("old_visual_id"), k.alias("visual_id"), F.when(k % 3 == 0, "d").alias("issue"), formula.alias("formula"))
    rows.write.option("extension", "tsv").csv(path, sep="\t", header=True, quote='"', escape='"')
    return readers.raw_table(spark, path).select("id", "post_id", "issue", "formula")


@query("SRC15", "SELECT o_orderkey AS id, o_custkey AS post_id, o_orderpriority AS latex, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS opt FROM orders")
def read_sample(spark, d):
    path = scratch(spark, "sample")
    S.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("post_id"), F.col("o_orderpriority").alias("latex"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("opt")).write.json(path)
    return readers.sample(spark, path).select("id", "post_id", "latex", "opt")


@query("SRC4 SRC6", "SELECT 'B.' || s_suppkey AS topic_id, CAST(1 + s_suppkey % 2 AS INTEGER) AS year, 'q_' || s_suppkey AS formula_id, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name || ' < x' END AS latex, 'slt ' || s_suppkey AS slt, CASE WHEN s_suppkey % 3 <> 0 THEN 'opt ' || s_suppkey END AS opt FROM supplier WHERE s_suppkey % 7 <> 0")
def read_topics(spark, d):
    """Suppliers as topics of two years: XML, and a table of each representation whose fifth column has any name."""
    s, root = S.table(spark, d, "supplier"), scratch(spark, "topics")
    k = F.col("s_suppkey")
    number = F.when(k % 7 != 0, F.concat(F.lit("B."), k.cast("string")))
    for year in (1, 2):
        part = s.where(1 + k % 2 == year)
        xml = part.select(number.alias("_number"), F.concat(F.lit(" q_"), k.cast("string"), F.lit(" ")).alias("Formula_Id"), F.when(k % 5 != 0, F.concat("s_name", F.lit(" < x"))).alias("Latex"))
        xml.coalesce(1).write.format("xml").options(rowTag="Topic", rootTag="Topics").save(f"{root}/x{year}")
        _move(spark, f"{root}/x{year}", f"{root}/year{year}/topics/Topics_V{year}.xml")
        for rep in ("SLT", "opt"):
            rows = part.select(F.concat(F.lit("q_"), k.cast("string")).alias("id"), F.lit("t").alias("topic_id"), F.lit("1").alias("thread_id"), F.lit("title").alias("type"), F.when((k % 3 != 0) | F.lit(rep == "SLT"), F.concat(F.lit(rep.lower() + " "), k.cast("string"))).alias("formula"))
            rows.coalesce(1).write.csv(f"{root}/{rep}{year}", sep="\t", header=True)
            _move(spark, f"{root}/{rep}{year}", f"{root}/year{year}/topics/Formulas_{rep}_V{year}.tsv")
    return readers.split_topics(spark, root, "train+dev")


def _move(spark, folder, to):
    """The one part file of a written folder, under another name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    part, target = hadoop.Path(readers.only_file(spark, folder, "part-*")), hadoop.Path(to)
    system = part.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    system.rename(part, target)


@query("SRC17", "SELECT 'B.' || s_suppkey AS topic_id, CASE WHEN s_suppkey % 4 = 0 THEN 'later ' ELSE '' END || s_name AS latex FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 4 = 0")
def read_query_latex(spark, d):
    """Two topic files, of which the second repeats some topics."""
    s, root, paths = S.table(spark, d, "supplier"), scratch(spark, "latex"), []
    k = F.col("s_suppkey")
    first = s.select(k, F.when(k % 5 != 0, F.col("s_name")).alias("Latex"))
    second = s.where(k % 4 == 0).select(k, F.concat(F.lit("later "), "s_name").alias("Latex"))
    for i, part in enumerate((first, second)):
        part.select(F.concat(F.lit("B."), k.cast("string")).alias("_number"), F.lit("q").alias("Formula_Id"), "Latex").coalesce(1).write.format("xml").options(rowTag="Topic", rootTag="Topics").save(f"{root}/x{i}")
        paths.append(readers.only_file(spark, f"{root}/x{i}", "part-*"))
    return readers.query_latex(spark, paths)


@query("SRC5", "SELECT 'f' || s_suppkey AS formula_id, CASE WHEN s_suppkey % 3 = 0 THEN 'second' ELSE 'first ' || s_name END AS slt FROM supplier WHERE s_suppkey % 7 <> 0")
def read_topic_formulas(spark, d):
    """Short rows are skipped, of repeated ids the last counts."""
    s, path = S.table(spark, d, "supplier"), scratch(spark, "formulas")
    row = lambda markup: F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit("\tt\t1\ttitle"), markup)
    short = F.col("s_suppkey") % 7 == 0
    lines = F.array(row(F.when(short, "").otherwise(F.concat(F.lit("\tfirst "), "s_name"))), F.when((F.col("s_suppkey") % 3 == 0) & ~short, row(F.lit("\tsecond"))))
    s.select(F.explode(F.array_compact(lines)).alias("value")).coalesce(1).write.text(path)
    return readers.topic_formulas(spark, path, "slt")


def _qrel_lines():
    """Of each judgment: a line that a later one overrules, the judgment with a fraction, a short line, a word for a grade, and
    an empty line."""
    line = lambda sep, *rest: F.concat_ws(sep, "topic_id", F.lit("0"), "visual_id", *rest)
    grade = F.concat(F.col("grade").cast("string"), F.lit(".9"))
    return F.explode(F.array(line(" ", F.lit("9")), line(" \t", grade), line(" "), line(" ", F.lit("grade")), F.lit(""))).alias("value")


@query("SRC7 SRC18", _with("qrels") + " SELECT topic_id, visual_id, grade FROM qrels")
def read_qrels(spark, d):
    """Repeated pairs, short lines, grades that are no numbers or have a fraction, empty lines."""
    root = scratch(spark, "qrels")
    S.synth_qrels(spark, d).coalesce(1).select(_qrel_lines()).write.text(readers.qrels_path(root, 2, "all"))
    return readers.qrels(spark, readers.qrels_path(root, 2, "all"))


@query("SRC8", _with("qrels") + " SELECT topic_id, visual_id, grade FROM qrels")
def read_split_qrels(spark, d):
    root, q = scratch(spark, "qrels"), S.synth_qrels(spark, d)
    for year in (1, 2):
        q.where(F.crc32(F.col("topic_id").cast("binary")) % 2 == year - 1).select(F.concat_ws(" ", "topic_id", F.lit("0"), "visual_id", F.col("grade").cast("string")).alias("value")).write.text(readers.qrels_path(root, year))
    return readers.split_qrels(spark, root, "train+dev")


@query("SRC16", _with("fqrels") + " SELECT topic_id, formula_id, CAST(unnest([9, grade]) AS INTEGER) AS grade FROM fqrels")
def read_formula_qrels(spark, d):
    """Repeated pairs stay."""
    path = scratch(spark, "formula-qrels")
    S.formula_qrels(spark, d).withColumnRenamed("formula_id", "visual_id").select(_qrel_lines()).write.text(path)
    return readers.formula_qrels(spark, path).select("topic_id", "formula_id", "grade")


@query("SRC9 SNK3", _with("run_a") + " SELECT topic_id, visual_id, score, 'demo' AS run_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM run_a) WHERE rank <= 50")
def read_run(spark, d):
    """A run file as the writer makes it."""
    path = scratch(spark, "run")
    writers.run_file(S.run_a(spark, d), "demo", path, 50)
    return readers.run(spark, path)


@query("SRC10 SNK4 TXT11", "SELECT 'T' || l_linenumber AS topic_id, l_orderkey || '' AS formula_id, l_quantity AS score FROM lineitem")
def read_submission(spark, d):
    """Submission lines with a header."""
    s = S.submission(spark, d).withColumn("line", F.concat_ws("\t", "topic_id", "formula_id", F.lit("1"), F.lit("1"), F.col("score").cast("string"), F.lit("demo")))
    path = scratch(spark, "submission")
    head = spark.createDataFrame([("topic\tformula\tpost\trank\tscore\trun",)], "value string")
    head.unionAll(s.select("line")).write.text(path)
    return readers.submission(spark, path).select("topic_id", "formula_id", "score")


@query("SRC11 SNK8 FE9", _with("qrels", "feature_rows") + " SELECT topic_id, visual_id, grade, f3, f1 FROM feature_rows")
def read_features(spark, d):
    path = scratch(spark, "features")
    writers.table(S.feature_rows(spark, d), path)
    return readers.features(spark, path, ["f3", "f1"])


@query("SRC13 SNK7 SRC3", "SELECT 'slt' AS rep, count(DISTINCT l_orderkey) AS graphs, count(DISTINCT l_orderkey) + count(*) AS nodes, 2 * count(*) AS edges, CAST(0 AS BIGINT) AS truncated FROM lineitem UNION ALL SELECT 'opt', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey) + count(*), 2 * count(*), 0 FROM lineitem WHERE l_orderkey % 2 = 0")
def graph_store_totals(spark, d):
    """Graphs of orders written and read back; every second one has one representation only."""
    types = graphs.as_map({"<pad>": 0, "<unk>": 1})
    code = graphs.encode(F.col("graph"), types, graphs.as_map({s: i for i, s in enumerate(graphs.SPECIAL_SYMBOLS)}), ("A", "N", "R"))
    rows = _order_graphs(spark, d).select("l_orderkey", code.alias("slt")).withColumn("opt", F.when(F.col("l_orderkey") % 2 == 0, F.col("slt")))
    return writers.graph_store(rows, scratch(spark, "graphs"))


@query("SNK11", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def embedding_cache(spark, d):
    """A cache made, found again, and made anew when its marker differs; the second table's rows come back."""
    path, docs = scratch(spark, "cache"), S.table(spark, d, "documents")
    make = lambda n: lambda: docs.select("doc_id", (F.length("text") * n).cast("long").alias("n"))
    writers.cached(spark, path, "m", make(3), {"step": 1, "dim": 4})
    writers.cached(spark, path, "m", make(1), {"step": 2, "dim": 4})
    return writers.cached(spark, path, "m", make(7), {"dim": 4, "step": 2})


@query("SNK1 SNK12 SNK13", _with("mapping", "fqrels") + " SELECT topic_id, visual_id, CAST(max(grade) - min(grade) AS INTEGER) AS spread FROM fqrels JOIN mapping USING (formula_id) GROUP BY ALL HAVING min(grade) < max(grade)")
def conflicts_round_trip(spark, d):
    path = scratch(spark, "conflicts")
    writers.conflicts_file(conversion.conflicts(S.formula_qrels(spark, d), S.mapping(spark, d)), path)
    return spark.read.csv(path, sep="\t", header=True).select("topic_id", "visual_id", F.col("spread").cast("int").alias("spread"))


@query("SNK2 SNK5 BM2", _with("corpus", "topics") + _BM25 + """
SELECT topic_id, visual_id, score FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM sc WHERE score <> 0) WHERE rank <= 10""")
def index_round_trip(spark, d):
    """A stored index of the whole corpus, loaded and searched."""
    path = scratch(spark, "index")
    bm25.build(S.corpus(spark, d)).save(path)
    return bm25.search(bm25.Index.load(spark, path), S.topics(spark, d), 10, digits=6).select("topic_id", "visual_id", "score")


@query("SNK6 SNK9 RK9 RR7", "SELECT 'f2' AS name, -0.75::DOUBLE AS weight, CAST(2 AS BIGINT) AS place UNION ALL SELECT 'f3', 1.5::DOUBLE, CAST(1 AS BIGINT)")
def stored_model(spark, d):
    """A reranker and a vocabulary as JSON files of the driver, read back; the weights largest in absolute value."""
    with tempfile.TemporaryDirectory() as folder:
        rerank.Reranker(["f1", "f2", "f3"], [0.0] * 3, [1.0] * 3, [0.5, -0.75, 1.5]).save(f"{folder}/model.json")
        writers.vocabularies({"slt": {"tags": {"π": 1}}}, f"{folder}/vocabulary.json")
        model, kept = rerank.Reranker.load(f"{folder}/model.json"), writers.load_vocabularies(f"{folder}/vocabulary.json")
    if kept != {"slt": {"tags": {"π": 1}}}:
        raise ValueError("the vocabulary came back changed")
    return spark.createDataFrame([(n, w, i) for i, (n, w) in enumerate(model.strongest(2), 1)], "name string, weight double, place long")
