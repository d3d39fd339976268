"""The registered queries over the stand-in tables, each with its SQL where SQL can express it.

Every entry names the operator ids of SURVEY section 2 that it exercises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import bm25, conversion, corpus, dense, diagnostics, evaluation, features, finetune, fusion, graphs, ranking, rerank, significance
from . import standins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
IDS: dict[str, str] = {}


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(S.SQL[n] for n in names)


def query(ids: str, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        IDS[f.__name__] = ids
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- sparse retrieval -----------------------------------------------------------------------------------------------

_BM25 = """,
tf AS (SELECT visual_id, term, count(*) AS tf FROM (SELECT visual_id, unnest(tokens) AS term FROM corpus) GROUP BY ALL),
dl AS (SELECT visual_id, len(tokens) AS len FROM corpus), pr AS (SELECT count(*) AS n, avg(len) AS al FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.term, tf.visual_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)) AS weight FROM tf JOIN df USING (term) JOIN dl USING (visual_id), pr),
qt AS (SELECT topic_id, term, count(*) AS qtf FROM (SELECT topic_id, unnest(tokens) AS term FROM topics) GROUP BY ALL),
sc AS (SELECT topic_id, visual_id, round(sum(qtf * weight), 6) AS score FROM qt JOIN w USING (term) GROUP BY ALL)"""


@query("BM1 BM2 BM3 RK1 RK2 RK3 JN8 AGG4", _with("corpus", "topics") + _BM25 + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS INTEGER) AS rank FROM sc WHERE score <> 0) WHERE rank <= 100""")
def bm25_topk(spark, d):
    return bm25.search_corpus(S.corpus(spark, d), S.topics(spark, d), 100, digits=6).select("topic_id", "visual_id", "score", "rank")


@query("BM2 TOK4 RK3", _with("corpus2", "topics2") + _BM25 + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS INTEGER) AS rank FROM sc WHERE score <> 0) WHERE rank <= 20""")
def bm25_bigram_topk(spark, d):
    return bm25.search_corpus(S.corpus(spark, d, True), S.topics(spark, d, True), 20, digits=6).select("topic_id", "visual_id", "score", "rank")


@query("BM4", _with("corpus", "topics") + _BM25 + """,
cand AS (SELECT topic_id, CAST(doc_id AS VARCHAR) AS visual_id FROM (SELECT topic_id, CAST(topic_id AS BIGINT) AS i FROM topics) JOIN documents ON doc_id IN (i, i * 2, i * 3))
SELECT topic_id, visual_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT * FROM cand) LEFT JOIN sc USING (topic_id, visual_id)""")
def bm25_candidate_scores(spark, d):
    t = S.topics(spark, d)
    i = F.col("topic_id").cast("long")
    pairs = t.select("topic_id", F.explode(F.array_distinct(F.array(i, i * 2, i * 3)).cast("array<string>")).alias("visual_id"))
    cand = pairs.join(S.corpus(spark, d).select("visual_id"), "visual_id", "left_semi").select("topic_id", "visual_id")
    return bm25.score_candidates(bm25.build(S.corpus(spark, d), terms=bm25.query_terms(t)), t, cand).select("topic_id", "visual_id", F.round("score", 6).alias("score"))


@query("AGG4", _with("corpus") + " SELECT visual_id, CAST(len(tokens) AS BIGINT) AS len FROM corpus")
def doc_lengths(spark, d):
    return bm25.doc_lengths(S.corpus(spark, d))


@query("AGG4 BM1", _with("corpus") + """, tf AS (SELECT DISTINCT visual_id, unnest(tokens) AS term FROM corpus), n AS (SELECT count(*) AS n FROM corpus)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf, n GROUP BY term""")
def term_df_idf(spark, d):
    docs = S.corpus(spark, d)
    n = docs.agg(F.count("*").alias("n"))
    return bm25.document_frequency(bm25.term_counts(docs)).join(F.broadcast(n)).select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("TOK4", _with("corpus2") + " SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM corpus) WHERE contains(term, ' ') GROUP BY term")
def bigram_counts(spark, d):
    return S.corpus(spark, d, True).select(F.explode("tokens").alias("term")).where(F.contains("term", F.lit(" "))).groupBy("term").agg(F.count("*").alias("n"))


@query("TOK2", r"""SELECT s_suppkey, array_to_string(regexp_extract_all('\frac{' || s_name || '}{' || s_suppkey || '}', '\\[a-zA-Z]+|[A-Za-z0-9]|[^\s{}]'), ' ') AS tokens FROM supplier""")
def latex_tokens(spark, d):
    latex = F.concat(F.lit(r"\frac{"), F.col("s_name"), F.lit("}{"), F.col("s_suppkey").cast("string"), F.lit("}"))
    return S.table(spark, d, "supplier").select("s_suppkey", F.array_join(C.latex_tokens(latex), " ").alias("tokens"))


# ---- dense retrieval ------------------------------------------------------------------------------------------------

_DENSE = """
WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT id AS topic_id, e FROM v WHERE {which}),
s AS (SELECT topic_id, v.id AS visual_id, round(list_dot_product(q.e, v.e), 6) AS score FROM q, v {extra})
SELECT topic_id, visual_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM s) WHERE rank <= {k}"""


def _vectors(spark, d):
    return S.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("visual_id"), "label", F.col("embedding").alias("vector"))


def _query_vectors(spark, d):
    """One query per label: its first vector."""
    return S.table(spark, d, "embeddings").groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").cast("string").alias("topic_id"), F.col("embedding").alias("vector")), "vec_id").alias("q")).select("q.*")


@query("JN9 RK4 EN4", _DENSE.format(which="CAST(id AS BIGINT) IN (SELECT min(vec_id) FROM embeddings GROUP BY label)", extra="", k=100))
def dense_topk(spark, d):
    return dense.topk(_query_vectors(spark, d), _vectors(spark, d), 100)


_QUICK = """WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT id AS topic_id, e FROM v WHERE CAST(id AS BIGINT) IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
keep AS (SELECT id FROM v WHERE e[1] > 0 UNION ALL (SELECT id FROM v WHERE NOT e[1] > 0 ORDER BY md5('0|' || id), id LIMIT 100)),
s AS (SELECT topic_id, v.id AS visual_id, q.e AS qe, round(list_dot_product(q.e, v.e), 6) AS score, label FROM q, v SEMI JOIN keep USING (id)),
r AS (SELECT topic_id, visual_id, score, label, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS INTEGER) AS rank FROM s)"""


def _quick_dev(spark, d):
    """Judged are the vectors whose first value is positive; a hundred others are drawn."""
    v = _vectors(spark, d)
    judged = v.where(F.get("vector", F.lit(0)) > 0).select("visual_id")
    return judged, dense.topk(_query_vectors(spark, d), dense.with_distractors(judged, v, 100), 50)


@query("JN14 EN7", _QUICK + " SELECT topic_id, visual_id, score, rank FROM r WHERE rank <= 50")
def quick_dev_topk(spark, d):
    return _quick_dev(spark, d)[1]


@query("EN7 JN6", _QUICK + """, j AS (SELECT q.topic_id, v.id AS visual_id FROM q JOIN v t ON t.id = q.topic_id JOIN v ON v.label = t.label WHERE v.e[1] > 0)
SELECT j.topic_id, count(*) AS judged, count(r.visual_id) AS found, round(count(r.visual_id)::DOUBLE / count(*), 6) AS coverage FROM j LEFT JOIN (SELECT * FROM r WHERE rank <= 50) r ON r.topic_id = j.topic_id AND r.visual_id = j.visual_id GROUP BY j.topic_id""")
def quick_dev_cover(spark, d):
    """How many of a topic's judged documents (those of its label) the search of the reduced corpus finds."""
    judged, run = _quick_dev(spark, d)
    labels = _vectors(spark, d).select("visual_id", "label")
    own = _query_vectors(spark, d).select("topic_id", F.col("topic_id").alias("visual_id")).join(labels, "visual_id").select("topic_id", "label")
    rows = own.join(labels.join(judged, "visual_id", "left_semi"), "label").join(run.select("topic_id", "visual_id", "rank"), ["topic_id", "visual_id"], "left")
    return rows.groupBy("topic_id").agg(F.count("*").alias("judged"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count("*"), 6).alias("coverage"))


# ---- fusion ---------------------------------------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC)"
_NORM = "CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1.0 END"
_TOP = """SELECT topic_id, visual_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM f) WHERE rank <= 1000"""


@query("FU2 JN10 SET1", _with("run_a", "run_b") + f""",
u AS (SELECT topic_id, visual_id, 1.0::DOUBLE / (60 + {_RANK}) AS part FROM run_a UNION ALL SELECT topic_id, visual_id, 1.0::DOUBLE / (60 + {_RANK}) FROM run_b),
f AS (SELECT topic_id, visual_id, round(sum(part), 9) AS score FROM u GROUP BY ALL) {_TOP}""")
def rrf_fusion(spark, d):
    return fusion.rrf([S.run_a(spark, d), S.run_b(spark, d)], digits=9)


@query("FU1 RK10 JN10", _with("run_a", "run_b") + f""",
u AS (SELECT topic_id, visual_id, 0.7::DOUBLE * {_NORM} AS part FROM run_a WINDOW p AS (PARTITION BY topic_id) UNION ALL SELECT topic_id, visual_id, 0.3::DOUBLE * {_NORM} FROM run_b WINDOW p AS (PARTITION BY topic_id)),
f AS (SELECT topic_id, visual_id, round(sum(part), 9) AS score FROM u GROUP BY ALL) {_TOP}""")
def linear_fusion(spark, d):
    return fusion.linear([S.run_a(spark, d), S.run_b(spark, d)], [0.7, 0.3], digits=9)


@query("RK10", _with("run_b") + f" SELECT topic_id, visual_id, round({_NORM}, 9) AS norm FROM run_b WINDOW p AS (PARTITION BY topic_id)")
def minmax_per_topic(spark, d):
    return ranking.minmax(S.run_b(spark, d)).select("topic_id", "visual_id", F.round("norm", 9).alias("norm"))


_GRID = _with("run_a", "run_b", "qrels") + f""",
a AS (SELECT topic_id, visual_id, {_NORM} AS a FROM run_a WINDOW p AS (PARTITION BY topic_id)), b AS (SELECT topic_id, visual_id, {_NORM} AS b FROM run_b WINDOW p AS (PARTITION BY topic_id)),
ws AS (SELECT round(unnest(range(21)) * 0.05, 2)::DOUBLE AS w),
r AS (SELECT w, topic_id, visual_id, round((1 - w) * coalesce(a, 0) + w * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (topic_id, visual_id), ws),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM r) WHERE rk <= 1000),
g AS (SELECT w, topic_id, grade, row_number() OVER (PARTITION BY w, topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM t JOIN qrels USING (topic_id, visual_id)),
i AS (SELECT topic_id, sum(grade / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, visual_id DESC) AS r FROM qrels) GROUP BY topic_id),
s AS (SELECT w, topic_id, sum(grade / log2(rank + 1)) AS dcg FROM g GROUP BY ALL),
m AS (SELECT ws.w, i.topic_id, CASE WHEN idcg > 0 THEN coalesce(dcg / idcg, 0) ELSE 0 END AS ndcg FROM i CROSS JOIN ws LEFT JOIN s ON s.topic_id = i.topic_id AND s.w = ws.w)"""


@query("FU3", _GRID + " SELECT w, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY w")
def fusion_grid(spark, d):
    return fusion.grid(S.run_a(spark, d), S.run_b(spark, d), S.synth_qrels(spark, d)).groupBy("w").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("FU3", _GRID + ", b2 AS (SELECT w, round(avg(ndcg), 9) AS mean FROM m GROUP BY w) SELECT w, round(mean, 6) AS mean FROM b2 ORDER BY mean DESC, round(abs(w - 0.5), 6), w LIMIT 1")
def fusion_best_weight(spark, d):
    got = fusion.best_weight(fusion.grid(S.run_a(spark, d), S.run_b(spark, d), S.synth_qrels(spark, d)))
    return got.select("w", F.round("mean", 6).alias("mean"))


@query("FU4 RR6", _GRID + """, fd AS (SELECT topic_id, CAST(CAST(topic_id AS BIGINT) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT topic_id FROM qrels)),
tr AS (SELECT h.held, m.w, round(avg(ndcg), 9) AS mean FROM m JOIN fd USING (topic_id) JOIN (SELECT DISTINCT fold AS held FROM fd) h ON fd.fold <> h.held GROUP BY ALL),
ch AS (SELECT held AS fold, w FROM (SELECT *, row_number() OVER (PARTITION BY held ORDER BY mean DESC, round(abs(w - 0.5), 6), w) AS n FROM tr) WHERE n = 1)
SELECT fold, ch.w, round(avg(ndcg), 6) AS held_out_mean, count(*) AS topics FROM ch JOIN fd USING (fold) JOIN m ON m.topic_id = fd.topic_id AND m.w = ch.w GROUP BY ALL""")
def fusion_cv(spark, d):
    q = S.synth_qrels(spark, d)
    folds = q.select("topic_id").distinct().withColumn("fold", (F.col("topic_id").cast("long") % 5).cast("int"))
    got = fusion.cross_validate(fusion.grid(S.run_a(spark, d), S.run_b(spark, d), q), folds)
    return got.select("fold", "w", F.round("held_out_mean", 6).alias("held_out_mean"), "topics")


# ---- evaluation -----------------------------------------------------------------------------------------------------


def _graded(run: str = "run_b", mode: str = "prime", depth: int = 1000) -> str:
    join = "JOIN" if mode == "prime" else "LEFT JOIN"
    return _with(run, "qrels") + f""",
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM {run}) WHERE rk <= {depth}),
g AS (SELECT topic_id, visual_id, grade IS NOT NULL AS judged, coalesce(grade, 0) AS grade, row_number() OVER o AS rank, sum(CASE WHEN coalesce(grade, 0) >= 2 THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS rsf,
        sum(CASE WHEN grade < 2 THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS nb FROM t {join} qrels USING (topic_id, visual_id) WINDOW o AS (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC)),
i AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, visual_id DESC) AS r FROM qrels),
e AS (SELECT topic_id, sum(grade / log2(r + 1)) AS idcg, count(*) FILTER (grade >= 2) AS nrel, count(*) FILTER (grade < 2) AS nnon FROM i GROUP BY topic_id)"""


@query("FLT4 FLT5", _with("run_b", "qrels") + " SELECT r.topic_id, r.visual_id, score FROM run_b r SEMI JOIN qrels q ON r.topic_id = q.topic_id AND r.visual_id = q.visual_id")
def prime_filter(spark, d):
    return evaluation.prime(S.run_b(spark, d), S.synth_qrels(spark, d))


def _measure(name):
    def f(spark, d):
        return evaluation.per_topic(S.run_b(spark, d), S.synth_qrels(spark, d)).select("topic_id", F.round(name, 6).alias(name))

    return f


def _add(name, ids, sql, f):
    f.__name__ = name
    query(ids, sql)(f)


_add("ndcg_prime", "EV1 EV3", _graded() + " SELECT e.topic_id, round(CASE WHEN idcg > 0 THEN coalesce(any_value(dcg) / idcg, 0) ELSE 0 END, 6) AS ndcg FROM e LEFT JOIN (SELECT topic_id, sum(grade / log2(rank + 1)) AS dcg FROM g GROUP BY topic_id) s USING (topic_id) GROUP BY e.topic_id, idcg", _measure("ndcg"))
_add("map_prime", "EV2", _graded() + " SELECT e.topic_id, round(CASE WHEN nrel > 0 THEN coalesce(any_value(h) / nrel, 0) ELSE 0 END, 6) AS ap FROM e LEFT JOIN (SELECT topic_id, sum(CASE WHEN grade >= 2 THEN rsf::DOUBLE / rank ELSE 0 END) AS h FROM g GROUP BY topic_id) s USING (topic_id) GROUP BY e.topic_id, nrel", _measure("ap"))
_add("p10_prime", "EV2", _graded() + " SELECT e.topic_id, round(coalesce(any_value(h) / 10.0, 0)::DOUBLE, 6) AS p10 FROM e LEFT JOIN (SELECT topic_id, count(*) FILTER (grade >= 2 AND rank <= 10) AS h FROM g GROUP BY topic_id) s USING (topic_id) GROUP BY e.topic_id", _measure("p10"))


@query("AGG16", _graded() + """ SELECT round(avg(n), 6) AS ndcg, count(*) AS topics FROM (SELECT e.topic_id, CASE WHEN idcg > 0 THEN coalesce(dcg / idcg, 0) ELSE 0 END AS n FROM e LEFT JOIN (SELECT topic_id, sum(grade / log2(rank + 1)) AS dcg FROM g GROUP BY topic_id) s USING (topic_id))""")
def mean_over_topics(spark, d):
    got = evaluation.mean(evaluation.per_topic(S.run_b(spark, d), S.synth_qrels(spark, d)), "ndcg")
    return got.select(F.round("ndcg", 6).alias("ndcg"), "topics")


@query("RK6", _with("run_b", "qrels") + """, t AS (SELECT topic_id, visual_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM run_b) WHERE rk <= 10)
SELECT q.topic_id, coalesce(n, 0)::DOUBLE / 10 AS judged_at_10 FROM (SELECT DISTINCT topic_id FROM qrels) q LEFT JOIN (SELECT t.topic_id, count(*) AS n FROM t JOIN qrels USING (topic_id, visual_id) GROUP BY t.topic_id) USING (topic_id)""")
def judged_at_10(spark, d):
    return evaluation.judged_at_10(S.run_b(spark, d), S.synth_qrels(spark, d))


def _cuts_sql(mode):
    per = ", ".join(f"sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN rank <= {k} AND grade >= 2 THEN rsf::DOUBLE / rank ELSE 0 END) AS h{k}, count(*) FILTER (rank <= {k} AND grade >= 2) AS t{k}" for k in evaluation.CUTS)
    ideal = ", ".join(f"sum(CASE WHEN r <= {k} THEN grade / log2(r + 1) ELSE 0 END) AS i{k}" for k in evaluation.CUTS)
    out = ", ".join(f"round(CASE WHEN i{k} > 0 THEN coalesce(d{k} / i{k}, 0) ELSE 0 END, 6) AS ndcg_{k}, round(CASE WHEN nrel > 0 THEN coalesce(h{k} / nrel, 0) ELSE 0 END, 6) AS map_{k}, round(coalesce(t{k}, 0)::DOUBLE / {k}, 6) AS p_{k}" for k in evaluation.CUTS)
    return _graded("run_a", mode) + f""", c AS (SELECT topic_id, {ideal} FROM i GROUP BY topic_id),
s AS (SELECT g.topic_id, {per}, sum(CASE WHEN grade >= 2 THEN CASE WHEN nb IS NULL OR nb = 0 THEN 1.0 ELSE 1 - least(nb, nrel)::DOUBLE / least(nrel, nnon) END ELSE 0 END) AS bp FROM g JOIN e ON g.topic_id = e.topic_id GROUP BY g.topic_id)
SELECT e.topic_id, {out}, round(CASE WHEN nrel > 0 THEN coalesce(bp / nrel, 0) ELSE 0 END, 6) AS bpref FROM e JOIN c ON c.topic_id = e.topic_id LEFT JOIN s ON s.topic_id = e.topic_id"""


def _cuts(mode):
    def f(spark, d):
        got = evaluation.at_cuts(S.run_a(spark, d), S.synth_qrels(spark, d), mode=mode)
        return got.select("topic_id", *[F.round(c, 6).alias(c) for c in got.columns if c != "topic_id"])

    return f


_add("metrics_at_k_prime", "EV4", _cuts_sql("prime"), _cuts("prime"))
_add("metrics_at_k_standard", "EV4", _cuts_sql("standard"), _cuts("standard"))


_WEAK = "SELECT CAST(s_suppkey AS VARCHAR) AS topic_id FROM supplier WHERE s_acctbal < 6000"


def _weak(spark, d):
    """Topics of suppliers with a low balance: the runs and judgments of theirs make an incomplete side."""
    return S.table(spark, d, "supplier").where("s_acctbal < 6000").select(F.col("s_suppkey").cast("string").alias("topic_id"))


@query("EV5", _with("run_b", "qrels") + f" SELECT DISTINCT topic_id FROM qrels WHERE topic_id NOT IN (SELECT topic_id FROM run_b WHERE topic_id IN ({_WEAK}))")
def missing_topics(spark, d):
    return evaluation.missing_topics(S.run_b(spark, d).join(_weak(spark, d), "topic_id", "left_semi"), S.synth_qrels(spark, d))


@query("SET2 EV5", _with("run_b", "qrels") + f" SELECT DISTINCT topic_id FROM run_b WHERE topic_id NOT IN (SELECT topic_id FROM qrels WHERE topic_id IN ({_WEAK}))")
def unknown_topics(spark, d):
    return evaluation.unknown_topics(S.run_b(spark, d), S.synth_qrels(spark, d).join(_weak(spark, d), "topic_id", "left_semi"))


# ---- significance ---------------------------------------------------------------------------------------------------

_DELTA = _with("run_a", "run_b", "qrels") + "".join(f""",
t{x} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM run_{x}) WHERE rk <= 1000),
g{x} AS (SELECT topic_id, grade, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM t{x} JOIN qrels USING (topic_id, visual_id)),
s{x} AS (SELECT topic_id, sum(grade / log2(rank + 1)) AS dcg, count(*) FILTER (grade >= 2 AND rank <= 10) / 10.0::DOUBLE AS p10 FROM g{x} GROUP BY topic_id)""" for x in "ab") + """,
i AS (SELECT topic_id, sum(grade / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC, visual_id DESC) AS r FROM qrels) GROUP BY topic_id),
dl AS (SELECT 'ndcg' AS measure, topic_id, CASE WHEN idcg > 0 THEN coalesce(sb.dcg, 0) / idcg - coalesce(sa.dcg, 0) / idcg ELSE 0 END AS delta FROM i LEFT JOIN sa USING (topic_id) LEFT JOIN sb USING (topic_id)
       UNION ALL SELECT 'p10', topic_id, coalesce(sb.p10, 0) - coalesce(sa.p10, 0) FROM i LEFT JOIN sa USING (topic_id) LEFT JOIN sb USING (topic_id))"""


def _deltas(spark, d):
    q = S.synth_qrels(spark, d)
    a, b = (evaluation.long_form(evaluation.per_topic(r, q).select("topic_id", "ndcg", "p10"), n) for r, n in ((S.run_a(spark, d), "a"), (S.run_b(spark, d), "b")))
    return significance.differences(a, b)


@query("ST3 JN15", _DELTA + " SELECT measure, round(avg(delta), 6) AS delta, count(*) FILTER (delta > 1e-9) AS wins, count(*) FILTER (delta < -1e-9) AS losses, count(*) FILTER (abs(delta) <= 1e-9) AS ties FROM dl GROUP BY measure")
def win_loss_tie(spark, d):
    return significance.win_loss_tie(_deltas(spark, d)).withColumn("delta", F.round("delta", 6))


@query("RK8", _DELTA + """, r AS (SELECT measure, topic_id, round(delta, 9) AS delta FROM dl)
SELECT measure, topic_id, round(delta, 6) AS delta, side, CAST(place AS INTEGER) AS place FROM (
  SELECT *, 'gain' AS side, row_number() OVER (PARTITION BY measure ORDER BY delta DESC, topic_id) AS place FROM r UNION ALL SELECT *, 'loss', row_number() OVER (PARTITION BY measure ORDER BY delta, topic_id) FROM r) WHERE place <= 5""")
def topic_gains_losses(spark, d):
    got = significance.gains_and_losses(_deltas(spark, d).withColumn("delta", F.round("delta", 9)))
    return got.select("measure", "topic_id", F.round("delta", 6).alias("delta"), "side", "place")


@query("ST1 ST2 ST3")
def paired_significance(spark, d):
    return significance.significance(_deltas(spark, d))


# ---- corpus ---------------------------------------------------------------------------------------------------------


def _raw(spark, d, name):
    """Three overlapping views of orders as the three raw tables."""
    o = S.table(spark, d, "orders")
    flag = {"latex": F.when(F.col("o_orderstatus") == "F", "d"), "opt": F.when(F.col("o_orderpriority").startswith("1"), "v"), "slt": F.when(F.col("o_orderstatus") == "F", "d")}[name]
    formula = {"latex": F.col("o_orderpriority"), "opt": F.when(F.col("o_totalprice") > 1000, F.concat(F.lit(" "), F.col("o_orderstatus"))), "slt": F.when(F.col("o_totalprice") > 2000, F.col("o_orderpriority"))}[name]
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("post_id"), F.col("o_custkey").alias("thread_id"), F.lit("answer").alias("type"), F.lit(" ").alias("comment_id"), F.col("o_orderstatus").alias("old_visual_id"), F.col("o_custkey").cast("string").alias("visual_id"), flag.alias("issue"), formula.alias("formula"))


_MERGED = """m AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS visual_id, nullif(CASE WHEN o_orderstatus = 'F' THEN 'd' ELSE '' END || CASE WHEN o_orderpriority LIKE '1%' THEN 'v' ELSE '' END, '') AS issue,
o_orderstatus <> 'F' AS retrievable, o_orderpriority AS latex, CASE WHEN o_totalprice > 1000 THEN o_orderstatus END AS opt, CASE WHEN o_totalprice > 2000 THEN o_orderpriority END AS slt FROM orders)"""


@query("JN1 PRJ1 PRJ2 PRJ3", "WITH " + _MERGED + " SELECT id, visual_id, issue, retrievable, latex, opt, slt FROM m")
def three_way_merge(spark, d):
    return corpus.merge(_raw(spark, d, "latex"), _raw(spark, d, "opt"), _raw(spark, d, "slt")).select("id", "visual_id", "issue", "retrievable", "latex", "opt", "slt")


@query("JN1", "SELECT o_orderkey AS id, 1 AS in_latex, CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END AS in_opt, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS in_slt FROM orders WHERE NOT (o_totalprice > 1000 AND o_orderstatus <> 'P')")
def merge_mismatch(spark, d):
    o = S.table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return corpus.merge_mismatches(o, o.where("o_totalprice > 1000"), o.where("o_orderstatus <> 'P'"))


@query("PRJ1 PRJ2", "WITH " + _MERGED + " SELECT coalesce(issue, '') AS issue, retrievable, count(*) AS n FROM m GROUP BY ALL")
def issue_flag_union(spark, d):
    m = corpus.merge(_raw(spark, d, "latex"), _raw(spark, d, "opt"), _raw(spark, d, "slt"))
    return m.groupBy(F.coalesce("issue", F.lit("")).alias("issue"), "retrievable").agg(F.count("*").alias("n"))


@query("AGG3", "SELECT count(*) AS n FROM orders WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN 'd' END, '') <> coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN 'v' END, '')")
def flag_disagreements(spark, d):
    return corpus.flag_disagreements(_raw(spark, d, "latex"), _raw(spark, d, "opt"), _raw(spark, d, "slt")).agg(F.count("*").alias("n"))


_PRIORITY = "2 * CASE WHEN opt IS NULL OR slt IS NULL THEN 1 ELSE 0 END + CASE WHEN type = 'comment' THEN 1 ELSE 0 END"


@query("AGG1 JN2 FLT1 SRC2", _with("findex") + f""" SELECT visual_id, arg_min(id, ({_PRIORITY}) * 4294967296 + id) AS formula_id, arg_min(post_id, ({_PRIORITY}) * 4294967296 + id) AS post_id, arg_min(type, ({_PRIORITY}) * 4294967296 + id) AS type,
count(*) AS n_instances, any_value(md5(latex)) AS latex FROM findex WHERE retrievable GROUP BY visual_id""")
def representatives(spark, d):
    return corpus.representatives(S.formula_index(spark, d)).select("visual_id", "formula_id", "post_id", "type", "n_instances", F.md5(F.col("latex").cast("binary")).alias("latex"))


@query("AGG2", _with("findex") + """, p AS (SELECT visual_id, count(*) AS n, bool_or(retrievable) AS a, bool_or(retrievable AND opt IS NOT NULL AND slt IS NOT NULL) AS x FROM findex GROUP BY visual_id)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS visual_ids, count(*) FILTER (a) AS retrievable_ids, count(*) FILTER (a AND NOT x) AS without_xml FROM p""")
def corpus_stats(spark, d):
    return corpus.build_stats(S.formula_index(spark, d))


@query("AGG3 FLT3", _with("findex") + " SELECT coalesce(issue, '') AS issue, count(*) AS rows, count(*) FILTER (opt IS NULL OR slt IS NULL) AS without_xml FROM findex GROUP BY ALL")
def ingest_stats(spark, d):
    return corpus.ingest_stats(S.formula_index(spark, d)).select("issue", "rows", "without_xml")


@query("JN6", _with("findex") + """, rel AS (SELECT DISTINCT md5(text) AS visual_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1), corp AS (SELECT DISTINCT visual_id FROM findex WHERE retrievable)
SELECT count(*) AS relevant, count(*) FILTER (c.visual_id IS NULL) AS missing FROM rel LEFT JOIN corp c USING (visual_id)""")
def recall_ceiling(spark, d):
    q = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id").where("quality = 1").select(F.md5(F.col("text").cast("binary")).alias("visual_id"), F.lit(2).alias("grade"))
    return corpus.coverage(q, S.formula_index(spark, d).where("retrievable"))


@query("FLT1 FLT2 FLT3 FLT7 FLT9 FLT10", _with("findex") + " SELECT count(*) FILTER (retrievable) AS retrievable, count(*) FILTER (opt IS NOT NULL AND slt IS NOT NULL) AS has_xml, count(*) FILTER (issue IN ('v', 'dv')) AS flagged, count(*) FILTER (issue IS NULL) AS clean, count(*) FILTER (issue IS NULL AND id % 100 = 0) AS sampled FROM findex")
def row_filter_stats(spark, d):
    x = S.formula_index(spark, d)
    return x.agg(
        F.count_if("retrievable").alias("retrievable"), F.count_if(F.col("opt").isNotNull() & F.col("slt").isNotNull()).alias("has_xml"), F.count_if(F.col("issue").isin("v", "dv")).alias("flagged"),
        F.count_if(F.col("issue").isNull()).alias("clean"), F.count_if(F.col("issue").isNull() & (F.col("id") % 100 == 0)).alias("sampled"),
    )


@query("JN5 FLT2", _with("findex", "qrels") + " SELECT DISTINCT id, type FROM findex WHERE CAST(id AS VARCHAR) IN (SELECT visual_id FROM qrels WHERE grade >= 2)")
def formula_lookup(spark, d):
    c = S.formula_index(spark, d).select(F.col("id").cast("string").alias("visual_id"), "id", "type")
    return corpus.lookup(c, S.synth_qrels(spark, d).where("grade >= 2"), "id", "type").select("id", "type")


# ---- run conversion -------------------------------------------------------------------------------------------------


@query("RK5 JN3 EV7", _with("mapping", "submission") + """ SELECT topic_id, visual_id, score FROM (SELECT topic_id, visual_id, score, row_number() OVER (PARTITION BY topic_id, visual_id ORDER BY score DESC, pos) AS n FROM submission JOIN mapping USING (formula_id)) WHERE n = 1""")
def import_run_dedup(spark, d):
    return conversion.import_run(S.submission(spark, d), S.mapping(spark, d))


@query("JN7", _with("submission") + " SELECT topic_id, count(*) AS unmapped FROM submission WHERE formula_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F') GROUP BY topic_id")
def unmapped_ids(spark, d):
    """Against the mapping of the finished orders alone."""
    done = S.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("formula_id"), F.col("o_custkey").cast("string").alias("visual_id"))
    return conversion.unmapped(S.submission(spark, d), done).groupBy("topic_id").agg(F.count("*").alias("unmapped"))


@query("SNK4 JN4", _with("run_b") + """, c AS (SELECT CAST(p_partkey AS VARCHAR) AS visual_id, p_partkey AS formula_id, CAST(p_size AS BIGINT) AS post_id FROM part WHERE p_size <= 25),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM run_b) WHERE rk <= 100)
SELECT topic_id, formula_id, post_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY rk) AS INTEGER) AS rank, score, 'demo' AS run_id FROM t JOIN c USING (visual_id)""")
def export_submission(spark, d):
    reps = S.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("visual_id"), F.col("p_partkey").alias("formula_id"), F.col("p_size").cast("long").alias("post_id"))
    return conversion.export_submission(S.run_b(spark, d), reps, "demo", 100)


@query("SNK3 RK2", _with("run_a") + """ SELECT topic_id, CAST(rank AS INTEGER) AS rank, topic_id || ' Q0 ' || visual_id || ' ' || rank || ' ' || CAST(score AS BIGINT) || '.0 demo' AS value FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rank FROM run_a) WHERE rank <= 50""")
def run_lines(spark, d):
    return conversion.to_lines(S.run_a(spark, d), "demo", 50)


@query("AGG9 JN3", _with("mapping", "fqrels") + " SELECT topic_id, visual_id, CAST(max(grade) AS INTEGER) AS grade FROM fqrels JOIN mapping USING (formula_id) GROUP BY ALL")
def rekey_qrels(spark, d):
    return conversion.rekey(S.formula_qrels(spark, d), S.mapping(spark, d))


@query("AGG10 SNK13", _with("mapping", "fqrels") + """ SELECT topic_id, visual_id, string_agg(formula_id || ':' || grade, ' ' ORDER BY formula_id, grade) AS grades, CAST(max(grade) - min(grade) AS INTEGER) AS spread, min(grade) < 2 AND max(grade) >= 2 AS straddles
FROM fqrels JOIN mapping USING (formula_id) GROUP BY ALL HAVING min(grade) < max(grade)""")
def qrel_conflicts(spark, d):
    return conversion.conflicts(S.formula_qrels(spark, d), S.mapping(spark, d))


# ---- graphs and vocabulary ------------------------------------------------------------------------------------------

_SIZES = "sz AS (SELECT len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS size FROM documents)"


def _sizes(spark, d):
    return S.corpus(spark, d).select(F.size("tokens").cast("long").alias("size"))


@query("AGG6", f"WITH {_SIZES}, c AS (SELECT size, count(*) AS n FROM sz GROUP BY size), r AS (SELECT size, sum(n) OVER (ORDER BY size) AS cum, sum(n) OVER () AS total FROM c) SELECT q::DOUBLE AS q, CAST(min(size) AS BIGINT) AS value FROM r, (SELECT unnest([0.5, 0.9, 0.99, 0.999]) AS q) WHERE cum >= q::DOUBLE * total GROUP BY q")
def size_percentiles(spark, d):
    return graphs.percentiles(_sizes(spark, d), "size")


@query("AGG7", f"WITH {_SIZES} SELECT " + ", ".join(f"count(*) FILTER (size > {n}) AS over_{n}" for n in graphs.LIMITS) + ", CAST(max(size) AS BIGINT) AS largest, count(*) AS total FROM sz")
def graphs_over_limit(spark, d):
    return graphs.over_limits(_sizes(spark, d), "size")


@query("AGG8 AGG5", _with("corpus") + """, c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM corpus) GROUP BY token)
SELECT token, CAST(row_number() OVER (ORDER BY token) + 9 AS INTEGER) AS id FROM c WHERE n >= 5 UNION ALL SELECT unnest(['<pad>', '<unk>', '<none>', '<int1>', '<int2>', '<int3>', '<int4>', '<int5>', '<decimal>', '<number>']), CAST(unnest(range(10)) AS INTEGER)""")
def vocab_ids(spark, d):
    counts = S.corpus(spark, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return graphs.vocabulary(counts)


@query("AGG7", _with("corpus") + ", c AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM corpus) GROUP BY token) SELECT round(sum(CASE WHEN n >= 5 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS coverage, count(*) FILTER (n >= 5) AS kept, count(*) AS types FROM c")
def vocab_coverage(spark, d):
    counts = S.corpus(spark, d).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return graphs.coverage(counts).withColumn("coverage", F.round("coverage", 6))


@query("TXT8", "SELECT p_partkey, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '<int' || least(len(s), 5) || '>' WHEN regexp_matches(s, '^[0-9]*[.,][0-9]+$') THEN '<decimal>' ELSE '<number>' END AS bucket FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN p_size || ',' || p_partkey ELSE p_type END AS s FROM part)")
def number_buckets(spark, d):
    s = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_size") % 3 == 1, F.concat_ws(",", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_type"))
    return S.table(spark, d, "part").select("p_partkey", C.number_bucket(s).alias("bucket"))


@query("TXT9", "SELECT c, n, CASE WHEN c IN ('e', 'i') THEN NULL WHEN c BETWEEN 'a' AND 'z' THEN 'latin_lower' WHEN c BETWEEN 'A' AND 'Z' THEN 'latin_upper' END AS class FROM (SELECT left(p_name, 1) AS c, count(*) AS n FROM part GROUP BY 1)")
def variable_classes(spark, d):
    return S.table(spark, d, "part").groupBy(F.left("p_name", F.lit(1)).alias("c")).agg(F.count("*").alias("n")).withColumn("class", C.variable_class("c"))


@query("JN13 FE3", _with("edges") + " SELECT a.src AS a, a.type AS t1, a.dst AS b, b.type AS t2, b.dst AS c FROM edges a JOIN edges b ON a.dst = b.src")
def two_edge_paths(spark, d):
    return graphs.two_edge_paths(S.edges(spark, d)).select("a", "t1", "b", "t2", "c")


@query("JN13 FE3", _with("edges") + " SELECT a.type AS t1, b.type AS t2, c.dst AS d, count(*) AS n FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src GROUP BY ALL")
def three_edge_paths(spark, d):
    return graphs.three_edge_paths(S.edges(spark, d)).groupBy("t1", "t2", "d").agg(F.count("*").alias("n"))


def _order_graphs(spark, d):
    """A graph per order: node 0 is the order, its lines hang off it by their flag."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey")))
    g = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(lines.alias("x"))
    lines_ = lambda f: F.transform("x", f)
    return g.select(
        "l_orderkey",
        F.struct(
            F.concat(F.array(F.lit("order")), lines_(lambda e: F.concat(F.lit("line"), e["l_linestatus"]))).alias("tags"),
            F.concat(F.array(F.lit("")), lines_(lambda e: e["l_partkey"].cast("string"))).alias("symbols"),
            F.transform("x", lambda e, i: F.struct(F.lit(0).alias("src"), (i + 1).cast("int").alias("dst"), e["l_returnflag"].alias("type"))).alias("edges"),
        ).alias("graph"),
    )


@query("GR7 GR5", "SELECT l_orderkey, CAST(count(*) * 2 AS INTEGER) AS edges, CAST(sum(n + n + 3) AS BIGINT) AS types FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS n FROM lineitem) GROUP BY l_orderkey")
def reverse_edges(spark, d):
    ids = graphs.as_map({"A": 0, "N": 1, "R": 2})
    g = _order_graphs(spark, d).select("l_orderkey", F.transform("graph.edges", lambda e: F.struct("graph.tags", e["src"].alias("src"), e["dst"].alias("dst"), F.element_at(ids, e["type"]).alias("type"))).alias("e"))
    both = graphs.reverse_edges(F.transform("e", lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), e["type"].alias("type"))), 3)
    return g.select("l_orderkey", both.alias("b")).select("l_orderkey", F.size("b").alias("edges"), F.aggregate("b", F.lit(0).cast("long"), lambda s, e: s + e["type"]).alias("types"))


@query("GR5 GR6 TXT10 GR3")
def graph_encode(spark, d):
    tags = graphs.as_map({"<pad>": 0, "<unk>": 1, "lineO": 2, "order": 3})
    symbols = graphs.as_map({s: i for i, s in enumerate(graphs.SPECIAL_SYMBOLS)} | {"7": 10})
    return _order_graphs(spark, d).select("l_orderkey", graphs.encode(F.col("graph"), tags, symbols, ("A", "N", "R")).alias("g")).select("l_orderkey", "g.*")


@query("GR4", "SELECT l_orderkey, string_agg('order -' || l_returnflag || '-> ' || l_partkey, '; ' ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) AS lines FROM lineitem GROUP BY l_orderkey")
def graph_describe(spark, d):
    return _order_graphs(spark, d).select("l_orderkey", F.array_join(graphs.describe(F.col("graph")), "; ").alias("lines"))


# ---- features and reranking -----------------------------------------------------------------------------------------

_OVER = _with("bags", "bag_pairs") + """,
i AS (SELECT q, c, sum(least(x.n, y.n)) AS i FROM bag_pairs JOIN bags x ON x.owner = q JOIN bags y ON y.owner = c AND y.tuple = x.tuple GROUP BY ALL),
s AS (SELECT owner, sum(n) AS n FROM bags GROUP BY owner)"""


def _bag_sides(spark, d):
    b = S.bags(spark, d)
    return b.withColumnRenamed("owner", "q"), b.withColumnRenamed("owner", "c")


@query("JN12 FE4 SET4", _OVER + """, r AS (SELECT p.q, p.c, coalesce(i, 0)::DOUBLE / a.n AS recall, coalesce(i, 0)::DOUBLE / b.n AS precision FROM bag_pairs p JOIN s a ON a.owner = p.q JOIN s b ON b.owner = p.c LEFT JOIN i ON i.q = p.q AND i.c = p.c)
SELECT q, c, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1 FROM r""")
def multiset_overlap(spark, d):
    got = features.overlap(*_bag_sides(spark, d), S.bag_pairs(spark, d))
    return got.select("q", "c", *[F.round(m, 6).alias(m) for m in ("recall", "precision", "f1")])


@query("FE5 AGG11 FE11", _with("bags", "bag_pairs") + """, df AS (SELECT tuple, count(*) AS df FROM bags GROUP BY tuple), n AS (SELECT count(DISTINCT owner) AS n FROM bags),
w AS (SELECT owner, tuple, bags.n, ln(1 + (n.n - df + 0.5) / (df + 0.5)) AS w FROM bags JOIN df USING (tuple), n), s AS (SELECT owner, sum(n * w) AS s FROM w GROUP BY owner),
i AS (SELECT q, c, sum(least(x.n, y.n) * x.w) AS i FROM bag_pairs JOIN w x ON x.owner = q JOIN w y ON y.owner = c AND y.tuple = x.tuple GROUP BY ALL)
SELECT p.q, p.c, round(CASE WHEN a.s > 0 THEN coalesce(i, 0) / a.s ELSE 0 END, 6) AS recall, round(CASE WHEN b.s > 0 THEN coalesce(i, 0) / b.s ELSE 0 END, 6) AS precision FROM bag_pairs p JOIN s a ON a.owner = p.q JOIN s b ON b.owner = p.c LEFT JOIN i ON i.q = p.q AND i.c = p.c""")
def idf_overlap(spark, d):
    b = S.bags(spark, d)
    df, n = features.document_frequency(b, "owner"), b.agg(F.count_distinct("owner").alias("n_docs"))
    got = features.idf_overlap(*_bag_sides(spark, d), S.bag_pairs(spark, d), df, n)
    return got.select("q", "c", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("FE9", _with("run_b", "qrels") + """, t AS (SELECT topic_id, visual_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS rk FROM run_b) WHERE rk <= 50),
c AS (SELECT topic_id, visual_id FROM t UNION SELECT topic_id, visual_id FROM qrels) SELECT c.topic_id, c.visual_id, coalesce(grade, -1) AS grade, score AS first_stage FROM c LEFT JOIN qrels USING (topic_id, visual_id) JOIN run_b USING (topic_id, visual_id)""")
def feature_table(spark, d):
    q, run = S.synth_qrels(spark, d), S.run_b(spark, d)
    return features.assemble(features.candidates(run, q, 50), q, run.withColumnRenamed("score", "first_stage")).select("topic_id", "visual_id", "grade", "first_stage")


@query("RR1 JN11", _with("qrels", "feature_rows") + """, p AS (SELECT topic_id, hi.visual_id AS hi_id, lo.visual_id AS lo_id, hi.f1 - lo.f1 AS f1, hi.f3 - lo.f3 AS f3, row_number() OVER (PARTITION BY topic_id ORDER BY md5('0|' || hi.visual_id || '|' || lo.visual_id), hi.visual_id, lo.visual_id) AS n
FROM feature_rows hi JOIN feature_rows lo USING (topic_id) WHERE hi.grade > lo.grade) SELECT topic_id, hi_id, lo_id, f1, f3 FROM p WHERE n <= 300""")
def pairwise_examples(spark, d):
    """At most 300 pairs a topic, in the seeded order."""
    return rerank.pairs(S.feature_rows(spark, d), ["f1", "f3"], most=300)


_STD = _with("qrels", "feature_rows") + ", st AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM feature_rows)"


@query("RR2 RR3", _STD + " SELECT round(m1, 6) AS mean_f1, round(m3, 6) AS mean_f3, round(s1, 6) AS scale_f1, round(s3, 6) AS scale_f3 FROM st")
def standardise(spark, d):
    got = rerank.feature_stats(S.feature_rows(spark, d), ["f1", "f3"])
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("RK7 RR3 RR4 RR7", _with("run_b", "qrels", "feature_rows") + """, sc AS (SELECT topic_id, visual_id, (f1 - 20) / 10 * 0.5 + (f3 - 2) / 1.5 * 0.25 AS model FROM feature_rows),
r AS (SELECT topic_id, visual_id, score, model, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS fr FROM run_b LEFT JOIN sc USING (topic_id, visual_id)),
t AS (SELECT *, fr <= 200 AND model IS NOT NULL AS top FROM r),
x AS (SELECT *, CASE WHEN top THEN 0.8 * CASE WHEN max(model) OVER p > min(model) OVER p THEN (model - min(model) OVER p) / (max(model) OVER p - min(model) OVER p) ELSE 1 END
      + (1 - 0.8) * CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1 END END AS mixed FROM t WINDOW p AS (PARTITION BY topic_id, top))
SELECT topic_id, visual_id, (count(*) OVER (PARTITION BY topic_id) - row_number() OVER (PARTITION BY topic_id ORDER BY top DESC, round(mixed, 9) DESC NULLS LAST, fr) + 1)::DOUBLE AS score FROM x""")
def rerank_apply(spark, d):
    model = rerank.Reranker(["f1", "f3"], [20.0, 2.0], [10.0, 1.5], [0.5, 0.25])
    scored = S.feature_rows(spark, d).select("topic_id", "visual_id", model.score().alias("model"))
    return rerank.rerank(S.run_b(spark, d), scored, 200, 0.8)


@query("RR5")
def grid_select(spark, d):
    f = S.feature_rows(spark, d)
    scored = {0.1: f.select("topic_id", "visual_id", (F.col("f1") / 50).alias("model")), 1.0: f.select("topic_id", "visual_id", (F.col("f3") / 7).alias("model"))}
    return rerank.select_setting(rerank.grid(S.run_b(spark, d), scored, S.synth_qrels(spark, d), [50, 200], [0.5, 1.0]))


@query("RR2 RK9")
def pairwise_lr(spark, d):
    model = rerank.fit(S.feature_rows(spark, d), ["f1", "f2", "f3"], c=1.0)
    return spark.createDataFrame(list(zip(model.names, model.mean, model.scale, model.weights, strict=True)), "name string, mean double, scale double, weight double")


@query("FE6 FE2 GR1 GR2 TXT2")
def tree_edit_pairs(spark, d):
    """Structural features of formula pairs made from suppliers: each against the next."""
    from ..functions.udfs import parse_formulas
    from ..operators.pairwise import graph_pairs, pair_features

    k = F.col("s_suppkey")
    letter = F.substring("s_name", 1, 1)
    slt = F.concat(F.lit("<math><msup><mi>"), letter, F.lit("</mi><mn>"), (k % 7).cast("string"), F.lit("</mn></msup><mo>+</mo><mfrac><mi>x</mi><mn>"), k.cast("string"), F.lit("</mn></mfrac></math>"))
    opt = F.concat(F.lit("<math><apply><plus/><apply><csymbol>superscript</csymbol><ci>"), letter, F.lit("</ci><cn>"), (k % 7).cast("string"), F.lit("</cn></apply><apply><divide/><ci>x</ci><cn>"), k.cast("string"), F.lit("</cn></apply></apply></math>"))
    parsed = parse_formulas(S.table(spark, d, "supplier").select(k.alias("id"), slt.alias("slt"), opt.alias("opt")))
    q = parsed.select(F.col("id").alias("q"), (F.col("id") + 1).alias("id"), F.col("slt_graph").alias("q_slt"), F.col("opt_graph").alias("q_opt"))
    c = parsed.select("id", F.col("slt_graph").alias("c_slt"), F.col("opt_graph").alias("c_opt"))
    return pair_features(graph_pairs(q, c, "id").withColumnRenamed("id", "c"))


def _encoded_formulas(spark, d):
    """Suppliers as formulas, parsed, and encoded with a vocabulary of the symbols they use."""
    from ..functions.udfs import parse_formulas

    k = F.col("s_suppkey")
    letter = F.element_at(F.array(*[F.lit(x) for x in "abcxyz"]), (k % 6 + 1).cast("int"))
    slt = F.concat(F.lit("<math><msup><mi>"), letter, F.lit("</mi><mn>"), (k % 7 + 10).cast("string"), F.lit("</mn></msup><mo>+</mo><mi>x</mi></math>"))
    opt = F.concat(F.lit("<math><apply><plus/><apply><csymbol>superscript</csymbol><ci>"), letter, F.lit("</ci><cn>"), (k % 7 + 10).cast("string"), F.lit("</cn></apply><ci>x</ci></apply></math>"))
    parsed = parse_formulas(S.table(spark, d, "supplier").select(k.alias("item"), k.cast("string").alias("visual_id"), slt.alias("slt"), F.when(k % 5 != 0, opt).alias("opt")))
    symbols = {t: i for i, t in enumerate([*graphs.SPECIAL_SYMBOLS, "a", "b", "c", "x", "y", "z", *map(str, range(10, 17)), "+", "superscript"])}
    tags = {t: i for i, t in enumerate(["<pad>", "<unk>", "mi", "mn", "mo", "ci", "cn", "csymbol", "plus"])}
    enc = lambda g, types: graphs.encode(F.col(g), graphs.as_map(tags), graphs.as_map(symbols), types, both_ways=False)
    rows = parsed.select("item", "visual_id", enc("slt_graph", graphs.SLT_EDGES).alias("slt"), enc("opt_graph", graphs.OPT_EDGES).alias("opt"))
    return rows, {r: {"tags": tags, "symbols": symbols} for r in ("slt", "opt")}


@query("AU1 AU2 AU3 AU4 AU5 AU6 GR9 FLT6")
def augmented_views(spark, d):
    from ..operators import encoding

    rows, vocabs = _encoded_formulas(spark, d)
    return encoding.augmented_pairs(encoding.anchors(rows), vocabs, seed=1)


@query("EN1 EN2 EN3 EN8 GR7 GR8")
def corpus_embedding(spark, d):
    """Vectors of random weights: the path, not the quality, of the encoder."""
    from ..functions import encoder
    from ..operators import encoding

    rows, vocabs = _encoded_formulas(spark, d)
    sizes = lambda k: {r: len(vocabs[r][k]) for r in ("slt", "opt")}
    c = encoder.EncoderConfig(hidden=32, layers=2, heads=4, out_dim=16, n_tags=sizes("tags"), n_symbols=sizes("symbols"), n_edge_types={"slt": 2 * len(graphs.SLT_EDGES), "opt": 2 * len(graphs.OPT_EDGES)})
    return encoding.embed(rows, encoder.random_weights(c), c)


# ---- diagnostics ----------------------------------------------------------------------------------------------------


def _tri_sql(a: str, b: str) -> str:
    g = lambda c: f"list_distinct(list_transform(range(1, greatest(1, len({c}) - 2) + 1), lambda i: substr({c}, i, 3)))"
    return f"SELECT page_id, round(len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))), 6) AS similarity FROM (SELECT page_id, {g(a)} AS ga, {g(b)} AS gb FROM p)"


@query("TXT7", "WITH p AS (SELECT a.page_id, regexp_replace(a.url, '\\s+|\\$', '', 'g') AS u, regexp_replace(b.url, '\\s+|\\$', '', 'g') AS v FROM pages a JOIN pages b ON b.page_id = a.page_id + 1) " + _tri_sql("u", "v"))
def trigram_jaccard(spark, d):
    p = S.table(spark, d, "pages").select("page_id", "url")
    pairs = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other")), "page_id")
    return diagnostics.latex_similarity(pairs, "url", "other").select("page_id", F.round("similarity", 6).alias("similarity"))


@query("QD1 AGG12", """WITH h AS (SELECT 'price' AS col, least(3, p_size % 4) AS grade, p_retailprice / 2100 AS sim FROM part UNION ALL SELECT 'size', least(3, p_size % 4), p_size / 50.0 FROM part WHERE p_size > 10),
e AS (SELECT col, count(*) AS n, avg(sim) FILTER (grade >= 2) - avg(sim) FILTER (grade = 0) AS sep FROM h GROUP BY col), r AS (SELECT col, round(n::DOUBLE / (SELECT count(*) FROM part), 6) AS coverage, round(sep::DOUBLE, 6) AS separation FROM e)
SELECT col AS "column", coverage, separation, CAST(rank() OVER (ORDER BY coverage DESC, separation DESC NULLS LAST) AS INTEGER) AS place, coalesce(separation >= 0.05, false) AS plausible FROM r""")
def id_space_verdict(spark, d):
    p = S.table(spark, d, "part")
    grade = F.least(F.lit(3), F.col("p_size") % 4)
    hits = p.select(F.lit("price").alias("column"), grade.alias("grade"), (F.col("p_retailprice") / 2100).alias("similarity")).unionByName(p.where("p_size > 10").select(F.lit("size").alias("column"), grade.alias("grade"), (F.col("p_size") / 50.0).alias("similarity")))
    return diagnostics.verdict(hits, p.agg(F.count("*").alias("n_judged")))


@query("AGG12", "SELECT least(3, p_size % 4) AS grade, round(avg(p_retailprice / 2100), 6) AS mean_similarity, count(*) AS n FROM part GROUP BY 1")
def grade_similarity(spark, d):
    hits = S.table(spark, d, "part").select(F.lit("price").alias("column"), F.least(F.lit(3), F.col("p_size") % 4).alias("grade"), (F.col("p_retailprice") / 2100).alias("similarity"))
    return diagnostics.grade_similarity(hits).select("grade", F.round("mean_similarity", 6).alias("mean_similarity"), "n")


@query("AGG13 FLT10", _with("findex") + """, v AS (SELECT *, CASE WHEN lower(trim(slt)) IN ('', 'none', 'nan', 'null') THEN NULL ELSE trim(slt) END AS value FROM findex)
SELECT value, count(*) AS instances, count(DISTINCT type) AS types, bool_or(opt IS NOT NULL) AS has_xml, md5(string_agg(latex, '|' ORDER BY id) FILTER (n <= 3)) AS latex FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY id) AS n FROM v WHERE value IS NOT NULL) GROUP BY value""")
def index_scan(spark, d):
    x = S.formula_index(spark, d).withColumn("has_xml", F.col("opt").isNotNull())
    got = diagnostics.id_space_scan(x, "slt")
    return got.select("value", "instances", "types", "has_xml", F.md5(F.array_join("latex", "|").cast("binary")).alias("latex"))




@query("AGG15 TXT12 TXT14")
def failure_causes(spark, d):
    """Pages as markup: why reading them fails."""
    from ..functions.udfs import slt_failure
    from ..functions.workers import ship

    ship(spark)
    rows = S.table(spark, d, "pages").select("page_id", F.lit("slt").alias("rep"), slt_failure("html").alias("cause"))
    return diagnostics.failure_causes(rows, "rep", "cause", "page_id")


# The last two repairs look ahead, which the SQL side's regular expressions cannot: there, good entities and tags are marked
# with control characters first, the bare characters replaced, and the marks taken back.
@query("TXT1", r'''WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^\s+|\s+$', '', 'g'), '^\s*<\?xml[^>]*\?>', ''), '\salttext=("[^"]*"|''[^'']*'')', '', 'g'), '</?mpadded\b[^>]*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(regexp_replace(h, '&(#[0-9]+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)', chr(1) || '\1', 'g'), '&', '&amp;'), chr(1), '&') AS h FROM a)
SELECT page_id, md5(replace(replace(regexp_replace(h, '<([A-Za-z/!?])', chr(1) || '\1', 'g'), '<', '&lt;'), chr(1), '<')) AS repaired FROM b''')
def markup_repair(spark, d):
    return S.table(spark, d, "pages").select("page_id", F.md5(C.sanitize("html").cast("binary")).alias("repaired"))


@query("TXT1")
def markup_sanitize(spark, d):
    """Lengths of the repaired markup."""
    return S.table(spark, d, "pages").select("page_id", F.length(C.sanitize("html")).cast("long").alias("n"))


# ---- sampling -------------------------------------------------------------------------------------------------------


@query("FT1 AGG17", _with("qrels") + """, st AS (SELECT CAST(p_partkey AS VARCHAR) AS visual_id FROM part WHERE p_size <= 40), tp AS (SELECT CAST(s_suppkey AS VARCHAR) AS topic_id, s_acctbal > 0 AS g FROM supplier WHERE s_nationkey <> 7),
x AS (SELECT q.topic_id, count(*) FILTER (grade >= 2 AND s.visual_id IS NOT NULL) AS pos, count(*) FILTER (grade < 2 AND s.visual_id IS NOT NULL) AS neg FROM qrels q LEFT JOIN st s USING (visual_id) GROUP BY q.topic_id)
SELECT CASE WHEN g IS NULL THEN 'no_topic' WHEN NOT g THEN 'no_query_graph' WHEN pos = 0 THEN 'no_positive' ELSE 'used' END AS reason, count(*) AS topics, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, count(*) FILTER (neg = 0) AS without_negatives FROM x LEFT JOIN tp USING (topic_id) GROUP BY ALL""")
def finetune_stats(spark, d):
    return finetune.example_stats(_examples(spark, d))


def _examples(spark, d):
    store = S.table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").cast("string").alias("visual_id"))
    tops = S.table(spark, d, "supplier").where("s_nationkey <> 7").select(F.col("s_suppkey").cast("string").alias("topic_id"), (F.col("s_acctbal") > 0).alias("has_graph"))
    return finetune.examples(S.synth_qrels(spark, d), tops, store)


@query("FLT6", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)")
def anchor_filter(spark, d):
    return _order_graphs(spark, d).where(graphs.size_of("graph") >= 3).agg(F.count("*").alias("n"))


@query("SET1 SET3 SET5", _with("run_a", "run_b") + " SELECT count(*) AS n FROM (SELECT visual_id FROM run_a WHERE score > 30 INTERSECT SELECT visual_id FROM run_b WHERE score > 50000)")
def shared_ids(spark, d):
    return S.run_a(spark, d).where("score > 30").select("visual_id").intersect(S.run_b(spark, d).where("score > 50000").select("visual_id")).agg(F.count("*").alias("n"))


from . import files, formulas  # noqa: E402, F401  these register further queries
