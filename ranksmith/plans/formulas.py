"""Registered queries over real markup: parts as formulas x^a + k/y, of which SQL knows every symbol, edge and tuple.

A part's size is the exponent a and its key k the numerator; the variable x goes through the alphabet with the size.  Every
eleventh size has broken presentation markup, every seventh none, and every thirteenth an empty element."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import udfs
from ..functions.workers import ship
from ..operators import bm25, diagnostics, encoding, features, finetune, graphs, pairwise, ranking, rerank
from . import standins as S
from .queries import _examples, _with, query

_LETTERS = "abcdghklmnopqrstuvwxz"  # fixed: one-letter variables of the stand-in, without the constants e and i


def formulas(spark, d):
    """id, brand, x, a, latex, slt, opt."""
    a, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    x = F.substring(F.lit(_LETTERS), (F.col("p_size") % len(_LETTERS) + 1).cast("int"), F.lit(1))
    slt = F.concat(F.lit('<math alttext="a<b"><mrow><msup><mi>'), x, F.lit("</mi><mn>"), a, F.lit("</mn></msup><mo>+</mo><mfrac><mn>"), k, F.lit("</mn><mi>y</mi></mfrac></mrow></math>"))
    slt = F.when(F.col("p_size") % 11 == 0, F.concat(slt, F.lit("<"))).when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 13 == 0, "<math><mrow/></math>").otherwise(slt)
    opt = F.concat(F.lit("<math><apply><plus/><apply><csymbol>superscript</csymbol><ci>"), x, F.lit("</ci><cn>"), a, F.lit("</cn></apply><apply><divide/><cn>"), k, F.lit("</cn><ci>y</ci></apply></apply></math>"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), x.alias("x"), a.alias("a"), F.concat(x, F.lit(r"^{"), a, F.lit(r"}+\frac{"), k, F.lit("}{y}")).alias("latex"), slt.alias("slt"), opt.alias("opt"))


_F = f"""f AS (SELECT p_partkey AS id, p_brand AS brand, substr('{_LETTERS}', CAST(p_size % {len(_LETTERS)} + 1 AS INTEGER), 1) AS x, p_size AS a, p_partkey AS k, p_size % 11 = 0 AS broken, p_size % 7 = 0 AND p_size % 11 <> 0 AS missing,
  p_size % 13 = 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AS blank FROM part)"""


@query("TOK1 TOK2 TOK3 TXT2", f"""WITH {_F} SELECT id, CASE WHEN broken OR missing THEN x || ' ^ ' || array_to_string(string_split(CAST(a AS VARCHAR), ''), ' ') || ' + \\frac ' || array_to_string(string_split(CAST(k AS VARCHAR), ''), ' ') || ' y'
  WHEN blank THEN '' ELSE x || ' ' || a || ' + ' || k || ' y' END AS symbols FROM f""")
def formula_symbols(spark, d):
    """Symbols of the layout; LaTeX tokens only where the markup is missing or unreadable."""
    parsed = udfs.parse_formulas(formulas(spark, d))
    return parsed.select("id", F.array_join(F.coalesce("slt_symbols", C.latex_tokens("latex")), " ").alias("symbols"))


@query("GR1 GR4 TXT12 TXT14", f"""WITH {_F} SELECT id, CASE WHEN broken OR missing OR blank THEN NULL ELSE x || ' -sup-> ' || a || '; ' || x || ' -next-> +; + -next-> mfrac; mfrac -above-> ' || k || '; mfrac -below-> y' END AS edges,
  CASE WHEN broken THEN 'parse' WHEN missing THEN NULL WHEN blank THEN 'empty_graph' ELSE 'ok' END AS outcome FROM f""")
def layout_graphs(spark, d):
    ship(spark)
    parsed = udfs.parse_formulas(formulas(spark, d)).withColumn("outcome", F.split(udfs.slt_failure("slt"), ":")[0])
    return parsed.select("id", F.array_join(graphs.describe(F.col("slt_graph")), "; ").alias("edges"), "outcome")


@query("GR2 GR4", f"""WITH {_F} SELECT id, 'superscript -arg1-> ' || x || '; superscript -arg2-> ' || a || '; plus -arg-> superscript; divide -arg1-> ' || k || '; divide -arg2-> y; plus -arg-> divide' AS edges FROM f""")
def operator_trees(spark, d):
    parsed = udfs.parse_formulas(formulas(spark, d))
    return parsed.select("id", F.array_join(graphs.describe(F.col("opt_graph")), "; ").alias("edges"))


@query("TXT2 TXT1", f"""WITH {_F} SELECT id, CASE WHEN broken OR missing THEN NULL WHEN blank THEN '<math><mrow /></math>' ELSE '<math><mrow><msup><mi>' || x || '</mi><mn>' || a || '</mn></msup><mo>+</mo><mfrac><mn>' || k || '</mn><mi>y</mi></mfrac></mrow></math>' END AS canonical FROM f""")
def canonical_markup(spark, d):
    ship(spark)
    return formulas(spark, d).select("id", udfs.canonical("slt").alias("canonical"))


_LEVELS = {
    "exact": ("'ci:' || x", "'cn:' || a", "'cn:' || k", "'ci:y'", "'csymbol:superscript'"),
    "alpha": ("'ci:V' || vx", "'cn:' || a", "'cn:' || k", "'ci:V' || vy", "'csymbol:superscript'"),
    "unified": ("'ci:VAR'", "'cn:NUM'", "'cn:NUM'", "'ci:VAR'", "'csymbol:superscript'"),
    "structure": ("'ci'", "'cn'", "'cn'", "'ci'", "'csymbol'"),
}


def _tuples_sql() -> str:
    """Every tuple of superscript(x, a) + k / y at each level; variables are numbered in canonical order, where the operands
    of plus are sorted by their shape and 'csymbol:...' comes before 'divide:'."""
    out = []
    for level, (x, a, k, y, sup) in _LEVELS.items():
        plus, div = ("'plus'", "'divide'") if level == "structure" else ("'plus:'", "'divide:'")
        edges = [(sup, "arg1", x), (sup, "arg2", a), (div, "arg1", k), (div, "arg2", y), (plus, "arg", sup), (plus, "arg", div)]
        paths = [(plus, "arg", h, t, z) for h, t, z in edges[:4]]
        for kind, rows in (("edge", edges), ("path", paths)):
            out += [f"SELECT id, '{level}' AS level, '{kind}' AS kind, {' || chr(31) || '.join(p if p[0] == chr(39) else chr(39) + p + chr(39) for p in r)} AS tuple FROM g" for r in rows]
    return "\nUNION ALL ".join(out)


@query("FE1 FE2 FE3 JN13", f"""WITH {_F}, g AS (SELECT *, 1 AS vx, CASE WHEN x = 'y' THEN 1 ELSE 2 END AS vy FROM f), t AS ({_tuples_sql()}) SELECT id, level, kind, tuple, count(*) AS n FROM t GROUP BY ALL""")
def formula_tuples(spark, d):
    """One-, two- and three-edge paths of the operator trees (none has three edges) at the four levels."""
    udfs.register(spark)
    udfs.parse_formulas(formulas(spark, d)).select("id", "opt_graph").createOrReplaceTempView("__opt_graphs")
    return spark.sql("SELECT id, t.level, t.kind, t.tuple, CAST(t.n AS BIGINT) AS n FROM __opt_graphs, LATERAL graph_tuples(opt_graph) t")


@query("FE6 FE7 FE8 FE10 GR1 GR2", f"""WITH {_F}, p AS (SELECT q.id AS q, c.id AS c, q.x = c.x AS sx, q.a = c.a AS sa, q.broken OR q.missing OR q.blank OR c.broken OR c.missing OR c.blank AS gone FROM f q JOIN f c ON c.id = q.id + 1)
SELECT q, c, CASE WHEN gone THEN 1.0 ELSE 0.0 END::DOUBLE AS slt_missing,
  round(CASE WHEN gone THEN 0 ELSE (CASE WHEN sx AND sa THEN 1 ELSE 0 END + CASE WHEN sx THEN 1 ELSE 0 END + 2)::DOUBLE / 5 END, 6) AS slt_exact_edge_recall,
  CASE WHEN gone THEN 0.0 ELSE 1.0 END::DOUBLE AS slt_unified_path_f1,
  round(CASE WHEN gone THEN 0 ELSE 1 - (1 + CASE WHEN sx THEN 0 ELSE 1 END + CASE WHEN sa THEN 0 ELSE 1 END)::DOUBLE / 6 END, 6) AS slt_ted_exact,
  round((3 + CASE WHEN sx THEN 1 ELSE 0 END + CASE WHEN sa THEN 1 ELSE 0 END)::DOUBLE / 6, 6) AS opt_exact_edge_precision,
  round(1 - (1 + CASE WHEN sx THEN 0 ELSE 1 END + CASE WHEN sa THEN 0 ELSE 1 END)::DOUBLE / 7, 6) AS opt_ted_exact_canon, round(1 - (1 + CASE WHEN sa THEN 0 ELSE 1 END)::DOUBLE / 7, 6) AS opt_ted_alpha_canon
FROM p""")
def structural_features(spark, d):
    """Features of each formula against the next: overlaps and edit similarities known from what the two share."""
    parsed = udfs.parse_formulas(formulas(spark, d))
    q = parsed.select(F.col("id").alias("q"), (F.col("id") + 1).alias("c"), F.col("slt_graph").alias("q_slt"), F.col("opt_graph").alias("q_opt"))
    c = parsed.select(F.col("id").alias("c"), F.col("slt_graph").alias("c_slt"), F.col("opt_graph").alias("c_opt"))
    got = pairwise.pair_features(pairwise.graph_pairs(q, c, "c"))
    names = ("slt_missing", "slt_exact_edge_recall", "slt_unified_path_f1", "slt_ted_exact", "opt_exact_edge_precision", "opt_ted_exact_canon", "opt_ted_alpha_canon")
    return got.select("q", "c", *[F.round(n, 6).alias(n) for n in names])


_STATUS = "CASE WHEN p_size % 11 = 0 THEN 'unparseable_or_empty' WHEN p_size % 7 = 0 THEN 'missing' WHEN p_size % 13 = 0 THEN 'unparseable_or_empty' ELSE 'ok' END"


@query("SRC3 AGG5", f"SELECT {_STATUS} AS status, count(*) AS n FROM part GROUP BY 1")
def graph_status(spark, d):
    return graphs.status(udfs.parse_formulas(formulas(spark, d)), "slt", "slt_graph")


@query("TXT5 TXT6 AGG14", "SELECT p_brand, CASE p_size % 5 WHEN 0 THEN 'no_alttext' WHEN 1 THEN 'match' WHEN 2 THEN 'cosmetic' WHEN 3 THEN 'same_symbols' ELSE 'different' END AS bucket, count(*) AS n FROM part GROUP BY ALL")
def mismatch_buckets(spark, d):
    """Each part's LaTeX against the alttext of markup, which differs from it in a known way."""
    n, k = F.col("p_size") % 5, F.col("p_partkey").cast("string")
    latex = F.concat(F.lit(r"\frac{a}{b}\le x"), k)
    alt = F.when(n == 1, F.concat(F.lit("\\frac{a}%\n {b}\\le  x"), k)).when(n == 2, F.concat(F.lit(r"\displaystyle\frac ab\,\le x"), k, F.lit(".")))
    alt = alt.when(n == 3, F.concat(F.lit(r"\frac[a](b)\leq x_"), k)).when(n == 4, F.concat(F.lit("y"), k))
    slt = F.concat(F.lit("<math"), F.coalesce(F.concat(F.lit(' alttext="'), alt, F.lit('"')), F.lit("")), F.lit("><mi>x</mi></math>"))
    rows = S.table(spark, d, "part").select("p_brand", latex.alias("latex"), slt.alias("slt"))
    return diagnostics.mismatch_buckets(rows.withColumn("alttext", C.alttext("slt")), "p_brand")


@query("AGG15 TXT12 TXT14", f"""WITH {_F}, c AS (SELECT id, CASE WHEN broken THEN 'parse' WHEN blank THEN 'empty_graph' ELSE 'ok' END AS cause FROM f WHERE NOT missing),
r AS (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY id) AS n FROM c) SELECT 'slt' AS rep, cause, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (n <= 3) AS examples FROM r GROUP BY cause""")
def formula_failures(spark, d):
    """Why markup cannot be read: the reader's message without what follows its kind."""
    ship(spark)
    rows = formulas(spark, d).where("slt is not null").select("id", F.lit("slt").alias("rep"), F.split(udfs.slt_failure("slt"), ":")[0].alias("cause"))
    return diagnostics.failure_causes(rows, "rep", "cause", "id").withColumn("examples", F.array_join("examples", ","))


@query("AGG13 QD1", "SELECT min(p_partkey) AS least, max(p_partkey) AS greatest, count(*) AS rows, count(*) FILTER (p_size % 3 = 0) AS old_equal, count(*) FILTER (p_size % 3 = 1) AS old_missing FROM part")
def id_space_summary(spark, d):
    k = F.col("p_partkey").cast("string")
    old = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), k)).when(F.col("p_size") % 3 == 1, "NaN").otherwise(F.concat(F.lit("o"), k))
    return diagnostics.id_space_summary(S.table(spark, d, "part").select(k.alias("visual_id"), old.alias("old_visual_id")))


# ---- samplers and grids ---------------------------------------------------------------------------------------------

_HEX = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"


@query("RK11 FLT8", "SELECT * FROM part ORDER BY md5('1|' || p_partkey), p_partkey LIMIT 100")
def hash_sample(spark, d):
    return ranking.hash_sample(S.table(spark, d, "part"), 100, "p_partkey", seed=1)


@query("FLT8", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_HEX.format(chr(39) + '0|' + chr(39) + ' || l_orderkey')} % 50 = 0")
def every_nth(spark, d):
    return ranking.every_nth(S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), 50, "l_orderkey")


@query("FT3", "SELECT step, CAST(slot AS INTEGER) AS slot, topic_id FROM (SELECT CAST(s AS INTEGER) AS step, CAST(s_suppkey AS VARCHAR) AS topic_id, row_number() OVER (PARTITION BY s ORDER BY md5('0|' || s_suppkey || '|' || s), CAST(s_suppkey AS VARCHAR)) - 1 AS slot FROM supplier, range(8) r(s)) WHERE slot < 16")
def topic_batches(spark, d):
    return finetune.batches(S.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("topic_id")), 16, 8)


_DRAW = lambda n, what: f"({_HEX.format(f'{chr(39)}0|{chr(39)} || topic_id || {chr(39)}|{chr(39)} || draw || {chr(39)}|{what}{chr(39)}')} % {n})"


@query("FT2 FT3", _with("qrels") + f""", st AS (SELECT CAST(p_partkey AS VARCHAR) AS visual_id FROM part WHERE p_size <= 40), tp AS (SELECT CAST(s_suppkey AS VARCHAR) AS topic_id FROM supplier WHERE s_nationkey <> 7 AND s_acctbal > 0),
x AS (SELECT topic_id, list_sort(list(visual_id) FILTER (grade >= 2)) AS pos FROM qrels SEMI JOIN st USING (visual_id) SEMI JOIN tp USING (topic_id) GROUP BY topic_id),
u AS (SELECT topic_id, draw, pos, len(pos) AS n FROM x, range(4) r(draw) WHERE len(pos) > 0),
i AS (SELECT *, {_DRAW('n', 'first')} AS i, n < 2 OR {_DRAW(1 << 20, 'anchor')} >= {1 << 19} AS own FROM u),
o AS (SELECT *, (i + 1 + CASE WHEN n > 1 THEN {_DRAW('greatest(n - 1, 1)', 'second')} ELSE 0 END) % n AS j, md5('0|' || topic_id || '|' || draw || '|corpus') AS at FROM i),
ring AS (SELECT CAST(p_partkey AS VARCHAR) AS visual_id, md5('0|' || p_partkey) AS h FROM part),
c AS (SELECT o.topic_id, o.draw, coalesce(arg_min(ring.visual_id, ring.h) FILTER (ring.h >= o.at), arg_min(ring.visual_id, ring.h)) AS random FROM o, ring GROUP BY o.topic_id, o.draw)
SELECT topic_id, CAST(draw AS INTEGER) AS draw, CASE WHEN NOT own THEN pos[i + 1] END AS anchor, CASE WHEN own THEN pos[i + 1] ELSE pos[j + 1] END AS positive, random AS negative FROM o JOIN c USING (topic_id, draw)""")
def triples_with_random_negatives(spark, d):
    """Topics that know relevant documents only: a random formula of the corpus stands in."""
    relevant = _examples(spark, d).withColumn("negatives", F.array().cast("array<string>"))
    return finetune.triples(relevant, 4, corpus=S.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("visual_id")))


@query("FT2 FT3", _with("qrels") + f""", st AS (SELECT CAST(p_partkey AS VARCHAR) AS visual_id FROM part WHERE p_size <= 40), tp AS (SELECT CAST(s_suppkey AS VARCHAR) AS topic_id FROM supplier WHERE s_nationkey <> 7 AND s_acctbal > 0),
x AS (SELECT topic_id, list_sort(list(visual_id) FILTER (grade >= 2)) AS pos, list_sort(list(visual_id) FILTER (grade < 2)) AS neg FROM qrels SEMI JOIN st USING (visual_id) SEMI JOIN tp USING (topic_id) GROUP BY topic_id),
u AS (SELECT topic_id, draw, pos, coalesce(neg, []) AS neg, len(pos) AS n FROM x, range(4) r(draw) WHERE len(pos) > 0),
i AS (SELECT *, {_DRAW('n', 'first')} AS i, n < 2 OR {_DRAW(1 << 20, 'anchor')} >= {1 << 19} AS own FROM u),
o AS (SELECT *, (i + 1 + CASE WHEN n > 1 THEN {_DRAW('greatest(n - 1, 1)', 'second')} ELSE 0 END) % n AS j FROM i)
SELECT topic_id, CAST(draw AS INTEGER) AS draw, CASE WHEN NOT own THEN pos[i + 1] END AS anchor, CASE WHEN own THEN pos[i + 1] ELSE pos[j + 1] END AS positive, CASE WHEN len(neg) > 0 THEN neg[{_DRAW('greatest(len(neg), 1)', 'negative')} + 1] END AS negative FROM o""")
def finetune_triples(spark, d):
    return finetune.triples(_examples(spark, d), 4)


@query("GR5 GR6 TXT10 GR3", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_partkey) AS i, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t FROM lineitem)
SELECT l_orderkey, string_agg(CASE l_linestatus WHEN 'O' THEN '2' ELSE '1' END, ',' ORDER BY i) AS tags, string_agg(CASE l_partkey WHEN 7 THEN '10' ELSE '1' END, ',' ORDER BY i) AS symbols,
  string_agg('0-' || i || '-' || t, ',' ORDER BY i) || ',' || string_agg(i || '-0-' || (t + 3), ',' ORDER BY i) AS edges FROM l GROUP BY l_orderkey""")
def graph_codes(spark, d):
    """The codes of graph_encode as text; the order's own node is left out of tags and symbols."""
    from .queries import QUERIES

    text = lambda c: F.array_join(F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x.cast("string")), ",")
    edges = F.array_join(F.transform("edges", lambda e: F.concat_ws("-", e["src"].cast("string"), e["dst"].cast("string"), e["type"].cast("string"))), ",")
    return QUERIES["graph_encode"](spark, d).select("l_orderkey", text(F.col("tag")).alias("tags"), text(F.col("symbol")).alias("symbols"), edges.alias("edges"))


_UNIT = "CASE WHEN max({0}) OVER p > min({0}) OVER p THEN ({0} - min({0}) OVER p) / (max({0}) OVER p - min({0}) OVER p) ELSE 1.0 END"


@query("RR5 RR6 FE8", _with("run_b", "qrels", "feature_rows") + f""", cov AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM feature_rows GROUP BY topic_id)), dp AS (SELECT DISTINCT least(d, n) AS depth FROM (SELECT unnest([50, 200]) AS d), cov),
st AS (SELECT *, row_number() OVER (ORDER BY c, depth, alpha) - 1 AS n FROM (SELECT unnest([0.1, 1.0])::DOUBLE AS c), dp, (SELECT unnest([0.5, 1.0])::DOUBLE AS alpha)),
fr AS (SELECT topic_id, visual_id, score, f1 / 50 AS m1, f3 / 7 AS m2, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, visual_id DESC) AS fr FROM run_b LEFT JOIN feature_rows USING (topic_id, visual_id)),
x AS (SELECT st.*, topic_id, visual_id, fr, score, CASE WHEN c < 0.5 THEN m1 ELSE m2 END AS model FROM fr, st), t AS (SELECT *, fr <= depth AND model IS NOT NULL AS top FROM x),
y AS (SELECT *, CASE WHEN top THEN alpha * {_UNIT.format('model')} + (1 - alpha) * {_UNIT.format('score')} END AS mixed FROM t WINDOW p AS (PARTITION BY n, topic_id, top)),
o AS (SELECT *, row_number() OVER (PARTITION BY n, topic_id ORDER BY top DESC, mixed DESC NULLS LAST, fr) AS place FROM y),
g AS (SELECT n, topic_id, grade, row_number() OVER (PARTITION BY n, topic_id ORDER BY place) AS rank FROM (SELECT * FROM o WHERE place <= 1000) JOIN qrels USING (topic_id, visual_id)),
i AS (SELECT topic_id, sum(grade / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY grade DESC) AS r FROM qrels) GROUP BY topic_id),
s AS (SELECT n, topic_id, sum(grade / log2(rank + 1)) AS dcg FROM g GROUP BY ALL)
SELECT c, CAST(depth AS INTEGER) AS depth, alpha, round(avg(CASE WHEN idcg > 0 THEN coalesce(dcg / idcg, 0) ELSE 0 END), 6) AS ndcg, count(*) AS topics FROM i CROSS JOIN st LEFT JOIN s ON s.topic_id = i.topic_id AND s.n = st.n GROUP BY c, depth, alpha""")
def rerank_grid(spark, d):
    """Every setting's mean; depths are held to what the reranker covers."""
    f = S.feature_rows(spark, d)
    scored = {0.1: f.select("topic_id", "visual_id", (F.col("f1") / 50).alias("model")), 1.0: f.select("topic_id", "visual_id", (F.col("f3") / 7).alias("model"))}
    got = rerank.grid(S.run_b(spark, d), scored, S.synth_qrels(spark, d), [50, 200], [0.5, 1.0])
    return got.groupBy("c", "depth", "alpha").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("topics"))


@query("RR6 FU4")
def rerank_cross_validation(spark, d):
    """Each topic under the setting chosen on the other folds; folds from a seeded permutation of the topics."""
    f, q = S.feature_rows(spark, d), S.synth_qrels(spark, d)
    results = rerank.grid(S.run_b(spark, d), {1.0: f.select("topic_id", "visual_id", (F.col("f1") / 50).alias("model"))}, q, [20, 200], [0.5, 1.0])
    folds = ranking.topic_folds([r["topic_id"] for r in q.select("topic_id").distinct().collect()], 5)
    return rerank.cross_validate(results, spark.createDataFrame(list(folds.items()), "topic_id string, fold int"))


# ---- scalar forms, views, loss --------------------------------------------------------------------------------------


@query("TXT4 TXT11", "SELECT p_partkey, substr('x1 ' || p_brand || ' ' || p_type, 1, 30) AS symbol, lower(p_type) AS post_type, regexp_replace(p_brand || '/' || p_size || ' a', '[^A-Za-z0-9_-]+', '-', 'g') AS run_id FROM part")
def symbol_forms(spark, d):
    """Wide letters, a superscript and runs of white space in what becomes a symbol; types and run ids with odd characters."""
    ship(spark)
    wide = F.concat(F.lit("ｘ¹ \t "), F.col("p_brand"), F.lit("\n"), F.col("p_type"), F.lit(" "))
    run_id = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string"), F.lit(" a"))
    return S.table(spark, d, "part").select("p_partkey", udfs.normalize_symbol(wide).alias("symbol"), C.post_type(F.concat(F.lit(" "), "p_type", F.lit("\t"))).alias("post_type"), C.safe_run_id(run_id).alias("run_id"))


@query("AU1 AU2 AU4 AU5 AU6 GR9", "SELECT CAST(s_suppkey AS VARCHAR) AS visual_id, CASE WHEN s_suppkey % 5 = 0 THEN '4' ELSE '4|5' END AS nodes, CASE WHEN s_suppkey % 5 = 0 THEN '3' ELSE '3|4' END AS edges, true AS same_class, true AS injective, true AS alike FROM supplier")
def renamed_views(spark, d):
    """What renaming keeps: nodes and edges, the class of each symbol, one new name for each old one, and the same name in both
    representations."""
    from ..functions.augment import Augmentation
    from .queries import _encoded_formulas

    rows, vocabs = _encoded_formulas(spark, d)
    views = encoding.augmented_pairs(rows, vocabs, Augmentation(p_rename=1.0, p_numbers=1.0, p_crop=0.0, p_drop_modality=0.0), seed=3)
    number = {s: i for s, i in vocabs["slt"]["symbols"].items()}
    kind = F.create_map(*[F.lit(x) for s, i in number.items() for x in (i, "var" if s in "abcxyz" else f"int{len(s)}" if s.isdigit() else s)])
    both = views.join(rows.select("visual_id", F.col("slt").alias("slt"), F.col("opt").alias("opt")), "visual_id")
    classes = lambda c: F.transform(F.col(f"{c}.symbol"), lambda i: F.element_at(kind, i))
    size = lambda f: F.concat_ws("|", f("a_slt").cast("string"), f("a_opt").cast("string"))
    pairs = F.array_distinct(F.arrays_zip(F.col("slt.symbol").alias("old"), F.col("a_slt.symbol").alias("new")))
    olds, news = F.array_distinct(F.transform(pairs, lambda p: p["old"])), F.array_distinct(F.transform(pairs, lambda p: p["new"]))
    # x^n + x as layout x, n, +, x; as operators plus, superscript, x, n, x
    alike = F.col("opt").isNull() | ((F.get("a_slt.symbol", F.lit(0)) == F.get("a_opt.symbol", F.lit(2))) & (F.get("a_slt.symbol", F.lit(1)) == F.get("a_opt.symbol", F.lit(3))))
    return both.select(
        "visual_id", size(lambda c: F.when(F.col(c).isNotNull(), F.size(f"{c}.tag"))).alias("nodes"), size(lambda c: F.when(F.col(c).isNotNull(), F.size(f"{c}.edges"))).alias("edges"),
        ((classes("slt") == classes("a_slt")) & F.coalesce(classes("opt") == classes("a_opt"), F.lit(True))).alias("same_class"), ((F.size(pairs) == F.size(olds)) & (F.size(olds) == F.size(news))).alias("injective"), alike.alias("alike"),
    )


@query("EN5", """WITH v AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings), a AS (SELECT label, i // 2 AS k, e FROM v WHERE i % 2 = 0), b AS (SELECT label, i // 2 AS k, e FROM v WHERE i % 2 = 1),
s AS (SELECT a.label, a.k AS ka, b.k AS kb, list_cosine_similarity(a.e, b.e) / 0.07 AS s FROM a JOIN b USING (label) WHERE a.k IN (SELECT k FROM b x WHERE x.label = a.label)),
r AS (SELECT label, ka AS k, ln(sum(exp(s))) - sum(s) FILTER (ka = kb) AS loss, CASE WHEN max(s) FILTER (ka = kb) >= max(s) THEN 1 ELSE 0 END AS hit FROM s GROUP BY label, ka), c AS (SELECT label, kb AS k, ln(sum(exp(s))) - sum(s) FILTER (ka = kb) AS loss FROM s GROUP BY label, kb)
SELECT label, round((avg(r.loss) + avg(c.loss)) / 2, 6) AS loss, round(avg(hit), 6) AS accuracy FROM r JOIN c USING (label, k) GROUP BY label""")
def contrastive_loss(spark, d):
    """The symmetric loss of a batch for each label: its vectors in pairs, in order."""
    import numpy as np
    import pandas as pd

    from ..functions.encoder import info_nce

    ship(spark)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        e = np.array(part.sort_values("vec_id").embedding.tolist(), float)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        n = len(e) // 2
        loss, accuracy = info_nce(e[0 : 2 * n : 2], e[1 : 2 * n : 2])
        return pd.DataFrame({"label": [part.label.iloc[0]], "loss": [round(loss, 6)], "accuracy": [round(accuracy, 6)]})

    return S.table(spark, d, "embeddings").groupBy("label").applyInPandas(each, "label int, loss double, accuracy double")
