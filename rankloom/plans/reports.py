"""Queries for composed loads, comparisons of screens, reports and checks of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators import bands as B
from rankloom.operators import checks as K
from rankloom.operators import corpus as C
from rankloom.operators import curves as V
from rankloom.operators import evaluation as E
from rankloom.operators import fusion as U
from rankloom.operators import prior as P
from rankloom.operators import rerank as R
from rankloom.operators.ranking import numbered
from rankloom.plans import corpora, evaluations, retrievals
from rankloom.plans.catalogue import query, rounded
from rankloom.plans.predict import Inputs, Settings, predict, retrieve
from rankloom.sources import files, roles
from rankloom.sources.roles import ROLES_SQL

# Documents and composed loads


@query("""SELECT p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name, p_type AS "group", CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS alternates, '' AS definition FROM part""")
def release_entries(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("Name")  # to_json() leaves nulls out
    raw = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("Code"), name, F.col("p_type").alias("Classification Name"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).alias("Alternate Name")))
    own = part.select(F.from_json(raw, files.ENTRY).alias("e")).select(F.col("e.Code").cast("long").alias("code"), *files.entry_fields())
    return own.select("code", "name", "group", F.array_join("alternates", ",").alias("alternates"), "definition")


def _band_document(spark, sf_dir):
    frozen = evaluations.frozen(spark, sf_dir).groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct(F.col("code").cast("string"), "count"))).alias("codes"))
    return frozen.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("band", "codes"))).alias("labels"))).alias("value"))


FROZEN = "WITH " + ROLES_SQL + """, frozen AS (SELECT code, count(*) AS count, CASE WHEN count(*) >= 5 THEN 'head' WHEN count(*) >= 3 THEN 'torso' ELSE 'tail' END AS band
  FROM raw_assignments WHERE split BETWEEN 1 AND 9 GROUP BY code)"""


@query(FROZEN + " SELECT CAST(code AS VARCHAR) AS code, band FROM frozen")
def document_bands(spark, sf_dir):
    return files.bands_of(_band_document(spark, sf_dir)).select("code", "band")


@query(FROZEN + " SELECT CAST(code AS VARCHAR) AS code, count FROM frozen")
def document_counts(spark, sf_dir):
    return files.bands_of(_band_document(spark, sf_dir)).select("code", "count")


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'gnd:' || c_nationkey WHEN 1 THEN 'gnd:' || c_nationkey || ',gnd:x' WHEN 2 THEN '' ELSE '' END AS subjects FROM customer""")
def graph_subjects(spark, sf_dir):
    one = F.concat(F.lit('{"@id": "gnd:'), F.col("c_nationkey"), F.lit('"}'))
    several = F.concat(F.lit("["), one, F.lit(', {"@id": "ddc:1"}, {"@id": "gnd:x"}, '), one, F.lit("]"))
    m = F.col("c_custkey") % 4
    value = F.when(m == 0, one).when(m == 1, several).when(m == 2, F.lit('{"@id": "ddc:2"}'))
    return roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_join(files.subjects_of(value), ",").alias("subjects"))


@query("""SELECT conv_id, role, count(*) AS n FROM (SELECT DISTINCT conv_id, role, turn FROM conversations c WHERE turn >= 2 AND NOT EXISTS (SELECT 1 FROM conversations l WHERE l.turn < 2 AND l.conv_id = c.conv_id AND l.role = c.role)) GROUP BY conv_id, role""")
def unlogged_rows(spark, sf_dir):
    turns = roles.table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    fresh = files.unlogged(turns.where("turn >= 2").dropDuplicates(), turns.where("turn < 2"), ["conv_id", "role"], ["conv_id", "role", "turn"])
    return fresh.groupBy("conv_id", "role").agg(F.count("*").alias("n"))


ASSEMBLED = corpora.MERGE + """, held AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0), known AS (SELECT o_orderkey AS id, o_orderpriority AS kind FROM orders),
loaded AS (SELECT m.id, k.kind, copies, subjects FROM merged m JOIN united USING (id) LEFT JOIN known k ON k.id = m.id WHERE m.id NOT IN (SELECT id FROM held)),
split_counts AS (SELECT 'index' AS part, count(*) AS n FROM loaded UNION ALL SELECT 'vocabulary', count(*) FROM part UNION ALL SELECT 'queries', count(*) FROM held)"""


def _load(spark, sf_dir):
    """Everything that a run reads: the queries of a split, the vocabulary, and the merged corpus without the split's records.

    What an order's lines say of the order itself is the same in all of them, so the load refuses none.
    """
    orders = roles.table(spark, sf_dir, "orders")
    held = orders.where("o_orderkey % 10 = 0").select(F.lit("dev").alias("split"), F.col("o_orderkey").alias("id"))
    lines = corpora.order_lines(spark, sf_dir).drop("kind").join(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind")), "id", "left")
    return C.assembled_load(C.merge(lines, "id", "arrived", ["kind"], "subjects"), held, roles.vocabulary(spark, sf_dir), "id")


@query(ASSEMBLED + " SELECT part, n FROM split_counts")
def load_inputs(spark, sf_dir):
    queries, vocabulary, index = _load(spark, sf_dir)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(index, "index").unionByName(count(vocabulary, "vocabulary")).unionByName(count(queries, "queries"))


@query(ASSEMBLED + " SELECT id, kind, copies, subjects FROM loaded")
def assembled_index(spark, sf_dir):
    return _load(spark, sf_dir)[2].select("id", "kind", "copies", F.array_join(F.col("subjects").cast("array<string>"), ",").alias("subjects"))


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position FROM documents QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 50")
def simple_sample(spark, sf_dir):
    """A sample that knows no cells, back in the order of the corpus."""
    docs = roles.table(spark, sf_dir, "documents").select("doc_id")
    return C.in_corpus_order(C.simple_sample(docs, 50, "doc_id", 42), numbered(docs, [F.col("doc_id")]), "doc_id")


USABLE = "WITH " + ROLES_SQL + """, known AS (SELECT code FROM vocabulary WHERE code % 50 <> 0), usable AS (SELECT r.record_id, type, lang FROM records r
  WHERE EXISTS (SELECT 1 FROM assignments a WHERE a.record_id = r.record_id) AND NOT EXISTS (SELECT 1 FROM assignments a WHERE a.record_id = r.record_id AND a.code NOT IN (SELECT code FROM known)))"""


@query(USABLE + """ SELECT record_id, type, lang, CAST(row_number() OVER (PARTITION BY type, lang ORDER BY md5('7:' || record_id), record_id) - 1 AS INTEGER) AS place FROM usable
  QUALIFY row_number() OVER (PARTITION BY type, lang ORDER BY md5('7:' || record_id), record_id) <= 3""")
def fixture_records(spark, sf_dir):
    """Codes divisible by 50 stand for codes that the vocabulary lacks."""
    own = roles.records(spark, sf_dir).withColumn("text", F.col("type"))
    found = C.choose_per_cell(own, roles.assignments(spark, sf_dir), roles.vocabulary(spark, sf_dir).where("code % 50 <> 0"), ["type", "lang"], 3, 7)
    return found.select("record_id", "type", "lang", "place")


@query("""WITH i AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_orderkey % 10 <> 0), q AS (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_orderkey % 10 = 0), v AS (SELECT p_partkey AS code FROM part),
gone AS (SELECT code FROM i WHERE code NOT IN (SELECT code FROM q) ORDER BY code LIMIT 3), unseen AS (SELECT code FROM v WHERE code NOT IN (SELECT code FROM q) AND code NOT IN (SELECT code FROM i) ORDER BY code LIMIT 1)
SELECT code, 'withheld' AS part FROM gone UNION ALL SELECT code, 'unseen' FROM unseen UNION ALL SELECT code, 'slice' FROM (SELECT code FROM i UNION SELECT code FROM q) WHERE code NOT IN (SELECT code FROM gone)""")
def fixture_codes(spark, sf_dir):
    """The training corpus is the index, the development split the queries: every line is one or the other."""
    codes = lambda where: roles.raw_assignments(spark, sf_dir).where(where).select("code")
    return C.fixture_codes(codes("split <> 0"), codes("split = 0"), roles.vocabulary(spark, sf_dir), 3)


@query("WITH " + ROLES_SQL + """, g AS (SELECT DISTINCT record_id, code FROM assignments WHERE split = 0), most AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM g GROUP BY record_id)),
pool AS (SELECT code FROM (SELECT code, row_number() OVER (ORDER BY md5('5:' || code), code) AS pos FROM vocabulary) WHERE pos <= 10 + (SELECT m FROM most))
SELECT record_id, code, CAST(row_number() OVER (PARTITION BY record_id ORDER BY md5('5:' || code), code) - 1 AS INTEGER) AS rank FROM dev, pool
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.record_id = dev.record_id AND g.code = pool.code) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY md5('5:' || code), code) <= 10""")
def filler_codes(spark, sf_dir):
    dev = roles.records(spark, sf_dir).where("split = 0")
    return C.wrong_codes(dev, retrievals.gold(spark, sf_dir), roles.vocabulary(spark, sf_dir), 10, 5)


# Label text by configuration


@query(corpora.TRANSLATED + """ SELECT code, CASE WHEN english IS NULL OR english = rendered THEN rendered ELSE rendered || ' / ' || english END AS name_form,
  'Fachgebiet: ' || kind || chr(10) || 'Schlagwort: ' || CASE WHEN english IS NULL OR english = rendered THEN rendered ELSE rendered || ' / ' || english END || chr(10) || 'Synonyme: ' || brand || chr(10) || 'Definition: ' || name AS text_form FROM named""")
def reranker_labels(spark, sf_dir):
    from rankloom.functions import text as T

    own = corpora.translated(corpora.terms(spark, sf_dir), F.col("term"), "parenthetical").withColumnsRenamed({"kind": "group", "name": "definition"}).withColumn("synonyms", F.array("brand"))
    forms = [T.config_label(form, F.col("term"), "parenthetical", F.col("english"), F.col("group"), F.col("synonyms"), F.col("definition")).alias(f"{form}_form") for form in ("name", "text")]
    return own.select("code", *forms)


# The whole plan, on keys that are strings

STRINGS = retrievals.NEAR.replace("SELECT vec_id AS id,", "SELECT 'r' || vec_id AS id, vec_id,").replace("SELECT id, CAST(label AS BIGINT) AS code FROM v UNION SELECT id, 100 + id % 37 FROM v", "SELECT id, 'c' || label AS code FROM v UNION SELECT id, 'c' || (100 + vec_id % 37) FROM v")
STRINGS += """, parts AS (SELECT label, i, avg(CAST(vector[i] AS DOUBLE)) AS x FROM v, range(1, 65) t(i) GROUP BY label, i), norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM parts GROUP BY label),
centres AS (SELECT 'c' || label AS id, list(round(x / n, 6) ORDER BY i) AS vector FROM parts JOIN norms USING (label) GROUP BY label), vocabulary AS (SELECT DISTINCT code FROM subjects WHERE code <> 'c101'),
labelled AS (SELECT * FROM (SELECT v.id AS query, c.id AS code, round(list_dot_product(v.vector, c.vector), 6) AS score FROM v, centres c) WHERE code IN (SELECT code FROM vocabulary)),
harvested AS (SELECT query, code, round(sum(greatest(sim, 0)), 6) AS score FROM near JOIN subjects USING (id) WHERE rank < 20 AND code IN (SELECT code FROM vocabulary) GROUP BY query, code),
lists AS (SELECT query, 'knn' AS source, code, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) - 1 AS rank FROM harvested QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, code) <= 5
  UNION ALL SELECT query, 'dense', code, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) - 1 FROM labelled QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, code) <= 5)"""
SETTINGS = Settings(weights={"knn": 1.0, "dense": 0.5}, neighbours=20, top_k=5, candidates=8, output=6)


def _inputs(spark, sf_dir):
    own = retrievals.vectors(spark, sf_dir).withColumn("code", F.concat(F.lit("c"), F.col("code").cast("string")))
    own, more = own.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "vector", "code"), own.select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("c"), (F.lit(100) + F.col("id") % 37).cast("string")).alias("code"))
    subjects = own.select("id", "code").unionByName(more)
    known = subjects.select("code").distinct().where("code <> 'c101'")
    labels = retrievals.V.centroids(own)
    return Inputs(own.select(F.col("id").alias("record_id"), "vector"), known, documents=own.select("id", "vector"), subjects=subjects, labels=labels.join(known, labels.id == known.code, "left_semi"))


@query(STRINGS + " SELECT query AS record_id, source, CAST(rank AS INTEGER) AS rank, code, score FROM lists")
def retrieve_lists(spark, sf_dir):
    return retrieve(_inputs(spark, sf_dir), SETTINGS)


@query(STRINGS + """, fused AS (SELECT query AS record_id, code, round(sum((CASE source WHEN 'knn' THEN 1.0::DOUBLE ELSE 0.5 END) / (60 + rank + 1)), 9) AS score FROM lists GROUP BY query, code)
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code) - 1 AS INTEGER) AS rank, code, score FROM fused QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code) <= 6""")
def predict_strings(spark, sf_dir):
    return predict(_inputs(spark, sf_dir), SETTINGS)


# Evaluation and reports


@query(evaluations.CELLS + """ SELECT type, lang, k, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM cells
  UNION ALL SELECT 'Overall', '', k, round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM cells GROUP BY k""")
def eval_overall(spark, sf_dir):
    return rounded(E.with_overall(E.official(evaluations.cell_hits(spark, sf_dir), ["type", "lang"]), ["type", "lang"]), "precision", "recall", "f1", places=9)


@query(evaluations.BANDS + f""" SELECT 'micro' AS part, 'all' AS slice, k, {evaluations.MICRO_OUT} FROM (SELECT k, {evaluations.MICRO} FROM hits GROUP BY k)
  UNION ALL SELECT 'band', band, k, {evaluations.MICRO_OUT} FROM band_scores
  UNION ALL SELECT 'language', lang, k, {evaluations.MICRO_OUT} FROM (SELECT lang, k, {evaluations.MICRO} FROM cell_hits GROUP BY lang, k)
  UNION ALL SELECT 'type', type, k, {evaluations.MICRO_OUT} FROM (SELECT type, k, {evaluations.MICRO} FROM cell_hits GROUP BY type, k)""")
def eval_report(spark, sf_dir):
    found = E.report(evaluations.gold(spark, sf_dir), roles.mixed_predictions(spark, sf_dir), evaluations.frozen(spark, sf_dir), roles.records(spark, sf_dir), evaluations.BAND_NAMES)
    return rounded(found, "precision", "recall", "f1")


@query("WITH " + ROLES_SQL + " SELECT record_id FROM dev WHERE record_id NOT IN (SELECT record_id FROM assignments WHERE code % 3 <> 0)")
def records_without_gold(spark, sf_dir):
    """Codes divisible by three don't count as gold here."""
    dev = roles.records(spark, sf_dir).where("split = 0")
    return E.without_gold(dev, roles.assignments(spark, sf_dir).where("code % 3 <> 0"))


@query(evaluations.HITS + evaluations.DUPLICATED + f""", scores AS (SELECT kind, k, p, r FROM (
  SELECT 'with' AS kind, k, {evaluations.MICRO} FROM hits GROUP BY k UNION ALL SELECT 'without' AS kind, k, {evaluations.MICRO} FROM hits WHERE record_id NOT IN (SELECT record_id FROM twins) GROUP BY k))
  SELECT a.k, round(b.p - a.p, 6) AS precision_change, round(b.r - a.r, 6) AS recall_change FROM scores a JOIN scores b USING (k) WHERE a.kind = 'with' AND b.kind = 'without'""")
def duplicates_change(spark, sf_dir):
    both = evaluations.duplicate_scores(spark, sf_dir)
    side = lambda kind: both.where(F.col("kind") == kind).drop("kind")
    return rounded(E.before_after(side("with"), side("without"), ["k"]).select("k", "precision_change", "recall_change"), "precision_change", "recall_change")


@query(evaluations.TURNED + """, sides AS (SELECT 'before' AS side, k, sum(hits)::DOUBLE / (count(*) * k) AS precision FROM hits GROUP BY k UNION ALL SELECT 'after', k, sum(hits)::DOUBLE / (count(*) * k) FROM hits2 GROUP BY k
  UNION ALL SELECT 'achievable', k, avg(least(gold, k) / k::DOUBLE) FROM hits GROUP BY k) SELECT side, k, round(precision, 6) AS precision FROM sides""")
def headline_achievable(spark, sf_dir):
    own = evaluations.gold(spark, sf_dir)
    before, after = (E.micro(E.record_hits(own, p), []) for p in (roles.mixed_predictions(spark, sf_dir), evaluations.turned(spark, sf_dir)))
    row = lambda df, side, c: df.select(F.lit(side).alias("side"), "k", F.col(c).alias("precision"))
    return rounded(row(before, "before", "precision").unionByName(row(after, "after", "precision")).unionByName(row(E.achievable_precision(own, E.KS), "achievable", "achievable")), "precision")


@query(evaluations.CONF + """, n AS (SELECT count(*) AS n, CAST(ceil(count(*) / 5.0) AS BIGINT) AS least FROM conf), placed AS (SELECT record_id, confidence, row_number() OVER (ORDER BY confidence, record_id) AS pos FROM conf)
  SELECT round(corr(confidence, hits_p / 5.0::DOUBLE), 6) AS pearson, count(*) FILTER (WHERE pos <= least) AS least, round(avg(hits_p / 5.0::DOUBLE) FILTER (WHERE pos <= least), 6) AS least_precision, round(avg(hits_p / 5.0::DOUBLE), 6) AS precision
  FROM placed JOIN outcomes USING (record_id), n""")
def calibration_summary(spark, sf_dir):
    own = evaluations.outcomes(spark, sf_dir).select("record_id", (F.col("hits_p") / 5).alias("precision"))
    return rounded(R.calibration_summary(evaluations.confidences(spark, sf_dir), own), "pearson", "least_precision", "precision")


JUDGED = retrievals.SQL_JUDGED


@query(JUDGED + " SELECT count(*) AS responses, count(reason) AS rejected, round(count(reason)::DOUBLE / count(*), 6) AS share FROM judged")
def rejection_counts(spark, sf_dir):
    return rounded(R.rejection_counts(retrievals.adjudicate_validate(spark, sf_dir)), "share")


@query(retrievals.FUSED + """, pairs AS (SELECT f.record_id, f.code, length(type || ' ' || lang) + length(name) AS length FROM fused f JOIN dev USING (record_id) JOIN vocabulary USING (code) WHERE rank < 5)
  SELECT record_id, code, CAST(length AS INTEGER) AS length, CAST((row_number() OVER (ORDER BY length DESC, record_id, code) - 1) // 32 AS BIGINT) AS batch FROM pairs""")
def score_batches(spark, sf_dir):
    texts = roles.records(spark, sf_dir).select("record_id", F.concat_ws(" ", "type", "lang").alias("text"))
    pairs = retrievals.fused(spark, sf_dir).where("rank < 5").select("record_id", "code").join(texts, "record_id").join(roles.vocabulary(spark, sf_dir).select("code", "name"), "code")
    return R.pair_batches(pairs, "text", "name", 32).select("record_id", "code", "length", "batch")


@query('SELECT "group", CAST(row_number() OVER (ORDER BY "group") - 1 AS INTEGER) AS position FROM (SELECT DISTINCT p_type AS "group" FROM part)')
def sorted_groups(spark, sf_dir):
    return P.sorted_groups(roles.vocabulary(spark, sf_dir))


@query("WITH " + ROLES_SQL + """, g AS (SELECT DISTINCT a.record_id, v."group" FROM assignments a JOIN vocabulary v USING (code) JOIN records r ON r.record_id = a.record_id WHERE r.split >= 1 AND v."group" <> 'ECONOMY')
  SELECT (SELECT count(*) FROM records WHERE split >= 1) AS documents, (SELECT count(DISTINCT record_id) FROM g) AS covered, (SELECT count(DISTINCT "group") FROM g) AS present, (SELECT count(DISTINCT "group") FROM vocabulary) AS groups,
  round((SELECT count(*) FROM records WHERE split >= 1) / (SELECT count(DISTINCT "group") FROM vocabulary)::DOUBLE, 6) AS per_group""")
def fit_facts(spark, sf_dir):
    known = P.group_of_code(roles.vocabulary(spark, sf_dir))
    truth = P.record_groups(roles.assignments(spark, sf_dir), known.where("group <> 'ECONOMY'"))
    return rounded(P.fit_facts(roles.records(spark, sf_dir).where("split >= 1"), truth, known), "per_group")


# Screens: an encoder's recall is a sum of quantities; order lines of a flag are a screen

SCREENED = corpora.SCREENS + """, sizes AS (SELECT l_returnflag AS screen, count(*) AS documents FROM lineitem GROUP BY l_returnflag)"""


def _sized(spark, sf_dir):
    return roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("screen")).agg(F.count("*").alias("documents"))


@query(SCREENED + " SELECT screen, documents, CAST(row_number() OVER (ORDER BY documents, screen) - 1 AS INTEGER) AS place FROM sizes")
def screens_by_size(spark, sf_dir):
    return V.by_index_size(_sized(spark, sf_dir))


@query(SCREENED + """, ends AS (SELECT min_by(screen, (documents, screen)) AS smaller, max_by(screen, (documents, screen)) AS larger FROM sizes), both_ends AS (
  SELECT a.encoder, a.recall AS x, b.recall AS y, a.position AS before, b.position AS after FROM ends JOIN ranked a ON a.screen = smaller JOIN ranked b ON b.screen = larger AND b.encoder = a.encoder),
  r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM both_ends),
  t AS (SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(((count(*) - count(*) FILTER (WHERE a.x = b.x)) * (count(*) - count(*) FILTER (WHERE a.y = b.y)))::DOUBLE), 6) AS tau FROM both_ends a JOIN both_ends b ON a.encoder < b.encoder)
  SELECT smaller, larger, (SELECT count(*) FROM both_ends WHERE before <> after) AS moved, (SELECT count(*) FROM both_ends WHERE before <> after) = 0 AS stable, (SELECT round(corr(rx, ry), 6) FROM r) AS rho, tau FROM ends, t""")
def screen_verdict(spark, sf_dir):
    return rounded(V.verdict(corpora.screens(spark, sf_dir), _sized(spark, sf_dir), "encoder", "recall"), "rho", "tau")


@query(SCREENED + " SELECT encoder, max(recall) FILTER (WHERE screen = 'A') AS A, max(recall) FILTER (WHERE screen = 'N') AS N, max(recall) FILTER (WHERE screen = 'R') AS R, max(recall) FILTER (WHERE screen = 'R') - max(recall) FILTER (WHERE screen = 'A') AS change FROM screens GROUP BY encoder")
def screen_table(spark, sf_dir):
    return V.screen_table(corpora.screens(spark, sf_dir), "encoder", "recall", ["A", "N", "R"])


@query(corpora.SYSTEMS + " SELECT round(corr(x, y), 6) AS pearson FROM systems")
def pearson(spark, sf_dir):
    return rounded(V.pearson(corpora.systems(spark, sf_dir), "x", "y"), "pearson")


@query("""WITH s AS (SELECT l_returnflag AS screen, CAST(count(*) AS BIGINT) AS documents, CASE l_returnflag WHEN 'R' THEN 'test' ELSE 'dev' END AS split FROM lineitem GROUP BY l_returnflag)
  SELECT 'split' AS "check", 'dev, test' AS detail UNION ALL SELECT 'encoder at some sizes only', '3' UNION ALL SELECT 'differs', 'seed: 1, 2' UNION ALL SELECT 'records', string_agg(DISTINCT d, ', ' ORDER BY d) FROM (SELECT CAST(documents AS VARCHAR) AS d FROM s)""")
def incomparable_screens(spark, sf_dir):
    """Planted: one screen of another split, an encoder missing from it, another seed, and as many records as order lines."""
    sized = _sized(spark, sf_dir)
    screens = sized.select("screen", "documents", F.when(F.col("screen") == "R", "test").otherwise("dev").alias("split"), F.col("documents").alias("records"), F.lit("all").alias("corpora"), F.lit("1").alias("revision"))
    rows = corpora.screens(spark, sf_dir).where("not (screen = 'R' and encoder = '3')").select("screen", "encoder")
    held = rows.select("screen", "encoder", F.lit("seed").alias("section"), F.when((F.col("screen") == "A") & (F.col("encoder") == "1"), "2").otherwise("1").alias("value"))
    return V.incomparable(screens, rows, held)


@query(retrievals.FUSED + """, gold AS (SELECT DISTINCT record_id, code FROM assignments WHERE split = 0), lists AS (SELECT record_id, source, rank, code FROM rankings UNION ALL SELECT record_id, 'fused', rank, code FROM fused)
  SELECT source, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE rank < k) AS hits, round(count(*) FILTER (WHERE rank < k)::DOUBLE / (SELECT count(*) FROM gold), 6) AS recall FROM lists JOIN gold USING (record_id, code), (VALUES (5), (10), (30)) t(k) GROUP BY source, k""")
def screen_rows(spark, sf_dir):
    return rounded(U.screen(roles.popularity_rankings(spark, sf_dir), retrievals.fused(spark, sf_dir), retrievals.gold(spark, sf_dir), (5, 10, 30)), "recall")


# Checks with planted violations


@query("WITH " + ROLES_SQL + " SELECT record_id FROM dev WHERE type = '5-LOW'")
def check_missing_cells(spark, sf_dir):
    known = roles.records(spark, sf_dir)
    return K.without_cell(known.where("split = 0"), known.where("type <> '5-LOW'"))


@query("WITH " + roles.MIXED_SQL.split("WITH ")[-1] + """ SELECT 'repeated' AS problem, record_id FROM dev WHERE record_id % 30 = 0 UNION ALL SELECT 'no ranking', record_id FROM dev WHERE record_id % 70 = 0""")
def check_alignment(spark, sf_dir):
    dev = roles.records(spark, sf_dir).where("split = 0").select("record_id")
    return K.misaligned_records(dev.unionByName(dev.where("record_id % 30 = 0")), roles.mixed_predictions(spark, sf_dir).where("record_id % 70 <> 0"))


@query("WITH " + ROLES_SQL + """, p AS (SELECT type, lang, record_id || CASE WHEN record_id % 50 = 0 THEN '.txt' ELSE '.json' END AS file, record_id FROM dev WHERE type <> '5-LOW' AND NOT (type = '1-URGENT' AND lang = 'BUILDING') AND record_id % 90 <> 0)
  SELECT DISTINCT 'type' AS grain, type AS place FROM dev WHERE type NOT IN (SELECT type FROM p)
  UNION ALL SELECT DISTINCT 'language', type || '/' || lang FROM dev d WHERE type IN (SELECT type FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.type = d.type AND p.lang = d.lang)
  UNION ALL SELECT 'file', type || '/' || lang || '/' || record_id FROM dev d WHERE EXISTS (SELECT 1 FROM p WHERE p.type = d.type AND p.lang = d.lang) AND record_id NOT IN (SELECT record_id FROM p)
  UNION ALL SELECT 'no JSON', type || '/' || lang || '/' || file FROM p WHERE file LIKE '%.txt'""")
def check_submission(spark, sf_dir):
    dev = roles.records(spark, sf_dir).where("split = 0")
    gold = dev.select("type", "lang", F.concat(F.col("record_id").cast("string"), F.lit(".jsonld")).alias("file"))
    kept = dev.where("type <> '5-LOW' and not (type = '1-URGENT' and lang = 'BUILDING') and record_id % 90 <> 0")
    return K.submission_gaps(gold, kept.select("type", "lang", F.concat(F.col("record_id").cast("string"), F.when(F.col("record_id") % 50 == 0, ".txt").otherwise(".json")).alias("file")))


@query("""SELECT o_orderkey AS name, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1997-06-30' THEN 'marked, but inside the cutoff' ELSE 'outside the cutoff, but not marked' END AS problem FROM orders
  WHERE (CAST(o_orderdate AS DATE) <= DATE '1997-06-30') = (o_orderkey % 2 = 0)""")
def check_appendix(spark, sf_dir):
    models = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").cast("date").alias("created"), F.col("o_orderdate").cast("date").alias("revision_date"), (F.col("o_orderkey") % 2 == 0).alias("appendix"), F.lit("api").alias("provider"))
    return K.appendix_conflicts(models, "1997-06-30", ["api"])


@query("""WITH a AS (SELECT DISTINCT text, lang FROM documents WHERE doc_id % 2 = 0), facts AS (SELECT 'duplicated from even ids' AS fact, count(*) AS n FROM documents d WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM a WHERE a.text = d.text AND a.lang = d.lang)
  UNION ALL SELECT 'duplicated from odd ids', count(*) FROM documents d WHERE doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 2 = 1 AND b.text = d.text AND b.lang = d.lang)
  UNION ALL SELECT 'unreadable', count(*) FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL) SELECT fact, n FROM facts""")
def split_facts(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    count = lambda df, name: df.agg(F.lit(name).alias("fact"), F.count("*").alias("n"))
    return count(C.duplicated_from(odd, even, "doc_id", ["text", "lang"]), "duplicated from even ids").unionByName(
        count(C.duplicated_from(even, odd, "doc_id", ["text", "lang"]), "duplicated from odd ids")
    ).unionByName(count(docs.where("lang is null or lang not in ('en', 'de')"), "unreadable"))


@query(evaluations.CELLS + """ SELECT type, lang, CAST(k AS BIGINT) AS k, round(precision, 9) AS precision FROM cells""")
def run_documents(spark, sf_dir):
    """Rows as nested JSON documents, and what is read back from them."""
    own = rounded(E.official(evaluations.cell_hits(spark, sf_dir), ["type", "lang"]), "precision", places=9)
    written = files.documents(own, {"cell": ["type", "lang"], "scores": ["k", "precision"]})
    back = written.select(F.from_json("document", "cell struct<type: string, lang: string>, scores struct<k: bigint, precision: double>").alias("d"))
    return back.select("d.cell.type", "d.cell.lang", "d.scores.k", "d.scores.precision")


@query(FROZEN + " SELECT band, count(*) AS labels, CAST(sum(count) AS BIGINT) AS assignments FROM frozen GROUP BY band")
def band_report(spark, sf_dir):
    return B.weighted_report(evaluations.frozen(spark, sf_dir))


@query("""WITH r AS (SELECT conv_id AS record_id, max_by(text, turn) AS response FROM conversations WHERE role = 'assistant' GROUP BY conv_id), a AS (SELECT DISTINCT conv_id AS record_id FROM conversations)
SELECT record_id, md5(response) AS response, response IS NULL AS to_call FROM a LEFT JOIN r USING (record_id)""")
def replayed_responses(spark, sf_dir):
    turns = roles.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), "role", "turn", F.col("text").alias("response"))
    found = R.replay(turns.select("record_id").distinct(), files.latest_lines(turns.where("role = 'assistant'"), "record_id", "response", "turn"))
    return found.select("record_id", F.md5(F.col("response").cast("binary")).alias("response"), F.col("response").isNull().alias("to_call"))


@query(retrievals.BOOSTED.split(", lifted AS")[0] + " SELECT count(*) AS candidates, CAST(0 AS BIGINT) AS moved FROM codes")
def prior_identity(spark, sf_dir):
    """A weight of zero leaves every ranking as it is."""
    own = retrievals.candidates(spark, sf_dir)
    plain = retrievals.rank_by(own, ["record_id"], [F.desc("score"), F.col("code")], name="before").select("record_id", "code", "before")
    lifted = P.boost(own, retrievals.distribution(spark, sf_dir), retrievals.code_groups(spark), 0.0)
    return plain.join(lifted, ["record_id", "code"], "left").agg(F.count("*").alias("candidates"), F.count_if(~F.col("before").eqNullSafe(F.col("rank"))).alias("moved"))


@query(evaluations.ROUTED + evaluations.TURNED.removeprefix(evaluations.HITS) + evaluations.BANDS.removeprefix(evaluations.HITS).split(", names AS")[0] + """,
  sides AS (SELECT 'before' AS side, record_id, code, min_rank FROM best UNION ALL SELECT 'after', record_id, code, min_rank FROM best2),
  per AS (SELECT side, coalesce(f.band, 'zero') AS band, k, count(*) AS assignments, count(*) FILTER (WHERE min_rank < k) AS hits FROM sides s LEFT JOIN frozen f USING (code), ks WHERE record_id IN (SELECT record_id FROM routed) GROUP BY 1, 2, 3)
  SELECT a.band, a.k, round(a.hits::DOUBLE / a.assignments, 6) AS recall_before, round(b.hits::DOUBLE / b.assignments, 6) AS recall_after, round(b.hits::DOUBLE / b.assignments - a.hits::DOUBLE / a.assignments, 6) AS recall_change
  FROM per a JOIN per b USING (band, k) WHERE a.side = 'before' AND b.side = 'after'""")
def routed_bands_before_after(spark, sf_dir):
    """Bands that routed records have no codes of are left out."""
    routed = R.route(evaluations.confidences(spark, sf_dir), 0.2)
    own, bands = evaluations.gold(spark, sf_dir).join(routed, "record_id", "left_semi"), evaluations.frozen(spark, sf_dir)
    side = lambda p: E.by_band(own, p, bands, evaluations.BAND_NAMES).where("assignments > 0")
    both = E.before_after(side(roles.mixed_predictions(spark, sf_dir)), side(evaluations.turned(spark, sf_dir)), ["band", "k"])
    return rounded(both.select("band", "k", "recall_before", "recall_after", "recall_change"), "recall_before", "recall_after", "recall_change")


@query(evaluations.MIGRATION + """, each AS (SELECT before AS band, after <> 'zero' AS reached, 'label' AS weighting, 1 AS n FROM moved UNION ALL SELECT before, after <> 'zero', 'assignment', weight FROM moved)
SELECT weighting, band, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE reached), 0) AS BIGINT) AS reached, CAST(coalesce(sum(n) FILTER (WHERE NOT reached), 0) AS BIGINT) AS still_zero FROM each GROUP BY weighting, band""")
def migration_report(spark, sf_dir):
    """Which labels of the scored split the grown corpus reaches, by the band that the small one froze."""
    labels = B.corpus_counts(roles.assignments(spark, sf_dir).where("split = 0")).withColumnRenamed("count", "weight")
    grown = B.corpus_counts(roles.assignments(spark, sf_dir).where("split between 1 and 9"))
    return B.migration_report(labels, evaluations.frozen(spark, sf_dir, 1, 1), grown)


TRAINED = """WITH s AS (SELECT CAST(l_suppkey % 12 AS VARCHAR) AS encoder, l_returnflag AS screen, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY ALL),
pairs AS (SELECT n.encoder, n.quantity AS q0, n.lines AS l0, r.quantity AS q1, r.lines AS l1 FROM s n JOIN s r USING (encoder) WHERE n.screen = 'N' AND r.screen = 'R')"""


@query(TRAINED + """ SELECT encoder, 'off the shelf' AS weights, q0 AS quantity, l0 AS lines FROM pairs UNION ALL SELECT encoder, 'fine-tuned', q1, l1 FROM pairs UNION ALL SELECT encoder, 'added', q1 - q0, l1 - l0 FROM pairs""")
def training_table(spark, sf_dir):
    own = roles.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 12).cast("string").alias("encoder"), F.col("l_returnflag").alias("screen")).agg(
        F.sum("l_quantity").cast("double").alias("quantity"), F.count("*").cast("double").alias("lines")
    )
    return V.training_table(own.where("screen = 'N'"), own.where("screen = 'R'"), "encoder", ["quantity", "lines"])


@query("""WITH r AS (SELECT l_returnflag AS screen, CAST(l_suppkey % 12 AS VARCHAR) AS encoder, CASE WHEN l_linenumber <= 2 THEN 'dense' WHEN l_linenumber <= 4 THEN 'lexical' ELSE 'neighbours' END AS retriever, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL),
f AS (SELECT screen, encoder, sum(value) AS fused FROM r GROUP BY ALL), sizes AS (SELECT screen, CAST(row_number() OVER (ORDER BY count(*), screen) - 1 AS INTEGER) AS size_place FROM (SELECT l_returnflag AS screen FROM lineitem) GROUP BY screen), best AS (
  SELECT encoder, CAST(row_number() OVER (ORDER BY fused DESC, encoder) - 1 AS INTEGER) AS place FROM f WHERE screen = (SELECT max_by(screen, size_place) FROM sizes)),
moved AS (SELECT encoder, retriever, min(value) <> max(value) AS moved FROM r GROUP BY ALL)
SELECT encoder, place, screen, size_place, retriever, value, fused, retriever <> 'neighbours' AND moved AS drifts FROM r JOIN f USING (screen, encoder) JOIN sizes USING (screen) JOIN best USING (encoder) JOIN moved USING (encoder, retriever)""")
def per_retriever(spark, sf_dir):
    """Each retriever alone on each screen; those that read no indexed document are controls, and may not move."""
    retriever = F.when(F.col("l_linenumber") <= 2, "dense").when(F.col("l_linenumber") <= 4, "lexical").otherwise("neighbours").alias("retriever")
    rows = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("screen"), (F.col("l_suppkey") % 12).cast("string").alias("encoder"), retriever).agg(F.count("*").cast("double").alias("recall"))
    whole = rows.groupBy("screen", "encoder").agg(F.sum("recall").alias("recall"))
    return V.per_retriever(rows, whole, _sized(spark, sf_dir), "encoder", "recall", ["dense", "lexical"])
