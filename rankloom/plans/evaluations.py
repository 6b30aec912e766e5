"""Evaluation queries: rankings of the development split against its gold codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import bands as B
from rankloom.operators import curves as C
from rankloom.operators import evaluation as E
from rankloom.operators import rerank as R
from rankloom.plans.catalogue import query, rounded
from rankloom.sources import roles
from rankloom.sources.roles import MIXED_SQL

SCALED = (("head", 5, None), ("torso", 3, 4), ("tail", 1, 2), ("zero", 0, 0))
BAND_NAMES = [b[0] for b in SCALED]


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = roles.records(spark, sf_dir).where("split = 0").select("record_id")
    return roles.assignments(spark, sf_dir).where("split = 0").join(dev, "record_id", "left_semi")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.record_hits(gold(spark, sf_dir), roles.mixed_predictions(spark, sf_dir))


def cell_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).join(roles.records(spark, sf_dir).select("record_id", "type", "lang"), "record_id")


HITS = "WITH " + MIXED_SQL + """, gold AS (SELECT record_id, code FROM assignments WHERE split = 0 AND record_id IN (SELECT record_id FROM dev)),
ks AS (SELECT CAST(k AS INTEGER) AS k FROM range(5, 51, 5) t(k)), best AS (
  SELECT g.record_id, g.code, min(p.rank) AS min_rank FROM gold g LEFT JOIN mixed p USING (record_id, code) GROUP BY g.record_id, g.code
), hits AS (
  SELECT record_id, k, CAST(count(*) FILTER (WHERE min_rank < k) AS BIGINT) AS hits, count(*) AS gold FROM best, ks GROUP BY record_id, k
), cell_hits AS (SELECT h.*, type, lang FROM hits h JOIN dev USING (record_id))"""
MICRO = """sum(hits)::DOUBLE / (count(*) * k) AS p, sum(hits)::DOUBLE / sum(gold) AS r, count(*) AS records, CAST(sum(gold) AS BIGINT) AS assignments"""
MICRO_OUT = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, records, assignments"
OFFICIAL = "avg(round_even(hits::DOUBLE / k, 4)) AS p, avg(round_even(hits::DOUBLE / gold, 4)) AS r, count(*) AS records"
OFFICIAL_OUT = "round(p, 9) AS precision, round(r, 9) AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, records"
CELLS = HITS + f""", cells AS (SELECT type, lang, k, p AS precision, r AS recall, round_even(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1, records
  FROM (SELECT type, lang, k, {OFFICIAL} FROM cell_hits GROUP BY type, lang, k))"""


@query(HITS + " SELECT record_id, k, hits, gold FROM hits")
def eval_hits(spark, sf_dir):
    return hits(spark, sf_dir)


@query(HITS + f" SELECT k, {MICRO_OUT} FROM (SELECT k, {MICRO} FROM hits GROUP BY k)")
def eval_micro(spark, sf_dir):
    return rounded(E.micro(hits(spark, sf_dir), []), "precision", "recall", "f1")


@query(HITS + f" SELECT lang, k, {MICRO_OUT} FROM (SELECT lang, k, {MICRO} FROM cell_hits GROUP BY lang, k)")
def eval_language_micro(spark, sf_dir):
    return rounded(E.micro(cell_hits(spark, sf_dir), ["lang"]), "precision", "recall", "f1")


@query(HITS + f" SELECT type, lang, k, {OFFICIAL_OUT} FROM (SELECT type, lang, k, {OFFICIAL} FROM cell_hits GROUP BY type, lang, k)")
def eval_cells(spark, sf_dir):
    return rounded(E.official(cell_hits(spark, sf_dir), ["type", "lang"]), "precision", "recall", places=9)


@query(HITS + f" SELECT type, k, {OFFICIAL_OUT} FROM (SELECT type, k, {OFFICIAL} FROM cell_hits GROUP BY type, k)")
def eval_type(spark, sf_dir):
    return rounded(E.official(cell_hits(spark, sf_dir), ["type"]), "precision", "recall", places=9)


@query(HITS + f" SELECT lang, k, {OFFICIAL_OUT} FROM (SELECT lang, k, {OFFICIAL} FROM cell_hits GROUP BY lang, k)")
def eval_language(spark, sf_dir):
    return rounded(E.official(cell_hits(spark, sf_dir), ["lang"]), "precision", "recall", places=9)


@query(CELLS + " SELECT k, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS cells FROM cells GROUP BY k")
def eval_macro(spark, sf_dir):
    return rounded(E.macro(E.official(cell_hits(spark, sf_dir), ["type", "lang"])), "precision", "recall", "f1")


BANDS = HITS + """, frozen AS (
  SELECT code, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'head' WHEN count(*) >= 3 THEN 'torso' ELSE 'tail' END AS band
  FROM raw_assignments WHERE split BETWEEN 1 AND 9 GROUP BY code
), names AS (SELECT unnest(['head', 'torso', 'tail', 'zero']) AS band), banded AS (
  SELECT b.*, coalesce(f.band, 'zero') AS band FROM best b LEFT JOIN frozen f USING (code)
), sums AS (
  SELECT band, k, count(*) AS assignments, count(DISTINCT record_id) AS records, count(*) FILTER (WHERE min_rank < k) AS hits FROM banded, ks GROUP BY band, k
), band_scores AS (
  SELECT n.band, ks.k, coalesce(hits, 0) / (SELECT count(DISTINCT record_id) FROM gold)::DOUBLE / ks.k AS p,
    coalesce(hits::DOUBLE / assignments, 0) AS r, coalesce(records, 0) AS records, coalesce(assignments, 0) AS assignments
  FROM names n CROSS JOIN ks LEFT JOIN sums s ON s.band = n.band AND s.k = ks.k
)"""


def frozen(spark, sf_dir, first=1, last=9):
    return B.freeze_bands(roles.raw_assignments(spark, sf_dir).where(f"split between {first} and {last}"), SCALED)


@query(BANDS + f" SELECT band, k, {MICRO_OUT} FROM band_scores")
def eval_band(spark, sf_dir):
    found = E.by_band(gold(spark, sf_dir), roles.mixed_predictions(spark, sf_dir), frozen(spark, sf_dir), BAND_NAMES)
    return rounded(found, "precision", "recall", "f1")


@query(CELLS + """, a AS (SELECT k, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM cells GROUP BY k), m AS (
  SELECT k, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1
  FROM (SELECT k, sum(hits)::DOUBLE / (count(*) * k) AS p, sum(hits)::DOUBLE / sum(gold) AS r FROM hits GROUP BY k)
) SELECT k, round(a.precision - m.precision, 6) AS precision, round(a.recall - m.recall, 6) AS recall, round(a.f1 - m.f1, 6) AS f1 FROM a JOIN m USING (k)""")
def eval_divergence(spark, sf_dir):
    own = cell_hits(spark, sf_dir)
    return rounded(E.divergence(E.micro(own, []), E.macro(E.official(own, ["type", "lang"]))), "precision", "recall", "f1")


SHARES = CELLS + """, shares AS (
  SELECT type, lang, avg(share) AS share FROM (
    SELECT type, lang, CASE WHEN sum(recall) OVER (PARTITION BY k) = 0 THEN 1.0 / count(*) OVER (PARTITION BY k) ELSE recall / sum(recall) OVER (PARTITION BY k) END AS share FROM cells
  ) GROUP BY type, lang)"""


@query(SHARES + " SELECT type, lang, round(share, 6) AS share FROM shares")
def recall_shares(spark, sf_dir):
    return rounded(E.recall_shares(E.official(cell_hits(spark, sf_dir), ["type", "lang"]), ["type", "lang"]), "share")


@query(SHARES + """, before AS (
  SELECT *, coalesce(sum(share) OVER (ORDER BY round(share, 9) DESC, type, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM shares
) SELECT type, lang, round(share, 6) AS share FROM before WHERE b < 0.5""")
def dominant_cells(spark, sf_dir):
    cells = E.official(cell_hits(spark, sf_dir), ["type", "lang"])
    return rounded(E.dominant(E.recall_shares(cells, ["type", "lang"]), ["type", "lang"]), "share")


@query(CELLS + " SELECT round(avg(recall), 6) AS mean_recall, count(*) AS ks FROM (SELECT k, avg(recall) AS recall FROM cells GROUP BY k)")
def mean_recall(spark, sf_dir):
    found = E.macro(E.official(cell_hits(spark, sf_dir), ["type", "lang"]))
    return found.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.count("*").alias("ks"))


@query(HITS + """, a AS (SELECT k, avg(hits::DOUBLE / k) AS p, avg(hits::DOUBLE / gold) AS r FROM hits GROUP BY k), b AS (
  SELECT k, avg(round_even(hits::DOUBLE / k, 4)) AS p, avg(round_even(hits::DOUBLE / gold, 4)) AS r FROM hits GROUP BY k
) SELECT round(max(greatest(abs(a.p - b.p), abs(a.r - b.r))), 9) AS max_difference, count(*) AS compared FROM a JOIN b USING (k)""")
def scorer_agreement(spark, sf_dir):
    own = hits(spark, sf_dir)
    exact = own.groupBy("k").agg(F.avg(F.col("hits") / F.col("k")).alias("precision"), F.avg(F.col("hits") / F.col("gold")).alias("recall"))
    return rounded(E.agreement(exact, E.official(own, []), ["k"], ["precision", "recall"]), "max_difference", places=9)


DUPLICATED = """, twins AS (
  SELECT record_id FROM (SELECT record_id, string_agg(code::VARCHAR, ',' ORDER BY code) AS codes FROM gold GROUP BY record_id)
  WHERE codes IN (SELECT codes FROM (SELECT record_id, string_agg(code::VARCHAR, ',' ORDER BY code) AS codes FROM assignments WHERE split <> 0 GROUP BY record_id)))"""


@query(HITS + DUPLICATED + f""" SELECT kind, k, {MICRO_OUT} FROM (
  SELECT 'with' AS kind, k, {MICRO} FROM hits GROUP BY k
  UNION ALL SELECT 'without' AS kind, k, {MICRO} FROM hits WHERE record_id NOT IN (SELECT record_id FROM twins) GROUP BY k)""")
def with_without_duplicates(spark, sf_dir):
    return rounded(duplicate_scores(spark, sf_dir), "precision", "recall", "f1")


def duplicate_scores(spark, sf_dir):
    own = hits(spark, sf_dir)
    codes = roles.assignments(spark, sf_dir).groupBy("record_id", "split").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    twins = codes.where("split = 0").join(codes.where("split <> 0").select("codes").distinct(), "codes", "left_semi").select("record_id")
    both = E.micro(own, []).withColumn("kind", F.lit("with")).unionByName(
        E.micro(own.join(twins, "record_id", "left_anti"), []).withColumn("kind", F.lit("without"))
    )
    return both


@query("WITH " + roles.ROLES_SQL + """ SELECT type, lang, string_agg(record_id::VARCHAR, ',' ORDER BY record_id) AS ids
  FROM dev WHERE type NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR lang NOT IN ('BUILDING', 'MACHINERY') GROUP BY type, lang""")
def unreadable_cells(spark, sf_dir):
    readable = F.col("type").isin("1-URGENT", "2-HIGH", "3-MEDIUM") & F.col("lang").isin("BUILDING", "MACHINERY")
    dev = roles.records(spark, sf_dir).where("split = 0").where(~readable)
    return dev.groupBy("type", "lang").agg(F.array_join(F.sort_array(F.collect_list("record_id")).cast("array<string>"), ",").alias("ids"))


@query(HITS + f" SELECT CAST(size AS BIGINT) AS size, k, {MICRO_OUT} FROM (SELECT least(gold, 5) AS size, k, {MICRO} FROM hits GROUP BY least(gold, 5), k)")
def by_gold_size(spark, sf_dir):
    own = hits(spark, sf_dir).withColumn("size", F.least("gold", F.lit(5).cast("long")))
    return rounded(E.micro(own, ["size"]), "precision", "recall", "f1")


@query(HITS + " SELECT k, round(avg(least(n, k) / k::DOUBLE), 6) AS achievable FROM (SELECT record_id, count(*) AS n FROM gold GROUP BY record_id), ks GROUP BY k")
def achievable_precision(spark, sf_dir):
    return rounded(E.achievable_precision(gold(spark, sf_dir), E.KS), "achievable")


#: The published results that a run is compared with: system, precision and recall at 5 and at 10, mean recall. Fixed values.
PUBLISHED = (
    ("RUC Team", 0.25, 0.48, 0.16, 0.57, 0.66),
    ("Annif", 0.23, 0.48, 0.14, 0.54, 0.59),
    ("LA2I2F", 0.20, 0.41, 0.13, 0.49, 0.58),
    ("DUTIR831", 0.23, 0.49, 0.13, 0.54, 0.56),
)


@query(CELLS + """, ks_macro AS (SELECT k, avg(precision) AS p, avg(recall) AS r FROM cells GROUP BY k)
  SELECT 'this run' AS team, round(max(p) FILTER (WHERE k = 5), 6) AS p5, round(max(r) FILTER (WHERE k = 5), 6) AS r5, round(max(p) FILTER (WHERE k = 10), 6) AS p10, round(max(r) FILTER (WHERE k = 10), 6) AS r10, round(avg(r), 6) AS mean_recall FROM ks_macro
  UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"('{t}', {', '.join(f'{x}::DOUBLE' for x in xs)})" for t, *xs in PUBLISHED) + ") t")
def leaderboard(spark, sf_dir):
    published = spark.createDataFrame(list(PUBLISHED), "team string, p5 double, r5 double, p10 double, r10 double, mean_recall double")
    own = E.macro(E.official(cell_hits(spark, sf_dir), ["type", "lang"]))
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c[0]}{k}")
    row = own.agg(at("precision", 5), at("recall", 5), at("precision", 10), at("recall", 10), F.avg("recall").alias("mean_recall"))
    return rounded(row, "p5", "r5", "p10", "r10", "mean_recall").select(F.lit("this run").alias("team"), "*").unionByName(published)


# Bands

@query("WITH " + roles.ROLES_SQL + """ SELECT code, count(*) AS count, CASE WHEN count(*) >= 5 THEN 'head' WHEN count(*) >= 3 THEN 'torso' ELSE 'tail' END AS band
  FROM raw_assignments WHERE split BETWEEN 1 AND 9 GROUP BY code""")
def freeze_bands(spark, sf_dir):
    return frozen(spark, sf_dir)


@query("WITH " + roles.ROLES_SQL + """ SELECT band, count(*) AS codes, CAST(sum(n) AS BIGINT) AS assignments FROM (
  SELECT code, count(*) AS n, CASE WHEN count(*) >= 101 THEN 'head' WHEN count(*) >= 10 THEN 'torso' ELSE 'tail' END AS band FROM raw_assignments GROUP BY code) GROUP BY band""")
def band_sizes(spark, sf_dir):
    return B.freeze_bands(roles.raw_assignments(spark, sf_dir)).groupBy("band").agg(F.count("*").alias("codes"), F.sum("count").alias("assignments"))


@query("WITH " + roles.ROLES_SQL + " SELECT code, count(*) AS count FROM assignments GROUP BY code")
def corpus_counts(spark, sf_dir):
    return B.corpus_counts(roles.assignments(spark, sf_dir))


@query("WITH " + roles.ROLES_SQL + " SELECT code, count(*) AS count FROM raw_assignments GROUP BY code")
def label_distribution(spark, sf_dir):
    return B.assignment_counts(roles.raw_assignments(spark, sf_dir))


MIGRATION = "WITH " + roles.ROLES_SQL + """, small AS (SELECT code, count(*) AS n FROM raw_assignments WHERE split = 1 GROUP BY code),
grown AS (SELECT code, count(*) AS n FROM assignments WHERE split BETWEEN 1 AND 9 GROUP BY code),
labels AS (SELECT code, count(*) AS weight FROM assignments WHERE split = 0 GROUP BY code), moved AS (
  SELECT weight, CASE WHEN s.n >= 5 THEN 'head' WHEN s.n >= 3 THEN 'torso' WHEN s.n >= 1 THEN 'tail' ELSE 'zero' END AS before,
    CASE WHEN g.n >= 5 THEN 'head' WHEN g.n >= 3 THEN 'torso' WHEN g.n >= 1 THEN 'tail' ELSE 'zero' END AS after
  FROM labels LEFT JOIN small s USING (code) LEFT JOIN grown g USING (code))"""


def _migration(spark, sf_dir, weight=None, more=None):
    labels = B.corpus_counts(roles.assignments(spark, sf_dir).where("split = 0")).withColumnRenamed("count", "weight")
    labels = labels if more is None else labels.unionByName(more)
    grown = B.corpus_counts(roles.assignments(spark, sf_dir).where("split between 1 and 9"))
    return B.migration(labels, frozen(spark, sf_dir, 1, 1), grown, SCALED, weight)


@query(MIGRATION + " SELECT before, after, count(*) AS n FROM moved GROUP BY before, after")
def band_migration(spark, sf_dir):
    return _migration(spark, sf_dir)


@query(MIGRATION + " SELECT before, after, CAST(sum(weight) AS BIGINT) AS n FROM moved GROUP BY before, after")
def band_migration_weighted(spark, sf_dir):
    return _migration(spark, sf_dir, "weight")


@query(MIGRATION.replace("FROM assignments WHERE split = 0 GROUP BY code)", "FROM (SELECT code FROM assignments WHERE split = 0 UNION ALL SELECT s_suppkey + 1000000 FROM supplier) GROUP BY code)")
  + " SELECT before, after, CAST(sum(weight) AS BIGINT) AS n FROM moved WHERE before = 'zero' AND after = 'zero' GROUP BY before, after")
def band_unreachable(spark, sf_dir):
    """Suppliers' keys, moved out of the codes' range, stand for labels that no corpus holds."""
    return B.unreachable(_migration(spark, sf_dir, "weight", roles.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("code"), F.lit(1).cast("long").alias("weight"))))


BOUND = "WITH " + roles.ROLES_SQL + """, frozen AS (SELECT DISTINCT code FROM raw_assignments WHERE split = 1), grown AS (SELECT DISTINCT code FROM assignments WHERE split BETWEEN 1 AND 9),
labels AS (SELECT code, count(*) AS weight FROM assignments WHERE split = 0 GROUP BY code), zero AS (
  SELECT l.*, code NOT IN (SELECT code FROM frozen) AS z, code IN (SELECT code FROM grown) AS reached FROM labels l)"""


def _grown(spark, sf_dir):
    return B.corpus_counts(roles.assignments(spark, sf_dir).where("split between 1 and 9"))


@query(BOUND + """ SELECT count(*) FILTER (WHERE z) AS zero_labels, CAST(coalesce(sum(weight) FILTER (WHERE z), 0) AS BIGINT) AS zero_assignments,
  count(*) FILTER (WHERE z AND reached) AS reached_labels, CAST(coalesce(sum(weight) FILTER (WHERE z AND reached), 0) AS BIGINT) AS reached_assignments,
  count(*) FILTER (WHERE z AND NOT reached) AS lost_labels, CAST(coalesce(sum(weight) FILTER (WHERE z AND NOT reached), 0) AS BIGINT) AS lost_assignments,
  round(coalesce(sum(weight) FILTER (WHERE z AND NOT reached), 0)::DOUBLE / sum(weight), 6) AS lost_share FROM zero""")
def zero_shot_bound(spark, sf_dir):
    dev = roles.assignments(spark, sf_dir).where("split = 0")
    return rounded(B.zero_shot_bound(dev, frozen(spark, sf_dir, 1, 1), _grown(spark, sf_dir), SCALED), "lost_share")


@query("WITH" + HITS.removeprefix("WITH") + """, frozen AS (SELECT DISTINCT code FROM raw_assignments WHERE split = 1), grown AS (SELECT DISTINCT code FROM assignments WHERE split BETWEEN 1 AND 9),
own AS (SELECT b.*, CASE WHEN code IN (SELECT code FROM grown) THEN 'reached' ELSE 'lost' END AS half FROM best b WHERE code NOT IN (SELECT code FROM frozen))
SELECT half, CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE min_rank < k) AS hits, count(*) AS assignments, round(count(*) FILTER (WHERE min_rank < k)::DOUBLE / count(*), 6) AS recall
FROM own, (VALUES (5), (10), (50)) t(k) GROUP BY half, k""")
def recall_over_labels(spark, sf_dir):
    own = gold(spark, sf_dir)
    halves = B.zero_shot_halves(own, frozen(spark, sf_dir, 1, 1), _grown(spark, sf_dir))
    return rounded(B.recall_over(halves, own, roles.mixed_predictions(spark, sf_dir), (5, 10, 50)), "recall")


@query("WITH " + roles.ROLES_SQL + " SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT code FROM assignments WHERE split BETWEEN 1 AND 9)")
def output_layer(spark, sf_dir):
    return B.output_layer(roles.assignments(spark, sf_dir).where("split between 1 and 9"))


LAYER = "WITH " + roles.ROLES_SQL + ", layer AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS position FROM (SELECT DISTINCT code FROM assignments WHERE split = 1))"


@query(LAYER + """ SELECT record_id, coalesce(string_agg(position::VARCHAR, ',' ORDER BY position), '') AS columns
  FROM dev LEFT JOIN (SELECT record_id, position FROM assignments JOIN layer USING (code)) USING (record_id) GROUP BY record_id""")
def target_rows(spark, sf_dir):
    layer = B.output_layer(roles.assignments(spark, sf_dir).where("split = 1"))
    dev = roles.records(spark, sf_dir).where("split = 0")
    found = B.target_rows(roles.assignments(spark, sf_dir).where("split = 0"), layer, dev)
    return found.select("record_id", F.array_join(F.col("columns").cast("array<string>"), ",").alias("columns"))


@query(LAYER + " SELECT count(*) AS total, count(*) FILTER (WHERE code NOT IN (SELECT code FROM layer)) AS unreachable FROM assignments WHERE split = 0")
def unreachable_assignments(spark, sf_dir):
    layer = B.output_layer(roles.assignments(spark, sf_dir).where("split = 1"))
    return B.unreachable_assignments(roles.assignments(spark, sf_dir).where("split = 0"), layer)


@query("WITH " + roles.ROLES_SQL + """, used AS (SELECT DISTINCT code FROM assignments)
  SELECT count(*) AS used, count(*) FILTER (WHERE code IN (SELECT code FROM vocabulary WHERE "group" <> 'ECONOMY')) AS known,
  count(*) FILTER (WHERE code NOT IN (SELECT code FROM vocabulary WHERE "group" <> 'ECONOMY')) AS unknown FROM used""")
def vocabulary_coverage(spark, sf_dir):
    return B.coverage(roles.assignments(spark, sf_dir), roles.vocabulary(spark, sf_dir).where("group <> 'ECONOMY'"))


# Confidence, routing, calibration, coverage

CONF = HITS + """, conf AS (
  SELECT record_id, round(coalesce(avg(s), 0), 9) AS confidence FROM dev LEFT JOIN (
    SELECT record_id, rank, (('0x' || substr(md5(record_id || '/' || code), 1, 6))::BIGINT % 1000) / 1000.0::DOUBLE AS s FROM mixed WHERE rank < 5) USING (record_id)
  GROUP BY record_id), outcomes AS (
  SELECT a.record_id, a.hits AS hits_p, b.hits AS hits_r, a.gold FROM hits a JOIN hits b USING (record_id) WHERE a.k = 5 AND b.k = 10)"""


def scored_predictions(spark, sf_dir):
    """The mixed predictions with a pseudo-random score of three decimals."""
    h = F.md5(F.concat_ws("/", F.col("record_id").cast("string"), F.col("code").cast("string")).cast("binary"))
    score = (F.conv(F.substring(h, 1, 6), 16, 10).cast("long") % 1000) / F.lit(1000.0)
    return roles.mixed_predictions(spark, sf_dir).withColumn("score", score)


def confidences(spark, sf_dir):
    return R.confidence(roles.records(spark, sf_dir).where("split = 0"), scored_predictions(spark, sf_dir))


def outcomes(spark, sf_dir):
    own = hits(spark, sf_dir)
    return own.where("k = 5").select("record_id", F.col("hits").alias("hits_p"), "gold").join(own.where("k = 10").select("record_id", F.col("hits").alias("hits_r")), "record_id")


@query(CONF + " SELECT record_id, confidence FROM conf")
def confidence(spark, sf_dir):
    return confidences(spark, sf_dir)


ROUTED = CONF + ", placed AS (SELECT *, row_number() OVER (ORDER BY confidence, record_id) AS pos, count(*) OVER () AS n FROM conf), routed AS (SELECT * FROM placed WHERE pos <= floor(0.2 * n + 1e-9))"


@query(ROUTED + " SELECT record_id, confidence, CAST(pos - 1 AS BIGINT) AS position FROM routed")
def route_least_confident(spark, sf_dir):
    return R.route(confidences(spark, sf_dir), 0.2)


@query(ROUTED + """ SELECT (SELECT min(confidence) FROM conf) AS lowest, (SELECT max(confidence) FROM conf) AS highest,
  (SELECT confidence FROM placed WHERE pos = n // 2 + 1) AS median, count(*) AS routed, max(confidence) AS threshold FROM routed""")
def routing_summary(spark, sf_dir):
    own = confidences(spark, sf_dir)
    return R.routing_summary(own, R.route(own, 0.2))


@query(CONF + """, d AS (SELECT record_id, confidence, CAST(ntile(10) OVER (ORDER BY confidence DESC, record_id) - 1 AS INTEGER) AS decile FROM conf)
  SELECT decile, count(*) AS records, round(avg(confidence), 6) AS confidence, round(avg(hits_p / 5.0::DOUBLE), 6) AS precision, round(avg(hits_p::DOUBLE / gold), 6) AS recall,
  round(avg(CASE WHEN hits_p = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_hit FROM d JOIN outcomes USING (record_id) GROUP BY decile""")
def calibration_deciles(spark, sf_dir):
    own = outcomes(spark, sf_dir).select("record_id", (F.col("hits_p") / 5).alias("precision"), (F.col("hits_p") / F.col("gold")).alias("recall"), F.col("hits_p").alias("hits"))
    return rounded(R.deciles(confidences(spark, sf_dir), own), "confidence", "precision", "recall", "no_hit")


@query(CONF + """, wanted AS (SELECT c AS requested, least((SELECT count(*) FROM conf), greatest(1, ceil(c * (SELECT count(*) FROM conf)))) AS w FROM (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25), (0.1)) t(c)),
  placed AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, record_id) AS pos FROM conf), cuts AS (SELECT requested, confidence AS threshold FROM wanted JOIN placed ON pos = w)
  SELECT requested, threshold, count(*) AS records, round(sum(hits_p)::DOUBLE / (count(*) * 5), 6) AS precision, round(avg(least(gold, 5) / 5.0::DOUBLE), 6) AS achievable,
  round(coalesce(sum(hits_p)::DOUBLE / (count(*) * 5) / nullif(avg(least(gold, 5) / 5.0::DOUBLE), 0), 0), 6) AS share_of_achievable, round(sum(hits_r)::DOUBLE / sum(gold), 6) AS recall, CAST(sum(gold) AS BIGINT) AS assignments, round(avg(CASE WHEN hits_p = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_hit,
  round(sum(gold)::DOUBLE / (SELECT sum(gold) FROM outcomes), 6) AS share
  FROM cuts JOIN conf ON confidence >= threshold JOIN outcomes USING (record_id) GROUP BY requested, threshold""")
def coverage_curve(spark, sf_dir):
    found = C.coverage_curve(confidences(spark, sf_dir), outcomes(spark, sf_dir), (1.0, 0.75, 0.5, 0.25, 0.1))
    return rounded(found, "precision", "achievable", "share_of_achievable", "recall", "no_hit", "share")


@query(ROUTED + BANDS.removeprefix(HITS) + f""", routed_sums AS (
  SELECT band, k, count(*) AS assignments, count(DISTINCT record_id) AS records, count(*) FILTER (WHERE min_rank < k) AS hits FROM banded, ks WHERE record_id IN (SELECT record_id FROM routed) GROUP BY band, k
), scores2 AS (
  SELECT n.band, ks.k, coalesce(hits, 0) / (SELECT count(DISTINCT record_id) FROM gold WHERE record_id IN (SELECT record_id FROM routed))::DOUBLE / ks.k AS p,
    coalesce(hits::DOUBLE / assignments, 0) AS r, coalesce(records, 0) AS records, coalesce(assignments, 0) AS assignments
  FROM names n CROSS JOIN ks LEFT JOIN routed_sums s ON s.band = n.band AND s.k = ks.k
) SELECT band, k, {MICRO_OUT} FROM scores2""")
def routed_bands(spark, sf_dir):
    routed = R.route(confidences(spark, sf_dir), 0.2)
    own = gold(spark, sf_dir).join(routed, "record_id", "left_semi")
    return rounded(E.by_band(own, roles.mixed_predictions(spark, sf_dir), frozen(spark, sf_dir), BAND_NAMES), "precision", "recall", "f1")


# Before and after: the mixed predictions, and the same lists turned round

TURNED = HITS + """, turned AS (SELECT record_id, code, CAST(49 - rank AS INTEGER) AS rank FROM mixed), best2 AS (
  SELECT g.record_id, g.code, min(p.rank) AS min_rank FROM gold g LEFT JOIN turned p USING (record_id, code) GROUP BY g.record_id, g.code
), hits2 AS (SELECT record_id, k, count(*) FILTER (WHERE min_rank < k) AS hits, count(*) AS gold FROM best2, ks GROUP BY record_id, k)"""
SIDES = """a AS (SELECT {by}, sum(hits)::DOUBLE / (count(*) * k) AS p, sum(hits)::DOUBLE / sum(gold) AS r FROM {one} GROUP BY {by}),
b AS (SELECT {by}, sum(hits)::DOUBLE / (count(*) * k) AS p, sum(hits)::DOUBLE / sum(gold) AS r FROM {two} GROUP BY {by})
SELECT {by}, round(a.p, 6) AS precision_before, round(b.p, 6) AS precision_after, round(b.p - a.p, 6) AS precision_change, round(a.r, 6) AS recall_before, round(b.r, 6) AS recall_after, round(b.r - a.r, 6) AS recall_change FROM a JOIN b USING ({by})"""
CHANGES = [f"{m}_{s}" for m in ("precision", "recall") for s in ("before", "after", "change")]


def turned(spark, sf_dir):
    return roles.mixed_predictions(spark, sf_dir).withColumn("rank", F.lit(49) - F.col("rank"))


@query(TURNED + ", " + SIDES.format(by="k", one="hits", two="hits2"))
def headline_before_after(spark, sf_dir):
    after = E.micro(E.record_hits(gold(spark, sf_dir), turned(spark, sf_dir)), [])
    return rounded(E.before_after(E.micro(hits(spark, sf_dir), []), after, ["k"]), *CHANGES)


@query(TURNED + ", lh AS (SELECT h.*, lang FROM hits h JOIN dev USING (record_id)), lh2 AS (SELECT h.*, lang FROM hits2 h JOIN dev USING (record_id)), " + SIDES.format(by="lang, k", one="lh", two="lh2"))
def language_before_after(spark, sf_dir):
    langs = roles.records(spark, sf_dir).select("record_id", "lang")
    before = E.micro(hits(spark, sf_dir).join(langs, "record_id"), ["lang"])
    after = E.micro(E.record_hits(gold(spark, sf_dir), turned(spark, sf_dir)).join(langs, "record_id"), ["lang"])
    return rounded(E.before_after(before, after, ["lang", "k"]), *CHANGES)


@query(BANDS.replace(HITS, TURNED) + """, sums2 AS (SELECT coalesce(f.band, 'zero') AS band, k, count(*) AS assignments, count(*) FILTER (WHERE min_rank < k) AS hits FROM best2 b LEFT JOIN frozen f USING (code), ks GROUP BY 1, k),
n AS (SELECT count(DISTINCT record_id)::DOUBLE AS n FROM gold), b2 AS (SELECT x.band, ks.k, coalesce(s.hits, 0) / n.n / ks.k AS p, coalesce(s.hits::DOUBLE / s.assignments, 0) AS r FROM names x CROSS JOIN ks CROSS JOIN n LEFT JOIN sums2 s ON s.band = x.band AND s.k = ks.k)
SELECT band, k, round(a.p, 6) AS precision_before, round(b.p, 6) AS precision_after, round(b.p - a.p, 6) AS precision_change, round(a.r, 6) AS recall_before, round(b.r, 6) AS recall_after, round(b.r - a.r, 6) AS recall_change
FROM band_scores a JOIN b2 b USING (band, k)""")
def band_before_after(spark, sf_dir):
    own, frz = gold(spark, sf_dir), frozen(spark, sf_dir)
    before = E.by_band(own, roles.mixed_predictions(spark, sf_dir), frz, BAND_NAMES)
    return rounded(E.before_after(before, E.by_band(own, turned(spark, sf_dir), frz, BAND_NAMES), ["band", "k"]), *CHANGES)
