"""Corpus queries: merging, clearing, sampling, label text, statistics of rankings, checks and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import checks as K
from rankloom.operators import corpus as C
from rankloom.operators import curves as V
from rankloom.operators import labels
from rankloom.plans.catalogue import query, rounded
from rankloom.sources import roles
from rankloom.sources.roles import MIXED_SQL, ROLES_SQL

# Assembling a corpus: a record is what lines of one order say, in the order in which the file holds them; copies carry
# different codes. Copies of one order may carry different flags, which is a conflict; what its order says is the same.

MERGE = """WITH raw AS (SELECT l_orderkey AS id, row_number() OVER () AS seq, l_returnflag AS kind, [l_partkey, l_suppkey] AS subjects FROM lineitem),
flat AS (SELECT id, seq, i, subjects[i] AS code FROM raw, (VALUES (1), (2)) t(i)), firsts AS (SELECT id, code, min(seq * 2 + i) AS pos FROM flat GROUP BY id, code),
heads AS (SELECT id, min(seq) * 2 + 2 AS own FROM raw GROUP BY id),
united AS (SELECT id, string_agg(code::VARCHAR, ',' ORDER BY pos) AS subjects, count(*) FILTER (WHERE pos > own) AS recovered FROM firsts JOIN heads USING (id) GROUP BY id),
merged AS (SELECT id, min_by(kind, seq) AS kind, count(*) AS copies, count(DISTINCT kind) > 1 AS conflict FROM raw GROUP BY id)"""


def order_lines(spark, sf_dir):
    """id, kind (a flag of the line), subjects, arrived."""
    return C.arrival(roles.table(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("kind"), F.array("l_partkey", "l_suppkey").alias("subjects"), "arrived"
    )


def merged_orders(spark, sf_dir):
    return C.merge(order_lines(spark, sf_dir), "id", "arrived", ["kind"], "subjects")


@query(MERGE + " SELECT id, kind, copies, conflict, recovered, subjects FROM merged JOIN united USING (id)")
def merge_duplicates(spark, sf_dir):
    return merged_orders(spark, sf_dir).withColumn("subjects", F.array_join(F.col("subjects").cast("array<string>"), ","))


@query(MERGE + """ SELECT CAST(sum(copies) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (WHERE copies > 1) AS duplicate_keys, CAST(sum(recovered) AS BIGINT) AS merged_subjects
  FROM merged JOIN united USING (id)""")
def merge_stats(spark, sf_dir):
    return C.merge_stats(merged_orders(spark, sf_dir))


@query(MERGE + " SELECT id, copies FROM merged WHERE conflict")
def merge_conflicts(spark, sf_dir):
    return merged_orders(spark, sf_dir).where("conflict").select("id", "copies")


OVERLAP = """WITH idx AS (SELECT DISTINCT c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 10 BETWEEN 1 AND 8),
held AS (SELECT DISTINCT CAST(o_orderkey % 10 AS INTEGER) AS split, o_custkey AS id FROM orders WHERE o_orderkey % 10 IN (0, 9)
  UNION SELECT 7, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"""


def _index(spark, sf_dir):
    return roles.table(spark, sf_dir, "orders").where("o_orderkey % 10 between 1 and 8").select(F.col("o_custkey").alias("id")).distinct()


def _held(spark, sf_dir):
    orders, customer = roles.table(spark, sf_dir, "orders"), roles.table(spark, sf_dir, "customer")
    own = orders.where("o_orderkey % 10 in (0, 9)").select((F.col("o_orderkey") % 10).cast("int").alias("split"), F.col("o_custkey").alias("id"))
    idle = customer.select(F.lit(7).alias("split"), F.col("c_custkey").alias("id")).join(orders.select(F.col("o_custkey").alias("id")), "id", "left_anti")
    return own.unionByName(idle).distinct()


@query(OVERLAP + " SELECT split, count(i.id) AS n FROM held h LEFT JOIN idx i USING (id) GROUP BY split")
def overlap_counts(spark, sf_dir):
    return C.overlap(_index(spark, sf_dir), _held(spark, sf_dir), "id")


@query(OVERLAP + " SELECT split, id FROM held JOIN idx USING (id)")
def excluded_ids(spark, sf_dir):
    return C.excluded(_index(spark, sf_dir), _held(spark, sf_dir), "id")


@query(OVERLAP + " SELECT id FROM idx WHERE id NOT IN (SELECT id FROM held)")
def clear_index(spark, sf_dir):
    index = _index(spark, sf_dir)
    return C.clear(index, C.excluded(index, _held(spark, sf_dir), "id"), "id")


@query("SELECT CAST(0 AS INTEGER) AS ordinal, count(*) AS n FROM customer UNION ALL SELECT 1, count(*) FROM supplier")
def concatenated(spark, sf_dir):
    a = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    b = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return C.concatenate(a, b).groupBy("ordinal").agg(F.count("*").alias("n"))


SIZE = 150
QUOTAS = f"""WITH cells AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), shares AS (
  SELECT *, n * {SIZE} / (sum(n) OVER ())::DOUBLE AS share FROM cells), based AS (SELECT *, floor(round(share, 9)) AS base, round(share - floor(round(share, 9)), 9) AS rest FROM shares),
placed AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source, lang) AS place, {SIZE} - sum(base) OVER () AS spare FROM based),
first_quotas AS (SELECT source, lang, n, CAST(base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota, count(*) OVER () AS cells FROM placed),
hungry AS (SELECT source, lang, row_number() OVER (ORDER BY source NULLS FIRST, lang NULLS FIRST) AS turn FROM first_quotas WHERE quota = 0 AND n > 0 AND {SIZE} >= cells),
units AS (SELECT source, lang, row_number() OVER (ORDER BY unit DESC, source DESC NULLS LAST, lang DESC NULLS LAST) AS pos FROM (SELECT source, lang, unnest(range(2, quota + 1)) AS unit FROM first_quotas WHERE quota > 1)),
donated AS (SELECT source, lang, count(*) AS given FROM units WHERE pos <= (SELECT count(*) FROM hungry) GROUP BY source, lang),
quotas AS (SELECT f.source, f.lang, n, quota - coalesce(given, 0) + CASE WHEN turn <= (SELECT coalesce(sum(given), 0) FROM donated) THEN 1 ELSE 0 END AS quota
  FROM first_quotas f LEFT JOIN donated d ON f.source IS NOT DISTINCT FROM d.source AND f.lang IS NOT DISTINCT FROM d.lang LEFT JOIN hungry h ON f.source IS NOT DISTINCT FROM h.source AND f.lang IS NOT DISTINCT FROM h.lang), drawn AS (
  SELECT d.*, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS pos FROM documents d
), sample AS (SELECT d.doc_id, source, lang FROM drawn d JOIN quotas USING (source, lang) WHERE pos <= quota)"""


def _cells(spark, sf_dir):
    return roles.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


def _sample(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return C.stratified_sample(docs, C.quotas(_cells(spark, sf_dir), ["source", "lang"], SIZE), ["source", "lang"], "doc_id", 42)


@query(QUOTAS + " SELECT source, lang, n, quota FROM quotas")
def quotas(spark, sf_dir):
    return C.quotas(_cells(spark, sf_dir), ["source", "lang"], SIZE)


@query(QUOTAS + " SELECT doc_id, source, lang FROM sample")
def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("doc_id", "source", "lang")


@query(QUOTAS + """, s AS (SELECT source, lang, count(*) AS m FROM sample GROUP BY source, lang)
SELECT source, lang, n AS corpus, coalesce(m, 0) AS sample, round(n / (sum(n) OVER ())::DOUBLE, 6) AS corpus_share, round(coalesce(m, 0) / (sum(m) OVER ())::DOUBLE, 6) AS sample_share FROM cells LEFT JOIN s USING (source, lang)""")
def cell_shares(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents")
    return rounded(C.cell_shares(docs, _sample(spark, sf_dir), ["source", "lang"]), "corpus_share", "sample_share")


@query("SELECT DISTINCT a.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang AND a.doc_id <> b.doc_id")
def exact_duplicates(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents")
    return C.duplicated_from(docs, docs, "doc_id", ["text", "lang"]).distinct()


@query("SELECT p_name AS name, count(DISTINCT p_partkey) AS codes, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def homographs(spark, sf_dir):
    return C.homographs(roles.vocabulary(spark, sf_dir))


@query("WITH " + ROLES_SQL + """, sizes AS (SELECT type, lang, record_id, count(*) AS size FROM assignments JOIN records USING (record_id) GROUP BY type, lang, record_id)
SELECT type, lang, record_id, size, CAST(row_number() OVER (PARTITION BY type, lang ORDER BY size DESC, record_id) - 1 AS INTEGER) AS rank FROM sizes QUALIFY row_number() OVER (PARTITION BY type, lang ORDER BY size DESC, record_id) <= 4""")
def top_per_cell(spark, sf_dir):
    own = roles.assignments(spark, sf_dir).drop("split").join(roles.records(spark, sf_dir), "record_id")
    return C.top_per_cell(own.groupBy("type", "lang", "record_id").agg(F.count("*").alias("size")), ["type", "lang"], 4)


@query("WITH " + ROLES_SQL + " SELECT type, lang, count(*) AS n FROM records GROUP BY type, lang")
def cell_counts(spark, sf_dir):
    return roles.records(spark, sf_dir).groupBy("type", "lang").agg(F.count("*").alias("n"))


# Label text

TERMS = "WITH terms AS (SELECT p_partkey AS code, p_type || CASE WHEN p_partkey % 3 = 0 THEN ',' WHEN p_partkey % 3 = 1 THEN ', ' ELSE ' ' END || p_brand AS term, p_name AS name, p_brand AS brand, p_type AS kind FROM part)"
SPLIT = TERMS + r""", split AS (SELECT *, CASE WHEN regexp_matches(term, '(?s)^.*?,\S') THEN regexp_extract(term, '(?s)^(.*?),(\S.*)$', 1) ELSE term END AS base,
  CASE WHEN regexp_matches(term, '(?s)^.*?,\S') THEN regexp_extract(term, '(?s)^(.*?),(\S.*)$', 2) END AS qualifier FROM terms)"""
#: A small dictionary for the translation queries: fixed values.
ENGLISH = {"ECONOMY": "thrift", "STANDARD": "norm", "PROMO": "offer", "Brand#11": "mark eleven", "LARGE": ""}
ENGLISH_SQL = ", dictionary AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ENGLISH.items()) + ") t(german, english))"


def terms(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part")
    sep = F.when(F.col("p_partkey") % 3 == 0, ",").when(F.col("p_partkey") % 3 == 1, ", ").otherwise(" ")
    return part.select(F.col("p_partkey").alias("code"), F.concat("p_type", sep, "p_brand").alias("term"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


@query(SPLIT + " SELECT code, base, qualifier FROM split")
def split_qualifier(spark, sf_dir):
    return terms(spark, sf_dir).select("code", T.base_term(F.col("term")).alias("base"), T.qualifier_of(F.col("term")).alias("qualifier"))


@query(SPLIT + """ SELECT code, CASE WHEN qualifier IS NULL THEN base ELSE base || ' (' || qualifier || ')' END AS parenthetical, CASE WHEN qualifier IS NULL THEN base ELSE base || ',' || qualifier END AS raw, base AS stripped,
  CASE WHEN term LIKE '% ' || brand THEN substr(term, 1, length(term) - length(brand) - 1) || ' (' || brand || ')' WHEN qualifier IS NULL THEN base ELSE base || ' (' || qualifier || ')' END AS given FROM split""")
def render_terms(spark, sf_dir):
    term = F.col("term")
    return terms(spark, sf_dir).select(
        "code", *(T.render_term(term, m).alias(m) for m in T.MODES), T.render_term(term, "parenthetical", F.col("brand")).alias("given")
    )


def translated(df, term, mode):
    words = df.sparkSession.createDataFrame(list(ENGLISH.items()), "german string, english string")
    return labels.translate(df, term, mode, words)


TRANSLATED = SPLIT + ENGLISH_SQL + """, words AS (SELECT s.*, b.english AS eb, coalesce(nullif(q.english, ''), qualifier) AS eq FROM split s LEFT JOIN dictionary b ON b.german = base LEFT JOIN dictionary q ON q.german = qualifier),
named AS (SELECT *, CASE WHEN coalesce(eb, '') = '' THEN NULL WHEN eq IS NULL THEN eb ELSE eb || ' (' || eq || ')' END AS english, CASE WHEN qualifier IS NULL THEN base ELSE base || ' (' || qualifier || ')' END AS rendered FROM words)"""


@query(TRANSLATED + " SELECT code, english, CASE WHEN english IS NULL OR english = rendered THEN rendered ELSE rendered || ' / ' || english END AS both_names FROM named")
def translate_terms(spark, sf_dir):
    own = translated(terms(spark, sf_dir), F.col("term"), "parenthetical")
    return own.select("code", "english", T.bilingual(T.render_term(F.col("term"), "parenthetical"), F.col("english")).alias("both_names"))


@query(TRANSLATED + """ SELECT code, 'Fachgebiet: ' || kind || chr(10) || 'Schlagwort: ' || rendered || CASE WHEN code % 2 = 0 THEN chr(10) || 'Synonyme: ' || name || '; ' || brand ELSE '' END AS label FROM named""")
def label_text(spark, sf_dir):
    synonyms = F.when(F.col("code") % 2 == 0, F.array("name", "brand")).otherwise(F.array().cast("array<string>"))
    return terms(spark, sf_dir).select("code", T.label_text(F.col("kind"), T.render_term(F.col("term"), "parenthetical"), synonyms).alias("label"))


@query(TRANSLATED + """, rows AS (SELECT code, 1 AS i, rendered AS v FROM named UNION ALL SELECT code, 2, english FROM named UNION ALL SELECT code, 3, name FROM named UNION ALL SELECT code, 4, brand FROM named UNION ALL SELECT code, 5, name FROM named),
firsts AS (SELECT code, v, min(i) AS i FROM rows WHERE v IS NOT NULL AND v <> '' GROUP BY code, v) SELECT code, string_agg(v, '|' ORDER BY i) AS variants FROM firsts GROUP BY code""")
def label_variants(spark, sf_dir):
    own = translated(terms(spark, sf_dir), F.col("term"), "parenthetical")
    found = T.variants(T.render_term(F.col("term"), "parenthetical"), F.col("english"), F.array("name", "brand", "name"))
    return own.select("code", F.array_join(found, "|").alias("variants"))


@query(SPLIT + " SELECT kind AS string FROM split UNION SELECT base FROM split UNION SELECT qualifier FROM split WHERE qualifier IS NOT NULL")
def translatable(spark, sf_dir):
    return labels.required(terms(spark, sf_dir), F.col("term"), "kind")


@query(SPLIT + ENGLISH_SQL + """, need AS (SELECT kind AS s FROM split UNION SELECT base FROM split UNION SELECT qualifier FROM split WHERE qualifier IS NOT NULL)
SELECT count(*) AS required, count(*) FILTER (WHERE s IN (SELECT german FROM dictionary)) AS cached, count(*) FILTER (WHERE s NOT IN (SELECT german FROM dictionary)) AS missing,
  (SELECT count(*) FROM dictionary WHERE german NOT IN (SELECT s FROM need)) AS stale FROM need""")
def translation_coverage(spark, sf_dir):
    return labels.cache_coverage(translatable(spark, sf_dir), spark.createDataFrame([(k,) for k in ENGLISH], "string string"))


@query(SPLIT + " SELECT count(*) AS entries, count(qualifier) AS terms, count(*) FILTER (WHERE regexp_matches(name, ',\\S')) AS names, count(*) FILTER (WHERE qualifier IS NOT NULL OR regexp_matches(name, ',\\S')) AS any_field FROM split")
def count_qualifiers(spark, sf_dir):
    return labels.count_qualified(terms(spark, sf_dir), {"terms": F.col("term"), "names": F.col("name")})


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS n_distinct FROM documents")
def tokens(spark, sf_dir):
    own = roles.table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return own.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN rtrim(substr(text, 1, 200), ' ') || ' […]' ELSE text END) AS clipped FROM documents")
def clip_text(spark, sf_dir):
    return roles.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clipped(F.col("text"), 200).cast("binary")).alias("clipped"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), ' · ')) AS line FROM documents")
def one_line(spark, sf_dir):
    return roles.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.one_line(F.col("text")).cast("binary")).alias("line"))


@query("SELECT page_id, regexp_extract(regexp_replace(trim(url, ' '), '/+$', ''), '[^/]*$', 0) AS last, regexp_replace(regexp_extract(url, '[^/]*$', 0), '\\.[^.]*$', '') AS stem FROM pages")
def url_parts(spark, sf_dir):
    return roles.table(spark, sf_dir, "pages").select("page_id", T.language_code(F.col("url")).alias("last"), T.stem_name(F.col("url")).alias("stem"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS subjects FROM documents")
def subject_lists(spark, sf_dir):
    return roles.table(spark, sf_dir, "documents").select("doc_id", F.size(T.subject_list(F.col("text"))).cast("long").alias("subjects"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark, sf_dir):
    return roles.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


# Statistics of rankings: systems are nations, scores their suppliers' and customers' balances

SYSTEMS = """WITH systems AS (SELECT n.n_name AS name, n.n_regionkey AS region, round(avg(c_acctbal), 0) AS x, round(avg(c_acctbal) FILTER (WHERE c_custkey % 2 = 0), -2) AS y
  FROM nation n JOIN customer ON c_nationkey = n_nationkey GROUP BY n.n_name, n.n_regionkey HAVING count(*) FILTER (WHERE c_custkey % 2 = 0 AND c_acctbal IS NOT NULL) > 0)"""


def systems(spark, sf_dir):
    nation, customer = roles.table(spark, sf_dir, "nation"), roles.table(spark, sf_dir, "customer")
    own = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return own.groupBy(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).agg(
        F.round(F.avg("c_acctbal"), 0).alias("x"), F.round(F.avg(F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal"))), -2).alias("y")
    ).where("y is not null")


@query(SYSTEMS + " SELECT name, y, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS r FROM systems")
def average_ranks(spark, sf_dir):
    return V.average_ranks(systems(spark, sf_dir), "y", "r").select("name", "y", F.col("r").cast("double").alias("r"))


@query(SYSTEMS + ", ranked AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM systems) SELECT round(corr(rx, ry), 6) AS rho FROM ranked")
def spearman(spark, sf_dir):
    return rounded(V.spearman(systems(spark, sf_dir), "x", "y"), "rho")


@query(SYSTEMS + """, pairs AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM systems a JOIN systems b ON a.name < b.name)
SELECT round(sum(sx * sy) / sqrt(((count(*) - count(*) FILTER (WHERE sx = 0)) * (count(*) - count(*) FILTER (WHERE sy = 0)))::DOUBLE), 6) AS tau FROM pairs""")
def kendall_tau_b(spark, sf_dir):
    return rounded(V.kendall(systems(spark, sf_dir), "name", "x", "y"), "tau")


SCREENS = """WITH screens AS (SELECT l_returnflag AS screen, CAST(l_suppkey % 12 AS VARCHAR) AS encoder, CAST(sum(l_quantity) AS DOUBLE) AS recall FROM lineitem GROUP BY l_returnflag, l_suppkey % 12),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY screen ORDER BY recall DESC, encoder) - 1 AS INTEGER) AS position FROM screens)"""


def screens(spark, sf_dir):
    own = roles.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("screen"), (F.col("l_suppkey") % 12).cast("string").alias("encoder"))
    return own.agg(F.sum("l_quantity").cast("double").alias("recall"))


@query(SCREENS + " SELECT screen, encoder, recall, position FROM ranked")
def screen_ranking(spark, sf_dir):
    return V.screen_ranking(screens(spark, sf_dir), ["screen"], "recall", "encoder")


@query(SCREENS + " SELECT a.encoder, a.position AS before, b.position AS after, a.position - b.position AS moved FROM ranked a JOIN ranked b USING (encoder) WHERE a.screen = 'A' AND b.screen = 'R'")
def rank_moves(spark, sf_dir):
    return V.rank_moves(screens(spark, sf_dir), "screen", "recall", "encoder", "A", "R")


@query(SCREENS + " SELECT encoder, position FROM ranked WHERE screen = 'R' AND position < 4")
def shortlist(spark, sf_dir):
    return V.screen_ranking(screens(spark, sf_dir).where("screen = 'R'"), ["screen"], "recall", "encoder").where("position < 4").select("encoder", "position")


@query(SCREENS + " SELECT encoder, min(recall) AS low, max(recall) AS high, max(recall) - min(recall) AS drift FROM screens WHERE encoder IN ('0', '1', '2') GROUP BY encoder HAVING min(recall) <> max(recall)")
def control_drift(spark, sf_dir):
    return V.control_drift(screens(spark, sf_dir).where("encoder in ('0', '1', '2')"), "encoder", "recall")


@query(SCREENS + " SELECT a.encoder, n.recall - a.recall AS index_adds, r.recall - n.recall AS training_adds FROM screens a JOIN screens n USING (encoder) JOIN screens r USING (encoder) WHERE a.screen = 'A' AND n.screen = 'N' AND r.screen = 'R'")
def attribution(spark, sf_dir):
    own = screens(spark, sf_dir)
    return V.attribution(own.where("screen = 'A'"), own.where("screen = 'N'"), own.where("screen = 'R'"), "encoder", "recall")


# Checks

@query("WITH " + MIXED_SQL + " SELECT record_id, count(*) AS codes, count(DISTINCT code) AS distinct_codes FROM mixed WHERE record_id % 30 <> 0 OR rank < 20 GROUP BY record_id HAVING count(*) <> 50 OR count(DISTINCT code) <> 50")
def check_short_rankings(spark, sf_dir):
    return K.bad_rankings(roles.mixed_predictions(spark, sf_dir).where("record_id % 30 <> 0 or rank < 20"), 50)


@query("WITH " + ROLES_SQL + " SELECT record_id, code, count(*) AS times FROM raw_assignments GROUP BY record_id, code HAVING count(*) > 1")
def check_duplicate_codes(spark, sf_dir):
    return K.repeated_codes(roles.raw_assignments(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE coalesce(trim(source, ' '), '') = '' OR coalesce(trim(CASE WHEN doc_id % 50 = 0 THEN ' ' ELSE lang END, ' '), '') = ''")
def check_blank_cells(spark, sf_dir):
    docs = roles.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("type"), F.when(F.col("doc_id") % 50 == 0, " ").otherwise(F.col("lang")).alias("lang"))
    return K.blank_cells(docs).withColumnRenamed("record_id", "doc_id")


@query("SELECT conv_id, count(*) AS times FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def check_repeated_ids(spark, sf_dir):
    return K.repeated_ids(roles.table(spark, sf_dir, "conversations"), "conv_id")


@query("""WITH c AS (SELECT DISTINCT c_custkey AS id FROM customer), o AS (SELECT DISTINCT o_custkey + 7 AS id FROM orders)
SELECT id, 'left' AS side FROM c WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'right' FROM o WHERE id NOT IN (SELECT id FROM c)""")
def check_unpaired(spark, sf_dir):
    a = roles.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return K.unpaired(a, roles.table(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("id")), ["id"])  # shifted, so that both sides have keys alone


@query("""SELECT o_orderkey AS name FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-30' OR CAST(o_orderdate AS DATE) + 30 > DATE '1997-06-30'""")
def check_cutoff(spark, sf_dir):
    models = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").cast("date").alias("created"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("revision_date"))
    return K.after_cutoff(models, "1997-06-30").select("name")


@query("""WITH m AS (SELECT o_orderkey AS name, CAST(o_orderdate AS DATE) AS created, CAST(o_orderdate AS DATE) + 30 AS revised, o_orderkey % 7 = 0 AS appendix, md5(o_orderkey::VARCHAR) AS revision, o_orderpriority AS provider FROM orders)
SELECT name, CASE WHEN revised > DATE '1997-06-30' AND NOT appendix THEN 'FAIL' WHEN appendix THEN 'APDX' ELSE 'ok' END AS flag, created::VARCHAR AS created,
  CASE WHEN name % 5 = 0 THEN revision || ' (declared, ' || provider || ')' ELSE substr(revision, 1, 12) || ' (' || CAST(revised AS DATE)::VARCHAR || ')' END AS pinned FROM m""")
def registry_report(spark, sf_dir):
    created, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    models = roles.table(spark, sf_dir, "orders").select(
        key.alias("name"), created.alias("created"), F.date_add(created, 30).alias("revision_date"), (key % 7 == 0).alias("appendix"),
        F.when(key % 5 == 0, "api").otherwise("hub").alias("origin"), F.md5(key.cast("string").cast("binary")).alias("revision"), F.col("o_orderpriority").alias("provider"),
    )
    return K.registry_report(models, "1997-06-30")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS stamp, event_id FROM events), lim AS (SELECT min(stamp) + (max(stamp) - min(stamp)) // 2 AS cut FROM e)
SELECT user_id, max(stamp) AS stamp, max_by(event_id, (stamp, event_id)) AS event_id FROM e, lim WHERE stamp <= cut GROUP BY user_id""")
def as_of_pick(spark, sf_dir):
    own = roles.table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("stamp"), "event_id")
    low, high = own.agg(F.min("stamp"), F.max("stamp")).first()
    return K.as_of(own, ["user_id"], "stamp", "event_id", F.lit(low + (high - low) // 2))


@query("""WITH old AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, f AS field, CASE f WHEN 'nation' THEN s_nationkey::VARCHAR ELSE s_name END AS value FROM supplier, (VALUES ('nation'), ('title')) t(f) WHERE s_suppkey % 11 <> 0),
new AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, f AS field, CASE f WHEN 'nation' THEN (CASE WHEN s_suppkey % 5 = 0 THEN 99 ELSE s_nationkey END)::VARCHAR ELSE s_name END AS value FROM supplier, (VALUES ('nation'), ('title')) t(f) WHERE s_suppkey % 13 <> 0)
SELECT coalesce(o.name, n.name) AS name, coalesce(o.field, n.field) AS field, o.value AS old, n.value AS new FROM old o FULL JOIN new n ON o.name = n.name AND o.field = n.field WHERE o.value IS DISTINCT FROM n.value""")
def document_diff(spark, sf_dir):
    own = roles.table(spark, sf_dir, "supplier")
    name = F.col("s_suppkey").cast("string").alias("name")
    nation = F.when(F.col("s_suppkey") % 5 == 0, 99).otherwise(F.col("s_nationkey"))
    fields = lambda n: F.explode(F.create_map(F.lit("nation"), n.cast("string"), F.lit("title"), F.col("s_name"))).alias("field", "value")
    return K.document_diff(own.where("s_suppkey % 11 <> 0").select(name, fields(F.col("s_nationkey"))), own.where("s_suppkey % 13 <> 0").select(name, fields(nation)))


@query("SELECT conv_id AS record_id, max_by(text, turn) AS response, count(*) AS lines FROM conversations GROUP BY conv_id")
def latest_response(spark, sf_dir):
    from rankloom.sources.files import latest_lines

    log = roles.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("record_id"), F.col("text").alias("response"), "turn")
    return latest_lines(log, "record_id", "response", "turn")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    from rankloom.streaming.windows import hourly

    own = roles.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return hourly(own).select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
