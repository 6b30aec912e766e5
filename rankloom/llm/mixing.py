"""Mixing sources to target weights. DataFrame functions only.

Every document gets a hash-random key (MD5 of its id and of its text's MD5); rows equal in source, id and text are one group of
`rows` rows from the start. Within a source the keys are range-sorted: a range is the first three hex digits of the key, so
a source of any size is spread over 4096 ranges, as are rows that share an id. Word counts are summed per range, the
range sums become offsets by a running sum over at most 4096 rows a source, and a running sum within the range completes
each group's prefix sum. A source's budget buys whole epochs of all its documents, and the rest cuts the prefix sums
at exactly the budget: the one document on the cut takes part of its words.

Targets: source weights 1, 2, 3 repeating by code point (null last) share all words; none gets more than `cap` times
what its source has, and the excess is shared by weight among the others. That is one level L with
target = min(cap * size, weight * L), found in closed form over the sources sorted by cap * size / weight.

Cases: null text has size 0; null source is a source of its own; a source with no words takes nothing; null ids and ids
that repeat with other texts have keys of their own; rows that repeat an id and a text are rows of their own, one after the
other; a very long text is only counted, where it is read; an empty table gives an empty result; other columns, whatever their names, are carried along or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import column, columns, materialise, skewed_lookup, table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sums: DataFrame, cap: float = 3.0) -> DataFrame:
    """From (src, source, source_size), a row per source, to the same with target. Few rows: one per source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sums.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    capped = weighted.withColumn("full", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("full") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = capped.withColumn("pos", F.row_number().over(order)).withColumn("lev", level)
    first = F.min(F.when(F.col("lev") <= F.col("ratio"), F.col("pos"))).over(whole)
    ranked = ranked.withColumn("first", first)
    lam = F.max(F.when(F.col("pos") == F.col("first"), F.col("lev"))).over(whole)
    return ranked.withColumn("lam", lam).select(
        "src", "source_size", F.least(F.col("full"), F.col("weight") * F.coalesce(F.col("lam"), F.lit(0.0))).alias("target")
    )


def _key(id_col: Column, text_col: Column) -> Column:
    text = F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def _source_key(source_col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source_col.cast("string")), F.lit("null"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, cap: float) -> DataFrame:
    """A row per group of equal rows: src, key, doc_id, size, rows, its source's source_size, target and epochs, and
    left, the words of the last, cut epoch that are left where the group begins."""
    sizes = docs.select(
        column(id_col).alias("doc_id"),
        column(source_col).alias("source"),
        F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _source_key(column(source_col)).alias("src"),
        _key(column(id_col), column(text_col)).alias("key"),
    )
    sizes = materialise(sizes.groupBy("src", "source", "key", "doc_id", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    sizes = sizes.withColumn("rng", F.substring("key", 1, 3))
    words = F.col("size") * F.col("rows")
    ranges = sizes.groupBy("src", "source", "rng").agg(F.sum(words).alias("in_range"))
    targets = source_targets(ranges.groupBy("src", "source").agg(F.sum("in_range").alias("source_size")), cap)
    offsets = ranges.withColumn(
        "offset", F.coalesce(F.sum("in_range").over(W.partitionBy("src").orderBy("rng").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("src", "rng", "offset")
    cuts = offsets.join(targets, "src").withColumn("budget", F.floor("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    within = W.partitionBy("src", "rng").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum(words).over(within), F.lit(0)))
    return ahead.join(cuts, ["src", "rng"]).withColumn("left", F.col("rest") - F.col("offset") - F.col("ahead"))


def _numbered(rows: DataFrame, count: str, name: str, step: int = 1 << 16) -> DataFrame:
    """Each row `count` times, with a running number from 0; arrays stay below `step` items."""
    many = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {step}"))))
    inner = F.sequence(F.col("chunk") * step, F.least(F.col(count), (F.col("chunk") + 1) * step) - 1)
    return many.withColumn(name, F.explode(inner)).drop("chunk")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    each = _numbered(_planned(docs, id_col, text_col, source_col, cap), "rows", "place")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("place") * F.col("size")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, cap: float = 3.0, few: int = 100_000) -> DataFrame:
    """The mix itself: rows of docs(doc_id, text, source, ...), whole and as often as they are taken.

    The document on a source's cut is taken whole if at least half of it lies before the cut. A source's decision is its
    number of epochs and the last key taken, so texts need no shuffle: they meet a table of one row per source, which is
    broadcast if it has at most `few` rows. Of equal rows on a cut as many are taken as lie before it.
    """
    left, size, rows = F.col("left"), F.col("size"), F.col("rows")
    whole = F.when(left <= 0, 0).when(size == 0, rows).otherwise(F.least(rows, F.floor((2 * left + size) / (2 * size))))
    planned = _planned(docs, "doc_id", "text", "source", cap).withColumn("whole", whole)
    torn = (F.col("whole") > 0) & (F.col("whole") < rows)
    cuts = planned.groupBy("src").agg(
        F.max("epochs").alias("epochs"), F.max(F.when(F.col("whole") == rows, F.col("key"))).alias("last"),
        F.max(F.when(torn, F.col("key"))).alias("torn"), F.max(F.when(torn, F.col("whole"))).alias("some"), F.sum("rows").alias("n"),
    )
    cuts = materialise(cuts, "mix-cuts")
    packed = docs.select(F.struct(*columns(docs)).alias("row"), _source_key(column("source")).alias("src"), _key(column("doc_id"), column("text")).alias("key"))
    held = cuts.agg(F.count("*").alias("sources"), F.count("torn").alias("torn"), F.sum("n").alias("n")).first()
    met = packed.join(F.broadcast(cuts), "src") if held.sources <= few else skewed_lookup(packed, cuts, ["src"], "n", held.n)
    on_cut = F.coalesce(F.col("key") == F.col("torn"), F.lit(False))
    times = F.col("epochs") + F.when(F.col("key") <= F.col("last"), 1).otherwise(0)
    out = met.where(~on_cut).select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("row.*")
    if held.torn:
        others = [F.col("row").getField(c) for c in docs.columns if c not in ("text", "doc_id", "source")]
        look = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
        equal = met.where(on_cut).groupBy("src", look.alias("look")).agg(F.first("row").alias("row"), F.count("*").alias("rows"), F.first("epochs").alias("epochs"), F.first("some").alias("some"))
        before = F.coalesce(F.sum("rows").over(W.partitionBy("src").orderBy("look").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        taken = F.col("epochs") * F.col("rows") + F.greatest(F.lit(0), F.least(F.col("rows"), F.col("some") - F.col("before")))
        equal = equal.withColumn("before", before).withColumn("taken", taken).where("taken > 0")
        out = out.unionByName(_numbered(equal, "taken", "place").select("row.*"))
    return out


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS capped FROM s
), r AS (SELECT *, capped / weight AS ratio FROM w), o AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS pos,
    (sum(source_size) OVER () - coalesce(sum(capped) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev
  FROM r
), l AS (SELECT min_by(lev, pos) AS lam FROM o WHERE lev <= ratio), t AS (
  SELECT source, source_size, least(capped, weight * coalesce((SELECT lam FROM l), 0.0::DOUBLE)) AS target FROM o
), b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b
), x AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken
FROM x
"""
