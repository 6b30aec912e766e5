"""Assembling corpora: merging copies, clearing held-out records, stratified samples, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators.ranking import rank_by


def concatenate(*corpora: DataFrame) -> DataFrame:
    """Bag union, with the corpus' place as `ordinal`."""
    out = None
    for i, df in enumerate(corpora):
        df = df.withColumn("ordinal", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def arrival(df: DataFrame, name: str = "arrived") -> DataFrame:
    """A total order of the rows of df, which must come straight from files: by file name, block of the file and place in it.

    It is one number, so that aggregation keeps it in place: the block's position among all blocks, a row a task or less and
    broadcast, and the row's place in the task that reads the block.

    Corpora read from several files in another order than that of their names go through concatenate(), whose ordinal comes first.
    """
    at = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    blocks = df.select(*at).distinct().withColumn("_ordinal", F.row_number().over(W.orderBy("_file", "_block")).cast("long"))
    placed = df.select("*", *at, F.monotonically_increasing_id().alias("_place"))  # rises within the task that reads the block
    known = placed.join(F.broadcast(blocks), ["_file", "_block"], "left")
    ordinal = F.coalesce("_ordinal", F.raise_error(F.lit("a block that was not listed")).cast("long"))
    low = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return known.withColumn(name, F.shiftleft(ordinal, 33).bitwiseOR(low)).drop("_file", "_block", "_ordinal", "_place")


def merge(records: DataFrame, key: str, seq: str, same: list[str], subjects: str) -> DataFrame:
    """One row per key: the first row's fields, subjects united in order of first appearance, copies, conflict (whether copies
    disagree in anything but their subjects), and recovered, the subjects that only later copies add.

    `seq` must be a total order (see arrival()). A key's copies are reduced to its different subjects before they meet, so
    a key that very many rows repeat takes no more room than its subjects. Null subjects are none; null keys are one key.
    recovered is counted without the lists: a key's different subjects less those of its first copy.
    """
    own = F.coalesce(F.size(F.array_distinct(F.array_compact(subjects))), F.lit(0)).alias("held")
    each = records.select(F.col(key), F.col(seq).alias("at"), own, F.struct(F.col(seq).alias("at"), *same).alias("row"), F.posexplode_outer(subjects).alias("pos", "code"))
    content = F.struct(*(F.col("row")[c].alias(c) for c in same)) if same else F.lit(0)
    firsts = each.groupBy(key, "code").agg(
        F.min(F.struct(F.col("row.at").alias("at"), F.coalesce("pos", F.lit(0)).alias("pos"))).alias("first"), F.min("row").alias("row"),
        F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("copies"), F.min("at").alias("at"), F.min_by("held", "at").alias("held"), F.min(content).alias("low"), F.max(content).alias("high"),
    )
    met = firsts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("first", "code")))).alias("own"), F.min("row").alias("row"),
        F.sum("copies").alias("copies"), (F.count("code") - F.min_by("held", "at")).cast("int").alias("recovered"), (~F.min("low").eqNullSafe(F.max("high"))).alias("conflict"),
    )
    return met.select(
        key, *(F.col("row")[c].alias(c) for c in same), F.transform("own", lambda x: x.code).alias(subjects), "copies", "conflict", "recovered"
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    """One row: rows read, keys, keys with copies, subjects that later copies added."""
    none = F.lit(0)
    return merged.agg(
        F.coalesce(F.sum("copies"), none).alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("recovered"), none).alias("merged_subjects"),
    )


def refuse_conflicts(merged: DataFrame, key: str) -> DataFrame:
    """merged, which fails when it is run if copies of a key disagree: two documents under one key are no duplicate."""
    told = F.raise_error(F.concat(F.lit("record "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" appears more than once with different content")))
    return merged.where(F.when(F.col("conflict"), told.cast("boolean")).otherwise(True))


def overlap(index: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """split, n: records of each held-out split that the index holds too; splits without any have 0."""
    inside = index.select(key).distinct().withColumn("inside", F.lit(1))
    return held_out.select("split", key).distinct().join(inside, key, "left").groupBy("split").agg(F.count("inside").alias("n"))


def excluded(index: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    return held_out.select("split", key).distinct().join(index.select(key).distinct(), key, "left_semi")


def clear(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return index.join(gone.select(key), key, "left_anti")


def assembled_load(corpus: DataFrame, held_out: DataFrame, vocabulary: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, vocabulary, index): a held-out split(split, key), and the merged corpus without the records that it holds.

    The index fails when it is run if copies of any record are in conflict.
    """
    corpus = refuse_conflicts(corpus, key)
    return held_out, vocabulary, clear(corpus, excluded(corpus, held_out, key), key)


def quotas(cells: DataFrame, by: list[str], size: int) -> DataFrame:
    """Largest-remainder quotas of `size` over cells(by..., n); ties go by cell. At or above the total each cell gives all.

    If size is at least the number of cells, each that would get nothing takes one from the largest donor, in order of
    cell; of equal donors the last cell gives, and none gives its last one. Taking one at a time from the largest is taking
    the highest units of all donors: unit l of a cell is the one that its quota of l has and one of l - 1 hasn't.
    """
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row a cell
    total, cells_n = F.sum("n").over(whole), F.count("*").over(whole)
    share = F.col("n") * F.lit(size) / F.col("total")
    out = cells.withColumn("total", total).withColumn("cells", cells_n).withColumn("share", share)
    out = out.withColumn("base", F.floor(F.round("share", 9))).withColumn("rest", F.round(F.col("share") - F.col("base"), 9))
    left = F.lit(size) - F.sum("base").over(whole)
    place = F.row_number().over(W.orderBy(F.desc("rest"), *by))
    out = out.withColumn("place", place).withColumn("left", left)
    quota = F.when(F.lit(size) >= F.col("total"), F.col("n")).otherwise(F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0))
    out = out.withColumn("quota", quota.cast("long"))
    starved = (F.col("quota") == 0) & (F.col("n") > 0) & (F.lit(size) >= F.col("cells"))
    out = out.withColumn("starved", starved).withColumn("wanted", F.count_if("starved").over(whole))
    out = out.withColumn("turn", F.when(F.col("starved"), F.row_number().over(W.partitionBy("starved").orderBy(*by))))
    lowest = F.greatest(F.lit(2).cast("long"), F.col("quota") - F.col("wanted") + 1)  # no cell gives more than are wanted
    units = out.where("quota > 1 and wanted > 0").select(*by, "wanted", F.explode(F.sequence(lowest, F.col("quota"))).alias("unit"))
    ordered = units.withColumn("at", F.row_number().over(W.orderBy(F.desc("unit"), *(F.desc_nulls_last(b) for b in by)))).where("at <= wanted")
    given = ordered.groupBy(*(F.col(b).alias(f"_{b}") for b in by)).agg(F.count("*").alias("given"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    met = out.join(F.broadcast(given), reduce(Column.__and__, same), "left").withColumn("given", F.coalesce("given", F.lit(0)))
    fed = F.when(F.col("turn") <= F.sum("given").over(whole), 1).otherwise(0)
    return met.select(*by, "n", (F.col("quota") - F.col("given") + fed).alias("quota"))


def in_corpus_order(rows: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """rows with the place of their key in the corpus, in that order."""
    return rows.join(positions.select(key, "position"), key).orderBy("position")


def simple_sample(rows: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    """`size` rows in the order of a seeded hash of the key, whatever their cells."""
    return rows.orderBy(draw_key(seed, F.col(key)), key).limit(size)


def choose_per_cell(records: DataFrame, assignments: DataFrame, vocabulary: DataFrame, by: list[str], count: int, seed: int) -> DataFrame:
    """From each cell `count` records, in seeded order, that have text and codes, all of them in the vocabulary."""
    known = assignments.join(vocabulary.select("code", F.lit(1).alias("known")), "code", "left").groupBy("record_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"))
    usable = records.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(known.where("unknown = 0").select("record_id"), "record_id", "left_semi")
    drawn = rank_by(usable.withColumn("_draw", draw_key(seed, F.col("record_id"))), by, [F.col("_draw"), F.col("record_id")], limit=count, name="place")
    return drawn.drop("_draw")


def wrong_codes(records: DataFrame, gold: DataFrame, vocabulary: DataFrame, count: int, seed: int) -> DataFrame:
    """record_id, code, rank: `count` codes of the vocabulary that are certainly wrong for the record.

    The same `count` + most gold codes of any record, in seeded order, are tried for all, so that enough are left.
    """
    most = gold.select("record_id", "code").distinct().groupBy("record_id").count().agg(F.max("count")).first()[0] or 0
    pool = vocabulary.select("code").distinct().orderBy(draw_key(seed, F.col("code")), "code").limit(count + most)
    tried = records.select("record_id").join(F.broadcast(pool))  # at most count + most codes
    wrong = tried.join(gold.select("record_id", "code"), ["record_id", "code"], "left_anti")
    return rank_by(wrong.withColumn("_draw", draw_key(seed, F.col("code"))), ["record_id"], [F.col("_draw"), F.col("code")], limit=count).drop("_draw")


def fixture_codes(index: DataFrame, queries: DataFrame, vocabulary: DataFrame, withheld: int) -> DataFrame:
    """code, part: withheld (the first index codes that no query has), unseen (the first code of neither), slice (the others)."""
    i, q, v = (df.select("code").distinct() for df in (index, queries, vocabulary))
    gone = i.join(q, "code", "left_anti").orderBy("code").limit(withheld)
    unseen = v.join(q, "code", "left_anti").join(i, "code", "left_anti").orderBy("code").limit(1)
    rest = i.unionByName(q).distinct().join(F.broadcast(gone), "code", "left_anti")
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(gone, "withheld").unionByName(part(unseen, "unseen")).unionByName(part(rest, "slice"))


def draw_key(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_sample(rows: DataFrame, quota: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """From each cell its quota of rows, in the order of a seeded hash of the key. No task keeps more of a cell than the largest quota."""
    most = quota.agg(F.max("quota")).first()[0] or 0
    drawn = rank_by(rows.withColumn("_draw", draw_key(seed, F.col(key))), by, [F.col("_draw"), F.col(key)], limit=int(most), name="_at")
    return drawn.join(quota.select(*by, "quota"), by).where(F.col("_at") < F.col("quota")).drop("_draw", "_at", "quota")


def cell_shares(corpus: DataFrame, sample: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of each cell in the corpus and in the sample."""
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = count(corpus, "corpus").join(count(sample, "sample"), by, "full").na.fill(0, ["corpus", "sample"])
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0)).alias(f"{c}_share")
    return both.select(*by, "corpus", "sample", share("corpus"), share("sample"))


def duplicated_from(queries: DataFrame, index: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Keys of queries whose `same` fields, none of them null, equal an indexed row's under another key; compared by a SHA-256 of lengths and fields."""
    h = lambda: F.sha2(F.concat(*(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in same)).cast("binary"), 256)
    known = index.select(h().alias("h"), F.col(key).alias("_k")).groupBy("h").agg(F.min("_k").alias("low"), F.max("_k").alias("high"))
    return queries.select(key, h().alias("h")).join(known, "h").where((F.col("low") != F.col(key)) | (F.col("high") != F.col(key))).select(key)


def homographs(vocabulary: DataFrame) -> DataFrame:
    """name, codes (how many), first and last of names that stand for several codes."""
    return vocabulary.groupBy("name").agg(F.countDistinct("code").alias("codes"), F.min("code").alias("first"), F.max("code").alias("last")).where("codes > 1")


def top_per_cell(sizes: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n largest records of each cell, ties by id."""
    return rank_by(sizes, by, [F.desc("size"), F.col("record_id")], limit=n)
