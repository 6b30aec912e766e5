"""Refusals as queries: each returns its violations, empty if all is well. And small lookups over documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ranking import numbered


class Refused(ValueError):
    """A check found violations."""


def require_none(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Raise with the first few violations."""
    rows = violations.limit(shown).collect()
    if rows:
        raise Refused(f"{what}: {', '.join(map(str, (tuple(r) for r in rows)))}")


def bad_rankings(rankings: DataFrame, length: int) -> DataFrame:
    """Records whose ranking hasn't exactly `length` distinct codes."""
    counts = rankings.groupBy("record_id").agg(F.count("*").alias("codes"), F.countDistinct("code").alias("distinct_codes"))
    return counts.where((F.col("codes") != length) | (F.col("distinct_codes") != length))


def repeated_codes(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy("record_id", "code").agg(F.count("*").alias("times")).where("times > 1")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def blank_cells(records: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return records.where(blank("type") | blank("lang")).select("record_id")


def unpaired(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys on one side alone, with the side."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def without_cell(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Records that have no type and language."""
    return records.select("record_id").join(cells.select("record_id"), "record_id", "left_anti")


def misaligned_records(records: DataFrame, rankings: DataFrame) -> DataFrame:
    """problem, record_id: ids that appear more than once, and records without a ranking."""
    twice = repeated_ids(records, "record_id").select(F.lit("repeated").alias("problem"), "record_id")
    missing = records.select("record_id").distinct().join(rankings.select("record_id").distinct(), "record_id", "left_anti")
    return twice.unionByName(missing.select(F.lit("no ranking").alias("problem"), "record_id"))


def submission_gaps(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """grain, place: types, languages and files of gold(type, lang, file) that the submission lacks, and files that are no JSON.

    A missing type isn't missing its languages too, nor a missing language its files.
    """
    stem = lambda df: df.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
    lacking = lambda a, b, on: a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti")
    g, s = stem(gold), stem(submitted)
    place = lambda *c: F.concat_ws("/", *c).alias("place")
    types = lacking(g, s, ["type"])
    left = g.join(types, "type", "left_anti")
    languages = lacking(left, s, ["type", "lang"])
    files = lacking(left.join(languages, ["type", "lang"], "left_anti"), s, ["type", "lang", "stem"])
    other = s.where(~F.col("file").endswith(".json"))
    return types.select(F.lit("type").alias("grain"), F.col("type").alias("place")).unionByName(
        languages.select(F.lit("language").alias("grain"), place("type", "lang"))
    ).unionByName(files.select(F.lit("file").alias("grain"), place("type", "lang", "stem"))).unionByName(other.select(F.lit("no JSON").alias("grain"), place("type", "lang", "file")))


def appendix_conflicts(models: DataFrame, cutoff: str, providers: list[str]) -> DataFrame:
    """name, problem: models inside the cutoff that are marked as outside, or outside and not marked, or that nothing can call."""
    day = F.lit(cutoff).cast("date")
    inside = (F.col("created") <= day) & (F.col("revision_date") <= day)
    problem = F.when(inside & F.col("appendix"), "marked, but inside the cutoff").when(~inside & ~F.col("appendix"), "outside the cutoff, but not marked")
    problem = problem.when(~F.coalesce(F.col("provider").isin(*providers), F.lit(False)), "no known provider")
    return models.select("name", problem.alias("problem")).where("problem is not null")


def after_cutoff(models: DataFrame, cutoff: str) -> DataFrame:
    """Models created or revised after the cutoff date."""
    return models.where((F.col("created") > F.lit(cutoff).cast("date")) | (F.col("revision_date") > F.lit(cutoff).cast("date")))


def registry_report(models: DataFrame, cutoff: str) -> DataFrame:
    """name, flag, created, pinned of a registry(name, created, revision_date, appendix, origin, revision, provider): FAIL for what
    postdates the cutoff and isn't marked, APDX for what is marked, ok for the rest; hosted models declare their revision."""
    late = (F.greatest("created", "revision_date") > F.lit(cutoff).cast("date")) & ~F.col("appendix")
    flag = F.when(late, "FAIL").when(F.col("appendix"), "APDX").otherwise("ok")
    declared = F.concat(F.col("revision"), F.lit(" (declared, "), F.col("provider"), F.lit(")"))
    dated = F.concat(F.substring("revision", 1, 12), F.lit(" ("), F.col("revision_date").cast("string"), F.lit(")"))
    return models.select("name", flag.alias("flag"), F.col("created").cast("string").alias("created"), F.when(F.col("origin") == "api", declared).otherwise(dated).alias("pinned"))


def as_of(events: DataFrame, by: list[str], at: str, value: str, cutoff) -> DataFrame:
    """The newest row of each group not after the cutoff; ties go to the larger value."""
    kept = events.where(F.col(at) <= cutoff)
    return kept.groupBy(*by).agg(F.max(F.struct(F.col(at), F.col(value))).alias("x")).select(*by, F.col(f"x.{at}").alias(at), F.col(f"x.{value}").alias(value))


def document_diff(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """name, field, old, new: fields of documents(name, field, value) that changed, came or went."""
    a, b = old.select("name", "field", F.col("value").alias("old")), new.select("name", "field", F.col("value").alias("new"))
    return a.join(b, ["name", "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")) & ~F.col("field").isin(*ignore))


def fingerprint(sections: dict) -> str:
    """12 hex digits that name a stage's output by what it depends on."""
    return hashlib.sha256(json.dumps(sections, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def folded(level: DataFrame, n: int, width: int = 4096) -> str:
    """The digest (64 hex digits) of n digests d by position, and of their number.

    Digests are hashed `width` at a time by position, level by level, until at most `width` are left for the driver.
    """
    left = n
    while left > width:
        held = level.groupBy(F.floor(F.col("position") / width).alias("position")).agg(F.sort_array(F.collect_list(F.struct("position", "d"))).alias("x"))
        level = held.select("position", F.sha2(F.array_join(F.transform("x", lambda x: x.d), "").cast("binary"), 256).alias("d"))
        left = -(-left // width)
    whole = hashlib.sha256()
    for row in level.orderBy("position").collect():
        whole.update(bytes.fromhex(row.d))
    whole.update(str(n).encode())
    return whole.hexdigest()


def input_revision(texts: DataFrame, order: str, text: str, width: int = 4096) -> str:
    """16 hex digits over the number of texts, the texts and their order."""
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("\0null")).cast("binary"), 256)
    level = numbered(texts.select(F.col(order).alias("o"), digest.alias("d")), [F.col("o"), F.col("d")])
    return folded(level, texts.count(), width)[:16]
