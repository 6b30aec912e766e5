"""Readers and writers of the pipeline's file formats.

Readers give long or nested DataFrames; writers check what they write first. Whole-tree writers put one file a record from
the executors, through the filesystem of the target, with no gathering on the driver.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import language_code, subject_list
from rankloom.operators.checks import Refused, bad_rankings, repeated_ids, require_none
from rankloom.sources.json_parts import json_entries

RECORD = "id string, type string, lang string, title string, abstract string, subjects string"
ENTRY = "`Code` string, `Name` string, `Classification Number` string, `Classification Name` string, `Alternate Name` array<string>, `Related Subjects` array<string>, `Definition` string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV records: quoted fields may hold line ends; missing fields are empty; subjects are split at white space."""
    raw = spark.read.csv(path, schema=RECORD, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.select("id", text("type"), language_code(F.coalesce("lang", F.lit(""))).alias("lang"), text("title"), text("abstract"), subject_list(F.col("subjects")).alias("subjects"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of entries, or a map from code to entry, as code, name, group, group_number, alternates, related, definition.

    Several tasks read one file, an entry a row.
    """
    whole = json_entries(spark, path)
    kind = ENTRY.replace(" string", ": string").replace(" array<", ": array<").replace("` :", "`:")
    listed = F.from_json("value", f"struct<{kind}>")
    keyed = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), f"map<string, struct<{kind}>>")
    rows = whole.where("not keyed").select(listed.alias("e")).select(F.col("e.Code").alias("code"), "e").unionByName(
        whole.where("keyed").select(F.explode(keyed).alias("code", "e"))
    )
    return rows.select("code", *entry_fields())


def entry_fields() -> list[Column]:
    """The fields of a release entry in column e, each with its default."""
    text = lambda c, name: F.coalesce(F.col(f"e.`{c}`"), F.lit("")).alias(name)
    names = lambda c, name: F.coalesce(F.col(f"e.`{c}`"), F.array().cast("array<string>")).alias(name)
    return [
        text("Name", "name"), text("Classification Name", "group"), text("Classification Number", "group_number"),
        names("Alternate Name", "alternates"), names("Related Subjects", "related"), text("Definition", "definition"),
    ]


def read_string_map(spark: SparkSession, path: str, field: str | None = None, optional: bool = False) -> DataFrame:
    """key, value of a JSON map, or of one of its fields; a missing file is empty if optional, else an error."""
    if optional and not _exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    if field is None:  # several tasks read one file, an entry a row
        whole = F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string, string>")
        return json_entries(spark, path).where("keyed").select(F.explode(whole).alias("key", "value"))
    column = F.from_json(F.get_json_object("value", f"$.{field}"), "map<string, string>")
    return spark.read.text(path, wholetext=True).select(F.explode(column).alias("key", "value"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """code, band, count from {labels: {band: {code: count}}}."""
    return bands_of(spark.read.text(path, wholetext=True))


def bands_of(documents: DataFrame) -> DataFrame:
    """code, band, count of documents in column value."""
    whole = documents.select(F.from_json(F.get_json_object("value", "$.labels"), "map<string, map<string, bigint>>").alias("m"))
    return whole.select(F.explode("m").alias("band", "codes")).select("band", F.explode("codes").alias("code", "count"))


def read_document(spark: SparkSession, path: str) -> str:
    """One small document as it stands, white space and all."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """split, record_id, rank, code of a prediction document {split, predictions: {record: [codes]}}; others are refused."""
    raw = spark.read.text(path, wholetext=True).select("value", F.get_json_object("value", "$.split").alias("split"), F.get_json_object("value", "$.predictions").alias("own"))
    require_none(raw.where("split is null or own is null").select(F.substring("value", 1, 40)), "no split or no predictions in a prediction document")
    lists = raw.select("split", F.explode(F.from_json("own", "map<string, array<string>>")).alias("record_id", "codes"))
    return lists.select("split", "record_id", F.posexplode("codes").alias("rank", "code"))


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, value (null for a file that is no JSON of the schema), broken: one row a file, and no failure."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("value"))
    broken = F.col("value").isNull() | F.col("value._corrupt").isNotNull()
    return raw.select("path", F.when(~broken, F.col("value").dropFields("_corrupt")).alias("value"), broken.alias("broken"))


GRAPH = "`@graph` array<map<string, string>>"


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """id, type, lang, title, abstract, subjects of bibliographic JSON-LD files: the node with a title; scalars or lists alike."""
    # ids are file names; maps keep scalars and nested values as JSON text
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    node = F.filter(F.from_json(F.get_json_object("value", "$.@graph"), "array<map<string, string>>"), lambda n: n["title"].isNotNull())[0]
    own = raw.select(F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "").alias("id"), node.alias("n"))
    return own.select(
        "id", F.regexp_extract(_joined(F.col("n")["@type"]), "[^:]*$", 0).alias("type"), language_code(_joined(F.col("n")["language"])).alias("lang"),
        _joined(F.col("n")["title"]).alias("title"), _joined(F.col("n")["abstract"]).alias("abstract"), subjects_of(F.col("n")["dcterms:subject"]).alias("subjects"),
    )


def _joined(value):
    """A JSON scalar or list of scalars as one text, white space made single."""
    parts = F.when(F.ltrim(value).startswith("["), F.array_join(F.from_json(value, "array<string>"), " ")).otherwise(value)
    return F.trim(F.regexp_replace(F.coalesce(parts, F.lit("")), r"\s+", " "))


def subjects_of(value, prefix: str = "gnd:"):
    """Ids with the prefix, in order, from a JSON object {@id}, or a list of them."""
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<struct<`@id`: string>>")).otherwise(F.array(F.from_json(value, "`@id` string")))
    ids = F.transform(listed, lambda x: x["@id"])
    return F.coalesce(F.array_distinct(F.filter(ids, lambda x: x.startswith(prefix))), F.array().cast("array<string>"))


def read_turtle_labels(spark: SparkSession, path: str, language: str = "de") -> DataFrame:
    """code, label: the first preferred label in the language of each concept block of Turtle files. Blocks end at ' .' line ends."""
    blocks = spark.read.text(path, lineSep=" .\n").withColumnRenamed("value", "block")
    code = F.regexp_extract("block", r"(gnd:\S+|<[^>]*/gnd/([^>]+)>)\s+a\s", 1)
    code = F.when(code.startswith("<"), F.concat(F.lit("gnd:"), F.regexp_extract("block", r"<[^>]*/gnd/([^>]+)>\s+a\s", 1))).otherwise(code)
    label = F.regexp_extract("block", rf'skos:prefLabel\s+"((?:[^"\\]|\\.)*)"@{language}', 1)
    plain = F.regexp_replace(label, r'\\(["\\])', "$1")
    return blocks.select(code.alias("code"), plain.alias("label")).where("code <> '' and label <> ''")


def recovered_qualifiers(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """code, qualifier: labels of the form 'X (Y)' whose name reads 'X Y', compared in composed form; the name's own spelling of Y."""

    @F.pandas_udf(T.StringType())
    def suffix(name: pd.Series, base: pd.Series, qualifier: pd.Series) -> pd.Series:
        nfc = lambda s: unicodedata.normalize("NFC", s)

        def one(n: str, b: str, q: str) -> str | None:
            if not q or nfc(n) != nfc(f"{b} {q}"):
                return None
            return next((n[i:] for i in range(len(n)) if nfc(n[i:]) == nfc(q) and n[i - 1 : i] == " "), None)

        return pd.Series([one(*x) for x in zip(name, base, qualifier)], dtype=object)

    pattern = r"^(.+?) \((.+)\)$"
    joined = entries.select("code", "name").join(labels, "code").where(F.col("label").rlike(pattern))
    found = joined.select("code", suffix("name", F.regexp_extract("label", pattern, 1), F.regexp_extract("label", pattern, 2)).alias("qualifier"))
    return found.where("qualifier is not null")


def read_gold_tree(spark: SparkSession, root: str) -> DataFrame:
    """record_id, type, lang, subjects of <type>/<lang>/<id>.jsonld; subjects from the last graph node, an object or a list."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonld").text(root, wholetext=True).withColumn("path", F.input_file_name())
    nodes = F.from_json(F.get_json_object("value", "$.@graph"), "array<map<string, string>>")
    return _placed(raw).withColumn("s", F.element_at(nodes, -1)["dcterms:subject"]).where("s is not null").select("record_id", "type", "lang", subjects_of(F.col("s")).alias("subjects"))


def read_submission_tree(spark: SparkSession, root: str) -> DataFrame:
    """record_id, type, lang, rank, code of <type>/<lang>/<id>.json."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).withColumn("path", F.input_file_name())
    listed = F.from_json("value", "`dcterms:subject` array<string>")["dcterms:subject"]
    return _placed(raw).select("record_id", "type", "lang", F.posexplode(listed).alias("rank", "code"))


def _placed(raw: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    decoded = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return raw.withColumn("record_id", F.regexp_replace(decoded(F.element_at(parts, -1)), r"\.[^.]*$", "")).withColumn("lang", decoded(F.element_at(parts, -2))).withColumn("type", decoded(F.element_at(parts, -3)))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its filesystem, the default one where it names none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file:///{whole.removeprefix('file:').lstrip('/')}" if whole.startswith("file:") else whole


def _write_tree(rows: DataFrame, root: str, suffix: str) -> int:
    """rows(type, lang, record_id, body) as files, written by the executors; returns how many.

    They are written beside the tree, which takes the place of an older one when all are there: a job that fails half-way
    leaves the old tree as it was, and no file of its own.
    """
    spark = rows.sparkSession
    whole = _qualified(spark, root).rstrip("/")
    parent, name = whole.rsplit("/", 1)
    uri = f"{parent}/.{uuid.uuid4().hex}-{name}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(uri)
        for pdf in frames:
            for t, lang, record, body in zip(pdf["type"], pdf["lang"], pdf["record_id"], pdf["body"]):
                files.create_dir(f"{base}/{t}/{lang}", recursive=True)
                with files.open_output_stream(f"{base}/{t}/{lang}/{record}{suffix}") as out:
                    out.write(body.encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    columns = [F.col(c).cast("string").alias(c) for c in ("type", "lang", "record_id")]
    old, half, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{uri}-old", uri, whole))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(half)
    try:
        written = rows.select(*columns, "body").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
        if fs.exists(target):
            fs.rename(target, old)
        if not fs.rename(half, target):
            fs.rename(old, target)
            raise OSError(f"could not move the files to {whole}")
        return written
    finally:
        for left in (half, old):
            fs.delete(left, True)


def write_submission(rankings: DataFrame, cells: DataFrame, root: str, length: int = 50) -> int:
    """One JSON file a record with exactly `length` distinct codes; refuses anything else before writing."""
    require_none(bad_rankings(rankings, length), f"rankings without {length} distinct codes")
    require_none(repeated_ids(cells, "record_id"), "records with several cells")
    lists = rankings.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x.code.cast("string")).alias("codes"))
    body = F.to_json(F.struct(F.col("codes").alias("dcterms:subject")))
    return _write_tree(lists.join(cells.select("record_id", "type", "lang"), "record_id").withColumn("body", body), root, ".json")


def write_gold_tree(gold: DataFrame, cells: DataFrame, root: str) -> int:
    lists = gold.groupBy("record_id").agg(F.sort_array(F.collect_set(F.col("code").cast("string"))).alias("codes"))
    subjects = F.transform("codes", lambda c: F.struct(c.alias("@id")))
    graph = F.array(F.to_json(F.struct(F.col("record_id").cast("string").alias("@id"))), F.to_json(F.struct(F.col("type").alias("@type"), subjects.alias("dcterms:subject"))))
    body = F.concat(F.lit('{"@graph":['), F.array_join(graph, ","), F.lit("]}"))
    return _write_tree(lists.join(cells.select("record_id", "type", "lang"), "record_id").withColumn("body", body), root, ".jsonld")


def latest_lines(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value of each key's last line, and how many lines it has."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("lines"))


def unlogged(rows: DataFrame, log: DataFrame, keys: list[str], once: list[str] | None = None) -> DataFrame:
    """The rows whose keys the log doesn't hold, one for each `once` (the keys by default)."""
    return rows.dropDuplicates(once or keys).join(log.select(*keys), keys, "left_anti")


def read_log(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """A JSON-lines log, newest last; a missing one is empty."""
    return spark.read.schema(schema).json(path).orderBy(order) if _exists(spark, path) else spark.createDataFrame([], schema)


def append_new(log_path: str, rows: DataFrame, keys: list[str]) -> None:
    """Append the rows that the JSON-lines log doesn't hold yet."""
    spark = rows.sparkSession
    held = spark.read.schema(rows.schema).json(log_path) if _exists(spark, log_path) else rows.limit(0)
    fresh = unlogged(rows, held, keys)
    fresh.write.mode("append").json(log_path)


def write_records(records: DataFrame, path: str) -> None:
    """CSV with a header, replacing what was there; subjects joined by spaces."""
    flat = records.withColumn("subjects", F.array_join("subjects", " "))
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_prior(head: DataFrame, path: str) -> None:
    head.write.mode("overwrite").parquet(path)


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """group, coefficients, intercept of a head that was fitted; refuses to go on without one."""
    if not _exists(spark, path):
        raise Refused(f"no fitted head at {path}")
    return spark.read.parquet(path).select("group", "coefficients", "intercept")


def write_predictions(rankings: DataFrame, split: str, path: str) -> None:
    """split, record_id and codes in order as JSON lines, one a record."""
    codes = F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x.code).alias("codes")
    write_json(rankings.groupBy("record_id").agg(codes).select(F.lit(split).alias("split"), "record_id", "codes"), path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_sorted_map(rows: DataFrame, path: str, files: int = 1) -> None:
    """key, value as JSON lines in order of key, replacing what was there: the same bytes for the same rows, however they come.

    One file by default. Of several, each holds the keys that a hash of the key gives it, in order.
    """
    ordered = rows.select("key", "value").repartition(files, "key").sortWithinPartitions("key", "value")
    ordered.write.mode("overwrite").option("compression", "none").json(path)


def keyed(entries: DataFrame, key: str) -> DataFrame:
    """key and entry, the row as JSON: a list of entries made a map."""
    return entries.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_vocabulary(entries: DataFrame, qualifiers: DataFrame, path: str) -> DataFrame:
    """Entries by code, their recovered qualifiers beside them, and one row of counts, which is returned as well."""
    write_sorted_map(keyed(entries, "code"), f"{path}/entries")
    write_sorted_map(qualifiers.select(F.col("code").alias("key"), F.col("qualifier").alias("value")), f"{path}/qualifiers")
    stats = entries.agg(F.count("*").alias("entries")).join(qualifiers.agg(F.count("*").alias("qualifiers")))  # one row each
    write_json(stats, f"{path}/stats")
    return entries.sparkSession.read.schema(stats.schema).json(f"{path}/stats")


def write_projection(entries: DataFrame, columns: list[str], path: str) -> None:
    """Some columns as CSV with a header; arrays joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if entries.schema[c].dataType.typeName() == "array" else F.col(c) for c in columns]
    entries.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def documents(rows: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """document: each row as JSON, its columns nested in sections."""
    return rows.select(F.to_json(F.struct(*(F.struct(*columns).alias(name) for name, columns in sections.items()))).alias("document"))


def read_screens(spark: SparkSession, path: str, schema_tag: str) -> DataFrame:
    """screen, documents, encoder, metric, value of screen documents; refuses another schema tag."""
    raw = spark.read.text(path, wholetext=True)
    require_none(raw.select(F.get_json_object("value", "$.schema").alias("schema")).where(~F.col("schema").eqNullSafe(F.lit(schema_tag))), "screens with another schema")
    rows = F.from_json(F.get_json_object("value", "$.rows"), "array<struct<encoder: string, micro: map<string, double>>>")
    own = raw.select(F.get_json_object("value", "$.split").alias("screen"), F.get_json_object("value", "$.index.documents").cast("long").alias("documents"), F.explode(rows).alias("r"))
    return own.select("screen", "documents", "r.encoder", F.explode("r.micro").alias("metric", "value"))


def negatives_path(root: str, configuration: str, split: str, depth: int) -> str:
    """Where mined negatives lie: named by what they were mined with, so that a run can't read another's."""
    for part in (configuration, split):
        if not part or set(part) & set("/\\") or part.startswith("."):
            raise ValueError(f"{part!r} is no name of a configuration or a split")
    return f"{root.rstrip('/')}/{configuration}-{split}-{int(depth)}"


def write_negatives(negatives: DataFrame, root: str, configuration: str, split: str, depth: int) -> str:
    """negatives(record_id, rank, code) as a table of its own; refuses ranks that the depth doesn't have."""
    require_none(negatives.where((F.col("rank") < 0) | (F.col("rank") >= depth)), f"negatives beyond depth {depth}")
    path = negatives_path(root, configuration, split, depth)
    negatives.select("record_id", "rank", "code").write.mode("overwrite").parquet(path)
    return path


def read_negatives(spark: SparkSession, root: str, configuration: str, split: str, depth: int) -> DataFrame:
    """What write_negatives() wrote under these names; refused if nothing was mined under them."""
    path = negatives_path(root, configuration, split, depth)
    if not _exists(spark, f"{path}/_SUCCESS"):
        raise Refused(f"no negatives were mined for {configuration}, {split}, depth {depth}")
    return spark.read.parquet(path)
