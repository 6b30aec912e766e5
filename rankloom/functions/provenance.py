"""What results depend on: closed configurations, stage keys, data revisions, attestations and receipts.

These are small, driver-side documents. Where they are about tables, the tables are reduced by Spark first.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import typing
import uuid
from pathlib import Path

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.checks import Refused, fingerprint, folded
from rankloom.operators.corpus import excluded, overlap
from rankloom.operators.ranking import numbered
from rankloom.sources.digests import file_digests
from rankloom.sources.scratch import discard, write_once


class ConfigError(ValueError):
    """A configuration that can't be read in one way only."""


def build(kind: type, raw: dict | None, path: str = ""):
    """A dataclass (with dataclass fields for sections) from a document; unknown keys and wrong types are refused."""
    if not isinstance(raw or {}, dict):
        raise ConfigError(f"{path or 'the document'} is no section")
    types, given = typing.get_type_hints(kind), dict(raw or {})
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(given) - set(known)):
        raise ConfigError(f"unknown keys in {path or 'the document'}: {', '.join(unknown)}")
    for name, value in given.items():
        want, where = types[name], f"{path}.{name}".lstrip(".")
        if dataclasses.is_dataclass(want):
            given[name] = build(want, value, where)
        elif want in (int, float, str, bool) and not (isinstance(value, want) and (want is bool or not isinstance(value, bool)) or want is float and type(value) is int):
            raise ConfigError(f"{where} is {value!r}, not {want.__name__}")
    return kind(**given)


def without_disabled(value):
    """A document in which sections that are switched off say so and nothing else, so that they compare equal."""
    if isinstance(value, dict):
        return {"enabled": False} if value.get("enabled") is False else {k: without_disabled(v) for k, v in value.items()}
    return value


def differences(documents: dict[str, dict]) -> dict[str, dict]:
    """Dotted key -> value by document, for keys on which the documents differ."""

    def flat(d: dict, at: str = "") -> dict:
        out = {}
        for k, v in d.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": v}
        return out

    flats = {name: flat(without_disabled(d)) for name, d in documents.items()}
    keys = sorted({k for f in flats.values() for k in f})
    found = {k: {n: f.get(k) for n, f in flats.items()} for k in keys}
    return {k: v for k, v in found.items() if len({json.dumps(x, sort_keys=True) for x in v.values()}) > 1}


def require_pairs(pairs: list[tuple[dict, dict]], equal: list[str], adapter: str = "adapter", model: str = "model") -> None:
    """Refuse pairs (untrained, trained) of configurations that differ in more than the adapter.

    Each pair is one model, with and without an adapter, and the sections named in `equal` are the same within every pair and
    in all of them: otherwise the difference between the two is not what training added.
    """
    for before, after in pairs:
        if before.get(adapter) is not None:
            raise Refused(f"{before.get('name')} names an adapter, so it is not the untrained side of a pair")
        if after.get(adapter) is None:
            raise Refused(f"{after.get('name')} names no adapter, so the pair is one configuration twice")
        if before.get(model) != after.get(model):
            raise Refused(f"{before.get(model)} and {after.get(model)} are two models")
        for other in (after, pairs[0][0]):
            found = differences({"a": {s: before.get(s) for s in equal}, "b": {s: other.get(s) for s in equal}})
            if found:
                told = "; ".join(f"{key}: {x.get('a')} and {x.get('b')}" for key, x in found.items())
                raise Refused(f"{before.get('name')} and {other.get('name')} differ in more than the adapter: {told}")


def longest_prefix(name: str, prefixes: dict[str, tuple[str, str]]) -> tuple[str, str]:
    """The (document, label) prefixes of the longest key that the model's name contains; none if no key fits."""
    return max(((k, v) for k, v in prefixes.items() if k in name), key=lambda x: len(x[0]), default=("", ("", "")))[1]


def data_revision(spark: SparkSession, paths: list[str]) -> str:
    """12 hex digits over the names and contents of the files that exist at or below the paths, of any size."""
    found = write_once(file_digests(spark, paths), "revision")
    n = found.count()
    level = numbered(found.select(F.col("name").alias("o"), F.sha2(F.concat_ws(":", "name", "digest").cast("binary"), 256).alias("d")), [F.col("o"), F.col("d")])
    out = fingerprint({"files": folded(level, n)} if n else {})
    discard(found)
    return out


class StageStore:
    """Tables of stages, each under a key of what it depends on. Reading never creates anything."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: str, depends: dict) -> str:
        return f"{self.root}/{stage}/{fingerprint(depends)}"

    def exists(self, stage: str, depends: dict) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(stage, depends) + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def load(self, stage: str, depends: dict) -> DataFrame:
        if not self.exists(stage, depends):
            raise Refused(f"stage {stage} has not been made for {json.dumps(depends, sort_keys=True)}")
        return self.spark.read.parquet(self.path(stage, depends))

    def scores(self, configuration: dict, split: str, records: int) -> DataFrame:
        """The scores (record_id, code, model) of a scoring pass over exactly these records; refused if none was stored."""
        return self.load("scores", {"configuration": configuration, "split": split, "records": records})

    def replayed(self, configuration: dict, split: str, records: int, candidates: DataFrame, score, refresh: bool = False) -> DataFrame:
        """The stored pass, or score(candidates) stored as one the first time or on `refresh`; a pass that doesn't cover the candidates is refused."""
        depends = {"configuration": configuration, "split": split, "records": records}
        if refresh or not self.exists("scores", depends):
            score(candidates).select("record_id", "code", "model").write.mode("overwrite").parquet(self.path("scores", depends))
        found = self.load("scores", depends)
        left = candidates.select("record_id", "code").join(found, ["record_id", "code"], "left_anti")
        if not left.isEmpty():
            raise Refused(f"the stored scoring pass for {split} lacks some of the candidates")
        return found

    def memo(self, stage: str, depends: dict, compute) -> DataFrame:
        """The stage's table, computed and written only the first time."""
        if not self.exists(stage, depends):
            compute().write.mode("overwrite").parquet(self.path(stage, depends))
        return self.load(stage, depends)


def attest(index: DataFrame, held_out: DataFrame, key: str, revision: str, path: str) -> dict:
    """What the index shares with the held-out splits: counts by split, and where the ids to leave out are written."""
    gone = excluded(index, held_out, key)
    gone.write.mode("overwrite").parquet(path)
    return {"revision": revision, "overlaps": {str(r["split"]): r["n"] for r in overlap(index, held_out, key).collect()}, "excluded": path}


def require_alignment(spark: SparkSession, attestation: dict, revision: str) -> DataFrame:
    """The ids to drop, once each, if the attestation is about this revision of the data."""
    if attestation["revision"] != revision:
        raise Refused(f"attested for {attestation['revision']}, the data are {revision}")
    return spark.read.parquet(attestation["excluded"]).drop("split").distinct()


class Receipts:
    """A test plan is fixed before the split is read, and the split is read once. Kept in a folder of any filesystem.

    Each read is a file of its own that is created only if it is not there, in one step, so of several reads at a time one
    succeeds, and the log only grows.
    """

    def __init__(self, root: str):
        self.files, base = pyarrow.fs.FileSystem.from_uri(str(root) if "://" in str(root) else Path(root).absolute().as_uri())
        self.root, self.uri = base.rstrip("/"), str(root).rstrip("/")

    def _write(self, name: str, document: dict) -> None:
        self.files.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(f"{self.root}/{name}") as out:
            out.write(json.dumps(document, sort_keys=True).encode())

    def _create(self, name: str, document: dict) -> bool:
        """Write the document if there is none of that name, and say whether this call did."""
        data = json.dumps(document, sort_keys=True).encode()
        self.files.create_dir(f"{self.root}/{name}".rsplit("/", 1)[0], recursive=True)
        if isinstance(self.files, pyarrow.fs.LocalFileSystem):  # a link to a whole file appears at once, or not at all
            half = f"{self.root}/.{uuid.uuid4().hex}"
            Path(half).write_bytes(data)
            try:
                os.link(half, f"{self.root}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(half)
            return True
        spark = SparkSession.active()
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        try:
            out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(data)
        out.close()
        return True

    def _read(self, name: str) -> dict | None:
        if self.files.get_file_info(f"{self.root}/{name}").type != pyarrow.fs.FileType.File:
            return None
        with self.files.open_input_stream(f"{self.root}/{name}") as given:
            return json.loads(given.read())

    def fix_plan(self, plan: dict) -> str:
        digest = hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()
        self._write("plan.json", {"digest": digest, "plan": plan})
        return digest

    def require_plan(self, plan: dict) -> None:
        fixed = self._read("plan.json")
        if fixed is None or fixed["digest"] != hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest():
            raise Refused("this plan is not the one that was fixed")

    def reads(self) -> list[dict]:
        """Every read so far, the first one first."""
        found = self.files.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/reads", allow_not_found=True))
        return [self._read(f"reads/{f.base_name}") for f in sorted(found, key=lambda f: f.base_name)]

    def require_unread(self, justification: str = "") -> None:
        """Write the receipt; a second read needs a reason, whoever made the first one."""
        place = len(self.reads())
        while place == 0 or justification.strip():
            if self._create(f"reads/{place:06d}.json", {"justification": justification}):
                return
            place += 1
        raise Refused("the split was read before; say why it is read again")

    def require_read(self) -> None:
        if not self.reads():
            raise Refused("nothing can be derived from a split that was not read")

    def receipt(self, facts: dict) -> dict:
        """What was read, why, and under which plan, with the facts of the run."""
        self.require_read()
        plan = self._read("plan.json") or {}
        return {"plan": plan.get("digest"), "reads": self.reads(), "facts": facts}


def pinned(name: str, revision: str | None, releases: dict[str, str]) -> str:
    """The revision to load a model at: the registered one; a configuration may repeat it, but not name another."""
    if name not in releases:
        raise ConfigError(f"{name} is not registered, so nothing says how old it is")
    if revision and revision != releases[name]:
        raise ConfigError(f"{name} is registered at {releases[name]}, the configuration names {revision}")
    return releases[name]
