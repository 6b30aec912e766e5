"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the stretches of 2, 3 and 4 bytes of the lower-cased text in which everything but letters counts as a space;
each is hashed to one of 2**bits embeddings, and a document is the average over all of its subwords. Training takes the
`sample` labelled rows with the smallest hashes of their id; each row's subwords are counted on the executors over its
whole text; rows that repeat an id, a language and a text are learned once. A fifth of the sample is kept from training: there a temperature is fitted that calibrates the softmax, and
the rejection threshold is set to the lowest confidence above which at least `precision` of the answers are right.

Averages are linear, so for prediction each embedding is multiplied by the softmax weights once: the model that is sent
to executors is one table of 2**bits rows of scores.

Cases: null texts and texts without a letter (superscript, Roman and other numerals are none) are `und` with score 0, as is everything if no labelled row has a letter;
rows with null labels are not learned from; very long texts are read in pieces that overlap by three bytes; ties go to
the language that sorts first; rows may repeat; a null id is never held out and is learned from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import column, forget, free_name, materialise, remainder, table
from rankloom.llm.textbatch import groups_of, map_arrow

MAYBE_LETTER = re.compile(r"[^\W\d_]")
LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PIECE = 1 << 20
CELLS = 4_000_000  # scores (of one place in one language) worked out at a time
SPAN = 4


def subwords(raw: np.ndarray, bits: int) -> list[np.ndarray]:
    """Hashes of the stretches of 2, 3 and 4 bytes that start at each byte."""
    x = raw.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (two[:-1] << np.uint32(8)) | x[2:]
    four = (three[:-1] << np.uint32(8)) | x[3:]
    down = np.uint32(32 - bits)
    return [((g * np.uint32(f) + np.uint32(a)) * np.uint32(2654435761)) >> down for g, f, a in ((two, 2246822519, 1), (three, 3266489917, 2), (four, 668265263, 3))]


def has_letter(text: str | None) -> bool:
    """Numerals that are no digits, as superscripts and Roman ones, are no letters."""
    return any(m.group().isalpha() for m in MAYBE_LETTER.finditer(text or ""))


def folded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY) + b" " * (SPAN - 1)


def pieces(raw: bytes, size: int = PIECE) -> Iterator[np.ndarray]:
    """A folded text in overlapping pieces: each stretch starts in exactly one."""
    flat = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(flat) - SPAN + 1), size):
        yield flat[at : at + size + SPAN - 1]


def counted(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the share of the document's subwords in each."""
    counts = np.zeros(1 << bits)
    for flat in pieces(folded(text)):
        n = len(flat) - SPAN + 1
        for h in subwords(flat, bits):
            counts += np.bincount(h[:n], minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / counts.sum()).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # 2**bits x languages
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """Averages over all subwords of each text."""
        out = np.zeros((len(texts), len(self.languages)))
        raws = [folded(t) for t in texts]
        size = min(PIECE, max(10_000, CELLS // max(1, len(self.languages))))
        small = [i for i, r in enumerate(raws) if len(r) <= size]
        if small:
            flat = np.frombuffer(b"".join(raws[i] for i in small), np.uint8)
            ends = np.cumsum([len(raws[i]) for i in small])
            starts = np.concatenate([[0], ends[:-1]])
            hashes, n = subwords(flat, self.bits), len(flat) - SPAN + 1
            total = self.scores[hashes[0][:n]]
            for h in hashes[1:]:
                total += self.scores[h[:n]]
            total = np.concatenate([total, np.zeros((SPAN - 1, total.shape[1]), total.dtype)])
            for text_end in ends[:-1]:  # stretches that would run into the next text
                total[text_end - SPAN + 1 : text_end] = 0
            count = np.maximum(1, ends - starts - SPAN + 1)
            out[small] = np.add.reduceat(total, starts, axis=0) / (3 * count)[:, None]
        for i in set(range(len(texts))).difference(small):
            total, n = np.zeros(out.shape[1]), 0
            for flat in pieces(raws[i], size):
                m = len(flat) - SPAN + 1
                total += sum(self.scores[h[:m]].sum(axis=0, dtype=np.float64) for h in subwords(flat, self.bits))
                n += 3 * m
            out[i] = total / n
        return out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The most likely language, its calibrated probability, and whether it is to be rejected."""
        has = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        found, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if has:
            p = self.probabilities(self.logits([texts[i] for i in has]))
            best = p.argmax(axis=1)
            score[has] = p[np.arange(len(has)), best]
            rejected[has] = score[has] < self.threshold
            for i, k in zip(has, best.tolist()):
                found[i] = self.languages[k]
        return found, score, rejected


def train_sgd(rows: list[tuple[str, np.ndarray, np.ndarray]], bits: int, dim: int = 16, epochs: int = 12, batch: int = 64, rate: float = 0.5, gain: float = 100.0, precision: float = 0.995, seed: int = 7) -> LanguageModel:
    """rows: (language, buckets, shares), in a fixed order. `gain` scales the averages, which are small."""
    rng = np.random.default_rng(seed)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros(0), bits)
    y = np.array([languages.index(r[0]) for r in rows])
    held = np.zeros(len(rows), bool)
    for k in range(len(languages)):
        held[np.flatnonzero(y == k)[4::5]] = True
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    weights, bias = rng.normal(0, 0.3, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    own = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(own)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            buckets = np.concatenate([rows[i][1] for i in part])
            shares = np.concatenate([rows[i][2] for i in part]) * np.float32(gain)
            of = np.repeat(np.arange(len(part)), [len(rows[i][1]) for i in part])
            uniq, inv = np.unique(buckets, return_inverse=True)
            bags = np.zeros((len(part), len(uniq)), np.float32)
            bags[of, inv] = shares
            hidden = bags @ emb[uniq]
            z = hidden @ weights + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            delta = z / z.sum(axis=1, keepdims=True)
            delta[np.arange(len(part)), y[part]] -= 1
            delta /= len(part)
            back = delta @ weights.T
            weights -= step * (hidden.T @ delta)
            bias -= step * delta.sum(axis=0)
            emb[uniq] -= step * (bags.T @ back)
    model = LanguageModel(languages, (emb @ weights * gain).astype(np.float32), bias.astype(np.float64), bits)
    check = np.flatnonzero(held) if held.any() else own
    logits = np.array([(model.scores[rows[i][1]] * rows[i][2][:, None]).sum(axis=0) for i in check]) + model.bias

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(logits)[np.arange(len(check)), y[check]], 1e-12)).mean()

    model.temperature = min(np.geomspace(0.2, 20, 60).tolist(), key=loss)
    p = model.probabilities(logits)
    conf, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-conf, kind="stable")
    kept = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
    model.threshold = float(conf[order[kept[-1]]]) if len(kept) else 1.0
    return model


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 3000, bits: int = 14) -> LanguageModel:
    """Fit on at most `sample` labelled documents; what reaches the driver is at most 2**bits pairs for each."""
    rows = docs.select(F.xxhash64(id_col).alias("h"), column(lang_col).alias("lang"), column(text_col).alias("text")).where("lang is not null")
    last = rows.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return train_sgd([], bits)
    near = materialise(rows.where(F.col("h") <= last).withColumn("of", F.xxhash64("text")), "language-sample")
    keys = near.select("h", "lang", "of").distinct().orderBy("h", "lang", "of").limit(sample)  # ids may repeat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, 2):
                kept = [(h, g, *counted(t, bits)) for h, g, t in zip(*(c.to_pylist() for c in part.columns)) if has_letter(t)]
                columns = list(zip(*kept)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32())))], ["h", "lang", "b", "s"])

    once = near.join(F.broadcast(keys), ["h", "lang", "of"], "left_semi").dropDuplicates(["h", "lang", "of"]).select("h", "lang", "text")
    found = map_arrow(once, run, "h long, lang string, b array<int>, s array<float>").toArrow()
    forget(near)
    lists = [np.split(found.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(found.column(c).combine_chunks().value_lengths().to_numpy(zero_copy_only=False))[:-1]) if found.num_rows else [] for c in ("b", "s")]
    order = sorted(range(found.num_rows), key=lambda i, h=found.column("h").to_pylist(), g=found.column("lang").to_pylist(): (h[i], g[i], len(lists[0][i])))
    langs = found.column("lang").to_pylist()
    return train_sgd([(langs[i], lists[0][i], lists[1][i]) for i in order], bits)


def predict_languages(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, lang_pred, score, rejected for docs; keep must not hold columns named like the other three."""
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL("lang_pred string, score double, rejected boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, len(keep), max(10_000, CELLS // max(1, len(model.languages)))):
                found, score, rejected = model.predict(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(*map(column, keep), column(text_col).alias(free_name(docs, "whole"))), run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = remainder("doc_id", 4) == 2
    model = train_languages(docs.where(~out))
    return predict_languages(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
