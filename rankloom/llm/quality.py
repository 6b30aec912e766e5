"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text (shares of kinds of characters, word lengths, repetition, lines, the worst lines) are brought
near normal by logarithms. Each class has its mean and a covariance shrunk towards the pooled one and a scaled identity;
the amount, which grows the fewer rows a class has, is chosen on a held-out fifth of the sample. The Cholesky factors are
inverted once and cached in the model, so a document's two Mahalanobis log-densities are two small matrix products. A
logistic curve fitted on the held-out fifth turns the density difference into the score.

The sample: of the labelled rows of each class for training, those with the `sample` / 2 smallest hashes of their id. Rows
are weighted so that the classes count as they do among all labels. The model is a few hundred numbers. Labels and ids are
never inputs of a score.

Cases: null text is empty; an empty text has the statistics of no words and is scored like any other; null labels and ids
are left out, and of labels that repeat an id with different values the larger counts; rows that repeat an id in the sample
are ranked by their statistics; if all labels are of one class, or there are none, every score is that class's share (0.5
without labels); a score of exactly 0.5 is predicted 1; a very long text is read in pieces, and of its different words and pairs only 64-bit
hashes are kept; rows may repeat; an empty table gives an empty result; other columns are ignored; a null id is never
held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import column, forget, materialise, remainder, table
from rankloom.llm.textbatch import groups_of, map_arrow

PIECE = 1 << 20  # characters cut into words at a time
ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Byte kinds as columns: upper, lower, other letters (multi-byte), digits, space, line end, stops, ! and ?, other marks, pipes."""
    kinds = np.zeros((256, 10))
    b = np.arange(256)
    kinds[(b >= 65) & (b <= 90), 0] = 1
    kinds[(b >= 97) & (b <= 122), 1] = 1
    kinds[(b >= 128), 2] = 1
    kinds[(b >= 48) & (b <= 57), 3] = 1
    kinds[[9, 11, 12, 13, 32], 4] = 1
    kinds[10, 5] = 1
    kinds[[44, 46, 58, 59], 6] = 1
    kinds[[33, 63], 7] = 1
    kinds[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.:;!?|'\"-()"], 8] = 1
    kinds[[124, 62, 60], 9] = 1
    return kinds


KINDS = _classes()


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a text, some at a time; none is cut."""
    rest = ""
    for at in range(0, len(text), PIECE):
        part = rest + text[at : at + PIECE]
        words = part.split()
        rest = words.pop() if at + PIECE < len(text) and words and not part[-1].isspace() else ""
        yield words


class Distinct:
    """How many different 64-bit hashes it has been given, in 8 bytes each and as much again while it sums up."""

    def __init__(self):
        self.known, self.new, self.size = np.empty(0, np.uint64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.new.append(hashes)
        self.size += len(hashes)
        if self.size > max(1 << 16, len(self.known)):
            self._settle()

    def _settle(self) -> None:
        self.known = np.unique(np.concatenate([self.known, *self.new]))
        self.new, self.size = [], 0

    def __len__(self) -> int:
        self._settle()
        return len(self.known)


def line_words(line: str) -> tuple[int, int, int]:
    """How many words a line has, in capitals, and different ones; a long line's words are never all held at once."""
    if len(line) <= PIECE:
        own = line.split()
        return len(own), sum(map(str.isupper, own)), len(set(own))
    count, upper, different = 0, 0, Distinct()
    for own in word_lists(line):
        count, upper = count + len(own), upper + sum(map(str.isupper, own))
        different.add(np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64))
    return count, upper, len(different)


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text."""
    out = np.zeros(18)
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ KINDS
    n = max(1.0, float(hist.sum()))
    words = same = length = long = caps = 0.0
    distinct, pairs = Distinct(), Distinct()
    last: list[str] = []
    for own in word_lists(text):
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        words, length, long = words + len(own), length + sizes.sum(), long + (sizes > 14).sum()
        caps += sum(map(str.isupper, own))
        own = last + own
        hashes = np.fromiter(map(hash, own), np.int64, len(own)).view(np.uint64)
        distinct.add(hashes)
        pairs.add(hashes[:-1] * ODD + hashes[1:])
        same += sum(map(str.__eq__, own, own[1:]))
        last = own[-1:]
    w = max(1.0, words)
    lines = text.split("\n")
    worst = np.zeros(4)
    for line in lines:
        if len(line) >= 24:
            m = len(line)
            count, upper, different = line_words(line)
            marks = sum(line.count(c) for c in "%$#&*|")
            worst = np.maximum(worst, (marks / m, line.count("!") / m, upper / max(1, count), 1 - different / max(1, count) if count > 20 else 0))
    tiny = 1e-3
    out[:10] = np.log(hist / n + tiny)
    out[10] = np.log1p(words)
    out[11] = np.log(length / w + 0.1)
    out[12] = np.log(long / w + tiny)
    out[13] = np.log(1.01 - len(distinct) / w)
    out[14] = np.log(1.01 - len(pairs) / w)
    out[15] = np.log(same / w + tiny)
    out[16] = np.log(caps / w + tiny)
    out[17] = np.log1p(len(lines) / w * 20)
    return np.concatenate([out, np.log(worst + 1e-2)])


@dataclass
class QDA:
    """Class means, inverted Cholesky factors, log-determinants and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    prior: float | None = None  # the constant score if there aren't two classes

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrink: float, shares: tuple[float, float] | None = None) -> QDA:
        """shares: of the classes in the data that x stands for; those of x by default. The fewer rows, the more shrinkage."""
        shares = shares or tuple((y == k).mean() for k in (0, 1))
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - centre) / scale
        dim = z.shape[1]
        pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).mean() for k in (0, 1))
        spread = 0.5 * pooled + 0.5 * np.eye(dim) * max(np.trace(pooled) / dim, 1e-3)
        means, factors, offsets = [], [], []
        for k in (0, 1):
            own = z[y == k]
            s = shrink + (1 - shrink) * dim / (dim + len(own))
            cov = (1 - s) * np.cov(own.T, bias=True) + s * spread
            low = np.linalg.cholesky(cov + 1e-6 * np.eye(dim))
            means.append(own.mean(axis=0))
            factors.append(np.linalg.inv(low))
            offsets.append(np.log(shares[k]) - np.log(np.diag(low)).sum())
        return cls(centre, scale, np.array(means), np.array(factors), np.array(offsets))

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        dens = [self.offsets[k] - 0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.tanh(self.difference(x) / 40) * 40 + self.shift, -35, 35)))


def _calibrated(model: QDA, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[QDA, float]:
    """Fit the logistic curve by Newton steps on weighted rows the discriminant hasn't seen; returns the log loss."""
    d = np.tanh(model.difference(x) / 40) * 40
    design, beta = np.stack([d, np.ones(len(d))], axis=1), np.array([0.5, 0.0])
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        hess = (design * (weights * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, design.T @ (weights * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    model.slope, model.shift = float(max(beta[0], 1e-3)), float(beta[1])
    p = np.clip(model.score(x), 1e-9, 1 - 1e-9)
    return model, float(-(weights * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weights.sum())


def fit_quality(x: np.ndarray, y: np.ndarray, totals: tuple[int, int] | None = None) -> QDA:
    """x in a random order; totals: how many rows of each class it was drawn from, all of them by default.

    Every fifth row of a class is kept for the calibration; of a class with fewer than five rows all serve for both.
    """
    counts = tuple(int((y == k).sum()) for k in (0, 1))
    totals = totals or counts
    if not min(counts):
        none = np.zeros(0)
        return QDA(none, none, none, none, none, prior=0.5 if not len(y) else float(y.mean()))
    shares = tuple(t / sum(totals) for t in totals)
    place = np.empty(len(y), np.int64)
    for k in (0, 1):
        place[y == k] = np.arange(counts[k])
    few = np.array(counts)[y.astype(int)] < 5
    held, own = (place % 5 == 4) | few, (place % 5 != 4) | few
    weights = np.array([s * len(y) / c for s, c in zip(shares, counts)])[y.astype(int)]
    tried = [_calibrated(QDA.fit(x[own], y[own], s, shares), x[held], y[held], weights[held]) for s in (0.01, 0.03, 0.1, 0.3, 0.6)]
    return min(tried, key=lambda t: t[1])[0]


def with_statistics(docs: DataFrame, keep: list[str], text_col: str, result: T.StructField, of: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """keep and one more column, computed by `of` from the statistics of docs' texts; each goes through Python once."""
    names = keep if text_col in keep else [*keep, text_col]
    at, n = names.index(text_col), len(keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups_of(batch, at):
                x = np.array([statistics(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], of(x)], [*keep, result.name])

    return map_arrow(docs.select(*map(column, names)), run, schema)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12_000) -> QDA:
    """Fit on at most sample / 2 labelled documents of each class; the classes' shares are those of all labels."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = materialise(known.withColumn("h", F.xxhash64("id")), "quality-labels")
    totals = {int(r.y): r["count"] for r in known.groupBy("y").count().collect()}

    def first(df: DataFrame, *order: str) -> DataFrame:
        one, two = (df.where(F.col("y") == k).orderBy(*order).limit(max(1, sample // 2)) for k in (0, 1))
        return one.unionByName(two)

    chosen = F.broadcast(first(known, "h", "id"))  # at most `sample` rows
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(chosen, "id").select("h", "y", "text")
    measured = with_statistics(texts, ["h", "y"], "text", T.StructField("x", T.ArrayType(T.DoubleType())), lambda x: pa.array(list(x), pa.list_(pa.float64())))
    measured = materialise(measured, "quality-sample")
    rows = first(measured, "h", "x").toArrow()  # ids may repeat, so their rows are ranked and cut again
    forget(known, measured)
    if not rows.num_rows:
        return fit_quality(np.zeros((0, 1)), np.zeros(0))
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), -1)
    order = np.lexsort((*x.T[::-1], rows.column("h").to_numpy()))
    return fit_quality(x[order], y[order], (totals.get(0, 0), totals.get(1, 0)))


def score_quality(docs: DataFrame, model: QDA, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """keep and score of docs; keep must not hold a column named like the score."""
    return with_statistics(docs, keep, text_col, T.StructField(score_col, T.DoubleType()), lambda x: pa.array(model.score(x)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = remainder("doc_id", 3) == 1
    model = train_quality(docs, labels.where(~out))
    return score_quality(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"]).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
