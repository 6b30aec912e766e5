"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give them away.

The base patterns (e-mail and IP addresses, card and phone numbers) find the protected entities. Corpus co-occurrence then
estimates how strongly the words around them reveal them. For an entity e and a term t within `window` (120) characters of a
mention, with df counted over the whole corpus,

    PMI(e; t) = log2(N df(e, t) / (df(e) df(t)))      IC(e) = log2(N / df(e))

and PMI / IC is the share of the entity's information that the term discloses: 1 if t never occurs without e, 0 if they are
independent. N and every df count documents, copies included. Pairs in fewer than `support` different surroundings are no
evidence, so that copies of one text are one observation there. Terms that disclose `generalise` or more are spans of kind
`term` wherever they occur in a document that mentions the entity (sanitise() puts a general word for them); those that
disclose `remove` or more are removed.

The patterns are matched in linear time, whatever the text: each start is tried once and no run is scanned twice.
Candidate terms have `least` (2) letters or more; they are counted over all documents through a bitmap, sized by the terms, that a
word must hit; chance hits fall out in the exact join. Without pairs that have the support there is nothing to count and that pass is left out. Pairs of an
entity and a term are handed on entity by entity, so that a text of addresses alone needs no memory for all of its pairs.

Cases: null text is empty; an empty text has no spans; very long texts are read whole; null ids are rows like others; rows
that repeat an id and a text get the same spans; spans that start alike are ordered by their ends; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.shared import KeyFilter, column, forget, materialise, skewed_lookup, table
from rankloom.llm.textbatch import groups_of, map_arrow

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]++")
LEAST = 2  # letters of a candidate term
SALTS = 16
LETTER = re.compile(r"[^\W\d_]")
NOT_DIGIT = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the local part is the run before an @ back to the last match."""
    end = 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield m.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    return [list(find(text)) for find in FINDERS]


class Spans:
    """Base spans of a text, for telling whether a stretch overlaps one."""

    def __init__(self, found: list[list[tuple[int, int]]]):
        taken = sorted(s for spans in found for s in spans)
        self.starts = np.array([s for s, _ in taken])
        self.ends = np.maximum.accumulate([e for _, e in taken]) if taken else self.starts

    def overlap(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end, "left")) - 1
        return k >= 0 and bool(self.ends[k] > start)


def near_terms(text: str, start: int, end: int, window: int, spans: Spans, least: int = LEAST) -> list[str]:
    """The terms of `least` letters or more that stand wholly within `window` characters of a mention, outside of all base spans."""
    a, b = max(0, start - window), min(len(text), end + window)
    begun, cut = a > 0 and LETTER.match(text, a - 1), b < len(text) and LETTER.match(text, b)
    return [
        m.group().lower() for m in TERM.finditer(text, a, b)
        if m.end() - m.start() >= least and not (cut and m.end() == b) and not (begun and m.start() == a) and not spans.overlap(m.start(), m.end())
    ]


def surroundings(text: str, found: list[list[tuple[int, int]]], window: int, most: int = 100_000, least: int = LEAST) -> Iterator[tuple[int, str | None, int, bool]]:
    """(entity, term, surroundings, first) for each entity and the terms near its mentions; first: not seen with it before.

    An entity comes with the term None once. Surroundings may be named again when an entity has more than `most`.
    """
    mentions: dict[int, list[tuple[int, int]]] = {}
    spans = Spans(found)
    for kind, own in enumerate(found):
        for start, end in own:
            value = text[start:end].lower() if kind < 2 else NOT_DIGIT.sub("", text[start:end])
            mentions.setdefault(hashed(f"{kind}:{value}"), []).append((start, end))
    for entity, places in mentions.items():
        yield entity, None, 0, True
        terms, seen = set(), set()
        for start, end in places:
            near = near_terms(text, start, end, window, spans, least)
            around = hashed(" ".join(near))
            for t in near:
                if (t, around) not in seen:
                    yield entity, t, around, t not in terms
                    terms.add(t)
                    seen.add((t, around))
            if len(seen) > most:
                seen.clear()


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def distinct_terms(text: str) -> set[str]:
    """The lower-cased terms of a whole text."""
    low = text.lower()
    if len(low) == len(text):
        return {*TERM.findall(low)}
    return {w.lower() for w in {*TERM.findall(text)}}  # a letter that grows when lower-cased would split its word


def places(text: str, terms: list[str]) -> list[tuple[str, int, int]]:
    """(term, start, end) wherever one of the terms stands in the text: one pass, however many terms there are."""
    wanted, low = set(terms), text.lower()
    if len(low) == len(text):
        return [(t, *m.span()) for m in TERM.finditer(low) if (t := m.group()) in wanted]
    return [(t, *m.span()) for m in TERM.finditer(text) if (t := m.group().lower()) in wanted]


def joined(kind: str, spans: list[tuple[int, int]]) -> list[str]:
    return [f"{kind}:{s}:{e}" for s, e in spans]


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text."""
    return F.xxhash64(column(id_col).isNull(), column(id_col), F.coalesce(column(text_col), F.lit("")))


def find_base(docs: DataFrame, id_col: str, text_col: str, window: int, least: int = LEAST, step: int = 50_000) -> DataFrame:
    """Rows of two kinds: of documents (doc_id, row, n_<kind>, base; e is null) and of what they mention (row, e, t, w, first)."""
    base = docs.select(column(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    schema = T.StructType([base.schema["doc_id"], *T.StructType.fromDDL(f"row long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, e long, t string, w long, first boolean")])
    kinds = (pa.int64(),) * 5 + (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_id = batch.schema.field(0).type

            def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

            for part in groups_of(batch, 2):
                rows, pairs = [], []
                for key, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found = base_spans(text)
                    spans = ",".join(x for k, s in zip(KINDS, found) for x in joined(k, s))
                    rows.append((key, *map(len, found), spans, None, None, None, None))
                    for pair in surroundings(text, found, window, least=least) if spans else ():
                        pairs.append((key, None, None, None, None, None, *pair))
                        if len(pairs) == step:
                            yield packed(pa.nulls(step, of_id), pairs)
                            pairs = []
                yield packed(part.column(0), rows)
                if pairs:
                    yield packed(pa.nulls(len(pairs), of_id), pairs)

    return map_arrow(base, run, schema)


def bitmap_of(terms: DataFrame) -> bytes:
    """Eight bits a term or more, 2**15 at least and 2**27 (16 MB) at most, packed, of which those that the terms hash to are set."""
    bits = max(15, min(27, (8 * terms.count()).bit_length()))
    hit = np.zeros(1 << bits, bool)
    hit[terms.select(F.pmod(F.xxhash64("t"), F.lit(1 << bits)).alias("b")).distinct().toArrow().column("b").to_numpy()] = True
    return np.packbits(hit).tobytes()


class TermFilter:
    """Whether a term may be among those of a bitmap."""

    def __init__(self, packed: bytes):
        self.bit = np.unpackbits(np.frombuffer(packed, np.uint8))
        self.low = len(self.bit) - 1

    def has(self, term: str) -> bool:
        return bool(self.bit[xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), 42) & self.low])


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str, flush: int = 100_000) -> DataFrame:
    """t, df_t: in how many documents each of the terms occurs.

    Tasks sum up their documents and hand on a row per term, or per `flush` terms at a time.
    """
    packed = bitmap_of(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = TermFilter(packed), Counter()

        def partial() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n"])

        for batch in batches:
            for part in groups_of(batch, 0):
                for text in part.column(0).to_pylist():
                    counts.update(t for t in distinct_terms(text) if known.has(t))
                if len(counts) > flush:
                    yield partial()
                    counts.clear()
        yield partial()

    words = map_arrow(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), run, "t string, n long")
    return words.groupBy("t").agg(F.sum("n").alias("df_t")).join(terms, "t")


def occurrences(docs: DataFrame, mentions: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, t, s, f: where the terms stand, outside of base spans, in documents that mentions(row) has; chance hits included."""
    packed = bitmap_of(terms)
    base = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    some = KeyFilter(mentions, "row").marked(base, F.col("row"), "hit").where("hit").select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermFilter(packed)
        for batch in batches:
            for part in groups_of(batch, 1):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    terms = [t for t in distinct_terms(text) if known.has(t)]
                    if not terms:
                        continue
                    spans = Spans(base_spans(text))
                    found = [x for x in places(text, terms) if not spans.overlap(*x[1:])]
                    if found:
                        ts, starts, ends = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(ts), pa.int64()), pa.array(ts, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["row", "t", "s", "f"])

    return map_arrow(some, run, "row long, t string, s long, f long").distinct()


def disclosing(found: DataFrame, docs: DataFrame, text_col: str, total: int, support: int, generalise: float) -> DataFrame | None:
    """e, t, share of the pairs whose term discloses `generalise` of its entity or more, and df_t."""
    near = found.where("t is not null")
    pairs = near.groupBy("e", "t").agg(F.countDistinct("w").alias("seen"), F.sum(F.col("first").cast("long")).alias("df_et")).where(F.col("seen") >= support)
    pairs = materialise(pairs.drop("seen"), "pii-pairs")
    held = pairs.count()
    if not held:
        return None
    per = lambda key: pairs.groupBy(key).agg(F.count("*").alias("pairs"))
    df_t = materialise(term_counts(docs, per("t"), text_col), "pii-df")  # read twice below
    df_e = found.where("e is not null and t is null").groupBy("e").agg(F.count("*").alias("df_e")).join(per("e"), "e")
    measured = skewed_lookup(pairs, df_e, ["e"], "pairs", held).drop("pairs")
    measured = skewed_lookup(measured, df_t, ["t"], "pairs", held).drop("pairs")
    n = F.lit(float(total))
    ic, pmi = F.log2(n / F.col("df_e")), F.log2(n * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    told = measured.withColumn("share", F.when(ic > 0, pmi / ic).otherwise(0.0)).where(F.col("share") >= generalise)
    told = materialise(told.select("e", "t", "share", "df_e", "df_t"), "pii-told")
    forget(pairs, df_t)
    return told


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 120, support: int = 3, generalise: float = 0.8, remove: float = 0.95, least: int = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end, comma-joined), terms (of `least` letters or more) and removed (likewise).

    Starts and ends are code points, ends exclusive; removed are the spans among terms that are to go altogether.
    """
    found = materialise(find_base(docs, id_col, text_col, window, least), "pii-base")
    out = found.where("e is null").select("doc_id", "row", *(f"n_{k}" for k in KINDS), "base")
    none = F.lit("").alias("terms"), F.lit("").alias("removed")
    total = out.count()
    told = disclosing(found, docs, text_col, total, support, generalise)
    if told is None:
        return out.select(*(c for c in out.columns if c != "row"), *none)
    mentions = found.where("e is not null and t is null").select("row", "e")
    per_e = told.groupBy("e").agg(F.max("df_e").alias("rows"))
    mentions = materialise(skewed_lookup(mentions, per_e, ["e"], "rows", total).select("row", "e").distinct(), "pii-mentions")
    places = materialise(occurrences(docs, mentions, told.select("t").distinct(), id_col, text_col), "pii-places")
    # Which terms disclose in which document: an entity that very many mention meets SALTS tasks, with its terms in each
    salted = told.select("e", "t", "share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told_in = mentions.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["e", "salt"])
    told_in = told_in.groupBy("row", "t").agg(F.max("share").alias("share"))
    spans = places.join(told_in, ["row", "t"]).groupBy("row", "s", "f").agg(F.max(F.col("share") >= remove).alias("gone"))
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "f", "gone"))).alias("x"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("term:"), x.s.cast("string"), F.lit(":"), x.f.cast("string"))), ",")
    spans = spans.select("row", text(F.col("x")).alias("terms"), text(F.filter("x", lambda x: x.gone)).alias("removed"))
    spans = materialise(spans, "pii-spans")
    marked = KeyFilter(spans, "row").marked(out, F.col("row"), "hit")  # only documents that may have terms are shuffled
    hit, rest = marked.where("hit").drop("hit"), marked.where("not hit").drop("hit")
    sized = hit.groupBy("row").agg(F.count("*").alias("times")).join(spans, "row")
    met = skewed_lookup(hit, sized, ["row"], "times", total, "left").drop("times")
    return met.na.fill("", ["terms", "removed"]).unionByName(rest.select("*", *none)).drop("row")


def sanitise(text: str | None, spans: str, removed: str = "") -> str:
    """The text with every span replaced by a general word for its kind, and the removed ones left out."""
    gone, parts, at = {*filter(None, removed.split(","))}, [], 0
    for start, end, kind, span in sorted((int(s), int(e), k, f"{k}:{s}:{e}") for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            parts += [(text or "")[at:start], "" if span in gone else f"[{kind}]"]
            at = end
    return "".join([*parts, (text or "")[at:]])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return found.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", some("base"), some("terms")).alias("spans"),
    )
