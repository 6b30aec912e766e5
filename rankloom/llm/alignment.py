"""Alignment of two tokenizers' tokens over one corpus: byte ranges that overlap are links, links are counted by id pair.

A byte-level BPE (A, a tokenizers file) and a piece model (B, a sentencepiece file) cut the same bytes, a space and the
text. Where both end a token a group ends; every pair of tokens whose byte ranges overlap is a link. The counts of id
pairs are dense matrices striped by B's id: stripe s holds the rows of the ids that leave s modulo the number of
stripes, each row a count for every id of A, so a stripe takes about `stripe_cells` cells (64 MB) whatever the corpus.

1. One pass over the texts encodes them and writes three kinds of rows: a row a document, the counts of id pairs of a task,
   summed before they leave it, by stripe, and each block of documents' links by stripe.
2. Counts meet by stripe: np.add.at puts them into the stripe's block, which leaves it without its zeros.
3. Links go where their stripe's counts are: a task takes a few stripes, one after the other, and the links of some blocks
   of documents. It fills the dense block, takes its rows' maxima (a B id's best count) and adds up for each document.
   Counts are copied once for every BLOCKS blocks; a common id meets as many tasks as there are blocks to deal.

Both tokenizers part words at a single space between other characters, so stretches between such spaces are encoded apart
and remembered, up to a bounded number.

Cases: null and empty texts, and those whose tokens of either kind don't spell a space and the text (with U+2581 for
instance), have no tokens: zeros and no groups. Special tokens' strings are plain text. Null ids and ids or rows that
repeat are documents of their own. Ties for the best count are all best. A very long text is a block of its own, in
memory that grows with it. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.bpe import PIECES, byte_letters
from rankloom.llm.packing import packed, spread, unpacked
from rankloom.llm.shared import column, forget, materialise, table
from rankloom.llm.textbatch import groups_of, map_arrow

BLOCKS = 64
REMEMBERED = 600_000
HELD_PAIRS = 3_000_000
WIDE = re.compile("[^\x00-\u024f]")
PIECE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A space and each text (none empty or null) cut before single spaces between other characters: parts, and each text's first.

    Where the neighbour may be another kind of white space there is no cut.
    """
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    starts = at[:-1] - at[0] + np.arange(len(texts))
    flat = np.full(int(at[-1] - at[0]) + len(texts), 32, np.uint8)
    own = np.ones(len(flat), bool)
    own[starts] = False
    flat[own] = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    cut = flat == 32
    cut[starts] = False
    space = np.flatnonzero(cut)
    cut[:] = False
    cut[space[_inked(flat, space, -1) & _inked(flat, space, 1)]] = True
    cut[starts] = True
    begins = np.flatnonzero(cut)
    offsets = np.append(begins, len(flat)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return parts, np.searchsorted(begins, starts)


def _inked(flat: np.ndarray, space: np.ndarray, way: int) -> np.ndarray:
    """Whether the character next to each space certainly is no white space."""
    near, mid, far = (np.where((i := space + way * k) < len(flat), flat[np.minimum(i, len(flat) - 1)], 32) for k in (1, 2, 3))
    first, second, third = (near, mid, far) if way > 0 else (far, mid, near)
    lead, last = (near, mid) if way > 0 else (mid, near)
    odd = (near <= 32) | ((lead == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((first == 0xE1) & (second == 0x9A))
    return ~(odd | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80) & (third == 0x80)))


class Aligner:
    """Aligned stretches: for each remembered one its numbers of tokens and groups, its groups as text, and its linked id pairs."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {c: b for b, c in byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.n_a, self.n_b = 1 + max(vocab.values()), self.b.get_piece_size()
        a_bytes = [b""] * self.n_a
        for token, i in vocab.items():
            a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that cross a space can't be aligned stretch by stretch")
        b_bytes = [bytes([int(m[1], 16)]) if (m := PIECE_BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.bytes_of = a_bytes, b_bytes
        self.sizes = tuple(np.array([len(t) for t in own], np.int64) for own in self.bytes_of)
        self.spelled = tuple(np.frombuffer(b"".join(own), np.uint8) for own in self.bytes_of)
        self.spell_at = tuple(np.cumsum(n) - n for n in self.sizes)
        self.fast = self._fast(json.loads(self.a.to_str()), of)
        #: Ids as they stand in the text of groups: A within and last in a group, then B.
        self.names = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]
        self.forget()

    def _fast(self, spec: dict, of: dict[str, int]) -> Callable[[str], list[int]] | None:
        """A quicker encoder of the same vocabulary, where ids rise as merges go and the file cuts words as PIECES does; for narrow characters."""
        model, cut, special = spec["model"], spec.get("pre_tokenizer") or {}, {t["content"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        made = [model["vocab"].get(a + b, -1) for a, b in merges]
        rising = len(made) > 0 and all(x < y for x, y in zip(made, made[1:])) and len(model["vocab"].keys() - special) - len(made) == 256
        if not (rising and spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]):
            return None
        import tiktoken

        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("a", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.counts = [np.zeros((0, 4), np.int64)]  # tokens of A and B, groups, links; minus one if the bytes differ
        self.pairs = [np.zeros(0, np.int64)]  # a * n_b + b

    def places(self, parts: list[bytes]) -> np.ndarray:
        """The number of each of these different stretches among the remembered ones, encoded where they are new."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = parts
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def _a_ids(self, strings: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        odd = [i for i, s in enumerate(strings) if WIDE.search(s)]
        ids = [() if WIDE.search(s) else self.fast(s) for s in strings] if odd else list(map(self.fast, strings))
        for i, e in zip(odd, self.a.encode_batch_fast([strings[i] for i in odd], add_special_tokens=False)):
            ids[i] = e.ids
        return ids

    def _learn(self, parts: list[bytes]) -> None:
        strings = [p.decode() for p in parts]
        ids = self._a_ids(strings), self.b.encode([s[1:] for s in strings], num_threads=1)
        size, text = np.fromiter(map(len, parts), np.int64, len(parts)), np.frombuffer(b"".join(parts), np.uint8)
        begin, good = np.cumsum(size) - size, np.ones(len(parts), bool)
        counts, flat, owner = np.zeros((len(parts), 4), np.int64), [], []
        for side, own in enumerate(ids):
            counts[:, side] = n = np.fromiter(map(len, own), np.int64, len(parts))
            flat.append(np.fromiter(itertools.chain.from_iterable(own), np.int64, int(n.sum())))
            owner.append(np.repeat(np.arange(len(parts)), n))
            good &= np.bincount(owner[side], self.sizes[side][flat[side]], len(parts)).astype(np.int64) == size
        for side in (0, 1):  # where the lengths agree, do the bytes?
            mine = flat[side][good[owner[side]]]
            spelled = self.spelled[side][spread(self.spell_at[side][mine], self.sizes[side][mine])]
            wrong = spelled != text[spread(begin[good], size[good])]
            if wrong.any():
                good[np.repeat(np.flatnonzero(good), size[good])[wrong]] = False
        kept = good.nonzero()[0]
        for p in parts:
            self.known[p] = len(self.known)
        texts = [""] * len(parts)
        if len(kept):
            flat, owner = [f[good[o]] for f, o in zip(flat, owner)], [o[good[o]] for o in owner]
            ends = [np.cumsum(t[f]) for t, f in zip(self.sizes, flat)]
            every = np.union1d(*ends)
            at = [np.searchsorted(e, every) for e in ends]
            both = (ends[0][at[0]] == every) & (ends[1][at[1]] == every)
            self.pairs.append(flat[0][at[0]] * self.n_b + flat[1][at[1]])
            link_owner = owner[0][at[0]]
            counts[:, 2] = np.bincount(link_owner[both], minlength=len(parts))
            counts[:, 3] = np.bincount(link_owner, minlength=len(parts))
            shut = every[both]  # where groups end
            group = [np.searchsorted(shut, e) for e in ends]
            named = [f + (shut[g] == e) * n for f, g, e, n in zip(flat, group, ends, (self.n_a, self.n_b))]
            order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
            named = list(map(self.names.__getitem__, np.concatenate([named[0], 2 * self.n_a + named[1]])[order].tolist()))
            upto = np.cumsum(counts[kept, 0] + counts[kept, 1]).tolist()
            for i, lo, hi in zip(kept.tolist(), [0, *upto], upto):
                texts[i] = "".join(named[lo:hi])
        counts[~good] = -1
        self.texts += texts
        self.counts.append(counts)

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of all remembered stretches, where each one's pairs start, and all pairs."""
        self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
        links = np.maximum(self.counts[0][:, 3], 0)
        return self.counts[0], np.cumsum(links) - links, self.pairs[0]


@functools.lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's Aligner: what it remembers serves the worker's next tasks too."""
    return Aligner(a_path, b_path)


def _packed_counts(pairs: np.ndarray, n: np.ndarray, n_b: int, stripes: int) -> bytes:
    return packed(pairs // n_b, pairs % n_b // stripes, n & 0xFFFFFFFF, n >> 32)


class Stripes:
    """How B's ids are dealt to dense blocks of rows of A's ids."""

    def __init__(self, n_a: int, n_b: int, cells: int):
        self.n_a, self.n_b = n_a, n_b
        self.n = min(n_b, max(1, -(-n_b * n_a // max(cells, n_a))))
        self.rows = -(-n_b // self.n)

    def cut(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of pairs by stripe, and the stripe of each in that order."""
        stripe = pairs % self.n_b % self.n
        order = np.argsort(stripe, kind="stable")
        return order, stripe[order]

    def add(self, block: np.ndarray, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Add counts to a stripe's block; the rows and columns they are in."""
        a, row, low, high = unpacked(payload)
        np.add.at(block, (row, a), low + (high << 32))
        return row, a


def _encoded(docs: DataFrame, a_path: str, b_path: str, stripes: Stripes, groups: str) -> DataFrame:
    """The three kinds of rows of the first pass. Blocks are numbered by partition: the rows must be written once and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, id_type = _aligner(a_path, b_path), pa.null()
        block, held = TaskContext.get().partitionId() << 32, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            id_type = batch.schema.field(0).type
            for own in groups_of(batch, 1):
                rows, pairs, n, links = _block(aligner, own, stripes, groups)
                yield _rows("doc", own.num_rows, id_type, block=np.full(own.num_rows, block), at=np.arange(own.num_rows), id=own.column(0), **rows)
                if links:
                    stripe, payload = zip(*links)
                    yield _rows("links", len(links), id_type, block=np.full(len(links), block), stripe=stripe, payload=payload)
                held = _summed(np.concatenate([held[0], pairs]), np.concatenate([held[1], n]))
                if len(held[0]) > HELD_PAIRS:
                    yield from _count_rows(*held, stripes, id_type)
                    held = held[0][:0], held[1][:0]
                block += 1
        yield from _count_rows(*held, stripes, id_type)

    id_type, numbers = docs.schema["id"].dataType.simpleString(), ", ".join(f"{c} long" for c in NUMBERS)
    return map_arrow(docs, run, f"kind string, block long, at long, id {id_type}, {numbers}, groups string, stripe int, payload binary")


def _rows(kind: str, n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
    given = {"kind": [kind] * n, **columns}
    plain = {"kind": pa.string(), "block": pa.int64(), "at": pa.int64(), "id": id_type, **dict.fromkeys(NUMBERS, pa.int64()), "groups": pa.string(), "stripe": pa.int32(), "payload": pa.binary()}
    arrays = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in plain.items()]
    return pa.RecordBatch.from_arrays(arrays, list(plain))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count_rows(pairs: np.ndarray, n: np.ndarray, stripes: Stripes, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    order, stripe = stripes.cut(pairs)
    own, first = np.unique(stripe, return_index=True)
    if len(own):
        payload = [_packed_counts(pairs[i], n[i], stripes.n_b, stripes.n) for i in np.split(order, first[1:])]
        yield _rows("counts", len(own), id_type, stripe=own, payload=payload)


def _block(aligner: Aligner, docs: pa.RecordBatch, stripes: Stripes, groups: str) -> tuple[dict, np.ndarray, np.ndarray, list]:
    """Columns of the documents, their id pairs with counts, and (stripe, links)."""
    texts = docs.column(1)
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    used = np.flatnonzero(sizes > 0)
    out = {c: np.zeros(docs.num_rows, np.int64) for c in NUMBERS}
    named = [""] * docs.num_rows
    none = np.zeros(0, np.int64)
    if not len(used):
        return out | {"groups": named}, none, none, []
    parts, first = stretches(texts.take(pa.array(used)))
    coded = parts.dictionary_encode()
    place = aligner.places(coded.dictionary.to_pylist())
    counts, pair_at, pairs = aligner.held()
    word = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(used)), np.diff(np.append(first, len(word))))
    of_word = place[word]
    good = np.logical_and.reduceat(counts[of_word, 0] >= 0, first)
    for k, c in enumerate(NUMBERS):
        out[c][used[good]] = np.add.reduceat(counts[of_word, k], first)[good]
    said, ends = of_word.tolist(), [*first[1:].tolist(), len(word)]
    for i, (lo, hi) in enumerate(zip(first.tolist(), ends)):
        if good[i]:
            text = "".join(map(aligner.texts.__getitem__, said[lo:hi]))[:-1]
            named[used[i]] = hashlib.sha256(text.encode()).hexdigest() if groups == "digest" else text
    kept = good[doc]
    seen, times = np.unique(doc[kept] * len(place) + word[kept], return_counts=True)
    if not len(seen):
        return out | {"groups": named}, none, none, []
    # Pairs of the block's stretches, ordered by stripe, and each document's links to them
    links = np.maximum(counts[place, 3], 0)
    mine = pairs[spread(pair_at[place], links)]
    own, which = np.unique(mine, return_inverse=True)
    order, stripe = stripes.cut(own)
    own, rank = own[order], np.argsort(order)[which]
    start = np.cumsum(links) - links
    seen_word, seen_doc = seen % len(place), seen // len(place)
    n = links[seen_word]
    key, times = _summed(rank[spread(start[seen_word], n)] * len(used) + np.repeat(seen_doc, n), np.repeat(times, n))
    pair, who = key // len(used), used[key % len(used)]
    totals = np.zeros(len(own), np.int64)
    np.add.at(totals, pair, times)
    met = totals > 0  # a stretch of a document without tokens may be the only one that has a pair
    found = []
    bounds = np.searchsorted(stripe, np.arange(stripes.n + 1))
    entry = np.searchsorted(pair, bounds)
    for s in np.flatnonzero(np.diff(entry)).tolist():
        lo, hi = entry[s], entry[s + 1]
        here, at, size = np.unique(pair[lo:hi], return_index=True, return_counts=True)
        gap = np.diff(who[lo:hi], prepend=0)
        gap[at] = who[lo:hi][at]
        found.append((s, packed(own[here] // stripes.n_b, own[here] % stripes.n_b // stripes.n, size, gap, np.minimum(times[lo:hi], 0xFFFFFFFF))))
    return out | {"groups": named}, own[met], totals[met], found


def _counted(rows: DataFrame, stripes: Stripes) -> DataFrame:
    """A row a stripe: its counts without zeros, summed in a dense block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = np.zeros((stripes.rows, stripes.n_a), np.int64), None

        def done() -> pa.RecordBatch:
            row, a = np.nonzero(block)
            n = block[row, a]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(a, row, n & 0xFFFFFFFF, n >> 32)], pa.binary())], ["stripe", "payload"])

        for batch in batches:
            for stripe, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stripe != at:
                    if at is not None:
                        yield done()
                        block[:] = 0
                    at = stripe
                stripes.add(block, payload)
        if at is not None:
            yield done()

    tasks = min(stripes.n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("stripe", "payload").repartition(tasks, "stripe").sortWithinPartitions("stripe")
    return map_arrow(dealt, run, "stripe int, payload binary")


def _scored(links: DataFrame, counts: DataFrame, stripes: Stripes, subs: int, teams: int) -> DataFrame:
    """block, at, n_best, count_sum: several rows a document, one for each team of stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = np.zeros((stripes.rows, stripes.n_a), np.int64), np.zeros(stripes.rows, np.int64)
        at, key, found, full = None, None, {}, (np.zeros(0, np.int64),) * 2

        def done() -> Iterator[pa.RecordBatch]:
            for b, (n_best, total) in found.items():
                own = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b)), pa.array(own), pa.array(n_best[own]), pa.array(total[own])], ["block", "at", "n_best", "count_sum"])

        for batch in batches:
            for team, sub, stripe, b, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if (team, sub) != key:
                    yield from done()
                    key, at, found = (team, sub), None, {}
                if stripe != at:
                    block[full], best[:], at = 0, 0, stripe
                if b < 0:
                    full = stripes.add(block, payload)
                    np.maximum.at(best, full[0], block[full])  # the rows' maxima: other cells are zero
                    continue
                a, row, size, gap, times = unpacked(payload)
                n = block[row, a]
                first = np.cumsum(size) - size
                who = np.cumsum(gap)
                who -= np.repeat(who[first] - gap[first], size)
                if b not in found or len(found[b][0]) <= who.max():
                    old = found.get(b, (np.zeros(0, np.int64),) * 2)
                    found[b] = tuple(np.concatenate([x, np.zeros(int(who.max()) + 1 - len(x), np.int64)]) for x in old)
                np.add.at(found[b][0], who, np.repeat(n == best[row], size) * times)
                np.add.at(found[b][1], who, np.repeat(n, size) * times)
        yield from done()

    team = F.pmod("stripe", F.lit(teams)).alias("team")
    own = links.select(team, F.pmod(F.xxhash64("block"), F.lit(subs)).cast("int").alias("sub"), "stripe", "block", "payload")
    copies = counts.select(team, F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub"), "stripe", F.lit(-1).cast("long").alias("block"), "payload")
    dealt = own.unionByName(copies).repartition(teams * subs, "team", "sub").sortWithinPartitions("team", "sub", "stripe", "block")
    return map_arrow(dealt, run, "block long, at long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text", stripe_cells: int = 8_000_000, teams: int = 8) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (as text, or its SHA-256 with groups="digest"), n_best, count_sum."""
    given = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    sides = _aligner(a_path, b_path)
    stripes = Stripes(sides.n_a, sides.n_b, stripe_cells)
    rows = materialise(_encoded(given, a_path, b_path, stripes, groups), "align")
    blocks = rows.where("kind = 'links'").agg(F.count_distinct("block")).first()[0]
    counts = materialise(_counted(rows.where("kind = 'counts'"), stripes), "align-counts")
    scored = _scored(rows.where("kind = 'links'").select("block", "stripe", "payload"), counts, stripes, max(1, -(-blocks // BLOCKS)), teams)
    sums = scored.groupBy("block", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    own = rows.where("kind = 'doc'").select("block", "at", F.col("id").alias("doc_id"), *NUMBERS, "groups")
    return own.join(sums, ["block", "at"], "left").select("doc_id", *NUMBERS, "groups", zero("n_best"), zero("count_sum"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripe_cells: int = 8_000_000) -> DataFrame:
    """a_id, b_id, count, best: every linked pair of ids, how many links hold it, and whether no pair of its B id has more."""
    sides = _aligner(a_path, b_path)
    stripes = Stripes(sides.n_a, sides.n_b, stripe_cells)
    rows = materialise(_encoded(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), a_path, b_path, stripes, "digest"), "align")
    counts = materialise(_counted(rows.where("kind = 'counts'"), stripes), "align-counts")
    forget(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, row, low, high = unpacked(payload)
                n, best = low + (high << 32), np.zeros(stripes.rows, np.int64)
                np.maximum.at(best, row, n)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(row * stripes.n + stripe), pa.array(n), pa.array(n == best[row])], ["a_id", "b_id", "count", "best"])

    return map_arrow(counts, run, "a_id long, b_id long, count long, best boolean")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups="digest")
    return found.withColumnRenamed("groups", "groups_sha256").withColumn("doc_id", F.col("doc_id").cast("long"))
