"""Byte-level BPE encoding and decoding from a public vocabulary file; its path is a parameter.

A segment tree stands over the ranks of adjacent symbol pairs. Its root holds the least (rank, position), so it yields the
leftmost of the lowest-ranked merges. A merge changes at most three leaves (the pair itself, the one before and the one
that is swallowed), each updated up to the root in logarithmic time, until no mergeable pair remains. Pieces of up to
SHORT bytes go through the same trees many at a time as numpy rows; longer pieces through one tree each.

Merging never crosses the pre-tokenizer's pieces, so equal stretches between single spaces encode alike: each Python
worker remembers up to twice MEMO of them. Decoding joins the tokens' bytes; bytes that are no UTF-8 become U+FFFD.

Cases: null text is the empty text with no tokens; special tokens in a text are their own ids; very long texts are cut
at single spaces between words, where no piece crosses; rows may repeat; an empty table gives an empty result; other
columns are ignored (encode_column can carry some along).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.shared import table
from rankloom.llm.textbatch import groups_of, map_arrow

SHORT = 64
MEMO = 200_000
ENDS = frozenset(".,;:!?")
STRETCH = 1 << 20
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
GAP = re.compile(r"(?<=\S) (?=\S)")
NONE = np.int32((1 << 31) - 1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank_of = {}
        for rank, (a, b) in enumerate(merges):
            self.rank_of.setdefault((vocab[a] << 32) | vocab[b], rank)
        self._hash_pairs()
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Packed ids of stretches, and of words with a space before them: (young, old); the old go when the young are many.
        self.memos: list[tuple[dict[str, bytes], dict[str, bytes]]] = [({}, {}), ({}, {})]
        n = 1 + max(self.bytes_of)
        self.token_size = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int32)
        self.token_at = (np.cumsum(self.token_size) - self.token_size).astype(np.int32)
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def _hash_pairs(self) -> None:
        """Two tables in which each pair has one of two places (cuckoo hashing), so that numpy looks up many at once."""
        bits = max(4, (4 * len(self.rank_of)).bit_length())
        self.shift = np.uint64(64 - bits)
        for seed in range(1, 100):
            self.factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64) | 1), np.uint64((0xC2B2AE3D27D4EB4F * (2 * seed + 1)) % (1 << 64) | 1)]
            keys = [dict(), dict()]
            for pair in self.rank_of:
                side = 0
                for _ in range(200):
                    place = int((pair * int(self.factors[side]) % (1 << 64)) >> int(self.shift))
                    pair, keys[side][place] = keys[side].get(place), pair
                    if pair is None:
                        break
                    side ^= 1
                if pair is not None:
                    break
            else:
                break
        self.tables = []
        for held in keys:
            own, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            at = np.fromiter(held, np.int64, len(held))
            own[at] = np.fromiter(held.values(), np.int64, len(held))
            rank[at] = [self.rank_of[p] for p in held.values()]
            self.tables.append((own, rank))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), NONE for those that never merge."""
        key = (a.astype(np.int64) << 32) | b
        found = None
        for factor, (own, rank) in zip(self.factors, self.tables):
            at = (key.view(np.uint64) * factor) >> self.shift
            here = np.where(own[at] == key, rank[at], NONE)
            found = here if found is None else np.minimum(found, here)
        return found

    def merge_many(self, pieces: list[bytes], slots: int) -> list[bytes]:
        """Pieces of at most `slots` bytes, a power of two: one tree a row, all rows in flat arrays. Ids as packed int32."""
        n, lens, high = len(pieces), np.fromiter(map(len, pieces), np.int32, len(pieces)), slots.bit_length() - 1
        sym = self.byte_ids[np.frombuffer(b"".join([p.ljust(slots, b"\0") for p in pieces]), np.uint8)]
        pos = np.tile(np.arange(slots, dtype=np.int32), n)
        nxt, prv, end = pos + 1, pos - 1, np.repeat(lens, slots)
        alive = pos < end
        tree = np.full((n, 2 * slots), NONE, np.int32)
        rank = self._rank(sym[:-1], sym[1:])
        leaves = np.full(n * slots, NONE, np.int32)
        leaves[:-1] = np.where((nxt[:-1] < end[:-1]) & (rank != NONE), (rank << high) | pos[:-1], NONE)
        tree[:, slots:] = leaves.reshape(n, slots)
        width = slots
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        tree = tree.reshape(-1)
        rows = np.flatnonzero(tree[1 :: 2 * slots] != NONE)
        while len(rows):
            base, top, size = rows * slots, rows * (2 * slots), lens[rows]
            root = tree[top + 1]
            at = root & (slots - 1)
            here = base + at
            merged = self.merged[root >> high]
            sym[here] = merged
            gone = nxt[here]
            alive[base + gone] = False
            after = nxt[base + gone]
            nxt[here] = after
            more = after < size
            right = base + np.where(more, after, at)
            prv[right] = np.where(more, at, prv[right])
            before = prv[here]
            some = before >= 0
            left = np.where(some, before, at)
            r = self._rank(np.concatenate([merged, sym[base + left]]), np.concatenate([sym[right], merged]))
            r1, r2 = r[: len(rows)], r[len(rows) :]
            tree[top + slots + gone] = NONE
            tree[top + slots + at] = np.where(more & (r1 != NONE), (r1 << high) | at, NONE)
            old = tree[top + slots + left]
            tree[top + slots + left] = np.where(some, np.where(r2 != NONE, (r2 << high) | left, NONE), old)
            node, over = np.concatenate([at, gone, left]) + slots, np.concatenate([top, top, top])
            for _ in range(high):
                node >>= 1
                low = over + 2 * node
                tree[over + node] = np.minimum(tree[low], tree[low + 1])
            rows = rows[tree[top + 1] != NONE]
        flat = sym[alive].tobytes()
        cuts = np.concatenate([[0], 4 * np.cumsum(alive.reshape(n, slots).sum(axis=1))]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, piece: bytes) -> bytes:
        """A piece of any length: one tree in flat arrays, built in numpy, about 50 bytes for each of the piece's."""
        n, rank_of, merged, none = len(piece), self.rank_of, self.merged, 1 << 60
        high = max(1, n - 1).bit_length()
        slots = 1 << high
        first = self.byte_ids[np.frombuffer(piece, np.uint8)]
        levels = [np.full(slots, none, np.int64)]
        rank = self._rank(first[:-1], first[1:]).astype(np.int64)
        levels[0][: n - 1] = np.where(rank != NONE, (rank << high) | np.arange(n - 1), none)
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([[none], *reversed(levels)]).tobytes())
        del levels, rank
        sym, nxt, prv = (array("i", x.astype(np.int32).tobytes()) for x in (first, np.arange(1, n + 1), np.arange(-1, n - 1)))

        def put(i: int, j: int) -> None:
            r = rank_of.get((sym[i] << 32) | sym[j]) if j < n else None
            set_leaf(i, none if r is None else (r << high) | i)

        def set_leaf(i: int, value: int) -> None:
            node = slots + i
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while (root := tree[1]) != none:
            i = root & (slots - 1)
            gone = nxt[i]
            sym[i] = merged[root >> high]
            nxt[i] = after = nxt[gone]
            sym[gone] = -1
            if after < n:
                prv[after] = i
            set_leaf(gone, none)
            put(i, after)
            if prv[i] >= 0:
                put(prv[i], i)
        out = np.frombuffer(sym, np.int32)
        return out[out >= 0].tobytes()

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, its ids) in some order."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        slots = np.maximum(2, np.ceil(np.log2(np.fromiter(map(len, raw), np.int64, len(raw)))).astype(np.int64))
        order = np.argsort(slots, kind="stable").tolist()
        bounds = np.searchsorted(slots[order], np.arange(2, SHORT.bit_length() + 1)).tolist()
        for bits, first, last in zip(range(2, SHORT.bit_length()), bounds, bounds[1:]):
            for at in range(first, last, 8000):
                part = order[at : min(last, at + 8000)]
                yield from zip([pieces[i] for i in part], self.merge_many([raw[i] for i in part], 1 << bits))
        for i in order[bounds[-1] :]:
            yield pieces[i], self.merge_long(raw[i])

    def stretches(self, text: str) -> tuple[list[str], list[str]]:
        """The text cut where a single space stands between words, where pieces never cross.

        Returns the first stretches as they are, and then words that each have a space before them.
        """
        parts = text.split(" ")
        if "" in parts or "\n " in text or " \n" in text or ODD_SPACE.search(text):
            parts, at = [], 0
            for m in GAP.finditer(text):
                parts.append(text[at : m.start()])
                at = m.end()
            parts.append(text[at:])
        return parts[:1], parts[1:]

    def learn(self, words: set[str], memo: dict[str, bytes], space: str) -> None:
        """Encode new stretches into memo: words of letters at once, the others from their pieces."""
        letters = {w for w in words if w.isalpha()}
        split: dict[str, list[str]] = {}
        ended: dict[str, str] = {}
        pieces: set[str] = set()
        for w in words - letters:
            if w[-1:] in ENDS and w[:-1].isalpha():
                ended[w] = w[:-1]
                pieces.add(w[-1])
            else:
                split[w] = PIECES.findall(space + w)
                pieces.update(split[w])
        stems = set(ended.values())
        letters |= stems.difference(memo)
        n = len(space)
        if letters:
            memo.update((p[n:], ids) for p, ids in self.encode_pieces([space + w for w in letters]))
        if pieces:
            known = dict(self.encode_pieces(list(pieces)))
            memo.update((w, memo[stem] + known[w[-1]]) for w, stem in ended.items())
            memo.update((w, b"".join([known[p] for p in ps])) for w, ps in split.items())

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        cut: list[list[tuple[list[str], list[str]] | bytes]] = []
        for text in texts:
            own: list[tuple[list[str], list[str]] | bytes] = []
            for part in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,):
                if part in self.special:
                    own.append(np.int32(self.special[part]).tobytes())
                elif part:
                    at = 0
                    while len(part) - at > STRETCH and (m := GAP.search(part, at + STRETCH)):
                        own.append(self.stretches(part[at : m.start()]))
                        at = m.start()
                    own.append(self.stretches(part[at:] if at else part))
            cut.append(own)
        for k, space in ((0, ""), (1, " ")):
            new, old = self.memos[k]
            if len(new) > MEMO:
                self.memos[k] = new, old = {}, new
            words = set().union(*(x[k] for own in cut for x in own if isinstance(x, tuple))).difference(new)
            if again := words.intersection(old):
                new.update((w, old[w]) for w in again)
                words -= again
            if words:
                self.learn(words, new, space)
        plain, spaced = (self.memos[k][0].__getitem__ for k in (0, 1))
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join([*map(plain, x[0]), *map(spaced, x[1])]) for x in own]), np.int32) for own in cut]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids, counts[i] ids each."""
        out, last = [], 0
        for n in counts.tolist():  # a document, or a part of a long one, at a time
            parts = [self._bytes(ids[at : min(last + n, at + STRETCH)]) for at in range(last, last + n, STRETCH)]
            out.append(b"".join(parts).decode("utf-8", "replace"))
            last += n
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.token_at[ids] - ends + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.token_bytes[at].tobytes()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in groups_of(batch, 1, 2_000_000):
                ids = bpe.encode_texts(part.column(1).to_pylist())
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                texts = pa.array(bpe.decode_all(flat, counts), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return map_arrow(base, run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
