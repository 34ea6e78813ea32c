"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens; positions it leaves out may differ. Every position
of a document and of a benchmark item gets one hash for each mask; equal hashes are hits. Around a
hit, document and item are compared token by token along its diagonal, and the longest stretch of
which 80 in 100 agree counts if it has at least `min_overlap` tokens (the whole item if that is
shorter). Tokens are runs of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased.

The test side is the bounded one: its size is measured, and items go to the executors in blocks of
at most `block_bytes` of text, one pass over the documents for each block, so any test set works.
What the passes find is put together by row (id and text) and does not depend on their number.

Defined results: null or empty texts have no overlap, empty items match nothing, items that are
shorter than a mask are looked up as a whole, repeated items count once for each id, items without
an id count like others and are listed without a name, repeated rows and rows without an id have
results of their own, an empty benchmark marks nothing, other columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, materialise, per_process, row_key, utf8

#: Any 13 tokens or more of which 80 in 100 agree, and items of 11 or 12, hit one of these (see the tests).
MASKS = ("1111111", "11011001101", "10110110011", "1110010111", "10101111", "11101000011", "11011010001")
_BASE = 0x9E3779B97F4A7C15
_SPAN = 1 << 20


def _tables():
    mix = np.random.RandomState(20240229)
    value = (mix.randint(0, 1 << 62, 256).astype(np.uint64) << np.uint64(2)) | np.uint64(1)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    token = np.zeros(256, dtype=bool)
    token[48:58] = token[65:91] = token[97:123] = token[128:] = True
    return value[lower], token


class _Hasher:
    def __init__(self):
        self.value, self.token = _tables()
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(_SPAN, _BASE, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(_SPAN, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
            self.role = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))

    def tokens(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of each token of the bytes `raw`."""
        inside = self.token[raw]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, dtype=np.uint64), start
        # sums within blocks: powers restart, so texts of any length need only _SPAN powers
        where = np.arange(len(raw)) % _SPAN if len(raw) > _SPAN else slice(0, len(raw))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.value[raw] * self.power[where])))
        found = (total[end] - total[start]) * self.inverse[start % _SPAN]
        if len(raw) > _SPAN:
            for k in np.flatnonzero(start // _SPAN != (end - 1) // _SPAN):
                piece = raw[start[k] : end[k]]
                if len(piece) <= _SPAN:
                    found[k] = (self.value[piece] * self.power[: len(piece)]).sum() * self.inverse[0]
                else:
                    found[k] = xxhash.xxh64_intdigest(piece.tobytes().lower())
        found ^= found >> np.uint64(29)
        return found * np.uint64(0xBF58476D1CE4E5B9), start

    def seeds(self, hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.full(n, salt, dtype=np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                out += hashes[k : k + n] * self.role[k]
        return out ^ (out >> np.uint64(31))


def _index(items: list[tuple[int, bytes]]) -> dict:
    """Seeds of a block of items: sorted hashes with (item, position), and the items' tokens."""
    hasher = _Hasher()
    tokens, keys, owner, place, short = [], [], [], [], set()
    longest = max(map(len, MASKS))
    for number, (_, text) in enumerate(items):
        h, _ = hasher.tokens(np.frombuffer(text, dtype=np.uint8))
        tokens.append(h)
        masks = list(enumerate(MASKS))
        if 0 < len(h) < longest:
            short.add(len(h))
            masks.append((1000 + len(h), "1" * len(h)))
        for salt, mask in masks:
            s = hasher.seeds(h, mask, salt)
            keys.append(s)
            owner.append(np.full(len(s), number))
            place.append(np.arange(len(s)))
    none = np.empty(0, dtype=np.int64)
    key = np.concatenate([np.empty(0, dtype=np.uint64), *keys])
    order = np.argsort(key, kind="stable")
    own, at = np.concatenate([none, *owner])[order], np.concatenate([none, *place])[order]
    filter_ = np.zeros(1 << 22, dtype=bool)
    filter_[(key >> np.uint64(42)).astype(np.int64)] = True
    return {"ids": [i for i, _ in items], "tokens": tokens, "key": key[order], "owner": own, "place": at, "filter": filter_, "short": sorted(short)}


def _stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(start, length, agreeing) of the longest stretch of which 80 in 100 agree, the first if several."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    low = np.minimum.accumulate(score)
    begin = np.searchsorted(-low, -score)  # the first position that scores no more
    end = int(np.argmax(np.arange(len(score)) - begin))
    at = int(begin[end])
    return at, end - at, int(same[at:end].sum())


def _overlaps(texts: list[bytes], index: dict, hasher: _Hasher, min_overlap: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text, (item id, first token, tokens, agreeing tokens) of its overlaps."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, start = hasher.tokens(raw)
    doc = np.searchsorted(begin, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    seen: set[tuple[int, int, int]] = set()
    for salt, mask in [*enumerate(MASKS), *((1000 + n, "1" * n) for n in index["short"])]:
        s = hasher.seeds(hashes, mask, salt)
        near = np.flatnonzero(index["filter"][(s >> np.uint64(42)).astype(np.int64)])
        near = near[doc[near] == doc[near + len(mask) - 1]]
        lows, highs = np.searchsorted(index["key"], s[near], "left"), np.searchsorted(index["key"], s[near], "right")
        for h in np.flatnonzero(lows < highs):
            k = int(near[h])
            d = int(doc[k])
            for e in range(lows[h], highs[h]):
                item, diagonal = int(index["owner"][e]), int(k - index["place"][e])
                if (d, item, diagonal) in seen:
                    continue
                seen.add((d, item, diagonal))
                tokens = index["tokens"][item]
                a, b = max(diagonal, int(first[d])), min(diagonal + len(tokens), int(first[d + 1]))
                at, length, agree = _stretch(hashes[a:b] == tokens[a - diagonal : b - diagonal])
                if length >= min(min_overlap, len(tokens)):
                    out[d].append((index["ids"][item], a + at - int(first[d]), length, agree))
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_overlap: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, spans) for each row of `docs`; spans: array of (item_id, start, tokens, agreeing)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), utf8(item_text).alias("t")).where("length(t) > 0").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    kind = "array<struct<item_id:long,start:long,tokens:long,agreeing:long>>"
    names, fields = ["item_id", "start", "tokens", "agreeing"], pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "tokens", "agreeing")]))
    if blocks == 1:
        narrow, ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")), ["doc_id"]
    else:
        narrow, ids = docs.select(*row_key(id_col, text_col), utf8(text_col).alias("text")), ["_id", "_hash"]
    parts = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) if blocks > 1 else items
        index = spark.sparkContext.broadcast(_index(sorted(((r[0], bytes(r[1])) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))))

        def run(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            found = _overlaps([t or b"" for t in batch.column(len(ids)).to_pylist()], index.value, per_process(("overlaps",), _Hasher), min_overlap)
            order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
            spans = pa.array([[dict(zip(names, x)) for x in sorted(set(f), key=order)] for f in found], fields)
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], spans], [*ids, "spans"])
            return out if blocks == 1 else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

        types = "doc_id long" if blocks == 1 else "_id string, _hash long"
        parts.append(map_columns(narrow, run, f"{types}, spans {kind}", rows=128))
    if blocks == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = materialise(every.groupBy("_id", "_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("found")), "overlaps")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col)).join(merged, ["_id", "_hash"], "left")
    return rows.select("doc_id", F.coalesce("found", F.array().cast(kind)).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: whether it overlaps, with which items, and by how many tokens."""
    spans = F.col("spans")
    return overlaps(docs, benchmark, **options).select(
        "doc_id",
        (F.size(spans) > 0).alias("contaminated"),
        F.size(F.array_distinct(spans["item_id"])).cast("long").alias("n_items"),
        F.array_join(F.array_sort(F.array_distinct(spans["item_id"])).cast("array<string>"), ",").alias("item_ids"),
        F.aggregate(spans["tokens"], F.lit(0).cast("long"), lambda s, x: s + x).alias("overlap_tokens"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without those that overlap with an item; rows are told apart by id and text."""
    keyed = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col)).withColumn("key", F.xxhash64("_id", "_hash"))
    rows = keyed.select("key", F.col("row")[text_col].alias("text"))
    leaks = overlaps(rows, benchmark, "key", "text", **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select("row.*")
