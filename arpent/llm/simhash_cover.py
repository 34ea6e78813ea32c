"""SimHash near-duplicates found through covering locality-sensitive hashing.

Every position of the 64-bit fingerprint gets a nonzero vector over GF(2) with `radius + 1`
entries. Each nonzero vector v of that space defines one table whose mask keeps the positions
whose vector has an odd product with v. The vectors of at most `radius` differing positions leave
some v orthogonal to all of them, and that table's mask drops just these positions: both
fingerprints then have the same key in it. So no pair within the radius is lost, and no other
tables are needed.

Distinct fingerprints, not documents, enter the tables; copies cost nothing. A bucket with more
than `bucket_limit` fingerprints is split again, exactly: among `radius + 1` blocks of the bits its
mask leaves out, one block must agree, so its members go to one sub-bucket for each block. Each
round fixes more bits, so buckets shrink at any size of input. A bucket emits a spanning forest of
its links, never all pairs.

Defined results: null text counts as empty, texts without words have fingerprint zero and link
like any other, repeated rows share their fingerprint, an empty table gives an empty table, other
columns of the input are ignored. A null id keeps its row; a component's id is the smallest id
that is not null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, map_columns, materialise, row_key, settled, utf8

BITS = 64


def fingerprint_of(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text: bit set where over half of its shingle hashes set it."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        octets = hashes[start : start + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint) with the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint_of(t, width) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return map_columns(narrow, run, "doc_id long, fingerprint long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each nonzero vector; positions get the nonzero vectors in turn."""
    vectors = range(1, 1 << (radius + 1))
    of_bit = [1 + k % len(vectors) for k in range(BITS)]
    return [sum(1 << k for k in range(BITS) if (of_bit[k] & v).bit_count() % 2) for v in vectors]


def _blocks(mask: int, radius: int) -> list[int]:
    """The bits that `mask` leaves out, dealt to radius + 1 blocks."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    return [sum(1 << k for k in free[j :: radius + 1]) for j in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a bucket, the position of the smallest one it is linked to in it."""
    n = len(values)
    label = np.arange(n)
    near = np.empty((n, n), dtype=bool)
    for start in range(0, n, 256):
        near[start : start + 256] = np.bitwise_count(values[start : start + 256, None] ^ values[None, :]) <= radius
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Streams over rows sorted by bucket; emits (u, v), u > v, a spanning forest of each bucket."""

    def flush(values: np.ndarray) -> list[tuple[int, int]]:
        if len(values) == 2:
            a, b = int(values[0]), int(values[1])
            linked = ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius
            return [(max(a, b), min(a, b))] if linked else []
        values = np.unique(values)
        label = _forest(values.view(np.uint64), radius)
        return [(int(values[k]), int(values[m])) for k, m in enumerate(label) if m != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, dtype=np.int64)
        out: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(0).to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            value = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cut))
            ends = np.concatenate((cut, [len(key)]))
            first = (slot[0], key[0])
            if first != last and len(held):
                if len(held) > 1:
                    out += flush(held)
                held = held[:0]
            head = np.concatenate((held, value[: ends[0]]))
            if len(starts) == 1:
                held, last = head, first
                continue
            if len(head) > 1:
                out += flush(head)
            for k in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                out += flush(value[starts[k] : ends[k]])
            held, last = value[starts[-1] :].copy(), (slot[-1], key[-1])
            if out:
                yield _pairs(out)
                out = []
        if len(held) > 1:
            out += flush(held)
        if out:
            yield _pairs(out)

    ordered = rows.repartition("slot", "key").sortWithinPartitions("slot", "key")
    return ordered.mapInArrow(run, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _keyed(rows: DataFrame, masks: list[int], base: int) -> DataFrame:
    """Rows (value[, slot]) to (slot, key, value) with one row for each mask."""
    tables = [F.struct(F.lit(base + k).alias("slot"), F.col("value").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    return rows.select("value", F.explode(F.array(*tables)).alias("t")).select("t.slot", "t.key", "value")


def links(distinct: DataFrame, radius: int, bucket_limit: int = 512) -> DataFrame:
    """Links (u, v), u > v, that connect what Hamming links within `radius` connect.

    `distinct` has the one column `value`: each fingerprint once.
    """
    masks = dict(enumerate(covering_masks(radius)))
    rows = _keyed(distinct, list(masks.values()), 0)
    parts = []
    while True:
        hot = materialise(rows.groupBy("slot", "key").count().where(F.col("count") > bucket_limit).select("slot", "key"), "hot")
        slots = sorted(r[0] for r in hot.select("slot").distinct().collect())  # table numbers, not data
        if not slots:
            parts.append(_links(rows, radius))
            break
        parts.append(_links(rows.join(hot, ["slot", "key"], "left_anti"), radius))
        within = rows.join(hot, ["slot", "key"], "left_semi").select("slot", "value")
        finer: dict[int, int] = {}
        split = []
        for slot in slots:
            if masks[slot] == (1 << 64) - 1:
                continue
            wider = [masks[slot] | b for b in _blocks(masks[slot], radius) if b]
            base = max([*masks, *finer]) + 1
            finer |= {base + k: m for k, m in enumerate(wider)}
            tables = [F.struct(F.lit(base + k).alias("slot"), F.col("value").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(wider)]
            split.append((slot, F.array(*tables)))
        choose = F.when(F.col("slot") == split[0][0], split[0][1])
        for slot, tables in split[1:]:
            choose = choose.when(F.col("slot") == slot, tables)
        rows = within.select("value", F.explode(choose).alias("t")).select("t.slot", "t.key", "value")
        rows = materialise(rows, "split")
        masks = finer
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each upper end has one edge and is no lower end, so that each component is a star around its smallest node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    counted = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return counted.where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of `edges` (u, v) is connected with.

    Alternates large-star and small-star steps until the edges are stars around the smallest
    nodes; each step is written to the shared folder, so the lineage stays short.
    """
    now = Stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now.read()):
        e = now.read()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = Stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low.read(), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = Stage(large.where("u <> v").distinct(), "large")
        e = mid.read()
        low2 = Stage(e.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = e.join(low2.read(), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p"))
        after = Stage(small.select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct(), "edges")
        for old in (now, low, mid, low2):
            old.drop()
        now = after
    return now.read().select(F.col("u").alias("node"), F.col("v").alias("label"))


@settled("components")
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, bucket_limit: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of `docs`."""
    prints = materialise(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    found = connected(links(nodes.select(F.col("fingerprint").alias("value")), radius, bucket_limit))
    labelled = nodes.join(found, nodes.fingerprint == found.node, "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    labelled = materialise(labelled, "labelled")
    least = materialise(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    members = materialise(labelled.join(least, "label").select("fingerprint", "component_id"), "members")
    return prints.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest id, with its own columns.

    Rows are told apart by id and text, so different texts with the same id or without one stay.
    """
    keyed = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    rows = materialise(keyed.select(F.xxhash64("_id", "_hash").alias("__arpent_row"), "_id", "_hash", F.col("row")[text_col].alias("text")), "rows")
    found = near_duplicates(rows, "__arpent_row", "text", **options).select("doc_id", "component_id")
    first = F.min(F.struct((F.col("_id") == "").alias("none"), F.col("_id").try_cast("long").alias("i"), "_id", "_hash")).alias("r")
    keep = found.join(rows, F.col("doc_id") == F.col("__arpent_row")).groupBy("component_id").agg(first).select("r._id", "r._hash")
    return keyed.join(keep, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("row.*")
