"""Near-duplicates by word shingles at a Jaccard similarity of num/den or more, without a lost pair.

First, SimHash: fingerprints of the shingles are linked through the covering tables of
`simhash_cover`, and a link counts if the two sets of shingles are as similar as asked. That joins
most copies cheaply. But 64 bits cannot find every pair at a similarity of 0.8: these differ in about
10 bits on average, and a covering radius of r needs 2^(r+1) - 1 tables. So, second, the remaining
candidates come from prefix filtering. All shingles have one global order. If two sets are similar
enough, the first shingle that both have lies among the first n - ceil(n * num / den) + 1 of either
one, and among the first n - ceil(2n * num / (num + den)) + 1 of the smaller one (`small`). So each
set enters one bucket for each shingle of its prefix, and no pair is lost. The order puts shingles
last that are frequent in a sample; the sample only decides the order, any order is exact.

Each set has a bitmap with the parity of the number of its shingles in each of 512 classes. Two
bitmaps never differ in more bits than the sets differ in shingles, so pairs of a bucket are left out
by roles, sizes and bitmaps, exactly. Candidates are then held against a second bitmap, which has about
as many classes as the set has shingles, so that long texts are told apart too; it takes a fiftieth of
the text's room, and texts move only for pairs it can't tell apart. What remains is verified on both texts.

Equal texts are one node, so copies cost nothing. Before pairs of a bucket are compared, rounds join
large groups: each node is verified with the nearest of the centres of its buckets, one for each
bucket, so a round verifies a pair for each node at most. The first round verifies the links of SimHash
too. Only pairs of different groups are compared afterwards, buckets of over `block` nodes block by
block. Rounds end when they join little, or no bucket of groups has over `hot` nodes; any number of
rounds gives the same groups.

Defined results: null text counts as empty, texts without words are copies of each other, texts
shorter than a shingle are one shingle, rows are told apart by id and text.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, drop_later, map_columns, materialise, row_key, settled, shared_dir, shuffles_dropped, utf8
from .simhash_cover import connected, fingerprint_of, links

_LOW = np.uint64(8)
SAMPLE, ORDERED = 5000, 100_000
WORDS = 8  #: 64-bit words of a bitmap
EMPTY = -1  #: the bucket of texts without words


def shingles_of(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the shingles; words are as for SimHash."""
    words = (text or b"").lower().split()
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    found = np.fromiter(map(xxhash.xxh64_intdigest, grams if words else ()), dtype=np.uint64)
    return np.unique(found >> _LOW).view(np.int64)


def bitmap_of(found: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in 512 classes, as eight longs."""
    odd = np.bincount(found & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_of(found: np.ndarray) -> bytes:
    """The parities in as many classes as there are shingles, rounded up to a power of two from 512 on."""
    classes = 1 << max(9, (max(1, len(found)) - 1).bit_length())
    return np.packbits((np.bincount(found & (classes - 1), minlength=classes) & 1).astype(np.uint8)).tobytes()


def wide_distance(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded, which gives the parities in half the classes."""
    x, y = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def prefixes(n: int, num: int, den: int) -> tuple[int, int]:
    """Lengths of the prefix of a set of n shingles: against smaller sets, against larger ones."""
    return n - -(-n * num // den) + 1, n - -(-2 * n * num // (num + den)) + 1


def _frequent(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, tier) of the shingles that occur in several texts of a sample, at most ORDERED."""
    every = max(1, docs.count() // SAMPLE)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles_of(t, width) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sets]))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0).select(utf8(text_col).alias("t"))
    counted = map_columns(sample, run, "h long").groupBy("h").count().where(F.col("count") > 1)
    rows = counted.orderBy(F.desc("count"), "h").limit(ORDERED).collect()
    h, n = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
    order = np.argsort(h)
    return h[order], np.array([int(x).bit_length() for x in n[order]], dtype=np.int64)


def _ordered(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set with each shingle's tier in its upper bits, sorted."""
    h, tier = frequent
    if len(h):
        at = np.minimum(np.searchsorted(h, found), len(h) - 1)
        found = found | np.where(h[at] == found, tier[at], 0) << np.int64(56)
    return np.sort(found)


def _nodes(texts: DataFrame, width: int, num: int, den: int, frequent) -> DataFrame:
    """(node, text, size, small, prefix, bits, wide, fingerprint): each text once, bucketed by `node` in the shared folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, small, prefix, bits, wide, prints = [], [], [], [], [], []
        for t in batch.column(1).to_pylist():
            s = shingles_of(t, width)
            long, short = prefixes(len(s), num, den)
            size.append(len(s))
            small.append(short)
            prefix.append(_ordered(s, frequent.value)[:long] if len(s) else np.array([EMPTY]))
            bits.append(bitmap_of(s))
            wide.append(wide_of(s))
            prints.append(fingerprint_of(t, width))
        longs = pa.list_(pa.int64())
        columns = [pa.array(size, pa.int32()), pa.array(small, pa.int32()), pa.array(prefix, longs), pa.array(bits, longs), pa.array(wide, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], ["node", "text", "size", "small", "prefix", "bits", "wide", "fingerprint"])

    spark = texts.sparkSession
    once = texts.groupBy(F.col("_hash").alias("node")).agg(F.first("text").alias("text"))
    made = map_columns(once, run, "node long, text binary, size int, small int, prefix array<long>, bits array<long>, wide binary, fingerprint long")
    name = f"arpent_nodes_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    drop_later(drop_folder(spark, path))
    drop_later(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with shuffles_dropped(spark):
        made.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "node").saveAsTable(name)
    return spark.table(name)


def _met(pairs: DataFrame, nodes: DataFrame, column: Column, share: int) -> DataFrame:
    """(u, v, a, b): the pairs with what `column` has of both.

    `u` may be in any number of pairs: its value goes to one place for each `share` of them.
    """
    hubs = materialise(pairs.groupBy("u").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")), "hubs")
    a = hubs.join(nodes.select(F.col("node").alias("u"), column.alias("a")), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a")
    dealt = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"))
    return dealt.join(nodes.select(F.col("node").alias("v"), column.alias("b")), "v").join(a, ["u", "part"]).select("u", "v", "a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, width: int, num: int, den: int, share: int = 512) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of num/den or more: by wide bitmaps first, then by texts."""

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [batch.column(k) for k in (2, 3)]
        m, n = (c.field("size").to_numpy(zero_copy_only=False).astype(np.int64) for c in both)
        apart = np.array([wide_distance(x, y) for x, y in zip(*(c.field("wide").to_pylist() for c in both))], dtype=np.int64)
        return batch.select([0, 1]).filter(pa.array(apart * (num + den) <= (m + n) * (den - num)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held, keep = {}, []
        for u, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if u not in held:
                held = {u: shingles_of(a.as_py(), width)}
            x, y = held[u], shingles_of(b.as_py(), width)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * (num + den) >= (len(x) + len(y)) * num)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = materialise(map_columns(_met(pairs, nodes, F.struct("wide", "size"), share), near, "u long, v long"), "near")
    return materialise(map_columns(_met(left, nodes, F.col("text"), share), run, "u long, v long"), "verified")


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Whether roles, sizes and bitmaps of two entries of a bucket allow a similarity of num/den."""
    m, n = F.col(f"{a}.size").cast("long"), F.col(f"{b}.size").cast("long")
    role = ((m <= n) & F.col(f"{a}.small")) | ((n <= m) & F.col(f"{b}.small"))
    return role & (F.least(m, n) * den >= F.greatest(m, n) * num) & (_distance(a, b) * (num + den) <= (m + n) * (den - num))


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(WORDS)), F.lit(0))


def _cross(buckets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): pairs of a bucket's nodes of different groups that may match.

    A bucket that holds two blocks compares nodes of the one with nodes of the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            across = batch.column(0).to_numpy(zero_copy_only=False)
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).flatten()
            start = ends[0]
            node, label, size, small, part = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            bits = np.stack([flat.field(5 + k).to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)
            out: list[np.ndarray] = []
            for two, s, e in zip(across, ends[:-1] - start, ends[1:] - start):
                for x in range(s, e - 1):
                    y = slice(x + 1, e)
                    m, n = int(size[x]), size[y].astype(np.int64)
                    ok = (label[y] != label[x]) & (np.minimum(m, n) * den >= np.maximum(m, n) * num)
                    ok &= ((m <= n) & small[x]) | ((n <= m) & small[y])
                    if two:
                        ok &= part[y] != part[x]
                    at = x + 1 + np.flatnonzero(ok)
                    if len(at):
                        apart = np.bitwise_count(bits[at] ^ bits[x]).sum(axis=1, dtype=np.int64)
                        at = at[apart * (num + den) <= (size[at].astype(np.int64) + m) * (den - num)]
                    if len(at):
                        out.append(np.stack((np.minimum(node[at], node[x]), np.maximum(node[at], node[x])), axis=1))
                    if len(out) > 2048:
                        yield _batch(out)
                        out = []
            if out:
                yield _batch(out)

    return buckets.mapInArrow(run, "u long, v long")


def _batch(out: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(out), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _by_simhash(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v): pairs of nodes whose fingerprints are linked; each node of a fingerprint with its first one."""
    prints = materialise(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), "prints")
    found = links(prints.select(F.col("fingerprint").alias("value")), radius)
    ends = [prints.select(F.col("fingerprint").alias(c), F.col("first").alias(f"node_{c}")) for c in ("u", "v")]
    linked = found.join(ends[0], "u").join(ends[1], "v").select(F.col("node_v").alias("u"), F.col("node_u").alias("v"))
    equal = nodes.select("fingerprint", "node").join(prints, "fingerprint").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return linked.unionByName(equal).where("u <> v").distinct()


def _named(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries with the group of their node; a node without a link is its own group."""
    if labels is None:
        return entries.withColumn("label", F.col("node"))
    return entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    if labels is None:
        return connected(found)
    return connected(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(found))


@settled("groups")
def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, radius: int = 3, hot: int = 64, rounds: int = 8, block: int = 1024) -> DataFrame:
    """(_id, _hash, component), for each row of `docs`: what links of a similarity of num/den connect."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text_col, width))
    rows = docs.select(*row_key(id_col, text_col), utf8(text_col).alias("text"))
    nodes = _nodes(rows.select("_hash", "text"), width, num, den, frequent)
    linked = materialise(_by_simhash(nodes, radius), "linked")

    entries = nodes.select("node", F.posexplode("prefix").alias("at", "key"), "small").select("key", "node", (F.col("at") < F.col("small")).alias("small"))
    common = materialise(entries.groupBy("key").agg(F.count("*").alias("n"), F.max("small").alias("small")).where("n > 1 AND small").select("key"), "common")
    shared = materialise(entries.join(common, "key", "left_semi"), "shared")
    crowd = materialise(shared.join(nodes.select("node", "size", "bits"), "node"), "crowd")

    labels = late = None  # late: verified links that the labels do not hold yet
    entry, most = F.struct("node", "label", "size", "small", "bits"), 0
    for k in range(rounds):
        named = _named(crowd, labels).withColumn("h", F.xxhash64("node", F.lit(k)))
        if labels is not None:
            named = materialise(named, "named")
        found = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.min(F.struct("h", entry.alias("c"))).alias("m"))
        centres = materialise(found.where("low <> high").select("key", "n", "m.c"), "centres")
        if k and centres.where(F.col("n") > hot).isEmpty():
            break
        tried = named.select("key", entry.alias("e")).join(centres, "key").where((F.col("e.label") != F.col("c.label")) & _may_match("e", "c", num, den))
        nearest = tried.groupBy(F.col("e.node").alias("v")).agg(F.min(F.struct(_distance("e", "c").alias("d"), F.col("c.node").alias("u"))).alias("m"))
        pairs = nearest.select("m.u", "v")
        new = _verified(materialise(pairs if k else pairs.unionByName(linked).distinct(), "tried"), nodes, width, num, den)
        n = new.count()
        most = max(most, n)
        if k and 10 * n <= most:
            late = new
            break
        labels = _joined(labels, new)

    named = _named(crowd, labels)
    left = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high")
    dealt = named.join(materialise(left.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "left"), "key")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("node", "label", "size", "small", "part", *(F.col("bits")[j].alias(f"w{j}") for j in range(WORDS)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    buckets = dealt.groupBy("key", low.alias("low"), high.alias("high")).agg(F.collect_list(member).alias("b"))
    pairs = _cross(buckets.where(F.size("b") > 1).select((F.col("low") < F.col("high")).alias("across"), "b"), num, den)
    pairs = materialise((pairs if rounds else pairs.unionByName(linked)).distinct(), "pairs")
    new = _verified(pairs, nodes, width, num, den)
    labels = _joined(labels, new if late is None else new.unionByName(late))
    return rows.select("_id", "_hash").join(labels, F.col("_hash") == F.col("node"), "left").select("_id", "_hash", F.coalesce("label", "_hash").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, the one with the smallest id, with its own columns; repeats of that row go too.

    Only keys of rows that go or repeat are joined to the documents.
    """
    found = groups(docs, id_col, text_col, **options).groupBy("_id", "_hash").agg(F.min("component").alias("component"), F.count("*").alias("n"))
    first = found.groupBy("component").agg(F.min(F.struct((F.col("_id") == "").alias("none"), F.col("_id").try_cast("long").alias("i"), "_id", "_hash")).alias("r"))
    kept = first.select("r._id", "r._hash", F.lit(True).alias("stays"))
    odd = found.join(kept, ["_id", "_hash"], "left").where("stays IS NULL OR n > 1").select("_id", "_hash", F.coalesce("stays", F.lit(False)).alias("repeats"))
    keyed = docs.select(F.struct("*").alias("row"), *row_key(id_col, text_col)).join(materialise(odd, "odd").hint("merge"), ["_id", "_hash"], "left")  # one plan at every size
    single = keyed.where("repeats IS NULL").select("row.*")
    return single.unionByName(keyed.where("repeats").dropDuplicates(["_id", "_hash"]).select("row.*"))
