"""Removal of long repeated byte strings, by longest previous factors.

The longest earlier match of a suffix is with the nearest suffix before or after it in suffix order
that starts at a smaller place. Removing strings of L bytes asks whether that factor reaches L. Two
strings of L bytes can only be equal if they have the same anchor, so suffix orders are made over the
surroundings of one anchor at a time, to a depth of L bytes.

Flow, without suffixes of whole corpora in one place:

1. Copies of a whole text are one text with a number of copies.
2. Each window of L bytes has one anchor, its smallest K-byte hash, leftmost on ties. Equal windows
   have equal anchors, and anchors are about 2 in L - K + 2 positions. Anchors seen once can't
   belong to a repeated window; they are counted away.
   Periodic bytes, where the smallest hash comes again and again, have one for each L - K + 1.
3. The bytes around the other anchors go to their anchor's partition, where previous factors are
   found. The occurrences of an anchor are dealt to blocks of about `hot`. A block settles what
   repeats inside it, byte by byte; the first suffix of each of its classes then sends one row, keyed
   by two 64-bit hashes of its L bytes, to meet those of the other blocks. So a common window costs a
   row for each block, not for each text. Only here are hashes taken for the bytes.
4. Spans return to their text. Texts are written once, bucketed by id, and not shuffled again.

`keep="first"` keeps the first occurrence (by smallest document id, then position), as the factors
say; `keep="none"` removes every occurrence, the first included.

Defined results: null text counts as empty; texts shorter than L lose nothing; matches may overlap
and lie in one document; repeated rows are copies of each other; rows without an id come last in
the order; an empty table gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, drop_later, map_columns, materialise, settled, shared_dir, utf8

K = 48
_SEGMENT = 1 << 20
SHARE = 1 << 20  #: bytes of surroundings that are solved at once, beside those of one block of an anchor


def _ranked(key: np.ndarray) -> np.ndarray:
    """The rank of each value among the different values."""
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return out


def suffix_ranks(raw: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first `depth` bytes, by prefix doubling; equal ranks are equal bytes.

    Only suffixes of at least `depth` bytes have one.
    """
    if len(raw) < depth:
        return np.empty(0, dtype=np.int64)
    done = min(8, depth)
    word = np.zeros(len(raw) - done + 1, dtype=np.uint64)
    for k in range(done):
        word = word << np.uint64(8) | raw[k : k + len(word)]
    rank = _ranked(word)
    while done < depth:
        step = min(done, depth - done)
        rank = _ranked(rank[:-step] * np.int64(len(raw)) + rank[step:])
        done += step
    return rank


def smaller_before(place: np.ndarray) -> np.ndarray:
    """For each entry of a sequence, the nearest index before it with a smaller value, or -1."""
    found = np.arange(-1, len(place) - 1)
    left = np.arange(len(place))
    while True:
        left = left[found[left] >= 0]
        left = left[place[found[left]] > place[left]]
        if not len(left):
            return found
        found[left] = found[found[left]]  # what lies between is larger than both


def previous_factors(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, source) for the suffixes whose longest previous factor reaches the depth of `rank`.

    In suffix order the longest earlier match of a suffix is with the nearest suffix before or after
    it that starts at a smaller place; it reaches the depth if both have one rank.
    """
    order = np.argsort(rank)
    rank, place = rank[order], place[order]
    before = smaller_before(place)
    after = len(place) - 1 - smaller_before(place[::-1])[::-1]  # len(place): none
    at = np.arange(len(place))
    of_before = (before >= 0) & (rank[before] == rank)
    of_after = after < len(place)
    of_after[of_after] = rank[after[of_after]] == rank[of_after]
    reached = of_before | of_after
    source = np.where(of_before, before, after)[reached]
    return order[at[reached]], order[source]


def _mixed(a: np.ndarray, b: np.ndarray, role: int) -> np.ndarray:
    out = a * np.uint64(0x9E3779B97F4A7C15 + 2 * role) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 - 4 * role)
    out ^= out >> np.uint64(32)
    return out


class _Rolling:
    """Hashes of all substrings of some lengths of a buffer, by doubling."""

    def __init__(self, raw: np.ndarray, seed: int):
        value = np.random.RandomState(seed).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.seed, self.level = seed, {1: value[raw]}

    def of(self, size: int) -> np.ndarray:
        """hash[i] for raw[i : i + size], for every i where that is inside."""
        if size not in self.level:
            low = 1 << (size.bit_length() - 1)
            if low == size:
                half = self.of(size // 2)
                self.level[size] = _mixed(half[: -(size // 2)], half[size // 2 :], size + self.seed)
            else:
                first, rest = self.of(low), self.of(size - low)
                n = len(self.level[1]) - size + 1
                self.level[size] = _mixed(first[:n], rest[low : low + n], size + self.seed)
        return self.level[size]


def _minima(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The K-byte hashes of a buffer, and for each window where its smallest one is."""
    full = _Rolling(raw, 7).of(K)
    width = length - K + 1
    n = len(full)
    value = (full & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = value
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    return full, (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)


def _anchors(row: np.ndarray, at: np.ndarray, full: np.ndarray, inner: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, hash, first window, last window, whether again) of the anchors of consecutive windows.

    Periodic bytes have the same smallest hash again and again; there one anchor stands for up to
    `width` windows, which is as many as for any other, and these may repeat each other.
    """
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    h, own, begin = full[at[first]], row[first], inner[first]
    fresh = np.ones(len(first), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0))
    part = (begin - begin[start]) // width
    fresh[1:] |= part[1:] != part[:-1]
    again = np.diff(np.append(np.flatnonzero(fresh), len(first))) > 1
    first = first[fresh]
    last = np.append(first[1:], len(at)) - 1
    return own[fresh], h[fresh], inner[first], inner[last], again


def anchors_of(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, whether again) of each anchor; each window of the text has one."""
    parts = []
    for begin in range(0, max(len(text) - length + 1, 0), _SEGMENT - length):
        raw = np.frombuffer(text[begin : begin + _SEGMENT - 1], dtype=np.uint8)
        if len(raw) < length:
            break
        full, at = _minima(raw, length)
        last_segment = begin + len(raw) >= len(text)
        if not last_segment:
            at = at[: _SEGMENT - length]
        inner = np.arange(len(at))
        _, h, first, last, again = _anchors(np.zeros(len(at), dtype=np.int64), at, full, inner, length - K + 1)
        parts.append((h, first + begin, last + begin, again))
        if last_segment:
            break
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def anchors_of_many(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, last window, whether again) of each anchor; short texts share one pass."""
    parts, group, size = [], [], 0

    def solve(group: list[int]) -> None:
        raw = np.frombuffer(b"".join(texts[k] for k in group), dtype=np.uint8)
        sizes = np.array([len(texts[k]) for k in group])
        begin, count = np.cumsum(sizes) - sizes, sizes - length + 1
        full, at = _minima(raw, length)
        row = np.repeat(np.arange(len(group)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = at[begin[row] + inner]
        own, *found = _anchors(row, at, full, inner, length - K + 1)
        parts.append((np.array(group)[own], *found))

    for k, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > _SEGMENT // 4:
            found = anchors_of(text, length)
            parts.append((np.full(len(found[0]), k), *found))
            continue
        if size + len(text) > _SEGMENT // 4:
            solve(group)
            group, size = [], 0
        group.append(k)
        size += len(text)
    if group:
        solve(group)
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _runs(mark: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of marks with one owner."""
    edge = np.flatnonzero(mark)
    if not len(edge):
        return edge, edge
    fresh = (np.diff(edge) > 1) | (np.diff(owner[edge]) != 0)
    return edge[np.concatenate(([True], fresh))], edge[np.concatenate((fresh, [True]))]


def _windows(context: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, start in the joined bytes) of every window inside the contexts, and these bytes."""
    raw = np.frombuffer(b"".join(context), dtype=np.uint8)
    size = np.fromiter(map(len, context), dtype=np.int64, count=len(context))
    begin, count = np.cumsum(size) - size, size - length + 1
    row = np.repeat(np.arange(len(context)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, offset, begin[row] + offset, raw


def _classed(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of contexts that are classed with others of their (anchor, block), and windows that other
    blocks must see.

    A window row (h1, h2) stands for a class of a block. Its key is set only if its place is repeated
    as soon as another block has the class; a row without key is a witness.
    """
    schema = "tid long, key binary, first_doc long, start long, end long, h1 long, h2 long"
    names = ["tid", "key", "first_doc", "start", "end", "h1", "h2"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        start = table["start"].to_numpy()
        first_doc = table["first_doc"].fill_null((1 << 63) - 1).to_numpy()
        shared = table["blocks"].to_numpy() > 1
        coded = table["context"].combine_chunks().dictionary_encode()
        code, size = coded.indices.to_numpy(), np.fromiter(map(len, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        order = np.lexsort((start, first_doc, code))
        head = order[np.diff(code[order], prepend=-1) != 0]  # the first of each context, in the order of codes
        whole = np.ones(len(code), dtype=bool)
        whole[head] = False
        if not keep_first:
            whole[head] = np.bincount(code, minlength=len(head)) > 1
        # equal contexts have equal windows; a look inside is needed where an anchor has several contexts or blocks, or comes again in one
        anchor = table["anchor"].to_numpy()[head]
        _, group, kinds = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero((kinds[group] > 1) | shared[head] | table["again"].to_numpy()[head])
        context = coded.dictionary.take(pa.array(several)).to_pylist()
        inside = head[several]
        row, offset, at, raw = _windows(context, length)
        rank = suffix_ranks(raw, length)[at]
        if keep_first:
            order = np.lexsort((start[inside][row] + offset, first_doc[inside][row]))
            turn = np.empty(len(row), dtype=np.int64)
            turn[order] = np.arange(len(row))
        else:
            turn = np.arange(len(row))
        mark = np.zeros(len(row), dtype=bool)
        later, source = previous_factors(rank, turn)
        mark[later] = True
        head = ~mark  # the first suffix of each class
        if not keep_first:
            mark[source] = True
        mark &= ~whole[inside][row]
        a, b = _runs(mark, row)
        full = np.flatnonzero(whole)
        own = np.concatenate((full, inside[row[a]]))
        begin = start[own] + np.concatenate((np.zeros(len(full), dtype=np.int64), offset[a]))
        end = start[own] + np.concatenate((size[code[full]], offset[b] + length))
        # one window of each class whose anchor has other blocks
        first = np.flatnonzero(head & shared[inside][row])
        h1, h2 = (_Rolling(raw, seed).of(length)[at] for seed in (11, 13)) if len(first) else (rank, rank)
        place = inside[row[first]]
        unsettled = ~mark[first] & ~whole[place]
        owner = np.concatenate((own, place))
        needed = np.concatenate((np.ones(len(own), dtype=bool), unsettled))
        at = pa.array(owner, mask=~needed)
        take = table.select(["tid", "key"]).take(at).combine_chunks()
        begin = np.concatenate((begin, start[place] + offset[first]))
        end = np.concatenate((end, start[place] + offset[first] + length))
        none = np.concatenate((np.ones(len(own), dtype=bool), np.zeros(len(first), dtype=bool)))
        hashes = [pa.array(np.concatenate((np.zeros(len(own), dtype=np.int64), h[first].view(np.int64))), mask=none) for h in (h1, h2)]
        order_doc = pa.array(first_doc[owner], mask=none | (not keep_first))
        arrays = [take["tid"], take["key"], order_doc, pa.array(begin, mask=~needed), pa.array(end, mask=~needed), *hashes]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in arrays], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0  # bytes of contexts in `held`
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                anchor = batch.column(0).to_numpy()
                block = batch.column(1).to_numpy()
                cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(block) != 0)) + 1
                fresh = held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (anchor[0], block[0])
                # all before the last group of this batch is complete
                done = int(cut[-1]) if len(cut) else (0 if fresh else None)
                if done is not None and waiting >= SHARE:
                    if done:
                        held.append(batch.slice(0, done))
                    yield solve(pa.Table.from_batches(held))
                    held, batch = [], batch.slice(done)
                    waiting = 0
                held.append(batch)
                waiting += pc.sum(pc.binary_length(batch.column("context"))).as_py() or 0
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block").mapInArrow(run, schema)


def _between_blocks(windows: DataFrame, keep_first: bool) -> DataFrame:
    """Spans (tid, key, start, end) of window rows whose class another block has too.

    A class has at most one row for each block, and is only streamed over.
    """
    names = ["tid", "key", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, False  # the last row, and whether the one before it has the same class
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            h1, h2 = table["h1"].to_numpy(), table["h2"].to_numpy()
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            before = np.concatenate(([matched], same))
            found = before.copy()
            if not keep_first:
                found[:-1] |= same
            found[-1] = False
            found &= table["key"].is_valid().to_numpy()
            if found.any():
                yield from table.select(names).filter(pa.array(found)).to_batches()
            held, matched = table.slice(len(h1) - 1).to_batches()[0], bool(before[-1])
        if matched and held.column("key")[0].is_valid:
            yield held.select(names)

    order = ["h1", "h2", *["first_doc", "start", "tid"] * keep_first]
    return windows.repartition("h1", "h2").sortWithinPartitions(*order).mapInArrow(run, "tid long, key binary, start long, end long")


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with `groups`, one for each of their keys; column n is the size of a group.

    Groups above a two-thousandth of the rows are fewer than 2,000, so they are broadcast and their
    rows never travel by key; all others are too small to make a task large.
    """
    large = groups.where(F.col("n") > total // 2000)
    small = groups.where(F.col("n") <= total // 2000)
    heavy = rows.join(F.broadcast(large), keys)
    light = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys)
    return heavy.unionByName(light)


def _distinct_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tid, key, text, copies, first_doc): each text once, bucketed in the shared folder.

    The buckets are the partitions of the grouping, so a task writes the files of its own only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(utf8(text_col), F.lit(b"")).alias("text"), F.col(id_col).cast("long").alias("i"))
    rows = rows.select(*_identity("text"), "text", "i")
    once = rows.groupBy("tid", "key").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("i").alias("first_doc"))
    name = f"arpent_texts_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = f"{shared_dir(spark)}/{name}"
    drop_later(drop_folder(spark, path))
    drop_later(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}"))
    writer = once.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, "tid", "key").sortBy("tid", "key").saveAsTable(name)
    return spark.table(name)


def _identity(text: str) -> list:
    key = F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32))
    return [F.xxhash64(key).alias("tid"), key.alias("key")]


def spans_of_texts(texts: DataFrame, length: int, keep_first: bool, hot: int) -> DataFrame:
    """(tid, key, spans): repeated windows between and inside distinct texts, unmerged."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, h, a, b, again = anchors_of_many(batch.column(2).to_pylist(), length)
        ids = [batch.column(k).take(pa.array(own)) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *ids, pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(again)], ["anchor", "tid", "key", "a", "b", "again"])

    found = materialise(map_columns(texts.select("tid", "key", "text"), find, "anchor long, tid long, key binary, a long, b long, again boolean"), "anchors")
    total = found.count()
    often = materialise(found.groupBy("anchor").agg((F.count("*") + F.count_if("again")).alias("n")).where("n > 1").select("anchor", "n", F.ceil(F.col("n") / hot).alias("blocks")), "often")
    block = F.pmod(F.xxhash64("tid", "a"), "blocks")
    place = F.struct("a", "b", "anchor", block.alias("block"), "blocks", "again")
    places = _joined(found, often, ["anchor"], total).groupBy("tid", "key").agg(F.collect_list(place).alias("places"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "block", "blocks", "again", "tid", "key", "first_doc", "start", "context"]
        for whole in batches:
            for begin in range(0, whole.num_rows, 64):
                batch = whole.slice(begin, 64)
                listed = batch.column(4)
                at, row = listed.flatten(), np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy())
                a, b = (at.field(c).to_numpy() for c in ("a", "b"))
                texts, b = batch.column(3).to_pylist(), b + length
                context = [texts[k][i:j] for k, i, j in zip(row.tolist(), a.tolist(), b.tolist())]
                own = [batch.column(k).take(pa.array(row)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([at.field("anchor"), at.field("block"), at.field("blocks"), at.field("again"), *own, pa.array(a), pa.array(context, pa.binary())], names)

    around = texts.select("tid", "key", "first_doc", "text").join(places, ["tid", "key"]).select("tid", "key", "first_doc", "text", "places")
    schema = "anchor long, block long, blocks long, again boolean, tid long, key binary, first_doc long, start long, context binary"
    classed = materialise(_classed(around.mapInArrow(surround, schema), length, keep_first), "classed")
    inside = classed.where("h1 IS NULL").select("tid", "key", "start", "end")
    every = inside.unionByName(_between_blocks(classed.where("h1 IS NOT NULL"), keep_first))
    return every.groupBy("tid", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged_of_many(own: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of maximal runs; spans of one owner that touch are one run."""
    order = np.lexsort((start, own))
    own, start, end = own[order], start[order], end[order]
    far = np.int64(1 << 40)
    reach = np.maximum.accumulate(end + own * far)
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = start[1:] + own[1:] * far > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(own))[: len(first)] - 1
    return own[first], start[first], reach[last] - own[first] * far


@settled("solved")
def solved_texts(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", hot: int = 1024, with_text: bool = False) -> DataFrame:
    """For each distinct text: key, first_doc, sizes, spans and the digest (and bytes) of what is kept."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    keep_first = keep == "first"
    texts = _distinct_texts(docs, id_col, text_col)
    spans = materialise(spans_of_texts(texts, length, keep_first, hot), "spans")
    names = ["key", "first_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        listed = batch.column(4)
        sizes = listed.value_lengths().fill_null(0).to_numpy()
        at = listed.flatten()
        own, begin, end = merged_of_many(np.repeat(np.arange(len(sizes)), sizes), at.field("start").to_numpy(), at.field("end").to_numpy())
        cut = np.searchsorted(own, np.arange(len(sizes) + 1)).tolist()
        begin, end = begin.tolist(), end.tolist()
        for k, (key, first, text, copies) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            runs = list(zip(begin[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]]))
            if copies > 1 and not keep_first and len(text) >= length:
                runs = [(0, len(text))]
            at, parts = 0, []
            for a, b in runs:
                parts.append(text[at:a])
                at = b
            kept = b"".join([*parts, text[at:]])
            out.append((key, first, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    both = texts.join(spans, ["tid", "key"], "left")
    schema = "key binary, first_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return map_columns(both.select("key", "first_doc", "text", "copies", "spans"), run, schema)


def report(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", hot: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`."""
    solved = solved_texts(docs, length, keep, id_col, text_col, hot)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(utf8(text_col), F.lit(b"")).alias("text")).select("doc_id", *_identity("text"))
    both = ids.select("doc_id", "key").join(solved, "key")
    if keep == "none":
        return both.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    gone = (F.col("n_bytes") >= length) & ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
    return both.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
