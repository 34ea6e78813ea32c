"""Unigram language model over subword lattices.

The pieces of an existing vocabulary spell every word, with a leading border mark; a text is its
words and an end. The probability of a spelling is the product of the weights of its pieces, and a
word's is the sum over all its segmentations, by a forward recursion in log space. No piece crosses
a border, so each distinct word is scored once, whatever its count.

The scores that come with the vocabulary are merge ranks (an order, not logarithms of
probabilities), so they only shape the prior: 1 / (rank + 10), normalised. Weights are re-estimated
on the training words by one round of expectation maximisation over the same lattices. Pieces that can't occur
(upper case A-Z, inner borders) get no weight; the 256 byte pieces spell any other character, so
every text has a positive probability.

Training words are entries of the lattice themselves: a discount D of each word's count is what the
spelling gets, P(w) = max(c - D, 0) / N + D * V / N * spelling(w). Training documents of one class
(here: one language, at most `max_classes`, the most frequent ones; all others are one class) give a
distribution of their own, discounted in the same way in favour of P. A table without that column
has one class.
The class of a text is never looked at when it is scored: its probability is the mixture over
classes, p(class) * product of P(w | class), and n words before the end follow a geometric law.

Flow: texts become postings (word, chunk of documents, rows and counts), written once; counts by
word; the lattice pass over distinct words; a join of postings with word scores, which Spark can
split where a word is hot; sums by chunk. Nothing but one number for each piece reaches the driver.

Defined results: null text counts as empty and scores the end piece alone; repeated rows are scored
each; rows without an id are hashed as empty text, so they are held out; without training rows the prior is used and
nothing is known; an empty table gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, settled, utf8

BORDER = "▁"
LOG10 = np.log(10.0)
_SLOT_BITS = 20


def read_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, prior, byte piece of each byte) of a sentencepiece model, usable pieces only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, rank, byte_at = [], [], np.full(256, -1)
    for k in range(model.get_piece_size()):
        text, score = model.id_to_piece(k), model.get_score(k)
        if model.is_unknown(k) or model.is_control(k):
            continue
        if model.is_byte(k):
            byte_at[int(text[3:5], 16)] = len(pieces)
            rank.append(model.get_piece_size())
        elif score < -1e6 or BORDER in text[1:] or any("A" <= c <= "Z" for c in text):
            continue
        else:
            rank.append(max(0.0, -score))
        pieces.append(text)
    prior = 1.0 / (np.array(rank, dtype=float) + 10.0)
    return pieces, prior / prior.sum(), byte_at


class Lattice:
    """Forward and backward sums for many words at once."""

    def __init__(self, pieces: list[str], byte_at: np.ndarray, weights: np.ndarray):
        self.byte_at, self.n = byte_at, len(pieces)
        with np.errstate(divide="ignore"):
            self.logp = np.log(weights)
        spelled = {t: k for k, t in enumerate(pieces) if k not in set(byte_at.tolist())}
        self.longest = max(map(len, spelled))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
        keys = {self._key(t): k for t, k in spelled.items()}
        if len(keys) != len(spelled):
            raise ValueError("pieces collide")
        self.tables = []
        left = dict(keys)
        for turn in range(16):
            if not left:
                break
            by = np.uint64((0xD6E8FEB86659FD93 + 2 * turn * 0x5851F42D4C957F2D) & ((1 << 64) - 1) | 1)
            key, at, rest = np.zeros(1 << _SLOT_BITS, dtype=np.uint64), np.full(1 << _SLOT_BITS, -1, dtype=np.int32), {}
            names = np.array(list(left), dtype=np.uint64)
            for h, slot in zip(left, (names * by) >> np.uint64(64 - _SLOT_BITS)):
                if at[slot] < 0:
                    key[slot], at[slot] = h, left[h]
                else:
                    rest[h] = left[h]
            self.tables.append((by, key, at))
            left = rest
        self.bytes_of: dict[int, float] = {}

    def _key(self, text: str) -> int:
        out = 0
        for k, c in enumerate(text):
            out = (out + (ord(c) + 1) * int(self.power[k])) & ((1 << 64) - 1)
        return out or 1

    def _find(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), -1, dtype=np.int32)
        for by, keys, at in self.tables:
            slot = (key * by) >> np.uint64(64 - _SLOT_BITS)
            hit = keys[slot] == key
            out[hit] = at[slot[hit]]
        return out

    def _by_bytes(self, code: int) -> float:
        found = self.bytes_of.get(code)
        if found is None:
            found = float(self.logp[self.byte_at[list(chr(code).encode("utf-8", "replace"))]].sum())
            self.bytes_of[code] = found
        return found

    def edges(self, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, rows, pieces, log weight) for words of one length; piece -1: by bytes."""
        n, length = codes.shape
        out = []
        value = (codes.astype(np.uint64) + np.uint64(1)).T.copy()
        for i in range(length):
            key = np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                key = key + value[j - 1] * self.power[j - 1 - i]
                found = self._find(key)
                rows = np.flatnonzero(found >= 0)
                if len(rows):
                    at = found[rows]
                    out.append((i, j, rows, at, self.logp[at]))
            kinds, where = np.unique(codes[:, i], return_inverse=True)
            weight = np.array([self._by_bytes(int(c)) for c in kinds])[where]
            out.append((i, i + 1, np.arange(n), np.full(n, -1, dtype=np.int32), weight))
        return out

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        alpha = np.full((codes.shape[1] + 1, codes.shape[0]), -np.inf)
        alpha[0] = 0.0
        for i, j, rows, _, weight in edges:  # ordered by start, so alpha[i] is complete
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + weight)
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's sum over segmentations."""
        out = np.zeros(len(words))
        for rows, codes in _by_length(words):
            out[rows] = self.forward(codes, self.edges(codes))[-1]
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in `words`, each counted so many times."""
        total = np.zeros(self.n)
        for rows_in, codes in _by_length(words):
            edges = self.edges(codes)
            alpha = self.forward(codes, edges)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0.0
            used, uses, spelled, shares = [], [], [], []
            for i, j, rows, at, weight in reversed(edges):  # ordered by start, so beta[j] is complete
                there = weight + beta[j, rows]
                beta[i, rows] = np.logaddexp(beta[i, rows], there)
                use = np.exp(alpha[i, rows] + there - alpha[-1, rows]) * times[rows_in[rows]]
                if at[0] >= 0:
                    used.append(at)
                    uses.append(use)
                else:
                    spelled.append(codes[:, i])
                    shares.append(use)
            if used:
                total += np.bincount(np.concatenate(used), np.concatenate(uses), minlength=self.n)
            kinds, where = np.unique(np.concatenate(spelled), return_inverse=True)
            for code, share in zip(kinds.tolist(), np.bincount(where, np.concatenate(shares)).tolist()):
                np.add.at(total, self.byte_at[list(chr(code).encode("utf-8", "replace"))], share)
        return total


def _by_length(words: list[str], block: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and code points, border mark first, of words of one length."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        step = max(1, block // (int(size[same[0]]) + 1))
        for start in range(0, len(same), step):
            rows = same[start : start + step]
            text = "".join(BORDER + words[k] for k in rows)
            yield rows, np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").reshape(len(rows), -1)


def _held_out(i: int | None) -> bool:
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0


_POSTINGS = "word binary, chunk long, n_train array<long>, at binary, n binary, ids array<long>"


def _flush(ids: list, kinds: np.ndarray, texts: list[list[bytes]], chunk: int, n_kinds: int) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    learn = np.array([not _held_out(i) for i in ids], dtype=bool)
    every = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    key = every.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    key, times = np.unique(key, return_counts=True)
    word, row = np.divmod(key, len(ids))
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    train = np.zeros((len(begin) + 1, n_kinds), dtype=np.int64)
    for k in range(n_kinds):
        mine = learn & (kinds == k)
        train[-1, k] = mine.sum()
        if len(begin):
            train[:-1, k] = np.add.reduceat(times * mine[row], begin)
    row2, times4 = row.astype("<u2").tobytes(), times.astype("<u4").tobytes()
    edge = [*begin.tolist(), len(row)]
    spans = list(zip(edge, edge[1:]))
    offsets = pa.array(np.arange(len(train) + 1, dtype=np.int32) * n_kinds)
    columns = [
        pa.array([*every.dictionary.to_pylist(), None], pa.binary()),
        pa.array(np.full(len(spans) + 1, chunk)),
        pa.ListArray.from_arrays(offsets, pa.array(train.ravel())),
        pa.array([*(row2[2 * a : 2 * b] for a, b in spans), None], pa.binary()),
        pa.array([*(times4[4 * a : 4 * b] for a, b in spans), sizes.astype("<u4").tobytes()], pa.binary()),
        pa.array([*[None] * len(spans), ids], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, ["word", "chunk", "n_train", "at", "n", "ids"])


def postings(docs: DataFrame, classes: list[str], id_col: str, text_col: str, class_col: str, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row for each word of a chunk of texts, and one with null word that lists its documents."""
    number = {c: k for k, c in enumerate(classes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, kinds, texts, size = [], [], [], 0
        for batch in batches:
            for i, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(i)
                kinds.append(number.get(kind, 0))
                texts.append((text or b"").lower().split())
                size += len(text or b"")
                if size >= chunk_bytes or len(ids) >= 4096:
                    yield _flush(ids, np.array(kinds), texts, chunk, len(classes))
                    chunk, ids, kinds, texts, size = chunk + 1, [], [], [], 0
        if ids:
            yield _flush(ids, np.array(kinds), texts, chunk, len(classes))

    narrow = docs.select(F.col(id_col).cast("long").alias("i"), utf8(text_col).alias("t"), F.coalesce(F.col(class_col).cast("string"), F.lit("")).alias("k"))
    return narrow.mapInArrow(run, _POSTINGS)


def _texts(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def learn_weights(counts: DataFrame, path: str, rounds: int = 1, prior_count: float = 1000.0) -> np.ndarray:
    """Weights of the pieces from (word, c): each training word once, as discounts are."""
    pieces, prior, byte_at = read_pieces(path)
    weights = prior
    known = counts.where("c > 0").select("word")
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(pieces, byte_at, weights)
            total = np.zeros(lattice.n)
            for batch in batches:
                total += lattice.expected(_texts(batch.column(0)), np.ones(batch.num_rows))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        summed = known.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.zeros(len(pieces))
        for r in summed.collect():  # one row for each piece at most
            uses[r["piece"]] = r["uses"]
        weights = uses + prior_count * prior
        weights = weights / weights.sum()
    return weights


@settled("scores")
def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", class_col: str = "lang", rounds: int = 1, max_classes: int = 32) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`."""
    if class_col not in docs.columns:
        docs = docs.withColumn(class_col, F.lit(""))
    learned = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 != 0
    labels = docs.where(learned).groupBy(F.coalesce(F.col(class_col).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    often = [r["k"] for r in labels.orderBy(F.desc("n"), "k").limit(max_classes + 1).collect()]
    classes = sorted(often) or [""]
    if len(often) > max_classes:
        classes = ["", *sorted(k for k in often[:max_classes] if k)]  # rarer ones are counted with those without a label
    posted = materialise(postings(docs, classes, id_col, text_col, class_col), "postings")
    words = posted.where("word IS NOT NULL")
    of_class = [F.coalesce(F.sum(F.get("n_train", F.lit(k))), F.lit(0)).alias(f"c{k}") for k in range(len(classes))]
    names_c = [f"c{k}" for k in range(len(classes))]
    summed = words.groupBy("word").agg(*of_class)
    counts = materialise(summed.select("word", sum((F.col(c) for c in names_c), F.lit(0)).alias("c"), *names_c), "counts")
    ends = [int(x) for x in posted.where("word IS NULL").agg(*of_class).first()]

    def facts(c: str) -> tuple[int, int, float]:
        total, kinds, once, twice = counts.agg(F.coalesce(F.sum(c), F.lit(0)), *(F.count_if(x) for x in (F.col(c) > 0, F.col(c) == 1, F.col(c) == 2))).first()
        return total, kinds, once / (once + 2 * twice) if once and twice else 0.5

    n_words, n_kinds, discount = facts("c")
    by_class = [facts(c) for c in names_c]
    n_ends = sum(ends)
    n_all, kinds = n_words + n_ends, n_kinds + (n_ends > 0)
    weights = learn_weights(counts, path, rounds)
    pieces, _, byte_at = read_pieces(path)
    below = float(n_all + 0.1 * (kinds + 1))
    spelled = discount * n_kinds / n_words if n_words else 1.0
    names_p = [f"p{k}" for k in range(len(classes))]

    def lattice_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, byte_at, weights)
        for batch in batches:
            c = batch.column(1).to_numpy().astype(float)
            every = lattice.log_probability(_texts(batch.column(0))) + np.log(spelled)
            out = []
            with np.errstate(divide="ignore"):
                every = np.logaddexp(every, np.log(np.maximum(c - discount, 0.0) / max(n_words, 1)))
                for k, (n, v, d) in enumerate(by_class):
                    own = batch.column(2 + k).to_numpy().astype(float)
                    out.append(np.logaddexp(every + np.log(d * v / n), np.log(np.maximum(own - d, 0.0) / n)) if n else every)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, out)], ["word", "c", *names_p])

    schema = ", ".join(["word binary, c long", *(f"{c} double" for c in names_p)])
    scored = materialise(counts.mapInArrow(lattice_pass, schema), "scored")
    joined = words.select("word", "chunk", "at", "n").join(scored, "word").select("chunk", "at", "n", "c", *names_p)
    columns = ["known", "base", *names_p]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, int] = {}
        sums = np.zeros((len(columns), 0))
        seen = np.zeros(0, dtype=bool)

        def give() -> pa.RecordBatch:
            rows = []
            for chunk, slot in slots.items():
                part = slice(slot * 4096, slot * 4096 + 4096)
                at = np.flatnonzero(seen[part])
                rows.append((chunk, at.astype("<u2").tobytes(), *(x[part][at].tobytes() for x in sums)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * (1 + len(columns))))], ["chunk", "at", *columns])

        for batch in batches:
            chunk, own = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            slot = np.array([slots.setdefault(int(c), len(slots)) for c in chunk])[own]
            at, n = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            size = np.fromiter(map(len, at), dtype=np.int64, count=len(at)) // 2
            row = np.frombuffer(b"".join(at), dtype="<u2") + np.repeat(slot * 4096, size)
            times = np.frombuffer(b"".join(n), dtype="<u4").astype(float)
            room = len(slots) * 4096
            if sums.shape[1] < room:
                sums = np.concatenate((sums, np.zeros((len(columns), room - sums.shape[1]))), axis=1)
                seen = np.concatenate((seen, np.zeros(room - len(seen), dtype=bool)))
            seen[row] = True
            c = batch.column(3).to_numpy()
            each = [c > 0, np.log10((c + 0.1) / below), *(p.to_numpy() for p in batch.columns[4:])]
            for total, value in zip(sums, each):
                total += np.bincount(row, times * np.repeat(value, size), minlength=sums.shape[1])
            if len(slots) >= 256:
                yield give()
                slots.clear()
                sums, seen = sums[:, :0], seen[:0]
        if slots:
            yield give()

    kinds_of = ", ".join(f"{c} binary" for c in ["at", *columns])
    parts = joined.mapInArrow(add_up, f"chunk long, {kinds_of}")
    heads = posted.where("word IS NULL").select("chunk", "ids", "n")
    empty = F.lit(None).cast("binary")
    both = parts.select("chunk", F.lit(None).cast("array<long>").alias("ids"), empty.alias("n"), "at", *columns).unionByName(
        heads.select("chunk", "ids", "n", *(empty.alias(c) for c in ["at", *columns]))
    )
    end = (n_ends + 1.0) / (n_all + 2.0)
    end_base = float(np.log10((n_ends + 0.1) / below))
    share = np.log((np.array(ends) + 1.0) / (n_ends + len(classes)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, sums = None, None, None, None

        def give() -> pa.RecordBatch:
            k = len(ids)
            found = np.logaddexp.reduce([share[j] + sums[2 + j][:k] for j in range(len(classes))])
            found = found + sizes * np.log(1.0 - end) + np.log(end)
            arrays = [
                pa.array(ids, pa.int64()),
                pa.array([_held_out(i) for i in ids], pa.bool_()),
                pa.array(sizes.astype(np.int64) + 1),
                pa.array(sums[0][:k].astype(np.int64) + (n_ends > 0)),
                pa.array(np.full(k, n_all, dtype=np.int64)),
                pa.array(sums[1][:k] + end_base),
                pa.array(found / LOG10),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk"] != now:
                    if now is not None:
                        yield give()
                    now, sums = r["chunk"], [np.zeros(4096) for _ in columns]
                if r["ids"] is not None:
                    ids, sizes = r["ids"], np.frombuffer(r["n"], dtype="<u4")
                else:
                    at = np.frombuffer(r["at"], dtype="<u2")
                    for total, name in zip(sums, columns):
                        total[at] += np.frombuffer(r[name])
        if now is not None:
            yield give()

    ordered = both.repartition("chunk").sortWithinPartitions("chunk", F.xxhash64("at", "base"))
    return ordered.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
