"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters, lower-cased, with one space for all that is no letter, are hashed
to `DIMS` buckets. Document frequencies are counted over every labelled training document. The
weights are trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties)
on about `max_rows` training documents, chosen by a hash of the id: that bound is the only one. The
temperature that divides the scores is set on a fifth of these documents that training leaves out.
Prediction reads whole texts and nothing but texts.

Defined results: null texts and texts without a letter are `und` with score 0; labels that are null
are not learned from; without any label everything is `und`; ties between languages go to the first
in alphabetical order; rows without an id are held out; repeated rows are predicted alike; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_columns

DIMS = 1 << 15
_ROLES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


class Grams:
    """Buckets and counts of a text's n-grams."""

    def __init__(self):
        letter = np.zeros(0x110000, dtype=bool)
        for start in range(0, 0x110000, 0x1000):
            if not 0xD800 <= start < 0xE000:
                letter[start : start + 0x1000] = [chr(c).isalpha() for c in range(start, start + 0x1000)]
        self.letter = letter

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        if not text:
            return np.empty(0, dtype=np.int64), np.empty(0)
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        inside = self.letter[code]
        if not inside.any():
            return np.empty(0, dtype=np.int64), np.empty(0)
        code = np.where(inside, code, 32).astype(np.uint32)
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        code = np.concatenate((np.array([32], dtype=np.uint32), code[keep], np.array([32], dtype=np.uint32)))
        a = code * _ROLES[0]
        two = a[:-1] + code[1:] * _ROLES[1]
        three = two[:-1] + code[2:] * _ROLES[2]
        mixed = np.concatenate((a, two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x1B873593)))
        mixed ^= mixed >> np.uint32(15)
        mixed *= _ROLES[3]
        counts = np.bincount(mixed >> np.uint32(17), minlength=DIMS)
        at = np.flatnonzero(counts)
        return at, counts[at].astype(float)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x DIMS
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[at]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, epochs: int = 3) -> None:
    """Follow-the-regularised-leader; sets the weights and the bias of `model`."""
    n_lang = len(model.languages)
    z, n = np.zeros((n_lang, DIMS + 1)), np.zeros((n_lang, DIMS + 1))

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[:, at], n[:, at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, x, lang in rows:
            at, x = np.append(at, DIMS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(w @ x)
            p[lang] -= 1.0
            g = p[:, None] * x[None, :]
            grown = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(grown) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] = grown
    every = weights(np.arange(DIMS + 1))
    model.weights, model.bias = every[:, :DIMS].copy(), every[:, DIMS].copy()


def calibrate(z: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by a search on its logarithm."""
    if not len(z):
        return 1.0

    smooth = 1.0 / (len(z) + 2.0)  # keeps the scores of separable classes below one

    def loss(log_t: float) -> float:
        p = np.log(np.maximum(softmax(z / np.exp(log_t)), 1e-12))
        return -((1.0 - smooth) * p[np.arange(len(z)), truth] + smooth * p.mean(axis=1)).sum()

    grid = np.linspace(-4.0, 3.0, 141)
    return float(np.exp(grid[int(np.argmin([loss(t) for t in grid]))]))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, and how many texts there are; over all rows of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), np.zeros(DIMS + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = grams(text)
                total[at] += 1
                total[DIMS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(DIMS + 1, dtype=np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # at most DIMS + 1 rows
        out[bucket] = n
    return out[:DIMS], int(out[DIMS])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000, max_labels: int = 256) -> Model | None:
    """A model of the languages in `labelled`, or none if it holds no label.

    Of more than `max_labels` labels only the commonest are learned: a row of weights for each has to
    fit the driver and every task.
    """
    labelled = labelled.where(F.col(lang_col).isNotNull())
    common = labelled.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(max_labels)
    languages = sorted(r[0] for r in common.collect())
    if not languages:
        return None
    if len(languages) == max_labels:
        labelled = labelled.where(F.col(lang_col).isin(languages))
    df, total = document_frequencies(labelled, text_col)
    model = Model(languages, np.log((1.0 + total) / (1.0 + df)) + 1.0, np.zeros((len(languages), DIMS)), np.zeros(len(languages)))
    dice = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(dice < min(1.0, max_rows / total)).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = Grams()
        at, counts = zip(*map(grams, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
        arrays = [batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(arrays, ["i", "l", "at", "counts"])

    sample = map_columns(chosen, run, "i long, l string, at array<int>, counts array<float>", rows=4096).toArrow()
    rows = []
    for i, lang, at, counts in zip(sample["i"].to_pylist(), sample["l"].to_pylist(), sample["at"], sample["counts"]):
        at = at.values.to_numpy()
        if len(at):
            rows.append((i or 0, at, model.vector(at, counts.values.to_numpy().astype(float)), languages.index(lang)))
    rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0]))
    held, kept = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    train([r[1:] for r in kept or rows], model)
    if held and kept:
        model.temperature = calibrate(np.array([model.scores(r[1], r[2]) for r in held]), np.array([r[3] for r in held]))
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, and the column `keep` if one is named."""
    also = [keep] if keep else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *also)
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # languages x DIMS numbers
    held: list[tuple] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append((Grams(), shared.value and Model(**shared.value)))
        (grams, m), langs, scores = held[0], [], []
        for text in batch.column(1).to_pylist():
            at, counts = grams(text)
            if m is None or not len(at):
                langs.append("und")
                scores.append(0.0)
                continue
            p = softmax(m.scores(at, m.vector(at, counts)) / m.temperature)
            best = int(np.argmax(p))
            langs.append(m.languages[best])
            scores.append(float(p[best]))
        arrays = [batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *also, "lang_pred", "score"])

    schema = narrow.drop("text").schema.add("lang_pred", "string").add("score", "double")
    return map_columns(narrow, run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))
