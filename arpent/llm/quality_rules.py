"""Learned decision lists over text statistics.

Sequential covering: a rule is a conjunction of thresholds that grows by the condition with the
best FOIL gain on two thirds of the labelled rows and is pruned, last conditions first, by its
value (p - n) / (p + n) on the other third. Rows that it covers are set aside and the next rule is
grown. The ordered list becomes one Spark `CASE WHEN`. Rules reject; what no rule covers is kept.

The statistics cover every document and whole texts. Only the fit reads a sample: at most about
`max_rows` labelled rows, chosen by a hash of the id, the same on every run.

Defined results: null text has no words and fails the base rule; without labels, or with labels of
one class, the list is empty and the base rule alone decides; a row repeated in the labels counts
each time; null labels are left out; other columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, utf8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct"]
_DROP = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_digits": b"0123456789",
    "n_marks": b"!?",
}


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    raw = text or b""
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    size = len(joined)
    marks = {name: size - len(joined.translate(None, drop)) for name, drop in _DROP.items()}
    return (len(words), chars, marks["n_symbols"], duplicates, repeated, lines, marks["n_upper"], marks["n_lower"], marks["n_digits"], marks["n_marks"], len(set(words)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return map_columns(narrow, run, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


def _share(top: str, below: str) -> Column:
    return F.coalesce(F.col(top) / F.nullif(F.col(below), F.lit(0)), F.lit(0.0))


def ratios() -> dict[str, Column]:
    """What thresholds are set on; all are JVM expressions over the counts."""
    return {
        "mean_word": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "lower_share": _share("n_lower", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "mark_share": _share("n_marks", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] <= self.value

    def column(self) -> Column:
        c = ratios()[self.feature]
        return c >= F.lit(self.value) if self.at_least else c <= F.lit(self.value)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, inside: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest FOIL gain among the rows that the rule still covers."""
    p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
    base = math.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for name in sorted(x):
        v = x[name][inside]
        order = np.argsort(v, kind="stable")
        v, t = v[order], y[inside][order]
        edge = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edge):
            continue
        p_low, total = np.cumsum(t)[edge - 1], np.arange(1, len(v) + 1)[edge - 1]
        for at_least, p, all_ in ((False, p_low, total), (True, p0 - p_low, len(v) - total)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / all_) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                middle = float((v[edge[k] - 1] + v[edge[k]]) / 2)
                best, found = float(gain[k]), Condition(name, at_least, middle)
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune_row: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9) -> list[Rule]:
    """Ordered rules for the rows with `bad`; stops at a rule that is not precise enough when pruned."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < max_rules:
        grow, prune = left & ~prune_row, left & prune_row
        if not bad[grow].any() or bad[grow].all():
            break
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (~bad[inside]).any():
            gain, condition = _best_condition(x, bad, inside)
            if condition is None:
                break
            rule += (condition,)
            inside &= condition.holds(x)
        if not rule:
            break

        def worth(r: Rule) -> tuple[float, float]:
            c = _covers(r, x, len(bad)) & prune
            p, n = int(bad[c].sum()), int((~bad[c]).sum())
            return (p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0

        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda r: (worth(r)[0], -len(r)))
        covered = _covers(rule, x, len(bad)) & left
        precise = bad[covered].mean() if covered.any() else 0.0
        if not covered.any() or precise < min_precision or (prune.any() and bad[prune].any() and worth(rule)[1] < min_precision):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: false where a rule rejects."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        condition = F.lit(True)
        for c in rule:
            condition = condition & c.column()
        out = out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sampled(labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """(doc_id, bad) of about `max_rows` labels, chosen by a hash of the id."""
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col) == 0).alias("bad")).where("doc_id IS NOT NULL AND bad IS NOT NULL")
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return truth.where(dice < min(1.0, max_rows / max(1, truth.count())))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 20_000, base: bool = True) -> list[Rule]:
    """Rules learned from statistics of labelled rows; with `base`, of those that pass the base rule."""
    chosen = sampled(labels, label_col, max_rows)
    named = ratios()
    rows = (stats.where(~base_failed()) if base else stats).join(chosen, "doc_id").select("doc_id", "bad", *(c.alias(k) for k, c in named.items()))
    frame = rows.toPandas().sort_values(["doc_id", "bad"], kind="stable")
    if not len(frame):
        return []
    x = {k: frame[k].to_numpy(dtype=float) for k in named}
    prune_row = np.array([(int(i) * 2654435761 >> 7) % 3 == 0 for i in frame["doc_id"]])
    return learn(x, frame["bad"].to_numpy(dtype=bool), prune_row)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, base: bool = True) -> DataFrame:
    """All counts, `base_failed` and `kept` for each row of `docs`; without `base` the list alone decides."""
    stats = materialise(statistics(docs, id_col, text_col), "stats")
    kept = verdict(fit(stats, labels, max_rows=max_rows, base=base))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & kept if base else kept)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> DataFrame:
    """`docs` without the rows that the learned list rejects; each row is judged by its own text.

    The base rule is left out here: labelled good texts may be short, and the list learns what
    repetition the labels reject. Counts travel with their row, so no row is joined or shuffled. The ids
    of the labelled sample, about `max_rows`, are broadcast.
    """
    ids = F.broadcast(sampled(labels, label_col, max_rows).select("doc_id").distinct())
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    keep = verdict(fit(statistics(labelled), labels, label_col, max_rows, base=False))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).field(at).cast(pa.binary()).to_pylist()
        found = np.array([statistics_of(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], ["row", *COUNTS])

    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return map_columns(rows, run, schema).where(keep).select("row.*")
