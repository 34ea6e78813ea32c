"""Exact BPE token counts of every prefix of a text, by dynamic programming.

The encoding of a prefix ends with one token t, and what stands before t is encoded as that shorter
prefix is: so count[i] = count[i - len(t)] + 1, where t is the longest vocabulary entry ending at i
that may follow the last token of the shorter prefix, that is, no merge with a lower rank would
have joined across the border. An automaton over the vocabulary gives the entries that end at each
byte, longest first, in one pass, so a long piece costs no more for each byte than a short one.

`prefix_counts` gives one number for each prefix in characters; the largest prefix within a budget,
the count after truncation and the count of the whole text are look-ups. A prefix is split as a
text that ends there: a run of white space at its end is one piece, and a cut-off contraction is
two.

Defined results: null text counts as empty and has no tokens; repeated rows count alike; an empty
table gives an empty table; other columns are ignored.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .common import map_columns, per_process


SHORT = 63  #: characters of a piece whose counts fit bytes
HEAD = 5


class PrefixCounter:
    """Counts for the vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str, pattern: str, cache_pieces: int = 400_000):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(s): k for s, k in spec["model"]["vocab"].items() if s not in self.special}
        self._build_automaton()
        self.join: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = self.vocab[raw(a)], self.vocab[raw(b)]
            whole = self.vocab[raw(a) + raw(b)]
            self.join.setdefault((left, right), len(self.join))
            self.parts.setdefault(whole, (left, right))
        self.made = {w: self.join[p] for w, p in self.parts.items()}  # the step that makes a token
        self.split = regex.compile(pattern)
        self.runs = regex.compile(r"\s{2,}")
        self.cuts = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.limit = cache_pieces
        self.pairs: list[dict[int, bool]] = [{} for _ in range(max(self.vocab.values()) + 1)]
        self.known_pairs = 0
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.heads: dict[bytes, tuple[list[int], list[int], int]] = {}  # pieces that begin alike share so much
        for whole in ("'re", "'ve", "'ll"):  # a prefix of these is an apostrophe and a letter
            counts = self._counts(whole)
            self.cache[whole] = bytes([1, 2, counts[-1]])

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side.

        Walks back through the merges that made both. At any time the last symbol of the left and
        the first symbol of the right one stand at the border; if they merge before the next merge
        on either side takes one of them, the border would have gone.
        """
        a, b = left, right
        taken_a = taken_b = len(self.join) + 1  # the step at which the symbol at the border is taken
        apart = True
        while True:
            step = self.join.get((a, b))
            # steps run in rank order; at equal steps the leftmost pair goes first
            if step is not None and step < taken_a and step <= taken_b:
                apart = False
                break
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a >= made_b:
                taken_a, a = made_a, self.parts[a][1]
            else:
                taken_b, b = made_b, self.parts[b][0]
        self.known_pairs += 1
        if self.known_pairs > 2_000_000:
            self.known_pairs = 0
            for known in self.pairs:
                known.clear()
        self.pairs[left][right] = apart
        return apart

    def _build_automaton(self) -> None:
        """States are prefixes of vocabulary entries; `outs` has the entries a state ends with, longest first."""
        self.steps, self.fail, own = {}, [0], [None]
        for t, k in self.vocab.items():
            state = 0
            for byte in t:
                edge = state << 8 | byte
                state = self.steps.setdefault(edge, len(self.fail))
                if state == len(self.fail):
                    self.fail.append(0)
                    own.append(None)
            own[state] = (len(t), k)
        self.outs: list[tuple] = [()] * len(own)
        level = [(0, 0, 0)]  # (state, its parent, byte)
        follow: list[list[tuple[int, int]]] = [[] for _ in own]
        for edge, child in self.steps.items():
            follow[edge >> 8].append((edge & 255, child))
        self.jumps: dict[int, int] = {}  # steps, and what follows from them by falling back
        while level:
            for state, parent, byte in level:
                if parent:
                    self.fail[state] = self._fall(self.fail[parent], byte)
                self.outs[state] = ((own[state],) if own[state] else ()) + (self.outs[self.fail[state]] if state else ())
            level = [(child, state, byte) for state, _, _ in level for byte, child in follow[state]]

    def _fall(self, state: int, byte: int) -> int:
        while True:
            found = self.steps.get(state << 8 | byte)
            if found is not None:
                return found
            if not state:
                return 0
            state = self.fail[state]

    def _jump(self, edge: int) -> int:
        if len(self.jumps) > 2_000_000:
            self.jumps.clear()
        found = self.jumps[edge] = self._fall(edge >> 8, edge & 255)
        return found

    def _counts(self, piece: str) -> list[int]:
        """The counts of all prefixes of one piece, in characters."""
        raw = piece.encode("utf-8", "replace")
        known = self.heads.get(raw[:HEAD])
        if known:
            counts, lasts, state = known[0].copy(), known[1].copy(), known[2]
        else:
            counts, lasts, state = [], [], 0
        pairs, jumps, outs = self.pairs, self.jumps, self.outs
        for at in range(len(counts), len(raw)):
            if at == HEAD and not known:
                self.heads[raw[:HEAD]] = counts.copy(), lasts.copy(), state
            byte = raw[at]
            edge = state << 8 | byte
            state = jumps.get(edge)
            if state is None:
                state = self._jump(edge)
            for size, token in outs[state]:
                before = at - size
                if before < 0:
                    counts.append(1)
                    lasts.append(token)
                    break
                last = lasts[before]
                may = pairs[last].get(token)
                if may or (may is None and self._apart(last, token)):
                    counts.append(counts[before] + 1)
                    lasts.append(token)
                    break
        if len(raw) == len(piece):
            return counts
        at, out = 0, []
        for char in piece:
            at += len(char.encode("utf-8", "replace"))
            out.append(counts[at - 1])
        return out

    def _piece(self, piece: str) -> bytes:
        """The counts of a piece of at most SHORT characters, one byte each."""
        found = bytes(self._counts(piece))
        if len(self.cache) >= self.limit:
            self._reset()
        self.cache[piece] = found
        return found

    def _long(self, piece: str) -> np.ndarray:
        return np.array(self._counts(piece), dtype=np.uint32) if len(piece) > SHORT else np.frombuffer(self.cache.get(piece) or self._piece(piece), dtype=np.uint8)

    def _plain(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Counts of all prefixes of a text without special tokens."""
        pieces = self.split.findall(text) if pieces is None else pieces
        if not pieces:
            return np.empty(0, dtype=np.int64)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        if sizes.max() > SHORT:
            inner = np.concatenate(list(map(self._long, pieces)))
        else:
            found = list(map(self.cache.get, pieces))
            if None in found:
                found = [f or self._piece(p) for f, p in zip(found, pieces)]
            inner = np.frombuffer(b"".join(found), dtype=np.uint8)
        each = inner[np.cumsum(sizes) - 1].astype(np.int64)
        out = inner + np.repeat(np.cumsum(each) - each, sizes)
        for run in self.runs.finditer(text):
            base = out[run.start() - 1] if run.start() else 0
            out[run.start() : run.end()] = base + self._long(run[0])
        return out

    def prefix_counts_of(self, texts: list[str | None], block: int = 1 << 20) -> Iterator[np.ndarray]:
        """The counts of many texts. New pieces of a block of texts are met in their order, so that
        neighbours are alike and what they need is at hand."""
        held, size = [], 0

        def solve() -> Iterator[np.ndarray]:
            split = [None if self.cuts and self.cuts.search(t) else self.split.findall(t) for t in held]
            new = set().union(*filter(None, split)) - self.cache.keys()
            for p in sorted(new):
                if len(p) <= SHORT:
                    self._piece(p)
            for text, pieces in zip(held, split):
                yield self.prefix_counts(text) if pieces is None else self._plain(text, pieces)

        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= block:
                yield from solve()
                held, size = [], 0
        yield from solve()

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """counts[i]: tokens of the first i + 1 characters."""
        text = text or ""
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        out, base, at = [], 0, 0
        for cut in self.cuts.finditer(text):
            part = self._plain(text[at : cut.start()])
            out.append(base + part)
            for end in range(cut.start() + 1, cut.end()):  # inside: the marker is ordinary text yet
                out.append(np.array([base + self._plain(text[at:end])[-1]]))
            base += (int(part[-1]) if len(part) else 0) + 1
            out.append(np.array([base]))
            at = cut.end()
        out.append(base + self._plain(text[at:]))
        return np.concatenate(out)

    @staticmethod
    def longest_within(counts: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens."""
        fits = np.flatnonzero(counts <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


def prefix_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, counts): the stored array answers any later question about prefixes."""
    return _mapped(docs, path, pattern, id_col, text_col, None)


def token_budget(docs: DataFrame, path: str, pattern: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars), looked up in the prefix counts."""
    return _mapped(docs, path, pattern, id_col, text_col, budget)


def _mapped(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, budget: int | None) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = per_process(("prefix", path, pattern), lambda: PrefixCounter(path, pattern))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        size = pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64())
        if budget is None:
            return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(list(counter.prefix_counts_of(texts)), pa.list_(pa.int64()))], ["doc_id", "n_bytes", "counts"])
        total, fit = [], []
        for c in counter.prefix_counts_of(texts):
            total.append(int(c[-1]) if len(c) else 0)
            fit.append(PrefixCounter.longest_within(c, budget))
        arrays = [batch.column(0), size, pa.array(total, pa.int64()), pa.array([t > budget for t in total], pa.bool_()), pa.array(fit, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, counts array<long>" if budget is None else "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_columns(narrow, run, schema, rows=256)
