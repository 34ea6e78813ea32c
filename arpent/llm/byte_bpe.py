"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding.

The tokenizer is built from a rank file: every byte maps to a printable character, merges follow
from the ranks, and the split pattern is a parameter. It has no special tokens, so strings such as
an end marker inside a text are ordinary text. Offsets are given in characters of the text; a token
that holds a part of a character has the span of that character. Decoding reverses the byte table:
tokens become bytes, and only the joined bytes become text, so split characters come out whole.

Defined results: null text counts as empty and has no ids, repeated rows are encoded alike, an
empty table gives an empty table, other columns of the input are kept by `encode` and ignored by
the digest.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, per_process


def byte_alphabet() -> list[str]:
    """The character for each byte: itself if printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in pairs]


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of several bytes: what is left when all earlier merges are done."""
    rank = {t: k for k, t in enumerate(tokens)}
    out = []
    for limit, token in enumerate(tokens):
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], limit))
            if rank.get(parts[best] + parts[best + 1], limit) >= limit:
                raise ValueError(f"token {limit} does not follow from earlier merges")
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBpe:
    """Encoder and decoder for one rank file; built once for each Python process."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokens = read_ranks(path)
        chars = byte_alphabet()
        spell = lambda raw: "".join(map(chars.__getitem__, raw))
        vocab = {spell(t): k for k, t in enumerate(self.tokens)}
        self.model = Tokenizer(BPE(vocab=vocab, merges=[(spell(a), spell(b)) for a, b in merges_of(self.tokens)]))
        self.model.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_with_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        return [(e.ids, e.offsets) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; a character cut off at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _lazy(path: str, pattern: str):
    def make() -> ByteBpe:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        return ByteBpe(path, pattern)

    return lambda: per_process(("bpe", path, pattern), make)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """`docs` with `token_ids` (and `token_starts`, `token_ends`, in characters of the text)."""
    get = _lazy(path, pattern)
    names = ["token_ids", *["token_starts", "token_ends"] * offsets]
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema
    for name in names:
        schema = schema.add(name, "array<int>")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(kept.index(text_col)).to_pylist()]
        if offsets:
            found = get().encode_with_offsets(texts)
            new = [[ids for ids, _ in found], [[a for a, _ in spans] for _, spans in found], [[b for _, b in spans] for _, spans in found]]
        else:
            new = [get().encode(texts)]
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int32())) for x in new)], [*kept, *names])

    return map_columns(docs.select(*kept), run, schema, rows=64)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """`encoded` with the column `decoded`: the bytes of its ids."""
    get = _lazy(path, pattern)
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [get().decode_bytes(ids or []) for ids in batch.column(kept.index(ids_col)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*kept, "decoded"])

    return map_columns(encoded.select(*kept), run, encoded.select(*kept).schema.add("decoded", "binary"), rows=64)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text in one pass."""
    get = _lazy(path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = get()
        counts, ids_hash, raw_hash = [], [], []
        for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
            raw_hash.append(hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
        arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(raw_hash, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_columns(narrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=64)
