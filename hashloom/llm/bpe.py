"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding runs the tokenizers library with a model built from a rank file.
Each id stands for a byte string; offsets come from the byte lengths, and
characters from the places where a UTF-8 character starts, so a token that
holds part of a character gets the whole character's place. Decoding looks the
ids' bytes up and joins them before anything is read as UTF-8, so characters
split over tokens come back whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import settle
from hashloom.llm.tokenizing import rank_encoder, text_slices, vocabulary_path


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def offsets_of(ids: np.ndarray, lengths: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token. A character split over tokens belongs to all of them."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    lead = (np.frombuffer(body, dtype=np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead)])
    begin = upto[starts] - np.where(np.append(lead, True)[starts], 0, 1)
    return begin, upto[ends]


def decoded(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def _arguments(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    return ranks or vocabulary_path("byte_bpe_multi_50k.tiktoken"), pattern or pre_token_pattern()


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, with_offsets: bool = True) -> DataFrame:
    """``doc_id, ids, starts, ends`` of each row of ``docs(doc_id, text)``.

    ``ids`` as the rank file gives them with no special tokens; ``starts`` and
    ``ends`` are character offsets, end exclusive, null unless ``with_offsets``.
    Null text is empty: no ids. Rows that repeat are encoded each.
    """
    path, pattern = _arguments(ranks, pattern)

    def run(batches):
        encoder, table = rank_encoder(path, pattern)
        lengths = np.array([len(t) for t in table])
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in text_slices(texts):
                part = [t or "" for t in texts[low:high]]
                ids = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in encoder.encode(part)]
                places = [offsets_of(i, lengths, t.encode()) for i, t in zip(ids, part, strict=True)] if with_offsets else [(None, None)] * len(part)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([docs_.slice(low, high - low).cast(pa.int64()), pa.array(ids, kind), pa.array([a for a, _ in places], kind), pa.array([b for _, b in places], kind)], ["doc_id", "ids", "starts", "ends"])

    settle(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, body`` (binary) of each row of ``encoded(doc_id, ids)``. Null ids give empty bytes; an id the file lacks is an error."""
    path, pattern = _arguments(ranks, pattern)

    def run(batches):
        _, table = rank_encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded(i or [], table) for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "body"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, body binary")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, then decoded from the ids alone, in one pass.

    Null text is empty. Rows that repeat are given each; an empty table gives no
    row; other columns are not read.
    """
    path, pattern = _arguments(ranks, pattern)

    def run(batches):
        encoder, table = rank_encoder(path, pattern)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in text_slices(texts):
                bodies = encoder.encode([t or "" for t in texts[low:high]])
                back = [hashlib.sha256(decoded(np.frombuffer(b, dtype="<u4").tolist(), table)).hexdigest() for b in bodies]
                yield pa.RecordBatch.from_arrays([docs_.slice(low, high - low).cast(pa.int64()), pa.array([len(b) // 4 for b in bodies], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in bodies]), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    settle(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
