"""Packing along a space-filling curve: near documents lie near each other in the training sequences."""

from __future__ import annotations

import array
import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import settle, slices, small_batches, trim

SEQUENCE, END_ID, DIMS, BITS, HASHED = 2048, 1, 3, 10, 512
#: Bytes of ids that one range of the curve should hold at most or so.
RANGE_BYTES = 8 << 20


class Encoder:
    """Ids of the byte-level BPE: its fast implementation, or the reference one for texts that hold a special string."""

    def __init__(self, full_file: str, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast, self.full_file = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), full_file
        with open(full_file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]

    @functools.cached_property
    def full(self):
        """The reference implementation, which most workers never need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.full_file)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as 16-bit numbers."""
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                ids = self.full.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(array.array("H", ids).tobytes())
        return out


@functools.cache
def encoder(tokenizer: str) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(f"{tokenizer}.json"), public_tokenizers.path(f"{tokenizer}.tiktoken"), public_tokenizers.PATTERN)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve positions of integer points (n, d) with `bits` bits in each coordinate."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of the higher bits
        p = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (16-bit, with the final id 1) and the projected hashed vector p0, p1, p2 of each row."""
    axes = np.random.default_rng(7).standard_normal((HASHED, DIMS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for part in slices(b, 1, 500):
                ids = [x + b"\1\0" for x in enc.encode_batch([t or "" for t in part.column(1).to_pylist()])]
                hashed = np.zeros((len(ids), HASHED), np.float32)
                for i, x in enumerate(ids):
                    slot = (np.frombuffer(x, np.uint16).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(23)
                    hashed[i] = np.sqrt(np.bincount(slot, minlength=HASHED))
                p = (hashed / np.linalg.norm(hashed, axis=1, keepdims=True)) @ axes
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), *(pa.array(p[:, k].astype(float)) for k in range(DIMS))], ["doc_id", "ids", *(f"p{k}" for k in range(DIMS))])
        trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary, " + ", ".join(f"p{k} double" for k in range(DIMS)))


def curve_key(coded: DataFrame) -> tuple[Column, int]:
    """Hilbert key of p0, p1, p2, each scaled between its 1st and 99th percentile over all rows; bytes of all ids."""
    *ends, size = coded.agg(*(F.percentile_approx(f"p{k}", [0.01, 0.99], 1000).alias(f"p{k}") for k in range(DIMS)), F.sum(F.length("ids"))).first()
    ends = [tuple(e) if e else (0.0, 1.0) for e in ends]

    @F.pandas_udf("bigint")
    def key(*cols):
        import pandas as pd

        scaled = [np.clip((c.to_numpy() - lo) / max(hi - lo, 1e-9), 0, 1) * ((1 << BITS) - 1) for c, (lo, hi) in zip(cols, ends, strict=True)]
        return pd.Series(hilbert(np.stack(scaled, axis=1).astype(np.int64)))

    return key(*(F.col(f"p{k}") for k in range(DIMS))), size or 0


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text), tokenized whole, in sequences of at most `length` (a power of two).

    Rows are range-sorted by the Hilbert key of their projected vector (ties by a hash of doc_id and length, then doc_id), in
    as many ranges as shuffle partitions, or as keep a range near RANGE_BYTES. Each
    range's ids, in that order, fill sequences of `length`; what is left at a range's end fills sequences of lesser
    powers of two, so nothing is padded. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ids (array) if with_ids. Null and empty texts are the end id alone; a row that repeats another is packed too;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    coded = settle(encode(docs, tokenizer))
    tie, (curve, size) = F.xxhash64("doc_id", F.length("ids")), curve_key(coded)
    keyed = coded.select("doc_id", "ids", curve.alias("curve"), tie.alias("tie"))
    ranges = keyed.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)), "curve", "tie", "doc_id").sortWithinPartitions("curve", "tie", "doc_id", F.crc32("ids"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        waiting: list[tuple[int, int, np.ndarray, int]] = []  # doc_id, start, ids, tokens of the document
        held, seq = 0, 0

        def emit(rows: list) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names)

        def fill(size: int) -> list:
            nonlocal held, seq
            out, at = [], 0
            while at < size:
                doc, start, ids, tokens = waiting.pop(0)
                take = ids[: size - at]
                out.append((doc, start, len(take), zlib.crc32(take.astype("<u4").tobytes()), tokens, first + seq, at, take.astype(np.int32) if with_ids else None))
                at += len(take)
                if len(take) < len(ids):
                    waiting.insert(0, (doc, start + len(take), ids[len(take) :], tokens))
            held -= size
            seq += 1
            return out

        for b in batches:
            rows: list = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(raw.as_py(), np.uint16)
                waiting.append((doc, 0, ids, len(ids)))
                held += len(ids)
                while held >= length:
                    rows += fill(length)
                if len(rows) >= 5000:
                    yield emit(rows)
                    rows = []
            yield emit(rows)
        rows = []
        while held:
            rows += fill(1 << (held.bit_length() - 1))
        yield emit(rows)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return ranges.select("doc_id", "ids").mapInArrow(cut, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
