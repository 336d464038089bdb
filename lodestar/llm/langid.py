"""Language identification by rank-order profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm._shared import settle, slices, small_batches, steps, trim

#: N-grams of 1 to 3 letters; length of a language's profile and of a document's; documents a language is learned from.
PROFILE, DOC_PROFILE, TRAIN_DOCS = 1000, 300, 3000
#: Languages whose rates (a row each) are broadcast; beyond it rows meet them by a sort-merge join.
FEW_LANGS = 10_000
#: Marks of longer n-grams' codes, above any letter's bits: a blank counts 0, so `" t"` would else be `"t"`.
TWO, THREE = 1 << 60, 1 << 61


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a whole text's n-grams, lower case, words padded by one blank on each side."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le"), dtype=np.uint32)
    a = np.zeros(len(raw) + 2, dtype=np.int64)
    a[1:-1] = np.where(_letters()[raw], raw, 0)
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    one, two = a[a != 0], TWO | (a[:-1] << 21) | a[1:]
    three = THREE | (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    codes = np.concatenate((one, two[(a[:-1] != 0) | (a[1:] != 0)], three[a[1:-1] != 0])) if len(one) else one
    codes.sort()
    if not len(codes):
        return codes, codes
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.append(at, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:n]]


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles (most frequent n-grams, in order) by language from docs (doc_id, text, lang).

    Null languages are left out. A language with more than max_docs rows is learned from about max_docs whole
    texts, taken by a hash of doc_id. At most `size` codes per language reach the driver.
    """
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    small_batches(docs.sparkSession)
    with steps():
        return _profiles(known, max_docs, size)


def _profiles(known: DataFrame, max_docs: int, size: int) -> dict[str, list[int]]:
    rate = settle(known.groupBy("lang").agg((F.lit(max_docs) / F.count(F.lit(1))).alias("rate")))
    rate = F.broadcast(rate) if rate.count() <= FEW_LANGS else rate.hint("merge")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003)
    sample = known.join(rate, "lang").filter(share < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes, counts = ngram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])
        trim()

    grams = sample.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r["rank"])):
        profiles.setdefault(r.lang, []).append(r.code)
    return profiles


def identify(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]], longest: int) -> tuple[str, float]:
    """The language with the least out-of-place distance, and 1 - distance / largest possible distance."""
    codes, counts = ngram_counts(text)
    if not len(codes) or not profiles:
        return "und", 0.0
    mine = top(codes, counts, DOC_PROFILE)
    best = ("und", 2.0)
    for lang, known, rank in profiles:
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        away = np.where(known[at] == mine, np.abs(rank[at] - np.arange(len(mine))), longest)
        distance = float(away.mean()) / longest
        if distance < best[1]:
            best = (lang, distance)
    return best[0], min(1.0, max(0.0, 1 - best[1]))


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text); the whole text is read.

    Null text, text without a letter, or no learned profile: `und` with score 0. Ties go to the smaller language
    name. Repeated rows are predicted each; other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    longest = max([1, *map(len, profiles.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = []
        for lang, codes in sorted(profiles.items()):
            order = np.argsort(codes)
            ready.append((lang, np.asarray(codes, np.int64)[order], order))
        for b in (part for whole in batches for part in slices(whole, 1)):
            got = [identify(t, ready, longest) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])
        trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(docs.filter(~held_out()))
    return predict(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
