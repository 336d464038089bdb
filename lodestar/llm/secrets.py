"""Secrets: fixed patterns, and tokens that a Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import spans_of
from lodestar.llm.pii import digest_columns

_VALUE = "[A-Za-z0-9+/_.=-]++"
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""" + _VALUE
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Runs of at least 18 and 16 characters; shorter runs fail whole, so that they need not be matched first.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
BASE = ("assign", "access", "hex")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Log-likelihood ratio per transition from which a token counts as random, where none was fitted; rows and documents to train on.
LLR_AT, TRAIN_ROWS, TRAIN_DOCS = 0.5, 4000, 2000
#: Every so many labelled tokens by hash only set the threshold; steps of a ratio that are told apart; weight of a false alarm.
HELD, STEP, ALARM = 4, 0.05, 20.0


def random_strings(spark: SparkSession, n: int = TRAIN_ROWS) -> DataFrame:
    """Strings without structure, by rule: base64 and base36-like renderings of digests of row numbers."""
    d = F.sha2(F.col("id").cast("string"), 256)
    as_base64 = F.regexp_replace(F.base64(F.unhex(d)), "=+$", "")
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, as_base64).otherwise(F.translate(F.conv(F.substring(d, 1, 15), 16, 36), "ABCDEFGHIJ", "abcdefghij")).alias("token"), F.lit(1).alias("label"))


def _sample(docs: DataFrame, max_docs: int) -> DataFrame:
    rows = max(1, docs.count())
    return docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(max_docs / rows * 1_000_003))


def planted(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """What the base patterns find in a bounded sample of documents (by hash of doc_id) that mixes letters and digits, label 1."""
    t = F.coalesce("text", F.lit(""))
    values = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(k)) for p, k in ((ASSIGN[:-len(_VALUE)] + f"({_VALUE})", 1), (ACCESS, 0), (HEX, 0))))
    found = _sample(docs, max_docs).select(F.explode(values).alias("token"))
    return found.filter((F.length("token") >= 12) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")).withColumn("label", F.lit(1))


def identifiers(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """Ordinary words of a bounded sample of documents (taken by hash of doc_id), alone and as snake_case pairs with a number."""
    sample = _sample(docs, max_docs)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), lambda w: F.length(w) >= 3)
    numbered = F.transform(words, lambda w, i: F.concat(w, F.lit("_"), F.lower(w), (i % 100).cast("string")))
    return sample.select(F.explode(F.concat(words, numbered)).alias("token"), F.lit(0).alias("label"))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of character transitions, row by row over ALPHABET, from labelled tokens (token, label 1 = random).

    Add-one smoothing; characters outside the alphabet are left out. Without any token all ratios are 0.
    What reaches the driver has the size of the alphabet squared.
    """
    kept = F.regexp_replace(F.coalesce("token", F.lit("")), r"[^A-Za-z0-9+/_=-]", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring(F.col("t"), i, F.lit(2)))
    got = labelled.select("label", kept.alias("t")).filter(F.length("t") >= 2).select("label", F.explode(pairs).alias("pair"))
    n = len(ALPHABET)
    counts = [[1.0] * (n * n), [1.0] * (n * n)]
    for label, pair, many in got.groupBy("label", "pair").count().collect():
        counts[1 if label else 0][ALPHABET.index(pair[0]) * n + ALPHABET.index(pair[1])] += many
    sums = [[sum(c[i * n : (i + 1) * n]) for i in range(n)] for c in counts]
    return [math.log(counts[1][k] / sums[1][k // n]) - math.log(counts[0][k] / sums[0][k // n]) for k in range(n * n)]


def llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a token over ALPHABET, of 2 characters at least."""
    table = F.expr("cast(split('" + ",".join(f"{x:.5f}" for x in model) + "', ',') as array<double>)")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, (at(i) - 1) * len(ALPHABET) + at(i + 1)))
    return total / (F.length(token) - 1)


def threshold(held: DataFrame, model: list[float]) -> float:
    """The ratio from which held-out tokens (token, label), of the length and mix a candidate has, best count as random.

    Best is the greatest share of random tokens found less ALARM times the share of ordinary ones, the middle of all steps
    that are as good; LLR_AT without both classes. Counts by step of STEP are all that reaches the driver.
    """
    ratio = held.filter(F.length("token") >= 2).select("label", F.floor(llr(F.col("token"), model) / STEP).cast("int").alias("at"))
    rows = ratio.groupBy("label", "at").count().collect()
    total = {k: sum(r["count"] for r in rows if r.label == k) for k in (0, 1)}
    if not total[0] or not total[1]:
        return LLR_AT
    share = lambda k, at: sum(r["count"] for r in rows if r.label == k and r["at"] >= at) / total[k]
    places = range(min(r["at"] for r in rows), max(r["at"] for r in rows) + 2)
    worth = {at: share(1, at) - ALARM * share(0, at) for at in places}
    best = [at for at in places if worth[at] >= max(worth.values()) - 1e-12]
    return (best[0] + best[-1]) / 2 * STEP


def _scored(kind: str, place: int, model: list[float]):
    def score(s: Column) -> Column:
        ratio = llr(s["value"], model) if kind == "markov" else F.lit(1.0)
        return F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"), ratio.alias("score"))

    return score


def findings(text: Column, model: list[float], at: float = LLR_AT) -> Column:
    """Array of (start, place, kind, end, score): base kinds with score 1, and `markov` tokens with their ratio."""
    t = F.coalesce(text, F.lit(""))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    rules = [
        ("assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, VALUE, 1)) >= 12, t.rlike("(?i)passw|secret|token|api_?key")),
        ("access", ACCESS, lambda v: F.lit(True), F.contains(t, F.lit("AKIA"))),
        ("hex", HEX, lambda v: F.lit(True), None),
        ("markov", CANDIDATE, lambda v: F.when(mixed(v), llr(v, model) >= at).otherwise(False), None),
    ]
    kinds = []
    for place, (kind, pattern, accept, gate) in enumerate(rules):
        kinds.append(F.transform(spans_of(t, pattern, accept, gate), _scored(kind, place, model)))
    return F.concat(*kinds)


def scan(docs: DataFrame, model: list[float], at: float = LLR_AT) -> DataFrame:
    """doc_id and `findings` of every row's whole text, however long. Null and empty texts have none; rows are neither merged
    nor dropped, repeated ones scanned each; other columns are not read; an empty table gives an empty result."""
    return docs.select("doc_id", findings(F.col("text"), model, at).alias("findings"))


def learn(spark: SparkSession, docs: DataFrame) -> tuple[list[float], float]:
    """Model and threshold from labelled samples: random strings by rule and secrets the base patterns find, against words."""
    labelled = random_strings(spark).unionByName(planted(docs)).unionByName(identifiers(docs))
    apart = F.pmod(F.xxhash64(F.lit(2), "token"), F.lit(HELD)) == 0
    model = train(labelled.filter(~apart))
    return model, threshold(labelled.filter(apart), model)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest_columns(scan(docs, *learn(spark, docs)), BASE)
