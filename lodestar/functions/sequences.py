"""Similarity of ordered token sequences, and their capping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of edit distance, bigrams, token sets and transitions.
WEIGHTS = (0.35, 0.25, 0.20, 0.20)
#: First code point of the characters that stand for a pair's distinct tokens; from here on 20,000 are free of surrogates.
FIRST_CHAR = 0x4E00


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def coded(a: Column, b: Column) -> Column:
    """Both sequences as numbers, struct(x, y): a token's number is its place among the pair's distinct tokens."""
    number = lambda seq, d: F.transform(seq, lambda t: F.array_position(d, t).cast("int"))
    return let(F.array_distinct(F.concat(a, b)), lambda d: F.struct(number(a, d).alias("x"), number(b, d).alias("y")))


def _chars(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda i: F.decode(F.unhex(F.hex(i + (FIRST_CHAR - 1))), "UTF-16BE")), "")


def _levenshtein(x: Column, y: Column) -> Column:
    longer = F.greatest(F.size(x), F.size(y))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(_chars(x), _chars(y)) / longer)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of arrays of any tokens (up to 20,000 distinct ones a pair); 1 if both are empty."""
    return let(coded(a, b), lambda p: _levenshtein(p["x"], p["y"]))


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ngrams(x: Column, n: int) -> Column:
    """Runs of n neighbouring tokens as arrays; none if there are fewer tokens."""
    runs = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.slice(x, i + 1, n))
    return F.when(F.size(x) >= n, runs).otherwise(F.filter(F.array(x), lambda _: F.lit(False)))


def _numbered(items: Column) -> Column:
    """Each element with the number of its equals before it, so that a multiset becomes a set."""
    return let(F.array_sort(items), lambda s: F.transform(s, lambda v, i: F.struct(v.alias("v"), (i - F.array_position(s, v)).alias("k"))))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Size of multiset intersection over that of union; 1 if both are empty."""
    common = F.size(F.array_intersect(_numbered(a), _numbered(b)))
    return let(common, lambda c: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(c / (F.size(a) + F.size(b) - c)))


def ngram_similarity(a: Column, b: Column, n: int = 2) -> Column:
    """multiset_similarity of the runs of n tokens."""
    grams = let(coded(a, b), lambda p: F.struct(ngrams(p["x"], n).alias("x"), ngrams(p["y"], n).alias("y")))
    return let(grams, lambda g: multiset_similarity(g["x"], g["y"]))


transition_similarity = ngram_similarity  # the same value for pairs of neighbours


def similarities(a: Column, b: Column) -> Column:
    """struct(lev, gram, jac, trans, combined): all terms from one coding of the pair. combined is their weighted sum, 0 if
    either sequence is empty; bigrams and transitions are one term."""

    def terms(p: Column) -> Column:
        grams = F.struct(ngrams(p["x"], 2).alias("x"), ngrams(p["y"], 2).alias("y"))
        pair = let(grams, lambda g: multiset_similarity(g["x"], g["y"]))
        return F.struct(_levenshtein(p["x"], p["y"]).alias("lev"), pair.alias("gram"), jaccard_similarity(p["x"], p["y"]).alias("jac"))

    def blend(t: Column) -> Column:
        lev, gram, jac, trans = WEIGHTS
        total = lev * t["lev"] + (gram + trans) * t["gram"] + jac * t["jac"]
        some = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(total)
        return F.struct(t["lev"].alias("lev"), t["gram"].alias("gram"), t["jac"].alias("jac"), t["gram"].alias("trans"), some.alias("combined"))

    return let(let(coded(a, b), terms), blend)


def combined_similarity(a: Column, b: Column) -> Column:
    return similarities(a, b)["combined"]


def cap_sequence(a: Column, budget: int = 120) -> Column:
    """At most `budget` evenly spaced elements, both ends kept; positions are rounded half to even."""
    step = (F.size(a) - 1) / F.lit(budget - 1.0)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.bround(i * step, 0).cast("int")))
    return F.when(F.size(a) > budget, F.transform(places, lambda i: F.get(a, i))).otherwise(a)


def relative_tokens(roots: Column, qualities: Column, tonic: Column) -> Column:
    """Chord roots relative to the tonic, with their qualities."""
    return F.zip_with(roots, qualities, lambda r, q: F.concat(F.pmod(r - tonic, F.lit(12)).cast("string"), F.lit(":"), q))


def parse_sequence(raw: Column) -> Column:
    """Tokens of a stored sequence, a JSON array or words between commas; empty ones are left out, null gives none."""
    listed = F.from_json(raw, "array<string>")
    split = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(F.when(F.trim(raw).startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(split), lambda t: t.isNotNull() & (t != ""))
