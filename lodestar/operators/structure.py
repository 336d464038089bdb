"""Sections of a track: how alike they are by families of features, which repeat, what part they play."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.series import rank_percent

#: Columns and weights of the families; then the limits of the parts' rules.
FAMILIES = {"chroma": (0, 12, 0.60), "timbre": (12, 14, 0.25), "density": (14, 16, 0.15)}
CHORUS_REPEATS, CHORUS_ENERGY, CHORUS_ONSET, EDGE_ENERGY, EDGE_ONSET, TOP_CONFIDENCE = 2, 0.50, 0.40, 0.35, 0.40, 0.60


def family_similarity(x: np.ndarray, families: dict | None = None) -> np.ndarray:
    """Similarity of all rows (sections) of one track: a cosine for each family about the track's own mean, by weight.

    A family that is the same in all sections says nothing and leaves its weight to the others.
    """
    out, used = np.zeros((len(x), len(x))), 0.0
    for first, last, weight in (families or FAMILIES).values():
        part = x[:, first:last] - x[:, first:last].mean(axis=0)
        if weight <= 0 or not part.size or np.abs(part).max() < 1e-9:
            continue
        part = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        out, used = out + weight * part @ part.T, used + weight
    return out / used if used else out


def label_sections(sections: DataFrame, keys: list[str]) -> DataFrame:
    """sections (keys, pos, group, energy, onset) with part and confidence: chorus, verse, intro, outro or unknown.

    Of the groups that come twice or more and are loud and dense enough on the average, the strongest is the chorus's, but
    only its loud and dense sections are chorus; sections of other repeated groups that are quieter than it are verse; the
    first is an intro if it is quiet and sparse, the last an outro if it is quiet. Energy and onset count by rank in the track.
    """
    whole, of_group = Window.partitionBy(*keys), Window.partitionBy(*keys, "group")
    got = sections.withColumns({"e": rank_percent("energy", "pos", keys), "o": rank_percent("onset", "pos", keys)})
    got = got.withColumns({"reps": F.count(F.lit(1)).over(of_group), "ge": F.avg("e").over(of_group), "go": F.avg("o").over(of_group), "at": F.min("pos").over(of_group), "last": F.max("pos").over(whole), "n": F.count(F.lit(1)).over(whole), "start": F.min("pos").over(whole)})
    strong = (F.col("reps") >= CHORUS_REPEATS) & (F.col("ge") >= CHORUS_ENERGY) & (F.col("go") >= CHORUS_ONSET)
    best = F.min(F.when(strong, F.struct((-(F.col("ge") * F.col("go") * F.sqrt("reps"))).alias("v"), "at", F.col("group").alias("g"), "ge"))).over(whole)
    got = got.withColumn("best", best)
    chorus, e, o, more = F.col("best.g"), F.col("e"), F.col("o"), 0.14 * (F.col("reps") - 1)
    cap = lambda top, low, v: F.round(F.least(F.lit(top), F.greatest(F.lit(low), v)), 3)
    rules = [
        ("chorus", F.col("group").eqNullSafe(chorus) & (e >= CHORUS_ENERGY) & (o >= CHORUS_ONSET), cap(TOP_CONFIDENCE, 0.25, 0.20 + more + 0.5 * (e - CHORUS_ENERGY) + 0.3 * (o - CHORUS_ONSET))),
        ("verse", chorus.isNotNull() & (F.col("group") != chorus) & (F.col("reps") >= CHORUS_REPEATS) & (e < F.col("best.ge")), cap(TOP_CONFIDENCE * 0.9, 0.2, 0.15 + more + 0.4 * (F.col("best.ge") - e))),
        ("intro", (F.col("pos") == F.col("start")) & (e < EDGE_ENERGY) & (o < EDGE_ONSET), F.round(F.least(F.lit(0.5), 0.3 + 0.4 * (0.35 - e)), 3)),
        ("outro", (F.col("pos") == F.col("last")) & (F.col("n") > 2) & (e < EDGE_ENERGY), F.round(F.least(F.lit(0.5), 0.3 + 0.4 * (0.35 - e)), 3)),
    ]
    part, sure = F.lit("unknown"), F.lit(0.0)
    for name, rule, confidence in reversed(rules):
        part, sure = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(part), F.when(F.coalesce(rule, F.lit(False)), confidence).otherwise(sure)
    return got.withColumns({"part": part, "confidence": sure}).select(*sections.columns, "part", "confidence")


def chorus_summary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, number of choruses, and energy and pos of the loudest (the first of equals); no row without a chorus."""
    loudest = F.min(F.struct((-F.col("energy")).alias("e"), "pos"))
    got = labelled.filter("part = 'chorus'").groupBy(*keys).agg(F.count(F.lit(1)).alias("choruses"), loudest.alias("l"))
    return got.select(*keys, "choruses", (-F.col("l.e")).alias("energy"), F.col("l.pos").alias("pos"))
