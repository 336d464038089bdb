"""Quality classifier by co-training: a text view and a metadata view teach each other, calibrated scores are combined."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import release, settle, slices, small_batches, trim

#: Labelled rows learned from, at most about so many. All other rows are the pool the views label for each other.
LABELLED = 4000
#: Rounds of exchange, share of the pool that a view hands over in each, slots of hashed byte triples.
ROUNDS, HANDED, SLOTS = 5, 0.05, 512
#: Slots of the other view: sources, languages, sizes in quarters of a doubling, the size itself.
SOURCES, LANGS, SIZES = 24, 8, 80
META = SOURCES + LANGS + SIZES + 1
#: Newton steps in a round but the last, which goes to the end: each is a pass over the pool.
STEPS_IN_ROUND = 2
#: Sums of one size that one task adds up.
FAN = 32
#: Weight of a pseudo-label; in a pool of more than LABELLED rows so much less that all together weigh the same.
PSEUDO = 0.3
#: Steps of a score that are told apart when a view's surest rows are sought, and the greatest score so counted.
STEPS, FAR = 128, 32
ACCEPT_AT = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def triples(text: str | None) -> np.ndarray:
    """Counts of the hashed byte triples of the whole text."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(SLOTS, np.int64)
    h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(23), minlength=SLOTS)


def text_view(counts: np.ndarray) -> np.ndarray:
    """What whole texts say, from rows of their triples' counts: square roots, unit length."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known of a page beside its text: source, language and stated size; nulls are values of their own (size: none)."""
    v = np.zeros(META, np.float32)
    v[zlib.crc32((source or "\0").encode("utf-8", "replace")) % SOURCES] = 1
    v[SOURCES + zlib.crc32((lang or "\0").encode("utf-8", "replace")) % LANGS] = 1
    if n_chars is not None:
        size = np.log2(1 + max(0, n_chars))
        v[SOURCES + LANGS + min(int(4 * size), SIZES - 1)] = 1
        v[-1] = size / 20
    return v


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(np.float64)


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss of rows x, without penalty."""
    x = _with_one(x)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x


def fit_logistic(x: np.ndarray, y: np.ndarray, strength: float = 1e-3) -> np.ndarray:
    """Weights (the last one the intercept) of a logistic regression, by Newton's method with a quadratic penalty."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(12):
        g, h = _slopes(x, y, w)
        step = np.linalg.solve(h + strength * len(x) * np.eye(len(w)), g + strength * len(x) * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    views: tuple[np.ndarray, np.ndarray]  # weights of the text and the metadata view
    scale: tuple[np.ndarray, np.ndarray]  # slope and intercept that calibrate either view
    pool: int = 0  # unlabelled rows that were scored in every round
    given: tuple[int, int] = (0, 0)  # of them, rows that the text and the metadata view have been taught
    rounds: tuple = ()  # what `taught` needs to give the same pseudo-labels again
    prior: float = 0.0  # log odds of acceptance among the rows that calibrate

    def logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_score(x, w) * s[0] + s[1] for x, w, s in zip((text, meta), self.views, self.scale, strict=True))


def _bins(s: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(s * STEPS), -FAR * STEPS, FAR * STEPS - 1).astype(np.int64)


def taught(x: tuple[np.ndarray, np.ndarray], rounds: list) -> tuple[np.ndarray, np.ndarray]:
    """Pseudo-label (1, 0, or -1 for none) that the text and the metadata view have for each row after these rounds.

    A round has the weights of both views and, for each, the bins of scores from which up and down to which it teaches
    the other. A row keeps the label of the first round that gave it one, so rounds are all there is to remember.
    """
    given = np.full(len(x[0]), -1), np.full(len(x[0]), -1)
    for w, cuts in rounds:
        for k in (0, 1):
            at, free = _bins(_score(x[k], w[k])), given[1 - k] < 0
            given[1 - k][free & (at >= cuts[k][0])] = 1
            given[1 - k][free & (at <= cuts[k][1])] = 0
    return given


def _total(pool: DataFrame, part) -> np.ndarray | float:
    """Sum over all rows of pool of part(views), an array of one size whatever the number of rows; 0 without rows."""

    def added(of, column):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for one in slices(b, column, 2000):
                    got = of(one)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sums"])
            trim()

        return run

    sums = lambda b: np.sum([np.frombuffer(r) for r in b.column(0).to_pylist()], axis=0)
    width = pool.rdd.getNumPartitions()
    out = pool.mapInArrow(added(lambda b: part(_unpacked(b)), 0), "sums binary")
    while width > 8:  # a task adds up FAN sums or so, so that a few reach the driver whatever the number of tasks
        width = -(-width // FAN)
        out = out.repartition(width).mapInArrow(added(sums, 0), "sums binary")
    return sum((np.frombuffer(r[0]) for r in out.collect()), 0.0)


def _cuts(free: np.ndarray, n_up: int, n_down: int) -> tuple[int, int]:
    """Bins from which up and down to which lie at most so many free rows (or the outermost bin that has any), beyond a score of 1 or -1."""

    def last(counts: np.ndarray, most: int) -> int:  # number of outer bins to take
        return max(int(np.searchsorted(np.cumsum(counts), most, "right")), int(np.flatnonzero(counts)[0]) + 1) if counts.any() else 0

    half = FAR * STEPS
    return half - last(free[: half + STEPS - 1 : -1], n_up), last(free[: half - STEPS], n_down) - 1 - half


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: DataFrame) -> Model:
    """Co-train on labelled rows (y 0 or 1) and an unlabelled pool; every fourth labelled row only calibrates.

    pool has the columns triples and meta. In each round every row of it is scored, and either view teaches the other
    what it is surest of in the whole pool. Counts of scores and sums of gradients and Hessians are all that leaves it.
    """
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    share, rounds, size = y.mean(), [], 0
    own, t = tuple(v[~held] for v in views), y[~held]
    w = tuple(fit_logistic(x, t) for x in own)
    tri = [np.triu_indices(x.shape[1] + 1) for x in own]
    ends = np.cumsum([0, *(n for x, i in zip(own, tri, strict=True) for n in (x.shape[1] + 1, len(i[0]), 1))])
    weight, given = 1.0, (0, 0)

    def climb(w: tuple, steps: int) -> tuple[tuple, tuple[int, int]]:
        """Weights after at most so many steps of Newton's method, both views in one pass, and how many rows they are taught."""
        for _ in range(steps):

            def sums(x, w=w, rounds=tuple(rounds)):
                out = []
                for k, label in enumerate(taught(x, rounds)):
                    g, h = _slopes(x[k][label >= 0], label[label >= 0], w[k])
                    out += [g, h[tri[k]], [(label >= 0).sum()]]
                return np.concatenate(out)

            total = np.broadcast_to(_total(pool, sums), ends[-1])
            parts = [total[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            new = []
            for k in (0, 1):
                g, flat, n = parts[3 * k : 3 * k + 3]
                h = np.zeros((len(g), len(g)))
                h[tri[k]] = flat
                h = h + h.T - np.diag(np.diag(h))
                g_own, h_own = _slopes(own[k], t, w[k])
                penalty = 1e-3 * (len(t) + weight * n[0])
                new.append(w[k] - np.linalg.solve(h_own + PSEUDO * weight * h + penalty * np.eye(len(g)), g_own + PSEUDO * weight * g + penalty * w[k]))
            moved = max(np.abs(a - b).max() for a, b in zip(new, w, strict=True))
            w = tuple(new)
            if moved < 1e-2:  # the next step would be about its square
                break
        return w, (int(parts[2][0]), int(parts[5][0]))

    for turn in range(ROUNDS):

        def scores(x, w=w, rounds=tuple(rounds)):
            known = taught(x, rounds)
            return np.concatenate([np.bincount(_bins(_score(x[k], w[k]))[known[1 - k] < 0] + FAR * STEPS, minlength=2 * FAR * STEPS) for k in (0, 1)])

        counts = _total(pool, scores)
        if not np.any(counts):
            break
        counts = counts.reshape(2, -1)
        size = size or int(counts[0].sum())
        weight = min(1.0, LABELLED / size)
        n_up, n_down = max(1, int(HANDED * size * share)), max(1, int(HANDED * size * (1 - share)))
        rounds.append((w, tuple(_cuts(c, n_up, n_down) for c in counts)))
        w, given = climb(w, STEPS_IN_ROUND if turn + 1 < ROUNDS else 12)
    use = held if held.any() else ~held
    scale = tuple(fit_logistic(_score(v[use], x)[:, None], y[use]) for v, x in zip(views, w, strict=True))
    odds = y[use].mean() / (1 - y[use].mean())
    return Model(w, scale, size, given, tuple(rounds), float(np.log(odds)))


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows with the columns triples (bytes, or longer numbers for long texts) and meta."""
    raw = b.column(b.schema.get_field_index("triples")).to_pylist()
    counts = np.stack([np.frombuffer(r, np.uint8 if len(r) == SLOTS else np.uint32) for r in raw]).astype(np.float32)
    meta = np.frombuffer(b"".join(b.column(b.schema.get_field_index("meta")).to_pylist()), np.float32).reshape(-1, META)
    return text_view(counts), meta


def _features(columns: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Triples' counts of texts, and the metadata view of what else is known of them."""
    texts, *known = columns
    counts = np.array([triples(t) for t in texts], np.int64).reshape(len(texts), SLOTS)
    return counts, np.array([meta_view(*x) for x in zip(*known, strict=True)], np.float32).reshape(len(texts), META)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in COLUMNS[1:4]), F.col("n_chars").cast("bigint").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from a bounded sample, by hash of doc_id, of labels (doc_id, quality) and from all docs. None without both classes.

    Labels that are null or neither 0 nor 1, or whose doc_id is null, are left out; of a document with several labels
    the least counts. Every document without one of the sampled labels is in the unlabelled pool.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            counts, meta = _features([b.column(k).to_pylist() for k in range(1, 5)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array([_packed(c) for c in counts], pa.binary()), pa.array([m.tobytes() for m in meta], pa.binary())], ["doc_id", "y", "triples", "meta"])
        trim()

    small_batches(docs.sparkSession)
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_003))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    n_known = known.count()
    if not n_known:
        return None
    some = known.filter(share < F.lit(LABELLED / n_known * 1_000_003)).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = _plain(docs).join(F.broadcast(some), "doc_id", "left")  # about LABELLED rows of two numbers
    seen = settle(rows.select(*COLUMNS, F.coalesce("y", F.lit(-1)).alias("y")).mapInArrow(extract, "doc_id bigint, y int, triples binary, meta binary"))
    got = pa.Table.from_pandas(seen.filter("y >= 0").toPandas().sort_values(["doc_id", "y"], kind="stable"), preserve_index=False)
    y = np.array(got.column("y").to_pylist(), float)
    model = cotrain(_unpacked(got.combine_chunks().to_batches()[0]), y, seen.filter("y < 0").select("triples", "meta")) if len(np.unique(y)) == 2 else None
    release(seen)
    return model


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _judged(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array, model: Model | None) -> list[np.ndarray]:
    """Scores by text, by metadata and by both, of rows of at most a few MB.

    Views that are independent given the class, as co-training supposes, add up in log odds, the prior counted once.
    """
    if model is None:
        return [np.full(len(texts), 0.5)] * 3
    counts, meta = _features([x.to_pylist() for x in (texts, langs, sources, sizes)])
    by_text, by_meta = model.logits(text_view(counts), meta)
    return [_odds(by_text), _odds(by_meta), _odds(by_text + by_meta - model.prior)]


def _judge(model: Model | None) -> Column:
    """text_score, meta_score and quality_score of a row as a struct; only the four columns read go to Python."""

    @F.arrow_udf("struct<text_score:double,meta_score:double,quality_score:double>")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            whole = pa.RecordBatch.from_arrays(list(columns), ["text", "lang", "source", "n_chars"])
            got = [_judged(*b.columns, model) for b in slices(whole, 0)]
            parts = [np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in range(3)]
            yield pa.StructArray.from_arrays([pa.array(p) for p in parts], ["text_score", "meta_score", "quality_score"])
        trim()

    return judge(*(F.col(c).cast("string") for c in COLUMNS[1:4]), F.col("n_chars").cast("bigint"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_score, meta_score, quality_score (0 to 1), accepted (at least 0.5) of every row of docs.

    Whole texts are read. Nulls count as empty text, a language or source of their own, and no stated size. Equal rows get
    equal scores, repeated rows one each. Without a model every score is 0.5. Other columns are not read; an empty table
    gives an empty result. docs needs the columns of COLUMNS.
    """
    small_batches(docs.sparkSession)
    got = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _judge(model).alias("got"))
    return got.select("doc_id", "got.*", (F.col("got.quality_score") >= ACCEPT_AT).alias("accepted"))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that `score` accepts, with all their columns, also rows with nulls, repeated ones and those of equal score.

    Rows stay in the JVM, whatever other columns they have; the four columns read alone go to Python. Without a model all
    rows stay; of an empty table none.
    """
    small_batches(docs.sparkSession)
    return docs.filter(_judge(model)["quality_score"] >= ACCEPT_AT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
