"""Grouped prefix join: all links between documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm._shared import lookup, maybe_in, settle, slices, small_batches, steps, sweep, trim
from lodestar.llm.components import components

SHINGLE, PERCENT = 5, 75
#: Slots of the frequency sketch that orders shingles from rare to common; any order gives the same links.
SKETCH = 1 << 16
#: In a shingle's list all pairs of the first PAIRED groups and those of the first HUBS groups with all others come first.
PAIRED, HUBS = 24, 4
#: Rows of a list held in memory at a time; slots of a document's counts, as many as shingles or so.
BLOCK, SLOTS = 512, (64, 8192)
#: Rows of a list that pass by such a block in one task.
PROBES = 512
#: Words whose digests a worker remembers, and the longest of them in bytes.
WORDS, WORD_BYTES = 150_000, 40
_known: dict[bytes, bytes] = {}
#: Odd multipliers of the two halves of a shingle's hash.
_ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _digest(word: bytes) -> bytes:
    got = hashlib.blake2b(word, digest_size=16).digest()
    if len(_known) < WORDS and len(word) <= WORD_BYTES:
        _known[word] = got
    return got


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) in order."""
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = a[1:] == a[:-1]
    if np.any(same & (b[1:] != b[:-1])):  # as good as never: one half alone is equal
        both = np.unique(np.stack((a, b), axis=1), axis=0)
        return both[:, 0].copy(), both[:, 1].copy()
    keep = np.concatenate(([True], ~same))
    return a[keep], b[keep]


def _word_digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digests (two halves) of all words of texts, A-Z lowered, in order, and how many words each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    if pc.any(pc.equal(pc.binary_length(flat), 0)).as_py():  # a text without words is split into one empty word
        empty = pc.equal(pc.binary_length(flat), 0)
        counts = counts - np.bincount(np.repeat(np.arange(len(counts)), counts), weights=empty.to_numpy(zero_copy_only=False), minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pc.invert(empty))
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    known = b"".join(d or _digest(w) for w, d in zip(words, map(_known.get, words), strict=True))
    return np.frombuffer(known, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()], counts


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the ordered distinct 128-bit hashes (two halves) of the whole text's shingles: A-Z lowered, words between
    white space, five to a shingle, all words as one if there are fewer, none without words.

    A word's digest is a cryptographic one, and a shingle's hash mixes its words' in turn, each half from its own half of
    the digests, so that there is no algebra by which different shingles would meet.
    """
    digests, counts = _word_digests(texts)
    whole = _mixed(digests, SHINGLE)  # those that reach over a text's end are not taken
    at = 0
    for n in counts.tolist():
        out = whole[:, at : at + n - SHINGLE + 1] if n >= SHINGLE else _mixed(digests[at : at + n], n)
        at += n
        yield _ordered(*out) if n else tuple(out)


def _mixed(digests: np.ndarray, size: int) -> np.ndarray:
    """Both halves of the hash of each run of `size` words."""
    count = max(0, len(digests) - size + 1) if size else 0
    out = np.full((2, count), size, np.uint64)
    for k, odd in enumerate(_ODD):
        for j in range(size):
            out[k] ^= digests[j : j + count, k]
            out[k] *= odd
            out[k] ^= out[k] >> np.uint64(32)
    return out


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets` of one text."""
    return next(shingle_sets(pa.array([text], pa.string())))


def _finish() -> None:
    _known.clear()
    trim()


def in_common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share."""
    if not len(x[0]) or not len(y[0]):
        return 0
    if np.any(y[0][1:] == y[0][:-1]):  # as good as never, see _ordered
        return len(set(zip(*map(np.ndarray.tolist, x), strict=True)) & set(zip(*map(np.ndarray.tolist, y), strict=True)))
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())


def _linked(n: int, m: int, common: int) -> bool:
    return 100 * common >= PERCENT * (n + m - common)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("doc_id").isNotNull(), F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))


def _sketch(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each of SKETCH slots, over all documents; its size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SKETCH, np.int64)
        for b in batches:
            for part in slices(b, 1):
                slots = [a >> np.uint64(48) for a, _ in shingle_sets(part.column(1))]
                n += np.bincount(np.concatenate(slots).astype(np.int64), minlength=SKETCH)
        _finish()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["slot", "n"])

    out = np.zeros(SKETCH, np.int64)
    for r in _texts(docs).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out


def _slots(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by their last bits, 255 for any larger count."""
    m = min(max(SLOTS[0], 1 << (len(s) - 1).bit_length()), SLOTS[1])
    return np.minimum(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8).tobytes()


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, node (128-bit digest of the whole set), grp (of size and prefix), prefix (rarest shingles in order), slots (counts) of every row.

    Of a group only the first row of each task has its prefix, which stands for all. grp and the shingles in prefix are the
    first 64 bits: groups or shingles that met there would only meet more candidates, all of which are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for part in slices(b, 1):
                rows = []
                for s, s2 in shingle_sets(part.column(1)):
                    n = len(s)
                    if not n:
                        rows.append((0, None, None, None, None))
                        continue
                    first = np.lexsort((s, sketch[(s >> np.uint64(48)).astype(np.int64)]))[: n - (PERCENT * n + 99) // 100 + 1]
                    node, group = (hashlib.blake2b(b"".join((n.to_bytes(8, "little"), x.tobytes(), y.tobytes())), digest_size=16).digest() for x, y in ((s, s2), (s[first], s2[first])))
                    rows.append((n, node, int.from_bytes(group[:8], "little", signed=True), None if group in seen else s[first].view(np.int64), _slots(s)))
                    seen.add(group)
                n, node, group, prefix, slots = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(group, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(slots, pa.binary())], ["doc_id", "n", "node", "grp", "prefix", "slots"])
        _finish()

    return _texts(docs).mapInArrow(run, "doc_id bigint, n bigint, node binary, grp bigint, prefix array<bigint>, slots binary")


def _fits(na, ra, nb, rb):
    """Whether sizes and what is left of both sets from a first common shingle on (itself included) allow a link."""
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & ((100 + PERCENT) * np.minimum(ra, rb) >= PERCENT * (na + nb))


def _first_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of groups (a, b) from each shingle's list, and (null, token) for lists that hold more pairs than were made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = [np.zeros(0, np.int64)] * 4  # the first PAIRED rows of the list that is still open
        for b in batches:
            cols = [np.concatenate((h, b.column(k).to_numpy())) for k, h in enumerate(head)]
            token, group, n, rest = cols
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.append(first, len(token)))
            begin = np.repeat(first, length)
            rank = np.arange(len(token)) - begin
            made_a, made_b = [], []
            for k in range(1, PAIRED):  # pairs k apart among the first PAIRED
                i = np.flatnonzero((rank >= k) & (rank < PAIRED))
                if not len(i):
                    break
                ok = _fits(n[i], rest[i], n[i - k], rest[i - k]) & (group[i] != group[i - k])
                made_a.append(group[i[ok]])
                made_b.append(group[i[ok] - k])
            i = np.flatnonzero(rank >= PAIRED)
            for k in range(HUBS if len(i) else 0):
                j = begin[i] + k
                ok = _fits(n[i], rest[i], n[j], rest[j]) & (group[i] != group[j])
                made_a.append(group[i[ok]])
                made_b.append(group[j[ok]])
            long_ = token[first[length > PAIRED]]
            a, c = np.concatenate([*made_a, long_[:0]]), np.concatenate([*made_b, long_[:0]])
            pairs = np.unique(np.stack((np.minimum(a, c), np.maximum(a, c)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            open_ = slice(first[-1], min(first[-1] + PAIRED, len(token)))
            head = [x[open_] for x in cols]
            left = np.concatenate((pairs[:, 0], long_))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64(), mask=np.arange(len(left)) >= len(pairs)), pa.array(np.concatenate((pairs[:, 1], long_)), pa.int64())], ["a", "b"])

    return postings.select("token", "grp", "n", "rest").mapInArrow(run, "a bigint, b bigint").distinct()


def _likely(rows: DataFrame, ids: DataFrame, key: str = "doc_id", room: int = 16) -> DataFrame:
    """The rows whose key is in ids, and some others: the rest is not shuffled."""
    return maybe_in(rows, ids, key, room).filter("maybe").drop("maybe")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids that are links, by the exact size of the intersection of their whole sets.

    The texts travel, which shuffles compress, not the several times larger sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, shingles(None)
        for b in (part for whole in batches for part in slices(whole, 3)):
            links = []
            for one, other, text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), shingle_sets(b.column(3)), strict=True):
                if one != last:  # rows come sorted by a
                    last, x = one, shingles(text.as_py())
                n, m = len(x[0]), len(y[0])
                if 100 * min(n, m) >= PERCENT * max(n, m) and _linked(n, m, in_common(x, y)):
                    links.append((one, other))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        _finish()

    def texts(name: str) -> DataFrame:
        some = _likely(_texts(docs), pairs.select(F.col(name).alias("doc_id")).distinct())
        return some.select(F.col("doc_id").alias(name), F.col("text").alias(f"text_{name}")).hint("merge")

    both = pairs.join(texts("b"), "b").join(texts("a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _apart(made: DataFrame, members: DataFrame) -> DataFrame:
    """The member pairs of the group pairs (a, b), and of each group itself, whose ends are not yet in one component.

    members: grp, node, root, k (members of the group). Pairs of groups of one member each were decided before.
    """
    many = members.filter("k > 1").select(F.col("grp").alias("a"), F.col("grp").alias("b")).distinct()
    left = members.select(F.col("grp").alias("a"), F.col("node").alias("node1"), F.col("root").alias("root1"), F.col("k").alias("k1"))
    right = members.select(F.col("grp").alias("b"), F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("k").alias("k2"))
    both = made.select("a", "b").union(many).join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.filter("(k1 > 1 or k2 > 1) and root1 <> root2").select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))


def _other_pairs(postings: DataFrame, long_: DataFrame, members: DataFrame) -> DataFrame:
    """For the long lists, every pair of members that may link and whose ends are not yet in one component.

    Postings of other lists are dropped before any shuffle. Of a list's components the one with most rows is compared with the rows outside it only, so lists that one group
    of near copies fills give no pairs here. The rows outside are dealt in blocks of BLOCK, all rows of the list in blocks
    of PROBES, and each pair of blocks is a task's unit of work, so that a long list is spread over many.
    """
    own = _likely(postings, long_, "token", 64).join(long_, "token").join(members.select("grp", "node", "root").hint("merge"), "grp")
    own = settle(own.select("token", "node", "n", "rest", "root").distinct())
    counts = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    lists = settle(counts.groupBy("token").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("token", F.col("m.root").alias("main"), F.expr(f"cast(ceil((k - m.k) / {BLOCK}) as bigint)").alias("blocks"), F.expr(f"cast(ceil(k / {PROBES}) as bigint)").alias("turns")))
    listed = settle(own.join(lists, "token"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    few = listed.filter("root <> main").withColumn("at", F.pmod(F.xxhash64("node"), "blocks")).withColumn("turn", upto("turns"))
    few = few.withColumn("block", F.expr("at * turns + turn")).withColumn("probe", F.lit(False))
    probes = listed.withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "node"), "turns")).withColumn("at", upto("blocks"))
    probes = probes.withColumn("block", F.expr("at * turns + turn")).withColumn("probe", F.lit(True))
    names = ["token", "block", "probe", "node", "n", "rest", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, np.zeros((4, 0), np.int64)  # the rows outside the main component that the open list's probes meet
        for b in batches:
            token, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            probe = b.column(2).to_numpy(zero_copy_only=False)
            rows = np.stack([b.column(k).to_numpy() for k in range(3, 7)]) if b.num_rows else np.zeros((4, 0), np.int64)
            cut = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            made = [np.zeros((0, 2), np.int64)]
            for i, j in zip([0, *cut], [*cut, len(token)], strict=True):
                if i == j:
                    continue
                if key != (token[i], part[i]):
                    key, block = (token[i], part[i]), np.zeros((4, 0), np.int64)
                mine = ~probe[i:j]
                block = np.concatenate((block, rows[:, i:j][:, mine]), axis=1)
                asks = rows[:, i:j][:, ~mine]
                (x, n, r, c), (x2, n2, r2, c2) = (v[:, None] for v in asks), block
                p, q = np.nonzero((c != c2) & _fits(n, r, n2, r2))
                made.append(np.stack((np.minimum(asks[0][p], x2[q]), np.maximum(asks[0][p], x2[q])), axis=1))
            pairs = np.unique(np.concatenate(made), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = few.select(names).union(probes.select(names)).repartition("token", "block").sortWithinPartitions("token", "block", "probe")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _possible(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose slot counts leave room for a link: no intersection exceeds the sum of lesser counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = (np.frombuffer(z.as_py(), np.uint8).astype(np.int64) for z in (x, y))
                u, v = (np.where(z == 255, 1 << 40, z) for z in (u, v))
                m = min(len(u), len(v))
                u, v = u.reshape(-1, m).sum(axis=0), v.reshape(-1, m).sum(axis=0)  # slot i of more slots is slot i mod m
                most = int(np.minimum(u, v).sum())
                keep.append((100 + PERCENT) * most >= PERCENT * int(u.sum() + v.sum()) or most >= 1 << 40 or max(u.max(), v.max()) >= 1 << 40)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def counts(name: str) -> DataFrame:
        some = _likely(rows.select("doc_id", "slots"), pairs.select(F.col(name).alias("doc_id")).distinct())
        return some.select(F.col("doc_id").alias(name), F.col("slots").alias(f"slots_{name}")).hint("merge")

    both = pairs.join(counts("b"), "b").join(counts("a"), "a")
    return settle(both.select("a", "b", "slots_a", "slots_b").mapInArrow(run, "a bigint, b bigint").distinct())


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included) of every row of docs (doc_id, text).

    Rows with one set are one node, nodes with one size and prefix (the rarest shingles of the set, of which any linked
    pair has one in common) one group. Groups meet in the lists of their prefixes' shingles; size and position filters
    lose no link. Pairs of members are verified on whole sets in two steps: first each list's rows against a few of the
    list, and each group's against one member, since most of them lie in one component then; afterwards all pairs
    whose ends are still apart. Null or empty texts, and texts of rows without doc_id,
    have no set and are linked with nothing; repeated rows and ties are
    rows of one node; other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with steps() as kept:
        rows = settle(_prefixes(docs, _sketch(docs)))
        listed = rows.filter(F.col("prefix").isNotNull()).select("grp", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "grp", "n", (F.col("n") - F.col("pos")).alias("rest"))
        found = settle(_first_pairs(listed.repartition("token").sortWithinPartitions("token", F.desc(F.col("rest") / F.col("n")), "grp")))
        sweep(docs.sparkSession)
        made, long_ = found.filter(F.col("a").isNotNull()), found.filter(F.col("a").isNull()).select(F.col("b").alias("token"))
        nodes = settle(rows.filter(F.col("node").isNotNull()).groupBy("node", "grp").agg(F.min("doc_id").alias("doc_id")))
        groups = settle(nodes.groupBy("grp").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("k")))
        one = lambda c: groups.select(F.col("grp").alias(c), F.col("one").alias(f"one_{c}")).hint("merge")
        across = made.join(one("a"), "a").join(one("b"), "b").select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))
        inside = nodes.join(groups.filter("k > 1").hint("merge"), "grp").filter("doc_id <> one").select(F.col("one").alias("a"), F.col("doc_id").alias("b"))
        first = settle(across.union(inside))
        links = settle(_verified(docs, _possible(rows, first)))
        roots = components(links).select(F.col("node").alias("doc_id"), "root")
        sized = lookup(nodes, groups.select("grp", "k"), "grp")
        members = settle(sized.join(roots.hint("merge"), "doc_id", "left").select("grp", F.col("doc_id").alias("node"), "k", F.coalesce("root", "doc_id").alias("root")))
        others = _apart(made, members)
        if long_.head(1):
            others = others.union(_other_pairs(listed, long_, members))
        others = settle(others.distinct().join(first, ["a", "b"], "left_anti"))
        if others.head(1):
            links = settle(links.union(_verified(docs, _possible(rows, others))))
            roots = components(links).select(F.col("node").alias("doc_id"), "root")
        by_node = settle(nodes.join(roots.hint("merge"), "doc_id", "left").select("node", F.coalesce("root", "doc_id").alias("component_id")))
        kept += [rows, by_node]
        full = lookup(rows.select("doc_id", "n", "node").filter(F.col("node").isNotNull()), by_node, "node")
        bare = rows.filter(F.col("node").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(bare)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of their component; rows without doc_id stay.

    Rows with null or empty texts are linked with nothing and stay; rows that repeat a doc_id stay or go together; an
    empty table gives an empty result. Rows that surely stay, by a bitmap of those that go, are not shuffled.
    """
    with steps() as kept:
        whose = join(docs).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
        gone = settle(whose.filter("not stays").select(F.col("doc_id").alias("id")))
        kept.append(gone)
    rows = maybe_in(docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id")), gone, "id")
    sure = rows.filter(~F.coalesce("maybe", F.lit(False)))
    rest = rows.filter("maybe").join(gone.hint("merge"), "id", "left_anti")
    return sure.select("row.*").unionByName(rest.select("row.*"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
