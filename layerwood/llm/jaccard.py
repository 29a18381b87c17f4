"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles, five words each (a shorter text is one
shingle).  Texts of equal sets are one node with a number of copies.

Candidates: a set is embedded as ``COORDINATES`` minhashes, so two sets share
about a share J of the coordinates.  In each run the sets go down a tree: at a
node every coordinate is chosen with probability 1 / (threshold x COORDINATES),
by a hash of the path, and the sets that agree in a chosen coordinate go on
together.  A bucket of at most ``SMALL`` sets is compared pair by pair; larger
ones are split again, down to ``DEPTH``; what is large even there is compared in
blocks, so no task gets more than two blocks.  Pairs whose minhashes agree in
about the threshold (less a margin of 3.5 standard errors) are candidates.  The
number of runs follows from the recall wanted for pairs just at the threshold.

Links: candidates only say which sets may belong together.  Within each group
of connected candidates all pairs are compared exactly, on the whole sets, in
blocks bounded by sets and by shingles; numbers of links are summed and a spanning forest of the
links leaves each block, never the pairs.  Groups of links are the classes.

Defined cases: null and blank texts have no shingles, no links, and are classes
of their own; repeated rows are copies; class ids are the smallest id in the
class (null only if all ids are null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, short_batches
from .components import components
from .contamination import small
from .text import LOWER, cut_words, handing_back, hash_words, joined, mixed, per_text

COORDINATES = 64
SMALL, DEPTH, BLOCK_SETS, BLOCK_SHINGLES = 128, 4, 1024, 300_000
#: Rows of a table of sets by sets that are looked at together.
STRIP = 512
PIECE = 1 << 20
_draw = np.random.default_rng(31)
FACTORS = _draw.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
PLACES = _draw.integers(1, 2**63, 32, dtype=np.uint64) | np.uint64(1)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes."""
    starts = joined(texts)[1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + PIECE, "right")) - 1)
        yield low, high
        low = high


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, ascending in each text, and how many each text has."""
    flat, starts = joined(texts)
    flat = LOWER[flat]
    begins, ends = cut_words(flat, starts)
    hashes, counts = hash_words(flat, begins, ends), per_text(begins, starts)
    first = np.cumsum(counts) - counts
    size = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    text = np.repeat(np.arange(len(size)), size)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    value = np.zeros(len(at), np.uint64)
    last = (first + counts)[text] - 1
    for k in range(words):
        there = at + k <= last
        value += np.where(there, hashes[np.minimum(at + k, len(hashes) - 1)] * PLACES[k], np.uint64(0)) if len(hashes) else 0
    value = mixed(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=len(size))


def set_hash(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set that is not empty."""
    at = np.cumsum(sizes) - sizes
    sums = [np.add.reduceat(mixed(values * PLACES[k]), at) for k in (30, 31)]
    return sums[0].view(np.int64), sums[1].view(np.int64)


def minhashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat((values * f) >> np.uint64(32), at) for f in FACTORS], axis=1).astype(np.uint32)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, hash1, hash2, n (shingles) and minhash (null without shingles) of every row of (id, text)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column("text")):
                values, sizes = shingle_sets(batch.column("text").slice(low, high - low), words)
                full = np.flatnonzero(sizes)
                one, two, sig = np.zeros(high - low, np.int64), np.zeros(high - low, np.int64), [None] * (high - low)
                if len(full):
                    one[full], two[full] = set_hash(values, sizes[full])
                    for i, m in zip(full, minhashes(values, sizes[full])):
                        sig[i] = m.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(one), pa.array(two), pa.array(sizes),
                                                  pa.array(sig, pa.binary())], ["id", "hash1", "hash2", "n", "minhash"])

    return docs.mapInArrow(handing_back(sketch), f"id {dict(docs.dtypes)['id']}, hash1 long, hash2 long, n long, minhash binary")


def runs_for(recall: float) -> int:
    """Runs until a pair at the threshold is found with this probability: it survives a level as a critical branching process."""
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def chosen(paths: np.ndarray, threshold: float) -> np.ndarray:
    """Which coordinates each node has chosen, as a table of path by coordinate."""
    h = mixed(paths.view(np.uint64)[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64) * PLACES[0])
    return (h >> np.uint64(11)).astype(float) < 2.0**53 / (threshold * COORDINATES)


def step_down(threshold: float, roots: np.ndarray | None = None) -> Callable:
    """Rows (path, uid, minhash) to rows (path, uid) of the chosen children; from all ``roots`` if given."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            uid = batch.column("uid").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("minhash").to_pylist()), np.uint32).reshape(n, -1)
            for root in [None] if roots is None else roots:
                paths = batch.column("path").to_numpy() if root is None else np.full(n, root)
                if root is None:
                    row, at = np.nonzero(chosen(paths, threshold))
                else:
                    picked = np.flatnonzero(chosen(paths[:1], threshold)[0])
                    row, at = np.repeat(np.arange(n), len(picked)), np.tile(picked, n)
                child = mixed(mixed(paths[row].view(np.uint64) * PLACES[1] + at.astype(np.uint64)) + sig[row, at])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(uid[row])], ["path", "uid"])

    return step


def groups_of(near: np.ndarray) -> np.ndarray:
    """The first member of each one's connected group, from a symmetric table."""
    first = np.full(len(near), -1)
    for i in range(len(near)):
        if first[i] < 0:
            front = np.array([i])
            first[i] = i
            while len(front):
                front = np.flatnonzero(near[front].any(0) & (first < 0))
                first[front] = i
    return first


def agreeing(sig: np.ndarray, least: int) -> np.ndarray:
    near = np.zeros((len(sig), len(sig)), bool)
    for low in range(0, len(sig), 64):
        near[low:low + 64] = (sig[low:low + 64, None, :] == sig[None]).sum(2, dtype=np.int16) >= least
    return near


def compare_buckets(least: int) -> Callable:
    """Rows (path, uid, minhash) in the order of paths to candidate edges, a forest per bucket."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in with_end(batches):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks()
            if not table.num_rows:
                continue
            path = table.column("path").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            if batch is not None:
                # the last bucket may go on
                rest = table.slice(int(cuts[-1])).combine_chunks().to_batches()[0]
                table, ends = table.slice(0, int(cuts[-1])), cuts[1:]
                cuts = cuts[:-1]
            else:
                ends = np.append(cuts[1:], len(path))
            if not len(cuts):
                continue
            uid = table.column("uid").to_numpy()
            sig = np.frombuffer(b"".join(table.column("minhash").to_pylist()), np.uint32).reshape(len(uid), -1)
            twos = cuts[ends - cuts == 2]
            twos = twos[(sig[twos] == sig[twos + 1]).sum(1) >= least]
            a, b = [uid[twos]], [uid[twos + 1]]
            for low, high in zip(cuts, ends):
                if high - low > 2:
                    first = groups_of(agreeing(sig[low:high], least))
                    other = np.flatnonzero(first != np.arange(len(first)))
                    a.append(uid[low + first[other]])
                    b.append(uid[low + other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return compared


def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    got = False
    for batch in batches:
        got = True
        yield batch
    if got:
        yield None


def candidates(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) between sets (uid, minhash) that may be similar enough."""
    margin = 3.5 * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = math.ceil((threshold - margin) * COORDINATES)
    roots = mixed(np.arange(1, runs_for(recall) + 1, dtype=np.uint64) * PLACES[2]).view(np.int64)
    rows = materialize(sets.select("uid", "minhash").mapInArrow(step_down(threshold, roots), "path long, uid long"), "paths")
    found = []
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        full = materialize(rows.join(counts, "path"), "buckets")
        last = depth == DEPTH
        few = full.filter(F.col("size") <= SMALL).select("path", "uid")
        many = full.filter(F.col("size") > SMALL)
        if last:
            blocks = F.ceil(F.col("size") / BLOCK_SETS)
            own = F.pmod(F.xxhash64("uid"), blocks)
            pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.xxhash64("path", F.least(own, b), F.greatest(own, b))))
            few = few.unionByName(many.select(pair.alias("path"), "uid"))
        few = few.join(sets.select("uid", "minhash"), "uid").select("path", "uid", "minhash")
        few = few.repartition("path").sortWithinPartitions("path", "uid")
        found.append(materialize(few.mapInArrow(compare_buckets(least), "a long, b long").distinct(), "candidates"))
        if last or many.isEmpty():
            break
        many = many.select("path", "uid").join(sets.select("uid", "minhash"), "uid").select("path", "uid", "minhash")
        rows = materialize(many.mapInArrow(step_down(threshold), "path long, uid long"), "paths")
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """uid and shingles (packed) of the wanted sets (uid, hash1, hash2, id): their texts are read again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in pieces(batch.column(0)):
                values, sizes = shingle_sets(batch.column(0).slice(low, high - low), words)
                full = np.flatnonzero(sizes)
                if len(full):
                    one, two = set_hash(values, sizes[full])
                    ends = np.cumsum(sizes[full])
                    sets = [values[e - s:e].tobytes() for e, s in zip(ends, sizes[full])]
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(sets, pa.binary())], ["hash1", "hash2", "shingles"])

    ids = small(materialize(wanted.select(F.col("id").alias("_id")).distinct(), "ids"))
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.mapInArrow(handing_back(packed), "hash1 long, hash2 long, shingles binary")
    return sets.join(wanted.select("uid", "hash1", "hash2"), ["hash1", "hash2"]).select("uid", "shingles").dropDuplicates(["uid"])


def compare_blocks(threshold: float) -> Callable:
    """All pairs of a block pair: per set the copies it is linked to, and a spanning forest of the links."""

    def compared(table: pa.Table) -> pa.Table:
        uid, side = table.column("uid").to_numpy(), table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        packed, starts = joined(table.column("shingles"))
        values, sizes = np.frombuffer(packed.tobytes(), np.uint64), np.diff(starts) // 8
        owner = np.repeat(np.arange(len(uid)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        count = np.diff(np.append(cuts, len(values)))
        # shingles of one set alone are in no pair
        shared = np.repeat(count > 1, count)
        owner, word = owner[shared], np.repeat(np.arange(len(cuts)), count)[shared]
        word = np.unique(word, return_inverse=True)[1]
        common = np.zeros((len(uid), len(uid)), np.float32)
        for low in range(0, (int(word[-1]) + 1) if len(word) else 0, 2048):
            part = slice(*np.searchsorted(word, [low, low + 2048]))
            held = np.zeros((len(uid), 2048), np.float32)
            held[owner[part], word[part] - low] = 1
            common += held @ held.T
        near, links = np.zeros(common.shape, bool), np.zeros(len(uid), np.int64)
        apart = table.column("i")[0] != table.column("j")[0]
        for low in range(0, len(uid), STRIP):
            part = slice(low, low + STRIP)
            union = (sizes[part, None] + sizes[None]).astype(np.float32) - common[part]
            near[part] = common[part] >= threshold * union - 1e-3
            if apart:
                near[part] &= side[part, None] != side[None]
            near[part][np.arange(len(union)), np.arange(low, low + len(union))] = False
            links[part] = np.where(near[part], copies, 0).sum(axis=1)
        first = groups_of(near)
        other = np.flatnonzero(first != np.arange(len(uid)))
        n, m = len(uid), len(other)
        return pa.table([pa.array(np.concatenate([uid, uid[other]])), pa.array(np.concatenate([links, np.zeros(m, np.int64)])),
                         pa.array([None] * n + uid[first[other]].tolist(), pa.int64())], ["uid", "links", "peer"])

    return compared


def exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """uid, links (copies linked to), peer (an edge, or null) from all pairs in each group of sets (uid, root, n, copies, shingles)."""
    blocks = sets.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS)).alias("blocks"))
    rows = sets.join(blocks, "root")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks"))
    rows = rows.select("uid", "root", "copies", "shingles", own.alias("side"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("uid", "copies", "shingles", "side", "root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    return rows.groupBy("root", "i", "j").applyInArrow(compare_blocks(threshold), "uid long, links long, peer long")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8,
                 recall: float = 0.99) -> DataFrame:
    """key, class_id and n_links (other rows at least this similar) of every row."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    with short_batches(docs.sparkSession):
        rows = materialize(sketched(docs, words), "sketches")
    sets = rows.filter("n > 0").groupBy("hash1", "hash2").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("minhash").alias("minhash"))
    sets = materialize(sets.withColumn("uid", F.monotonically_increasing_id()), "sets")
    groups = components(candidates(sets, threshold, recall))
    wanted = materialize(sets.join(groups.withColumnRenamed("node", "uid"), "uid").select("uid", "root", "hash1", "hash2", "id", "n", "copies"), "wanted")
    whole = wanted.select("uid", "root", "n", "copies").join(whole_sets(docs, wanted, words), "uid")
    found = materialize(exact_links(whole, threshold), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = components(found.filter("peer IS NOT NULL").select(F.col("uid").alias("a"), F.col("peer").alias("b")))
    sets = sets.select("hash1", "hash2", "uid", "id", "copies").join(links, "uid", "left").join(classes.withColumnRenamed("node", "uid"), "uid", "left")
    sets = materialize(sets.withColumn("root", F.coalesce("root", "uid")), "linked")
    smallest = sets.groupBy("root").agg(F.min("id").alias("class_id"))
    sets = sets.join(smallest, "root").select("hash1", "hash2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = rows.filter("n > 0").select("id", "hash1", "hash2").join(sets, ["hash1", "hash2"]).select(F.col("id").alias(key), "class_id", "n_links")
    blank = rows.filter("n = 0").select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(blank)
