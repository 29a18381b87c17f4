"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of all byte contexts up to ``ORDER`` bytes in the training
texts, every text between end marks (byte 255, which UTF-8 never has).  A byte is
coded in the longest context that was seen; if it is new there, an escape is
coded and the next shorter context is used, with all bytes of the longer one
excluded.  Escapes by method D: each byte seen in a context gives up ``ESCAPE`` of
its count.  Shorter contexts are updated only where a byte is new in the longer
one.  Behind the empty context all bytes that are left are equally likely.  A
text's score is the log10 probability of its bytes and its end.

Counts cover all training texts and the trie may be of any size: it is never in
one place.  Texts are written once, in chunks of about ``CHUNK`` bytes.  A chunk
sends its distinct n-grams and word hashes with their counts, packed, to buckets;
n-grams go by the last two bytes of their context, so a bucket holds the whole
subtree that the escapes of its n-grams walk through, except the order-0 and
order-1 counts (65,536 numbers, sent to all).  The bucket adds up counts and
returns one number per n-gram or word to each chunk, where the texts are scored.

Defined cases: null texts are empty; an empty text still has its end; without
training texts all bytes are equally likely; words are known by 64-bit hashes;
rows repeated in the input are scored and learned each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import LOWER, cut_words, hash_words, joined, mixed, per_text

ORDER = 5
CHUNK = 16 << 20
#: Bytes of a chunk that are looked at together.
BLOCK = 2 << 20
#: What a seen byte gives up for the escape.
ESCAPE = 0.4
END = 255
GRAM, WORD = 0, 1
U8 = np.uint64(8)


def pack(values: np.ndarray) -> bytes:
    """Equal bytes of the numbers stand together, which packs better."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def grams_of(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (context and byte) of the given texts and their ends, and how many each text has."""
    sizes = (starts[1:] - starts[:-1])[rows]
    begins = np.cumsum(np.concatenate([[ORDER], sizes + ORDER]))
    line = np.full(begins[-1], END, np.uint8)
    for to, row, size in zip(begins.tolist(), rows.tolist(), sizes.tolist()):
        line[to:to + size] = flat[starts[row]:starts[row] + size]
    grams = line[:-ORDER].astype(np.uint64)
    for k in range(1, ORDER + 1):
        grams <<= U8
        grams |= line[k:len(line) - ORDER + k]
    keep = np.ones(len(grams), bool)
    for k in range(1, ORDER):
        # what follows the end mark of a text is no symbol
        spare = begins[:-1] + sizes + k - ORDER
        keep[spare[spare < len(grams)]] = False
    return grams[keep], sizes + 1


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    values = np.sort(values)
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.diff(np.append(new, len(values)))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def learned(all_keys: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(all_keys), np.int64)
    out[np.searchsorted(all_keys, keys)] = counts
    return out


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    part = (keys >> U8) & np.uint64(0xFFFF) if kind == GRAM else keys
    return (mixed(part + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per bucket the places of its keys, in the order of the keys."""
    home = bucket_of(kind, keys, buckets)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b]:cuts[b + 1]]


def words_of(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = cut_words(flat, starts)
    return hash_words(flat, begins, ends), per_text(begins, starts)


def blocks(starts: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in runs of about BLOCK bytes."""
    size = np.cumsum((starts[1:] - starts[:-1])[rows] + ORDER)
    low = 0
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(size, BLOCK + (size[low - 1] if low else 0), "right")))
        yield rows[low:high]
        low = high


def gathered(flat: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of the given texts and their counts."""
    held = [distinct(grams_of(flat, starts, some)[0]) for some in blocks(starts, rows)]
    return added(*(np.concatenate(x) for x in zip(*held))) if held else distinct(np.zeros(0, np.uint64))


def chunk_keys(flat: np.ndarray, starts: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For both kinds: sorted distinct keys of the texts, and their counts in training texts."""
    own, n = gathered(flat, starts, np.flatnonzero(train))
    keys = np.union1d(own, gathered(flat, starts, np.flatnonzero(~train))[0])
    yield GRAM, keys, learned(keys, own, n)
    words, counts = words_of(flat, starts)
    keys, _ = distinct(words)
    yield WORD, keys, learned(keys, *distinct(words[np.repeat(train, counts)]))


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that stand together in the input, about CHUNK bytes; a longer text is a chunk of its own."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(np.diff(joined(batch.column("text"))[1]) + ORDER)
        low = 0
        while low < batch.num_rows:
            room = CHUNK - size + (sizes[low - 1] if low else 0)
            high = max(int(np.searchsorted(sizes, room, "right")), low + (not held))
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(sizes[high - 1] - (sizes[low - 1] if low else 0))
            if high < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            low = high
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunked_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of kind -1 are the texts with their chunk; the others hold a chunk's keys of a kind and
    bucket with their training counts, packed."""
    kinds = dict(docs.dtypes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nth, batch in enumerate(in_chunks(batches)):
            chunk = (TaskContext.get().partitionId() << 32) + nth
            n = batch.num_rows
            same = lambda value, kind, n: pa.array(np.full(n, value), kind)
            names = ["key", "train", "text", "chunk", "kind", "bucket", "keys", "counts"]
            types = [f.type for f in batch.schema]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, same(chunk, pa.int64(), n), same(-1, pa.int32(), n), pa.nulls(n, pa.int32()),
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
            flat, starts = joined(batch.column("text"))
            for kind, keys, counts in chunk_keys(LOWER[flat], starts, batch.column("train").to_numpy(zero_copy_only=False)):
                rows = [(b, pack_sorted(keys[at]), pack(counts[at].astype(np.uint32))) for b, at in by_bucket(kind, keys, buckets)]
                if rows:
                    m, (b, k, c) = len(rows), zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.nulls(m, t) for t in types), same(chunk, pa.int64(), m), same(kind, pa.int32(), m),
                         pa.array(b, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names)

    return docs.mapInArrow(counted, f"key {kinds['key']}, train boolean, text string, chunk long, kind int, bucket int, "
                                    "keys binary, counts binary")


def pair_counts(counted: DataFrame) -> np.ndarray:
    """In how many different contexts of one more byte each (byte, next byte) was seen in training texts.

    256 x 256 numbers, whatever the corpus.
    """

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = unpack_sorted(keys)[unpack(counts, np.uint32) > 0]
                held = np.union1d(held, keys & np.uint64(0xFFFFFF))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64))], ["triple"])

    rows = counted.filter(F.col("kind") == GRAM).select("keys", "counts").mapInArrow(triples, "triple long")
    out = np.zeros(1 << 16, np.int64)
    for row in rows.distinct().groupBy((F.col("triple") % (1 << 16)).alias("pair")).count().collect():
        out[row["pair"]] = row["count"]
    return out.reshape(256, 256)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(a / b), 0 where nothing is left to tell apart."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), np.log(np.where(a > 0, a, 1) / np.where(b > 0, b, 1)), 0.0)


def code_lengths(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Natural log probability of the last byte of each n-gram in its context.

    ``grams`` sorted and distinct, with all that were counted for their last two
    context bytes; ``pairs`` as of ``pair_counts``.  The longest contexts have
    counts; a shorter one counts in how many contexts of one more byte a byte
    follows.  ``whole`` is the log probability when coding starts in a context,
    ``below`` the one after an escape from it, its own bytes excluded.
    """
    single = np.count_nonzero(pairs, axis=0)
    total, kinds = single.sum(), np.count_nonzero(single)
    rest = -np.log(max(256 - kinds, 1))
    whole0 = np.where(single > 0, ratio(single - ESCAPE, total), ratio(ESCAPE * kinds, total) + rest)
    # order 1, all pairs at once
    n, d = pairs.sum(1, keepdims=True), np.count_nonzero(pairs, axis=1)[:, None]
    left = total - (single * (pairs > 0)).sum(1, keepdims=True)
    below1 = np.where(single > 0, ratio(single - ESCAPE, left), ratio(ESCAPE * (kinds - d), left) + rest)
    whole1 = np.where(n == 0, whole0, np.where(pairs > 0, ratio(pairs - ESCAPE, n), ratio(ESCAPE * d, n) + below1))
    low = {"key": np.arange(1 << 16, dtype=np.uint64), "n": pairs.ravel(), "whole": whole1.ravel(), "below": below1.ravel(),
           "context_n": np.repeat(n.ravel(), 256), "context_d": np.repeat(d.ravel(), 256)}
    levels = {ORDER: (grams, counts)}
    for k in range(ORDER - 1, 1, -1):
        key, n = levels[k + 1]
        levels[k] = added(key & np.uint64((1 << 8 * (k + 1)) - 1), (n > 0).astype(np.int64))
    for k in range(2, ORDER + 1):
        key, n = levels[k]
        up = np.searchsorted(low["key"], key & np.uint64((1 << 8 * k) - 1))
        _, at = np.unique(key >> U8, return_inverse=True)
        total, kinds = np.bincount(at, n)[at], np.bincount(at, n > 0)[at]
        excluded = np.bincount(at, np.where(n > 0, low["n"][up], 0))[at]
        left, kinds_left = low["context_n"][up] - excluded, low["context_d"][up] - kinds
        below = np.where(low["n"][up] > 0, ratio(low["n"][up] - ESCAPE, left), ratio(ESCAPE * kinds_left, left) + low["below"][up])
        whole = np.where(total == 0, low["whole"][up], np.where(n > 0, ratio(n - ESCAPE, total), ratio(ESCAPE * kinds, total) + below))
        low = {"key": key, "n": n, "whole": whole, "below": below, "context_n": total, "context_d": kinds}
    return low["whole"]


def answer_chunks(counted: DataFrame, pairs: np.ndarray) -> DataFrame:
    """Per row of ``counted`` the value of each key: log10 probability of n-grams, training count of words.

    Rows of kind -1 hold how many distinct training words, and how many in all, a bucket has.
    """
    schema = "chunk long, kind int, bucket int, value binary, known long, total long"

    def answered(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = [unpack(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist()]
        names, sums = added(np.concatenate(keys), np.concatenate(counts))
        if kind == GRAM:
            value, known = (code_lengths(names, sums, pairs) / np.log(10)).astype(np.float32), 0
        else:
            value, known = sums, 1
        chunks = table.column("chunk").to_pylist()
        # values alone: the chunk knows its keys and their order
        packed = [pack(value[np.searchsorted(names, k)]) for k in keys]
        n = len(chunks)
        return pa.table([pa.array(chunks + [None] * known, pa.int64()), pa.array([kind] * n + [-1] * known, pa.int32()),
                         pa.array([bucket] * (n + known), pa.int32()), pa.array(packed + [None] * known, pa.binary()),
                         pa.array([None] * n + [np.count_nonzero(sums)] * known, pa.int64()),
                         pa.array([None] * n + [int(sums.sum())] * known, pa.int64())],
                        ["chunk", "kind", "bucket", "value", "known", "total"])

    return counted.groupBy("kind", "bucket").applyInArrow(answered, schema)


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns key, n_tokens, n_known, train_tokens, base_score and score for every row; ``train`` says which rows to learn from."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    held = materialize(chunked_counts(rows, buckets), "chunks")
    chunks, counted = held.filter("kind = -1").select("chunk", "key", "train", "text"), held.filter("kind >= 0")
    answers = materialize(answer_chunks(counted.select("chunk", "kind", "bucket", "keys", "counts"), pair_counts(counted)), "answers")
    # three numbers reach the driver
    ends = chunks.filter("train").count()
    words = answers.filter("kind = -1").agg(F.sum("known"), F.sum("total")).first()
    vocabulary, total = (words[0] or 0) + (ends > 0), (words[1] or 0) + ends
    key_type = dict(rows.dtypes)["key"]
    schema = f"key {key_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    log_base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, starts = joined(left.column("text"))
        flat, n = LOWER[flat], left.num_rows
        values = {(k, b): v for k, b, v in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "value")))}

        def table(kind: int, keys: np.ndarray, form: type) -> np.ndarray:
            out = np.empty(len(keys), form)
            for b, at in by_bucket(kind, keys, buckets):
                out[at] = unpack(values[(kind, b)], form)
            return out

        keys = gathered(flat, starts, np.arange(n))[0]
        logs, score = table(GRAM, keys, np.float32).astype(float), np.zeros(n)
        for rows in blocks(starts, np.arange(n)):
            grams, sizes = grams_of(flat, starts, rows)
            names, at = np.unique(grams, return_inverse=True)
            score[rows] = np.add.reduceat(logs[np.searchsorted(keys, names)][at], np.cumsum(sizes) - sizes)
        words, counts = words_of(flat, starts)
        keys, at = np.unique(words, return_inverse=True)
        seen = table(WORD, keys, np.int64)
        of = np.repeat(np.arange(n), counts)
        base = np.bincount(of, log_base(seen)[at], n) + log_base(ends)
        known = np.bincount(of, (seen > 0)[at], n).astype(np.int64) + (ends > 0)
        return pa.table([left.column("key"), pa.array(counts + 1), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score)],
                        ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    texts = chunks.select("chunk", "key", "text").groupBy("chunk")
    sent = answers.filter("kind >= 0").select("chunk", "kind", "bucket", "value").groupBy("chunk")
    return texts.cogroup(sent).applyInArrow(scored, schema).withColumnRenamed("key", key)
