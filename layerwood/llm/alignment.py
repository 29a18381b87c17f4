"""Cross-tokenizer alignment: tokens of two tokenizers linked where they end at the same byte.

A text is encoded twice, with a blank before it: by a byte-level BPE (A) and by a
piece model with byte fallback (B, which adds the blank itself).  Bytes of tokens
are laid side by side; places where tokens of both end cut the text into groups,
and the two tokens that end there are linked (no token is empty, so there is one
link per group).

How often a pair of ids is linked in the corpus is counted in four steps:

1. Tasks encode and align whole texts.  They write the ids of each text (two bytes
   each where the vocabularies allow it) and each distinct pair once, with its count.
2. The distinct pairs get a minimal perfect hash (``perfect_hash``).
3. What tasks sent becomes dense count vectors indexed by the hash, cut into
   slices, which are added up a tree, ``FAN`` at a time.
4. A second pass aligns every text again, from its ids, and looks its links up;
   keys are verified, an unknown pair is an error.

Linked tokens end with the same bytes, so the shorter is a suffix of the longer:
``pair_bound`` counts such pairs of the two vocabularies (under a million for
those used here).  Pairs, hash and counts are bounded by it, whatever the corpus
is; nothing else passes through the driver.

Texts of Latin characters only (below ``PLAIN`` in every leading byte) are encoded
by the same vocabulary and word pattern in a faster library; where character
classes of libraries could differ, by the file's own tokenizer.

Defined cases: null and empty texts, texts that are not valid UTF-8, and texts
whose tokens of either kind do not join to the blank and the text have no tokens
(zeros and empty strings); strings of special tokens are plain text; repeated rows
count as often as they stand; an empty table gives an empty result; all columns
stay, those named like results are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .perfect_hash import PerfectHash, perfect_hash

FAN = 16
#: Numbers in a slice of a count vector.
SLICE = 1 << 15
#: Bytes of text encoded together; a longer text is encoded alone.
BATCH = 1 << 20
#: Bytes of distinct pairs a task holds before it sends them.
HELD = 1 << 21
#: Leading bytes up to this one are of characters below U+0240.
PLAIN = 0xC8
#: Fixed value: how this kind of byte-level vocabulary cuts texts into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULTS = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "n_best": "long", "count_sum": "long", "groups": "string"}


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@dataclass(frozen=True)
class Encoders:
    """Both tokenizers and the bytes of their tokens."""

    a: object
    fast: object
    b: object
    a_bytes: tuple[bytes, ...]
    b_bytes: tuple[bytes, ...]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    marks: tuple[np.ndarray, ...]


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> Encoders:
    """Read once per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letters, vocabulary = byte_letters(), a.get_vocab()
    a_bytes = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        a_bytes[number] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
    special = set(a.get_added_tokens_decoder())
    ranks = {t: i for i, t in enumerate(a_bytes) if t and i not in special}
    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    b_bytes = [b"" if b.IsControl(i) or b.IsUnknown(i) else piece_bytes(b.IdToPiece(i)) for i in range(b.GetPieceSize())]
    marks = tuple(np.array([f"{i}{end}" for end in ends for i in range(len(names))], object) for names, ends in ((a_bytes, ",|"), (b_bytes, ",;")))
    return Encoders(a, fast, b, tuple(a_bytes), tuple(b_bytes), *(np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)), marks)


def pair_bound(enc: Encoders) -> int:
    """How many pairs of ids can be linked at all: one token's bytes end with the other's."""
    total = 0
    for ones, others in ((enc.a_bytes, enc.b_bytes), (enc.b_bytes, enc.a_bytes)):
        known: dict[bytes, int] = {}
        for t in others:
            known[t] = known.get(t, 0) + bool(t)
        # equal tokens are counted the first time only
        total += sum(known.get(t[i:], 0) for t in ones for i in range(0 if ones is enc.a_bytes else 1, len(t)))
    return total


@dataclass(frozen=True)
class Aligned:
    """Ids of both tokenizers, whether each ends a group, and the linked pairs as one number each."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @property
    def pairs(self) -> np.ndarray:
        return self.a[self.a_ends] << np.int64(32) | self.b[self.b_ends]


NOTHING = Aligned(*(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0, bool) for _ in range(2)))


def encode_a(raw: bytes, text: str, enc: Encoders) -> np.ndarray:
    """Ids of the blank and the text."""
    if np.frombuffer(raw, np.uint8).max() <= PLAIN:
        return enc.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
    return np.array(enc.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)


def side_by_side(a: np.ndarray, b: np.ndarray, enc: Encoders) -> Aligned:
    at_a, at_b = np.cumsum(enc.a_sizes[a]), np.cumsum(enc.b_sizes[b])
    ends = np.zeros((at_a[-1] if len(at_a) else 0) + 1, np.uint8)
    ends[at_a] = 1
    ends[at_b] += 1
    return Aligned(a, b, ends[at_a] == 2, ends[at_b] == 2)


def align(text: bytes, a: np.ndarray, b: list[int], enc: Encoders) -> Aligned:
    """Side by side, unless the tokens do not join to the blank and the text.

    A cuts bytes and changes none, so the lengths of its tokens tell whether they are all there.
    """
    whole = b" " + text
    if not len(a) or enc.a_sizes[a].sum() != len(whole) or b"".join([enc.b_bytes[i] for i in b]) != whole:
        return NOTHING
    return side_by_side(a, np.array(b, np.int64), enc)


def aligned(texts: list[bytes | None], enc: Encoders) -> Iterator[Aligned]:
    """Whole texts in their order, encoded some megabytes at a time."""

    def flush(held: list[tuple[bytes, str]]) -> Iterator[Aligned]:
        plain = [t for _, t in held if t]
        codes = iter(enc.b.encode(plain, num_threads=1) if plain else [])
        for raw, t in held:
            if not t:
                yield NOTHING
                continue
            yield align(raw, encode_a(raw, t, enc), next(codes), enc)

    held, size = [], 0
    for raw in texts:
        try:
            text = raw.decode() if raw else ""
        except UnicodeDecodeError:
            text = ""
        if size + len(text) > BATCH and held:
            yield from flush(held)
            held, size = [], 0
        held.append((raw, text))
        size += len(text)
    yield from flush(held)


def groups_text(x: Aligned, enc: Encoders) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``."""
    if not len(x.a):
        return ""
    # a token of A comes after the tokens of B of earlier groups, one of B after those of A of its own group too
    group_a, group_b = np.cumsum(x.a_ends) - x.a_ends, np.cumsum(x.b_ends) - x.b_ends
    upto_a, upto_b = (np.concatenate([[0], np.flatnonzero(e) + 1]) for e in (x.a_ends, x.b_ends))
    out = np.empty(len(x.a) + len(x.b), object)
    # ids behind which a group goes on stand first in the lists, those that end their part behind them
    out[np.arange(len(x.a)) + upto_b[group_a]] = enc.marks[0][x.a + len(enc.a_bytes) * x.a_ends]
    out[np.arange(len(x.b)) + upto_a[group_b + 1]] = enc.marks[1][x.b + len(enc.b_bytes) * x.b_ends]
    return "".join(out.tolist())[:-1]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def id_type(enc: Encoders) -> str:
    return "<u2" if max(len(enc.a_bytes), len(enc.b_bytes)) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, a_path: str, b_path: str, text: str, keep: list[T.StructField]) -> DataFrame:
    """First pass: per text its ids (``_a``, ``_b``), and behind them per task its distinct pairs with the number of links that hold each."""
    names = [*(f.name for f in keep), "_a", "_b", "_pair", "_count"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(a_path, b_path)
        form = id_type(enc)
        keys, counts, raw, size, types = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, None

        def merged():
            return summed(np.concatenate([keys, *raw]), np.concatenate([counts, np.ones(size, np.int64)]))

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            # few rows at a time where texts are long
            cuts = np.flatnonzero(np.diff(ends // (4 * BATCH))) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                part, a, b = batch.slice(low, high - low), [], []
                for x in aligned(part.column(part.num_columns - 1).to_pylist(), enc):
                    raw.append(x.pairs)
                    size += len(raw[-1])
                    a.append(x.a.astype(form).tobytes())
                    b.append(x.b.astype(form).tobytes())
                    if 8 * size > HELD:
                        keys, counts = merged()
                        raw, size = [], 0
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        keys, counts = merged()
        for low in range(0, len(keys), 1 << 16):
            some = keys[low:low + (1 << 16)]
            none = [pa.nulls(len(some), t) for t in [*types, pa.binary(), pa.binary()]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some), pa.array(counts[low:low + (1 << 16)])], names)

    free = [T.StructField(f.name, f.dataType) for f in keep]
    more = [T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType()), T.StructField("_pair", T.LongType()), T.StructField("_count", T.LongType())]
    given = docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text).cast("binary").alias("_raw"))
    return materialize(given.mapInArrow(counted, T.StructType([*free, *more])), "encoded")


def count_vector(sent: DataFrame, found: PerfectHash) -> np.ndarray:
    """Counts by hash number: dense vectors of the tasks, in slices, added up a tree."""
    size = len(found)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            at = found.find(batch.column(0).to_numpy())
            if (at < 0).any():
                raise ValueError("a pair that was not hashed")
            np.add.at(total, at, batch.column(1).to_numpy())
        if total.any():
            yield sliced(np.arange(0, size, SLICE), [total[low:low + SLICE] for low in range(0, size, SLICE)])

    def sliced(lows, vectors) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(lows, np.int64)), pa.array([v.tobytes() for v in vectors], pa.binary())], ["low", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in table.column("counts").to_pylist())
        return pa.Table.from_batches([sliced([table.column("low")[0].as_py()], [total])])

    level = sent.mapInArrow(dense, "low long, counts binary").withColumn("branch", F.spark_partition_id())
    tasks = sent.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        level = level.withColumn("branch", F.floor(F.col("branch") / FAN)).groupBy("low", "branch").applyInArrow(
            lambda key, table: added(table).append_column("branch", pa.array([key[1].as_py()], pa.int64())), "low long, counts binary, branch long")
    slices = level.groupBy("low").applyInArrow(added, "low long, counts binary").collect()
    total = np.zeros(size, np.int64)
    for r in slices:
        total[r["low"]:r["low"] + SLICE] = np.frombuffer(r["counts"], np.int64)
    return total


@dataclass(frozen=True)
class PairTable:
    """The corpus: hash of the distinct pairs, their counts, and the highest count of each id of B."""

    found: PerfectHash
    counts: np.ndarray
    best: np.ndarray


def learn_pairs(sent: DataFrame, enc: Encoders) -> PairTable:
    """Steps 2 and 3 from what the tasks sent (pair, count)."""
    bound = pair_bound(enc)
    keys = sent.select("pair").distinct().limit(bound + 1).toArrow().column(0).to_numpy()
    if len(keys) > bound:
        raise ValueError(f"more than {bound} distinct pairs: the tokens linked do not end with the same bytes")
    found = perfect_hash(keys)
    counts = count_vector(sent, found) if len(found) else np.zeros(0, np.int64)
    best = np.zeros(len(enc.b_bytes), np.int64)
    np.maximum.at(best, (found.keys & np.uint64(0xFFFFFFFF)).astype(np.int64), counts)
    return PairTable(found, counts, best)


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Columns of docs, numbers of tokens, groups and links, ``n_best``, ``count_sum``, and ``groups`` as text.

    ``n_best``: links whose pair is the most frequent one of its B id; ``count_sum``: the pairs' counts added over links.
    """
    keep = [f for f in docs.schema.fields if f.name not in RESULTS and (keep_text or f.name != text)]
    held = encoded(docs, a_path, b_path, text, keep)
    sent = held.filter("_pair IS NOT NULL").select(F.col("_pair").alias("pair"), F.col("_count").alias("count"))
    table = docs.sparkSession.sparkContext.broadcast(learn_pairs(sent, encoders(a_path, b_path)))
    names = [f.name for f in keep] + list(RESULTS)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pairs = encoders(a_path, b_path), table.value
        form = id_type(enc)

        def rows(part: pa.RecordBatch) -> pa.RecordBatch:
            n_a, n_b, n_links, keys, groups = [], [], [], [NOTHING.pairs], []
            for a, b in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                x = side_by_side(*(np.frombuffer(ids, form).astype(np.int64) for ids in (a, b)), enc) if a else NOTHING
                n_a.append(len(x.a))
                n_b.append(len(x.b))
                keys.append(x.pairs)
                n_links.append(len(keys[-1]))
                groups.append(groups_text(x, enc))
            # links of all texts of the part are looked up together
            key = np.concatenate(keys)
            at = pairs.found.find(key)
            if (at < 0).any():
                raise ValueError("a pair that was not hashed")
            counts = pairs.counts[at]
            ends = np.concatenate([[0], np.cumsum(np.array(n_links, np.int64))])
            best, total = (np.concatenate([[0], np.cumsum(v)])[ends] for v in (counts == pairs.best[key & 0xFFFFFFFF], counts))
            numbers = [n_a, n_b, n_links, n_links, np.diff(best), np.diff(total)]
            return pa.RecordBatch.from_arrays([*part.columns[:-2], *(pa.array(v, pa.int64()) for v in numbers), pa.array(groups, pa.string())], names)

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // (4 * BATCH))) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield rows(batch.slice(low, high - low))

    results = [T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in RESULTS.items()]
    ids = held.filter("_pair IS NULL").select(*(F.col(f"`{f.name}`") for f in keep), "_a", "_b")
    return ids.mapInArrow(looked_up, T.StructType([*(T.StructField(f.name, f.dataType) for f in keep), *results]))
