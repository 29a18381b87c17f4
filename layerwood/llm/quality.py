"""Quality: a generalised additive model with pairwise interactions over text features.

Each text becomes numbers (``FEATURES``): its size, shares of letters, capitals,
digits and signs, words and lines that repeat, and so on.  A feature is cut
into ``BINS`` bins of about equal shares.  Cyclic boosting goes round the features:
a tree of few leaves on one feature's bins follows the gradient of the logistic
loss, and its small step is added to the feature's lookup table.  Then the pairs of
features whose best two-way cut gains most are boosted in the same way with
tables over coarser bins.  A score is the sum of the looked-up values of a row's bins.

Features are computed once over whole texts and written; labels meet these narrow
rows.  The tables are fitted on at most ``fit_rows`` different labelled texts (by
smallest hash of the text; copies of a text count once).  ``1 / HELD`` of them, by
hash, judge after how many rounds to stop.

Defined cases: null texts count as empty; empty texts have their own bins (all
features 0) and are scored as any other; null labels and labels of unknown
documents are left out; a document with several labels is good if at least half of
them say so, a text if at least half of its labelled documents are; with labels of
one class all scores are near that class, without any 0.5; other columns stay,
those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import cut_words, hash_words, joined, mixed, per_text

#: What a text is described by, in the order of the vector.
FEATURES = ("bytes", "words", "lines", "word_bytes", "line_words", "capitals", "letters", "digits", "marks", "signs", "signs_twice", "breaks",
            "upper_words", "title_words", "signed_words", "short_words", "long_words", "word_ends", "words_again", "top_word", "pairs_again",
            "runs_again", "lines_again", "line_bytes_again", "byte_entropy")
BINS, COARSE, HELD = 32, 8, 6
#: Bytes of text looked at together; a longer text is looked at alone.
BATCH = 1 << 21

LOWER, UPPER, BEYOND, DIGIT, MARK, SIGN, SPACE, BREAK = range(8)
KINDS = np.full(256, SIGN, np.uint8)
for _chars, _kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(128, 256), BEYOND), (range(48, 58), DIGIT),
                      (b".,;:?!'\"()-", MARK), (b" \t\x0b\x0c\r", SPACE), (b"\n", BREAK)):
    KINDS[list(_chars)] = _kind
SIGNS = (KINDS == SIGN) | (KINDS == MARK)
LINE_ENDS = np.zeros(256, bool)
LINE_ENDS[10] = True


def again(owner: np.ndarray, names: np.ndarray, texts: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Share of things of each text that stand there before, and the share of its most frequent one."""
    if not len(names):
        return np.zeros(texts), np.zeros(texts)
    order = np.lexsort((names, owner))
    o, h = owner[order], names[order]
    w = np.ones(len(o)) if weight is None else weight[order].astype(float)
    first = np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(w, starts)
    total, once, top = np.bincount(o, w, texts), np.bincount(o[starts], w[starts], texts), np.zeros(texts)
    np.maximum.at(top, o[starts], sums)
    return 1 - once / np.maximum(total, 1e-9) * (total > 0) - (total == 0), top / np.maximum(total, 1)


def shingles(owner: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` neighbouring words within a text."""
    n = len(words) - size + 1
    if n <= 0:
        return owner[:0], words[:0]
    rolled = np.zeros(n, np.uint64)
    for i in range(size):
        rolled = mixed(rolled + words[i:i + n]) + np.uint64(i)
    inside = owner[:n] == owner[size - 1:]
    return owner[:n][inside], rolled[inside]


def inside(flags: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each stretch."""
    upto = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=upto[1:])
    return upto[ends] - upto[begins]


def describe(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of texts that stand one behind another in ``flat``."""
    texts = len(starts) - 1
    sizes = np.diff(starts).astype(float)
    kind = KINDS[flat]
    bytes_of, twice = np.zeros((texts, 256)), np.zeros(texts)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        for low in range(a, b, BATCH):
            part = flat[low:min(b, low + BATCH)]
            bytes_of[i] += np.bincount(part, minlength=256)
            before = flat[low:min(b, low + BATCH + 1)]
            twice[i] += np.count_nonzero(SIGNS[before[1:]] & (before[1:] == before[:-1]))
    counts = np.stack([bytes_of[:, KINDS == k].sum(axis=1) for k in range(8)], axis=1)
    letters = counts[:, LOWER] + counts[:, UPPER] + counts[:, BEYOND]
    share = lambda part, whole: part / np.maximum(whole, 1)
    begins, ends = cut_words(flat, starts)
    words = hash_words(flat, begins, ends)
    word_owner = np.repeat(np.arange(texts), per_text(begins, starts))
    n_words = np.bincount(word_owner, minlength=texts).astype(float)
    length = ends - begins
    first, last = (kind[begins], kind[ends - 1]) if len(begins) else (kind[:0], kind[:0])
    upper, signed = (inside(kind == k, begins, ends) for k in (UPPER, SIGN))
    of_words = lambda flags: share(np.bincount(word_owner, flags, texts), n_words)
    line_begins, line_ends = cut_words(flat, starts, LINE_ENDS)
    lines = hash_words(flat, line_begins, line_ends)
    line_owner = np.repeat(np.arange(texts), per_text(line_begins, starts))
    n_lines = np.bincount(line_owner, minlength=texts).astype(float)
    words_again, top_word = again(word_owner, words, texts)
    p = bytes_of / np.maximum(sizes, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    return np.stack([
        np.log1p(sizes), np.log1p(n_words), np.log1p(n_lines), share(np.bincount(word_owner, length, texts), n_words), share(n_words, n_lines),
        share(counts[:, UPPER], counts[:, UPPER] + counts[:, LOWER]), share(letters, sizes), share(counts[:, DIGIT], sizes), share(counts[:, MARK], sizes),
        share(counts[:, SIGN], sizes), share(twice, sizes), share(counts[:, BREAK], sizes),
        of_words((upper == length) & (length > 1)), of_words((first == UPPER) & (upper < length)), of_words(signed > 0), of_words(length <= 2), of_words(length > 12),
        of_words(last == MARK), words_again, top_word, again(*shingles(word_owner, words, 2), texts)[0], again(*shingles(word_owner, words, 5), texts)[0],
        again(line_owner, lines, texts)[0], again(line_owner, lines, texts, line_ends - line_begins)[0], entropy], axis=1)


def text_features(docs: DataFrame, text: str = "text", into: str = "features", keep_text: bool = True) -> DataFrame:
    """Add the features of whole texts as an array."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = joined(batch.column(batch.num_columns - 1))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(starts, starts[low] + BATCH, "right")) - 1)
                rows = describe(flat[starts[low]:starts[high]], starts[low:high + 1] - starts[low])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], values], names)
                low = high

    kept = [f for f in docs.schema.fields if f.name != into and (keep_text or f.name != text)]
    names = [f.name for f in kept] + [into]
    given = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(text).cast("binary").alias("_raw"))
    return given.mapInArrow(described, T.StructType([*kept, T.StructField(into, T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class QualityModel:
    """Bin edges, a lookup table per feature, coarse edges and tables of the pairs, and the start value."""

    start: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    coarse: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int], ...]
    pair_tables: tuple[np.ndarray, ...]

    def add_up(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            bins = binned(x, self.coarse)
            for (f, g), table in zip(self.pairs, self.pair_tables):
                total += table[bins[:, f], bins[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def edges_of(x: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    return tuple(np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T)


def binned(x: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)


def worth(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g * g / (h + penalty)


def best_cut(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 where none is allowed."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = worth(left_g, left_h, penalty) + worth(right_g, right_h, penalty) - worth(g.sum(), h.sum(), penalty)
    gain[(left_h < least) | (right_h < least)] = -1
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 0 else (0.0, 0)


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, penalty: float) -> np.ndarray:
    """Leaf values by bin of a tree of at most ``leaves`` leaves on one feature."""
    parts, open_ = [(0, len(g))], {}
    while len(parts) < leaves:
        for a, b in parts:
            if (a, b) not in open_:
                open_[a, b] = best_cut(g[a:b], h[a:b], least, penalty)
        a, b = max(parts, key=lambda p: open_[p][0])
        if not open_[a, b][1]:
            break
        parts.remove((a, b))
        parts += [(a, a + open_[a, b][1]), (a + open_[a, b][1], b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def plane_tree(g: np.ndarray, h: np.ndarray, least: float, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values by pair of bins: one cut on the first feature, then one on the second on each side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + penalty)))
    all_ = worth(g.sum(), h.sum(), penalty)
    for flip in (False, True):
        u, v = (g.T, h.T) if flip else (g, h)
        for at in range(1, len(u)):
            gain, out = -all_, np.empty(u.shape)
            for side in (slice(0, at), slice(at, None)):
                gs, hs = u[side].sum(axis=0), v[side].sum(axis=0)
                more, cut = best_cut(gs, hs, least, penalty)
                gain += more + worth(gs.sum(), hs.sum(), penalty)
                for piece in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                    out[side, piece] = gs[piece].sum() / (hs[piece].sum() + penalty)
            if gain > best[0]:
                best = (float(gain), out.T if flip else out)
    return best


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 300, rate: float = 0.1, leaves: int = 3, pairs: int = 8,
          least: float = 2.0, penalty: float = 1.0, patience: int = 25) -> QualityModel:
    """Cyclic boosting; ``held`` rows do not steer the trees, their loss picks the number of rounds."""
    edges, coarse = edges_of(x[~held], BINS), edges_of(x[~held], COARSE)
    bins, rough = binned(x, edges), binned(x, coarse)
    share = float(np.clip(y[~held].mean(), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), start)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return np.where(held, 0, y - p), np.where(held, 0, np.maximum(p * (1 - p), 1e-6))

    def loss() -> float:
        z = np.clip(total, -30, 30)
        each = np.log1p(np.exp(z)) - y * z
        return float(each[held].mean() if held.any() else each.mean())

    def cycle(steps, state) -> None:
        """Rounds until the loss of held rows has not fallen for some; what came after its least is undone."""
        nonlocal total
        best, kept, waited = loss(), [t.copy() for t in state], 0
        kept_total = total.copy()
        for _ in range(rounds):
            for step in steps:
                step()
            if (now := loss()) < best - 1e-6:
                best, kept, waited, kept_total = now, [t.copy() for t in state], 0, total.copy()
            elif (waited := waited + 1) >= patience:
                break
        state[:], total = kept, kept_total

    def on_line(f: int):
        def step() -> None:
            nonlocal total
            g, h = gradients()
            n = len(tables[f])
            change = rate * line_tree(np.bincount(bins[:, f], g, n), np.bincount(bins[:, f], h, n), leaves, least, penalty)
            tables[f] += change
            total = total + change[bins[:, f]]
        return step

    cycle([on_line(f) for f in range(x.shape[1]) if len(edges[f])], tables)

    def plane(values: np.ndarray, f: int, g: int) -> np.ndarray:
        m, n = len(coarse[f]) + 1, len(coarse[g]) + 1
        return np.bincount(rough[:, f] * n + rough[:, g], values, m * n).reshape(m, n)

    slope, curve = gradients()
    ranked = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            if len(coarse[f]) and len(coarse[g]):
                ranked.append((-plane_tree(plane(slope, f, g), plane(curve, f, g), least, penalty)[0], f, g))
    chosen = [(f, g) for gain, f, g in sorted(ranked)[:pairs] if gain < 0]
    pair_tables = [np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1)) for f, g in chosen]

    def on_plane(i: int, f: int, g: int):
        def step() -> None:
            nonlocal total
            slope, curve = gradients()
            change = rate * plane_tree(plane(slope, f, g), plane(curve, f, g), least, penalty)[1]
            pair_tables[i] += change
            total = total + change[rough[:, f], rough[:, g]]
        return step

    cycle([on_plane(i, f, g) for i, (f, g) in enumerate(chosen)], pair_tables)
    return QualityModel(start, edges, tuple(tables), coarse, tuple(chosen), tuple(pair_tables))


def fit_quality(rows: DataFrame, labels: DataFrame, key: str = "doc_id", content: str = "content", features: str = "features",
                label: str = "quality", fit_rows: int = 20_000) -> QualityModel:
    """Fit on rows (key, hash of the text, features) and labels (key, label)."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        (F.avg((F.col(label) > 0).cast("int")) >= 0.5).cast("int").alias("_label"))
    sample = rows.select(key, F.col(content).alias("_text"), F.col(features).alias("_x")).join(marked, F.col(key) == F.col("_id"))
    sample = sample.groupBy("_text").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"), F.first("_x").alias("_x"))
    # a hash limit lets few rows more than the sample into the sort
    count = sample.count()
    if count > fit_rows:
        part = int(min(1.0, fit_rows / count + 4 * (fit_rows ** 0.5) / count) * (1 << 32))
        sample = sample.filter(F.pmod(F.xxhash64(F.lit(7), "_text"), F.lit(1 << 32)) < part)
    table = sample.orderBy(F.xxhash64(F.lit(7), "_text"), "_text").limit(fit_rows).toPandas()
    y = table["_label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return QualityModel(0.0 if not len(y) else (10.0 if y[0] else -10.0), (), (), (), (), ())
    x = np.stack(table["_x"].to_numpy())
    held = mixed(table["_text"].to_numpy(np.int64).view(np.uint64)) % np.uint64(HELD) == 0
    if len(np.unique(y[~held])) < 2:
        held[:] = False
    return boost(x, y, held)


def quality_score(model: QualityModel, features: Column) -> Column:
    """Probability of label 1 of a column of features."""

    @F.pandas_udf("double")
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(model.add_up(np.stack(rows.to_numpy())) if len(rows) else np.zeros(0))

    return scored(features)
