"""Removal of repeated passages: bytes covered by a string of ``length`` bytes (400) that starts anywhere else too.

Suffixes are sorted only at anchors.  The anchor of a string is the place in it
where the hash of a core (a quarter of the length) is smallest (the first such place), so equal
strings have equal anchors, about one place in 150 is one, and strings are equal
only if their anchors start with the same core.  A string that starts at p is
known by its anchor a and the distance d = a - p; an anchor stands for a range of
distances, and all that its strings hold is its context.

1. Each task lists anchors with hashes of core and context.  Cores that occur
   once are done with.  A context that occurs twice settles all its strings.
2. Cores with different contexts: one text per context is read again.  Their
   suffixes (and, reversed, what stands before them) are ordered by deep-shallow
   sorting.  Common prefixes with the neighbours tell for every d which anchors
   share length - d bytes to the right and d bytes to the left: that is another
   occurrence of the string.
3. A core with more than ``MOST`` contexts is not sorted in one task: the strings
   of its anchors are counted by hash, in as many groups as there are strings.

Bytes are judged on the input.  Keys of a text are hashes of its id and content;
cores, contexts and the strings of step 3 are known by 64-bit hashes.  A core (or
context) of more than one in ``SHARES`` anchors is one of at most that many, so it
meets its anchors by broadcast; the others meet them in a shuffle.

Defined cases: null texts are empty; texts under ``length`` bytes keep all; rows
repeated in the input are occurrences of their own, so all of a long text is
removed from each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, short_batches
from .contamination import KEY, keyed, small
from .suffixes import deep_shallow
from .text import BYTE_VALUES, STEP, STEP_BACK, handing_back, in_bytes, joined, mixed, powers

LENGTH = 400
#: Bytes sorted by multikey quicksort behind the core and before it; longer common parts are left to blind tries.
SHALLOW = 64
SHARES, LEAST_HOT = 500_000, 5_000
SEGMENT = 1 << 19
MOST = 20_000
RUN = 8_192
FORTH, BACK = None, None


def running_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that give the hash of any stretch, and the factors that shift it to its start."""
    global FORTH, BACK
    if FORTH is None or len(FORTH) < len(data) + 1:
        FORTH, BACK = powers(STEP, len(data) + 1), powers(STEP_BACK, len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * FORTH[:len(data)], out=run[1:])
    return run, BACK


def sliding_first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, by minima of blocks from both sides."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:len(values)] = values
    table = full.reshape(-1, width)
    right = np.minimum.accumulate(table, axis=1).ravel()
    left = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1:width - 1 + n])


def core_of(length: int) -> int:
    return length // 4


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, anchor, nearest and farthest distance, core and context of all anchors of the strings within texts."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    run, back = running_hash(data)
    wide = core_of(length)
    places = len(data) - wide + 1
    core = mixed((run[wide:] - run[:places]) * back[:places])
    low = np.uint64((1 << 22) - 1)
    best = sliding_first_minimum((core & ~low) | np.arange(places, dtype=np.uint64), length - wide + 1)
    anchor = (best & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:len(anchor)]
    p = np.flatnonzero(np.arange(len(anchor)) + length <= starts[text + 1])
    if not len(p):
        return none
    a, t = anchor[p], text[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    last = np.append(first[1:], len(p)) - 1
    a, t = a[first], t[first]
    far, near = a - p[first], a - p[last]
    s, e = a - far, a + length - near
    context = mixed((run[e] - run[s]) * back[s] + (far * 1024 + near).astype(np.uint64))
    return t, a - starts[t], near, far, core[a], context


def segments(flat: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Texts in runs of about SEGMENT bytes; a longer text is cut so that every string lies in one part.

    First text, bytes, starts within them, and where in its text the part begins.
    """
    low, n = 0, len(starts) - 1
    while low < n:
        if starts[low + 1] - starts[low] > SEGMENT:
            for begin in range(0, int(starts[low + 1] - starts[low]) - length + 1, SEGMENT):
                part = flat[starts[low] + begin:min(starts[low] + begin + SEGMENT + length - 1, starts[low + 1])]
                yield low, part, np.array([0, len(part)]), begin
            low += 1
            continue
        high = low + 1
        while high < n and starts[high + 1] - starts[low] <= SEGMENT:
            high += 1
        yield low, flat[starts[low]:starts[high]], starts[low:high + 1] - starts[low], 0
        low = high


def list_anchors(texts: DataFrame, length: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = joined(batch.column("text"))
            ids = [batch.column(c) for c in KEY]
            for first, data, cuts, begin in segments(flat, starts, length):
                text, a, near, far, core, context = anchors_of(data, cuts, length)
                row = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(row) for c in ids), pa.array(a + begin), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)),
                     pa.array(core.view(np.int64)), pa.array(context.view(np.int64))], [*KEY, "a", "near", "far", "core", "context"])

    return texts.mapInArrow(handing_back(listed), "id_hash long, text_hash long, a long, near int, far int, core long, context long")


def with_contexts(texts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """core, context, near, far, and the bytes before and from the anchor, of classes that name one occurrence."""
    keys = small(materialize(classes.select(KEY).distinct(), "keys"))
    wanted = classes.groupBy(KEY).agg(F.collect_list(F.struct("core", "context", "a", "near", "far")).alias("wanted"))
    rows = texts.join(keys, KEY, "left_semi").dropDuplicates(KEY).join(wanted, KEY).select("text", F.explode("wanted").alias("w"))
    data = F.col("text").cast("binary")
    cut = lambda s, e: F.substring(data, s + 1, e - s)
    a, near, far = F.col("w.a").cast("int"), F.col("w.near"), F.col("w.far")
    return rows.select("w.core", "w.context", "w.near", "w.far", cut(a - far, a).alias("before"), cut(a, a + length - near).alias("behind"))


def repeated_ranges(core: np.ndarray, near: np.ndarray, far: np.ndarray, before: list[bytes], behind: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each context the distances whose strings occur in another context of the core, as from, to, from, to."""
    n = len(core)
    _, group = np.unique(core, return_inverse=True)
    wide = core_of(length)
    right, right_shared = deep_shallow(group, behind, length, wide + SHALLOW)
    left, left_shared = deep_shallow(group, [b[::-1] for b in before], length - wide, SHALLOW)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[right], rank_l[left] = np.arange(n), np.arange(n)
    hit = np.zeros((n, length - wide + 3), bool)
    for d in range(int(near.min()), int(far.max()) + 1):
        on = np.flatnonzero((near <= d) & (d <= far))
        same_r = np.cumsum(right_shared < length - d)[rank_r[on]]
        same_l = np.cumsum(left_shared < d)[rank_l[on]]
        _, at, count = np.unique(same_r * (n + 1) + same_l, return_inverse=True, return_counts=True)
        hit[on, d + 1] = count[at] > 1
    edges = np.diff(hit.astype(np.int8), axis=1)
    return [np.stack([np.flatnonzero(e == 1), np.flatnonzero(e == -1) - 1], axis=1).ravel().tolist() for e in edges]


def sorted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """core, context and ranges, from all contexts of a core; some thousand contexts at a time."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            cols = {c: table.column(c).to_numpy() for c in ("core", "context", "near", "far")}
            found = repeated_ranges(cols["core"], cols["near"], cols["far"], table.column("before").to_pylist(), table.column("behind").to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(cols["core"]), pa.array(cols["context"]), pa.array(found, pa.list_(pa.int32()))],
                                              ["core", "context", "ranges"])

        held = None
        for batch in batches:
            for low in range(0, batch.num_rows, RUN):
                some = pa.Table.from_batches([batch.slice(low, RUN)])
                held = some if held is None else pa.concat_tables([held, some])
                core = held.column("core").to_numpy()
                last = int(np.searchsorted(core, core[-1]))  # the last core may go on
                if last >= RUN // 2:
                    yield solve(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield solve(held)

    rows = contexts.repartition("core").sortWithinPartitions("core", "context")
    return rows.mapInArrow(ranges, "core long, context long, ranges array<int>")


def counted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """As ``sorted_ranges``, by counting the strings of frequent cores."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["before"] + row["behind"], np.uint8)
                run, back = running_hash(data)
                d = np.arange(row["near"], row["far"] + 1)
                s = row["far"] - d
                value = mixed((run[s + length] - run[s]) * back[s] + d.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), row["core"])), pa.array(np.full(len(d), row["context"])),
                                                  pa.array(d.astype(np.int32)), pa.array(value.view(np.int64))], ["core", "context", "d", "string"])

    each = materialize(contexts.mapInArrow(strings, "core long, context long, d int, string long"), "strings")
    twice = each.groupBy("string").count().filter("count > 1").select("string")
    hits = each.join(twice, "string").groupBy("core", "context").agg(F.sort_array(F.collect_list("d")).alias("ds"))
    pair = F.flatten(F.transform("ds", lambda d: F.array(d, d)))
    return hits.select("core", "context", pair.alias("ranges"))


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows joined to facts (keys, n: how many rows have them, ...): frequent keys by broadcast, the others by a shuffle.

    A key of more than ``total / SHARES`` rows is one of fewer than ``SHARES``.
    """
    most = max(LEAST_HOT, total // SHARES)
    hot = F.broadcast(materialize(facts.filter(F.col("n") > most), "frequent"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(facts.filter(F.col("n") <= most), keys))


def joined_up(spans: DataFrame) -> DataFrame:
    """Key and spans (ascending, apart) from spans (key, start, end) that may overlap or touch."""
    in_order = Window.partitionBy(*KEY).orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("opens", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    runs = runs.withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Key and spans (start, end in bytes, ascending, apart) of all texts with repeated passages."""
    with short_batches(texts.sparkSession):
        anchors = materialize(list_anchors(texts, length), "anchors")
    total = anchors.count()
    cores = anchors.groupBy("core").agg(F.count("*").alias("n"), F.min("context").alias("one"), F.max("context").alias("other"))
    cores = materialize(cores.filter("n > 1").select("core", "n", (F.col("one") != F.col("other")).alias("open")), "cores")
    again = materialize(join_hot(anchors, cores, ["core"], total).drop("n"), "repeated")
    discard(anchors)
    classes = again.groupBy("core", "context").agg(
        F.count("*").alias("n"), F.min(F.struct(*KEY, "a")).alias("at"), F.first("near").alias("near"), F.first("far").alias("far"), F.first("open").alias("open"))
    classes = materialize(classes.select("core", "context", "n", "at.*", "near", "far", "open"), "classes")
    settled = classes.filter("n > 1").select("core", "context", "n", F.array("near", "far").alias("ranges"))
    contested = materialize(with_contexts(texts, classes.filter("open"), length), "contexts")
    sizes = contested.groupBy("core").count().filter(F.col("count") > MOST).select("core")
    large = small(materialize(sizes, "frequent"))
    ranges = sorted_ranges(contested.join(large, "core", "left_anti"), length).unionByName(counted_ranges(contested.join(large, "core"), length))
    singles = classes.filter("open AND n = 1").select("core", "context", "n").join(ranges.filter("size(ranges) > 0"), ["core", "context"])
    known = materialize(settled.unionByName(singles), "ranges")
    spans = join_hot(again.select("core", "context", *KEY, "a"), known, ["core", "context"], total)
    pairs = F.transform(F.sequence(F.lit(0), F.size("ranges") - 1, F.lit(2)), lambda i: F.struct(
        (F.col("a") - F.get("ranges", i + 1)).alias("start"), (F.col("a") - F.get("ranges", i) + length).alias("end")))
    found = materialize(joined_up(spans.select(*KEY, F.explode(pairs).alias("span")).select(*KEY, "span.*").distinct()), "spans")
    for table in (again, classes, contested, known):
        discard(table)
    return found


def cut_out(data: Column, edges: Column) -> Column:
    """What stands outside the spans (start, end, start, end, ...); null where there are none."""

    @F.pandas_udf("binary")
    def rest(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, cuts):
            if cut is None or text is None:
                out.append(None)
                continue
            places = [0, *(int(c) for c in cut), len(text)]
            out.append(b"".join([text[s:e] for s, e in zip(places[::2], places[1::2])]))
        return pd.Series(out, dtype=object)

    return rest(data, edges)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, send_bytes: int = 64 << 20) -> DataFrame:
    """All columns of docs, n_bytes, spans (null if none) and kept (bytes).

    Spans are sent to all tasks while they are of at most ``send_bytes``; else texts and spans shuffle.
    """
    if not 64 <= length <= 1_024:
        raise ValueError("length from 64 to 1024 bytes")
    texts = keyed(docs, key, text).filter(F.octet_length("text") >= length)
    spans = repeated_spans(texts, length)
    held = spans.agg(F.count("*").alias("texts"), F.sum(F.size("spans")).alias("spans")).first()
    spans = in_bytes(spans, 2 * held["texts"] + (held["spans"] or 0), 32, send_bytes)
    docs = docs.drop("n_bytes", "spans", "kept")  # columns of these names are replaced
    rows = docs.withColumns({"_id": F.xxhash64(F.lit(1), F.col(key).cast("string")), "_text": F.xxhash64(F.lit(2), text)})
    rows = rows.join(spans.withColumnsRenamed({"id_hash": "_id", "text_hash": "_text"}), ["_id", "_text"], "left").drop("_id", "_text")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    edges = F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"])))
    # only texts with spans go to Python
    kept = cut_out(F.when(F.col("spans").isNotNull(), data), edges)
    return rows.withColumns({"n_bytes": F.octet_length(data).cast("long"), "kept": F.coalesce(kept, data)})
