"""Small array helpers that run inside Spark tasks on Arrow batches.

Spark decides the partitions, merges the partial counts and picks the cuts;
these functions only walk the rows of one batch down the trees known so far.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from ..functions.hashing import MIX_RANGE, mix_array
from ..operators.splits import WORD

FLUSH_CODES = 4_000_000
#: Binned rows that a task holds to find equal ones among them.
GROUP_BYTES = 64 << 20
#: Rows of a group, and groups of a batch, at most: a batch stays small however often a row repeats.
GROUP_ROWS, GROUP_BATCH = 64, 10_000


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of equal lengths as a 2-d array; another length is an error."""
    if not len(column):
        return np.zeros((0, width or 1))
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = np.diff(np.asarray(column.offsets))
    width = int(sizes[0]) if width is None else width
    if (sizes != width).any():
        raise ValueError(f"vectors of {sizes.min()} to {sizes.max()} numbers where {width} are expected")
    return np.asarray(column.flatten()).reshape(len(column), width)


def bin_matrix(column: pa.Array, bin_type: str) -> np.ndarray:
    """A binary column of equal lengths as a 2-d array of bins."""
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[places[0]:places[-1]]
    return np.frombuffer(flat.tobytes() if bin_type != "u1" else flat, bin_type).reshape(len(column), -1)


def bin_rows(values: np.ndarray, edges: list, bin_type: str = "u1") -> np.ndarray:
    """Bin of each value: the number of edges below it; None keeps a category code."""
    out = np.empty(values.shape, bin_type)
    for f, edge in enumerate(edges):
        column = values[:, f]
        out[:, f] = column.astype(bin_type) if edge is None else np.searchsorted(edge, column, "left")
    return out


def by_block(blocks: np.ndarray):
    """(block, row positions) of a batch; batches mostly hold one block."""
    order = np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.diff(blocks[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(blocks[rows[0]]), rows


def tree_weights(row_hash: np.ndarray, tree: dict) -> np.ndarray:
    if not tree["bootstrap"] and tree["rate"] >= 1.0:
        return np.ones(len(row_hash), np.int64)
    draw = mix_array(row_hash, tree["tree_hash"])
    if tree["bootstrap"]:
        weight = np.zeros(len(draw), np.int64)
        for bound in tree["poisson"]:  # they rise, so behind one that no draw reaches there is none
            reached = draw >= bound
            if not reached.any():
                break
            weight += reached
        return weight
    return (draw < int(tree["rate"] * MIX_RANGE)).astype(np.int64)


def descend(values: np.ndarray, root: int, nodes: dict, limit: str) -> np.ndarray:
    """Last known node of every row; ``limit`` names the array compared with the value."""
    count, width = values.shape
    flat = values.ravel()
    at = np.empty(count, np.int64)
    rows, first = np.arange(count), np.arange(count) * width
    here = np.full(count, root, np.int64)
    child, feature, kind, mask = nodes["child"], nodes["feature"], nodes["kind"], nodes["mask"]
    bound = nodes[limit]
    has_categories = nodes["has_categories"]
    while len(rows):
        below = child.take(here)
        closed = below < 0
        if closed.any():
            at[rows[closed]] = here[closed]
            still = ~closed
            rows, first, here, below = rows[still], first[still], here[still], below[still]
        x = flat.take(first + feature.take(here))
        right = ~(x <= bound.take(here))  # a NaN goes right, as it does in the bins
        if has_categories:
            category = kind.take(here) != 0
            code = np.where(category, x, 0).astype(np.int64)
            inside = (mask[here, code // WORD] >> code % WORD) & 1
            right = np.where(category, inside == 0, right)
        here = below + right
    return at


def grouped_batches(batches):
    """Binned rows of equal block, fold, label and bins as one row with the hashes of all of them.

    Equal rows that were not held together stay different groups; sums over groups are the same.
    """
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= GROUP_BYTES:
            yield from groups_of(held)
            held, size = [], 0
    if held:
        yield from groups_of(held)


def groups_of(batches: list):
    """Groups of some binned rows, in the order of their blocks."""
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    block, fold, label = (np.asarray(rows.column(c)) for c in ("block", "fold", "label"))
    bins = bin_matrix(rows.column("bins"), "u1")
    padded = np.zeros((len(bins), -(-bins.shape[1] // 8) * 8), np.uint8)
    padded[:, :bins.shape[1]] = bins
    words = padded.view("<u8")
    mixed = np.zeros(len(bins), np.uint64)
    for part in (fold.astype(np.uint64), label.astype(np.uint64), *words.T):
        mixed = (mixed ^ part) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    # equal rows have one key and become neighbours; what is a group is decided by the rows themselves
    order = np.argsort(block.astype(np.int64) << 48 | (mixed >> np.uint64(16)).astype(np.int64))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(1)
    for column in (block, fold, label):
        column = column[order]
        new[1:] |= column[1:] != column[:-1]
    runs = np.flatnonzero(new)
    new |= (np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))) % GROUP_ROWS == 0
    starts = np.flatnonzero(new)
    # a tree's draw takes the hash by this modulus only
    hashes = (np.asarray(rows.column("row_hash"))[order] % MIX_RANGE).astype("<u4")
    places = np.append(starts, len(order)).astype(np.int32) * 4
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(hashes.tobytes())])
    first = pa.array(order[starts])
    out = pa.RecordBatch.from_arrays([*[rows.column(c).take(first) for c in ("block", "fold", "label", "bins")], packed],
                                     names=["block", "fold", "label", "bins", "hashes"])
    for at in range(0, out.num_rows, GROUP_BATCH):
        yield out.slice(at, GROUP_BATCH)


def group_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row hashes of all groups, one behind the other, and the number of rows of each group."""
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[places[0]:places[-1]]
    return np.frombuffer(flat.tobytes(), "<u4").astype(np.int64), np.diff(places).astype(np.int64) // 4


def group_weights(row_hash: np.ndarray, sizes: np.ndarray, tree: dict) -> np.ndarray:
    """How often the rows of each group count in a tree, all together."""
    if not tree["bootstrap"] and tree["rate"] >= 1.0:
        return sizes
    weight = tree_weights(row_hash, tree)
    return weight if len(weight) == len(sizes) else np.add.reduceat(weight, np.cumsum(sizes) - sizes)


def active_points(batch: pa.RecordBatch, state: dict):
    """Yield (tree, groups, slots, weights, labels, bins) of the groups of equal rows in open nodes."""
    blocks = np.asarray(batch.column("block"))
    fold = np.asarray(batch.column("fold"))
    labels = np.asarray(batch.column("label"))
    bins = bin_matrix(batch.column("bins"), state["bin_type"])
    hashes, sizes = group_hashes(batch.column("hashes"))
    nodes = state["nodes"]
    for block, groups in by_block(blocks):
        every = len(groups) == len(bins)
        block_bins = bins if every else bins[groups]
        block_sizes = sizes[groups]
        block_hashes = hashes if every else hashes[np.repeat(np.isin(np.arange(len(bins)), groups), sizes)]
        for tree in state["trees"].get(block, ()):
            used, part = groups, block_bins
            weight = group_weights(block_hashes, block_sizes, tree)
            keep = weight > 0
            if tree["fold_out"] >= 0:
                keep &= fold[used] != tree["fold_out"]
            if not keep.all():
                used, weight, part = used[keep], weight[keep], part[keep]
            slots = nodes["slot"].take(descend(part, tree["root"], nodes, "cut"))
            keep = slots >= 0
            if keep.all():
                yield tree, used, slots, weight, labels[used], part
            elif keep.any():
                used = used[keep]
                yield tree, used, slots[keep], weight[keep], labels[used], part[keep]


def distinct_sums(codes: np.ndarray, counts: np.ndarray):
    low = codes.min()
    if codes.max() - low < 4 * len(codes) + 1024:
        sums = np.bincount(codes - low, weights=counts)
        hit = np.flatnonzero(sums)
        return hit + low, sums[hit]
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[starts], np.add.reduceat(counts, starts)


def histogram_batches(batches, state: dict):
    """Partial histograms of one task, as rows of the histogram table."""
    classes, bins_, width = state["num_classes"], state["num_bins"], state["cand_feature"].shape[1]
    feature, kind, cut = state["cand_feature"], state["cand_kind"], state["cand_cut"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def emit():
        codes, counts = distinct_sums(np.concatenate([c for c, _ in held]),
                                      np.concatenate([n for _, n in held]))
        label, cell = codes % classes, codes // classes
        cells, at = np.unique(cell, return_inverse=True)
        table = np.zeros((len(cells), classes))
        table[at, label] = counts
        bin_, place = cells % bins_, cells // bins_
        slot, j = place // width, place % width
        arrays = [state["slot_tree"][slot], state["slot_node"][slot], feature[slot, j], kind[slot, j],
                  cut[slot, j], bin_.astype(np.int32), *[table[:, k] for k in range(classes)]]
        names = ["tree", "node", "feature", "kind", "cut", "bin", *[f"c{k}" for k in range(classes)]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    for batch in batches:
        for _, _, slots, weight, labels, bins in active_points(batch, state):
            at = np.arange(len(slots))
            for j in range(width):
                f, c = feature[slots, j], cut[slots, j]
                used = f > -2
                b = np.where(f >= 0, bins[at, np.maximum(f, 0)], 0).astype(np.int64)
                forced = (kind[slots, j] == 0) & (c >= 0)
                b = np.where(forced, b > c, b)
                code = ((slots.astype(np.int64) * width + j) * bins_ + b) * classes + labels
                codes, counts = distinct_sums(code[used], weight[used]) if used.any() else (code[:0], weight[:0])
                held.append((codes, counts))
                size += len(codes)
        if size > FLUSH_CODES:
            merged = distinct_sums(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            held, size = [merged], len(merged[0])
            if size > FLUSH_CODES // 2:
                yield emit()
                held, size = [], 0
    if size:
        yield emit()


def binned_batches(batches, edges: dict, bin_type: str = "u1"):
    """(block, fold, row_hash, label, bins) from (…, features) with per-block edges."""
    for batch in batches:
        values = matrix(batch.column("features"))
        blocks = np.asarray(batch.column("block"))
        out = np.zeros(values.shape, bin_type)
        for block, rows in by_block(blocks):
            if block in edges:
                out[rows] = bin_rows(values[rows], edges[block], bin_type)
        width = out.shape[1] * out.itemsize
        packed = pa.Array.from_buffers(pa.binary(width), len(out), [None, pa.py_buffer(out.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("block"), batch.column("fold"), batch.column("row_hash"),
             batch.column("label"), packed.cast(pa.binary())],
            names=["block", "fold", "row_hash", "label", "bins"])


def value_hashes(seed: int, block: int, feature: int, values: np.ndarray) -> np.ndarray:
    """First 32 bits of md5(seed:block:feature:value), the value in its shortest form."""
    head = f"{seed}:{block}:{feature}:"
    digests = b"".join([hashlib.md5((head + repr(value)).encode()).digest() for value in values.tolist()])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64)


def smallest_hashes(batches, keep: int, seed: int, skip=()):
    """Per block and feature the ``keep`` distinct values of smallest hash, and the largest value.

    The sketch of a task never holds more; sketches are merged by taking the
    smallest of their hashes again.  A NaN counts as the largest value.
    """
    sketches: dict[tuple[int, int], list] = {}
    for batch in batches:
        values = matrix(batch.column("features")) + 0.0  # one zero only
        for block, rows in by_block(np.asarray(batch.column("block"))):
            for f in range(values.shape[1]):
                if f in skip:
                    continue
                found = np.unique(values[rows, f])
                held = sketches.setdefault((block, f), [np.zeros(0, np.int64), np.zeros(0), -np.inf])
                held[2] = np.maximum(held[2], found[-1])  # NaN stays
                found = found[~np.isnan(found)]
                found = found[~np.isin(found, held[1])]
                hashes = np.concatenate([held[0], value_hashes(seed, block, f, found)])
                found = np.concatenate([held[1], found])
                best = np.lexsort((found, hashes))[:keep]
                held[0], held[1] = hashes[best], found[best]
    for (block, f), (hashes, found, top) in sketches.items():
        n = max(len(found), 1)  # a feature of NaNs only still has a row
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, f, np.int32)), pa.array(hashes) if len(found) else pa.nulls(1, pa.int64()),
             pa.array(found) if len(found) else pa.nulls(1, pa.float64()), pa.array(np.full(n, top))], names=["block", "feature", "hash", "value", "top"])


def lowest_above(batches, edges: dict):
    """Per block, feature and bin the smallest value this task has seen."""
    lows: dict[int, list] = {}
    for batch in batches:
        values = matrix(batch.column("features"))
        for block, rows in by_block(np.asarray(batch.column("block"))):
            if block not in edges:
                continue
            if block not in lows:
                lows[block] = [None if e is None else np.full(len(e) + 1, np.inf) for e in edges[block]]
            for f, low in enumerate(lows[block]):
                if low is not None:
                    column = values[rows, f]
                    np.minimum.at(low, np.searchsorted(edges[block][f], column, "left"), column)
    for block, features in lows.items():
        for f, low in enumerate(features):
            hit = np.flatnonzero(np.isfinite(low)) if low is not None else ()
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), block, np.int64)), pa.array(np.full(len(hit), f, np.int32)),
                     pa.array(hit.astype(np.int32)), pa.array(low[hit])],
                    names=["block", "feature", "bin", "low"])


def forest_votes(values: np.ndarray, folds: np.ndarray, state: dict) -> np.ndarray:
    """Summed leaf shares of the trees in the state, by the place of their forest."""
    classes, nodes, shares = state["num_classes"], state["nodes"], state["nodes"]["shares"]
    out = np.zeros((len(values), state["num_forests"], classes))
    for fold in np.unique(folds):
        rows = np.flatnonzero(folds == fold)
        part = values if len(rows) == len(values) else values[rows]
        sums: dict[int, np.ndarray] = {}
        for fold_out, place, root in state["roots"]:
            if fold_out == fold:
                share = shares.take(descend(part, root, nodes, "threshold"), axis=0)
                sums[place] = sums[place] + share if place in sums else share
        for place, votes in sums.items():
            out[rows, place] = votes
    return out.reshape(len(values), -1)


def class_vectors(votes: np.ndarray, folds: np.ndarray, members: dict, models: int, classes: int) -> np.ndarray:
    """Concatenated class vectors of all models from the votes of their forests."""
    votes = votes.reshape(len(votes), -1, classes)
    out = np.zeros((len(votes), models, classes))
    for fold in np.unique(folds):
        rows = np.flatnonzero(folds == fold)
        if len(rows) == len(votes):
            rows = slice(None)  # all rows, without a copy by positions
        for model, place in members.get(int(fold), ()):
            part = votes[rows, place]
            out[rows, model] += part / np.maximum(class_sum(part), 1e-300)
    out /= np.maximum(class_sum(out), 1e-300)
    return out.reshape(len(votes), models * classes)


def class_sum(votes: np.ndarray) -> np.ndarray:
    """Sum over the last axis, which stays; over few classes adding columns is faster, and the order is the same."""
    if votes.shape[-1] >= 8:
        return votes.sum(-1, keepdims=True)
    total = votes[..., :1].copy()
    for k in range(1, votes.shape[-1]):
        total += votes[..., k:k + 1]
    return total
