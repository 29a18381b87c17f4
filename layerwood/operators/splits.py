"""Split search as DataFrame operators: values, thresholds, histograms, cuts, routing.

Column conventions
  tree points  tree INT, node BIGINT, label INT, w, bins ARRAY<INT>
  histogram    tree, node, feature, kind, cut, bin, c0..c{K-1}
  frontier     tree, node, candidates ARRAY<STRUCT<feature, kind, cut>>
``cut`` is -1 when every cut is tried and the forced cut index otherwise.
Nodes are numbered like a heap: root 1, children 2n and 2n+1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import key_hash, mix
from ..functions.impurity import IMPURITY, INVALID_GAIN, LARGEST, split_gain, total
from ..session import materialize

CONTINUOUS, ORDERED, UNORDERED = 0, 1, 2
#: Categories in a word of a left side.
WORD = 62
CUT_SALT = 104729
ALL_CUTS = -1
TOTALS = -1
NODE = ["tree", "node"]
CELL = [*NODE, "feature", "kind", "cut"]
#: Nodes of at most so many bytes are sent to all tasks; the points of more are dealt by node and part.
SEND_BYTES = 32 << 20
NODE_PARTS = 32


def count_columns(num_classes: int) -> list[str]:
    return [f"c{k}" for k in range(num_classes)]


# ---------------------------------------------------------------- values and thresholds

def explode_features(df: DataFrame, *keep: str, vector: str = "features") -> DataFrame:
    return df.select(*keep, F.posexplode(vector).alias("feature", "value"))


def feature_value_counts(df: DataFrame, by=("block",)) -> DataFrame:
    return explode_features(df, *by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def value_ranges(values: DataFrame, by, ranges: int | None = None) -> DataFrame:
    """Distinct values in ranges of about equal row counts, in order within and across ranges.

    Spark cuts by samples of the rows themselves, so a group with many values has
    many ranges and small groups share one, whatever their distribution.
    """
    keys = [*by, "value"]
    ranged = values.repartitionByRange(ranges, *keys) if ranges else values.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _with_next(batches):
    """Next value of the same group within a range; its first row and the row without a known next are ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def emit(rows: pa.Table, closed: bool, first: bool):
        """All rows but the last if more follow."""
        n = rows.num_rows - (0 if closed else 1)
        here, below = rows.slice(0, rows.num_rows - 1), rows.slice(1)
        same = pa.array([True] * here.num_rows, pa.bool_())
        for name in rows.column_names[:-1]:
            same = pc.and_(same, pc.equal(here.column(name), below.column(name)).combine_chunks())
        following = pc.if_else(same, below.column("value").combine_chunks(), pa.scalar(None, below.schema.field("value").type))
        if closed:
            following = pa.concat_arrays([following, pa.nulls(1, following.type)])
        flags = [False] * n
        begins, ends = list(flags), list(flags)
        if first and n:
            begins[0] = True
        if closed:
            ends[-1] = True
        out = rows.slice(0, n).append_column("next_value", following).append_column("begins", pa.array(begins, pa.bool_())).append_column("ends", pa.array(ends, pa.bool_()))
        return out.combine_chunks().to_batches()

    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if rows.num_rows > 1:
            yield from emit(rows, False, first)
            first = False
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from emit(held, True, first)


def successors(values: DataFrame, by, buckets: int | None = None) -> DataFrame:
    """Next larger distinct value of the same group, without one task per group.

    ``values`` holds distinct values.  They are sorted in ranges of equal row
    counts; inside a range the next row is the successor, and a range's last row
    gets the first row of the range behind it.  Only two rows per range take part in
    that second step.
    """
    by = list(by)
    types = dict(values.dtypes)
    ordered = value_ranges(values.select(*by, "value"), by, buckets)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, "value"]) + f", next_value {types['value']}, begins boolean, ends boolean"
    found = materialize(ordered.mapInArrow(_with_next, schema), "successors")
    edges = found.filter("begins OR ends").withColumn("_next", F.lead("value").over(Window.partitionBy(*by).orderBy("value")))
    last = edges.filter("ends").select(*by, "value", F.col("_next").alias("next_value"))
    return found.filter("NOT ends").select(*by, "value", "next_value").unionByName(last)


def candidate_thresholds(values: DataFrame, by=("block", "feature")) -> DataFrame:
    """Midpoints of consecutive distinct values; a constant feature has none."""
    pairs = successors(values.select(*by, "value").distinct(), by)
    return (pairs.filter(F.col("next_value").isNotNull())
            .withColumn("threshold", (F.col("value") + F.col("next_value")) / F.lit(2.0)))


def sample_per_group(df: DataFrame, k: int, seed: int, by, *keys: str) -> DataFrame:
    """Uniform sample of at most k rows per group.

    The rank limit is applied before the shuffle as well, so a group sends at
    most k rows from each task however large it is.
    """
    order = Window.partitionBy(*by).orderBy(key_hash(seed, *keys), *keys)
    return df.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


# ---------------------------------------------------------------- frontier

def candidate_cuts(nodes: DataFrame) -> DataFrame:
    """Add the candidate features of each node and, for random trees, their cuts.

    ``nodes`` has tree, node, tree_hash, is_random, subset, num_splits
    ARRAY<INT> and kinds ARRAY<INT> (by feature).  Everything stays inside one row.
    """
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.size("num_splits") - 1),
        lambda f: F.struct(mix(F.col("_k"), f.cast("long")).alias("h"), f.alias("feature"))))

    def candidate(s: Column) -> Column:
        splits = F.get("num_splits", s["feature"]).cast("long")
        forced = (mix(s["h"], F.lit(CUT_SALT).cast("long")) % F.greatest(splits, F.lit(1).cast("long"))).cast("int")
        return F.struct(s["feature"].cast("int").alias("feature"),
                        F.get("kinds", s["feature"]).alias("kind"),
                        F.when(F.col("is_random"), forced).otherwise(F.lit(ALL_CUTS)).alias("cut"))

    picked = F.filter(F.slice(ranked, F.lit(1), F.col("subset")), lambda s: F.get("num_splits", s["feature"]) > 0)
    return (nodes.withColumn("_k", mix(F.col("tree_hash"), F.col("node")))
            .withColumn("_ranked", picked)
            .withColumn("candidates", F.transform("_ranked", candidate)).drop("_k", "_ranked"))


# ---------------------------------------------------------------- histograms

def bin_code(bin_: Column, kind: Column, cut: Column) -> Column:
    """Bins of a forced continuous cut shrink to the two sides."""
    side = (bin_ > cut).cast("int")
    return F.when((kind == CONTINUOUS) & (cut >= 0), side).otherwise(bin_).cast("int")


def meet_nodes(points: DataFrame, nodes: DataFrame, row_bytes: Column, name: str) -> DataFrame:
    """Points joined with their node's row, however few nodes hold them.

    A join by (tree, node) alone would put all points of a node into one task, and the
    sums behind it would stay there.  So the nodes are written and weighed: up to
    ``SEND_BYTES`` they go to all tasks and the points stay where they are; beyond it
    each node is dealt ``NODE_PARTS`` times, and points meet it by the partition they come from.
    """
    nodes = materialize(nodes, name)
    weight = nodes.agg(F.sum(row_bytes)).first()[0] or 0
    if weight <= SEND_BYTES:
        return points.join(F.broadcast(nodes), NODE)
    parts = nodes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(NODE_PARTS - 1))))
    return points.withColumn("_part", F.spark_partition_id() % NODE_PARTS).join(parts, [*NODE, "_part"]).drop("_part")


def node_histogram(points: DataFrame, frontier: DataFrame, num_classes: int, with_totals: bool) -> DataFrame:
    """Class counts per (tree, node, feature, bin), summed inside the tasks before the only shuffle of their cells."""
    candidates = F.col("candidates")
    if with_totals:
        candidates = F.concat(F.array(F.struct(
            F.lit(TOTALS).alias("feature"), F.lit(CONTINUOUS).alias("kind"),
            F.lit(ALL_CUTS).alias("cut"))), candidates)
    open_nodes = frontier.select(*NODE, candidates.alias("candidates"))
    cells = (meet_nodes(points, open_nodes, 64 + 40 * F.size("candidates"), "frontier")
             .select(*NODE, "label", "w", "bins", F.explode("candidates").alias("c"))
             .select(*NODE, "label", "w", F.col("c.feature").alias("feature"),
                     F.col("c.kind").alias("kind"), F.col("c.cut").alias("cut"),
                     F.coalesce(F.get("bins", F.col("c.feature")), F.lit(0)).alias("bin")))
    cells = cells.withColumn("bin", bin_code(F.col("bin"), F.col("kind"), F.col("cut")))
    return merge_histogram(cells.select(*CELL, "bin", *[
        F.expr(f"if(label = {k}, cast(w AS double), 0D) AS c{k}") for k in range(num_classes)]), num_classes)


def merge_histogram(partial: DataFrame, num_classes: int) -> DataFrame:
    return partial.groupBy(*CELL, "bin").agg({c: "sum" for c in count_columns(num_classes)}).selectExpr(
        *CELL, "bin", *[f"`sum({c})` AS {c}" for c in count_columns(num_classes)])


def _over(order: str = "") -> str:
    cells = "PARTITION BY " + ", ".join(CELL)
    frame = f" ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if order else ""
    return f"OVER ({cells}{frame})"


def prefix_sums(histogram: DataFrame, num_classes: int, order: str = "bin") -> DataFrame:
    """Left counts l_k and totals t_k of every cut 'value bin <= this bin'.

    A window holds the bins of one (tree, node, feature): at most max_bins rows.
    """
    return histogram.selectExpr(
        "*", *[f"sum(c{k}) {_over(order)} AS l{k}" for k in range(num_classes)],
        *[f"sum(c{k}) {_over()} AS t{k}" for k in range(num_classes)])


def centroid_order(histogram: DataFrame, num_classes: int, impurity: str = "gini") -> DataFrame:
    """Rank the categories of each cell (0-based): by impurity for several
    classes, by the count of class 1 for two; equal centroids by category."""
    counts = count_columns(num_classes)
    centroid = IMPURITY[impurity](counts) if num_classes > 2 else counts[1]
    ranked = histogram.selectExpr("*", f"CASE WHEN {total(counts)} = 0 THEN {LARGEST} ELSE {centroid} END AS centroid")
    return ranked.selectExpr("*", "cast(row_number() OVER (PARTITION BY " + ", ".join(CELL)
                             + " ORDER BY centroid, bin) - 1 AS int) AS rank")


def words_for(categories: int) -> int:
    """Words that a left side of so many categories takes; one where there are none."""
    return max(1, -(-categories // WORD))


def candidate_splits(histogram: DataFrame, num_classes: int, kinds=(CONTINUOUS,),
                     impurity: str = "gini", words: int = 1) -> DataFrame:
    """(tree, node, feature, kind, cut, mask, l*, t*): every cut that may be taken.

    ``mask`` has the left categories as bits of ``words`` words, ``WORD`` in each; it
    is 0 for continuous features.
    """
    more = "0L, " * (words - 1)
    nothing = f"array({more}0L) AS mask"
    sides = [c for k in range(num_classes) for c in (f"l{k}", f"t{k}")]
    head = [*NODE, "feature", "kind"]
    out = []
    if CONTINUOUS in kinds:
        part = prefix_sums(histogram.where(f"kind = {CONTINUOUS}"), num_classes)
        out.append(part.where("cut < 0 OR bin = 0").selectExpr(
            *head, "if(cut >= 0, cut, bin) AS cut", nothing, *sides))
    if ORDERED in kinds:
        ranked = centroid_order(histogram.where(f"kind = {ORDERED}"), num_classes, impurity)
        part = prefix_sums(ranked, num_classes, "rank").selectExpr(
            "*", "array(" + ", ".join(f"sum(if(bin div {WORD} = {w}, shiftleft(1L, bin % {WORD}), 0L)) {_over('rank')}" for w in range(words)) + ") AS mask")
        out.append(part.where("cut < 0 OR rank = cut").selectExpr(*head, "rank AS cut", "mask", *sides))
    if UNORDERED in kinds:
        cells = histogram.where(f"kind = {UNORDERED}").selectExpr("*", f"max(bin) {_over()} AS _top")
        cells = cells.selectExpr("*", "explode(if(cut >= 0, array(cut + 1L), "
                                      "sequence(1L, greatest(shiftleft(1L, _top) - 1L, 1L)))) AS number")
        inside = "(shiftright(number, bin) & 1L) = 1"
        part = cells.groupBy(*head, "number").agg(
            *[F.expr(f"sum(if({inside}, c{k}, 0D)) AS l{k}") for k in range(num_classes)],
            *[F.expr(f"sum(c{k}) AS t{k}") for k in range(num_classes)])
        out.append(part.selectExpr(*head, "cast(number - 1 AS int) AS cut", f"array(number{', 0L' * (words - 1)}) AS mask", *sides))
    return reduce(lambda a, b: a.unionByName(b), out)


def best_split(candidates: DataFrame, num_classes: int, impurity: str = "gini",
               min_instances: int = 1, min_info_gain: float = 1e-6) -> DataFrame:
    """Per node the cut of largest gain; ties go to the first feature, then the first cut.

    In two steps: the best cut of each feature where its histogram lies, then the
    best of a node over one row per feature.
    """
    left, whole = [f"l{k}" for k in range(num_classes)], [f"t{k}" for k in range(num_classes)]
    gain = split_gain(whole, left, impurity, min_instances, min_info_gain)
    scored = candidates.selectExpr("*", f"if(feature = {TOTALS}, {INVALID_GAIN}, {gain}) AS gain")
    payload = (f"struct(feature, kind, cut, mask, gain, array({', '.join(left)}) AS left, "
               f"array({', '.join(whole)}) AS counts)")
    best = "max_by({0}, struct({1}gain, -{1}feature, -{1}cut)) AS s"
    of_features = scored.groupBy(*NODE, "feature").agg(F.expr(best.format(payload, ""))).drop("feature")
    return of_features.groupBy(*NODE).agg(F.expr(best.format("s", "s."))).select(*NODE, "s.*")


# ---------------------------------------------------------------- growing and routing

def expand_nodes(splits: DataFrame, level: int, max_depth: int, num_classes: int,
                 impurity: str = "gini", min_info_gain: float = 1e-6) -> DataFrame:
    """Decide leaf or split per node and which children are leaves at once."""
    def pure(side: str) -> str:
        return IMPURITY[impurity]([f"get({side}, {k})" for k in range(num_classes)]) + " = 0"

    last = str(level + 1 == max_depth)
    return (splits.selectExpr("*", f"gain < {min_info_gain!r}D OR {level == max_depth} AS is_leaf",
                              "zip_with(counts, left, (t, l) -> t - l) AS right")
            .selectExpr("*", f"{last} OR {pure('left')} AS left_leaf", f"{last} OR {pure('right')} AS right_leaf"))


def children(expanded: DataFrame) -> DataFrame:
    """(tree, node, counts, is_leaf) of both children of every split node."""
    pair = ("array(struct(node * 2 AS node, left AS counts, left_leaf AS is_leaf), "
            "struct(node * 2 + 1 AS node, right AS counts, right_leaf AS is_leaf))")
    return (expanded.where("NOT is_leaf").selectExpr("tree", f"explode({pair}) AS c")
            .select("tree", "c.node", "c.counts", "c.is_leaf"))


def goes_left(bin_: Column, kind: Column, cut: Column, mask: Column) -> Column:
    word = F.get(mask, F.floor(bin_ / WORD).cast("int"))
    in_mask = F.call_function("shiftright", word, bin_ % WORD).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(kind == CONTINUOUS, bin_ <= cut).otherwise(in_mask)


def route_points(points: DataFrame, expanded: DataFrame) -> DataFrame:
    """Move rows to the children of their split node; rows that reach a leaf drop out."""
    splits = expanded.filter(~F.col("is_leaf")).select(
        *NODE, "feature", "kind", "cut", "mask", "left_leaf", "right_leaf")
    left = goes_left(F.get("bins", F.col("feature")), F.col("kind"), F.col("cut"), F.col("mask"))
    moved = meet_nodes(points, splits, 80 + 8 * F.size("mask"), "splits").withColumn("_left", left)
    done = F.when(F.col("_left"), F.col("left_leaf")).otherwise(F.col("right_leaf"))
    return (moved.filter(~done)
            .withColumn("node", F.col("node") * 2 + F.when(F.col("_left"), 0).otherwise(1))
            .select("tree", "node", "label", "w", "bins"))
