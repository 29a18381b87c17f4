"""Forests and cascades in plain SQL: the twins of fitted models.

``rows`` has rid, inst, row_hash, label, block, fold, split ('train' or 'test') and x,
the features as a list.  Each layer adds its expressions: thresholds of the training rows
by block, one chain of level tables for all its trees, the votes of all rows, and
the rows of the next layer.  What the driver decides without looking at rows
(which blocks a model draws, the hash of a tree) comes in as a list of trees.
"""

from __future__ import annotations

from collections.abc import Callable

from ..config import ForestConfig
from ..functions.hashing import MIX_RANGE
from ..operators import sampling as P
from ..operators import splits as S
from ..plans.grower import Tree, feature_kinds
from .registry import sql_hash, sql_mix

INVALID = "-1.7976931348623157e308::DOUBLE"


def added(values: str, order: str) -> str:
    """A sum of doubles in a fixed order, so that it rounds like the model's."""
    return f"list_reduce(list({values} ORDER BY {order}), lambda a, b: a + b)"


def total(values: list[str]) -> str:
    """Their sum in the order in which an array of them is added: eight lanes from eight numbers on."""
    if len(values) < 8:
        return f"({' + '.join(values)})"
    a = values[:8]
    lanes = f"((({a[0]} + {a[1]}) + ({a[2]} + {a[3]})) + (({a[4]} + {a[5]}) + ({a[6]} + {a[7]})))"
    return f"({' + '.join([lanes, *values[8:]])})"


def gini(counts: list[str]) -> str:
    n = f"({' + '.join(counts)})"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE 1 - ({' + '.join(f'{c} * {c}' for c in counts)}) / ({n} * {n}) END)"


def gain(config: ForestConfig) -> str:
    ks = range(config.num_classes)
    left, whole = [f"l{k}" for k in ks], [f"t{k}" for k in ks]
    right = [f"({t} - {l})" for t, l in zip(whole, left)]
    n_left, n_right, n = (f"({' + '.join(x)})" for x in (left, right, whole))
    value = f"({gini(whole)} - {n_left} / {n} * {gini(left)} - {n_right} / {n} * {gini(right)})"
    return (f"CASE WHEN feature >= 0 AND {n_left} >= {config.min_instances} AND {n_right} >= {config.min_instances} "
            f"AND {value} >= {config.min_info_gain!r} THEN {value} ELSE {INVALID} END")


def threshold_tables(tag: str, rows: str, width: int, raw: int, config: ForestConfig, used: list[int], kinds: list[int], arity: dict[int, int]) -> list[str]:
    """Edges, thresholds and bins of the training rows of the used blocks; features added to the ``raw`` ones are sampled on their own.

    Categories have no edges; their bin is their code, and the number of cuts follows from their arity.
    """
    cuts = [arity[f] - 1 if kinds[f] == S.ORDERED else (1 << (arity[f] - 1)) - 1 for f in sorted(arity)]
    is_category = f"feature IN ({', '.join(map(str, sorted(arity))) or '-1'})"
    known = "CASE feature " + " ".join(f"WHEN {f} THEN {n}" for f, n in zip(sorted(arity), cuts)) + " ELSE count(threshold) END" if arity else "count(threshold)"
    return [
        f"cells{tag} AS MATERIALIZED (SELECT rid, block, unnest(range({width})) AS feature, unnest(x) AS v FROM {rows} "
        f"WHERE split = 'train' AND block IN ({', '.join(map(str, used))}))",
        f"vals{tag} AS MATERIALIZED (SELECT block, feature, v, lead(v) OVER (PARTITION BY block, feature ORDER BY v) AS above, "
        f"{sql_hash(config.seed, 'block', f'CASE WHEN feature < {raw} THEN feature ELSE feature - {raw} END', 'v')} AS h FROM (SELECT DISTINCT block, feature, v FROM cells{tag}))",
        f"edges{tag} AS MATERIALIZED (SELECT block, feature, v, (v + above) / 2 AS threshold, "
        f"row_number() OVER (PARTITION BY block, feature ORDER BY v) - 1 AS i FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY block, feature ORDER BY h, v) AS r FROM vals{tag} WHERE above IS NOT NULL AND NOT {is_category}) WHERE r < {config.max_bins})",
        f"cuts{tag} AS MATERIALIZED (SELECT block, feature, {known} AS n FROM (SELECT DISTINCT block, feature FROM vals{tag}) "
        f"LEFT JOIN edges{tag} USING (block, feature) GROUP BY 1, 2)",
        f"codes{tag} AS MATERIALIZED (SELECT block, feature, v, CASE WHEN {is_category} THEN v::INT ELSE coalesce(sum((e.i IS NOT NULL)::INT) OVER "
        f"(PARTITION BY block, feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT END AS bin "
        f"FROM vals{tag} LEFT JOIN edges{tag} e USING (block, feature, v))",
        f"binned{tag} AS MATERIALIZED (SELECT rid, list(bin ORDER BY feature) AS b FROM cells{tag} JOIN codes{tag} USING (block, feature, v) GROUP BY rid)"]


def kind_is(kinds: list[int], kind: int) -> str:
    return f"feature IN ({', '.join(str(f) for f, k in enumerate(kinds) if k == kind) or '-2'})"


def candidate_tables(own: str, config: ForestConfig, kinds: list[int]) -> list[str]:
    """u{own}: every cut that may be taken, with its left and total counts and the categories that go left (null for numbers)."""
    ks = range(config.num_classes)
    over = "OVER (PARTITION BY tree, node, feature, cut"
    sides = ", ".join(f"sum(c{k}) {over} ORDER BY bin) AS l{k}, sum(c{k}) {over}) AS t{k}" for k in ks)
    columns = "tree, node, feature, cut, lefts, " + ", ".join(f"l{k}, t{k}" for k in ks)
    numbers = kind_is(kinds, S.CONTINUOUS)[:-1] + ", -1)"
    out, every = [], [f"SELECT {columns} FROM (SELECT tree, node, feature, CASE WHEN cut >= 0 THEN cut ELSE bin END AS cut, NULL::INT[] AS lefts, {sides}, "
                      f"cut < 0 OR bin = 0 AS real FROM x{own} WHERE {numbers}) WHERE real"]
    if S.ORDERED in kinds:
        centre = gini([f"c{k}" for k in ks]) if config.num_classes > 2 else "c1"
        ranked = ", ".join(f"sum(c{k}) {over} ORDER BY rank) AS l{k}, sum(c{k}) {over}) AS t{k}" for k in ks)
        out.append(f"r{own} AS MATERIALIZED (SELECT *, row_number() {over} ORDER BY {centre}, bin) - 1 AS rank FROM x{own} WHERE {kind_is(kinds, S.ORDERED)})")
        every.append(f"SELECT {columns} FROM (SELECT tree, node, feature, rank AS cut, list(bin) {over} ORDER BY rank) AS lefts, {ranked}, "
                     f"cut < 0 OR rank = cut AS real FROM (SELECT * REPLACE (cut::BIGINT AS cut) FROM r{own})) WHERE real")
    if S.UNORDERED in kinds:
        inside = "(number >> bin) & 1 = 1"
        counts = ", ".join(f"sum(CASE WHEN {inside} THEN c{k} ELSE 0 END)::DOUBLE AS l{k}, sum(c{k})::DOUBLE AS t{k}" for k in ks)
        out.append(f"y{own} AS MATERIALIZED (SELECT *, unnest(CASE WHEN cut >= 0 THEN [cut::BIGINT + 1] ELSE range(1, greatest((1 << top) - 1, 1)::BIGINT + 1) END) AS number "
                   f"FROM (SELECT *, max(bin) {over}) AS top FROM x{own} WHERE {kind_is(kinds, S.UNORDERED)}))")
        # a subset may hold categories that do not occur in the node
        lefts = "list_filter(range(62), lambda b: (number >> b) & 1 = 1)::INT[]"
        every.append(f"SELECT {columns} FROM (SELECT tree, node, feature, number - 1 AS cut, {lefts} AS lefts, {counts} FROM y{own} GROUP BY tree, node, feature, number)")
    return [*out, f"u{own} AS MATERIALIZED ({' UNION ALL '.join(every)})"]


def goes_left(value: str, split: str, bound: str) -> str:
    return f"(CASE WHEN {split}.lefts IS NULL THEN {value} <= {bound} ELSE list_contains({split}.lefts, {value}::INT) END)"


def tree_tables(tag: str, rows: str, config: ForestConfig, trees: list[Tree], kinds: list[int]) -> list[str]:
    """All nodes of the trees: nodes{tag} has tree, node, is_leaf, feature, threshold, lefts, gain, c0...."""
    ks = range(config.num_classes)
    listed = ", ".join(f"({t.tree}, {t.model}, {t.forest}, {t.block}, {t.fold_out}, {t.is_random}, {t.bootstrap}, {t.tree_hash}, {t.subset})" for t in trees)
    drawn = " + ".join(f"(m >= {int(b * MIX_RANGE)})::INT" for b in P.poisson_cdf(config.subsampling_rate))
    counts, sums = ", ".join(f"c{k}" for k in ks), ", ".join(f"sum(CASE WHEN label = {k} THEN w ELSE 0 END)::DOUBLE AS c{k}" for k in ks)
    out = [
        f"trees{tag}(tree, model, forest, block, fold_out, is_random, bootstrap, tree_hash, subset) AS (VALUES {listed})",
        f"p{tag}_0 AS MATERIALIZED (SELECT * FROM (SELECT rid, tree, 1::BIGINT AS node, label, b, CASE WHEN bootstrap THEN {drawn} ELSE 1 END AS w FROM "
        f"(SELECT r.rid, r.label, b.b, t.tree, t.bootstrap, {sql_mix('r.row_hash', 't.tree_hash')} AS m FROM {rows} r JOIN binned{tag} b USING (rid) "
        f"JOIN trees{tag} t ON t.block = r.block AND (t.fold_out < 0 OR t.fold_out <> r.fold))) WHERE w > 0)"]
    numbers = kind_is(kinds, S.CONTINUOUS).replace("feature", "c.feature")
    for d in range(config.max_depth):
        own, last = f"{tag}_{d}", d + 1 == config.max_depth
        open_ = f"SELECT tree, node FROM k{tag}_{d - 1} WHERE NOT closed" if d else f"SELECT DISTINCT tree, node FROM p{own}"
        totals = (f" UNION ALL SELECT tree, node, -1, -1, 0, {sums} FROM p{own} GROUP BY tree, node" if d == 0 else "")
        kids = ", ".join(f"CASE WHEN side = 0 THEN l{k} ELSE t{k} - l{k} END AS c{k}" for k in ks)
        pure = f"greatest({counts}) = {' + '.join(f'c{k}' for k in ks)}"
        out += [
            f"n{own} AS MATERIALIZED (SELECT tree, node, block, is_random, subset, {sql_mix('tree_hash', 'node')} AS k "
            f"FROM ({open_}) JOIN trees{tag} USING (tree))",
            f"h{own} AS MATERIALIZED (SELECT tree, node, feature, n, is_random, subset, {sql_mix('k', 'feature')} AS h FROM n{own} JOIN cuts{tag} USING (block))",
            f"c{own} AS MATERIALIZED (SELECT tree, node, feature, CASE WHEN is_random THEN {sql_mix('h', str(S.CUT_SALT))} % n ELSE -1 END AS cut "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY h, feature) AS r FROM h{own}) WHERE r <= subset AND n > 0)",
            f"x{own} AS MATERIALIZED (SELECT tree, node, feature, cut, bin, {sums} FROM (SELECT p.tree, p.node, c.feature, c.cut, p.label, p.w, "
            f"CASE WHEN c.cut >= 0 AND {numbers} THEN (p.b[c.feature + 1] > c.cut)::INT ELSE p.b[c.feature + 1] END AS bin "
            f"FROM p{own} p JOIN c{own} c ON p.tree = c.tree AND p.node = c.node) GROUP BY tree, node, feature, cut, bin{totals})",
            *candidate_tables(own, config, kinds),
            f"s{own} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, cut) AS r "
            f"FROM (SELECT *, {gain(config)} AS gain FROM u{own})) WHERE r = 1)",
            f"k{own} AS MATERIALIZED (SELECT *, {'true' if last else pure} AS closed FROM (SELECT tree, node * 2 + side AS node, {kids} "
            f"FROM s{own}, (SELECT unnest(range(2)) AS side) WHERE gain >= {config.min_info_gain!r}))"]
        if not last:
            out += [
                f"m{own} AS MATERIALIZED (SELECT p.rid, p.tree, p.node * 2 + (NOT {goes_left('p.b[s.feature + 1]', 's', 's.cut')})::INT AS node, p.label, p.b, p.w "
                f"FROM p{own} p JOIN s{own} s ON p.tree = s.tree AND p.node = s.node WHERE s.gain >= {config.min_info_gain!r})",
                f"p{tag}_{d + 1} AS MATERIALIZED (SELECT m.* FROM m{own} m JOIN k{own} k ON m.tree = k.tree AND m.node = k.node AND NOT k.closed)"]
    depths = range(config.max_depth)
    roots = f"SELECT tree, node, {', '.join(f't{k} AS c{k}' for k in ks)} FROM s{tag}_0"
    every = " UNION ALL ".join([roots, *(f"SELECT tree, node, {counts} FROM k{tag}_{d}" for d in depths)])
    cut = " UNION ALL ".join(f"SELECT tree, node, feature, cut, lefts, gain FROM s{tag}_{d} WHERE gain >= {config.min_info_gain!r}" for d in depths)
    out.append(
        f"nodes{tag} AS MATERIALIZED (SELECT a.tree, a.node, s.tree IS NULL AS is_leaf, coalesce(s.feature, 0) AS feature, "
        f"coalesce(e.threshold, 0) AS threshold, s.lefts, coalesce(s.gain, 0) AS gain, {', '.join(f'a.c{k}' for k in ks)} FROM ({every}) a "
        f"JOIN trees{tag} t ON t.tree = a.tree LEFT JOIN ({cut}) s ON s.tree = a.tree AND s.node = a.node "
        f"LEFT JOIN edges{tag} e ON e.block = t.block AND e.feature = s.feature AND e.i = s.cut)")
    return out


def vote_tables(tag: str, rows: str, config: ForestConfig, trees: list[Tree]) -> list[str]:
    """models{tag}: rid, model and its class vector p0....  A row asks the trees that left its fold out."""
    ks = range(config.num_classes)
    n = " + ".join(f"c{k}" for k in ks)
    out = [f"w{tag}_0 AS MATERIALIZED (SELECT r.rid, r.x, t.tree, 1::BIGINT AS node FROM {rows} r JOIN trees{tag} t ON t.fold_out = r.fold)"]
    for d in range(config.max_depth):
        out.append(f"w{tag}_{d + 1} AS MATERIALIZED (SELECT w.rid, w.x, w.tree, CASE WHEN n.is_leaf THEN w.node WHEN {goes_left('w.x[n.feature + 1]', 'n', 'n.threshold')} THEN 2 * w.node "
                   f"ELSE 2 * w.node + 1 END AS node FROM w{tag}_{d} w JOIN nodes{tag} n ON w.tree = n.tree AND w.node = n.node)")
    shares = ", ".join(f"{added(f'c{k} / ({n})', 'w.tree')} AS v{k}" for k in ks)
    votes, whole = total([f"v{k}" for k in ks]), total([f"q{k}" for k in ks])
    models = ", ".join(f"{added(f'v{k} / {votes}', 'forest')} AS q{k}" for k in ks)
    return [*out,
            f"forests{tag} AS MATERIALIZED (SELECT w.rid, t.model, t.forest, {shares} FROM w{tag}_{config.max_depth} w "
            f"JOIN nodes{tag} n ON w.tree = n.tree AND w.node = n.node JOIN trees{tag} t ON t.tree = w.tree GROUP BY 1, 2, 3)",
            f"models{tag} AS MATERIALIZED (SELECT rid, model, {', '.join(f'q{k} / {whole} AS p{k}' for k in ks)} "
            f"FROM (SELECT rid, model, {models} FROM forests{tag} GROUP BY 1, 2))"]


def mean_table(tag: str, config: ForestConfig, models: int) -> str:
    """mean{tag}: rid and the mean class vector p0...."""
    each = ", ".join(f"{added(f'p{k}', 'model')} / {models} AS p{k}" for k in range(config.num_classes))
    return f"mean{tag} AS MATERIALIZED (SELECT rid, {each} FROM models{tag} GROUP BY rid)"


def layers_sql(rows_sql: str, width: int, config: ForestConfig, plan: Callable[[int, int], list[Tree]], layers: int, concat: bool = False,
               arity: dict[int, int] | None = None, before: str = "") -> str:
    """WITH list of ``layers`` layers; ``plan(layer, features)`` gives a layer's trees, ``before`` what the rows are made from."""
    arity = arity or {}
    ks, parts, rows = range(config.num_classes), [*([before] if before else []), f"rows1 AS MATERIALIZED ({rows_sql})"], "rows1"
    for layer in range(1, layers + 1):
        tag, features = f"_{layer}", width
        if layer > 1:
            features += config.num_classes * (config.models_per_layer if concat else 1)
        trees = plan(layer, features)
        models = max(t.model for t in trees) + 1
        kinds = feature_kinds(features, arity, config)
        parts += threshold_tables(tag, rows, features, width, config, sorted({t.block for t in trees}), kinds, arity)
        parts += tree_tables(tag, rows, config, trees, kinds)
        parts += vote_tables(tag, rows, config, trees)
        parts.append(mean_table(tag, config, models))
        if layer < layers:
            vector = f"[{', '.join(f'p{k}' for k in ks)}]"
            passed = (f"(SELECT rid, flatten(list({vector} ORDER BY model)) AS more FROM models{tag} GROUP BY rid)" if concat
                      else f"(SELECT rid, {vector} AS more FROM mean{tag})")
            rows = f"rows{layer + 1}"
            parts.append(f"{rows} AS MATERIALIZED (SELECT r.* REPLACE (list_concat(r0.x, m.more) AS x) FROM rows{layer} r "
                         f"JOIN rows1 r0 USING (rid) JOIN {passed} m USING (rid))")
    return "WITH " + ", ".join(parts)


def probabilities(config: ForestConfig, table: str, keys: str, digits: int = 6, where: str = "true") -> str:
    """One row per class of a table of vectors."""
    return " UNION ALL ".join(
        f"SELECT {keys}, cast({k} AS INTEGER) AS class, round(p{k}, {digits}) AS value FROM {table} JOIN rows1 USING (rid) WHERE {where}"
        for k in range(config.num_classes))


def node_rows(config: ForestConfig, layers: int) -> str:
    counts = ", ".join(f"c{k}" for k in range(config.num_classes))
    return " UNION ALL ".join(
        f"SELECT cast({layer} AS INTEGER) AS layer, cast(tree AS INTEGER) AS tree, cast(node AS BIGINT) AS node, is_leaf, "
        f"cast(feature AS INTEGER) AS feature, round(threshold, 9) AS threshold, {counts} FROM nodes_{layer}" for layer in range(1, layers + 1))


def metrics_sql(config: ForestConfig, layers: int) -> str:
    """Report of each layer and split from the mean vectors; macro precision and recall over all classes."""
    ks, each = range(config.num_classes), []
    for layer in range(1, layers + 1):
        hits = ", ".join(f"count(*) FILTER (label = {k} AND guess = {k})::DOUBLE AS hit{k}, count(*) FILTER (guess = {k})::DOUBLE AS said{k}, "
                         f"count(*) FILTER (label = {k})::DOUBLE AS is{k}" for k in ks)
        guess = f"list_position([{', '.join(f'p{k}' for k in ks)}], greatest({', '.join(f'p{k}' for k in ks)})) - 1"
        each.append(f"SELECT {layer} AS layer, split, count(*) AS n_total, {hits} FROM (SELECT split, label, {guess} AS guess FROM mean_{layer} "
                    f"JOIN rows1 USING (rid)) GROUP BY split")
    right = " + ".join(f"hit{k}" for k in ks)
    chance = " + ".join(f"said{k} * is{k}" for k in ks)
    macro = lambda whole: f"({' + '.join(f'hit{k} / greatest({whole}{k}, 1)' for k in ks)}) / {config.num_classes}"
    return f"""
SELECT cast(layer AS INTEGER) AS layer, split, n_right::BIGINT AS n_right, n_total, accuracy, precision, recall,
       2 * precision * recall / (precision + recall) AS f1, (accuracy - by_chance) / (1 - by_chance) AS kappa
FROM (SELECT layer, split, n_total, {right} AS n_right, ({right}) / n_total AS accuracy, {macro('said')} AS precision, {macro('is')} AS recall,
             ({chance}) / (n_total::DOUBLE * n_total) AS by_chance FROM ({" UNION ALL ".join(each)}))"""
