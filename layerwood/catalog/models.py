"""Forests and cascades on real tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ForestConfig
from ..operators import metrics as M
from ..operators import sampling as P
from ..plans.cascade import CascadeModel, fit_block_cascade, fit_cascade, out_of_fold_vectors
from ..plans.forest import fit_block_forest, fit_forest, library_forest_vectors
from ..plans.grower import Tree, plan_trees
from ..plans.job import prepare_blocks, run_job
from ..plans.persist import load_cascade, load_forest, save_cascade, save_forest
from ..session import new_path
from ..sources.delimited import load_delimited
from .cascade_sql import layers_sql, metrics_sql, probabilities
from .registry import query, sql_hash, table

SPLIT_SEED, BLOCK_SEED, BLOCKS, TAKEN = 7, 5, 12, 6
ROWS_SEED = 51


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six statistics of the whole text of every document; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.split(F.lower(text), r"\s+")
    n_words = F.size(words).cast("double")
    features = F.array(
        F.length(text).cast("double"), n_words, F.size(F.split(text, "\n")).cast("double"),
        F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n,
        F.size(F.array_distinct(words)) / n_words,
        F.length(F.regexp_replace(text, "[^0-9]", "")) / n)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("instance"), features.alias("features"))


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    # six numbers go into the join, not the text
    return document_features(spark, sf_dir).join(labels, F.col("instance") == F.col("doc_id")).select("instance", "label", "features")


DOCUMENTS_SQL = r"""
texts AS MATERIALIZED (SELECT doc_id AS inst, t, string_split_regex(lower(t), '\s+') AS words, greatest(length(t), 1) AS n
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
described AS MATERIALIZED (SELECT inst, [length(t)::DOUBLE, len(words)::DOUBLE, len(string_split(t, chr(10)))::DOUBLE,
  length(regexp_replace(t, '[^\p{L}]', '', 'g')) / n, len(list_distinct(words)) / len(words), length(regexp_replace(t, '[^0-9]', '', 'g')) / n] AS x FROM texts)
"""


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a derived label: is the discounted price above 40000?"""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("instance"),
        (price > 40000).cast("double").alias("label"),
        F.array("l_extendedprice", "l_discount", "l_tax", "l_quantity").alias("features"))


LINE_ID_SQL = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
SMALL = ForestConfig(rf_num=2, crf_num=2, sub_rf_num=2, trees=4, max_depth=5, max_layers=2, seed=ROWS_SEED)


def blocked_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows of the chosen blocks, and all held-out rows."""
    rows = P.train_test_split(line_rows(spark, sf_dir), 0.7, SPLIT_SEED, "instance")
    rows = P.random_blocks(rows, BLOCKS, BLOCK_SEED, "instance")
    chosen = P.choose_blocks(BLOCKS, TAKEN, BLOCK_SEED)
    return (rows.filter(F.col("is_train") & F.col("block").isin(chosen)).drop("is_train"),
            rows.filter(~F.col("is_train")).drop("is_train"))


def split_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All training rows, and all held-out rows."""
    rows = P.train_test_split(line_rows(spark, sf_dir), 0.7, SPLIT_SEED, "instance")
    return rows.filter("is_train").drop("is_train"), rows.filter("not is_train").drop("is_train")


def block_cascade_model(spark: SparkSession, sf_dir: str, config: ForestConfig = SMALL) -> CascadeModel:
    train, test = blocked_lines(spark, sf_dir)
    return fit_block_cascade(train, test, config)


CHOSEN = P.choose_blocks(BLOCKS, TAKEN, BLOCK_SEED)
IS_TRAIN_SQL = f"{sql_hash(SPLIT_SEED, LINE_ID_SQL)} < {int(0.7 * (1 << 32))}"
FEATURES_SQL = "[l_extendedprice, l_discount, l_tax, l_quantity]"
LABEL_SQL = "cast(l_extendedprice * (1 - l_discount) > 40000 AS INTEGER)"


def lines_sql(row_hash: str, fold: str = "-1", where: str = "true") -> str:
    """All rows, or those of ``split_lines``, as one block."""
    return f"""
SELECT row_number() OVER () AS rid, inst, {row_hash} AS row_hash, label, 0 AS block, {fold} AS fold, 'train' AS split, x
FROM (SELECT {LINE_ID_SQL} AS inst, {IS_TRAIN_SQL} AS is_train, {LABEL_SQL} AS label, {FEATURES_SQL} AS x FROM lineitem) WHERE {where}"""


def blocked_rows_sql(seed: int, cv: int = 0) -> str:
    """The rows of ``blocked_lines``, training and test."""
    fold = f"CASE WHEN is_train THEN {sql_hash(seed, 'inst')} % {cv} ELSE -1 END" if cv else "-1"
    return f"""
SELECT row_number() OVER () AS rid, inst, {sql_hash(seed, 'b', 'inst')} AS row_hash, label, b AS block, {fold} AS fold,
       CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, x
FROM (SELECT *, CASE WHEN is_train THEN {sql_hash(BLOCK_SEED, 'inst')} % {BLOCKS} ELSE 0 END AS b
      FROM (SELECT {LINE_ID_SQL} AS inst, {IS_TRAIN_SQL} AS is_train, {LABEL_SQL} AS label, {FEATURES_SQL} AS x FROM lineitem))
WHERE NOT is_train OR b IN ({", ".join(map(str, CHOSEN))})"""


def block_plan(config: ForestConfig, blocks: list[int] = CHOSEN, cv: int = 0):
    """Trees of a block cascade's layer: decided by seeds, not by rows."""
    def plan(layer: int, features: int) -> list[Tree]:
        assignment = P.assign_blocks(blocks, config.models_per_layer, config.sub_rf_num, layer, config.seed)
        return plan_trees(assignment, set(range(config.rf_num, config.models_per_layer)), features, config, layer, folds_out=(-1, *range(cv)))
    return plan


def fold_plan(config: ForestConfig):
    """Trees of a k-fold cascade's layer."""
    def plan(layer: int, features: int) -> list[Tree]:
        return plan_trees([[0]] * config.models_per_layer, set(range(config.rf_num, config.models_per_layer)), features, config, layer,
                          folds_out=(-1, *range(config.num_folds)))
    return plan


def forest_plan(config: ForestConfig, is_random: bool, blocks: list[int], folds_out=(-1,)):
    """Trees of one model with a forest per block."""
    return lambda layer, features: plan_trees([blocks], {0} if is_random else set(), features, config, layer, folds_out=folds_out)


IN_ONE_BLOCK = sql_hash(ROWS_SEED, "0", "inst")
INST_SQL, FOLD_SQL = sql_hash(ROWS_SEED, "inst"), f"{sql_hash(ROWS_SEED, 'inst')} % 3"
KEYS_SQL = "inst AS instance, label::DOUBLE AS label"
CASCADE_SQL = layers_sql(blocked_rows_sql(ROWS_SEED), 4, SMALL, block_plan(SMALL), 2)
FOREST_SQL = layers_sql(lines_sql(IN_ONE_BLOCK, where="is_train"), 4, SMALL, forest_plan(SMALL, False, [0]), 1)
PAIR = SMALL.replace(rf_num=1, crf_num=1)
TEN_CLASSES = SMALL.replace(num_classes=10, rf_num=1, crf_num=1, max_depth=3)


def _probabilities(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("probability").alias("class", "value")).withColumn(
        "value", F.round("value", 6))


@query("random_forest")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own forest on the labelled documents, scored on the held-out ones."""
    rows = P.train_test_split(document_rows(spark, sf_dir), 0.7, SPLIT_SEED, "instance")
    config = ForestConfig(trees=10, max_depth=6)
    out = library_forest_vectors(rows.filter("is_train"), rows.filter("not is_train"), config)
    return M.report(M.confusion(out, vector="probability"), 2)


@query("block_forest", f"""{layers_sql(blocked_rows_sql(ROWS_SEED), 4, SMALL, forest_plan(SMALL, True, CHOSEN), 1)}
{probabilities(SMALL, 'mean_1', KEYS_SQL, where="split = 'test'")}""")
def block_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One completely random model: the j-th forest grows on the j-th block."""
    train, test = blocked_lines(spark, sf_dir)
    model = fit_block_forest(train, SMALL, True, 4, CHOSEN)
    return _probabilities(model.transform(test.drop("block")), "instance", "label")


@query("feature_importance", f"""{FOREST_SQL},
per AS (SELECT tree, feature, sum(gain * (c0 + c1)) AS g FROM nodes_1 WHERE NOT is_leaf GROUP BY 1, 2),
scaled AS (SELECT feature, sum(g / t) AS s FROM (SELECT *, sum(g) OVER (PARTITION BY tree) AS t FROM per) GROUP BY 1)
SELECT cast(feature AS INTEGER) AS feature, round(s / sum(s) OVER (), 9) AS importance FROM scaled""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = split_lines(spark, sf_dir)
    return fit_forest(train, SMALL, False, 4).feature_importances().withColumn("importance", F.round("importance", 9))


@query("in_sample_class_vectors", f"{FOREST_SQL} {probabilities(SMALL, 'mean_1', KEYS_SQL)}")
def in_sample_class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest's vectors on its own training rows."""
    train, _ = split_lines(spark, sf_dir)
    model = fit_forest(train, SMALL, False, 4)
    return _probabilities(model.transform(train), "instance", "label")


@query("oof_class_vectors", f"""{layers_sql(lines_sql(INST_SQL, FOLD_SQL), 4, SMALL, forest_plan(SMALL, False, [0], (-1, 0, 1, 2)), 1)}
{probabilities(SMALL, 'mean_1', 'inst AS instance, cast(fold AS INTEGER) AS fold, label::DOUBLE AS label')}""")
def oof_class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = out_of_fold_vectors(line_rows(spark, sf_dir), SMALL, False)
    return _probabilities(vectors, "instance", "fold", "label")


@query("oof_coverage", f"""
SELECT cast({sql_hash(ROWS_SEED, LINE_ID_SQL)} % 3 AS INTEGER) AS fold, count(*) AS n_rows,
       count(DISTINCT {LINE_ID_SQL}) AS n_instances, count(*) AS n_proper FROM lineitem GROUP BY 1""")
def oof_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row gets exactly one out-of-fold vector, and each one sums to 1."""
    vectors, _ = out_of_fold_vectors(line_rows(spark, sf_dir), SMALL, True)
    proper = F.abs(F.get("probability", F.lit(0)) + F.get("probability", F.lit(1)) - 1) < 1e-9
    return vectors.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("instance").alias("n_instances"),
        F.count_if(proper).alias("n_proper"))


@query("cascade_concat", f"""{layers_sql(lines_sql(INST_SQL, FOLD_SQL), 4, PAIR, fold_plan(PAIR), 2, concat=True)}
{" UNION ALL ".join(f"""SELECT cast({i} AS INTEGER) AS layer, count(*) FILTER ((p1 > p0)::INT = label) AS n_right, count(*) AS n_total,
  count(*) FILTER ((p1 > p0)::INT = label) / count(*) AS accuracy FROM models_{i} JOIN rows1 USING (rid)""" for i in (1, 2))}""")
def cascade_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-fold cascade: accuracy of every layer."""
    model = fit_cascade(line_rows(spark, sf_dir), PAIR)
    return spark.createDataFrame([(h["layer"], h["n_right"], h["n_total"], h["accuracy"]) for h in model.history],
                                 "layer int, n_right long, n_total long, accuracy double")


@query("cascade_predict", f"""{layers_sql(f"""
SELECT row_number() OVER () AS rid, inst, {INST_SQL} AS row_hash, label, 0 AS block, fold, split, x FROM (
  SELECT inst, quality AS label, {FOLD_SQL} AS fold, 'train' AS split, x FROM described JOIN labels ON doc_id = inst
  WHERE {sql_hash(SPLIT_SEED, 'inst')} < {int(0.7 * (1 << 32))}
  UNION ALL SELECT inst, NULL, -1, 'test', x FROM described)""", 6, PAIR, fold_plan(PAIR), 2, concat=True, before=DOCUMENTS_SQL)}
{probabilities(PAIR, 'mean_2', 'inst AS instance', where="split = 'test'")}""")
def cascade_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-fold cascade on the labelled training documents, class probabilities of all documents."""
    rows = P.train_test_split(document_rows(spark, sf_dir), 0.7, SPLIT_SEED, "instance")
    model = fit_cascade(rows.filter("is_train").drop("is_train"), PAIR)
    return _probabilities(model.transform(document_features(spark, sf_dir)), "instance")


@query("block_cascade", f"""{CASCADE_SQL} {probabilities(SMALL, 'mean_2', KEYS_SQL, where="split = 'test'")}""")
def block_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: train on the chosen blocks, class probabilities of all held-out rows."""
    train, test = blocked_lines(spark, sf_dir)
    return _probabilities(fit_block_cascade(train, test, SMALL).transform(test), "instance", "label")


METRIC_SCHEMA = ("layer int, split string, n_right long, n_total long, accuracy double, precision double, "
                 "recall double, f1 double, kappa double")


@query("block_cascade_metrics", f"{CASCADE_SQL} {metrics_sql(SMALL, 2)}")
def block_cascade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f.strip().split(" ")[0] for f in METRIC_SCHEMA.split(",")]
    model = block_cascade_model(spark, sf_dir)
    return spark.createDataFrame([tuple(h[n] for n in names) for h in model.history], METRIC_SCHEMA)


CHOSEN_SQL = ", ".join(map(str, CHOSEN))


@query("block_cascade_coverage", f"""
WITH rows AS (
  SELECT {sql_hash(SPLIT_SEED, LINE_ID_SQL)} < {int(0.7 * (1 << 32))} AS is_train,
         {sql_hash(BLOCK_SEED, LINE_ID_SQL)} % {BLOCKS} AS block FROM lineitem),
used AS (SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split FROM rows
         WHERE NOT is_train OR block IN ({CHOSEN_SQL})),
sizes AS (SELECT split, count(*) AS n_total FROM used GROUP BY 1)
SELECT cast(layer AS INTEGER) AS layer, split, n_total, true AS learned
FROM sizes, (SELECT unnest(range(1, 3)) AS layer)""")
def block_cascade_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer scores every row of both splits, and learns a target that can be learned."""
    model = block_cascade_model(spark, sf_dir)
    return spark.createDataFrame(
        [(h["layer"], h["split"], h["n_total"], h["accuracy"] > 0.9) for h in model.history],
        "layer int, split string, n_total long, learned boolean")


@query("block_cascade_predict", f"""{layers_sql(f"""
SELECT row_number() OVER () AS rid, vec_id AS inst, {sql_hash(ROWS_SEED, 'b', 'vec_id')} AS row_hash, label, b AS block, -1 AS fold, 'train' AS split, x
FROM (SELECT *, {sql_hash(BLOCK_SEED, 'vec_id')} % 4 AS b, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)""",
    64, TEN_CLASSES, block_plan(TEN_CLASSES, [0, 1, 2, 3]), 2)} {probabilities(TEN_CLASSES, 'mean_2', KEYS_SQL)}""")
def block_cascade_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ten-class cascade on the embeddings: probabilities of every row (the labels are noise)."""
    rows = P.random_blocks(table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("instance"), F.col("label").cast("double").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features")), 4, BLOCK_SEED, "instance")
    model = fit_block_cascade(rows, None, TEN_CLASSES)
    return _probabilities(model.transform(rows), "instance", "label")


AGREE_SQL = f"""
SELECT count(*) AS n_rows, count(*) AS n_equal FROM lineitem
WHERE NOT {sql_hash(SPLIT_SEED, LINE_ID_SQL)} < {int(0.7 * (1 << 32))}"""


def _agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two scorings of the same table, and how many have the same probabilities."""
    both = first.select("instance", F.col("probability").alias("a"), F.lit(None).cast("array<double>").alias("b")).unionByName(
        second.select("instance", F.lit(None).cast("array<double>").alias("a"), F.col("probability").alias("b")))
    per = both.groupBy("instance").agg(F.count("a").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"))
    close = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y) < 1e-9), lambda ok: ok)
    return per.agg(F.sum("n").alias("n_rows"), F.sum(F.when(close, F.col("n")).otherwise(0)).alias("n_equal"))


@query("forest_save_load", AGREE_SQL)
def forest_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reloaded forest gives the same probabilities."""
    train, test = split_lines(spark, sf_dir)
    model, path = fit_forest(train, SMALL, True, 4), new_path(spark, "forest")
    save_forest(model, path)
    return _agreement(model.transform(test), load_forest(spark, path).transform(test))


@query("block_cascade_save_load", AGREE_SQL)
def block_cascade_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reloaded cascade gives the same probabilities."""
    train, test = blocked_lines(spark, sf_dir)
    model, path = fit_block_cascade(train, test, SMALL), new_path(spark, "cascade")
    save_cascade(model, path)
    return _agreement(model.transform(test), load_cascade(spark, path).transform(test))


@query("scoring_in_groups", AGREE_SQL)
def scoring_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring in groups of one tree agrees with scoring by all trees at once."""
    train, test = split_lines(spark, sf_dir)
    model = fit_forest(train, SMALL, False, 4)
    first = model.transform(test)
    model.state_bytes = 0
    return _agreement(first, model.transform(test))


def document_cascade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block cascade on the labelled documents: all metrics per layer and split."""
    rows = P.train_test_split(document_rows(spark, sf_dir), 0.7, SPLIT_SEED, "instance")
    train = P.random_blocks(rows.filter("is_train"), 4, BLOCK_SEED, "instance").drop("is_train")
    model = fit_block_cascade(train, rows.filter("not is_train").drop("is_train"), SMALL)
    names = [f.strip().split(" ")[0] for f in METRIC_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in model.history], METRIC_SCHEMA)


JOB_CONFIG = ForestConfig(num_classes=18, rf_num=1, crf_num=1, sub_rf_num=2, trees=2, max_depth=4, max_layers=2, seed=ROWS_SEED)
JOB_BLOCKS, JOB_TAKEN = 12, 6


def written_lines(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The order lines as a delimited file in the layout of watch_acc, and its feature spec."""
    data, spec = new_path(spark, "lines"), new_path(spark, "spec")
    line = F.concat_ws(",", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(data)
    spark.createDataFrame([("C",)] * 5, "value string").coalesce(1).write.text(spec)
    return data, spec


@query("delimited_job")
def delimited_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a delimited file over blocks on storage to the cascade's report."""
    data, spec = written_lines(spark, sf_dir)
    model = run_job(spark, "watch_acc", data, spec, JOB_CONFIG, JOB_BLOCKS, JOB_TAKEN)
    names = [f.strip().split(" ")[0] for f in METRIC_SCHEMA.split(",")]
    return spark.createDataFrame([tuple(h[n] for n in names) for h in model.history], METRIC_SCHEMA)


@query("delimited_load", """
SELECT cast(l_linenumber - 1 AS DOUBLE) AS label, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
       cast(l_suppkey AS DOUBLE) AS f4, true AS id_is_own FROM lineitem""")
def delimited_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file read back by the loader; ids run from 0 without gaps."""
    rows = load_delimited(spark, "watch_acc", *written_lines(spark, sf_dir))
    seen = rows.groupBy("instance").count().agg(F.count("*").alias("ids"), F.sum("count").alias("n"), F.max("instance").alias("top"))
    fine = seen.select(((F.col("ids") == F.col("n")) & (F.col("top") == F.col("n") - 1)).alias("ok")).first()["ok"]
    return rows.select("label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(5)], F.lit(fine).alias("id_is_own"))


@query("full_tables", """
SELECT cast(l_linenumber - 1 AS DOUBLE) AS label, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
       cast(l_suppkey AS DOUBLE) AS f4, 1::BIGINT AS n_sides FROM lineitem""")
def full_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full training and test tables as the job writes them, read back: every row is in one of them."""
    path = new_path(spark, "full")
    prepare_blocks(spark, "watch_acc", *written_lines(spark, sf_dir), JOB_BLOCKS, 0.7, 7, f"{path}/blocks", f"{path}/tables")
    both = None
    for side in ("train", "test"):
        rows = spark.read.parquet(f"{path}/tables/{side}")
        both = rows if both is None else both.unionByName(rows)
    sides = Window.partitionBy("instance")
    return both.select("label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(5)], F.count("*").over(sides).alias("n_sides"))


@query("document_cascade_metrics", f"""{layers_sql(f"""
SELECT row_number() OVER () AS rid, inst, {sql_hash(ROWS_SEED, 'b', 'inst')} AS row_hash, label, b AS block, -1 AS fold, split, x FROM (
  SELECT inst, quality AS label, CASE WHEN is_train THEN {sql_hash(BLOCK_SEED, 'inst')} % 4 ELSE 0 END AS b, CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, x
  FROM (SELECT *, {sql_hash(SPLIT_SEED, 'inst')} < {int(0.7 * (1 << 32))} AS is_train FROM described JOIN labels ON doc_id = inst))""",
    6, SMALL, block_plan(SMALL, [0, 1, 2, 3]), 2, before=DOCUMENTS_SQL)} {metrics_sql(SMALL, 2)}""")
def document_cascade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_cascade_report(spark, sf_dir)
