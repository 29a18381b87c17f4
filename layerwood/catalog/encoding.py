"""Sources, loaders and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.sampling import assign_blocks, assignment_frame, choose_blocks, random_blocks
from ..session import new_path
from ..sources.delimited import has_right_fields, keep_data_lines, parse_delimited, parse_layer_lines, with_row_ids
from ..sources.specs import DATASETS, FeatureSpec, encoded_width, numbers, read_feature_specs
from ..sources import tables
from ..sources.tables import layer_lines, read_blocks, write_blocks, write_table
from .registry import LINE_KEYS, long_form, query, sql_hash, table

KEYS_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
# The categories of the order and line columns.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("scan_filter_lines", """
SELECT doc_id, cast(line_no AS INTEGER) AS line_no, md5(line) AS line_md5 FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
WHERE length(line) > 1 AND NOT starts_with(line, '|')""")
def scan_filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value"))
    return keep_data_lines(lines).select("doc_id", "line_no", F.md5("value").alias("line_md5"))


@query("load_binary_string_label", f"""
SELECT {KEYS_SQL}, CASE WHEN l_extendedprice > 50000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
  l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3,
  CASE WHEN l_returnflag IN ('A', 'R') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS flag_unknown,
  CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_a,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_r,
  CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS status_o, cast(18 AS INTEGER) AS width
FROM lineitem""")
def load_binary_string_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    numeric = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", *LINE_KEYS]
    extra = [F.year("l_shipdate"), F.month("l_shipdate"), F.dayofmonth("l_shipdate"), F.lit(1)]
    text = F.when(F.col("l_extendedprice") > 50000, " >50K").otherwise(" <=50K.")
    lines = li.select(*LINE_KEYS, F.concat_ws(
        ",", *[F.col(c) for c in numeric], F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" ")),
        "l_linestatus", *extra, text).alias("value"))
    specs = numbers(8) + [FeatureSpec.parse("A, R"), FeatureSpec.parse("F,O")] + numbers(4)
    out = parse_delimited(lines, DATASETS["uci_adult"], specs)
    return out.select(*LINE_KEYS, "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)],
                      F.get("features", F.lit(8)).alias("flag_unknown"), F.get("features", F.lit(9)).alias("flag_a"),
                      F.get("features", F.lit(10)).alias("flag_r"), F.get("features", F.lit(13)).alias("status_o"),
                      F.size("features").alias("width"))


def embedding_lines(spark: SparkSession, sf_dir: str, count: int, label, label_first: bool) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    numbers_ = F.array_join(F.transform(F.slice("embedding", 1, count),
                                        lambda x: x.cast("double").cast("string")), ",")
    parts = [label, numbers_] if label_first else [numbers_, label]
    return emb.select(F.col("vec_id").alias("instance"), F.concat_ws(",", *parts).alias("value"))


def embedding_sql(count: int, label: str) -> str:
    return f"""
SELECT vec_id AS instance, cast({label} AS DOUBLE) AS label, cast(p.pos AS INTEGER) AS pos,
       round(cast(embedding[p.pos + 1] AS DOUBLE), 9) AS value
FROM embeddings, (SELECT unnest(range({count})) AS pos) p"""


@query("load_shifted_label", embedding_sql(54, "label"))
def load_shifted_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = embedding_lines(spark, sf_dir, 54, F.col("label") + 1, False)
    return long_form(parse_delimited(lines, DATASETS["covertype"], numbers(54)), "instance", "label")


@query("load_label_first", embedding_sql(28, "CASE WHEN label >= 5 THEN 1 ELSE 0 END"))
def load_label_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = embedding_lines(spark, sf_dir, 28, (F.col("label") >= 5).cast("int"), True)
    return long_form(parse_delimited(lines, DATASETS["higgs"], numbers(28)), "instance", "label")


@query("load_label_first_narrow", embedding_sql(18, "CASE WHEN label >= 5 THEN 1 ELSE 0 END"))
def load_label_first_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = embedding_lines(spark, sf_dir, 18, (F.col("label") >= 5).cast("int"), True)
    return long_form(parse_delimited(lines, DATASETS["susy"], numbers(18)), "instance", "label")


@query("load_label_middle", f"""
SELECT {KEYS_SQL}, cast(l_linenumber - 1 AS DOUBLE) AS label, l_quantity AS f0, l_extendedprice AS f1,
       l_discount AS f2, l_tax AS f3, cast(l_suppkey AS DOUBLE) AS f4 FROM lineitem""")
def load_label_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, F.concat_ws(
        ",", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_suppkey").alias("value"))
    out = parse_delimited(lines, DATASETS["watch_acc"], numbers(5))
    return out.select(*LINE_KEYS, "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(5)])


@query("load_layer_layout", """
SELECT vec_id AS instance, cast(label % 2 AS DOUBLE) AS label, cast(p.pos AS INTEGER) AS pos,
       round(cast(embedding[p.pos + 1] AS DOUBLE), 9) AS value
FROM embeddings, (SELECT unnest(range(20)) AS pos) p""")
def load_layer_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later layer's file of the narrow dataset: 20 numbers and a plain label at the end."""
    lines = embedding_lines(spark, sf_dir, 20, (F.col("label") % 2).cast("string"), False)
    return long_form(parse_delimited(lines, DATASETS["susy"], numbers(20)), "instance", "label")


@query("arity_check", """
SELECT cast(CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 6 END AS INTEGER) AS n_fields, l_linenumber % 2 = 1 AS is_valid,
       count(*) AS n_lines FROM lineitem GROUP BY ALL""")
def arity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with all six fields, and lines that lack one."""
    five = F.concat_ws(",", "l_quantity", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    line = F.when(F.col("l_linenumber") % 2 == 0, five).otherwise(F.concat_ws(",", five, F.col("l_suppkey")))
    parts = F.split(line, ",", -1)
    return (table(spark, sf_dir, "lineitem")
            .select(F.size(parts).alias("n_fields"), has_right_fields(parts, DATASETS["watch_acc"]).alias("is_valid"))
            .groupBy("n_fields", "is_valid").agg(F.count(F.lit(1)).alias("n_lines")))


def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("instance"), F.array("value", F.col("user_id").cast("double")).alias("features"),
        (F.col("event_type") == "purchase").cast("double").alias("label"))
    return random_blocks(ev, 8, 11, "instance")


@query("layer_reload", f"""
SELECT event_id AS instance, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
       value AS f0, cast(user_id AS DOUBLE) AS f1, {sql_hash(11, 'event_id')} % 8 AS block FROM events""")
def layer_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_layer_lines(layer_lines(layer_rows(spark, sf_dir), True), True)
    return out.select("instance", "label", F.get("features", F.lit(0)).alias("f0"),
                      F.get("features", F.lit(1)).alias("f1"), "block")


@query("layer_reload_plain", """
SELECT event_id AS instance, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
       value AS f0, cast(user_id AS DOUBLE) AS f1 FROM events""")
def layer_reload_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_layer_lines(layer_lines(layer_rows(spark, sf_dir), False), False)
    return out.select("instance", "label", F.get("features", F.lit(0)).alias("f0"),
                      F.get("features", F.lit(1)).alias("f1"))


READ_SEED, READ_BLOCKS, READ_TAKE = 5, 20, 6
READ_CHOSEN = choose_blocks(READ_BLOCKS, READ_TAKE, READ_SEED)


@query("read_selected_blocks", f"""
SELECT o_orderkey AS instance, o_totalprice, {sql_hash(READ_SEED, 'o_orderkey')} % {READ_BLOCKS} AS block
FROM orders WHERE {sql_hash(READ_SEED, 'o_orderkey')} % {READ_BLOCKS} IN ({', '.join(map(str, READ_CHOSEN))})""")
def read_selected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all blocks, then open the chosen block folders only."""
    path = new_path(spark, "blocks")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), "o_totalprice")
    write_blocks(random_blocks(rows, READ_BLOCKS, READ_SEED, "instance"), path)
    return read_blocks(spark, path, READ_CHOSEN)


ASSIGNED = [(m, slot, b) for m, drawn in enumerate(assign_blocks(list(range(READ_BLOCKS)), 3, 2, 1, READ_SEED)) for slot, b in enumerate(drawn)]


@query("read_assigned_blocks", f"""
SELECT o_orderkey AS instance, o_totalprice, a.block::BIGINT AS block, cast(1 AS INTEGER) AS layer, a.model::INTEGER AS model, a.slot::INTEGER AS slot
FROM orders JOIN (VALUES {", ".join(map(str, ASSIGNED))}) a(model, slot, block) ON {sql_hash(READ_SEED, 'o_orderkey')} % {READ_BLOCKS} = a.block""")
def read_assigned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that three models draw in the first of two layers, by a join with the written draw."""
    path, draw = new_path(spark, "blocks"), new_path(spark, "draw")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), "o_totalprice")
    write_blocks(random_blocks(rows, READ_BLOCKS, READ_SEED, "instance"), path)
    blocks = spark.read.parquet(path).select(F.col("block").cast("long")).distinct()
    write_table(assignment_frame(blocks, 3, 2, 2, READ_SEED), draw)
    return tables.read_assigned_blocks(spark, path, spark.read.parquet(draw), 1)


@query("blocks_written_once", f"""
SELECT o_orderkey AS instance, o_totalprice, {sql_hash(READ_SEED, 'o_orderkey')} % 6 AS block FROM orders""")
def blocks_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write in mode ``ignore`` leaves blocks that are there as they are."""
    path = new_path(spark, "blocks")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"), "o_totalprice")
    write_blocks(random_blocks(rows, 6, READ_SEED, "instance"), path)
    write_blocks(random_blocks(rows.withColumn("o_totalprice", F.lit(0.0)), 6, READ_SEED, "instance"), path, mode="ignore")
    return read_blocks(spark, path, range(6))


@query("block_round_trip", f"""
SELECT {sql_hash(READ_SEED, 'event_id')} % 12 AS block, count(*) AS n_rows,
       cast(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1""")
def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "blocks")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("instance"), "value")
    write_blocks(random_blocks(rows, 12, READ_SEED, "instance"), path)
    return (read_blocks(spark, path, range(12)).groupBy("block")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("instance").alias("id_sum")))


@query("row_ids", "SELECT min(i) AS lowest, max(i) AS highest, count(DISTINCT i) AS n_ids, count(*) AS n_rows "
                  "FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous ids in file order; which row gets which id depends on the files."""
    rows = with_row_ids(table(spark, sf_dir, "events").select("event_id"))
    return rows.agg(F.min("instance").alias("lowest"), F.max("instance").alias("highest"),
                    F.count_distinct("instance").alias("n_ids"), F.count(F.lit(1)).alias("n_rows"))


@query("feature_dims", """
WITH dims AS (
  SELECT 'o_orderstatus' AS feature, count(DISTINCT trim(o_orderstatus)) + 1 AS width FROM orders
  UNION ALL SELECT 'o_orderpriority', count(DISTINCT trim(o_orderpriority)) + 1 FROM orders
  UNION ALL SELECT 'o_totalprice', cast(count(*) > 0 AS BIGINT) FROM orders)
SELECT feature, width, cast(sum(width) OVER () AS BIGINT) AS total_width FROM dims""")
def feature_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded width of each feature (names plus the unknown slot) and of the whole row."""
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderstatus", "o_orderpriority"]
    # a few names per column
    names = [[r[0] for r in orders.select(F.trim(c)).distinct().orderBy(F.trim(c)).collect()] for c in columns]
    path = new_path(spark, "specs")
    lines = [", ".join(n) for n in names] + ["C"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    specs = read_feature_specs(spark, path)
    return spark.createDataFrame([(c, s.width, encoded_width(specs)) for c, s in zip([*columns, "o_totalprice"], specs)],
                                 "feature string, width long, total_width long")


KNOWN = ["1-URGENT", "3-MEDIUM", "5-LOW"]


@query("one_hot", """
SELECT o_orderkey AS instance,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slot_0,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_1,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_2,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS slot_3 FROM orders""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.category_names(",".join(KNOWN))
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"),
                                                A.one_hot("o_orderpriority", names).alias("v"))
    return out.select("instance", *[F.get("v", F.lit(i)).alias(f"slot_{i}") for i in range(4)])


@query("ordinal_encode", """
SELECT o_orderkey AS instance, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '3-MEDIUM' THEN 2.0::DOUBLE
  WHEN '5-LOW' THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS code FROM orders""")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.category_names(",".join(KNOWN))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("instance"),
                                                 A.ordinal("o_orderpriority", names).alias("code"))


@query("assemble_features", """
SELECT o_orderkey AS instance, o_totalprice AS f0, cast(o_custkey AS DOUBLE) AS f1,
  CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f2,
  CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f3,
  CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f4,
  CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f5 FROM orders""")
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [FeatureSpec(), FeatureSpec(), FeatureSpec.parse("F, O, P")]
    inputs = [F.col(c).cast("string") for c in ("o_totalprice", "o_custkey", "o_orderstatus")]
    out = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("instance"), F.concat(*[s.encode(c) for s, c in zip(specs, inputs)]).alias("v"))
    return out.select("instance", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(6)])


@query("vector_text", """
SELECT event_id AS instance, value AS f0, cast(user_id AS DOUBLE) AS f1, cast(1 AS INTEGER) AS n_commas FROM events""")
def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector to comma text and back."""
    text = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("instance"),
        A.to_csv_text(F.array("value", F.col("user_id").cast("double"))).alias("text"))
    parts = F.split("text", ",")
    return text.select("instance", F.get(parts, F.lit(0)).cast("double").alias("f0"),
                       F.get(parts, F.lit(1)).cast("double").alias("f1"), (F.size(parts) - 1).alias("n_commas"))
