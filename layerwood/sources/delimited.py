"""Delimited text to (instance, label, features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .specs import DatasetSpec, FeatureSpec, dataset_spec, encoded_width, read_feature_specs


def keep_data_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Drop empty, one-character and '|' comment lines."""
    return lines.filter((F.length(column) > 1) & ~F.startswith(F.col(column), F.lit("|")))


def checked(value: Column, ok: Column, message: Column) -> Column:
    """The value, or a failed query where the condition does not hold."""
    return F.when(ok, value).otherwise(F.raise_error(message))


def has_right_fields(parts: Column, spec: DatasetSpec) -> Column:
    """Whether a split line has as many fields as a raw or a layer line of the dataset."""
    return F.size(parts).isin(spec.fields, spec.layer_fields)


def parse_delimited(lines: DataFrame, spec: DatasetSpec, features: list[FeatureSpec],
                    column: str = "value") -> DataFrame:
    """Parse raw or layer lines of a dataset; other columns are kept.

    A line with the wrong number of fields, or whose encoded width differs from
    that of the spec, fails the query.
    """
    parts = F.split(F.col(column), ",", -1)
    keep = [c for c in lines.columns if c != column]
    split = keep_data_lines(lines, column).select(*keep, parts.alias("_parts"))
    split = split.select(*keep, checked(
        F.col("_parts"), has_right_fields(F.col("_parts"), spec),
        F.format_string(f"{spec.name}: %d fields, expected {spec.fields} or {spec.layer_fields}",
                        F.size("_parts"))).alias("_parts"))
    p = F.col("_parts")
    is_raw = F.size(p) == spec.fields

    def assembled(positions: list[int]) -> Column:
        return F.concat(*[f.encode(F.get(p, F.lit(i))) for f, i in zip(features, positions)])

    raw_positions = spec.feature_positions()
    layer_positions = list(range(spec.layer_fields - 1))
    raw = assembled(raw_positions) if len(features) >= len(raw_positions) else None
    layer = assembled(layer_positions) if len(features) >= len(layer_positions) else None
    if raw is None:
        raise ValueError(f"{spec.name}: {len(features)} feature specs for {len(raw_positions)} features")
    layer_label = F.trim(F.get(p, F.lit(spec.layer_fields - 1))).cast("double")
    if layer is None:
        vector, label = F.when(is_raw, raw), spec.label(p)
    else:
        vector = F.when(is_raw, raw).otherwise(layer)
        label = F.when(is_raw, spec.label(p)).otherwise(layer_label)
    width = encoded_width(features)
    out = split.select(*keep, label.alias("label"), vector.alias("features"))
    return out.select(*keep, "label", checked(
        F.col("features"), F.size("features") == width,
        F.format_string(f"{spec.name}: encoded width %d, expected {width}",
                        F.coalesce(F.size("features"), F.lit(-1)))).alias("features"))


def with_row_ids(df: DataFrame, column: str = "instance") -> DataFrame:
    """Contiguous ids in partition order: per-partition counts give the offsets.

    The rows are written once, so that both passes see the same partitions.
    """
    marked = materialize(df.withColumn("_m", F.monotonically_increasing_id()), "marked-rows")
    pid = F.shiftright("_m", 33)
    counts = marked.groupBy(pid.alias("_p")).count().collect()
    offset, offsets = 0, []
    for row in sorted(counts, key=lambda r: r["_p"]):
        offsets.append((int(row["_p"]), offset))
        offset += row["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _o long")
    in_partition = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return (marked.withColumn("_p", pid).join(F.broadcast(table), "_p")
            .withColumn(column, in_partition + F.col("_o")).drop("_m", "_p", "_o"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(instance, value): the data lines of all files, numbered from 0 in the order of file names and lines.

    The numbers do not depend on how files are split or packed into tasks: lines
    are counted by split, and splits are put in order, one row each.  The lines
    are written once, so that counting and numbering see the same splits.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_start"))
    lines = keep_data_lines(lines).withColumn("_m", F.monotonically_increasing_id())
    lines = materialize(lines, "lines")
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    order = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_offset"))
    # lines of a split stand in a row, but dropped ones are not numbered: marks are given after the filter
    return lines.join(splits, ["_file", "_start"]).select(
        (F.col("_m") - F.col("_first") + F.col("_offset")).alias("instance"), "value")


def load_delimited(spark: SparkSession, dataset: str, path: str, features_path: str,
                   partitions: int = 0, phases: dict[str, str] | None = None) -> DataFrame:
    """Read one of the registered datasets; ids count the data lines of all files.

    ``phases`` may give paths to the names "train" and "test"; any other
    ``path`` is read as it is.
    """
    lines = numbered_lines(spark, (phases or {}).get(path, path))
    if partitions > 0:
        lines = lines.repartition(partitions)
    return parse_delimited(lines, dataset_spec(dataset), read_feature_specs(spark, features_path))


def parse_layer_lines(lines: DataFrame, with_block: bool, column: str = "value") -> DataFrame:
    """Layer rows ``instance, f..., label[, block]`` as text."""
    kept = keep_data_lines(lines, column)
    p = F.split(F.col(column), ",", -1)
    tail = 2 if with_block else 1
    vector = F.transform(F.slice(p, F.lit(2), F.size(p) - tail - 1), lambda x: F.trim(x).cast("double"))
    label = F.trim(F.get(p, F.size(p) - tail)).cast("double")
    cols = [F.trim(F.get(p, F.lit(0))).cast("long").alias("instance"), label.alias("label"),
            vector.alias("features")]
    if with_block:
        cols.append(F.trim(F.get(p, F.size(p) - 1)).cast("long").alias("block"))
    return kept.select(*cols)
