import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from layerwood.catalog.registry import sql_hash, sql_mix
from layerwood.functions import arrays as A
from layerwood.functions import impurity as I
from layerwood.functions import sampling_rates as R
from layerwood.functions.hashing import MIX_RANGE, key_hash, key_hash_value, mix, mix_array
from layerwood.operators.sampling import poisson_cdf, tree_weight
from layerwood.plans.tasks import tree_weights
from layerwood.sources.specs import FeatureSpec, encoded_width


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hash_agrees_in_three_engines(spark):
    ids = np.arange(2000)
    df = spark.range(2000).select("id", key_hash(5, "id").alias("h"),
                                  mix(key_hash(5, "id"), F.lit(987654321987).cast("long")).alias("m"))
    rows = {r["id"]: (r["h"], r["m"]) for r in df.collect()}
    ours = [key_hash_value(5, int(i)) for i in ids]
    mixed = mix_array(np.array(ours), 987654321987)
    other = duckdb.connect().execute(
        f"SELECT id, {sql_hash(5, 'id')} AS h, {sql_mix(sql_hash(5, 'id'), '987654321987')} AS m "
        "FROM (SELECT unnest(range(2000)) AS id)").fetchall()
    assert all(rows[i] == (ours[i], mixed[i]) for i in range(2000))
    assert all(rows[i] == (h, m) for i, h, m in other)


def test_mix_spreads_evenly_and_trees_are_not_correlated():
    rows = mix_array(np.arange(200_000) * 7919, 12345)
    assert abs(rows.mean() / MIX_RANGE - 0.5) < 0.005
    other = mix_array(np.arange(200_000) * 7919, 12346)
    assert abs(np.corrcoef(rows, other)[0, 1]) < 0.01


@pytest.mark.parametrize("rate,bootstrap", [(1.0, True), (0.5, True), (0.6, False), (1.0, False)])
def test_tree_weights_agree_between_expression_and_tasks(spark, rate, bootstrap):
    df = spark.range(5000).select("id", key_hash(3, "id").alias("h"))
    expr = tree_weight(F.col("h"), F.lit(424242).cast("long"), rate, bootstrap)
    rows = df.select("h", expr.alias("w")).collect()
    tree = {"bootstrap": bootstrap, "rate": rate, "tree_hash": 424242,
            "poisson": np.array([int(p * MIX_RANGE) for p in poisson_cdf(rate)], np.int64)}
    weights = tree_weights(np.array([r["h"] for r in rows]), tree)
    assert [r["w"] for r in rows] == weights.tolist()
    assert abs(weights.mean() - rate) < 0.05


def test_encodings(spark):
    spec = FeatureSpec.parse("red, blue")
    assert spec.width == 3 and FeatureSpec.parse("C").width == 1 and encoded_width([spec, FeatureSpec()]) == 4
    for text, hot, code in (("red", [0, 1, 0], 1), (" blue ", [0, 0, 1], 2), ("green", [1, 0, 0], 0), ("?", [1, 0, 0], 0)):
        assert one(spark, spec.encode(F.lit(text))) == hot
        assert one(spark, spec.code(F.lit(text))) == code
    assert one(spark, FeatureSpec().encode(F.lit(" 2.5"))) == [2.5]
    assert FeatureSpec.parse("?, a").names == ("?", "a")


def test_array_functions(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, A.argmax(v(0.2, 0.4, 0.4))) == 1
    assert one(spark, A.normalize(v(1, 3))) == [0.25, 0.75]
    assert one(spark, A.normalize(v(0, 0))) == [0, 0]
    assert np.allclose(one(spark, A.stack_mean(v(0.8, 0.2, 0.4, 0.6), 2)), [0.6, 0.4])
    assert np.allclose(one(spark, A.mean_vectors(v(1, 2), v(3, 4))), [2, 3])
    df = spark.createDataFrame([([0.8, 0.2, 0.4, 0.6],)], "v array<double>")
    assert np.allclose(df.select(F.expr(A.models_mean("v", 2, 2))).first()[0], [0.6, 0.4])


def test_category_subsets(spark):
    assert one(spark, A.category_subset(F.lit(13), F.lit(4))) == [3, 2, 0]
    assert one(spark, A.category_subset(F.lit(1), F.lit(3))) == [0]
    assert one(spark, A.subset_count(F.lit(5))) == 15


def test_split_gain(spark):
    def gain(parent, left, **kw):
        names = [f"p{i}" for i in range(2)] + [f"l{i}" for i in range(2)]
        df = spark.createDataFrame([tuple(map(float, parent + left))], names)
        return df.select(F.expr(I.split_gain(names[:2], names[2:], **kw))).first()[0]

    assert gain([4, 4], [4, 0]) == 0.5
    assert gain([4, 4], [4, 0], min_instances=5) < -1e300
    assert gain([4, 4], [2, 2]) < -1e300
    assert gain([4, 4], [4, 0], impurity="entropy") == 1.0


def test_sampling_rates(spark):
    near = lambda c, x: abs(one(spark, c) - x) < 1e-6
    k, n = F.lit(10), F.lit(1000)
    assert near(R.keep_rate(k, n, True), 0.038460)
    assert near(R.keep_rate(k, n, False), 0.035613)
    assert one(spark, R.poisson_mean(F.lit(10.0), False)) == 1e-15
    assert near(R.binomial_rate(F.lit(1000.0), F.lit(0.01), False), 0.0012436)
