"""Array expressions: class vectors, encodings, bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def argmax(vector) -> Column:
    """Zero-based position of the largest element, the first one on ties."""
    v = _col(vector)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def array_total(vector) -> Column:
    return F.aggregate(_col(vector), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def normalize(vector) -> Column:
    """Scale to sum 1; an all-zero vector stays as it is."""
    v = _col(vector)
    total = array_total(v)
    return F.when(total == 0, v).otherwise(F.transform(v, lambda x: x / total))


def stack_mean(vector, num_classes: int) -> Column:
    """Mean class vector of several concatenated ones (position modulo classes)."""
    v = _col(vector)
    forests = (F.size(v) / F.lit(num_classes)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda k: F.aggregate(
            F.sequence(F.lit(0), forests - 1), F.lit(0.0).cast("double"),
            lambda acc, j: acc + F.get(v, j * num_classes + k)) / forests)


def mean_vectors(*vectors) -> Column:
    """Element-wise mean of any number of equally long vectors."""
    cols = [_col(v) for v in vectors]
    total = reduce(lambda left, right: F.zip_with(left, right, lambda x, y: x + y), cols)
    return F.transform(total, lambda x: x / F.lit(float(len(cols))))


def category_names(spec: str) -> list[str]:
    """Names of a categorical feature; slot 0 is the unknown name '?'."""
    names = ["?"]
    for raw in spec.strip().split(","):
        name = raw.strip()
        if name not in names:
            names.append(name)
    return names


def ordinal(value, names: list[str]) -> Column:
    """Index of the trimmed value in names, 0 when it is not there."""
    listed = F.array(*[F.lit(n) for n in names])
    position = F.array_position(listed, F.trim(_col(value)))
    return F.when(position > 0, position - 1).otherwise(F.lit(0)).cast("double")


def one_hot(value, names: list[str]) -> Column:
    index = ordinal(value, names)
    return F.array(*[F.when(index == i, F.lit(1.0)).otherwise(F.lit(0.0)) for i in range(len(names))])


def to_csv_text(vector) -> Column:
    return F.array_join(F.transform(_col(vector), lambda x: x.cast("string")), ",")


def category_subset(number, arity) -> Column:
    """Positions of the one-bits of a number, highest first."""
    n, k = _col(number).cast("long"), _col(arity).cast("int")
    return F.filter(F.sequence(k - 1, F.lit(0), F.lit(-1)),
                    lambda j: F.call_function("shiftright", n, j).bitwiseAND(F.lit(1).cast("long")) == 1)


def subset_count(arity) -> Column:
    """Number of distinct two-sided splits of a category set: 2^(k-1)-1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _col(arity).cast("int") - 1) - 1


def models_mean(vector: str, models: int, num_classes: int) -> str:
    """SQL for the mean of a known number of concatenated class vectors."""
    sums = [" + ".join(f"get({vector}, {m * num_classes + k})" for m in range(models)) for k in range(num_classes)]
    return "array(" + ", ".join(f"({s}) / {models}D" for s in sums) + ")"
