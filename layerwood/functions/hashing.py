"""Deterministic randomness.

Every random choice is a hash of ids and a seed, so a lost executor recomputes
the same rows and plain SQL can repeat the choice.  ``key_hash`` is used once
per row (or per value); ``mix`` is a cheap integer step for choices made per
(row, tree) or per (node, feature), where a digest each would be too slow.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32
MIX_RANGE = (1 << 31) - 1


def key_hash(seed: int, *cols) -> Column:
    """First 32 bits of md5(seed:col:...) as BIGINT in [0, 2^32)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                               else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def key_hash_value(seed: int, *values) -> int:
    text = ":".join([str(seed), *[str(v) for v in values]])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def mix(a: Column, b: Column) -> Column:
    """Mix two non-negative integers into [0, 2^31)."""
    x = (a % F.lit(MIX_RANGE)).bitwiseXOR(b % F.lit(MIX_RANGE))
    x = (x * F.lit(48271) + F.lit(11)) % F.lit(MIX_RANGE)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * F.lit(69621) + F.lit(7)) % F.lit(MIX_RANGE)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return (x * F.lit(40692)) % F.lit(MIX_RANGE)


def mix_array(a, b):
    """The same function on numpy integers; a product with the quotient is faster than the remainder."""
    def rest(x):
        return x - x // MIX_RANGE * MIX_RANGE

    x = np.bitwise_xor(rest(np.asarray(a, np.int64)), rest(np.asarray(b, np.int64)))
    x = rest(x * 48271 + 11)
    x = x ^ (x >> 15)
    x = rest(x * 69621 + 7)
    x = x ^ (x >> 13)
    return rest(x * 40692)
