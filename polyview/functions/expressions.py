"""Component densities and log-sum-exp as Spark SQL expressions; parameters are literals, k is a category column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from polyview.functions.dist import LN_2PI
from polyview.plans.model import ln_factorial


def table(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.ravel(values)])


def pick(values: np.ndarray, k: Column) -> Column:
    return F.get(table(values), k)


def ln_density(kind: str, c: dict, k: Column, x: Column) -> Column:
    if kind == "continuous":
        z = (x - pick(c["mu"], k)) / pick(c["sigma"], k)
        return -0.5 * z * z - F.log(pick(c["sigma"], k)) - 0.5 * LN_2PI
    if kind == "categorical":
        return F.get(table(c["ln_w"]), k * c["ln_w"].shape[1] + x.cast("int"))
    rate = pick(c["rate"], k)
    return x.cast("double") * F.log(rate) - rate - ln_factorial(x)


def logsumexp(terms: list[Column]) -> Column:
    """-inf terms are fine; null if any term is null."""
    if len(terms) == 1:
        return terms[0]
    own = F.array(*terms)
    top = F.array_max(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(F.exists(own, lambda x: x.isNull()), None).when(top == float("-inf"), top).otherwise(top + F.log(total))
