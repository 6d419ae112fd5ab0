"""From layers to a normalised objective and the best units of an eligible grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators import model


def objective(values: DataFrame, problem: DataFrame, k: int) -> DataFrame:
    """unit, objective. values: (layer, unit, amount); problem: (layer, direction, importance), a row per layer."""
    scales = F.broadcast(problem).join(model.top_k_scale(values, k), "layer", "left")
    return model.fused(values, model.normalised(scales))


def best(units: DataFrame, n: int) -> DataFrame:
    return units.orderBy(F.desc("objective"), "unit").limit(n)
