"""Apply fitted state models to a stream.

State assignment (E2), archetype rules (D15) and contradiction flags (D14)
are stateless projections once thresholds are fitted on a batch, so the same
functions run on a streaming DataFrame (``spark.readStream``); nothing here
keeps state between micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.archetype import assign_archetypes, instability_flags
from ..operators.binning import apply_states


def score_states(df: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """States, archetype and contradiction flags for every row (batch or streaming)."""
    return instability_flags(assign_archetypes(apply_states(df, thresholds)))
