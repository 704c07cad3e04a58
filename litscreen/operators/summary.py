"""What a run did and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COST = "decimal(38,6)"


def _total(cost: Column) -> Column:
    """Decimal addition gives the same total in any order; only the total is rounded, so small costs add up."""
    return F.coalesce(F.sum(cost.cast("decimal(28,15)")), F.lit(0)).cast(COST)


def cost_summary(responses: DataFrame, cost_col: str = "cost", error_col: str = "error") -> DataFrame:
    """Calls made, calls failed, and the cost of those that succeeded."""
    ok = F.col(error_col).isNull()
    return responses.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~ok).alias("failed"),
        _total(F.when(ok, F.col(cost_col))).alias("total_cost"),
    )


def run_summary(
    outcomes: DataFrame, cost_col: str = "cost", added_col: str = "added", failed_col: str | None = None
) -> DataFrame:
    """Pairs handled, records really written, and the cost, from one row per pair; with ``failed_col`` the failures too."""
    counts = [F.count(F.lit(1)).alias("pairs"), F.count_if(F.col(added_col)).alias("added")]
    if failed_col:
        counts.append(F.count_if(F.col(failed_col)).alias("failed"))
    return outcomes.agg(*counts, _total(F.col(cost_col)).alias("total_cost"))
