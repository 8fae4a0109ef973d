"""Running totals and ranks in a global order, without one task for a whole group.

The order's first column is cut at sampled quantiles.  Totals of the cuts are summed before the rows of each cut are
ordered, so a task holds one cut of one group, and only the totals of the cuts meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64


def with_total_before(rows: DataFrame, name: str, order: list[str], by: list[str] | None = None, amount: Column | None = None, cuts: int = CUTS) -> DataFrame:
    """rows with column ``name``: the sum of ``amount`` (1 for each row if none is given) over the rows before, in the order, of the same group.

    The first column of ``order`` is a number and not null; ties go by the others.
    """
    by = by or []
    shares = [i / cuts for i in range(1, cuts)]
    edges = rows.agg(F.percentile_approx(order[0], shares, 100 * cuts)).head()[0] or []  # ``cuts`` numbers
    own = rows.withColumn("_amount", F.lit(1).cast("long") if amount is None else amount)
    own = own.withColumn("_cut", F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(order[0]))) if edges else F.lit(0))
    up_to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*by, "_cut").agg(F.sum("_amount").alias("_total"))
    totals = totals.select(*by, "_cut", F.coalesce(F.sum("_total").over(up_to_here(Window.partitionBy(*by).orderBy("_cut"))), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_amount").over(up_to_here(Window.partitionBy(*by, "_cut").orderBy(*order))), F.lit(0))
    ranked = own.withColumn("_within", within)
    same = [ranked[c].eqNullSafe(totals[c]) for c in [*by, "_cut"]]
    both = ranked.join(totals, same[0] if len(same) == 1 else same)
    return both.select(*(ranked[c] for c in rows.columns), (F.col("_before") + F.col("_within")).cast("long").alias(name))
