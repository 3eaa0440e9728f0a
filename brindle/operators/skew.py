"""Per-key results when a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are reduced to one compact state per join key before the join,
so that no task ever meets the raw rows of a hot key: Spark's partial aggregation
combines them where they are read, and the join sees one row a key from either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    left_groups: list[str] | None = None,
    right_groups: list[str] | None = None,
) -> DataFrame:
    """Aggregate the inner join of two inputs without building it.

    Equals ``left JOIN right USING (key) GROUP BY left_groups, right_groups`` (by key where
    no groups are given) with ``n_pairs = count(*)`` and the sums named in left_sums and
    right_sums. Each side becomes (key, groups, count, sums); counts multiply, the sums of
    one side are multiplied by the count of the other; then everything is rolled up. n_pairs
    is a decimal of 38 digits, for counts of a key hot on both sides don't fit 64 bits. Of a
    key with very many groups on both sides, adaptive execution splits the join.

    Null keys match nothing, as in SQL. Null measures add nothing; a sum over nulls only is
    null. Empty inputs give no rows. Other columns of the inputs are ignored, so clashing
    names do no harm.
    """
    ls, rs = left_sums or {}, right_sums or {}
    lg, rg = left_groups or [], right_groups or []

    def state(df: DataFrame, sums: dict[str, Column], groups: list[str], side: str) -> DataFrame:
        measured = df.select(
            F.col(key).alias(f"{side}_key"),
            *[F.col(g).alias(f"{side}_g{i}") for i, g in enumerate(groups)],
            *[c.alias(f"{side}_m{i}") for i, c in enumerate(sums.values())],
        ).filter(F.col(f"{side}_key").isNotNull())
        return measured.groupBy(f"{side}_key", *[f"{side}_g{i}" for i in range(len(groups))]).agg(
            F.count(F.lit(1)).alias(f"{side}_n"), *[F.sum(f"{side}_m{i}").alias(f"{side}_m{i}") for i in range(len(sums))]
        )

    joined = state(left, ls, lg, "l").join(state(right, rs, rg, "r"), F.col("l_key") == F.col("r_key"))
    by = [F.col(f"l_g{i}").alias(g) for i, g in enumerate(lg)] + [F.col(f"r_g{i}").alias(g) for i, g in enumerate(rg)]
    return joined.groupBy(*(by or [F.col("l_key").alias(key)])).agg(
        F.sum((F.col("l_n").cast("decimal(19,0)") * F.col("r_n").cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("n_pairs"),
        *[F.sum(F.col(f"l_m{i}") * F.col("r_n").cast("double")).alias(name) for i, name in enumerate(ls)],
        *[F.sum(F.col(f"r_m{i}") * F.col("l_n").cast("double")).alias(name) for i, name in enumerate(rs)],
    )


def top_row_per_key(df: DataFrame, key: str, value: str, row: str) -> DataFrame:
    """(key, value, row, n_rows, n_ties): for each key the row of the largest value, of equal values the smallest row.

    This is the join of the rows with the largest value of their key, aggregated eagerly:
    the rows become states (key, value) -> (smallest row, count), the states become bounds
    key -> (largest value, count), the compact states and bounds are joined on both columns,
    and each joined pair is already the roll-up of its key. A hot key's rows are combined
    before either shuffle, and its distinct values spread over all partitions, because the
    states are hashed by key and value together. The table is read and shuffled once: either
    side of the join takes the states from the same exchange.

    Rows with a null key or value don't count; null rows count as rows but name none (a key
    with such rows only has a null row). NaN is the largest value, as in Spark's ordering.
    Repeated rows change n_rows and n_ties only. An empty table gives no rows; other columns
    are ignored.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(row).alias("r")).filter(
        F.col("k").isNotNull() & F.col("v").isNotNull()
    )
    states = rows.groupBy("k", "v").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("n"))
    bounds = states.groupBy("k").agg(F.max("v").alias("top"), F.sum("n").alias("rows_of_key"), F.min("r").alias("least"))
    bounds = bounds.select(F.col("k").alias("bound_key"), "top", "rows_of_key", "least")
    # the last condition always holds; it asks both sides for the same columns, so that they share one exchange
    whole = F.col("r").isNull() | (F.col("r") >= F.col("least"))
    joined = states.join(bounds, (F.col("k") == F.col("bound_key")) & (F.col("v") == F.col("top")) & whole)
    return joined.select(
        F.col("k").alias(key), F.col("v").alias(value), F.col("r").alias(row), F.col("rows_of_key").alias("n_rows"), F.col("n").alias("n_ties")
    )
