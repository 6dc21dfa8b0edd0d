"""Positions, running totals and exact percentiles in very large groups.

A window partitioned by shop alone sends the whole of the largest shop to one
task.  :func:`ranked` sorts by ranges of (group, key) instead: Spark cuts the
ranges to the size of the data, a large group spans many of them, and a row's
place in its range plus the rows of earlier ranges is its place in the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.tenancy import attach
from shopgrain.sources.shared import materialize

#: Bits of a running id that hold the place in its partition.
_PLACE_BITS = 33


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column] | None = None,
    groups_per_tenant: int = 1,
    peers: int = 0,
) -> DataFrame:
    """Add ``_pos`` (1-based place), ``_n`` (group size) and running totals.

    ``order`` lists ascending sort keys whose combination is unique within a
    group; pass ``-col`` for a descending number.  For each ``name: column``
    of ``totals`` the result has ``_cum_name`` (sum up to and including this
    row) and ``_sum_name`` (sum of the group).  With ``peers``, rows that agree
    in that many leading keys are tied, and ``_peers_name`` is the running sum
    up to the last of them, as in a RANGE frame.  A tie may span many ranges:
    its total is carried over their borders by one row for each range.

    The sorted rows are written once, with a running id that holds their range
    and their place in it; range totals and the result read the files.  Places
    need no further shuffle, running totals one by range.
    """
    by = list(by)
    totals = dict(totals or {})
    keys = {f"_k{i}": c for i, c in enumerate(order)}
    base = df.select(
        "*", *[c.alias(k) for k, c in keys.items()], *[c.alias(f"_v_{n}") for n, c in totals.items()]
    )
    placed = materialize(
        base.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_slice", F.shiftright("_id", _PLACE_BITS))

    tie = F.struct(*[F.col(f"_k{i}") for i in range(peers)])
    borders = [F.min_by(tie, "_id").alias("_first"), F.max_by(tie, "_id").alias("_last")] if peers else []
    per_slice = placed.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_start"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals], *borders,
    )
    # One row per range of a group.
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*by)
    offsets = per_slice.select(
        *by, "_slice", "_start",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"),
        F.sum("_rows").over(whole).alias("_n"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_off_{n}") for n in totals],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_sum_{n}") for n in totals],
        *(["_first", "_last"] if peers else []),
    )
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if peers:
        offsets = _tie_ends(placed, offsets, by, tie, list(totals), groups_per_tenant + ranges)
    joined = attach(
        placed, offsets, [*by, "_slice"], "inner", groups_per_tenant + ranges, 128
    )
    upto = Window.partitionBy(*by, "_slice").orderBy("_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    tied = Window.partitionBy(*by, "_slice").orderBy(*[f"_k{i}" for i in range(peers)]).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return joined.select(
        *df.columns,
        (F.col("_off") + F.col("_id") - F.col("_start") + 1).alias("_pos"),
        "_n",
        *[
            (F.sum(f"_v_{n}").over(upto) + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(
                f"_cum_{n}"
            )
            for n in totals
        ],
        *[
            F.coalesce(
                F.when(tie == F.col("_last"), F.col(f"_end_{n}")),
                F.sum(f"_v_{n}").over(tied) + F.coalesce(F.col(f"_off_{n}"), F.lit(0)),
            ).alias(f"_peers_{n}")
            for n in totals if peers
        ],
        *[f"_sum_{n}" for n in totals],
    )


def _tie_ends(
    placed: DataFrame, offsets: DataFrame, by: list[str], tie: Column, totals: list[str], rows_per_tenant: int
) -> DataFrame:
    """Add for each range the running totals at the end of the tie that its last row belongs to.

    Such a tie goes on in those later ranges that begin with it; null where it
    ends in its range and did not begin it.
    """
    slices = [*by, "_slice"]
    heads = attach(placed, offsets.select(*slices, "_first"), slices, "inner", rows_per_tenant, 128)
    heads = heads.filter(tie == F.col("_first")).groupBy(*slices).agg(
        *[F.sum(f"_v_{n}").alias(f"_head_{n}") for n in totals]
    )
    starts = offsets.join(heads, slices).groupBy(*by, F.col("_first").alias("_last")).agg(*[
        F.max_by(F.coalesce(F.col(f"_off_{n}"), F.lit(0)) + F.col(f"_head_{n}"), "_slice").alias(f"_end_{n}")
        for n in totals
    ])
    return materialize(offsets.join(starts, [*by, "_last"], "left"))


#: Accuracy of the sketch that brackets a percentile: a bracket holds about 6/ACCURACY of a group's rows.
ACCURACY = 10_000


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    points: Mapping[str, float],
    groups_per_tenant: int = 1,
) -> DataFrame:
    """Exact interpolated percentiles, one row per group.

    A mergeable sketch names two values around each percentile.  Rows below
    are counted, and only values between the two, equal ones merged, are put
    in order; so the rows are read where they lie and never sorted.  A group
    whose sketch missed is done again between its ends.
    """
    by = list(by)
    rows = materialize(df.select(*by, F.col(value).alias("_x")).filter(F.col("_x").isNotNull()))
    number = F.col("_x").cast("double")
    around = [x for p in points.values() for x in (max(0.0, p - 3 / ACCURACY), min(1.0, p + 3 / ACCURACY))]
    ends = materialize(
        rows.groupBy(*by).agg(F.percentile_approx(number, around, ACCURACY).alias("_q")).select(*by, *[
            F.col("_q")[2 * i + j].alias(f"_{side}_{name}")
            for i, name in enumerate(points) for j, side in enumerate(("from", "to"))
        ])
    )
    counts = _bracketed(rows, ends, by, points, groups_per_tenant)
    missed = F.lit(False)
    for name, p in points.items():
        lo, hi = _places(p)
        last = F.col(f"_below_{name}") + F.col(f"_inside_{name}") + 1
        missed |= (lo < F.col(f"_below_{name}")) | (hi > last)
    if not counts.filter(missed).isEmpty():
        again = ends.join(counts.filter(missed).select(*by, F.lit(True).alias("_again")), by, "left")
        # Nothing is above NaN.
        ends = materialize(again.select(*by, *[
            F.when(F.col("_again"), F.lit(end)).otherwise(F.col(f"_{side}_{name}")).alias(f"_{side}_{name}")
            for name in points for side, end in (("from", float("-inf")), ("to", float("nan")))
        ]))
        counts = _bracketed(rows, ends, by, points, groups_per_tenant)

    inside = attach(rows, ends, by, "inner", groups_per_tenant).select(*by, "_x", F.explode(F.array_compact(F.array(*[
        F.when(number.between(F.col(f"_from_{name}"), F.col(f"_to_{name}")), F.lit(name)) for name in points
    ]))).alias("_point")).groupBy(*by, "_point", "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = ranked(
        inside, [*by, "_point"], [F.col("_x")], {"c": F.col("_c")}, groups_per_tenant * len(points)
    ).join(counts.select(*by, "_n", *[f"_below_{name}" for name in points]).withColumnRenamed("_n", "_all"), by)

    def found(name: str, place: Column) -> Column:
        upto = F.col(f"_below_{name}") + F.col("_cum_c")
        here = (F.col("_point") == name) & (place <= upto) & (place > upto - F.col("_c"))
        return F.max(F.when(here, F.col("_x").cast("double")))

    picked = placed.groupBy(*by).agg(*[
        found(name, place).alias(f"_{side}_{name}")
        for name, p in points.items() for side, place in zip(("lo", "hi"), _places(p, "_all"), strict=True)
    ])

    def interpolate(name: str, p: float) -> Column:
        at = (F.col("_n") - 1) * F.lit(p)
        first, second = _places(p)
        below, last = F.col(f"_below_{name}"), F.col(f"_below_{name}") + F.col(f"_inside_{name}")
        lo = F.when(first == below, F.col(f"_prev_{name}")).otherwise(F.col(f"_lo_{name}"))
        hi = F.when(second == below, F.col(f"_prev_{name}")).when(
            second > last, F.col(f"_next_{name}")).otherwise(F.col(f"_hi_{name}"))
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return counts.join(picked, by).select(*by, *[interpolate(n, p) for n, p in points.items()])


def _places(p: float, n: str = "_n") -> tuple[Column, Column]:
    """The two places between which the percentile lies."""
    first = F.floor((F.col(n) - 1) * F.lit(p)) + 1
    return first, F.least(first + 1, F.col(n))


def _bracketed(
    rows: DataFrame, ends: DataFrame, by: list[str], points: Mapping[str, float], groups_per_tenant: int
) -> DataFrame:
    """Per group and percentile: rows below and within the bracket, and the values next to it."""
    x = F.col("_x").cast("double")
    per_point = []
    for name in points:
        low, high = F.col(f"_from_{name}"), F.col(f"_to_{name}")
        per_point += [
            F.count_if(x < low).alias(f"_below_{name}"), F.count_if(x.between(low, high)).alias(f"_inside_{name}"),
            F.max(F.when(x < low, x)).alias(f"_prev_{name}"), F.min(F.when(x > high, x)).alias(f"_next_{name}"),
        ]
    marked = attach(rows, ends, by, "inner", groups_per_tenant)
    return materialize(marked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *per_point))


def top_n(df: DataFrame, n: int, *order: Column, by: Sequence[str] = ("client_key",)) -> DataFrame:
    """First ``n`` rows per group.

    The optimizer turns the filter into a group limit that runs before the
    exchange, so each task sends at most ``n`` rows per group.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
