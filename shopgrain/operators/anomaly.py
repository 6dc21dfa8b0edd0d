"""Unusual sales, discounts and sellers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, div0, money_sum, rint
from shopgrain.functions.ordering import percentiles
from shopgrain.functions.tenancy import attach, for_every_shop, keep_bound
from shopgrain.schema import DONE, WIDE_MONEY
from shopgrain.sources.shared import materialize

FEATURES = ["_total", "_desconto", "hora", "_dia"]
SAMPLE = 256
EULER = 0.5772156649015329
ROWS_PER_BATCH = 200_000
#: Forests of up to this size are sent to every task; a tree has at most 2 x SAMPLE nodes of NODE_BYTES.
FOREST_BYTES = 128 * 1024 * 1024
NODE_BYTES = 28
SCORED = ["client_key", "venda_key", "data_venda", *FEATURES, "anomalia_score"]
SCORE_SCHEMA = (
    "client_key string, venda_key string, data_venda timestamp_ntz, _total double, _desconto double, hora int, _dia int, "
    "anomalia_score double"
)
#: A prime; a sale's draw for a tree is a linear function of its hash modulo this.
PRIME = 2_147_483_647


def _hashed(text: str, digits: int) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def _done(vendas: DataFrame) -> DataFrame:
    return vendas.filter(F.col("status") == DONE)


def _pct(off: Column, total: Column) -> Column:
    return div0(off, total) * 100.0


def _features(vendas: DataFrame) -> DataFrame:
    return _done(vendas).select(
        "client_key", "venda_key", "data_venda",
        F.coalesce(dbl("total"), F.lit(0.0)).alias("_total"),
        F.coalesce(dbl("desconto"), F.lit(0.0)).alias("_desconto"),
        F.coalesce(F.hour("data_venda"), F.lit(0)).alias("hora"),
        F.coalesce(F.weekday("data_venda"), F.lit(0)).alias("_dia"),
    )


def _path_tail(m: int) -> float:
    """Mean depth still missing below a leaf of ``m`` rows."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + EULER) - 2.0 * (m - 1) / m


def _grow(x: np.ndarray, seed: int, tree: int, limit: int):
    """One isolation tree as flat arrays: feature (-1 leaf), cut, children, depth.

    Feature and cut follow from digests of seed, tree and the node's place
    (children of place i are 2i and 2i + 1), so any engine grows the same tree.
    """
    feature, cut, left, right, depth = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False, 1)]
    while todo:
        rows, level, parent, is_right, place = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        left.append(-1)
        right.append(-1)
        if level >= limit or len(usable) == 0:
            feature.append(-1)
            cut.append(0.0)
            depth.append(level + _path_tail(len(rows)))
            continue
        f = int(usable[_hashed(f"{seed}:{tree}:{place}:f", 8) % len(usable)])
        at = float(lo[f] + _hashed(f"{seed}:{tree}:{place}:c", 13) / float(1 << 52) * (hi[f] - lo[f]))
        feature.append(f)
        cut.append(at)
        depth.append(0.0)
        goes_left = part[:, f] <= at
        todo.append((rows[~goes_left], level + 1, node, True, 2 * place + 1))
        todo.append((rows[goes_left], level + 1, node, False, 2 * place))
    return feature, cut, left, right, depth


def _trees(samples: DataFrame, seed: int) -> DataFrame:
    schema = (
        "client_key string, _tree int, _psi int, _feature array<int>, _cut array<double>, "
        "_left array<int>, _right array<int>, _depth array<double>"
    )

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        limit = max(1, math.ceil(math.log2(len(pdf))))
        x = pdf[FEATURES].to_numpy(dtype=float)
        arrays = _grow(x, seed, tree, limit)
        return pd.DataFrame([[pdf["client_key"].iloc[0], tree, len(pdf), *arrays]], columns=[
            "client_key", "_tree", "_psi", "_feature", "_cut", "_left", "_right", "_depth",
        ])

    return keep_bound(
        samples.groupBy("client_key", "_tree").applyInPandas(grow, schema), samples
    )


def _samples(rows: DataFrame, sizes: DataFrame, trees: int, seed: int) -> DataFrame:
    """For each tree the ``SAMPLE`` rows with the smallest hashes.

    A row enters a tree's candidates with a chance of about 4 x SAMPLE / n, so
    what is ranked stays near 4 x SAMPLE rows per tree however large the shop.
    """
    key = F.concat(F.lit(f"{seed}:"), F.col("venda_key"))
    digest = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % PRIME
    draws = F.array(*[
        F.struct(F.lit(t).alias("_tree"), (
            (F.col("_d") * (1 + _hashed(f"{seed}:{t}:a", 8) % (PRIME - 1)) + _hashed(f"{seed}:{t}:b", 8) % PRIME) % PRIME
        ).alias("_h"))
        for t in range(trees)
    ])
    # Only the trees that a sale is a candidate of become rows, a handful in a large shop.
    below = F.lit(4.0 * SAMPLE * PRIME) / F.col("_n")
    near = attach(rows, sizes).withColumn("_d", digest).select(
        "client_key", *FEATURES, "venda_key", "_n", F.inline(F.filter(draws, lambda d: d["_h"] < below)),
    )
    w = Window.partitionBy("client_key", "_tree").orderBy("_h", "venda_key")
    return near.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= SAMPLE).drop(
        "_rn", "_n"
    )


def _score(left: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
    """Mean path length over the trees, turned into a score (lower is odder)."""
    x = left[FEATURES].to_numpy(dtype=float)
    total = np.zeros(len(x))
    forest = forest.sort_values("_tree")
    arrays = [forest[c] for c in ("_feature", "_cut", "_left", "_right", "_depth")]
    for tree in zip(*arrays):
        feature, cut, lo, hi, depth = (np.asarray(a) for a in tree)
        node = np.zeros(len(x), dtype=np.int64)
        active = feature[node] >= 0
        while active.any():
            at = node[active]
            go_left = x[active, feature[at]] <= cut[at]
            node[active] = np.where(go_left, lo[at], hi[at])
            active = feature[node] >= 0
        total += depth[node]
    psi = int(forest["_psi"].max()) if len(forest) else 1
    tail = _path_tail(psi) or 1.0
    # Nine places do not depend on the order of the sum.
    score = np.round(-np.power(2.0, -(total / max(len(forest), 1)) / tail), 9)
    return left.assign(anomalia_score=score)


def pontuar_vendas(vendas: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """Isolation score of every finished sale of shops with at least 50 sales.

    Trees grow from small hash samples.  Sales are scored where they lie while
    the forests of all shops fit into FOREST_BYTES, which every task then holds;
    beyond that in batches of bounded size, each beside a copy of its shop's
    forest.
    """
    rows = _features(vendas)
    sizes = materialize(rows.groupBy("client_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 50"))
    forest = materialize(_trees(_samples(rows, sizes, trees, seed), seed))
    most = FOREST_BYTES // (trees * 2 * SAMPLE * NODE_BYTES)
    if sizes.limit(most + 1).count() <= most:
        return keep_bound(_scored_in_place(rows, forest), vendas)
    return keep_bound(_scored_by_batch(rows, sizes, forest), vendas)


def _scored_in_place(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """Scores of the sales of shops that have a forest; ``forest`` is small and goes to every task."""
    forests = dict(tuple(forest.toPandas().groupby("client_key")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shop, sales in batch.groupby("client_key"):
                if shop in forests:
                    yield _score(sales, forests[shop])

    return rows.select(*SCORED[:-1]).mapInPandas(score, SCORE_SCHEMA)


def _scored_by_batch(rows: DataFrame, sizes: DataFrame, forest: DataFrame) -> DataFrame:
    """Scores of the sales, which are shuffled in batches to copies of their shop's forest."""
    batches = F.ceil(F.col("_n") / ROWS_PER_BATCH).cast("int")
    salted = attach(rows, sizes).select(
        *rows.columns, F.pmod(F.xxhash64("venda_key"), batches).cast("int").alias("_salt")
    )
    copies = attach(forest, sizes).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), batches - 1))
    ).select(
        "client_key", "_salt", "_tree", "_psi", "_feature", "_cut", "_left", "_right", "_depth"
    )
    keys = ["client_key", "_salt"]

    def score(sales: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        return _score(sales, trees)[SCORED]

    return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(score, SCORE_SCHEMA)


def anomalias_vendas(
    vendas: DataFrame, contamination: float = 0.05, trees: int = 100, seed: int = 42
) -> DataFrame:
    """Sales whose isolation score lies below the exact ``contamination`` quantile."""
    # Scored once: the percentile and the result both read the written scores.
    scores = materialize(pontuar_vendas(vendas, trees, seed))
    limit = percentiles(
        scores, ["client_key"], "anomalia_score", {"_limit": contamination},
    )
    return attach(scores, limit).filter(F.col("anomalia_score") < F.col("_limit")).select(
        "client_key", "venda_key", "data_venda", F.col("_total").alias("total"),
        F.col("_desconto").alias("desconto"), "hora", "anomalia_score",
    )


def anomalias_desconto(vendas: DataFrame, limit: float = 2.0) -> DataFrame:
    """Sales whose discount share is more than ``limit`` deviations above the mean."""
    rows = _done(vendas).select(
        "client_key", "venda_key", "data_venda", "vendedor_id", dbl("total").alias("total"),
        F.coalesce(dbl("desconto"), F.lit(0.0)).alias("desconto"),
    ).withColumn("pct_desconto", _pct(F.col("desconto"), F.col("total")))
    # Both are merged from partial means, so neither a huge share nor many sales lose digits.
    spread = rows.groupBy("client_key").agg(
        F.avg("pct_desconto").alias("_mean"), F.stddev_samp("pct_desconto").alias("_std")
    ).filter(F.col("_std") > 0)
    z = (F.col("pct_desconto") - F.col("_mean")) / F.col("_std")
    # Nine places do not depend on the order in which partitions arrive.
    return attach(rows, spread).filter(z > limit).select(*rows.columns, rint(z, 9).alias("z_score"))


def anomalias_vendedor(vendas: DataFrame) -> DataFrame:
    """Sellers with their mean ticket, mean discount and ticket z-score."""
    rows = _done(vendas).filter(F.col("vendedor_id").isNotNull())
    pct = _pct(F.coalesce(F.col("desconto"), F.lit(0)), F.col("total"))
    total = money_sum("total")
    sellers = rows.groupBy("client_key", "vendedor_id").agg(
        F.count("venda_key").alias("total_vendas"),
        rint(div0(total, F.count("total")), 2).alias("ticket_medio"),
        rint(F.avg(pct), 2).alias("desconto_medio"),
        dbl(total).alias("total_faturado"),
    )
    spread = sellers.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("ticket_medio").alias("_mean"),
        F.stddev_samp("ticket_medio").alias("_std"),
    )
    z = rint((F.col("ticket_medio") - F.col("_mean")) / F.col("_std"), 2)
    return attach(sellers, spread).select(
        *sellers.columns,
        F.when(F.col("_n") > 1, F.when(F.col("_std") > 0, z).otherwise(F.lit(0.0))).alias(
            "z_ticket"
        ),
    )


def resumo_anomalias(sales: DataFrame, discounts: DataFrame, shops: DataFrame) -> DataFrame:
    """Counts and amounts of both kinds of anomaly, one row per shop."""
    def money(col: str) -> Column:
        return dbl(F.sum(F.col(col).cast(WIDE_MONEY)))

    a = sales.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("total_anomalias_venda"), money("total").alias("valor_anomalias")
    )
    d = discounts.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("total_descontos_anomalos"),
        money("desconto").alias("valor_descontos"),
    )
    with_a = for_every_shop(a, shops, ["total_anomalias_venda", "valor_anomalias"])
    return attach(with_a, d, how="left").fillna(
        0, ["total_descontos_anomalos", "valor_descontos"]
    )


def descontos_por_vendedor(discounts: DataFrame) -> DataFrame:
    """Occurrences and amount per seller; ``destaque`` marks the shop's top seller."""
    per_seller = discounts.filter(F.col("vendedor_id").isNotNull()).groupBy(
        "client_key", "vendedor_id"
    ).agg(
        F.count(F.lit(1)).alias("ocorrencias"),
        dbl(F.sum(F.col("desconto").cast(WIDE_MONEY))).alias("desconto_total"),
    )
    top = per_seller.groupBy("client_key").agg(
        F.min_by("vendedor_id", F.struct(-F.col("ocorrencias"), F.col("vendedor_id"))).alias("_top")
    )
    return attach(per_seller, top).select(
        *per_seller.columns, (F.col("vendedor_id") == F.col("_top")).alias("destaque")
    )


def anomalias_por_hora(sales: DataFrame) -> DataFrame:
    return sales.groupBy("client_key", "hora").agg(F.count(F.lit(1)).alias("ocorrencias"))
