"""Market-basket rules: frequent product sets of up to three and their rules.

Sets are counted level by level.  After the first level a basket keeps frequent
products only, and there are at most (mean basket size / min_support) of those,
so the sets one basket can produce are bounded whatever the size of the sale.
Equal baskets are merged with a weight before they are expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.functions.numbers import rint
from shopgrain.functions.ordering import top_n
from shopgrain.functions.tenancy import attach, tenant_bound
from shopgrain.sources.shared import materialize

MIN_BASKETS = 10
#: Items that a task joins with their sales and gathers to baskets, on average.
ITEMS_IN_TASK = 500_000
#: Frequent products or pairs, in bytes, that are sent to every task; more of them are shuffled.
SENT_BYTES = 16 * 1024 * 1024


def by_sale(itens: DataFrame, rows: int) -> DataFrame:
    """Deal ``itens``, of which there are ``rows``, to tasks by sale, their number growing with the rows.

    Gathering baskets sorts the items of a task, so its memory would grow with
    the data while the session's partitions do not.  A join with the sales and
    :func:`itemsets` after this keep the dealing, for which it must name their
    keys; the name of a single shop is a constant and not among them.
    """
    if rows <= ITEMS_IN_TASK:
        return itens
    session = int(itens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["venda_key"] if tenant_bound(itens) == 1 else ["client_key", "venda_key"]
    return itens.repartition(max(session, -(-rows // ITEMS_IN_TASK)), *keys)


def _frequent(counts: DataFrame, n: DataFrame, min_support: float) -> DataFrame:
    share = F.col("_count").cast("double") / F.col("_n").cast("double")
    return attach(counts, n).filter((F.col("_n") >= MIN_BASKETS) & (share >= min_support))


def _sent(found: DataFrame, *cols: str) -> bool:
    """Whether the frequent products or pairs in ``cols`` are few enough to be sent to every task."""
    size = sum(F.octet_length(c) + F.lit(16) for c in cols)
    return (found.agg(F.sum(size)).first()[0] or 0) <= SENT_BYTES


def _join_found(baskets: DataFrame, found: DataFrame, on: Sequence[str], sent: bool) -> DataFrame:
    """Join baskets with what was found frequent, never sending the baskets.

    The planner cannot tell how many rows an expanded basket makes.  Without a
    hint it may take the baskets for the smaller side, and gather them all in
    the driver to broadcast them.
    """
    return baskets.join(F.broadcast(found) if sent else found.hint("merge"), list(on))


def _after(items: Column, index: Column) -> Column:
    return F.slice(items, index + F.lit(2), F.size(items))


def itemsets(
    itens: DataFrame, min_support: float = 0.01, max_len: int = 3, item: str = "produto_key"
) -> DataFrame:
    """Product sets bought together in at least ``min_support`` of the sales.

    Fewer than ten sales give no sets.  A product repeated in a sale counts once.
    """
    # One row per distinct basket.  What several levels read is written once: baskets, frequent products and pairs.
    whole = materialize(
        itens.groupBy("client_key", "venda_key").agg(F.array_sort(F.collect_set(item)).alias("_basket"))
        .groupBy("client_key", "_basket").agg(F.count(F.lit(1)).alias("_weight"))
    )
    n = whole.groupBy("client_key").agg(F.sum("_weight").alias("_n"))
    single = materialize(_frequent(
        whole.select("client_key", "_weight", F.explode("_basket").alias("_item"))
        .groupBy("client_key", "_item").agg(F.sum("_weight").alias("_count")),
        n, min_support,
    ))
    levels = [single.select("client_key", F.array("_item").alias("itens"), "_count", "_n")]
    # Baskets keep their frequent products, of which a shop has at most mean basket size / min_support.
    kept = single.groupBy("client_key").agg(F.collect_list("_item").alias("_kept"))
    baskets = (
        _join_found(whole, kept, ["client_key"], _sent(single, "_item"))
        .select("client_key", F.array_intersect("_basket", "_kept").alias("_basket"), "_weight")
        .filter(F.size("_basket") > 1)
        .groupBy("client_key", "_basket").agg(F.sum("_weight").alias("_weight"))
    )
    if max_len >= 3:
        baskets = materialize(baskets)
    if max_len >= 2:
        two = baskets.select(
            "client_key", "_weight",
            F.posexplode("_basket").alias("_i", "_a"), "_basket",
        ).select(
            "client_key", "_weight", "_a",
            F.explode(_after(F.col("_basket"), F.col("_i"))).alias("_b"),
        )
        pair_counts = materialize(_frequent(
            two.groupBy("client_key", "_a", "_b").agg(F.sum("_weight").alias("_count")),
            n, min_support,
        ))
        levels.append(
            pair_counts.select("client_key", F.array("_a", "_b").alias("itens"), "_count", "_n")
        )
    if max_len >= 3:
        sent = _sent(pair_counts, "_a", "_b")
        # Partners of a product that come after it, from the frequent pairs.
        partners = pair_counts.groupBy("client_key", "_a").agg(
            F.array_sort(F.collect_list("_b")).alias("_next")
        )
        first = _join_found(
            baskets.select("client_key", "_weight", "_basket", F.explode("_basket").alias("_a")),
            partners, ["client_key", "_a"], sent,
        ).select(
            "client_key", "_weight", "_a",
            F.array_sort(F.array_intersect("_basket", "_next")).alias("_rest"),
        ).filter(F.size("_rest") > 1).groupBy("client_key", "_a", "_rest").agg(
            F.sum("_weight").alias("_weight")
        )
        second = partners.select(
            "client_key", F.col("_a").alias("_b"), F.col("_next").alias("_next_b")
        )
        three = _join_found(
            first.select("client_key", "_weight", "_a", "_rest", F.explode("_rest").alias("_b")),
            second, ["client_key", "_b"], sent,
        ).select(
            "client_key", "_weight", "_a", "_b",
            F.explode(F.array_intersect("_rest", "_next_b")).alias("_c"),
        )
        levels.append(
            _frequent(
                three.groupBy("client_key", "_a", "_b", "_c").agg(
                    F.sum("_weight").alias("_count")
                ),
                n, min_support,
            ).select("client_key", F.array("_a", "_b", "_c").alias("itens"), "_count", "_n")
        )
    out = levels[0]
    for level in levels[1:max_len]:
        out = out.unionByName(level)
    return out.select(
        "client_key", "itens", F.size("itens").cast("bigint").alias("tamanho"),
        F.col("_count").cast("bigint").alias("contagem"),
        (F.col("_count").cast("double") / F.col("_n").cast("double")).alias("suporte"),
    )


def _splits(items: Column) -> Column:
    """Every (antecedent, consequent) division of a set of two or three."""
    def pick(i: int) -> Column:
        return F.array(F.element_at(items, i))

    def drop(i: int) -> Column:
        return F.array_except(items, pick(i))

    def both(i: int) -> Sequence[Column]:
        return (
            F.struct(pick(i).alias("_ante"), drop(i).alias("_cons")),
            F.struct(drop(i).alias("_ante"), pick(i).alias("_cons")),
        )

    two = F.array(both(1)[0], both(2)[0])
    three = F.array(*[s for i in (1, 2, 3) for s in both(i)])
    return F.when(F.size(items) == 2, two).otherwise(three)


def regras(sets: DataFrame, min_confidence: float = 0.2, min_lift: float = 1.2) -> DataFrame:
    """Association rules of the frequent sets, in percent.

    The sets are few but costly, and are read three times, so they are written
    once first.
    """
    sets = materialize(sets)
    divided = sets.filter(F.col("tamanho") > 1).select(
        "client_key", F.col("suporte").alias("_both"), F.inline(_splits(F.col("itens")))
    )

    def support_of(side: str, name: str) -> DataFrame:
        return sets.select(
            "client_key", F.col("itens").alias(side), F.col("suporte").alias(name)
        )

    known = divided.join(support_of("_ante", "_sa"), ["client_key", "_ante"]).join(
        support_of("_cons", "_sc"), ["client_key", "_cons"]
    )
    confidence = F.col("_both") / F.col("_sa")
    lift = confidence / F.col("_sc")
    return known.filter((lift >= min_lift) & (confidence >= min_confidence)).select(
        "client_key",
        F.array_join("_ante", ", ").alias("antecedents"),
        F.array_join("_cons", ", ").alias("consequents"),
        rint(F.col("_both") * 100.0, 2).alias("support"),
        rint(confidence * 100.0, 2).alias("confidence"),
        rint(lift, 3).alias("lift"),
    )


def _best_first() -> tuple[Column, ...]:
    return F.desc("lift"), F.asc("antecedents"), F.asc("consequents")


def top_regras(rules: DataFrame, n: int = 10) -> DataFrame:
    return top_n(rules, n, *_best_first())


def sugestoes(rules: DataFrame, produto: str, n: int = 5, exact: bool = True) -> DataFrame:
    """Best rules whose antecedent holds the product.

    ``exact=False`` also accepts the key as part of a longer one.
    """
    if exact:
        hit = F.array_contains(F.split("antecedents", ", "), produto)
    else:
        hit = F.contains(F.col("antecedents"), F.lit(produto))
    return top_n(rules.filter(hit), n, *_best_first())
