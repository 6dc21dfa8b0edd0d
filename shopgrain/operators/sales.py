"""Sales KPIs, trends, comparisons and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopgrain.functions.numbers import dbl, div0, money_sum
from shopgrain.functions.ordering import top_n
from shopgrain.functions.periods import items_since, sale_keys, since, starting, with_starts
from shopgrain.functions.tenancy import attach, for_every_shop
from shopgrain.schema import DONE, WIDE_MONEY

# Fixed values.
WEEKDAYS = ("Dom", "Seg", "Ter", "Qua", "Qui", "Sex", "Sáb")
MONTHS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
GRID_DAYS = ("Seg", "Ter", "Qua", "Qui", "Sex", "Sáb")
GRID_HOURS = ("08h", "09h", "10h", "11h", "12h", "13h", "14h", "15h", "16h", "17h", "18h")
NO_CATEGORY = "Sem Categoria"
NO_SELLER = "Não Informado"


def _done(vendas: DataFrame) -> DataFrame:
    return vendas.filter(F.col("status") == DONE)


def _done_since(vendas: DataFrame, period: str, kind: str, as_of) -> DataFrame:
    return since(_done(vendas), period, kind, as_of, clock=vendas)


def _zero(col: Column) -> Column:
    return F.coalesce(dbl(col), F.lit(0.0))


def _hour(col: str) -> Column:
    return F.lpad(F.hour(col).cast("string"), 2, "0")


def _name_of(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def home_kpis(
    vendas: DataFrame, itens: DataFrame, as_of=None, shops: DataFrame | None = None
) -> DataFrame:
    """Month-to-date revenue, ticket, count and items per sale.

    ``shops`` lists the shops that get a row; without it the sales are asked.
    """
    sales = _done_since(vendas, "month", "to_date", as_of)
    keys = sale_keys(itens, vendas)
    kpis = sales.groupBy("client_key").agg(
        money_sum("total").alias("_sum"), F.count(F.lit(1)).alias("total_vendas")
    )
    pieces = (
        items_since(itens, vendas, as_of, starting("month", "to_date")).select(*keys, "quantidade")
        .join(sales.select(*keys), keys, "left_semi")
        .groupBy("client_key")
        .agg(F.sum("quantidade").alias("_pieces"))
    )
    both = for_every_shop(
        attach(kpis, pieces, how="left"), vendas if shops is None else shops, ["total_vendas"]
    )
    return both.select(
        "client_key",
        _zero("_sum").alias("faturamento"),
        div0(F.col("_sum"), F.col("total_vendas")).alias("ticket_medio"),
        "total_vendas",
        div0(F.col("_pieces"), F.col("total_vendas")).alias("itens_por_venda"),
    )


def vendas_resumo(vendas: DataFrame) -> DataFrame:
    """All-time totals of finished sales; a shop without any gets zeros, in the same pass."""
    done = F.col("status") == DONE
    sums = vendas.groupBy("client_key").agg(
        money_sum(F.when(done, F.col("total"))).alias("_sum"),
        F.count(F.when(done, 1)).alias("total_vendas"),
        money_sum(F.when(done, F.col("desconto"))).alias("_disc"),
    )
    return sums.select(
        "client_key",
        _zero("_sum").alias("faturamento"),
        "total_vendas",
        div0(F.col("_sum"), F.col("total_vendas")).alias("ticket_medio"),
        _zero("_disc").alias("total_desconto"),
    )


def _per_day(sales: DataFrame) -> DataFrame:
    return sales.groupBy("client_key", F.col("data_venda").cast("date").alias("_dia")).agg(
        F.count(F.lit(1)).alias("vendas"), money_sum("total").alias("_fat")
    )


def _iso(col: str) -> Column:
    return F.col(col).cast("string").alias("dia")


def vendas_por_dia(vendas: DataFrame, period: str = "month", as_of=None) -> DataFrame:
    """Revenue per day over this period and the one before."""
    days = _per_day(_done_since(vendas, period, "compare", as_of))
    return days.select(
        "client_key", _iso("_dia"), "vendas", _zero("_fat").alias("faturamento"),
        F.lit(0.0).alias("media_movel"),
    ).orderBy("client_key", "dia")


def vendas_tendencia(vendas: DataFrame, period: str = "month", as_of=None) -> DataFrame:
    """Revenue per day with the mean of the last 7 days that have sales."""
    days = _per_day(_done_since(vendas, period, "trend", as_of))
    skip = 0 if period == "year" else 6
    # One row per day: a shop's window is bounded by the calendar.
    by_day = Window.partitionBy("client_key").orderBy("_dia")
    mean7 = F.round(F.avg("_fat").over(by_day.rowsBetween(-6, 0)), 2)
    out = days.select(
        "client_key", _iso("_dia"), "vendas", _zero("_fat").alias("faturamento"),
        _zero(mean7).alias("media_movel"),
        F.row_number().over(by_day).alias("_rn"),
        F.count(F.lit(1)).over(Window.partitionBy("client_key")).alias("_days"),
    )
    # A series no longer than the warm-up is shown whole.
    return (
        out.filter((F.col("_rn") > skip) | (F.col("_days") <= skip))
        .drop("_rn", "_days").orderBy("client_key", "dia")
    )


def top_dias(vendas: DataFrame, period: str = "week", as_of=None, n: int = 5) -> DataFrame:
    days = _per_day(_done_since(vendas, period, "to_date", as_of))
    best = top_n(days, n, F.desc("_fat"), F.asc("_dia"))
    return best.select("client_key", _iso("_dia"), "vendas", _zero("_fat").alias("faturamento"))


def vendas_por_hora(vendas: DataFrame, period: str = "week", as_of=None) -> DataFrame:
    sales = _done_since(vendas, period, "rolling", as_of)
    return (
        sales.groupBy("client_key", F.concat(_hour("data_venda"), F.lit(":00")).alias("hora"))
        .agg(_zero(money_sum("total")).alias("faturamento"))
        .orderBy("client_key", "hora")
    )


def mix_categorias(
    itens: DataFrame, vendas: DataFrame, produtos: DataFrame, period: str = "week",
    as_of=None, n: int = 5,
) -> DataFrame:
    """Best categories by revenue."""
    keys = sale_keys(itens, vendas)
    sales = _done_since(vendas, period, "rolling", as_of).select(*keys)
    # Sum per product first: what meets the catalogue is one row per product.
    per_product = (
        items_since(itens, vendas, as_of, starting(period, "rolling"))
        .select(*keys, "produto_key", "total").join(sales, keys)
        .groupBy("client_key", "produto_key")
        .agg(money_sum("total").alias("_fat"))
    )
    per_category = (
        per_product.join(
            produtos.select("client_key", "produto_key", "categoria"),
            ["client_key", "produto_key"], "left",
        )
        .groupBy("client_key", F.coalesce("categoria", F.lit(NO_CATEGORY)).alias("categoria"))
        .agg(F.sum("_fat").cast(WIDE_MONEY).alias("_fat"))
    )
    best = top_n(per_category, n, F.desc("_fat"), F.asc("categoria"))
    return best.select("client_key", "categoria", _zero("_fat").alias("faturamento"))


def _change(now: Column, before: Column) -> Column:
    grown = F.when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(before == 0, grown).otherwise(
        F.try_divide(now - before, before) * 100.0
    )


def vendas_kpis_trend(
    vendas: DataFrame, period: str = "month", as_of=None, shops: DataFrame | None = None
) -> DataFrame:
    """Revenue, ticket, count and discount share of two periods in one pass.

    ``shops`` lists the shops that get rows; without it the sales are asked.
    """
    sales, at = with_starts(
        _done(vendas), vendas, as_of,
        now=starting(period, "current"), before=starting(period, "previous"),
    )
    moment = F.col("data_venda")
    current = moment >= at["now"]
    previous = moment < at["now"]
    amount, off = F.col("total").cast(WIDE_MONEY), F.col("desconto").cast(WIDE_MONEY)
    sums = sales.filter(moment >= at["before"]).groupBy("client_key").agg(
        *[
            agg.alias(f"{name}_{tag}")
            for tag, which in (("a", current), ("p", previous))
            for name, agg in (
                ("fat", _zero(F.sum(F.when(which, amount)))),
                ("n", F.count(F.when(which, 1)).cast("double")),
                ("off", _zero(F.sum(F.when(which, off)))),
            )
        ]
    )
    sums = for_every_shop(sums, vendas if shops is None else shops, [c for c in sums.columns if c != "client_key"])
    fat = (F.col("fat_a"), F.col("fat_p"))
    n = (F.col("n_a"), F.col("n_p"))
    ticket = tuple(div0(f, c) for f, c in zip(fat, n))
    share = tuple(
        div0(o, f + o) * 100.0 for o, f in ((F.col("off_a"), fat[0]), (F.col("off_p"), fat[1]))
    )

    def line(kpi: str, pair, change: Column) -> Column:
        return F.struct(
            F.lit(kpi).alias("kpi"), pair[0].alias("atual"), pair[1].alias("anterior"),
            change.alias("variacao"),
        )

    lines = F.array(
        line("faturamento", fat, _change(*fat)),
        line("ticket_medio", ticket, _change(*ticket)),
        line("total_transacoes", n, _change(*n)),
        line("perc_desconto", share, share[0] - share[1]),
    )
    return sums.select("client_key", F.inline(lines))


def ranking_vendedores(
    vendas: DataFrame, itens: DataFrame, period: str = "month", as_of=None
) -> DataFrame:
    """Sellers by revenue with ticket, pieces per sale and discount share."""
    keys = sale_keys(itens, vendas)
    sales = _done_since(vendas, period, "to_date", as_of).select(
        *keys, "vendedor_id", "total", "desconto"
    )
    # Items of the period only; summed per sale so that the join keeps one row each.
    pieces = (
        items_since(itens, vendas, as_of, starting(period, "to_date")).select(*keys, "quantidade").join(sales.select(*keys), keys, "left_semi")
        .groupBy(*keys).agg(F.sum("quantidade").alias("_pieces"))
    )
    per_seller = sales.join(pieces, keys, "left").groupBy(
        "client_key", "vendedor_id"
    ).agg(
        F.count(F.lit(1)).alias("vendas"),
        money_sum("total").alias("_fat"),
        money_sum("desconto").alias("_off"),
        F.sum("_pieces").alias("_pieces"),
    )
    name = F.coalesce("vendedor_id", F.lit(NO_SELLER))
    gross = F.col("_fat") + F.col("_off")
    return per_seller.select(
        "client_key", name.alias("id"), name.alias("nome"), "vendas",
        _zero("_fat").alias("faturamento"),
        div0(F.col("_fat"), F.col("vendas")).alias("ticket"),
        div0(F.col("_pieces"), F.col("vendas")).alias("upa"),
        (div0(F.col("_off"), gross) * 100.0).alias("desconto"),
    ).orderBy("client_key", F.desc("faturamento"), "id")


def vendas_heatmap(vendas: DataFrame, period: str = "month", as_of=None) -> DataFrame:
    """Revenue by weekday and hour."""
    sales = _done_since(vendas, period, "to_date", as_of)
    return (
        sales.groupBy(
            "client_key", F.dayofweek("data_venda").alias("_dow"),
            F.concat(_hour("data_venda"), F.lit("h")).alias("hora"),
        )
        .agg(money_sum("total").alias("_fat"))
        .select(
            "client_key", _name_of(WEEKDAYS, F.col("_dow")).alias("dia"), "hora",
            _zero("_fat").alias("faturamento"),
        )
    )


def comparativo(vendas: DataFrame, period: str = "month", as_of=None) -> DataFrame:
    """This period against the one before, point by point; gaps are 0.

    The anchor is the shop's last day with sales in the window.  A month is
    shifted with its days clamped (31 March meets the last day of February).
    """
    days = _per_day(_done_since(vendas, period, "compare", as_of)).drop("vendas")
    anchor = days.groupBy("client_key").agg(F.max("_dia").alias("_last"))
    last = F.col("_last")
    if period == "week":
        first = F.trunc(last, "week")
        points = F.sequence(first, F.date_add(first, 6))
        shifted = F.date_sub("_at", 7)
        label = _name_of(WEEKDAYS, F.dayofweek("_at"))
    elif period == "month":
        points = F.sequence(F.trunc(last, "month"), last)
        shifted = F.add_months("_at", -1)
        label = F.dayofmonth("_at").cast("string")
    elif period == "year":
        days = days.groupBy("client_key", F.trunc("_dia", "month").alias("_dia")).agg(
            F.sum("_fat").alias("_fat")
        )
        points = F.sequence(
            F.trunc(last, "year"), F.trunc(last, "month"), F.make_ym_interval(F.lit(0), F.lit(1))
        )
        shifted = F.add_months("_at", -12)
        label = _name_of(MONTHS, F.month("_at"))
    else:
        raise ValueError(f"unknown period: {period}")
    calendar = anchor.select("client_key", F.posexplode(points).alias("_i", "_at")).withColumn(
        "_before", shifted
    )
    now = days.select("client_key", F.col("_dia").alias("_at"), F.col("_fat").alias("_now"))
    before = days.select(
        "client_key", F.col("_dia").alias("_before"), F.col("_fat").alias("_prev")
    )
    return (
        calendar.join(now, ["client_key", "_at"], "left")
        .join(before, ["client_key", "_before"], "left")
        .select(
            "client_key", (F.col("_i") + 1).cast("bigint").alias("ordem"), label.alias("label"),
            _zero("_now").alias("atual"), _zero("_prev").alias("anterior"),
        )
        .orderBy("client_key", "ordem")
    )


def mix_share(mix: DataFrame) -> DataFrame:
    """Share of the shown categories; ``mix`` has at most a handful of rows per shop."""
    shown = F.sum("faturamento").over(Window.partitionBy("client_key"))
    share = F.when(shown > 0, F.col("faturamento") / shown * 100.0).otherwise(F.lit(0.0))
    return mix.select("client_key", "categoria", "faturamento", share.alias("percentual"))


def heatmap_normalizado(heatmap: DataFrame) -> DataFrame:
    """Full weekday x opening-hour grid, each cell relative to the peak."""
    peak = heatmap.groupBy("client_key").agg(
        F.greatest(F.max("faturamento"), F.lit(1.0)).alias("_peak")
    )
    grid = peak.select(
        "client_key", "_peak",
        F.explode(F.array(*[F.lit(d) for d in GRID_DAYS])).alias("dia"),
    ).select(
        "client_key", "_peak", "dia",
        F.explode(F.array(*[F.lit(h) for h in GRID_HOURS])).alias("hora"),
    )
    cell = F.coalesce("faturamento", F.lit(0.0))
    return grid.join(heatmap, ["client_key", "dia", "hora"], "left").select(
        "client_key", "dia", "hora", cell.alias("faturamento"),
        (cell / F.col("_peak")).alias("intensidade"),
    )


def dia_detalhe(por_dia: DataFrame) -> DataFrame:
    """Daily rows with the ticket of the day."""
    return por_dia.select(
        "client_key", "dia", "vendas", "faturamento",
        (F.col("faturamento") / F.col("vendas")).alias("ticket_medio"),
    )


def dia_extremos(por_dia: DataFrame) -> DataFrame:
    """Best and worst day by revenue, the earlier day on a tie."""
    best = F.max_by(F.struct("dia", "faturamento", "vendas"), F.struct(
        F.col("faturamento"), -F.unix_date(F.col("dia").cast("date"))
    ))
    worst = F.min_by(F.struct("dia", "faturamento", "vendas"), F.struct(
        F.col("faturamento"), F.unix_date(F.col("dia").cast("date"))
    ))
    return por_dia.groupBy("client_key").agg(best.alias("b"), worst.alias("w")).select(
        "client_key",
        F.col("b.dia").alias("melhor_dia"), F.col("b.faturamento").alias("melhor_faturamento"),
        F.col("b.vendas").alias("melhor_vendas"),
        F.col("w.dia").alias("pior_dia"), F.col("w.faturamento").alias("pior_faturamento"),
        F.col("w.vendas").alias("pior_vendas"),
    )
