from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shopgrain.operators import load, normalize
from shopgrain.operators.publish import CACHE, HISTORY, publicar_insights
from shopgrain.sources import csv_files
from shopgrain.sources.csv_files import csv_parts, csv_scan, detect_separator, inside_after
from shopgrain.sources.tables import TableStore
from shopgrain.streaming.sync import WAITING, incremental_sync, table_schema

NOW = datetime(2024, 6, 1, 12)


def put(base, path, text):
    p = base / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def raw(spark, cols, data):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data, 1)], [*cols, "_line"])
    return df.withColumn("_file", F.lit("f"))


def test_normalize_vendas_defaults_and_rejects(spark):
    df = raw(spark, ["id", "data", "cliente", "vendedor", "total", "desconto", "status", "canal"], [
        ("1", "2024-01-02", "c", "", "R$ 1.000,50", "", "", ""), ("", "2024-01-02", "c", "v", "1", "1", "x", "y"),
        ("3", "99/99/2024", "c", "v", "1", "1", "x", "y"), ("4", "02/01/2024", "", "v", "abc", "1,5", "cancelada", "web"),
        ("5", "2024-01-02", "", "", "99999999999", "", "", ""),
    ])
    good, bad = normalize.normalize_vendas(df, "a")
    got = {r.venda_key: r for r in good.collect()}
    assert set(got) == {"1", "4"}
    one, four = got["1"], got["4"]
    assert (float(one.total), one.status, one.canal, one.vendedor_id) == (1000.5, "concluida", "balcao", None)
    assert (float(four.total), float(four.desconto), four.status, four.cliente_key) == (0.0, 1.5, "cancelada", None)
    assert four.data_venda == datetime(2024, 1, 2)
    reasons = {r._line: (r._reason, r._raw["id"]) for r in bad.collect()}
    assert reasons == {
        2: ("linha 2: ID da venda não encontrado", ""), 3: ("linha 3: data inválida '99/99/2024'", "3"),
        5: ("linha 5: valor fora do limite", "5"),
    }


def test_normalize_itens_fills_total(spark):
    df = raw(spark, ["venda_id", "sku", "qtd", "preco", "desconto", "total", "un"], [
        ("1", "p", "2", "10,50", "1", "", ""), ("1", "p", "2", "10", "1", "7", "KG"), ("1", "", "1", "1", "0", "1", ""),
        ("", "p", "1", "1", "0", "1", ""), ("1", "p", "0", "5", "0", "", ""),
    ])
    good, bad = normalize.normalize_itens(df, "a")
    assert sorted((float(r.quantidade), float(r.total), r.unidade) for r in good.collect()) == [
        (0.0, 0.0, "UN"), (2.0, 7.0, "KG"), (2.0, 20.0, "UN"),
    ]
    assert sorted(r._reason for r in bad.collect()) == [
        "linha 3: ID do produto não encontrado", "linha 4: ID da venda não encontrado",
    ]


def test_normalize_produtos_and_clientes_drop_rows_without_key(spark):
    p = normalize.normalize_produtos(raw(spark, ["codigo", "nome", "custo", "ativo"], [
        ("p1", "", "1,25", "SIM"), ("", "x", "1", "sim"), ("p2", "Dois", "", "0"),
    ]), "a")[0]
    assert sorted((r.produto_key, r.nome, float(r.preco_custo), r.ativo, r.unidade) for r in p.collect()) == [
        ("p1", "p1", 1.25, True, "UN"), ("p2", "Dois", 0.0, False, "UN"),
    ]
    c = normalize.normalize_clientes(raw(spark, ["id", "name", "cpf", "status"], [
        ("c1", "", "111", "ativo"), ("", "x", "", ""),
    ]), "a")
    r = c.first()
    assert c.count() == 1 and (r.nome, r.documento, r.ativo, r.telefone) == ("c1", "111", True, None)


def sales_frame(spark, data):
    df = spark.createDataFrame(data, "client_key string, venda_key string, cliente_key string, total int, _line int")
    return df


def test_upsert_vendas_last_row_wins_and_unknown_customer_is_null(spark):
    old = sales_frame(spark, [("a", "1", "c1", 1, 0), ("a", "2", "c1", 2, 0), ("b", "1", "c1", 3, 0)]).drop("_line")
    new = sales_frame(spark, [("a", "1", "zz", 10, 2), ("a", "1", "c1", 20, 1), ("a", "9", "c1", 5, 3)])
    people = spark.createDataFrame([("a", "c1"), ("b", "zz")], "client_key string, cliente_key string")
    once = load.upsert_vendas(old, new, people)
    want = [("a", "1", None, 10), ("a", "2", "c1", 2), ("a", "9", "c1", 5), ("b", "1", "c1", 3)]
    pick = lambda df: sorted((r.client_key, r.venda_key, r.cliente_key, r.total) for r in df.collect())
    assert pick(once) == want
    assert pick(load.upsert_vendas(once, new, people)) == want


def test_upsert_clientes_keeps_first_papers(spark):
    cols = "client_key string, cliente_key string, nome string, tipo string, documento string, telefone string, " \
           "cidade string, bairro string, cep string, ativo boolean, atributos string"
    old = spark.createDataFrame([("a", "1", "Ana", "t", None, "9", "x", "y", "z", True, "{}")], cols).withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    new = spark.createDataFrame([
        ("a", "1", "Ana B", "u", "doc", "8", None, "yy", "zz", False, "{}", 1),
        ("a", "2", "Leo", "t", "first", None, None, None, None, True, "{}", 1),
        ("a", "2", "Leo B", "t", "second", "5", None, None, None, True, "{}", 2),
    ], cols + ", _line int")
    got = {r.cliente_key: r for r in load.upsert_clientes(old, new, NOW).collect()}
    a, b = got["1"], got["2"]
    assert (a.nome, a.documento, a.telefone, a.cidade, a.cep, a.ativo, a.updated_at) == (
        "Ana B", None, "9", None, "z", False, NOW)
    assert (b.nome, b.documento, b.telefone) == ("Leo B", "first", None)


def test_load_itens_drops_orphans_and_replaces_by_sale(spark):
    schema = "client_key string, venda_key string, produto_key string"
    old = spark.createDataFrame([("a", "1", "p1"), ("a", "2", "p1")], schema)
    new = spark.createDataFrame([("a", "1", "p2"), ("a", "1", "p2"), ("a", "99", "p1")], schema)
    sales = spark.createDataFrame([("a", "1"), ("a", "2")], "client_key string, venda_key string")
    got = sorted((r.venda_key, r.produto_key) for r in load.load_itens(old, new, sales).collect())
    assert got == [("1", "p2"), ("1", "p2"), ("2", "p1")]


def test_run_log_has_success_and_error_rows(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "client_key string")
    errors = spark.createDataFrame([("c", "quebrado")], "client_key string, error_message string")
    out = load.etl_run_log(keys("a", "a", "b"), keys("a"), NOW, NOW, errors=errors)
    got = sorted((r.client_key, r.status, r.records_read, r.records_written, r.error_message) for r in out.collect())
    assert got == [("a", "success", 2, 1, None), ("b", "success", 1, 0, None), ("c", "error", 0, 0, "quebrado")]


def test_store_results_survive_empty_writes_and_text_keys(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    assert store.load_result("nada").count() == 0
    df = spark.createDataFrame([("001", 1), ("002", 2)], "client_key string, v int")
    store.save_result("r", df)
    store.save_result("r", df.filter("v = 9"))
    store.save_result("r", spark.createDataFrame([("002", 5)], "client_key string, v int"))
    got = sorted((r.client_key, r.v) for r in store.load_result("r").collect())
    assert got == [("001", 1), ("002", 5)]
    assert store.erase_tenant("002") == ["r"]
    assert [r.client_key for r in store.load_result("r").collect()] == ["001"]


def test_publish_cache_takes_the_top(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", i) for i in range(9)], "client_key string, lift int")
    store.publish_cache("basket", df, 3, F.desc("lift"))
    assert sorted(r.lift for r in store.read("basket").collect()) == [6, 7, 8]


def test_insights_publication_and_history(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    cols = "client_key string, tipo string, prioridade int, titulo string, mensagem string, acao string, href string, " \
           "categoria string, icone string, top3 boolean"
    line = lambda tipo, cat, top, shop="a": (shop, tipo, 1, "t", "m", "a", "h", cat, "i", top)
    home = spark.createDataFrame([line("x", "estoque", True), line("perf", "vendas", False)], cols)
    page = spark.createDataFrame([line("v1", "vendas", True), line("v9", "vendas", False)], cols)
    publicar_insights(store, home, page, NOW)
    assert sorted(r.tipo for r in store.read(CACHE).collect()) == ["v1", "x"]
    publicar_insights(store, home.filter("tipo = 'perf'"), page.limit(0), datetime(2024, 6, 2))
    assert sorted(r.tipo for r in store.read(CACHE).collect()) == ["perf"]
    assert store.read(HISTORY).count() == 5


@pytest.fixture
def inbox(tmp_path):
    put(tmp_path, "inbox/a/clientes/c.csv", "id,nome,ativo\nc1,Ana,sim\n")
    put(tmp_path, "inbox/a/produtos/p.tsv", "id\tnome\tpreco\tativo\np1\tUm\t2,5\tS\n")
    put(tmp_path, "inbox/a/vendas/v1.csv", "ID;Data;Cliente;Total\n1;03/04/2024;c1;10\n2;x;c1;1\n3;2024-01-05;c9;7\n")
    put(tmp_path, "inbox/b/vendas/v1.csv", "numero,date,vl_total\n1,2024-05-06,\"1,5\"\n")
    put(tmp_path, "inbox/a/itens_venda/i.csv", "venda_id,produto_key,quantidade,preco\n1,p1,2,5\n99,p1,1,1\n")
    return tmp_path


def test_stream_equals_batch_and_is_idempotent(spark, inbox):
    def pull(store, checkpoint):
        incremental_sync(
            spark, str(inbox / "inbox"), store, str(inbox / checkpoint), clock=lambda: NOW
        ).awaitTermination()

    store = TableStore(spark, str(inbox / "tables"))
    pull(store, "cp")
    pick = lambda: sorted(
        (r.client_key, r.venda_key, r.cliente_key, float(r.total)) for r in store.read("vendas").collect()
    )
    scanned = csv_scan(spark, str(inbox / "inbox/a/vendas/v1.csv"))
    batch = load.upsert_vendas(
        spark.createDataFrame([], table_schema("vendas")).drop("mes"),
        normalize.normalize_vendas(scanned, "a")[0],
        spark.createDataFrame([("a", "c1")], "client_key string, cliente_key string"),
    )
    of_a = sorted((r.client_key, r.venda_key, r.cliente_key, float(r.total)) for r in batch.collect())
    first = pick()
    assert first == of_a + [("b", "1", None, 1.5)]
    assert [(r.venda_key, float(r.total)) for r in store.read("itens_venda").collect()] == [("1", 10.0)]
    assert sorted(r._reason for r in store.read("rejeitos").collect()) == [
        "linha 2: data inválida 'x'", "linha 2: venda desconhecida",
    ]
    logs = {(r.client_key, r.lote.split("-")[0]): (r.records_read, r.records_written) for r in store.read("etl_logs").collect()}
    assert logs[("a", "vendas")] == (3, 2) and logs[("a", "itens_venda")] == (2, 1)
    pull(store, "cp")          # nothing new
    pull(store, "other")       # everything again
    assert pick() == first
    # A sale that moves to another month leaves no trace in the old one.
    put(inbox, "inbox/a/vendas/v2.csv", "id,data,total\n3,2024-09-01,8\n")
    pull(store, "cp")
    assert ("a", "3", None, 8.0) in pick() and len(pick()) == len(first)
    store.erase_tenant("a")
    assert pick() == [("b", "1", None, 1.5)]


SALES = "id,data,total\n1,2024-01-05,10\n2,2024-02-05,20\n3,2024-02-06,30\n"
ITEMS = ["venda_id,produto_key,quantidade,preco\n1,p1,2,5\n2,p2,1,20\n9,p9,1,1\n", "venda_id,produto_key,quantidade,preco\n2,p3,4,5\n3,p1,3,10\n"]


@pytest.mark.parametrize("order", ["0v1", "0 1v", "0 v 1"])
def test_order_of_sales_and_items_does_not_matter(spark, tmp_path, order):
    """Each word is a batch of files: the sales, the items, later items of one of the sales."""
    store, now = TableStore(spark, str(tmp_path / "tables")), [NOW]
    for n, names in enumerate(order.split()):
        for name in names:
            put(tmp_path, f"inbox/a/{'vendas' if name == 'v' else 'itens_venda'}/f{n}{name}.csv", SALES if name == "v" else ITEMS[int(name)])
        incremental_sync(spark, str(tmp_path / "inbox"), store, str(tmp_path / "cp"), clock=lambda: now[0]).awaitTermination()
    got = sorted((r.venda_key, r.produto_key, str(r.mes)) for r in store.read("itens_venda").collect())
    together = any("0" in w and "1" in w for w in order.split())
    second = [("2", "p2", "2024-02-01")] * together + [("2", "p3", "2024-02-01")]
    assert got == [("1", "p1", "2024-01-01"), *second, ("3", "p1", "2024-02-01")]
    waits = lambda: [(r.venda_key, r.produto_key) for r in store.read(WAITING).collect()]
    assert waits() == [("9", "p9")]
    if order == "0 v 1":
        # The wait of an item whose sale never comes ends at last; a sale that comes later has none.
        now[0] = NOW + timedelta(days=31)
        put(tmp_path, "inbox/a/clientes/c.csv", "id,nome,ativo\nc1,Ana,sim\n")
        incremental_sync(spark, str(tmp_path / "inbox"), store, str(tmp_path / "cp"), clock=lambda: now[0]).awaitTermination()
        assert waits() == []


def test_a_stray_quote_costs_its_own_line_only(spark, tmp_path):
    put(tmp_path, "q.csv", 'a;b;c\n1;a"b;"c\n2;x;5\n3;y"z";6\n4;z;7\n')
    assert sorted(r.a for r in csv_scan(spark, str(tmp_path / "q.csv")).collect()) == ["1", "2", "3", "4"]


def test_every_file_keeps_its_own_header(spark, tmp_path):
    put(tmp_path, "in/1.csv", "id;nome\nx;y\n")
    put(tmp_path, "in/2.csv", "nome;id\ny2;x2\n")
    put(tmp_path, "in/3.csv", "\nID,Outro\n7,8\nshort\n9,10\n")
    put(tmp_path, "in/4.csv", "")
    good, bad = csv_parts(spark, str(tmp_path / "in"))
    got = sorted((r.id, r.nome, r.outro, r._line) for r in good.collect())
    assert got == [("7", "", "8", 1), ("9", "", "10", 2), ("x", "y", "", 1), ("x2", "y2", "", 1)]
    assert [r._text for r in bad.collect()] == ["short"]
    assert detect_separator(spark, str(tmp_path / "in/1.csv")) == ";"


def test_wide_headers_that_differ_late_are_told_apart(spark, tmp_path):
    wide = ",".join(f"{'coluna_bem_comprida_' * 150}{i:03d}" for i in range(25))
    assert len(wide) > 64 * 1024
    put(tmp_path, "in/1.csv", f"{wide},fim\n" + "1," * 25 + "2\n")
    put(tmp_path, "in/2.csv", f"{wide},outro\n" + "1," * 25 + "3\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    try:
        rows = csv_scan(spark, str(tmp_path / "in")).select("fim", "outro").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.fim, r.outro) for r in rows) == [("", "3"), ("2", "")]


def test_a_broken_file_waits_and_the_others_are_loaded(spark, tmp_path):
    import gzip

    rows = "".join(f"{i};2024-01-{1 + i % 28:02d};{i}\n" for i in range(1, 101))
    put(tmp_path, "inbox/a/vendas/v.csv", "id;data;total\n" + rows)
    put(tmp_path, "inbox/b/vendas/v0.csv", "id;data;total\n900;2024-02-01;5\n")
    broken = tmp_path / "inbox/b/vendas/v1.csv.gz"
    whole = gzip.compress(("id;data;total\n" + rows * 50).encode())
    broken.write_bytes(whole[: len(whole) // 2])
    (tmp_path / "inbox/c/vendas").mkdir(parents=True)
    (tmp_path / "inbox/c/vendas/v.csv.gz").write_bytes(b"no archive")
    store = TableStore(spark, str(tmp_path / "tables"))

    def pull():
        incremental_sync(spark, str(tmp_path / "inbox"), store, str(tmp_path / "cp"), clock=lambda: NOW).awaitTermination()
        return sorted((r.client_key, r.n) for r in store.read("vendas").groupBy("client_key").agg(F.count("*").alias("n")).collect())

    assert pull() == [("a", 100), ("b", 1)]
    log = {r.client_key: (r.status, r.records_written) for r in store.read("etl_logs").collect()}
    assert log == {"a": ("success", 100), "b": ("partial", 1), "c": ("error", 0)}
    assert pull() == [("a", 100), ("b", 1)]
    broken.write_bytes(whole)
    assert pull() == [("a", 100), ("b", 101)]
    waiting = store.read("arquivos_pendentes").groupBy("path").agg(F.max_by("waits", "lote").alias("w")).filter("w").collect()
    assert [r.path.split("/")[-3] for r in waiting] == ["c"]


def test_quoted_line_ends_of_all_shops(spark, tmp_path):
    """A record over two lines is one record."""
    for shop in ("a", "b"):
        put(tmp_path, f"inbox/{shop}/clientes/c.csv", 'id,nome,email\nc1,"Ana\nMaria",a@b.co\nc2,Rui,\n')
        put(tmp_path, f"inbox/{shop}/vendas/v.csv", 'id,vendedor,data,total\n1,"Jo\nao",2024-01-02,5\n2,Rui,2024-01-03,7\n')
    store = TableStore(spark, str(tmp_path / "tables"))
    incremental_sync(spark, str(tmp_path / "inbox"), store, str(tmp_path / "cp"), clock=lambda: NOW).awaitTermination()
    assert {(r.client_key, r.venda_key) for r in store.read("vendas").collect()} == {(s, v) for s in "ab" for v in "12"}
    names = {(r.client_key, r.cliente_key, r.nome) for r in store.read("clientes").collect()}
    assert names == {(s, c, n) for s in "ab" for c, n in (("c1", "Ana\nMaria"), ("c2", "Rui"))}


@pytest.mark.parametrize("line, sep, outside, inside", [
    ("a;b", ";", False, True), ('"a";"b"', ";", False, False), ('"a', ";", True, True), ('a"', ";", False, False), ('a"b;c', ";", False, True),
    ('"a""', ";", True, True), ('x";"y', ";", True, True), ('"a""";b', ";", False, False), ('"a"b";c', ";", False, False),
    ('  "a', ";", True, True), ('"a"  ;b', ";", False, False), ('""', ";", False, True), ('"', ";", True, False), ("", ",", False, True),
    ('\t"a', "\t", True, True), ('a,"b,c', ",", True, True), ('a,"b",""', ",", False, False), ('"a" b', ",", True, True),
])
def test_states_at_line_ends(line, sep, outside, inside):
    assert (inside_after(line, sep, False), inside_after(line, sep, True)) == (outside, inside)


@pytest.mark.parametrize("block", ["128m", "100"])
def test_quoted_line_ends_on_block_borders(spark, tmp_path, block):
    """Records of several lines, blank lines in them, doubled quotes and long texts, in blocks of few bytes."""
    records = []
    for i in range(24):
        text = ["plain", "two\nlines", 'a ""b"" c\n\nlast', "x;y\n;z\n" * (i % 7) + "end", "", 'word"inside'][i % 6]
        records.append((str(i), text))
    body = "".join(f'{k};{t};z\n' if t in ("plain", "", 'word"inside') else f'{k};"{t}";z\n' for k, t in records)
    put(tmp_path, "in/1.csv", "k;t;u\n" + body)
    put(tmp_path, "in/2.csv", "k;t;u\r\n" + body.replace("\n", "\r\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows, bad = csv_parts(spark, str(tmp_path / "in"))
        got = sorted((r._file[-5], r._line, r.k, r.t) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(k, t.replace('""', '"').strip()) for k, t in records]
    assert got == [(f, n, k, t) for f in "12" for n, (k, t) in enumerate(want, 1)]
    assert bad.count() == 0


def test_a_quote_that_never_closes_costs_a_logged_stretch(spark, tmp_path, monkeypatch):
    lines = [f"{i};n{i};x" for i in range(50)]
    lines[10] = '10;"open;x'
    put(tmp_path, "1.csv", "a;b;c\n" + "\n".join(lines) + "\n")
    lines[20] = '20;"two\nlines";x'
    put(tmp_path, "2.csv", "a;b;c\n" + "\n".join(lines) + "\n")
    monkeypatch.setattr(csv_files, "MAX_LINES", 8)
    rows, bad = csv_parts(spark, str(tmp_path / "1.csv"))
    assert {r.a for r in rows.collect()} == {str(i) for i in range(50)} - {"10"} | {r.a for r in rows.collect() if r.a == "10"}
    assert rows.count() + bad.count() == 50
    rows, bad = csv_parts(spark, str(tmp_path / "2.csv"))
    kept = {r.a for r in rows.collect()}
    assert kept >= {str(i) for i in range(50)} - {"10", "20"}
    assert rows.count() + bad.count() == 51


def test_an_empty_first_result_can_be_read_back(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("001", 1)], "client_key string, v int")
    store.save_result("r", df.limit(0))
    assert store.load_result("r").schema == df.schema and store.load_result("r").count() == 0
    store.save_result("r", df)
    assert [tuple(r) for r in store.load_result("r").select("client_key", "v").collect()] == [("001", 1)]
    assert store.names() == ["r"]


def test_partitions_are_a_few_files_each(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"))
    store.save_result("r", spark.range(2000, numPartitions=8).selectExpr("cast(id % 50 as string) AS client_key", "id AS v"))
    assert len(list((tmp_path / "t/r").rglob("*.parquet"))) <= 2 * 50
    assert store.load_result("r").count() == 2000


def test_intermediate_results_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from shopgrain.sources import shared

    context = SimpleNamespace(master="yarn", applicationId="x", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


def test_erasing_a_shop_leaves_no_copy(spark, tmp_path):
    from datetime import timedelta

    from shopgrain.sources import files, shared

    store = TableStore(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "client_key string, v int")
    store.save_result("r", df)
    store.save_result("r", df)
    shared.materialize(df)
    # A write that never counted.
    df.write.partitionBy("client_key").parquet(str(tmp_path / "t/r/rows/versao=vlost"))
    store.erase_tenant("a")
    assert files.exists(spark, shared.scratch_dir(spark)) and not list((tmp_path / "t").rglob("client_key=a"))
    assert [r.client_key for r in store.load_result("r").collect()] == ["b"]
    store.erase_tenant("a", idle=timedelta(0))
    assert not files.exists(spark, shared.scratch_dir(spark))
