from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shopgrain.functions import parsing
from shopgrain.functions.numbers import fmt_brl, rint
from shopgrain.functions.privacy import mascarar_pii
from shopgrain.sources.csv_files import csv_scan, detect_separator, scan_shapes


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_decimal_br(spark):
    texts = ["R$ 1.250,00", "1250,5", "1,250.00", "1250.75", "", "abc", " -3,5 ", "1.5d", "NaN", "2e3"]
    assert values(spark, texts, parsing.parse_decimal_br) == [
        1250.0, 1250.5, 1.25, 1250.75, 0.0, 0.0, -3.5, 0.0, 0.0, 2000.0,
    ]


def test_date_layouts_day_first(spark):
    texts = [
        "2024-01-15 09:30:00", "2024-01-15T09:30:00", "2024-01-15T09:30:00Z", "2024-01-15",
        "03/04/2024 08:00:00", "03/04/2024", "03-04-2024", "12/25/2024", "13/25/2024", "", "ontem",
        "2024-01-15 09:30", "2024-02-30", "3/4/2024", "2024-01-15 09:30:00Z",
    ]
    d = datetime
    assert values(spark, texts, parsing.parse_date_multi) == [
        d(2024, 1, 15, 9, 30), d(2024, 1, 15, 9, 30), d(2024, 1, 15, 9, 30), d(2024, 1, 15),
        d(2024, 4, 3, 8), d(2024, 4, 3), d(2024, 4, 3), d(2024, 12, 25), None, None, None,
        None, None, None, None,
    ]


def test_bool(spark):
    texts = ["true", "1", "SIM", " s ", "Ativo", "a", "nao", "", "0", "inativo"]
    assert values(spark, texts, parsing.parse_bool_br) == [True] * 6 + [False] * 4


def test_first_non_empty_follows_alias_order(spark):
    df = spark.createDataFrame([("", "b", "c"), ("a", "b", "c"), (" ", None, "c")], "x string, y string, z string")
    pick = parsing.first_non_empty(df.columns, ("missing", "x", "y", "z"))
    assert [r[0] for r in df.select(pick).collect()] == ["b", "a", "c"]
    assert df.select(parsing.first_non_empty(df.columns, ("nope",))).first()[0] == ""


def test_money_text_and_rounding(spark):
    df = spark.createDataFrame([(1234.56, 2.5), (0.0, 3.5), (1e6, 0.125)], "a double, b double")
    assert [r[0] for r in df.select(fmt_brl(F.col("a"))).collect()] == [
        "R$ 1.234,56", "R$ 0,00", "R$ 1.000.000,00",
    ]
    assert [r[0] for r in df.select(rint(F.col("b"), 0)).collect()] == [2.0, 4.0, 0.0]
    assert df.select(rint(F.lit(0.125), 2)).first()[0] == 0.12


def test_pii_of_each_kind_in_one_text(spark):
    text = "CPF 123.456.789-09, CNPJ 12.345.678/0001-95, fone (11) 98765-4321 ou 1134567890, a.b+c@x-y.com.br fim"
    df = spark.createDataFrame([(1, text, text)], "n int, t string, keep string")
    row = mascarar_pii(df, ["t", "n"]).first()
    assert row.t == "CPF [CPF], CNPJ [CNPJ], fone [TELEFONE] ou [TELEFONE], [EMAIL] fim"
    assert (row.n, row.keep) == (1, text)
    assert mascarar_pii(df).first().keep == row.t


@pytest.mark.parametrize("name,text,sep", [
    ("a.csv", "a;b;c\n1;2;3\n", ";"), ("a.csv", "a,b\n", ","), ("a.csv", "a\tb\tc\n", "\t"),
    ("a.tsv", "a,b,c\n", "\t"), ("a.csv", "a;b,c\n", ","), ("a.csv", "abc\n", ","),
])
def test_separator(spark, tmp_path, name, text, sep):
    (tmp_path / name).write_text(text)
    assert detect_separator(spark, str(tmp_path / name)) == sep


def test_separator_reads_only_the_start(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "z" * 600 + ";" * 50)
    assert detect_separator(spark, str(tmp_path / "x.csv")) == ","


def test_scan_skips_rows_of_other_width(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text(' ID ;Nome;VALOR\n1; Ana ;"1;5"\n2;curta\n3;a;b;c\n\n4;5" tubo;"x ""y"""\n')
    df = csv_scan(spark, str(p))
    assert df.columns == ["id", "nome", "valor", "_file", "_line"]
    got = sorted((r._line, r.id, r.nome, r.valor) for r in df.collect())
    assert got == [(1, "1", "Ana", "1;5"), (2, "4", '5" tubo', 'x "y"')]
    assert df.count() == 2


def test_scan_keeps_a_value_over_two_lines(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text('a,b\n1,"x\ny"\n2,z\n')
    got = sorted((r._line, r.a, r.b) for r in csv_scan(spark, str(p)).collect())
    assert got == [(1, "1", "x\ny"), (2, "2", "z")]


def test_line_numbers_run_on_over_blocks(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text("k,v\n" + "".join(f"{i},x\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        df = csv_scan(spark, str(p))
        assert df.rdd.getNumPartitions() > 1
        assert df.filter(F.col("_line") != F.col("k").cast("int")).count() == 0
        assert df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_group_by_header_and_separator(spark, tmp_path):
    for name, text in (("a.csv", "id,n\n1,2\n"), ("b.csv", "id;n\n1;2\n"), ("c.csv", "id,n\n3,4\n"), ("d.csv", "")):
        (tmp_path / name).write_text(text)
    groups = scan_shapes(spark, [str(tmp_path / f"{c}.csv") for c in "abcd"])
    assert sorted((g.sep, len(g.paths)) for g in groups) == [(",", 2), (";", 1)]
