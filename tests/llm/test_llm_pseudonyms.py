import re
from datetime import date

import pytest

from shopgrain.llm import pseudonyms as op


def one(spark, values, key="k"):
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    rows = {r.doc_id: r for r in op.pseudonymised(df, key).collect()}
    return [rows[i].text for i in range(len(values))], [rows[i].n_pseudonyms for i in range(len(values))]


def luhn(s):
    d = [int(x) for x in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def with_check(body):
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_cards_stay_valid_and_linked(spark):
    a = with_check("478538059239113")
    spaced = " ".join(a[i : i + 4] for i in range(0, 16, 4))
    out, n = one(spark, [f"x {a}, y", f"{spaced}.", f"{a} {a}", a[:-1] + str((int(a[-1]) + 1) % 10), f"b{a}"])
    new = re.search(r"\d{16}", out[0])[0]
    assert luhn(new) and new != a and out[0] == f"x {new}, y"
    assert out[1] == " ".join(new[i : i + 4] for i in range(0, 16, 4)) + "." and out[2] == f"{new} {new}"
    assert n == [1, 1, 2, 0, 0] and out[4] == f"b{a}"


def test_numbers_of_a_kind_are_permuted(spark):
    """Every value has one pseudonym and no two share one."""
    groups = {
        "card": [with_check(f"4{i:012d}") for i in range(300)],
        "social": [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 40)],
        "address": [f"10.0.{i // 250}.{i % 250}" for i in range(300)],
        "date": [date.fromordinal(date(1999, 12, 1).toordinal() + i).isoformat() for i in range(400)],
        "phone": [f"+1 (2{i:02d}) 555-{i:04d}" for i in range(100)] + [f"+1 (1{i:02d}) 555-{i:04d}" for i in range(100)],
    }
    for kind, values in groups.items():
        out, n = one(spark, values)
        assert set(n) == {1}, kind
        assert len(set(out)) == len(set(values)), kind
        shape = lambda s: re.sub(r"\d+" if kind == "address" else r"\d", "9", s)
        assert {shape(x) for x in out} == {shape(x) for x in values}, kind
    out, _ = one(spark, groups["social"])
    assert all(0 < int(x[:3]) < 900 and x[:3] != "666" and x[4:6] != "00" and x[7:] != "0000" for x in out)


def test_dates_keep_their_notation(spark):
    out, n = one(spark, ["1999-02-28", "28.02.1999", "28/02/1999", "02/28/1999", "31.02.1999", "1999-13-01", "28.02.1702"])
    d = date.fromisoformat(out[0])
    assert out[1] == d.strftime("%d.%m.%Y") and out[2] == d.strftime("%d/%m/%Y")
    month, day, _ = map(int, out[3].split("/"))
    assert month <= 12 < day and n == [1, 1, 1, 1, 0, 0, 0] and out[4] == "31.02.1999"


def test_dates_of_time_stamps(spark):
    out, n = one(spark, ["2024-05-01", "2024-05-01T12:00:00Z", "+49 30 901820 2024-05-01T12:00", "2024-05-01Temp", "2024-05-01T1"])
    assert out[1] == f"{out[0]}T12:00:00Z" and out[0] != "2024-05-01" and out[2].endswith(f" {out[0]}T12:00")
    assert n == [1, 1, 2, 0, 0]


def test_bank_accounts(spark):
    out, n = one(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "DE88370400440532013000"])
    plain = out[0].replace(" ", "")
    assert plain == out[1] and out[2].startswith("GB") and "WEST" in out[2] and n == [1, 1, 1, 0]
    for x in (plain, out[2]):
        moved = x[4:] + x[:4]
        assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_bank_accounts_before_other_words(spark):
    def account(country, body):
        moved = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(moved) % 97:02d}{body}"

    accounts = ["ES9121000418450200051332", "AT611904300234573201", "DE89370400440532013000", "NO9386011117947",
                "DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332", account("XY", "12345678901234567890")]
    behind = ["12 May", "BIC ABCD", "2024", "2024 1999 ABCD", "A", "4111 1111 1111 1111", "17.05.2024"]
    alone = dict(zip(accounts, one(spark, accounts)[0], strict=True))
    extra = dict(zip(behind, one(spark, behind)[0], strict=True))
    assert all(k != v for k, v in alone.items())
    both = [(a, b) for a in accounts for b in behind]
    out, _ = one(spark, [f"{a} {b}" for a, b in both])
    assert out == [f"{alone[a]} {extra[b]}" for a, b in both]
    out, n = one(spark, ["AB12 4111 1111 1111 1111", "DE88370400440532013000 12 May"])
    assert out == [f"AB12 {extra['4111 1111 1111 1111']}", "DE88370400440532013000 12 May"] and n == [1, 0]


def test_mail_addresses(spark):
    values = [f"Ann.{i}-x@mail.example.com" for i in range(200)] + ["a@b.co", "ANN.7-X@mail.example.com"]
    out, n = one(spark, values)
    assert set(n) == {1} and len(set(out)) == len(values)
    assert all(re.fullmatch(r"[A-Z][a-z]{2}\.\d{1,3}-[a-z]@mail\.example\.com", x) for x in out[:200])
    assert out[7].lower() == out[-1].lower()  # letters are linked across cases


def test_other_key_other_pseudonyms(spark):
    a = with_check("478538059239113")
    assert one(spark, [a], "k")[0] != one(spark, [a], "other")[0]


def test_phone_formats(spark):
    out, n = one(spark, ["(743) 555-3824", "743-555-3824", "+1 743 555 3824", "+49 30 901820 12", "call 12345", "1.2.3"])
    digits = [re.sub(r"\D", "", x) for x in out]
    assert digits[0] == digits[1] == digits[2][1:] and digits[3].startswith("49")
    assert n == [1, 1, 1, 1, 0, 0]


def test_values_next_to_each_other(spark):
    """A phone does not take what stands behind it, and what is not valid hides nothing."""
    phones = ["+1 (826) 555-4081", "+49 30 901820", "(743) 555-3824"]
    others = ["190.137.223.204", "2024-05-17", "17.05.2024", "123-45-6789", with_check("478538059239113"),
              "4111 1111 1111 1111", "743-555-3825", "a@b.co"]
    alone = dict(zip(phones + others, one(spark, phones + others)[0], strict=True))
    assert all(k != v for k, v in alone.items())
    both = [(p, o) for p in phones for o in others]
    out, n = one(spark, [f"{p} {o}" for p, o in both])
    assert out == [f"{alone[p]} {alone[o]}" for p, o in both] and set(n) == {2}
    new = alone[phones[0]]
    out, n = one(spark, ["+1 (826) 555-4081 20 euros", "+49 30 901820 20 euros", "12 34 +1 (826) 555-4081.",
                         "+12345678901234567 190.137.223.204", "1234 4111 1111 1111 1111", "\n+1 (826) 555-4081\n"])
    assert out[0] == f"{new} 20 euros" and out[2] == f"12 34 {new}." and out[5] == f"\n{new}\n"
    assert out[3] == f"+12345678901234567 {alone['190.137.223.204']}"
    assert out[4] == f"1234 {alone['4111 1111 1111 1111']}" and n == [1] * 6
    out, n = one(spark, [f"{phones[0]} x ß😀 {others[0]}; " * 500])
    assert out == [f"{new} x ß😀 {alone[others[0]]}; " * 500] and n == [1000]


def test_awkward_rows(clashing, awkward_rows):
    out = op.pseudonymised(clashing, "k")
    assert out.columns == [*clashing.columns, "_n_pseudonyms"]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted([(r[0], r[1]) for r in awkward_rows], key=str)


def test_empty_table(no_docs):
    assert op.pseudonymised(no_docs, "k").count() == 0


@pytest.mark.parametrize("m,n", [(2, 3), (13, 7), (1, 11)])
def test_network_is_a_permutation(spark, m, n):
    from pyspark.sql import functions as F

    pairs = spark.range(m * n).select(F.floor(F.col("id") / n).alias("a"), (F.col("id") % n).alias("b"))
    big = lambda x: F.lit(x).cast("bigint")
    out = pairs.select(op.permuted("k", "t", F.col("a"), F.col("b"), big(m), big(n)).alias("p")).collect()
    assert {(r.p.a, r.p.b) for r in out} == {(a, b) for a in range(m) for b in range(n)}


def test_very_long_mail_like_texts(spark):
    rows = [("x a@" + "b." * 100_000 + "1",), ("x a@" + "bb." * 100_000 + "com y",), ("a@" * 100_000,), ("x a@" + "b" * 200_000 + ".com",)]
    got = op.pseudonymised(spark.createDataFrame(rows, "text string"), "k").collect()
    assert [r["n_pseudonyms"] for r in got] == [0, 1, 0, 0]
    assert [r["text"] == t for r, (t,) in zip(got, rows, strict=True)] == [True, False, True, True]


def test_local_parts_of_other_alphabets(spark):
    names = ["müller@example.org", "łukasz@x.pl", "иван@mail.ru", "李雷@ex.cn", "δοκιμή@x.gr"]
    got = [r["text"] for r in op.pseudonymised(spark.createDataFrame([(n,) for n in names], "text string"), "k").collect()]
    for old, new in zip(names, got, strict=True):
        a, b = old.split("@"), new.split("@")
        assert a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] != b[0]
        assert all(x != "�" and x.isalpha() for x in b[0])
    twice = [r["text"] for r in op.pseudonymised(spark.createDataFrame([(n,) for n in names], "text string"), "k").collect()]
    assert twice == got
