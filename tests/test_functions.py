"""Column expressions against tables of (input, expected), one Spark job per table."""

import datetime as dt
import random
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from razao.fixed_values import WHITESPACE_CHARS
from razao.functions import dates, identity, money, text


def evaluate(spark, inputs, expr, schema="value string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in df.select("i", expr.alias("out")).orderBy("i").select("out").collect()]


def check(spark, table, expr):
    got = evaluate(spark, [k for k, _ in table], expr)
    assert got == [v for _, v in table]


AMOUNTS = [
    ("123,45", "123.45"), ("123.45", "123.45"), ("1.234,56", "1234.56"), ("1,234.56", "1234.56"),
    ("1.234", "1234"), ("1,234", "1234"), ("1.000.000,00", "1000000"),
    ("1,000,000.00", "1000000"), ("-1.000.000,00", "-1000000"), ("(123,45)", "-123.45"),
    ("-123,45", "-123.45"), ("R$ 1.234,56", "1234.56"), ("1 234,56", "1234.56"),
    ("1 234,56", "1234.56"), ("0,01", "0.01"), ("0.01", "0.01"), ("999.999,99", "999999.99"),
    ("10-20", "-1020"), (",50", "0.50"), ("1.2.3", "123"), ("12.345", "12345"),
    ("1.234,", "1234"), ("-0,5", "-0.5"), ("0", "0"), ("1e3", "13"),
    ("", None), ("  ", None), ("abc", None), ("123,", None), ("123.", None), ("NaN", None),
    ("Infinity", None), ("1.234,56,78", None), (".", None), (None, None), (",.", None),
]


def test_parse_amount(spark):
    got = evaluate(spark, [k for k, _ in AMOUNTS], money.parse_amount(F.col("value")))
    assert got == [None if v is None else Decimal(v) for _, v in AMOUNTS]


def test_amount_errors(spark):
    raw = F.col("value")
    digits = money.amount_digits(raw)
    table = [
        ("", "amount_empty"), (None, "amount_empty"), (" ", "amount_empty"),
        ("abc", "amount_without_digits"), ("123,", "amount_invalid"),
        ("1.234,56,78", "amount_invalid"), ("0", "amount_zero"), ("0,00", "amount_zero"),
        ("-0,00", "amount_zero"), ("1,00", None),
    ]
    check(spark, table, money.amount_error(raw, digits, money.amount_value(digits)))


@pytest.mark.parametrize(
    "separator, table",
    [(",", [("1.234", 1234), ("1.234,5", Decimal("1234.5")), ("0,125", Decimal("0.125"))]),
     (".", [("1,234", 1234), ("1.234", Decimal("1.234")), ("1,234.5", Decimal("1234.5"))])],
)
def test_fixed_decimal_separator(spark, separator, table):
    check(spark, table, money.parse_amount(F.col("value"), separator))


def test_sign_gives_direction(spark):
    value = money.parse_amount(F.col("value"))
    check(spark, [("123,45", "in"), ("-123,45", "out"), ("0", None)], money.signed_direction(value))
    check(spark, [("123,45", "out"), ("-123,45", "in")], money.signed_direction(value, False))


def test_given_direction_must_fit(spark):
    inputs = [("-123,45", "out"), ("-123,45", "in"), ("5", "in"), ("5", "out"), ("5", "up")]
    expr = money.direction_error(money.parse_amount(F.col("v")), F.col("d"))
    got = evaluate(spark, inputs, expr, "v string, d string")
    assert got == [None, "amount_sign_conflict", None, None, "direction_invalid"]


def test_units_are_exact(spark):
    table = [
        ("0,01", 1), ("9.999,99", 999999), ("1.000.000,00", 100000000), ("0,10", 10),
        ("19,99", 1999), ("1,11", 111), ("2,22", 222), ("1.000.000.000,00", 100000000000),
        ("-5,00", 500), ("0,.004", None), ("0", None), ("99999999999999999999", None),
    ]
    check(spark, table, money.to_units(money.parse_amount(F.col("value"))))
    total = spark.range(1000).select(
        F.sum(money.to_units(money.parse_amount(F.lit("0,10")))).alias("t")
    )
    assert total.first().t == 10000


def test_money_rendering(spark):
    units = F.col("value").cast("bigint")
    check(spark, [("1050", "10.50"), ("5", "0.05"), ("-123456", "-1234.56")], money.to_display(units))
    check(
        spark,
        [("1050", "R$ 10,50"), ("123456789", "R$ 1.234.567,89"), ("-5", "-R$ 0,05")],
        money.format_money(units, F.lit("BRL")),
    )
    check(spark, [("-123456", "R$ 1.234,56")], money.format_view_amount(money.to_decimal(units)))


def day(text_):
    return None if text_ is None else dt.date.fromisoformat(text_)


@pytest.mark.parametrize(
    "fmt, table",
    [
        ("dd/MM/yyyy", [
            ("15/03/2024", "2024-03-15"), (" 15/03/2024 ", "2024-03-15"),
            ("29/02/2024", "2024-02-29"), ("31/12/2024", "2024-12-31"),
            ("015/03/2024", "2024-03-15"), ("15-03/2024", "2024-03-15"),
            ("15/03/24", None), ("31/02/2024", None), ("30/02/2024", None),
            ("29/02/2023", None), ("2024-03-15", None), ("", None), ("123/03/2024", None),
            ("00/03/2024", None), ("15/3/2024", None), (None, None)]),
        ("MM/dd/yyyy", [("03/15/2024", "2024-03-15"), ("13/40/2024", None)]),
        ("yyyy-MM-dd", [("2024-03-15", "2024-03-15"), ("0050-01-01", None), ("2024-13-01", None)]),
        (None, [
            ("2024-03-15", "2024-03-15"), ("2024-03-15T10:30:00.000Z", "2024-03-15"),
            ("2024-03-15T23:30:00-03:00", "2024-03-16"), ("15/03/2024", None),
            ("2024-02-30", None), ("0050-01-01", None), ("2024-03-15Tfoo", None)]),
    ],
)
def test_parse_date(spark, fmt, table):
    check(spark, [(k, day(v)) for k, v in table], dates.parse_date(F.col("value"), fmt))


def test_day_millis(spark):
    millis = F.col("value").cast("bigint")
    check(spark, [("1710460800000", day("2024-03-15")), ("1710547199999", day("2024-03-15")),
                  ("-1", day("1969-12-31"))], dates.day_of_millis(millis))
    check(spark, [("2024-03-15", 1710460800000)], dates.day_millis(F.col("value").cast("date")))
    check(spark, [("2024-03-15", "15/03/2024")], dates.display_date(F.col("value").cast("date")))
    with pytest.raises(ValueError):
        dates.parse_date(F.col("value"), "d.M.yy")


def test_identity_text(spark):
    table = [
        ("  João   Silva  ", "joao silva"), ("☕ Cafezinho", "☕ cafezinho"),
        ("Pix-123!", "pix-123!"), ("a \tb", "a b"), ("ÀÉÎÕÜ Ç", "aeiou c"),
        ("é", "e"), ("Ελλάδα", "ελλαδα"), ("й", "и"), ("", ""),
    ]
    check(spark, table, text.identity_text(F.col("value")))
    check(spark, table, text.identity_text(F.col("value"), exact=True))


def test_accents_agree_with_full_decomposition(spark):
    rng = random.Random(7)
    letters = [chr(c) for c in range(0x20, 0x530)] + list("日本ЙйЁё")
    words = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(300)]
    want = ["".join(c for c in unicodedata.normalize("NFD", w) if not "̀" <= c <= "ͯ")
            for w in words]
    assert evaluate(spark, words, text.strip_accents(F.col("value"))) == want


def test_cluster_key(spark):
    table = [
        ("PADARIA ALFA 123", "padaria alfa"), ("Padaria Alfa 456", "padaria alfa"),
        ("PIX-987654 Mercado Central", "pix mercado central"),
        ("PADARIA ☕ CENTRAL", "padaria central"), ("7-ELEVEN 24H", "7 eleven 24h"),
        ('<script>alert("xss")</script>', "script alert xss script"),
        ("Transferência 高木ゆうこ → محمد علي", "transferencia"),
        ("☕ Cafezinho na padaria 🥐", "cafezinho na padaria"), ("a_123 b", "a 123 b"),
        ("ABC1234", "abc1234"), ("", ""), (None, None),
    ]
    check(spark, table, text.cluster_key(F.col("value")))


def test_counterparty_name(spark):
    table = [
        ("Pix enviado - Jose", "Jose"), ("PIX RECEBIDO - Maria Silva", "Maria Silva"),
        ("Pix - Joao", "Joao"), ("Pix enviado - João Silva", "João Silva"),
        ("Transferência recebida pelo Pix - CLIENTE FICTICIO A - •••.000.000-•• - BCO C6 S.A.",
         "CLIENTE FICTICIO A"),
        ("TRANSFERÊNCIA RECEBIDA - Cliente Ficticio B - •••.000.000-•• - NU PAGAMENTOS",
         "Cliente Ficticio B"),
        ("Transferência enviada pelo Pix - CLIENTE FICTICIO C (Transferência enviada)",
         "CLIENTE FICTICIO C"),
        ("Reembolso recebido pelo Pix - 99 TECNOLOGIA LTDA - 18.033.552/0001-61",
         "99 TECNOLOGIA LTDA"),
        ("Pagamento efetuado - Padaria Alfa", "Padaria Alfa"),
        ("Pix enviado - Ana-Maria   da Silva", "Ana-Maria da Silva"),
        ("Bruno H Rodrigues", "Bruno H Rodrigues"),
        ("Acai Do Alto           Salvador      Bra", "Acai Do Alto Salvador Bra"),
        ("Compra no débito PADARIA", "PADARIA"), ("Transferência enviada - 12345678", "12345678"),
        ("", None), ("   ", None), (None, None), ("Pix enviado", None),
    ]
    check(spark, table, text.counterparty_name(F.col("value")))


def test_counterparty_key(spark):
    table = [
        ("  João   Silva  ", "joao silva"), ("PIX recebido João Silva", "joao silva"),
        ("  PIX   enviado - João   Silva!!! ", "joao silva"), ("pix recebido", None),
        ("   ", None), (None, None), ("☕🥐🎉", None),
        ("<script>alert(1)</script>", "script alert 1 script"), ("Pixel Doces", "pixel doces"),
        ("pix pix recebido enviado", "enviado"), ("TED DOC Fulano", "fulano"),
        ("João Silva " * 200, " ".join(["joao silva"] * 200)),
    ]
    check(spark, table, text.counterparty_key(F.col("value")))


def test_own_transfer(spark):
    inputs = [
        ("Transferência entre contas", None), (None, "Conta própria"),
        ("Pix enviado para João", "João Silva"), ("", None), (None, None),
        ("Mesma  TITULARIDADE", "x"),
    ]
    got = evaluate(spark, inputs, text.own_transfer(F.col("d"), F.col("c")), "d string, c string")
    assert got == [True, True, None, None, None, True]


FINGERPRINTS = [
    ("1710460800000|10000|out|pix enviado|row-1", "fp_94e2d6be"),
    ("1710460800000|10000|out|pix enviado|row-0", "fp_95e2d851"),
    ("1711929600000|500|out|cafezinho|row-3", "fp_f66e3f41"),
    ("1704067200000|1|out|teste|row-0", "fp_6cf1f55f"),
    ("1717200000000|5000|in|salario|row-42", "fp_a76d3f93"),
    ("1710460800000|10000|out", "fp_d837da99"),
    ("1711929600000|500|out", "fp_845ce6ea"),
    ("x|☕ 🥐 高木", "fp_6767edce"),
]


def test_fnv_fingerprint(spark):
    check(spark, FINGERPRINTS, identity.fnv_fingerprint(F.col("value")))


def test_identity_strings(spark):
    d = F.lit("2024-03-15").cast("date")
    row = spark.range(1).select(
        identity.identity_string(d, F.lit(10000), F.lit("out"), F.lit("pix enviado"),
                                 F.lit("row-1")).alias("a"),
        identity.suspicion_string(d, F.lit(10000), F.lit("out")).alias("b"),
    ).first()
    assert row == ("1710460800000|10000|out|pix enviado|row-1", "1710460800000|10000|out")


def test_white_space_class_is_the_white_space_characters(spark):
    """All characters of the basic plane, alone and inside text."""
    chars = spark.range(1, 0x10000).filter("id NOT BETWEEN 55296 AND 57343").selectExpr("CAST(id AS int) AS code")
    one = F.decode(F.unhex(F.lpad(F.hex("code"), 4, "0")), "UTF-16BE")
    rows = chars.select("code", F.concat(F.lit("a"), one, F.lit("b")).alias("v")).select(
        "code", (text.collapse(F.col("v")) == "a b").alias("found"))
    assert {r.code for r in rows.filter("found").collect()} == {ord(c) for c in WHITESPACE_CHARS}


def test_numbers_leave_a_cluster_key(spark):
    rows = spark.createDataFrame([("a 123 b12 1234x 99 x999 7777 _123 \u260e",)], "v string")
    assert rows.select(text.cluster_key(F.col("v")).alias("k")).first().k == "a b12 1234x 99 x999 123"
