"""Scalar functions against plain Python."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bidflow.functions import keys, text, values
from bidflow.operators.rules import any_keyword


def one(spark, column, **cells):
    types = {str: "string", int: "bigint", datetime: "timestamp", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, code, external_id, raw_id",
    [
        ("ATI", "ati", "ext-1", 7),
        ("", "ati", "ext-1", 7),
        ("  ATI ", "ati", "", 7),
        ("ATI", "ati", None, 7),
        ("ATI", "ati", None, None),
        ("ATI", "ati", None, 0),
        (" \tATI", "ati", "x ", 1),
        ("\x1cATI", "ati", "x\x1f\n", 1),
        ("", "", "", None),
    ],
)
def test_title_is_the_python_expression(spark, name, code, external_id, raw_id):
    expected = f"{name or code}: заявка {external_id or raw_id or ''}".strip()
    schema = "name string, code string, external_id string, raw_id bigint"
    df = spark.createDataFrame([(name, code, external_id, raw_id)], schema)
    title = text.bid_title(F.col("name"), F.col("code"), F.col("external_id"), F.col("raw_id"))
    assert df.select(title.alias("x")).first()["x"] == expected


def test_strip_handles_every_python_blank(spark):
    blanks = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert one(spark, text.strip(F.col("a")), a=blanks + "x y" + blanks) == "x y"
    assert one(spark, text.strip(F.col("a")), a="​x﻿") == "​x﻿"


def test_times(spark):
    at = datetime(2025, 12, 3, 10, 5, 9)
    assert one(spark, text.compact_time(F.col("t")), t=at) == "20251203100509"
    assert one(spark, text.iso_seconds(F.col("t")), t=at) == "2025-12-03T10:05:09"


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title> A &amp;lt; B&#8212;&#x;</title><style>p{}</style>"
        "<script>var t='</p><a href=\"/no\">';</script></head><body><!-- <p>no</p> -->"
        "<p>One&nbsp;two<br>three <a class=x href=\"/u?a=1&amp;b=2\">link</a><p>1 < 2 &#128512;</body>"
    )
    assert one(spark, text.html_title(F.col("h")), h=page) == "A &lt; B—&#x;"
    assert one(spark, text.html_text(F.col("h")), h=page) == "One two three link 1 < 2 😀"
    assert one(spark, text.html_links(F.col("h")), h=page) == ["/u?a=1&b=2"]
    assert one(spark, text.html_title(F.col("h")), h="<p>none") is None


def test_json_field(spark):
    assert one(spark, text.json_field(F.col("p"), "k"), p='{"k": 5}') == "5"
    assert one(spark, text.json_field(F.col("p"), "k"), p="<html>") is None


@pytest.mark.parametrize(
    "written, amount, currency",
    [
        ("25 000,50 руб.", "25000.50", "RUB"),
        ("25 000 ₽", "25000.00", "RUB"),
        ("$1200.5", "1200.50", "USD"),
        ("цена 900 EUR/т", "900.00", "EUR"),
        ("150000 р", "150000.00", "RUB"),
        ("договорная", None, None),
        ("рубин 5", "5.00", "RUB"),
        ("truby 7", "7.00", None),
    ],
)
def test_prices(spark, written, amount, currency):
    assert one(spark, values.price(F.col("p")), p=written) == (Decimal(amount) if amount else None)
    assert one(spark, values.currency(F.col("p")), p=written) == currency


@pytest.mark.parametrize(
    "written, tons",
    [
        ("20 т", "20.000"),
        ("20,5 тонн", "20.500"),
        ("1 500 кг", "1.500"),
        ("вес 12", "12.000"),
        ("30 ц", "3.000"),
        ("5t", "5.000"),
        ("", None),
    ],
)
def test_weights(spark, written, tons):
    assert one(spark, values.weight_tons(F.col("w")), w=written) == (Decimal(tons) if tons else None)


@pytest.mark.parametrize(
    "written, normal",
    [
        ("8 (901) 234-56-78", "+79012345678"),
        ("+7 901 234 56 78", "+79012345678"),
        ("79012345678", "+79012345678"),
        ("9012345678", "+79012345678"),
        ("+1 (743) 555-3824", "+17435553824"),
        ("123", None),
        ("", None),
        ("1234567890", None),
    ],
)
def test_phones(spark, written, normal):
    assert one(spark, values.phone(F.col("p")), p=written) == normal


def test_first_phone_in_text(spark):
    assert one(spark, values.first_phone(F.col("t")), t="карта 4785380592391139, тел. 8 (901) 234-56-78") == "+79012345678"
    assert one(spark, values.first_phone(F.col("t")), t="ни одного 12345") is None


@pytest.mark.parametrize(
    "written, moment",
    [
        ("03.12.2025 10:15", datetime(2025, 12, 3, 10, 15)),
        (" 03.12.2025 ", datetime(2025, 12, 3)),
        ("2025-12-03T10:15:07", datetime(2025, 12, 3, 10, 15, 7)),
        ("Сегодня, 09:30", datetime(2025, 12, 5, 9, 30)),
        ("вчера", datetime(2025, 12, 4)),
        ("30 минут назад", datetime(2025, 12, 5, 11, 30)),
        ("2 часа назад", datetime(2025, 12, 5, 10, 0)),
        ("3 days ago", datetime(2025, 12, 2, 12, 0)),
        ("31.02.2025", None),
        ("скоро", None),
    ],
)
def test_moments(spark, written, moment):
    df = spark.createDataFrame([(written, datetime(2025, 12, 5, 12))], "w string, r timestamp")
    df = df.select(values.clean(F.col("w")).alias("t"), "r")
    assert df.select(values.moment(F.col("t"), F.col("r")).alias("x")).first()["x"] == moment


@pytest.mark.parametrize(
    "written, places",
    [
        ("Казань — Самара", ["Казань", "Самара"]),
        ("Ростов-на-Дону - Москва", ["Ростов-на-Дону", "Москва"]),
        ("А → Б → В", ["А", "Б", "В"]),
        ("Казань", None),
    ],
)
def test_routes(spark, written, places):
    assert one(spark, values.route_places(F.col("r")), r=written) == places


def test_place_key(spark):
    for written in ("г. Орёл", "ОРЕЛ", " город  орёл "):
        assert one(spark, values.place_key(F.col("p")), p=written) == "орел"


def test_dedup_key_policies(spark):
    df = spark.createDataFrame([("A  b", None), ("a B", None), ("a b", "x")], "title string, url string")
    skip = [r[0] for r in df.select(keys.dedup_key(df, ["title", "url"])).collect()]
    equal = [r[0] for r in df.select(keys.dedup_key(df, ["title", "url"], "equal")).collect()]
    assert skip[0] is None and skip[1] is None and len(skip[2]) == 64
    assert equal[0] == equal[1] != equal[2]
    with pytest.raises(ValueError):
        keys.dedup_key(df, ["title"], "other")


@pytest.mark.parametrize(
    "written, amount",
    [
        ("$1,200.50", "1200.50"),
        ("1.200,50 €", "1200.50"),
        ("$1,200", "1200.00"),
        ("1,200,000 usd", "1200000.00"),
        ("1.200.000 руб", "1200000.00"),
        ("1,2 млн", "1200000.00"),
        ("цена 12,500 руб", "12.50"),
        ("7.5.", "7.50"),
        ("1 200,5", "1200.50"),
        ("0,125 $", "0.13"),
    ],
)
def test_marks_of_thousands_and_decimals(spark, written, amount):
    assert one(spark, values.price(F.col("t")), t=written) == Decimal(amount)


@pytest.mark.parametrize(
    "written, number",
    [
        ("+7 (912) 345-67-89 доб. 12", "+79123456789"),
        ("8 (912) 345-67-89, вн. 7", "+79123456789"),
        ("+49 30 1234567 ext 22", "+49301234567"),
        ("+49 30 1234567 (ext. 22)", "+49301234567"),
        ("9123456789", "+79123456789"),
    ],
)
def test_phone_extensions_are_cut_off(spark, written, number):
    assert one(spark, values.phone(F.col("t")), t=written) == number


def test_links_in_any_quotes(spark):
    page = "<a href='u1'>1</a><A class=\"x > y\" HREF=u2>2</A><a\nhref=\"u3?a=1&amp;b=2\" id=z>3</a><a name=n>4</a><area href=u5>"
    assert one(spark, text.html_links(F.col("h")), h=page) == ["u1", "u2", "u3?a=1&b=2"]


def test_all_entities(spark):
    page = "<p>&#x41;&#X1F600;&euro;&lt;b&gt; &amp;lt; &eacute;&unknown; &#0; &#xD800; &AMP; a & b;</p>"
    assert one(spark, text.html_text(F.col("h")), h=page) == "A😀€<b> &lt; é&unknown; &#0; &#xD800; & a & b;"


def test_relative_dates_count_back(spark):
    at = datetime(2025, 12, 3, 10, 5)
    for written, expected in (
        ("5 минут назад", datetime(2025, 12, 3, 10, 0)),
        ("2 часа назад", datetime(2025, 12, 3, 8, 5)),
        ("3 hours ago", datetime(2025, 12, 3, 7, 5)),
        ("2 дня назад", datetime(2025, 12, 1, 10, 5)),
        ("1 day ago", datetime(2025, 12, 2, 10, 5)),
    ):
        assert one(spark, values.moment(F.col("t"), F.col("r")), t=written, r=at) == expected, written


@pytest.mark.parametrize(
    "written, amount",
    [
        ("25 тыс. руб", "25000.00"),
        ("1,5 млн руб", "1500000.00"),
        ("25к", "25000.00"),
        ("$25k", "25000.00"),
        ("25 т.р.", "25000.00"),
        ("25 т. руб", "25000.00"),
        ("2 млрд ₽", "2000000000.00"),
        ("20-25 тыс руб", "20000.00"),
        ("25 к оплате", "25.00"),
        ("30 000 - 35 000 руб", "30000.00"),
        ("5 т рожь", "5.00"),
        ("900 000 000 000 млрд", None),
    ],
)
def test_multipliers_and_ranges_of_prices(spark, written, amount):
    assert one(spark, values.price(F.col("t")), t=written) == (Decimal(amount) if amount else None)


@pytest.mark.parametrize(
    "written, tons",
    [("20-25 т", "25.000"), ("20 – 22,5 тонн", "22.500"), ("1,2 тыс. т", "1200.000"), ("500 тыс кг", "500.000"), ("25 т.", "25.000"), ("1-2", "2.000")],
)
def test_multipliers_and_ranges_of_weights(spark, written, tons):
    assert one(spark, values.weight_tons(F.col("t")), t=written) == Decimal(tons)


def test_notations_of_moments(spark):
    at = datetime(2025, 12, 3, 10, 5)
    for written, expected in (
        ("2025-12-03T10:15:00Z", datetime(2025, 12, 3, 10, 15)),
        ("2025-12-03T10:15:00.250+03:00", datetime(2025, 12, 3, 7, 15, 0, 250000)),
        ("2025-12-03 10:15:00+0300", datetime(2025, 12, 3, 7, 15)),
        ("2025-12-03 10:15", datetime(2025, 12, 3, 10, 15)),
        ("3 декабря 2025", datetime(2025, 12, 3)),
        ("3 декабря", datetime(2025, 12, 3)),
        ("31 мая 2024 г., 09:30", datetime(2024, 5, 31, 9, 30)),
        ("3 дек. 2025 в 7:05", datetime(2025, 12, 3, 7, 5)),
        ("3rd March 2024", datetime(2024, 3, 3)),
        ("31 февраля 2025", None),
        ("3 слона 2025", None),
        ("завтра", datetime(2025, 12, 4)),
        ("Завтра в 08:00", datetime(2025, 12, 4, 8)),
        ("послезавтра", datetime(2025, 12, 5)),
        ("позавчера, 23:59", datetime(2025, 12, 1, 23, 59)),
        ("час назад", datetime(2025, 12, 3, 9, 5)),
        ("an hour ago", datetime(2025, 12, 3, 9, 5)),
        ("полчаса назад", datetime(2025, 12, 3, 9, 35)),
        ("неделю назад", datetime(2025, 11, 26, 10, 5)),
        ("30 сек. назад", datetime(2025, 12, 3, 10, 4, 30)),
        ("2025-13-03T10:15:00Z", None),
        ("3 часа", None),
    ):
        df = spark.createDataFrame([(written, at)], "w string, r timestamp").select(values.clean(F.col("w")).alias("t"), "r")
        assert df.select(values.moment(F.col("t"), F.col("r")).alias("x")).first()["x"] == expected, written


def test_tags_with_marks_in_quotes(spark):
    for page, shown in (
        ('<p title="a > b">x', "x"),
        ("<p title = 'a > b' class=c>x</p>y", "x y"),
        ("<p don't>x</p> it's", "x it's"),
        ('<p title="open>x</p>', "x"),
        ("<script>if (a <!-- b) '</p>'</script>x<!-- <script> -->y", "x y"),
        ("<style>p > a {}</style  >x<script src=a>never closed", "x"),
        ("<header>h</header><head><title>t</title></head>x", "h x"),
        ("a <b" + " x=1" * 3000 + ">c" + "<i " + "y" * 50000 + ">d", "a c d"),
        ("caf&eacute &copy 2025 &#65 &ampx &unknown z", "café © 2025 A &x &unknown z"),
    ):
        assert one(spark, text.html_text(F.col("h")), h=page) == shown, page[:60]
    assert one(spark, text.html_links(F.col("h")), h='<a href="?a=1&copy=2&lt;">x</a>') == ["?a=1&copy=2<"]


def test_the_text_of_a_page_is_computed_once(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "h string").select(text.html_text(F.col("h")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</head") == 1


def test_a_price_reads_no_second_number(spark):
    texts = ["12,5 тыс. руб", "10–20 т", "1.000.000", "USD 1,234", "1,234 руб", "нет", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    prices = df.select(values.price(F.col("t")).alias("p"))
    # The cast of a missing second number fails, and throws, inside the engine for every row.
    assert "high" not in prices._jdf.queryExecution().optimizedPlan().toString()
    found = [None if r.p is None else float(r.p) for r in prices.collect()]
    assert found == [12500, 10, 1e6, 1234, 1.23, None, None, None]


def test_keywords_are_looked_for_by_their_first_letters(spark):
    pattern = any_keyword(["blue bolt", "Груз"])
    assert pattern.startswith("(?iU)(?=[bГ])")
    texts = ["a BLUE  bolt", "blue bolts", "груз", "грузы", "xblue bolt", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(pattern)).collect()] == [True, False, True, False, False, False]
    assert "(?=" not in any_keyword([]) and "(?=" not in any_keyword(["-x", "blue"])
