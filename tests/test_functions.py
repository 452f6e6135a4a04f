"""Functions and selectors on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.functions.dates import date_element, defaulted, strftime, valid_date
from scriptorium.functions.expressions import ExpressionError, directives, expression
from scriptorium.functions.selectors import TagCondition, category_predicate, date_predicate, number_predicate, parent_name, tags_predicate
from scriptorium.operators.aggregates import cloud_limit
from scriptorium.operators.listing import Host, PageQuery, Template, bound_query, pager_neighbours, pager_pages, pager_parameters, pager_url, parse_order, url_parameters


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("source", "result"),
    [("3*5-1", 14), ("-2^2", 4), ("2^3^2", 512), ("7/(2-2)", None), ("min(8, 2.5, 31)", 2.5), ("round(-2.5)", -2), ("7 % -3", 1), ("1 < 2 and not 0", 1), (".5 + 1.", 1.5), ("sqrt(-1)", None), ("pow(10, 400)", None)],
)
def test_expressions(spark, source, result):
    assert value(spark, expression(source)) == result


@pytest.mark.parametrize("source", ["", "1 +", "abs()", "abs(1,2)", "nope", "nope(1)", "1 < 2 < 3", "(1", "1 $ 2", "1" * 257])
def test_bad_expressions(spark, source):
    with pytest.raises(ExpressionError):
        expression(source)


@pytest.mark.parametrize(
    ("number", "shown"),
    [(5.0, "5"), (0.1 + 0.2, "0.30000000000000004"), (1e21, "1e+21"), (-0.0, "0"), (123456789012345680.0, "123456789012345680"), (1e-7, "1e-7"), (0.00001, "0.00001")],
)
def test_number_text(spark, number, shown):
    assert value(spark, text.number_text(F.lit(number))) == shown


@pytest.mark.parametrize(
    ("name", "slug"),
    [("Some Page!", "some-page"), ("/a:b:C", "a-b:c"), ("_default:main", "main"), ("__x__y", "_x-y"), ("Ünï côde", "ünï-côde"), ("a -- : -- b", "a:b")],
)
def test_page_slug(spark, name, slug):
    assert value(spark, text.page_slug(F.lit(name))) == slug


def test_text_functions(spark):
    assert value(spark, text.grapheme_count(F.lit("é👨‍👩‍👧x"))) == 3
    assert value(spark, text.utf16_length(F.lit("a😀"))) == 3
    assert value(spark, text.literal_markup(F.lit("a😀"))) == "@<&#97;&#128512;>@"
    assert value(spark, text.literal_markup(F.lit(""))) == ""
    assert value(spark, text.section(F.lit("one\n====\n two \n====\n"), 2)) == "two"
    assert value(spark, text.section(F.lit("one"), 2)) == ""
    assert value(spark, text.excerpt(F.lit("Key: a. Key: b."), r"Key: (\w)", group=1, match=2)) == "b"
    assert value(spark, text.excerpt(F.lit("aa"), r"(a)\1")) == ""
    assert value(spark, text.source_space(F.lit("\na\r\nb\tc\n  \nd\n"))) == "a\nb    c\n\nd"
    assert value(spark, text.dangerous_url(F.lit("java\tscript:x"))) is True


@pytest.mark.parametrize(
    ("condition", "tags", "shown"),
    [("+a -b", ["a"], True), ("+a -b", ["a", "b"], False), ("x y", ["y"], True), ("x y", ["z"], False), ("+", ["a"], False), ("-", [], True), ("", ["a"], False), ("- +a", ["a"], True), ("+a", None, None)],
)
def test_tag_conditions(spark, condition, tags, shown):
    column = F.lit(None).cast("array<string>") if tags is None else F.array(*map(F.lit, tags)).cast("array<string>")
    assert value(spark, TagCondition(condition).predicate(column)) is shown


def test_selectors(spark):
    assert value(spark, category_predicate(None, F.lit("docs"), "docs")) is True
    assert value(spark, category_predicate("-admin", F.lit("news"), "docs")) is True
    assert value(spark, category_predicate("* -news", F.lit("news"), "docs")) is False
    visible, hidden = F.array(F.lit("docs")), F.array(F.lit("_staff"))
    assert value(spark, tags_predicate("+docs +stable", visible, hidden)) is False
    assert value(spark, tags_predicate("+_staff", visible, hidden)) is True
    assert value(spark, tags_predicate("==", F.array(F.lit("shared"), F.lit("docs")), hidden, ["docs", "shared", "_x"])) is True
    assert number_predicate("about 3", F.lit(3)) is None and value(spark, number_predicate(">=3", F.lit(3))) is True
    now = datetime(2024, 3, 31)
    assert date_predicate("2024.13", F.lit(now), now) is None and date_predicate("last 0 days", F.lit(now), now) is None
    assert value(spark, date_predicate("last month", F.lit(datetime(2024, 2, 29)), now)) is True


def test_orders_and_paths():
    assert parse_order("titleAsc") == ("title", False) and parse_order("rating") == ("rating", True)
    assert parse_order("name asc") == ("created_at", True) and parse_order("pagelength asc") == ("size", False)
    assert url_parameters("/start/tag/a%20b/p/2?x/y") == {"tag": "a b", "p": "2"}
    assert url_parameters("/category/o/tags/x") == {"category": "o", "tags": "x"} and url_parameters("/") == {}
    query = bound_query({"tags": "@URL|x", "perPage": "7x", "_f": "v", "reverse": "yes"}, "/start/tags/a")
    assert (query.tags, query.per_page, query.form, query.reverse) == ("a", 7, {"f": "v"}, True)
    assert pager_pages(1, 1) == [] and pager_pages(5, 9) == [1, 3, 4, 5, 6, 7, 9]
    assert pager_url("/start/p/2/tag/x?q=1", "p", 3) == "/start/tag/x/p/3?q=1"
    assert pager_url("/", "p", 2) == "/p/2" and pager_url("/start#top", "p", 2) == "/start/p/2#top"
    assert pager_parameters(["", "left", "", ""]) == ["p", "left_p", "p2", "p3"]
    assert [pager_neighbours(n, 3) for n in (1, 2, 3, 9)] == [(None, 2), (1, 3), (2, None), (None, None)]


def test_template(spark):
    row = spark.createDataFrame([("cat:a", "A", datetime(2024, 3, 5, 7))], "fullname string, title string, created_at timestamp")
    found = row.select(Template("%%title_linked%% %%created_at|%d.%m.%Y%% %%nope%%%%title").column().alias("t")).first()["t"]
    assert found == "[[[cat:a | A]]] 05.03.2024 %%title"
    assert value(spark, strftime(F.lit(datetime(2024, 1, 2, 15, 4)), "%I:%M %p %j %q")) == "03:04 PM 002 %q"


@pytest.mark.parametrize("selector", ["+3", "3.", ".5", "> +3", "=>3", "three", ""])
def test_numbers_that_are_no_selector(spark, selector):
    assert number_predicate(selector, F.lit(1)) is None


def test_dates_that_are_no_selector(spark):
    now = datetime(2020, 5, 1)
    for text_ in ("last year", "last 0 days", "last two weeks", "2020.13", "202", "> 2020-1-1", ">> 2020-01-01", "> 2020-02-30", "", None):
        assert date_predicate(text_, F.lit(now), now) is None


def test_names_and_limits():
    assert [parent_name(x) for x in ("o:page", " - ", "=", "-=", ".", None)] == ["o:page", None, None, None, None, None]
    assert [cloud_limit(x) for x in ("12", "0", "-3", "4.5", None, "9" * 30)] == [12, 50, 50, 50, 50, 50]
    assert parse_order("metadata{due} ASC") == ("metadata.due", False) and parse_order("metadata{due}") == ("metadata.due", True)


def test_host_refuses_what_it_does_not_have():
    host = Host()
    assert host.accepted(PageQuery(category="*", limit=99)).limit == 20 and host.accepted(PageQuery(limit=-4)).limit == 0
    for query in (PageQuery(rating=">1"), PageQuery(order="random"), PageQuery(parent="-")):
        with pytest.raises(ValueError, match="support"):
            host.accepted(query)


@pytest.mark.parametrize(
    ("source", "shown"),
    [
        ("a [[#expr 2*3]] b", "a 6 b"), ("[[#expr 1/0]]", "ERROR"), ("[[#expr nope]]", "ERROR"), ("[[#expr ]]", ""), ("[[#if yes | a | b]][[#if 0|a|b]]", "ab"), ("[[#if x]]", ""),
        ("[[#ifexpr 2 > 1 | [[#if false | q | [[#expr 4/8]]]] ]]", "0.5"), ("[[#ifexpr [[#expr 1+1]] = 2 | two]]", "two"), ("[[#ifexpr ( | a | b]]", "ERROR"), ("[[#other 1]]", "[[#other 1]]"),
    ],
)
def test_directives(spark, source, shown):
    assert value(spark, directives(source)) == shown


def test_directives_too_deep(spark):
    source = "[[#if 1 | " * 65 + "x" + "]]" * 65
    assert value(spark, directives(source)) == source


def plain_fnv(text_, digits):
    out = ""
    for n in range(-(-digits // 8)):
        h = 0x811C9DC5 ^ n
        data = text_.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[k : k + 2], "big")) * 0x01000193 % 2**32
        out += f"{h:08x}"
    return out[:digits]


def test_hashes_dates_and_paths(spark):
    for text_ in ("", "abc", "žó😀 x", "a" * 300):
        assert value(spark, text.stable_hex(F.lit(text_), 32)) == plain_fnv(text_, 32) and value(spark, text.stable_hex(F.lit(text_), 40)) == plain_fnv(text_, 40)
    assert value(spark, date_element(F.lit(0))) == '<span class="odate time_0">01 Jan 1970 00:00</span>'
    assert value(spark, date_element(F.lit(60), "%d|agohover", True)) == '<span class="odate time_60 format_%25d%7Cagohover">01 Jan 1970 00:01</span>'
    assert value(spark, valid_date(F.lit("2020-02-29 10:00:00"))) == datetime(2020, 2, 29, 10) and value(spark, valid_date(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="Invalid page date: 2020-02-30"):
        value(spark, valid_date(F.lit("2020-02-30")))
    assert value(spark, defaulted(F.lit(None).cast("timestamp"))) is not None
    for path in ("", "a/b ", "a/\x01", "..", "a\\b", "a#b", "a/%41"):
        assert value(spark, text.safe_local_path(F.lit(path))) is None
    assert value(spark, text.page_link(F.lit("//Other.example/X"), F.lit(None).cast("string"))) == "//other.example/x"
    assert value(spark, text.page_link(F.lit("/My Route/"), F.lit(""))) == "/my-route/"
