"""Golden cells for the column expressions."""

from __future__ import annotations

import random
from decimal import Decimal
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from saldo.functions import html, names, numbers, periods, text, urls


def cells(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_number(spark):
    given = ["1.234,56", "-5", " 7 ", "", "abc", "1e5", "inf", "nan", "1d", "12,", ",5", "+3,1", "1_000", None, "1.005"]
    got = cells(spark, given, numbers.parse_number)
    want = ["1234.56", "-5", "7", None, None, "100000", None, None, None, "12", "0.5", "3.1", None, None, "1005"]
    assert got == [None if w is None else Decimal(w).quantize(Decimal("0.01")) for w in want]


def test_parse_number_rounds_beyond_its_scale(spark):
    assert cells(spark, ["1,005"], numbers.parse_number) == [Decimal("1.01")]
    assert cells(spark, ["1,005"], lambda c: numbers.parse_number(c, 3)) == [Decimal("1.005")]


def test_measure_passes_numbers_through(spark):
    df = spark.createDataFrame([(1234.56,), (float("nan"),), (None,)], "raun double")
    assert [r[0] for r in df.select(numbers.measure(df, "raun")).collect()] == [Decimal("1234.56"), None, None]


def test_format_number(spark):
    given = [1234.0, 1234.56, -0.0, -1234567.891, 0.5, None, 999.999]
    assert cells(spark, given, numbers.format_number, "double") == [
        "1.234", "1.234,56", "0", "-1.234.567,89", "0,50", "", "1.000,00",
    ]
    assert cells(spark, ["1.234,5", "abc", None, " 7 "], numbers.format_text_number) == ["1.234,50", "abc", "", "7"]
    assert cells(spark, [1234.5, 1234.0, 1234.567, None], numbers.format_grouped, "double") == [
        "1,234.5", "1,234.0", "1,234.57", "",
    ]


def test_format_percent_and_score(spark):
    assert cells(spark, [12.34, 0.25, -1234.5, None], numbers.format_percent, "double") == ["12.3%", "0.2%", "-1234.5%", ""]
    assert cells(spark, [1234.567, None], numbers.format_score, "double") == ["1234.57", "0.00"]


def test_share_percent(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 2.0), (2.0, None), (-1.0, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(numbers.share_percent(F.col("a"), F.col("b"))).collect()]
    assert got == [25.0, 0.0, 0.0, 100.0, 0.0]


def test_year_and_month(spark):
    given = ["2020", "2020.0", "x", "", None, "12.0"]
    assert cells(spark, given, numbers.to_year) == [2020, 2020, None, None, None, 12]


def test_digits_only(spark):
    given = ["VSK-001", "  12 34\t", "abc", "   ", "", None]
    assert cells(spark, given, text.digits_only) == ["001", "1234", "", None, None, None]


def test_map_values(spark):
    mapping = {"A": "X", "B": "A"}
    assert cells(spark, [" A ", "B", "C ", None], lambda c: text.map_values(c, mapping)) == ["X", "A", "C", None]
    assert cells(spark, [" A "], lambda c: text.map_values(c, {})) == ["A"]


def test_file_period(spark):
    files = ["x_202312.csv", "x_202313.csv", "x_1999.csv", "x.csv", "1998_201407.csv", "x_199912.csv", "202300"]
    assert cells(spark, files, periods.file_year) == [2023, 2023, 1999, None, 2014, 1999, 2023]
    assert cells(spark, files, periods.file_month) == [12, None, None, None, 7, None, None]


def test_column_names():
    assert names.normalize_columns(["Ár/ársfjórðungur", "ár", "Ár", "  ", "Tegund 0"]) == [
        "ar_arsfjorungur", "ar", "ar_2", "col", "tegund_0",
    ]
    # The number 2 is taken by another column, so the repeated name goes on to 3.
    assert names.unique_names(["a", "a", "a_2"]) == ["a", "a_3", "a_2"]
    assert names.reader_names(["a", "a", "", "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]


BASES = ["http://h.org/a/b/c.html?q=1#f", "https://h.org", "http://h.org/a/", "http://h.org/x?y#z"]
HREFS = [
    "http://o.net/x", "//o.net/y", "/root.csv", "rel.csv", "./r", "../up", "../../../far", "a/./b/../c", "?p=2", "#top",
    "", "/a/b/../c", "mailto:x@y", "d/", "..", ".", "a//b",
]


@pytest.mark.parametrize("base", BASES)
def test_resolve_agrees_with_the_standard_library(spark, base):
    got = cells(spark, HREFS, lambda c: urls.resolve(F.lit(base), c))
    assert got == [urljoin(base, h) for h in HREFS]


def test_file_name(spark):
    given = ["http://h/a/b%20c.csv?x=1", "http://h/a+b.csv", "http://h/", "http://h", "http://h/d/", "http://h/bad%zz.csv"]
    assert cells(spark, given, urls.file_name) == [
        "b c.csv", "a+b.csv", "download.csv", "download.csv", "d", "bad%zz.csv",
    ]


def test_links_are_distinct_and_in_order(spark):
    page = '<a href="/b/download/x.csv">1</a><a href="/a/download/y.csv">2</a><a HREF="/b/download/x.csv">3</a><a href="/n">'
    pattern = 'href="([^"]+download/[^"]+\\.csv)"'
    got = cells(spark, [page], lambda c: urls.links(c, F.lit("http://h.org/p"), pattern))
    assert got == [["http://h.org/b/download/x.csv", "http://h.org/a/download/y.csv"]]


def facts(spark, pages, **options):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "n int, html string")
    rows = df.select("n", html.page_facts(F.col("html"), **options).alias("f")).orderBy("n").select("f.*").collect()
    return [tuple(r) for r in rows]


def test_entity_name(spark):
    given = [
        "<title>T</title><h1> A <b>B</b>\n</h1><h1>C</h1>",
        "<title>T &amp; U</title><h1>&nbsp;</h1>",
        "<script>var h='<h1>no</h1>'</script><!-- <h1>no</h1> --><h1 class='x'>J&oacute;n &#254;&#xF0; &amp;lt; &unknown;</h1>",
        "<p>none</p>",
        None,
        "<h1><div>In a block</div></h1><p>after</p>",
        "<h1>Open<p>text<h1>Next</h1>",
        "",
    ]
    assert [r[0] for r in facts(spark, given)] == [
        "AB", "T & U", "Jón þð &lt; &unknown;", None, None, "In a block", "Open", None,
    ]


def test_page_text(spark):
    page = "<html><style>x{}</style><p> one </p>\n<p>two&nbsp;<b>three</b></p> a < b &amp; c<!-- gone --></html>"
    assert html.PageReader().read(page).text() == "one two three a < b & c"
    assert [r[2] for r in facts(spark, [page, page.upper(), "x", None], phrase="Three A < B")] == [True, True, False, None]


def test_first_href(spark):
    page = "<a name=x>no</a><a href='/q?a=1&amp;b=2'>1</a><a class=y href=/d/unit/5>2</a><a href=\"/d/unit/6\">3</a><a href>4</a>"
    for part, want in (("/d/unit/", "/d/unit/5"), ("a=1&b", "/q?a=1&b=2"), ("/none", None)):
        assert facts(spark, [page], part=part)[0][1] == want


class Events(HTMLParser):
    """All events of a page, with runs of text as one."""

    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, dict(reversed(attrs)).get("href") if tag == "a" else None))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        if self.seen and self.seen[-1][0] == "data":
            data = self.seen.pop()[1] + data
        self.seen.append(("data", data))

    def handle_comment(self, data):
        self.seen.append(("other",))

    handle_decl = handle_pi = unknown_decl = handle_comment


def expected(page):
    """Findings of a page by searching its list of events."""
    parser = Events()
    parser.feed(page)
    parser.close()
    shown, hidden = [], []
    for event in parser.seen:
        if event[0] == "start" and event[1] in html.HIDDEN:
            hidden.append(event[1])
        elif hidden:
            if event == ("end", hidden[-1]):
                hidden.pop()
                shown.append(("other",))
        else:
            shown.append(event)

    def words(events):
        joined = []
        for e in events:
            if e[0] == "data":
                joined.append(e[1].strip())
        return [w for w in joined if w]

    def element(tag):
        starts = [i for i, e in enumerate(shown) if e[:2] == ("start", tag)]
        if not starts:
            return ""
        rest = shown[starts[0] + 1 :]
        ends = [i for i, e in enumerate(rest) if e == ("end", tag)]
        again = [i for i, e in enumerate(rest) if e[:2] == ("start", tag)]
        if ends and (not again or ends[0] < again[0]):
            return "".join(words(rest[: ends[0]]))
        blocks = [i for i, e in enumerate(rest) if e[0] in ("start", "end") and e[1] in html.BLOCK]
        stop = min(blocks[:1] + again[:1], default=len(rest))
        return "".join(words(rest[:stop]))

    hrefs = [e[2] for e in shown if e[:2] == ("start", "a") and e[2] is not None]
    return element("h1") or element("title") or None, " ".join(words(shown)), hrefs


def test_fuzzed_pages():
    parts = [
        "<h1>", "</h1>", "<title>", "</title>", "<p>", "</p>", "<b>", "</b>", "<div>", "<br/>", "<a href='/x?a&amp;b'>", "<a href=y>", "</a>", "<a>",
        "<script>", "</script>", "<style>", "</style>", "<template>", "</template>", "<!--", "-->", "<!doctype html>", "<?pi>", "&amp;", "&amp", "&#65;",
        "&nbsp;", "&bogus;", "<", ">", "&", " ", "\n", "word", "é", "'", '"', "</", "<!",
    ]
    rng = random.Random(5)
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        read = html.PageReader().read(page)
        assert (read.name(), read.text(), read.hrefs) == expected(page), page


def test_wide_amounts_are_kept_and_too_wide_ones_are_errors(spark):
    wide = "9" * 24
    assert cells(spark, [f"{wide},25", "1e3", "inf"], numbers.parse_number) == [Decimal(f"{wide}.25"), Decimal("1000.00"), None]
    with pytest.raises(Exception, match="no decimal"):
        cells(spark, ["9" * 27], numbers.parse_number)


def test_measure_of_numbers(spark):
    df = spark.createDataFrame([(1.5, 2, None), (float("nan"), None, 3.25)], "a double, b int, c double")
    got = df.select(*[numbers.measure(df, n).alias(n) for n in df.columns]).collect()
    assert [tuple(r) for r in got] == [(Decimal("1.50"), Decimal("2.00"), None), (None, None, Decimal("3.25"))]
