from __future__ import annotations

import re

import pytest

from pyspark.sql import functions as F

from saldo.operators import entities, harvest

PHRASE, PART = "no match found", "/id/"
PAGES = {
    "1": ('<h1>Search</h1><a href="/id/900">x</a>', "<h1>First Ltd</h1>"),
    "2": ("<p>No <b>match</b> FOUND</p><a href='/id/901'>x</a>", "<h1>Never</h1>"),
    "3": ("<title>Many hits</title>", None),
    "4": ('<a href="/id/904">x</a>', "<p>nameless</p>"),
    "5": ('<a href="/id/905">x</a>', None),
}


@pytest.fixture
def captures(spark):
    searches = [(k, f"http://r.org/s?n={k}", s) for k, (s, _) in PAGES.items()]
    details = [(k, f"http://r.org/d/{k}", d) for k, (_, d) in PAGES.items() if d]
    schema = "vm_number string, url string, html string"
    keys = spark.createDataFrame([(k,) for k in [*PAGES, "6"]], "vm_number string")
    return keys, spark.createDataFrame(searches, schema), spark.createDataFrame(details, schema)


def test_classify(captures):
    got = {r[0]: tuple(r)[1:] for r in entities.classify(*captures, PHRASE, PART).collect()}
    assert got == {
        "1": ("ok", "First Ltd", "http://r.org/id/900"),
        "2": ("no_result", None, "http://r.org/s?n=2"),
        "3": ("result_unknown", "Many hits", "http://r.org/s?n=3"),
        "4": ("missing_name", None, "http://r.org/id/904"),
        "5": ("error: no detail capture", None, "http://r.org/id/905"),
        "6": ("error: no search capture", None, None),
    }


def test_resolve_new_keeps_known_rows(spark, captures):
    keys, searches, details = captures
    known = spark.createDataFrame(
        [("1", "ok", "Old name", "u"), ("99", "ok", "Not asked", "u")], "vm_number string, status string, name string, url string"
    )
    got = {r["vm_number"]: r["name"] for r in entities.resolve_new(keys, known, searches, details, PHRASE, PART).collect()}
    assert got == {"1": "Old name", "2": None, "3": "Many hits", "4": None, "5": None, "6": None}


def test_entity_keys(spark):
    df = spark.createDataFrame([("VSK-7",), (" 7 ",), ("abc",), ("",), (None,), ("12-3",)], "vm_numer string")
    assert [r[0] for r in entities.entity_keys(df).collect()] == ["", "123", "7"]
    assert [r[0] for r in entities.entity_keys(df, limit=2).collect()] == ["", "123"]
    assert entities.number_column(df.withColumnRenamed("vm_numer", "vm_number")) == "vm_number"
    with pytest.raises(KeyError):
        entities.entity_keys(df.withColumnRenamed("vm_numer", "other"))


def test_harvest(spark):
    html = '<a href="/x/download/b.csv">b</a> <a href="/x/download/a%20c.CSV">a</a> <a href="/x/download/b.csv">b</a> <a href="/y.csv">y</a>'
    pages = spark.createDataFrame([(1, "http://h.org/set", html), (2, "http://h.org/set", html)], "page_id int, url string, html string")
    got = [tuple(r) for r in harvest.harvest_links(pages).orderBy("page_id", "position").collect()]
    one = [(0, "http://h.org/x/download/b.csv", "b.csv"), (1, "http://h.org/x/download/a%20c.CSV", "a c.CSV")]
    assert got == [(p, *r) for p in (1, 2) for r in one]
    assert sorted(tuple(r) for r in harvest.first_pages(harvest.harvest_links(pages)).collect()) == sorted((r[1], 1) for r in one)


def test_manifest(spark):
    links = spark.createDataFrame(
        [(1, 0, "u/a", "a"), (1, 1, "u/b", "b"), (1, 2, "v/b", "b"), (1, 3, "u/c", "c")],
        "page_id int, position int, link string, filename string",
    )
    listing = "filename string, bytes bigint"
    before = spark.createDataFrame([("a", 5)], listing)
    after = spark.createDataFrame([("a", 6), ("b", 7)], listing)
    def run(force):
        return {r["url"]: (r["status"], r["bytes"]) for r in harvest.manifest(links, before, after, force).collect()}
    assert run(False) == {"u/a": ("skipped", 5), "u/b": ("downloaded", 7), "v/b": ("skipped", 7), "u/c": ("error: file has not landed", 0)}
    assert run(True)["u/a"] == ("downloaded", 6)
    assert tuple(harvest.manifest_summary(harvest.manifest(links, before, after)).first()) == (4, 1, 19)


def test_references_and_elements_that_are_not_closed(spark):
    pages = [
        "<h1>O&apos;Brien &#146;x &amp y &copy &bogus; &notanentity; &eacute;</h1>",
        "<title>T</title><h1>Open heading<p>text</p>",
        "<title>T</title><script>hidden <h1>no</h1>",
        "<h1>&amp;lt; &nbsp; </h1>",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "n int, html string")
    got = [r["name"] for r in entities.read_names(df, "n").orderBy("n").collect()]
    # Old names count without a semicolon, also as the start of a longer word.
    assert got == ["O'Brien \u2019x & y \u00a9 &bogus; \u00acanentity; \u00e9", "Open heading", "T", "&lt;"]


def test_numbers_without_a_search_have_its_address(spark):
    keys = spark.createDataFrame([("12",)], "vm_number string")
    none = spark.createDataFrame([], "vm_number string, url string, html string")
    row = entities.classify(keys, none, none, "none", "/d", "http://r/s?q={number}&x=1").first()
    assert (row["status"], row["url"]) == ("error: no search capture", "http://r/s?q=12&x=1")


def unread(captures, *numbers):
    """Captures of which those of some numbers fail when they are read."""
    failing = F.when(F.col("vm_number").isin(*numbers), F.raise_error(F.lit("a known page was read"))).otherwise(F.col("html"))
    return captures.withColumn("html", failing)


def test_only_pages_of_new_numbers_are_read(spark, captures, tmp_path):
    keys, searches, details = captures
    path = str(tmp_path / "table")
    some = keys.where("vm_number in ('1', '3')")
    assert entities.append_new(some, path, searches, details, PHRASE, PART) == 2
    watched = unread(searches, "1", "3"), unread(details, "1", "3")
    assert entities.append_new(keys, path, *watched, PHRASE, PART) == 4
    every = unread(searches, *PAGES), unread(details, *PAGES)
    assert entities.append_new(keys, path, *every, PHRASE, PART) == 0
    want = {tuple(r) for r in entities.classify(keys, searches, details, PHRASE, PART).collect()}
    assert {tuple(r) for r in entities.read_entities(spark, path).collect()} == want


@pytest.mark.parametrize("most_sent", [1_000_000, 2])
def test_captures_in_folders(spark, captures, tmp_path, monkeypatch, most_sent):
    monkeypatch.setattr(entities, "MOST_SENT", most_sent)
    keys, searches, details = captures
    stores = [entities.CaptureStore(str(tmp_path / n), 8) for n in ("s", "d")]
    assert stores[0].of(keys).count() == 0
    for store, rows in zip(stores, (searches, details)):
        store.add(rows.where("vm_number < '3'"))
        store.add(rows.where("vm_number >= '3'"))
    one = stores[0].of(keys.where("vm_number = '4'"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", one._jdf.queryExecution().toString())
    assert one.where("vm_number = '4'").count() == 1 and one.count() < searches.count()
    path = str(tmp_path / "table")
    assert [entities.append_new(k, path, *stores, PHRASE, PART) for k in (keys.limit(2), keys, keys)] == [2, 4, 0]
    want = {tuple(r) for r in entities.classify(keys, searches, details, PHRASE, PART).collect()}
    assert {tuple(r) for r in entities.read_entities(spark, path).collect()} == want
