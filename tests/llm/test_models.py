"""Language trees, site quality, URL trees, archives and the vector tree."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from saldo.llm import language_ppm, site_quality, stores, url_trees, vector_tree, warc
from saldo.sources.scratch import scratch_dir

WORDS = {"aa": ["kato", "mira", "selo", "vanu"], "bb": ["schlund", "grecht", "pfort", "wurz"]}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS[lang], k=12)) for _ in range(n)]


def training(documents, n=60):
    return documents([(k * 2 + j, t, lang) for j, lang in enumerate(WORDS) for k, t in enumerate(sentences(lang, n, j))])


def slow_bits(model, lang, text):
    """The code length read byte by byte off the frozen tables."""
    raw = b"   " + language_ppm.plain_bytes(text)
    symbols, width, total = [int(model.symbols[b]) for b in raw], model.width, 0.0
    for i in range(3, len(symbols)):
        node = model.nodes[(symbols[i - 3] * width + symbols[i - 2]) * width + symbols[i - 1]]
        total += float(model.bits[lang][node][symbols[i]])
    return total


def test_languages(documents, monkeypatch):
    docs = training(documents)
    model = language_ppm.fit(docs)
    assert model.languages == ["aa", "bb"]
    assert np.allclose(np.exp2(-model.bits.astype(float)).sum(axis=2), 1, atol=1e-4)
    texts = ["kato mira", "GRECHT!! pfort", "vanu " * 2000]
    monkeypatch.setattr(language_ppm, "CHUNK", 700)
    bits, _ = model.lengths([language_ppm.plain_bytes(t) for t in texts])
    assert np.allclose(bits, [[slow_bits(model, k, t) for k in (0, 1)] for t in texts], rtol=1e-5)
    rows = [(1, None), (2, ""), (3, "12 !! ²"), (4, "Kato selo vanu"), (4, "Kato selo vanu"), (5, "wurz grecht " * 5000), (6, "日本語")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_ppm.identify(documents(rows), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "aa" and got[5][0] == "bb" and got[6][0] in ("aa", "bb")
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = language_ppm.keep_languages(docs.unionByName(documents(rows)))
    assert kept.columns == docs.columns
    assert {1, 2, 3}.isdisjoint({r.doc_id for r in kept.join(documents(rows).select("doc_id", "text"), ["doc_id", "text"]).collect()})
    assert kept.count() >= docs.count()


def test_languages_without_training(documents):
    model = language_ppm.fit(documents([(1, None, "aa"), (2, "text", None)]))
    assert [r.lang_pred for r in language_ppm.identify(documents([(1, "text")]), model).collect()] == ["und"]
    assert language_ppm.keep_languages(documents([])).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_ppm.fit(docs.where(~held))
    found = docs.where(held).join(language_ppm.identify(docs, model), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_site_quality(spark, documents):
    rng = random.Random(1)

    def text(good):
        return " ".join(rng.choices(WORDS["aa"] + WORDS["bb"] + [str(rng.random())], k=40)) if good else "BUY!! ### $$$ " * 12

    rows, labels = [], []
    for i in range(400):
        good = i % 2 == 0 if i % 5 else i % 4 > 0
        rows.append((i, text(good), "aa", "src/hot" if i % 3 == 0 else f"http://Host{i % 7}/p/{i}"))
        labels.append((i, int(good)))
    rows += [(1000, None, None, None), (1001, "", "aa", ""), (1002, text(True), "aa", "solo"), (1002, text(True), "aa", "solo")]
    known = spark.createDataFrame(labels[:300] + labels[:5] + [(7777, None)], "doc_id bigint, quality int")
    got = site_quality.score(documents(rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got)
    truth = dict(labels)
    assert np.mean([(r.quality >= 0.4) == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]) > 0.97
    assert {(r.host, r.path) for r in got if r.doc_id in (1, 3)} == {("host1", "/p"), ("src", "/hot")}
    kept = site_quality.keep_quality(documents(rows), known)
    assert kept.columns == documents([]).columns and {r.doc_id for r in kept.collect()} >= {i for i, g in labels if g}
    none = known.where("false")
    assert site_quality.keep_quality(documents(rows), none).count() == len(rows)
    again = rows[:3] * 4 + rows[-2:]
    assert site_quality.keep_quality(documents(again), none).count() == len(again)
    assert site_quality.score(documents([]), known).collect() == []


def pseudo_documents(groups):
    """Shrinkage of sites (n, good, squares, centre), from the formulas."""
    total, sites = sum(n for n, *_ in groups), len(groups)
    if sites < 2 or total <= sites:
        return site_quality.MOST_SHRINKAGE
    between = sum(n * (g / n - c) ** 2 for n, g, _, c in groups)
    within = sum(q - n * (g / n) ** 2 for n, g, q, _ in groups)
    noise = max(within, 0) / (total - sites)
    spread = (between - (sites - 1) * noise) / max(1, total - sum(n * n for n, *_ in groups) / total)
    even = sum(c * (1 - c) for *_, c in groups) / sites
    if spread <= 0:
        return site_quality.MOST_SHRINKAGE
    return min(max(even / spread - 1, site_quality.LEAST_SHRINKAGE), site_quality.MOST_SHRINKAGE)


def test_site_rates_by_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.withColumn("source", F.concat("source", F.lit("/"), (F.col("doc_id") % 3).cast("string")))
    rows = site_quality.score(docs, labels).collect()

    def sums(keys):
        out = {}
        for r in rows:
            good = 1 / (1 + np.exp(-r.evidence))
            n, g, q = out.get(keys(r), (0, 0.0, 0.0))
            out[keys(r)] = (n + 1, g + good, q + good * good)
        return out

    hosts, paths = sums(lambda r: r.host), sums(lambda r: (r.host, r.path))
    whole = sum(g for _, g, _ in hosts.values()) / len(rows)
    strength = pseudo_documents([(*v, whole) for v in hosts.values()])
    of_host = {h: (strength * whole + g) / (strength + n) for h, (n, g, _) in hosts.items()}
    strength = pseudo_documents([(*v, of_host[k[0]]) for k, v in paths.items()])
    logit = lambda p: np.log(p / (1 - p))
    for r in rows:
        n, g, _ = paths[(r.host, r.path)]
        rate = (strength * of_host[r.host] + g) / (strength + n)
        assert np.isclose(r.site_rate, rate) and np.isclose(r.quality, 1 / (1 + np.exp(-(r.evidence + logit(rate) - logit(whole)))))
    assert len(paths) > len(hosts) > 1


def test_samples_stay_within_their_bounds(spark, documents):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choices(WORDS["aa"], k=20)) + f" {i}", "aa") for i in range(300)] + [(i, f"{' '.join(rng.choices(WORDS['bb'], k=20))} {i}", "bb") for i in range(300)]
    copies = [(10_000 + i, "kato mira selo", "aa") for i in range(5400)]
    docs = documents(texts + copies + [(1, "x" * 5000, "aa")])
    for most, size, want in ((50, 1 << 30, {"aa": 50, "bb": 50}), (1000, 1 << 30, {"aa": 302, "bb": 300}), (1000, 1, {"aa": 1, "bb": 1})):
        drawn = language_ppm.drawn_texts(docs, "lang", "text", most, size)
        assert {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()} == want
    model = language_ppm.fit(docs, sample_docs=60)
    found = {r.doc_id: r.lang_pred for r in language_ppm.identify(documents([(1, WORDS["aa"][0] + " " + WORDS["aa"][1]), (2, WORDS["bb"][0] + " " + WORDS["bb"][1])]), model).collect()}
    assert found == {1: "aa", 2: "bb"}
    labels = spark.createDataFrame([(i, int(i >= 290)) for i, *_ in texts[:300]] + [(i, 0) for i, *_ in copies], "doc_id bigint, quality int")
    read = site_quality.read_documents(documents(texts[:300] + copies))
    taught = read.select("doc_id", "mark", "features").join(labels.withColumnRenamed("quality", "label"), "doc_id").select("mark", "features", F.col("label").cast("double").alias("label"))
    for most in (5, 50, 400):
        rows, kinds = site_quality.drawn_texts(taught, most)
        assert len(rows) == len(kinds) <= min(most + 1, 301) and set(kinds) == {0.0, 1.0}


def test_pages_that_repeat_their_id(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "v", "same"), (0, "w", "same"), (2, "x", "own"), (None, "y", "same"), (3, "z", None), (3, "z", None)]
    out = warc.plan_records(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    told = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in out)
    assert told == sorted(
        [("1", "response", "None"), ("1", "revisit", "1"), ("1", "revisit", "1"), ("0", "revisit", "1"), ("2", "response", "None")]
        + [("None", "response", "None"), ("3", "response", "None"), ("3", "revisit", "3")]
    )


def test_shrinkage_follows_the_spread(spark):
    def groups(rates, n):
        return spark.createDataFrame([(f"h{i}", n, n * r, n * r) for i, r in enumerate(rates)], "host string, n bigint, good double, squares double")

    even = site_quality.shrinkage(groups([0.5] * 20, 100), F.lit(0.5))
    apart = site_quality.shrinkage(groups([0.1, 0.9] * 10, 100), F.lit(0.5))
    assert even == site_quality.MOST_SHRINKAGE and apart < 3


RULES = [url_trees.Rule("block", "net", "/"), url_trees.Rule("allow", "example.net", "/en/"), url_trees.Rule("block", "example.com", "/de/")]


def test_rules_and_parts(spark):
    cases = {
        "http://WWW.Example.NET/en/1?q=/#a": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://notexample.com/de/x": ("notexample.com", "/de/x", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "x://m.example.com/de/\n?": ("m.example.com", "/de/\n", "example.com/de/", "block"),
        "no scheme/net/": ("", "", None, "allow"),
        "ÀB://ÀB.net/": ("Àb.net", "/", "net/", "block"),
        None: ("", "", None, "allow"),
        "http://h/" + "p" * 20000: ("h", "/" + "p" * 20000, None, "allow"),
    }
    urls = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id bigint, url string, features string")
    labelled = spark.createDataFrame([("http://a/", None)], "url string, bad int")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_trees.judge(urls, labelled, RULES).collect()}
    assert got == cases
    assert url_trees.judge(urls.where("false"), labelled, RULES).collect() == []


def test_trees_learn_lexical_signs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 2
        path = "".join(rng.choices("0123456789", k=12)) if bad else "/".join(rng.choices(["news", "about", "help"], k=2))
        rows.append((f"http://h{i % 9}.example.org/{path}?{'a=1&b=2&c=3' if bad else ''}", bad))
    known = spark.createDataFrame(rows[:400], "url string, bad int")
    judged = url_trees.judge(spark.createDataFrame(rows[400:], "url string, bad int"), known, RULES).collect()
    assert np.mean([(r.verdict == "block") == bool(r.bad) for r in judged]) > 0.95


def test_archives(spark):
    pages = [(1, "http://a/\r\nx", "<p>one</p>"), (2, None, "<p>one</p>"), (5, "u", None), (4, "u", ""), (-3, "u", "é" * 9000), (None, "u", "<p>one</p>"), (9, "u", "last")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, payload string")
    folder = scratch_dir(spark, "warc")
    warc.write_warc(frame, folder, file_bytes=200)
    got = warc.read_warc(spark, folder).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert {k: (r.record_type, r.refers_to) for k, r in by.items() if k is not None} == {
        1: ("revisit", 2), 2: ("response", None), 5: ("response", None), 4: ("revisit", 5), -3: ("response", None), 9: ("response", None)
    }
    assert by[None].record_type == "response" and bytes(by[None].payload) == b"<p>one</p>"
    for page_id, _, html in pages[:5]:
        raw = (html or "").encode()
        assert (by[page_id].payload_length, by[page_id].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert by[page_id].payload is None if by[page_id].record_type == "revisit" else bytes(by[page_id].payload) == raw
    assert by[1].target_uri == "http://a/%0D%0Ax"
    only = warc.read_warc(spark, folder, payload=False).where("record_type = 'revisit' AND page_id IN (1, 2)")
    assert [(r.page_id, r.payload) for r in only.collect()] == [(1, None)]
    empty = scratch_dir(spark, "warc")
    warc.write_warc(frame.where("false"), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_unwanted_records_are_passed_over_and_damage_is_found():
    import io

    good = warc.write_record(1, "u", b"payload", None, False)
    broken = good.replace(b"sha1:", b"sha1:AAAA")
    rows = list(warc.read_records(io.BytesIO(broken + good), lambda row: not row[4].startswith("AAAA"), True))
    assert [r[7] for r in rows] == [b"payload"]
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(broken), lambda row: True, True))


def brute_nearest(rows, queries, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = {}
    for q in queries:
        if q in usable:
            a = usable[q]
            scored = [(-float(a @ b / np.sqrt((a @ a) * (b @ b))), i) for i, b in usable.items() if i != q]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def test_nearest_vectors(spark, vectors):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    rows = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(40)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [float("nan")] * 8), (5004, [None] + [1.0] * 7), (5005, [1.0, 2.0]), (None, base[3])]
    queries = [*range(0, 300, 10), 7, 1000, 1010, 5000, 5002, 99999]
    asked = spark.createDataFrame([(q,) for q in queries] + [(7,)], "query_id bigint")
    got = vector_tree.nearest(vectors(rows), asked, k=5, leaf_rows=20).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, queries, 5)
    assert set(mine) == set(want)
    assert mine[7] == want[7] and mine[1010] == want[1010]
    assert np.mean([len(set(mine[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    few = vectors(rows[:3])
    assert len(vector_tree.nearest(few, asked, k=5).where("query_id = 0").collect()) == 2
    assert vector_tree.nearest(vectors([]), asked).collect() == []


def test_crowded_leaves_are_split_and_queries_open_few_rows(spark, vectors, monkeypatch):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(60, 12))
    # A third of all rows lies about one middle.
    which = np.where(rng.random(4000) < 1 / 3, 0, rng.integers(0, 60, 4000))
    base = (middles[which] + 0.2 * rng.normal(size=(4000, 12))).round(6)
    rows = list(enumerate(base.tolist()))
    for name, value in (("NODE_SAMPLE", 200), ("PLACE_ROWS", 150), ("CELL_QUERIES", 15), ("LEAF_SAMPLE", 16)):
        monkeypatch.setattr(vector_tree, name, value)
    met = []
    plain = vector_tree._split

    def split(placed, leaf_rows):
        out = plain(placed, leaf_rows)
        sizes = [r["count"] for r in out[0].groupBy("node").count().collect()]
        met.append((len(out[1]), sum(sizes), max(sizes)))
        return out

    monkeypatch.setattr(vector_tree, "_split", split)
    queries = list(range(0, 4000, 50))
    asked = spark.createDataFrame([(q,) for q in queries], "query_id bigint")
    got = vector_tree.nearest(vectors(rows), asked, k=5, sample=64, leaf_rows=20).collect()
    levels, held, largest = met[0]
    assert levels >= 1 and held == 4000 and largest <= 400
    units = base / np.sqrt((base * base).sum(1, keepdims=True))
    near = units[queries] @ units.T
    near[np.arange(len(queries)), queries] = -2
    truth = {q: set(row.tolist()) for q, row in zip(queries, np.argsort(-near, axis=1)[:, :5], strict=True)}
    mine = {q: set() for q in queries}
    for r in got:
        mine[r.query_id].add(r.vec_id)
    assert np.mean([len(mine[q] & truth[q]) / 5 for q in queries]) >= 0.9


def test_nodes_name_their_way():
    node = int(vector_tree._below(int(vector_tree._below(77, np.array([5]))[0]), np.array([8000]))[0])
    assert vector_tree._ancestor(node, 0) == 77
    assert vector_tree._ancestor(node, 1) == int(vector_tree._below(77, np.array([5]))[0])
    assert vector_tree._ancestor(node, 2) == node and vector_tree._ancestor(77, 3) == 77


def test_archives_of_gzip_members(spark):
    pages = [(1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (5, "u", None), (4, "u", ""), (-3, "u", "é" * 9000), (None, "u", "<p>one</p>")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    folders = [scratch_dir(spark, "warc"), scratch_dir(spark, "warc")]
    tables = []
    for folder, gzipped in zip(folders, (False, True), strict=True):
        warc.write_warc(frame, folder, file_bytes=200, gzipped=gzipped)
        rows = warc.read_warc(spark, folder).drop("record_id").collect()
        tables.append(sorted((r.page_id is None, r.page_id, r.record_type, r.target_uri or "", r.payload_digest, r.payload_length, r.refers_to or 0, bytes(r.payload or b"")) for r in rows))
    assert tables[0] == tables[1]
    names = os.listdir(re.sub("^file:/*", "/", folders[1]))
    assert names and all(name.endswith(".warc.gz") for name in names)
    only = warc.read_warc(spark, folders[1]).where("record_type = 'response' AND page_id = -3").collect()
    assert [bytes(r.payload) for r in only] == [("é" * 9000).encode()]


def test_archives_of_other_writers(spark, tmp_path):
    page = b"<p>hello</p>"
    coded = gzip.compress(page)

    def record(kind, name, payload, extra, http):
        block = http + payload
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode()
        return gzip.compress(head + block + b"\r\n\r\n")

    served = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
    told = "Content-Type: application/http; msgtype=response\r\n"
    (tmp_path / "a.warc.gz").write_bytes(
        record("warcinfo", "<http://x/1>", b"software: other\r\n", "Content-Type: application/warc-fields\r\n", b"")
        + record("response", "<urn:uuid:00000000-0000-0000-0000-000000000001>", coded, told + f"WARC-Payload-Digest: sha1:{warc.digest(coded)}\r\n", served)
        + record("response", "<urn:uuid:00000000-0000-0000-0000-000000000002>", coded, told + f"WARC-Payload-Digest: SHA1:{warc.digest(page)}\r\n", served)
        + record("response", "<x>", page, told + "WARC-Payload-Digest: sha256:unknown\r\n", b"HTTP/1.1 200 OK\r\n\r\n")
    )
    (tmp_path / "_SUCCESS").write_bytes(b"")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [r.record_type for r in rows] == ["warcinfo", "response", "response", "response"]
    assert [r.page_id for r in rows] == [None] * 4
    assert [bytes(r.payload) for r in rows[1:]] == [page] * 3
    (tmp_path / "notes.txt").write_text("no archive")
    with pytest.raises(Exception, match="no archives"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_store_names():
    system, path = stores.open_store("file:///tmp/x")
    assert path == "/tmp/x" and system.type_name == "local"
    with pytest.raises(Exception, match="(?i)unrecognized"):
        stores.open_store("dbfs:/x")
