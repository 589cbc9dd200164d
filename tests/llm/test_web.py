from __future__ import annotations

import gzip
import zlib

import numpy as np
import pytest
from oracle import compare, views
from pyspark.sql import functions as F

from pulsegrid.llm import langid, mtree, urlfilter, warc
from pulsegrid.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


@pytest.mark.parametrize("name", ["op6_url_filter", "op7_warc", "op10_top_k"])
def test_twins(spark, con, name):
    compare(queries()[name](spark, SMALL), con, oracle_sql()[name])


URLS = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/x", "https://EXAMPLE.org/es/1", "https://x.example.org/en/1?q", "https://example.org/en/2#f", "http://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/", "http://com/de/1", "http://a.net/listed/?utm_source=x", "http://www.a.net/listed", "http://b.net/x?y://z", "x://y\n.net/a"]


def test_url_edges(spark):
    pages = spark.createDataFrame([(i % 12, u, "h", "m", True) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, maybe string, found boolean")
    listed = spark.createDataFrame([("a.net/listed",), ("a.net/listed",), ("",), (None,)], "canonical string")
    rows = urlfilter.judge(pages, listed).collect()
    assert len(rows) == 2 * len(URLS)
    verdict = {(r.host, r.path): (r.rule, r.verdict) for r in rows}
    assert verdict["", ""] == (None, "allow")
    assert verdict["a.org", ""] == (None, "allow") and verdict["a.org", "/x"] == ("org/", "allow")
    assert verdict["example.org", "/es/1"] == ("example.org/es/", "block") and verdict["x.example.org", "/en/1"] == ("example.org/en/1", "block")
    assert verdict["example.org", "/en/2"] == ("org/", "allow") and verdict["notexample.org", "/es/"] == ("org/", "allow")
    assert verdict["a.com", "/fr/1"] == ("com/fr/", "allow") and verdict["com", "/de/1"] == ("com/de/", "block")
    assert verdict["a.net", "/listed/"] == (None, "block") and verdict["www.a.net", "/listed"] == (None, "block") and verdict["b.net", "/x"] == (None, "allow")
    assert all(r.verdict == "allow" for r in urlfilter.judge(pages, listed.limit(0)).collect() if r.rule is None)
    assert urlfilter.judge(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negatives(spark):
    hashes = spark.range(4000).selectExpr("xxhash64(id) as h")
    bloom = urlfilter.build_filter(hashes, most_blocks=64)
    values = np.array([r.h for r in hashes.collect()])
    assert bloom.maybe(values).all()
    sparse = urlfilter.build_filter(hashes.limit(500))
    assert sparse.maybe(np.array([r.h for r in spark.range(10_000, 20_000).selectExpr("xxhash64(id) as h").collect()])).mean() < 0.05


def test_hosts_cover_their_pages(spark):
    pages = spark.createDataFrame([(1, "http://www.a.net/x/?utm_source=1"), (2, "http://m.b.bad.net/y?q=1"), (3, "http://bad.net.good.net/"), (4, "http://single/x"), (5, "http://p.net/q?z=1#f"), (6, "http://p.net/other")], "page_id long, url string")
    listed = spark.createDataFrame([("a.net/x",), ("bad.net",), ("p.net/q",), ("never.net/seen",)], "canonical string")
    rows = {r.page_id: (r.verdict, r.listed) for r in urlfilter.judge(pages, listed).collect()}
    assert rows == {1: ("block", "a.net/x"), 2: ("block", "bad.net"), 3: ("allow", None), 4: ("allow", None), 5: ("block", "p.net/q"), 6: ("allow", None)}


def test_false_positives_are_removed(spark):
    """A filter that is far too small lets most pages through, with the same verdicts; repeated page ids are judged each."""
    pages = spark.range(4000).select((F.col("id") % 7).alias("page_id"), F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    listed = spark.range(0, 8000, 2).select(F.concat(F.lit("h.net/"), F.col("id")).alias("canonical"))
    seen = urlfilter.filter_report(pages, listed, most_blocks=64).first()
    assert seen.listed == 2000 and seen.passed > 3000
    rows = urlfilter.judge(pages, listed, most_blocks=64).collect()
    assert len(rows) == 4000 and all((r.verdict == "block") == (int(r.path[1:]) % 2 == 0) for r in rows)


def test_arc_versions():
    for version in (1, 2):
        name = f"x{version}.arc"
        body = warc.arc_head(version, name) + warc.arc_record(version, name, 0, "http://a b/", "20260102030405", b"head\r\n\r\nbody\nwith lines") + warc.arc_record(version, name, 9, "u", "20260102030406", b"")
        for content in (body, gzip.compress(body), gzip.compress(body[:80]) + gzip.compress(body[80:])):
            rows = list(warc.parse_arc(content))
            assert [(r["URL"], r["Archive-date"], r["block"]) for r in rows] == [("http://a%20b/", "20260102030405", b"head\r\n\r\nbody\nwith lines"), ("u", "20260102030406", b"")]
            assert ("Result-code" in rows[0]) == (version == 2)
    assert len(list(warc.parse_arc(body[:-12]))) == 1  # a header line that is cut off
    assert [r["short"] for r in warc.parse_arc(body[: body.index(b"with lines")])] == [True]


def test_warc_edges(spark):
    body = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nzz\r\n\r\n"
    data = [(1, "http://a", body), (2, None, body), (3, "http://a b\nc", None), (4, "http://c", ""), (5, "u", "é" * 300_000), (None, "v", body), (7, "w", "own"), (7, "w", "own"), (None, "n", "lone"), (None, "n2", "lone")]
    rows = warc.convert_pages(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)).collect()
    n = len(body)
    want = [(1, n, "response", None), (2, n, "revisit", 1), (None, n, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 600_000, "response", None)]
    want += [(7, 3, "response", None)] * 2 + [(None, 4, "response", None)] * 2
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows))) == sorted(map(repr, want))
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_bytes_in_any_charset(spark):
    data = [(1, b"http://a/\xff", b"caf\xe9"), (2, b"http://b", bytes(range(256)) * 50), (3, b"http://c", b"caf\xe9")]
    pages = spark.createDataFrame(data, "page_id long, url binary, html binary")
    rows = {r.page_id: (r.payload_bytes, r.record_type, r.payload_digest) for r in warc.convert_pages(pages).collect()}
    assert rows == {1: (4, "response", warc.sha1_base32(b"caf\xe9")), 2: (12800, "response", warc.sha1_base32(bytes(range(256)) * 50)), 3: (4, "revisit", warc.sha1_base32(b"caf\xe9"))}


def test_every_record_is_a_member_with_its_own_id(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string").coalesce(1)
    warc.write_volumes(warc.arc_volumes(pages), f"{tmp_path}/arc")
    warc.write_volumes(warc.warc_volumes(warc.arc_records(warc.read_volumes(spark, f"{tmp_path}/arc"))), f"{tmp_path}/warc")
    (content,) = [r.content for r in warc.read_volumes(spark, f"{tmp_path}/warc").collect()]
    members = []
    while content:
        part = zlib.decompressobj(31)
        members.append(part.decompress(content))
        content = part.unused_data
    assert [m[:8] for m in members] == [b"WARC/1.1"] * 3 + [b""]
    ids = [next(warc.parse_warc(m))[0]["WARC-Record-ID"] for m in members[:3]]
    assert len(set(ids)) == 3
    assert next(warc.parse_warc(members[2]))[0]["WARC-Refers-To"] == ids[0]


def test_small_payloads_can_stay_apart(spark):
    data = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    rows = warc.convert_pages(spark.createDataFrame(data, "page_id long, url string, html string"), least_bytes=5).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_top_k_edges(spark):
    rnd = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rnd.normal(size=4)]) for i in range(200)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 260)]
    odd = [(None, [1.0] * 4), (300, None), (301, [float("nan")] * 4), (302, [1.0, None, 0.0, 0.0]), (320, [float("inf"), 0.0, 0.0, 0.0])]
    rows = mtree.top_k(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>")).collect()
    q = {i: np.floor(64 * np.array(v)).astype(int) for i, v in vectors}
    want = []
    for i in (i for i in q if i % 20 == 0):
        best = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i))[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in rows) == sorted(want)
    few = mtree.top_k(spark.createDataFrame(vectors[:5], "vec_id long, embedding array<double>")).collect()
    assert len(few) == 4
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_tree_prunes():
    """Where vectors cluster, the stored distances spare most of them."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16)) * 400
    x = np.floor(centres[rnd.integers(0, 40, 8000)] + rnd.normal(size=(8000, 16)) * 8).astype(np.int64)
    tree = mtree.MTree(np.arange(8000), x)
    scored = 0
    for i in range(0, 8000, 400):
        ids, scores, n = tree.search(i, x[i], 20)
        order = sorted((-int(s), int(j)) for j, s in enumerate(x @ x[i]) if j != i)[:20]
        assert [(-int(s), int(j)) for j, s in zip(ids, scores, strict=True)] == order
        scored += n
    assert scored < 20 * 8000 / 2


def test_language_held_out(spark):
    """Fitted on every second document, judged on the others without their declared language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_text(docs.where("doc_id % 2 = 0"))
    from pyspark.sql import functions as F

    blind = docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string"))
    found = {r.doc_id: r for r in langid.identify(blind, model=model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("doc_id % 2 = 1").collect()}
    assert len(found) == len(truth)
    assert sum(found[d].lang == lang for d, lang in truth.items()) >= 0.97 * len(truth)
    assert sum(r.accepted for r in found.values()) >= 0.99 * len(truth)


def test_language_edges(spark, edge_docs, no_docs):
    rows = {r.doc_id: r for r in langid.identify(edge_docs).collect()}
    assert all((rows[d].lang, rows[d].accepted) == ("und", False) for d in (1, 2, 3, 15))
    assert rows[10].lang == "en" and rows[10].accepted
    assert langid.identify(no_docs).count() == 0
    unlabelled = langid.identify(edge_docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source")).collect()
    assert {r.lang for r in unlabelled} == {"und"}


def test_language_of_pages(spark):
    pages = langid.page_evidence(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rows = langid.identify(pages, "page_id").collect()
    assert sum(r.lang == r.declared for r in rows) >= 0.97 * len(rows)
    assert {r.host for r in rows if r.host.endswith(".org")}


def test_hosts_lend_evidence(spark):
    """A short text of no language in particular follows its host."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'fr')")
    from pyspark.sql import functions as F

    docs = docs.withColumn("source", F.concat(F.lit("http://h"), (F.col("doc_id") % 3).cast("string"), F.lit("."), "lang", F.lit("/p")))
    extra = spark.createDataFrame([(90_001, "e", None, "http://h0.fr/x", 1), (90_002, "e", None, "http://h0.en/x", 1)], docs.schema)
    found = {r.doc_id: r.lang for r in langid.identify(docs.unionByName(extra)).where("doc_id > 90000").collect()}
    assert found == {90_001: "fr", 90_002: "en"}


@pytest.mark.parametrize("clusters", [1, 12])
def test_top_k_over_many_blocks(spark, monkeypatch, clusters):
    """Small blocks: both rounds run, several blocks a region, repeated vec_ids and query ids; as all products give it."""
    for name, value in (("BLOCK", 64), ("PAGE", 16), ("FANOUT", 4), ("GROUP", 3), ("QUERIES", 20), ("FEW", 4)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 8)) * (0 if clusters == 1 else 6)
    x = centres[rng.integers(clusters, size=1500)] + rng.normal(size=(1500, 8))
    x[200:500] = x[200]  # a vector that a fifth of the rows repeat
    ids = [i % 1400 for i in range(1500)]  # the last ids are repeated, queries among them
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    q = np.floor(64 * x).astype(np.int64)
    got = {}
    for r in mtree.top_k(frame, k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries_ = {i for i in ids if i % 20 == 0}
    assert set(got) == queries_
    for i in queries_:
        own = min((tuple(v) for k, v in zip(ids, q, strict=True) if k == i))
        scores = q @ np.array(own)
        want = sorted(((-int(s), k) for k, s in zip(ids, scores, strict=True) if k != i))[:7]
        assert sorted(got[i]) == [(n, k, -s) for n, (s, k) in enumerate(want, 1)]


def test_trees_are_laid_for_the_queries_of_their_group(spark, monkeypatch):
    monkeypatch.setattr(mtree, "GROUP", 2)
    monkeypatch.setattr(mtree, "QUERIES", 10)
    trees = spark.createDataFrame([(b, b"t") for b in range(6)], "block int, tree binary")
    shape = "group int, first int, last int, own int, id long, v array<long>, least long"
    asked = spark.createDataFrame([(0, 0, 1, -1, i, [1], 0) for i in range(25)] + [(2, 4, 4, 5, i, [1], 0) for i in range(3)], shape)
    rows = mtree.with_trees(trees, asked, 3, 1).collect()
    laid = sorted((r.group, r.part, r["first"]) for r in rows if r.tree)
    assert laid == [(0, p, b) for p in range(3) for b in (0, 1)] + [(2, 0, 4), (2, 0, 5)]
    assert sum(r.tree is None for r in rows) == 28
