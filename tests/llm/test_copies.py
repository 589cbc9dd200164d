from __future__ import annotations

import hashlib
import random
import re

import brute
import numpy as np
from oracle import compare, views
from pyspark.sql import functions as F

from pulsegrid.llm import common, linededup, merkle, simhash

SMALL = "/root/testdata/sf0.001"


def test_keys_are_shared_up_to_four_bits():
    rnd = np.random.default_rng(1)
    fps = rnd.integers(0, 2**64, 500, dtype=np.uint64)
    for d in range(5):
        other = fps.copy()
        for i in range(len(other)):
            for b in rnd.choice(64, d, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        one, two = simhash.fuzzy_keys(fps), simhash.fuzzy_keys(other)
        shared = {r for r, _ in set(zip(one[1].tolist(), one[0].tolist())) & set(zip(two[1].tolist(), two[0].tolist()))}
        assert len(shared) == len(fps)


def test_golay_code():
    """The code is perfect: each syndrome has one error of weight 3 or less, and only those of weight 3 have five more of weight 4."""
    _, errors = simhash._golay()
    weights = np.bitwise_count(errors.astype(np.uint64))
    assert errors.shape == (2048, 6) and (weights[:, 0] <= 3).all()
    three = weights[:, 0] == 3
    assert three.sum() == 1771 and (weights[three, 1:] == 4).all() and (errors[~three] == errors[~three, :1]).all()
    assert all(len(set(row)) == 6 for row in errors[three].tolist())


def test_links_of_a_dense_group(spark):
    """A group of near copies, in which most pairs are linked, and strangers."""
    rnd = np.random.default_rng(2)
    near = {int(0x0123456789ABCDEF) ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 5), replace=False)) for _ in range(1500)}
    fps = sorted(near | {int(x) for x in rnd.integers(0, 2**64, 300, dtype=np.uint64)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node long, fp long")
    links = simhash.near_links(df)
    named = links.join(df.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(df.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    assert links.count() < 40_000  # a forest, not all pairs
    roots = {r.node: r.root for r in simhash.components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")), df).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == brute.components(list(enumerate(fps)))


def test_chain(spark):
    """A long chain ends in one component."""
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    assert {r.root for r in simhash.components(links, links).collect()} == {1}


def test_near_duplicates_edges(spark, edge_docs, edge_rows, no_docs):
    rows = {repr(r.doc_id): r for r in simhash.near_duplicates(edge_docs).collect()}
    known = [(d, brute.fingerprint(t)) for d, t in edge_rows if d is not None]
    want = brute.components(known)
    for d, f in known:
        assert (rows[repr(d)].fingerprint, rows[repr(d)].component_id) == (f"{f:016x}", want[d])
    assert rows["None"].fingerprint == f"{brute.fingerprint(edge_rows[13][1]):016x}"
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_query(spark):
    from pulsegrid.llm.queries import queries

    docs = [(r.doc_id, brute.fingerprint(r.text)) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute.components(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op4_simhash"](spark, SMALL).collect()} == {d: (f"{f:016x}", want[d]) for d, f in docs}


def test_likely_rows(spark):
    """All rows that are wanted, a null id among them, and hardly any other."""
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), (F.col("id") % 7).alias("key"), F.lit("s").alias("spot"))
    wanted = rows.where("id is null or id % 10 = 0").select("id", "key")
    got = {r.id for r in common.likely(rows, wanted, "id", "key").collect()}
    assert {r.id for r in wanted.collect()} <= got and len(got) <= 2_000 + 20
    assert common.likely(rows, wanted.limit(0), "id", "key").count() == 0


def test_texts_without_candidates_stay_where_they_are(spark):
    """Of many long texts two are alike: where the list of candidates wasn't broadcast, all texts were shuffled."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=20_000)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (150, texts[0] + " more"), (150, texts[0] + " more"), (None, texts[1])], "doc_id long, text string").repartition(8)
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    none = sc._jvm.java.util.ArrayList()
    written = lambda: sum(x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)))
    docs = common.write_table(docs, "docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        gone = {r.doc_id for r in simhash.similar_copies(docs).collect()}
        moved = written() - began
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert gone == {150, None}
    assert moved < sum(map(len, texts)) / 4


def test_line_dedup_edges(spark, edge_docs, edge_rows, no_docs):
    want = brute.kept_lines([(d, t) for d, t in edge_rows if d is not None])
    rows = {r.doc_id: r for r in linededup.dedup_lines(edge_docs).collect()}
    assert {d: (rows[d].n_lines, rows[d].n_dropped, rows[d].text) for d in want} == want
    assert rows[None].text == edge_rows[13][1] and rows[None].key == "k"
    assert (rows[5].keep_bitmap, rows[7].keep_bitmap) == ("0:2", "")
    assert linededup.line_digest(no_docs).count() == 0


def test_line_dedup_many_lines(spark):
    """Bitmaps of more than one word, and a line that a document repeats."""
    text = lambda d: "\n".join([f"line number {i} of document {d} alone" if i % 3 else "the very same line in all of them" for i in range(100)])
    docs = [(d, text(d)) for d in range(4)]
    want = brute.kept_lines(docs)
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == want


def test_line_dedup_query(spark):
    from pulsegrid.llm.queries import oracle_sql, queries

    compare(queries()["op5_line_dedup"](spark, SMALL), views(SMALL), oracle_sql()["op5_line_dedup"])


def check_merkle(rows, docs):
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        new = merkle.edited(t, nxt)
        half = len(t) // 2
        assert new == t[: len(t) - half] + nxt[:half]
        r = rows[repr(d)]
        one, two, three = merkle.tree(t), merkle.tree(new), merkle.tree(nxt)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), brute.sha(new), one.told(), two.told())
        assert (r.near_edited, r.near_next) == (merkle.likeness(one, two), merkle.likeness(one, three))


def test_merkle_edges(spark, edge_docs, edge_rows, no_docs):
    rows = {repr(r.doc_id): r for r in merkle.fingerprint_documents(edge_docs).collect()}
    check_merkle(rows, edge_rows)
    assert rows["10"].fingerprint == rows["11"].fingerprint and rows["10"].near_next == 1.0
    assert merkle.fingerprint_documents(no_docs).count() == 0
    sole = merkle.fingerprint_documents(edge_docs.where("doc_id = 13")).first()
    assert sole.near_next == 1.0


def plain_root(text):
    """The root by the book: 128-bit BLAKE2b of sections of paragraphs of leaves."""
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    sections, nodes = [], []
    for paragraph in text.split("\n"):
        sentences = re.findall(r"[^.!?]+[.!?]*\s*|[.!?]+\s*", paragraph)
        leaves = [y for x in sentences for y in ([x] if len(x) <= 64 else re.findall(r"\s*(?:\S+\s*){1,6}|\s+", x))]
        assert "".join(leaves) == paragraph
        nodes.append(h(b"p" + b"".join(h(x.encode()) for x in leaves)))
        if not leaves or nodes[-1][0] % 4 == 0:
            sections.append(h(b"s" + b"".join(nodes)))
            nodes = []
    if nodes:
        sections.append(h(b"s" + b"".join(nodes)))
    return h(b"r" + b"".join(sections)).hex()


def test_merkle_root_by_the_book():
    rnd = random.Random(8)
    for _ in range(200):
        text = "\n".join(" ".join(rnd.choices(["word", "é", "end.", "why?", "!", "a" * 70], k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 6)))
        assert merkle.tree(text).told().split(":")[0] == plain_root(text)


def test_merkle_of_ids_that_many_rows_share(spark):
    """A third of all rows has one id, another third none: the order goes on by the hash of the text, over many partitions."""
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text number {i} of some words") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = [tuple(r) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.expr("xxhash64(cast(text as binary))")).collect()]
    want = sorted((repr(d), brute.sha(merkle.edited(t, order[(i + 1) % 300][1]))) for i, (d, t) in enumerate(order))
    assert sorted((repr(r.doc_id), r.edited_sha256) for r in merkle.fingerprint_documents(docs).collect()) == want


def test_merkle_query(spark):
    from pulsegrid.llm.queries import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check_merkle({repr(r.doc_id): r for r in queries()["op9_merkle"](spark, SMALL).collect()}, docs)


def test_merkle_trees():
    text = "One sentence here. Another one.\n\nA second part. " + "many words in a row " * 40
    assert all("".join(merkle.leaves_of(p)) == p for p in text.split("\n"))
    assert merkle.parse(merkle.tree(text).told()).told() == merkle.tree(text).told()
    assert merkle.edits(text, text.replace("Another", "Changed")) == [(19, 31)]
    assert merkle.edits(text, text) == [] and merkle.likeness(merkle.tree(text), merkle.tree(text)) == 1.0
    assert merkle.tree(text).root != merkle.tree(text + " ").root and merkle.tree("a\nb").root != merkle.tree("ab").root


def test_line_dedup_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(d, "the same line in each of them", 7, "w") for d in range(3)], "doc_id long, text string, _lines int, word string")
    rows = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert [rows[d].text for d in range(3)] == ["", "", "the same line in each of them"]
    assert {(r._lines, r.word) for r in rows.values()} == {(7, "w")}
