from __future__ import annotations

import random

import brute

from pulsegrid.llm import secrets


def test_random_texts():
    scan, rnd = secrets.automaton(), random.Random(1)
    parts = ["password", "PASSWD", "token", "api_key", "secret", "=", ":", " ", "'", '"', "AKIA", "A", "0", "f", "abcdef0123", "deadbeef", "é", "ghp_", "xoxb-", "AIza", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "\n", "_", "Zz9", "ſecret", "toKen", "/+"]
    for _ in range(5000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 40)))
        assert scan.spans(text.encode()) == brute.secrets(text), text


def test_minimal_automaton():
    scan = secrets.Automaton(secrets.BASE_RULES)
    assert scan.states <= scan.raw_states
    rows = {(tuple(scan.table[i]), scan.ends[i], scan.last[i]) for i in range(scan.states)}
    assert len(rows) == scan.states  # no two states are alike


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = secrets.find_secrets(edge_docs, out_col="found").select("doc_id", "spans", "found").collect()
    want = sorted((repr(d), brute.secrets(t)) for d, t in edge_rows)
    assert sorted((repr(r.doc_id), [tuple(x) for x in r.found]) for r in got) == want
    assert {r.spans for r in got} == {"s"}
    digest = {r.doc_id: r for r in secrets.secret_digest(edge_docs).collect()}
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute.secrets(edge_rows[3][1]) if k in ("assign", "access", "hex"))
    assert (digest[4].n_assign, digest[4].n_access, digest[4].n_hex, digest[4].base_sha256) == (1, 1, 1, brute.sha(base))
    assert digest[1].base_sha256 == brute.sha("") and digest[1].spans == ""
    masked = {repr(r.doc_id): r.text for r in secrets.redact_secrets(edge_docs).collect()}
    assert masked == {repr(d): brute.masked(t) for d, t in edge_rows}
    assert secrets.secret_digest(no_docs).count() == 0 and secrets.redact_secrets(no_docs).columns == no_docs.columns


def test_query(spark):
    from pulsegrid.llm.queries import queries

    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries()["op1_secret_scan"](spark, small).collect():
        spans = brute.secrets(texts[r.doc_id])
        told = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r.spans == ",".join(told)
        assert r.base_sha256 == brute.sha(",".join(x for x in told if x.split(":")[0] in ("assign", "access", "hex")))
