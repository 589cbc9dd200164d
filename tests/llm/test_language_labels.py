"""Every label is a language, and a table without labels keeps its texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from pulsegrid.llm import langid


def test_every_label_is_a_language(spark):
    """80 made-up languages, each with words of its own; those of the fewest documents included."""
    rng = random.Random(3)
    rows, n = [], 0
    for i in range(80):
        code = chr(97 + i // 26) + chr(97 + i % 26) + "x"
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
        for _ in range(12 if i < 64 else 6):
            rows.append((n, " ".join(rng.choice(words) for _ in range(60)), code, f"http://h{i}.org/x"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert len(langid.fit_text(docs).languages) == 80
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(found) == n and all(found[d].lang == code and found[d].accepted for d, _, code, _ in rows)


def test_texts_without_any_label_are_accepted(spark):
    rows = [(1, "some words without a label", None, None), (2, "1234 5678", None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id: (r.lang, r.accepted) for r in langid.identify(docs).collect()} == {1: ("und", True), 2: ("und", False), 3: ("und", False)}


def test_fusion_against_brute_force(spark):
    """All counts, smoothed priors and posteriors again in plain Python, from the model's likelihoods; repeated rows and nulls included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10_001, None, "en", "src1"), (10_002, "und so weiter", None, None), (10_002, "und so weiter", None, None), (10_003, "no label here", "XX-y", "http://a.b.org/x")], docs.schema)
    docs = docs.unionByName(odd)
    model = langid.fit_text(docs)
    names = [*model.languages, "und"]
    rows = []
    for r in docs.collect():
        n, ll = model.score((r.text or "").encode())
        code = re.match(r"\s*([a-z]+)", (r.lang or "").lower())
        address = (r.source or "").lower()
        host = re.search("://([^/?#]*)", address)[1] if "://" in address else address
        end = re.search(r"\.([^.:]+)(:[0-9]*)?$", host)
        rows.append((r.doc_id, n, ll, code[1] if code else None, host, end[1] if end else "", names[int(np.argmax(ll))] if n else "und"))
    said, hosts, ends = Counter(), Counter(), Counter()
    for _, n, _, declared, host, end, best in rows:
        if best != "und":
            vote = min(1.0, n / langid.VOTE)
            hosts[host, best] += vote
            ends[end, best] += vote
            if declared:
                said[declared if declared in model.languages else "", best] += 1
    smooth = lambda counts, prior: [(c + langid.STRENGTH * p) / (sum(counts) + langid.STRENGTH) for c, p in zip(counts, prior, strict=True)]
    total = [sum(v for (_, x), v in ends.items() if x == name) for name in model.languages]
    flat = [(x + 1) / (sum(total) + len(total)) for x in total]
    found = Counter((r.doc_id, r.lang, r.posterior, r.text_lang, r.declared, r.host) for r in langid.identify(docs, model=model).collect())
    want = Counter()
    for d, n, ll, declared, host, end, best in rows:
        if not n:
            want[d, "und", 0.0, best, declared, host] += 1
            continue
        prior = flat
        if any(h == host for h, _ in hosts):
            prior = smooth([hosts[host, x] for x in model.languages], smooth([ends[end, x] for x in model.languages], flat))
        logs = [x * langid.EVIDENCE / (n + langid.EVIDENCE) for x in ll]
        logs = [x + math.log(p * (1 - langid.PRIOR_UNKNOWN)) for x, p in zip(logs, prior, strict=False)] + [logs[-1] + math.log(langid.PRIOR_UNKNOWN)]
        if declared:
            key = declared if declared in model.languages else ""
            of = lambda x: sum(v for (_, y), v in said.items() if y == x)
            logs = [x + math.log((said[key, y] + 1) / (of(y) + len(names))) for x, y in zip(logs, model.languages, strict=False)] + [logs[-1] - math.log(len(names))]
        top = max(logs)
        want[d, names[logs.index(top)], round(1 / sum(math.exp(x - top) for x in logs), 6), best, declared, host] += 1
    near = lambda counter: {k[:2] + (round(k[2], 4),) + k[3:]: v for k, v in counter.items()}
    assert near(found) == near(want)
