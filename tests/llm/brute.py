"""Plain versions of the operators, to hold them against."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

_CASED = "".join  # the keyword's letters count in either case, ASCII only
_WORDS = "|".join(_CASED(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
_KEY = "[aA][pP][iI]_?[kK][eE][yY]"
SECRETS = [
    ("assign", re.compile(rf"""({_WORDS}|{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ("github", re.compile("gh[pousr]_([A-Za-z0-9]+)"), lambda m: len(m[1]) >= 36),
    ("slack", re.compile("xox[abprs]-([A-Za-z0-9-]+)"), lambda m: len(m[1]) >= 10),
    ("google", re.compile("AIza([A-Za-z0-9_-]+)"), lambda m: len(m[1]) >= 35),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)"), lambda m: len(m[1]) >= 10),
    ("pem", re.compile("-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"), lambda m: True),
]


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    found = sorted((m.start(), i, k, m.end()) for i, (k, p, fits) in enumerate(SECRETS) for m in p.finditer(text or "") if fits(m))
    return [(k, s, e) for s, _, k, e in found]


def masked(text: str | None) -> str | None:
    out, at = [], 0
    for kind, start, end in secrets(text):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return None if text is None else "".join([*out, text[at:]])


_SPACE = " \t\n\x0b\x0c\r"
_ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def kept_lines(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """doc_id → lines, dropped lines, kept text."""
    held: dict[str, set[int]] = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            k = x.strip(_SPACE).translate(_ASCII)
            if len(k) >= 20:
                held.setdefault(k, set()).add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(k := x.strip(_SPACE).translate(_ASCII)) >= 20 and len(held[k]) >= 3 and d != max(held[k]))]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(_ASCII).encode())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple[int, int]]) -> dict[int, int]:
    """doc_id → smallest doc_id that it reaches; docs are (doc_id, fingerprint)."""
    ids, fps = [d for d, _ in docs], np.array([f for _, f in docs], dtype=np.uint64)
    up = {d: d for d in ids}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 4)[0]:
            a, b = top(ids[i]), top(ids[j])
            up[max(a, b)] = min(a, b)
    return {d: top(d) for d in ids}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _mix(h: int, seed: int) -> int:
    z = h + 0x9E3779B97F4A7C15 * seed & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return z ^ z >> 31


def sketch(text: str | None, shingle: int = 5) -> tuple[int, ...]:
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return (0,) * 4
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    out = []
    for seed in range(4):
        own = [_mix(h, seed) if seed else h for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return tuple(out)


def jaccard(one: str | None, two: str | None, shingle: int = 5) -> float:
    sets = []
    for text in (one, two):
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets.append({" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def alike(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id → the smallest id of its group: all pairs of sketches that share a key and are near in a half, and of texts whose sets of shingles are alike to 0.8."""
    from pulsegrid.llm import simhash

    made = [(d, sketch(t)) for d, t in docs]
    keys = []
    for _, s in made:
        own = [set(simhash.fuzzy_keys(np.array([x], dtype=np.uint64))[0].tolist()) for x in s]
        keys.append(own)
    group = list(range(len(made)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(made)):
        for j in range(i):
            a, b = made[i][1], made[j][1]
            near = any(sum((a[w] ^ b[w]).bit_count() for w in half) <= simhash.SKETCH_BITS and (any(keys[i][w] & keys[j][w] for w in half) or all(a[w] == b[w] for w in half)) for half in ((0, 1), (2, 3)))
            if near and jaccard(docs[i][1], docs[j][1]) >= 0.8:
                group[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(made):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, (d, _) in enumerate(made)}
