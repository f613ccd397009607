"""Randomness battery and discovery bounds against plain Python, and linear cost of many matches."""
import math
import random
import re
import string
import time

import brute
import pytest

from cadenza.llm import secrets

BINS = secrets.BINS
B62 = string.ascii_letters + string.digits


def battery(run):
    """(encoding, size class, p), or None where the tests have no power."""
    run = run.replace("=", "")
    if len(run) < 20:
        return None
    code, alphabet = next((i, a) for i, (pattern, a) in enumerate(secrets.ENCODINGS) if re.search(pattern, run))
    n, k = len(run), len(alphabet)
    if n * math.log2(k) < secrets.LEAST_BITS:
        return None
    tail = lambda z: 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3)) if 1.5976 * z + 0.07056 * z**3 < 700 else 0.0
    v = [alphabet.find(c) + 1 for c in run]
    chi = (k / n * sum(run.count(a) ** 2 for a in alphabet) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    high = [x > k / 2 for x in v]
    n1, turns = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    expected = 2 * n1 * (n - n1) / n + 1
    runs = abs(turns - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.25))
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = 99.0 if spread <= 0 else abs(sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / max(spread, 1e-9) + 1 / n) * math.sqrt(n)
    tests = [tail(chi), 2 * tail(runs), 2 * tail(serial)]
    if "A" in alphabet and "a" in alphabet:
        up, low = sum(c in string.ascii_uppercase for c in run), sum(c in string.ascii_lowercase for c in run)
        tests.append(2 * tail(abs(up - (up + low) / 2) / math.sqrt(max(up + low, 1) / 4)))
    return code, math.floor(2 * math.log2(n)), min(1.0, len(tests) * min(tests))


def scan(texts):
    """Random spans of each text, by the bounds of all of them."""
    found = []
    for i, t in enumerate(texts):
        base = [(a, b) for _, a, b in brute.secrets(t)]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t or ""):
            if not any(a < m.end() and m.start() < b for a, b in base) and (p := battery(m[0])):
                found.append((i, m.start(), m.end(), *p))
    bound = {}
    for key in {x[3:5] for x in found}:
        n = [0] * BINS
        for x in found:
            if x[3:5] == key:
                n[min(int(x[5] * BINS), BINS - 1)] += 1
        even = sum(n[BINS // 2 :]) / (BINS // 2)
        bound[key] = next((j for j in range(1, BINS) if sum(n[j:]) - even * (BINS - j) <= 0.05 * sum(n[j:]) + 2 * math.sqrt(sum(n[j:]))), BINS - 1) / BINS
    out = [[] for _ in texts]
    for i, a, b, code, size, p in found:
        if p > bound[code, size]:
            out[i].append((a, b))
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = sorted(secrets.scan_secrets(df).collect(), key=lambda r: r.doc_id)
    return [[(s["start"], s["stop"]) for s in r.spans if s["kind"] == 3] for r in rows]


def keys(alphabet, n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=size)) for _ in range(n)]


def camel(n, seed):
    rng = random.Random(seed)
    words = "get set user account value string index buffer result handler session request parser config service manager token count".split()
    return ["".join([rng.choice(words), *(rng.choice(words).capitalize() for _ in range(4))]) + str(rng.randrange(10)) for _ in range(n)]


def test_random_spans_equal_plain_python(spark):
    rng = random.Random(4)
    texts = [t for _, t in brute.ROWS if t is None or len(t) < 5000]
    for a in (string.ascii_lowercase, string.ascii_letters, string.digits, "0123456789ABCDEF", B62, B62 + "+/", B62 + "-_"):
        texts += [f"x {k} y" for k in keys(a, 25, rng.randrange(24, 60), len(a))]
    texts += [f"{c} and {d}" for c, d in zip(camel(60, 1), camel(60, 2))]
    texts += ["/usr/local/share/applications/menu-file_name", "A" * 40, "=" * 30, "AKIA" + "Q" * 20 + " " + keys(B62, 1, 40, 9)[0]]
    assert run(spark, texts) == scan(texts)


@pytest.mark.parametrize("alphabet,size", [(string.ascii_letters, 32), (string.ascii_lowercase, 32), (B62, 20), (B62, 40), ("0123456789ABCDEF", 24), (string.digits, 40)])
def test_random_keys_are_found(alphabet, size):
    """Letters only, digits only and mixed: 0.95 of the random ones pass at the least bound."""
    p = [battery(k)[2] for k in keys(alphabet, 2000, size, size)]
    assert sum(x > 1 / BINS for x in p) >= 0.95 * len(p)


def test_identifiers_are_not_reported(spark):
    names = [c for c in camel(600, 3) if len(c) >= 20]
    texts = [f"call {c} now" for c in names] + [f"key {k}" for k in keys(B62, 200, 32, 5)]
    got = run(spark, texts)
    assert sum(map(bool, got[: len(names)])) <= 0.05 * len(names)
    assert sum(map(bool, got[len(names) :])) >= 0.95 * 200


def test_many_matches_in_one_text_take_linear_time(spark):
    run(spark, ["warm up AKIA" + "B" * 16])
    began = time.time()
    text = " ".join(f"AKIA{i:016d}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.scan_secrets(df).selectExpr("size(base) n", "size(spans) m", "base[99999].stop e").first()
    assert (row.n, row.m, row.e) == (100_000, 100_000, len(text))
    assert time.time() - began < 40
