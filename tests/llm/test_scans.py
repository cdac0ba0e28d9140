"""Secrets, personal data and mixing against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from prepflow.llm import mixing, pii, queries, secrets

SCHEMA = "doc_id bigint, text string, found string, source string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "f", "s") for i, t in texts], SCHEMA)


ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets_brute(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def pii_brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m)) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def noise(rng, parts, n):
    return "".join(rng.choice(parts) for _ in range(n))


SECRET_PARTS = [
    "password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCD1234", "Z9",
    "0123456789abcdef", "f", "g", "é", "日本", "-----BEGIN ", "\n", "x1.y-z", "ghp_", "\0", "İ",
]
PII_PARTS = [
    "a", "b.c", "@", ".", "-", "1", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
    "+", " ", "é", "x_y%", ".com", "(", ")", "日本", "\n", "00000000000000", "DE89 3704 0044 0532 0130 00",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_secrets(spark, seed):
    rng = random.Random(seed)
    texts = [(i, noise(rng, SECRET_PARTS, rng.randrange(1, 60))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, "a" * 31 + "é" + "b" * 32), (None, "token=abcdefgh"), (902, "x")]
    texts.append((903, "é " * 50_000 + "secret: 12345678 " * 3))
    out = secrets.scan_secrets(docs_of(spark, texts))
    digests = queries.span_digests(out, secrets.BASE_KINDS, secrets.KINDS).collect()
    got = sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in digests)
    want = []
    for i, t in texts:
        spans = secrets_brute(t or "")
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        want.append((str(i), hashlib.sha256(listed(spans).encode()).hexdigest(), *counts))
    assert got == sorted(want)
    assert secrets.scan_secrets(docs_of(spark, texts).limit(0)).count() == 0


def test_checksums_of_tokens():
    body = b"A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = b"x ghp_" + body + secrets.base62_crc(body) + b" "
    bad = b"x ghp_" + body + b"AAAAAA "
    words = secrets.automaton()
    kinds = lambda data: [s[0] for s in secrets.find_secrets(data, words)]
    assert "checked_token" in kinds(good) and "checked_token" not in kinds(bad)
    assert kinds(b"-----BEGIN RSA PRIVATE KEY-----") == ["private_key"]


@pytest.mark.parametrize("seed", [1, 2])
def test_personal_data(spark, seed):
    rng = random.Random(seed)
    texts = [(i, noise(rng, PII_PARTS, rng.randrange(1, 40))) for i in range(250)]
    texts += [(900, None), (901, ""), (902, "a@b.c_d@e.f@g.h 1.2.3.4.5.6.7.8"), (None, "x@y.zz"), (902, "x")]
    texts += [(903, "9" * 20_000), (904, "a" * 50_000 + "@"), (905, "1.2.3.4 " * 700 + "é@b.c d@e.f")]
    out = pii.find_personal_data(docs_of(spark, texts))
    digests = queries.span_digests(out, pii.BASE_KINDS, pii.KINDS).collect()
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in digests)
    want = []
    for i, t in texts:
        spans = pii_brute(t) if t and len(t) < 20_000 else []
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        want.append((str(i), hashlib.sha256(listed(spans).encode()).hexdigest(), *counts))
    assert got == sorted(want)
    assert pii.find_personal_data(docs_of(spark, texts).limit(0)).count() == 0


def test_added_kinds_and_context(spark):
    text = "My IBAN is DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; call +1 017 555 7713 or ssn 123-45-6789"
    found = pii.find_personal_data(docs_of(spark, [(1, text)])).first()["found"]
    assert [s["kind"] for s in found if s["kind"] != "card"] == ["iban", "phone", "ssn"]
    iban = next(s for s in found if s["kind"] == "iban")
    assert text[iban["start"] : iban["end"]] == iban["hit"] and iban["score"] == pytest.approx(1.0)


def mixed_rows():
    rng = random.Random(8)
    rows = []
    for source, n, words in (("big", 900, 40), ("a", 200, 30), ("ä", 90, 25), (None, 120, 20), ("tiny", 3, 5), ("zero", 4, 0)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randrange(words, 2 * words + 1)), source) for k in range(n)]
    return rows + [(10_000, None, "a"), (10_001, "  \n", "a"), (5, "same text", "a"), (5, "same text", "a"), (None, "x y", "big")]


def targets_brute(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        more = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}


def test_mix(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("x"))
    out = mixing.mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets_brute(sizes)
    assert len(out) == len(rows)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert all(0 <= r.copies <= 3 and r.taken == r.size * r.copies for r in own)
        # The nearest sum of whole documents may be off by half a document.
        assert abs(sum(r.taken for r in own) - want[s]) <= max(1e-6, max(r.size for r in own) / 2)
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_passes_over_long_documents(spark):
    """One document of a third of its source may stand at the cut; the target is still met to a short document."""
    rng = random.Random(6)
    rows, sources = [], [f"s{k:02}" for k in range(40)]
    for s in sources:
        sizes = [rng.randrange(20, 61) for _ in range(100)]
        rows += [(len(rows) + k, "w " * n, s) for k, n in enumerate([*sizes, sum(sizes) // 2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, weights=(1.0, 3.0)).collect()
    for s in sources:
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30


def test_mix_follows_preferences(spark):
    """Documents that are liked more are taken more often, and the target still holds."""
    rows = [(i, "w " * 10, "a" if i < 2000 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, weights=(1.0, 3.0), preference=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    taken = lambda keep: sum(r.taken for r in out if keep(r))
    assert taken(lambda r: r.source == "a") == 10_000
    assert taken(lambda r: r.source == "a" and r.doc_id % 2 == 0) > 2 * taken(lambda r: r.source == "a" and r.doc_id % 2)
