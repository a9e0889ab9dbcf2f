"""Spans against plain regexes over whole texts; queries against the texts that match."""

import random
import re

import pytest

from riskweave.llm import secrets

BASE = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
TEXTS = [None, "", "password=hunter22 and PASSWORD : 'abc' token=\"xyz123456\"", "AKIA" + "A1" * 8, "AKIASHORT AKIA" + "Z" * 40,
         "0123456789abcdef" * 3, "é" * 50 + "Api_Key = s3cr3t+/=value", "apikey:aaaaaa;api_key:bbbbbb", "tok en=abcdef", "x" * 100_000 + " secret = AKIA" + "B" * 16,
         "passwordtoken=123456", "deadbeef" * 3 + "g", "passwd='" + "a" * 5]


def plain(text):
    found = [(m.start(), k, m.end()) for k, (_, p, group, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[group]) >= least]
    return [(BASE[k][0], s, e) for s, k, e in sorted(found)]


def noisy(n):
    random.seed(n)
    parts = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCD1234", "deadbeef", "0123", "ü", "x", "\n"]
    return ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(n)]


def test_spans_as_plain_regexes(docs):
    texts = TEXTS + noisy(400)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.s] for r in docs(texts).select("doc_id", secrets.scan("text").alias("s")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def test_empty_table(docs):
    assert docs([]).select(secrets.scan("text")).count() == 0


@pytest.mark.parametrize("pattern, trigrams", [
    (r"AKIA[A-Z0-9]+", [{frozenset({b"aki", b"kia"})}]),
    (r"[0-9a-f]+", []),
    (r"(?:foo|barbar)x*", [{frozenset({b"foo"}), frozenset({b"bar", b"arb", b"rba"})}]),
    (r"ab+c", []),
    (r"(?:hello)+ .*world", [{frozenset({b"hel", b"ell", b"llo"})}, {frozenset({b"wor", b"orl", b"rld"})}]),
])
def test_queries(pattern, trigrams):
    assert secrets.trigram_query(pattern) == trigrams


@pytest.mark.parametrize("pattern", [r"colou?r=\d{2,}", r"(?:key|id)[-_][a-d]x", r"a(bcd|ef*)gh", r"sk-[a-z]{3}\d+", r"(abc)?def"])
def test_queries_never_lose_a_match(pattern):
    random.seed(pattern)
    parts = ["colour=", "color=", "12", "key", "id", "-", "_", "a", "x", "abcd", "gh", "ef", "sk-", "abc", "def", "7"]
    query = secrets.trigram_query(pattern)
    for _ in range(500):
        text = "".join(random.choices(parts, k=8))
        grams = {text.encode().lower()[i : i + 3] for i in range(len(text) - 2)}
        held = all(any(option <= grams for option in condition) for condition in query)
        assert held or not re.search(pattern, text)


def test_index_lists_the_texts(docs):
    texts = ["token", None, "my TOKEN", "", "tok en"] * 3
    got = {}
    for r in secrets.trigram_index(docs(texts), "doc_id", "text").collect():
        got.setdefault(r.trigram, set()).update(r["keys"])
    assert got["tok"] == {i for i, t in enumerate(texts) if t and "tok" in t.lower()}
    assert got["oke"] == {i for i, t in enumerate(texts) if t and "oke" in t.lower()}
