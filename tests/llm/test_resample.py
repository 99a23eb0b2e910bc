"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import resample

SCHEMA = "doc_id long, text string, rank long, bucket string, n string, fit int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain(docs, target):
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([d[1] for d in docs], target))
    S, T = sum(s.values()), sum(t.values())
    out = []
    for key, text in docs:
        found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    fit = sorted((-r[3], math.inf if r[0] is None else r[0], r[1], r[2], i) for i, r in enumerate(out) if r[4] >= 20)
    rank = {r[-1]: k for k, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return Counter((*r[:4], rank.get(i)) for i, r in enumerate(out))


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    vocabulary = ["the", "OF", "ñandú", "日本", "x²", "it's", "don-t", "a1b2", "Straße", "w" * 300, "İstanbul", "é"]
    texts = [None, "", "  ", "!!!", "one", "one two", "A\x7fB\x80C", "x" * 5000]
    texts += [" ".join(rng.choice(vocabulary, rng.integers(1, 80))) + "." for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, texts[20]), (7, texts[30]), (7, texts[30]), (8, "only two")]
    return rows


def test_draw_is_that_of_the_plain_version(spark, docs):
    target = ["the of ñandú", None, "", "日本 日本 the x"] * 3
    full = [(*d, 1, "clash", "clash", 1) for d in docs]
    got = resample.resample(spark.createDataFrame(full, SCHEMA).repartition(4), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == plain(docs, target)
    assert sum(r["rank"] is not None for r in got) == 5 * sum(len(words(t)) >= 20 for _, t in docs) // 100 > 5


def test_empty_tables(spark, docs):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(*d, 1, "", "", 1) for d in docs[:9]], SCHEMA)
    assert resample.resample(none, some).collect() == []
    got = resample.resample(some, none).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got) == plain(docs[:9], [])


def test_payloads_compose_to_the_crc_of_joined_words():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(0, 256, rng.integers(0, 2000)).astype(np.uint8)) for _ in range(60)]
    left, right = parts[:-1], parts[1:]
    got = resample.composed(np.array([zlib.crc32(x) for x in left], np.uint32), np.array([zlib.crc32(x) for x in right], np.uint32), np.array([len(x) for x in right]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(left, right)]


@pytest.mark.parametrize("most", [10, 37, 1000])
def test_runs_cross_the_pieces_of_a_long_text(monkeypatch, docs, most):
    texts = [t for _, t in docs[:80]]
    pieces, grouped = resample._pieces, resample._grouped
    monkeypatch.setattr(resample, "_pieces", lambda t, _: pieces(t, most))
    monkeypatch.setattr(resample, "_grouped", lambda t: grouped(t, most))
    got = Counter()
    for at, b in resample.runs(resample.Dictionary(memory=50), texts):
        got.update(zip(at.tolist(), b.tolist()))
    assert got == Counter((k, bucket(f)) for k, t in enumerate(texts) for f in features(t))
