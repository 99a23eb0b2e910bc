"""Alignment of two tokenizers: the fragment monoid, ranges of bytes, and the operator against plain versions."""

import hashlib
import itertools
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, batch long, pairs string, row string, chunk int"

TEXTS = [
    None, "", " ", "\n\n", "a", "  two  spaces ", "trail ", "tab\tand\x0bvt", "x▁y", "▁", "<|endoftext|> <s> </s> <0x41>", "né Ñandú 日本語 テスト", "a\xa0b c", "　wide  space",
    "end\x00nul", "ｆｕｌｌ width", "é accent", "🙂🙃 smile", "It's we'll don't", "12345 67,890.12", "naïve café", "the same text", "the same text", "﻿mark", "x" * 3000, "é" * 2000 + " " + "na " * 700,
    "The quick brown fox jumps over the lazy dog. " * 40, "Straße über Übergröße und Eichhörnchen " * 30, " ".join(f"w{i}" for i in range(600)),
]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(A, B, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(A)
    found.encode_special_tokens = True
    return found


def plain(pair, library, text):
    """(a ids, b ids, groups, links) by whole encodings; None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a = library.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    parts = [[pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]]
    if any(b"".join(p) != raw for p in parts):
        return None
    ends = [list(itertools.accumulate(map(len, p))) for p in parts]
    groups, x, y = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        i, j = ends[0].index(e, x) + 1, ends[1].index(e, y) + 1
        groups.append((a[x:i], b[y:j]))
        x, y = i, j
    begins = [[0, *e[:-1]] for e in ends]
    links, j = Counter(), 0
    for i in range(len(a)):
        while ends[1][j] <= begins[0][i]:
            j += 1
        k = j
        while k < len(b) and begins[1][k] < ends[0][i]:
            links[a[i], b[k]] += 1
            k += 1
    return a, b, groups, links


def expected(pair, library, texts):
    found = [plain(pair, library, t) for t in texts]
    count = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for f in found:
        if f is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            a, b, groups, links = f
            text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            yield (len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest())


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("size", [65_536, 200])
def test_alignment_is_that_of_whole_encodings(spark, pair, library, size):
    rows = [(i, t, 1, "clash", "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1, None, None, None), (3, "a repeated id", 1, None, None, None), (3, "a repeated id", 1, None, None, None)]
    got = align.alignment(spark.createDataFrame(rows, SCHEMA).repartition(3), A, B, public_tokenizers.PATTERN, size).collect()
    want = Counter((r[0], *e) for r, e in zip(rows, expected(pair, library, [r[1] for r in rows])))
    assert Counter((r["doc_id"], *[r[n] for n in NAMES]) for r in got) == want
    assert sum(e[0] == 0 for e in want) < len(rows) // 2


def test_no_documents(spark):
    assert align.alignment(spark.createDataFrame([], SCHEMA), A, B, public_tokenizers.PATTERN).collect() == []
    assert align.alignment(spark.createDataFrame([(1, None, 1, "", "", 1)], SCHEMA), A, B, public_tokenizers.PATTERN).first()["groups_sha256"] == ""


def test_fragments_compose_in_any_way():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(2, 60))
        sides = []
        for _ in range(2):
            ends = sorted({*rng.choice(np.arange(1, n + 1), rng.integers(1, n), replace=False).tolist(), n})
            sides.append(align.Tokens(rng.integers(0, 9, len(ends)).tolist(), ends))
        whole = align.begin() * align.fragment(*sides)
        cuts = sorted({0, n, *rng.integers(0, n, 4).tolist()})
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            own = [[k for k, e in enumerate(t.ends) if lo < e <= hi] for t in sides]
            parts.append(align.fragment(*[align.Tokens([t.ids[k] for k in at], [t.ends[k] for k in at]) for t, at in zip(sides, own)]))
        parts[0] = align.begin() * parts[0]
        left = parts[0]
        for p in parts[1:]:
            left = left * p
        right = parts[-1]
        for p in parts[-2::-1]:
            right = p * right
        while len(parts) > 1:  # any two neighbours
            k = int(rng.integers(0, len(parts) - 1))
            parts[k : k + 2] = [parts[k] * parts[k + 1]]
        assert left == right == parts[0] == whole
        assert whole.last == (align.Tokens(), align.Tokens())
        assert align.Fragment() * whole == whole == whole * align.Fragment()


def test_ranges_cover_all_bytes_and_cut_inside_stretches(pair, library):
    stretches, inside = align.Stretches(pair), 0
    for text in [t for t in TEXTS if t and len(t) > 300]:
        raw = b" " + text.encode()
        found = align.ranges(raw, 100)
        assert [r[0] for r in found] == [0] + [r[1] for r in found[:-1]] and found[-1][1] == len(raw)
        assert len(found) > 3 or "x" * 3000 == text or "é" in text
        inside += sum(left < at for at, _, left, _ in found)
        f = align.Fragment()
        for at, to, left, right in found:
            assert left <= at and to <= right
            f = f * align.of_range(stretches, raw[left:right], at, to, left)
        a, b, groups, links = plain(pair, library, text)
        assert (f.closed.n_a, f.closed.n_b, f.closed.n_groups, sum(f.closed.links.values())) == (len(a), len(b), len(groups), sum(links.values()))
    assert inside > 5
