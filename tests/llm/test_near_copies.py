"""The pipeline's near copies against brute force: whole five-word Jaccard of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import near_copies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}


def smallest_of_groups(texts):
    """texts: (doc_id, text). The smallest id of each group."""
    sets, top = [shingle_set(t) for _, t in texts], list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                top[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(texts):
        groups.setdefault(root(i), []).append(key)
    return sorted(min(g) for g in groups.values())


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(share * len(out))):
        out[k] = f"x{rng.random()}"
    return out


@pytest.fixture(scope="module")
def made():
    """Near copies on both sides of 0.8, one large group of them, a line that all texts hold, exact copies and short texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    line, base, texts = [word() for _ in range(30)], [word() for _ in range(200)], []
    for _ in range(60):
        one = [word() for _ in range(rng.randrange(5, 150))]
        texts += [one + line, edited(rng, one, 0.02) + line, edited(rng, one, 0.05) + line]
    texts += [edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04])) for _ in range(90)]
    texts += [line, line, ["a"], ["A"], ["a", "b"], [], []]
    rng.shuffle(texts)
    return [(k + 1, " ".join(t)) for k, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_keeps_what_brute_force_keeps(spark, made):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in made], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == smallest_of_groups(made)


def test_large_buckets_are_whole(spark, made):
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for rounds in (0, 1, 4):
        assert sorted(r["doc_id"] for r in near_copies.kept(docs, few=2, rounds=rounds).collect()) == smallest_of_groups(made)


def test_stage_on_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == smallest_of_groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_rows_of_one_id_are_told_apart_by_text(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    other = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", "b", 1), (1, other, "en", "s", 1), (1, text, "en", "a", 1), (2, text, "de", "s", 1), (None, text, "en", "s", 1),
        (None, "alone here with words of its own", "en", "s", 1), (None, "alone here with words of its own", None, "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, text, "en", "a", 1), (1, other, "en", "s", 1), (5, "", "en", "s", 0), (None, "alone here with words of its own", None, "s", 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_parities_never_exceed_the_difference(spark):
    """Of any length, in numpy and in Spark: at most as many bits differ as shingles, and nearly as many."""
    rng = random.Random(4)
    sets = []
    for n in (1, 60, 127, 128, 129, 150, 500, 620, 4000, 5000):
        some = [rng.getrandbits(64) for _ in range(n)]
        sets += [np.unique(np.array(some, dtype="<u8")), np.unique(np.array(some[: n - n // 9] + [rng.getrandbits(64)], dtype="<u8"))]
    bits = [np.array(near_copies.parity(s), dtype=np.int64).view(np.uint64) for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j]))]
    rows = [(i, j, near_copies.parity(sets[i]), near_copies.parity(sets[j])) for i, j in pairs]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>").select("i", "j", near_copies.differing(F.col("a"), F.col("b")).alias("d"))
    many = near_copies.Parities(bits)
    for r in df.collect():
        apart = len(np.setxor1d(sets[r["i"]], sets[r["j"]]))
        places, counts = many.differing(r["i"], np.arange(len(sets)) != r["i"])
        assert dict(zip(places.tolist(), counts.tolist()))[r["j"]] == r["d"] <= apart
        assert apart > len(sets[r["i"]]) // 4 or r["d"] >= 0.7 * apart


def test_boilerplate_that_is_not_a_near_copy(spark):
    """5,000 texts of 40 words of their own and 230 that all share, some near copies among them: no pairs but those are looked at."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared, texts = [word() for _ in range(230)], []
    for k in range(5000):
        own = [word() for _ in range(40)]
        texts.append(own[:20] + shared + own[20:])
    for k in range(40):
        texts.append([*texts[k][:-1], "other"])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    prints = near_copies.store(near_copies.described(docs, near_copies.common_shingles(docs)), "test")
    met = near_copies.meetings(prints.select("sig", "n", "keys", "own"), 32).cache()
    assert met.where("large").count() == 0 and met.where("NOT large").select("a", "b").distinct().count() == 40
    assert sorted(r["doc_id"] for r in near_copies.kept(docs).collect()) == list(range(5000))


def test_buckets_without_pairs_are_looked_at_once(spark, monkeypatch):
    """A line in unrelated texts makes a large bucket: it is compared once, each text's parity is fetched once, and the pairs elsewhere are found."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    line = [word() for _ in range(20)]
    texts = [line + [word() for _ in range(60)] for _ in range(200)]
    texts += [edited(rng, texts[k], 0.01) for k in range(5)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(near_copies, "common_shingles", lambda docs: np.zeros(0, np.uint64))
    real, seen = near_copies.across, []
    monkeypatch.setattr(near_copies, "across", lambda rows, *a: seen.append(rows.count()) or real(rows, *a))
    assert sorted(r["doc_id"] for r in near_copies.kept(docs).collect()) == smallest_of_groups(list(enumerate(map(" ".join, texts))))
    assert len(seen) == 1 and seen[0] > 100


def test_shared_text_on_both_sides_of_the_threshold(spark):
    """Groups that share a passage of every length, in buckets of every kind."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for long in (10, 60, 200):
        shared = [word() for _ in range(long)]
        for k in range(70):
            own = [word() for _ in range(rng.randrange(0, long // 3 + 2))]
            at = rng.randrange(0, len(own) + 1)
            texts.append(own[:at] + shared + own[at:])
    made = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = smallest_of_groups(made)
    assert 5 < len(want) < 200
    for few, rounds in ((32, 4), (3, 1)):
        assert sorted(r["doc_id"] for r in near_copies.kept(docs, few=few, rounds=rounds).collect()) == want


def test_columns_with_the_names_of_ours(spark):
    names = ["k1", "K2", "sig", "n", "at", "row", "place", "top", "who", "h", "salt", "own", "bits"]
    rows = [(k % 3, "some words that are the same in all of them", *[f"{c}{k}" for c in names]) for k in range(6)] + [(9, "words of its own here", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = near_copies.kept(docs).collect()
    assert sorted(tuple(r) for r in got) == [rows[0], rows[6]]
