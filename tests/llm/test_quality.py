"""Quality rules: counts against a plain version, sketches that merge, and fences by language and source."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, measure string, low string, level int"
WORDS = "the of and an onion thing ereath tion ingou stble né über Ñandú 日本 12 it's x² #tag a|b".split(" ")


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    out = [None, "", "   ", "\n\n\n", "a\nb\na\n \n\na", "one two\r\none two\r\n", "x" * 20_000, "\xa0 \x1c \x85 wide　space", "#$%&*|<>" * 9, "a " * 5000]
    line = " ".join(rng.choice(WORDS, 12))
    out += [f"{line}\n{line} more\n{line}", " ".join([line] * 7), " ".join(["a b c d e f g h"] * 2 + ["z"] * 3), "a b c d e f g h " * 2]
    for _ in range(120):
        w = rng.choice(WORDS, rng.integers(1, 150)).tolist()
        if rng.random() < 0.5 and len(w) > 12:
            k = int(rng.integers(0, len(w) - 9))
            w += w[k : k + int(rng.integers(5, 20))]
        out.append("".join(x + str(rng.choice([" ", "  ", "\n", "\t", " \n "])) for x in w))
    return out


def test_counts_are_those_of_the_plain_version(spark, texts):
    rows = [(i, t, "en", None, "clash", "clash", 1) for i, t in enumerate(texts)] + [(None, texts[20], None, "s", None, None, None), (5, texts[21], None, None, None, None, None)]
    got = quality.kept(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == Counter((r[0], *plain(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got) and 0 < sum(r["kept"] for r in got)
    assert quality.kept(spark.createDataFrame([], SCHEMA)).collect() == []


def prose(rng, n, long):
    return " ".join("".join(rng.choice(list("aeiounrst"), max(1, int(rng.normal(long, 1))))) for _ in range(n))


def test_thresholds_follow_the_language_and_source(spark):
    rng = np.random.default_rng(9)
    rows, spoiled = [], set()
    for lang, source, n, long in (("en", "a", 80, 4), ("de", "a", 80, 9), ("de", "tiny", 6, 9), ("xx", "b", 3, 5), (None, None, 60, 6)):
        for k in range(n):
            i = len(rows)
            text = prose(rng, int(rng.integers(40, 200)), long)
            if k % 10 == 3:
                text, _ = " ".join(w + "###" for w in text.split()), spoiled.add(i)
            rows.append((i, text, lang, source, "", "", 0))
    rows.append((len(rows), prose(rng, 100, 9), "en", "a", "", "", 0))  # words of German length among short ones
    spoiled.add(len(rows) - 1)
    got = {r["doc_id"]: r["kept"] for r in quality.kept(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, k in got.items() if not k} == spoiled


def test_sketches_merge_to_the_sketch_of_all(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, int(rng.integers(20, 300)), 5), f"l{i % 2}", f"s{i % 3}", "", "", 0) for i in range(200)]
    measured = quality.measured(spark.createDataFrame(rows, SCHEMA)).select("*", *quality.values()).cache()
    parts = [quality.sketches(measured.where(F.col("doc_id") % 4 == k)) for k in range(4)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    merged = merged.groupBy("lang", "source", "measure", "low").agg(F.sum("n").alias("n"))
    as_set = lambda df: {tuple(r) for r in df.select("lang", "source", "measure", "low", "n").collect()}
    whole = quality.sketches(measured)
    assert as_set(merged) == as_set(whole)
    lengths = sorted(r["word_length"] for r in measured.where("NOT base_failed AND lang = 'l0' AND source = 's0'").collect())
    exact = lengths[-(-3 * len(lengths) // 4) - 1]
    sketch = sorted((r["low"], r["n"]) for r in whole.where("lang = 'l0' AND source = 's0' AND measure = 'word_length'").collect())
    upto, low = 0, None
    for low, n in sketch:
        upto += n
        if 4 * upto >= 3 * len(lengths):
            break
    assert low <= exact < low * 33 / 32 + 1
