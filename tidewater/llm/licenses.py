"""Licence scan: phrases in consecutive words, and an exact set-similarity join of text blocks with templates.

A block is a window of consecutive words of the whole text, line ends ignored: for a template of t
words, of t and a quarter. A template is found if some block holds at least `least` of its distinct
words; one of under ten distinct words only if t words in a row hold all of them, as little
of it would be enough otherwise. Words are ordered by how many documents hold them, rarest first; a
block can reach the threshold only if it holds one of a template's first words in that order, if the
text is long enough, and if enough words are left after the place of the match. Only windows around
such words are looked at, and no block is missed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_templates import NOTICES, TEXTS
from .shared import arrow_schema

# Phrases and labels of the base.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
TEMPLATES = TEXTS + NOTICES
#: A template of fewer distinct words is found whole or not at all.
SHORT = 10

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | bytes) -> list[bytes]:
    """In lower case for A-Z; ASCII letters, digits and all characters above make words."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_WORDS).split()


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand in b' w w w '; places may overlap."""
    out, at, seen, upto = [], joined.find(phrase), 0, 0
    while at >= 0:
        seen += joined.count(b" ", upto, at)
        upto = at
        out.append(seen)
        at = joined.find(phrase, at + 1)
    return out


@dataclass
class Template:
    label: str
    own: list[bytes]  # distinct words from rare to frequent
    need: int  # so many of them
    window: int  # in so many words


@dataclass
class Index:
    """Templates in the order of the words' frequencies."""

    templates: list[Template]
    prefix: dict[bytes, list[tuple[int, int]]]  # word: (template, its place in the prefix)
    held_by: dict[bytes, list[int]]  # word: templates
    rank: dict[bytes, int]  # word: its place in the order

    @classmethod
    def build(cls, templates, frequency: dict[bytes, int], least: float) -> Index:
        made, prefix, held_by = [], {}, {}
        for k, (label, text) in enumerate(templates):
            found = words(text)
            own = sorted(set(found), key=lambda w: (frequency.get(w, 0), w))
            if not own:
                continue
            short = len(own) < SHORT
            need = len(own) if short else max(1, ceil(least * len(own) - 1e-9))
            k = len(made)
            made.append(Template(label, own, need, len(found) if short else len(found) + len(found) // 4))
            for at, w in enumerate(own[: len(own) - need + 1]):
                prefix.setdefault(w, []).append((k, at))
            for w in own:
                held_by.setdefault(w, []).append(k)
        order = sorted(held_by, key=lambda w: (frequency.get(w, 0), w))
        return cls(made, prefix, held_by, {w: i for i, w in enumerate(order)})

    def candidates(self, held: set[bytes]) -> set[int]:
        """Templates that a text with these words may hold enough of.

        The text's words that any template has are taken in the order. Where one is in a template's prefix, what they share
        is at most what was found of it before, this word, and the lesser of what is left of either behind it; a template
        is given up where that isn't enough.
        """
        own = sorted(held & self.rank.keys(), key=self.rank.__getitem__)
        found: dict[int, int] = {}
        for place, w in enumerate(own):
            for k, at in self.prefix.get(w, ()):
                t, before = self.templates[k], found.get(k, 0)
                if before >= 0 and len(own) >= t.need:
                    most = before + 1 + min(len(t.own) - at - 1, len(own) - place - 1)
                    found[k] = before + 1 if most >= t.need else -1
        return {k for k, n in found.items() if n > 0}

    def matches(self, found: list[bytes]) -> dict[str, float]:
        """Each label found in the text's words, with the greatest share of a template's words that a block holds."""
        held = set(found)
        hopeful = {k for k in self.candidates(held) if sum(w in held for w in self.templates[k].own) >= self.templates[k].need}
        if not hopeful:
            return {}
        places: dict[int, list[int]] = {k: [] for k in hopeful}
        for i, w in enumerate(found):
            for k in self.held_by.get(w, ()):
                if k in places:
                    places[k].append(i)
        out: dict[str, float] = {}
        for k, at in places.items():
            t = self.templates[k]
            first = set(t.own[: len(t.own) - t.need + 1])
            share = most_in_window(found, at, [i for i in at if found[i] in first], t.window) / len(t.own)
            if share * len(t.own) >= t.need - 1e-9:
                out[t.label] = max(out.get(t.label, 0.0), share)
        return out


def most_in_window(found: list[bytes], at: list[int], anchors: list[int], window: int) -> int:
    """The most distinct words among the places `at` within any window that holds an anchor."""
    best, done = 0, -1
    for a in anchors:
        begin, end = max(bisect_left(at, a - window + 1), done + 1), bisect_right(at, a + window - 1)
        # Windows that end up to the last place seen were looked at with an earlier anchor.
        tail = bisect_left(at, at[begin] - window + 1) if begin < len(at) else begin
        counts: Counter = Counter()
        for j in range(tail, end):
            counts[found[at[j]]] += 1
            while at[j] - at[tail] >= window:
                w = found[at[tail]]
                counts[w] -= 1
                if not counts[w]:
                    del counts[w]
                tail += 1
            best = max(best, len(counts))
        done = max(done, end - 1)
    return best


def frequencies(docs: DataFrame, templates) -> dict[bytes, int]:
    """How many documents hold each of the templates' words; one row a word and task is summed."""
    tokens = frozenset(w for _, t in templates for w in words(t))

    def run(batches):
        counts = dict.fromkeys(tokens, 0)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for w in tokens.intersection(words(text or "")):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    got = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got}


def listed(templates, most: int) -> list[tuple[str, str]]:
    """Templates as a list; a table (label, text) is collected after its size is checked, at most `most` rows and a megabyte of each thousand."""
    if not isinstance(templates, DataFrame):
        return list(templates or TEMPLATES)
    rows = templates.where("label IS NOT NULL AND text IS NOT NULL").select("label", "text").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > most or size > 1000 * most:
        raise ValueError(f"{n} templates of {size} bytes are more than fit in every task; `most` is {most}")
    return [tuple(r) for r in rows.orderBy("label", "text").collect()]


def scan(docs: DataFrame, least: float = 0.8, templates=None, phrases=None, most: int = 10_000) -> DataFrame:
    """Words, base places, labels and score of every whole text; a null text is an empty one, and repeated rows are rows of their own.

    score: 1 with a base phrase, else the greatest share of a template found, else 0. templates: a list of
    (label, text) or a table with these columns, of at most `most` rows.
    """
    templates, phrases = listed(templates, most), phrases or PHRASES
    box = docs.sparkSession.sparkContext.broadcast(Index.build(templates, frequencies(docs, templates), least))
    ddl = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    schema = arrow_schema(ddl)
    wanted = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def run(batches):
        index = box.value
        prefix = index.prefix.keys()
        for batch in batches:
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = words(text or "")
                joined = b" " + b" ".join(found) + b" "
                at = [(w, label) for phrase, label in wanted for w in places(joined, phrase)]
                base = {label for _, label in at}
                more = {} if prefix.isdisjoint(found) else index.matches(found)
                starts = [w for w, _ in at]
                out.append((
                    key, len(found), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | more.keys())), 1.0 if base else max(more.values(), default=0.0),
                ))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
