"""Personal data: patterns for four kinds, and a skip-chain conditional random field that adds spans.

The field's variables are the tokens that hold a digit or an at sign; any other token is outside
by construction. Neighbouring variables are joined, and so is each to the next one in the document
that is the same token, or a similar one: one whose digits end in the same seven. These are chains
through all repeats. Loopy message passing makes labels
agree over each document. Weights come from the corpus itself: the patterns' spans label a bounded
sample, and the pseudo-likelihood of those labels is maximised.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("outside", *KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Both begin at the first digit of a run: the look behind sees that digit and the character before it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_SIGN = re.compile(r"[0-9@]")
_FORM = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a")]


def emails(text: str) -> list[tuple[int, int]]:
    """A run of local characters, an at sign and a domain with a dot: found from the at sign, in linear time."""
    out, free = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class Field:
    """The variables of one document: spans of tokens, hashed features, and joined pairs."""

    def __init__(self, text: str, bits: int, gap: int = 2):
        spans = [m.span() for m in _TOKEN.finditer(text)] if _SIGN.search(text) else []
        at = [k for k, (s, e) in enumerate(spans) if _SIGN.search(text, s, e)]
        self.spans = [spans[k] for k in at]
        self.forms = [_form(text[s:e]) for s, e in self.spans]
        self.features = np.array(
            [_coordinates(text, spans, k, f, bits) for k, f in zip(at, self.forms)], dtype=np.int64
        ).reshape(len(at), 10)
        self.near = [(i - 1, i) for i in range(1, len(at)) if at[i] - at[i - 1] <= gap]
        last: dict[str, int] = {}
        self.far = []
        for i, (s, e) in enumerate(self.spans):
            digits = _digits(text[s:e])[-TAIL:]
            for key in (text[s:e].strip(_EDGE).lower(), *["#" + digits] * (len(digits) == TAIL)):
                if key in last:
                    self.far.append((last[key], i))
                last[key] = i
        self.far = sorted(set(self.far) - set(self.near))

    def gold(self, base) -> np.ndarray:
        """Labels by the spans that a token overlaps."""
        labels = np.zeros(len(self.spans), dtype=np.int64)
        begin, end = (np.array([x[k] for x in self.spans], dtype=np.int64) for k in (0, 1))
        for kind, s, e in base:
            labels[np.searchsorted(end, s, "right") : np.searchsorted(begin, e, "left")] = LABELS.index(kind)
        return labels


_EDGE = ".,;:!?()[]{}<>\"'#$%&*|"
#: Tokens are similar if this many last digits are equal.
TAIL = 7


def _form(token: str) -> str:
    for pattern, by in _FORM:
        token = pattern.sub(by, token)
    return token


def _coordinates(text, spans, k, form, bits) -> list[int]:
    s, e = spans[k]
    core = text[s:e].strip(_EDGE)
    digits = _digits(core)
    before = text[slice(*spans[k - 1])] if k else ""
    after = text[slice(*spans[k + 1])] if k + 1 < len(spans) else ""
    parts = core.split(".")
    facts = (
        "bias", f"form {_form(core)}", f"digits {min(len(digits), 20)}", f"first {core[:1]}",
        f"at {'@' in core} {'.' in core.rpartition('@')[2]}", f"before {_form(before)}", f"after {_form(after)}",
        f"luhn {len(digits) > 11 and luhn(digits)} {len(digits)}",
        f"octets {len(parts) == 4 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in parts)}",
        f"share {round(4 * len(digits) / max(1, len(core)))}",
    )
    return [crc32(f.encode("utf-8", "surrogatepass")) >> (32 - bits) for f in facts]


class Graph:
    """A document's variables without their text."""

    def __init__(self, spans, features, near, far):
        self.spans, self.features, self.near, self.far = spans, np.array(features, dtype=np.int64).reshape(len(spans), 10), near, far


def train(docs: DataFrame, sample: int = 8192, variables: int = 16, bits: int = 14, passes: int = 60) -> dict:
    """Weights by pseudo-likelihood over at most `sample` different documents that hold a digit or an at sign.

    The sample is the documents of the smallest hash of id and text, chosen by the hash alone; repeated
    rows count once. Variables are made where the texts are. One task fits the weights; of each document
    it takes at most variables * sample / 256 leading ones, and it reads documents one by one until
    variables * sample are met, so that its memory is bounded whatever the texts' length and a batch of
    2,000 documents has a few dozen megabytes. Without such documents nothing is
    added later.
    """
    place = F.xxhash64("doc_id", "text").alias("place")
    held = docs.where(F.col("text").rlike("[0-9@]"))
    chosen = held.select(place).distinct().orderBy("place").limit(sample)
    rows = held.select(place, "text").join(F.broadcast(chosen), "place", "left_semi").dropDuplicates(["place"])
    most, each = variables * sample, max(variables, variables * sample // 256)

    def leading(text):
        """Features, pairs and labels of a text's first variables; the rest of its field is let go."""
        f = Field(text, bits)
        near, far = (np.array([i for e in pairs if max(e) < each for i in e], dtype=np.int32) for pairs in (f.near, f.far))
        return f.features[:each].ravel().astype(np.int32), near, far, f.gold(base_spans(text))[:each].astype(np.int32)

    def make():
        return lambda places, texts: (places, *zip(*map(leading, texts)))

    made = map_rows(rows, make, "place long, x array<int>, near array<int>, far array<int>, gold array<int>")

    def learn(batches):
        graphs, gold, known = [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                x, near, far, g = (b.column(c)[i].as_py() for c in ("x", "near", "far", "gold"))
                if g and known < most:
                    known += len(g)
                    graphs.append(Graph(g, x, list(zip(near[::2], near[1::2])), list(zip(far[::2], far[1::2]))))
                    gold.append(np.array(g, dtype=np.int64))
        if graphs:
            unary, near, far = fit(graphs, gold, bits, passes)
            flat = np.concatenate([unary.ravel(), near.ravel(), far.ravel()])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "w"])

    got = made.repartition(1).sortWithinPartitions("place").mapInArrow(learn, "at long, w double").toArrow()
    flat = np.zeros((1 << bits) * 5 + 50)
    flat[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return {"bits": bits, "unary": flat[:-50].reshape(-1, 5), "near": flat[-50:-25].reshape(5, 5), "far": flat[-25:].reshape(5, 5)}


def joined(fields: list[Field]):
    """All variables of several documents as one graph."""
    shift = np.cumsum([0, *[len(f.spans) for f in fields]])
    x = np.concatenate([f.features for f in fields])
    pairs = [
        np.array([(a + s, b + s) for f, s in zip(fields, shift) for a, b in getattr(f, kind)], dtype=np.int64).reshape(-1, 2)
        for kind in ("near", "far")
    ]
    return x, pairs[0], pairs[1]


def fit(fields, gold, bits: int, passes: int, rate: float = 0.5, l2: float = 1e-4):
    """AdaGrad on the pseudo-likelihood: each variable given the labels of those it is joined to."""
    x, near, far = joined(fields)
    y = np.concatenate(gold)
    unary, pair = np.zeros((1 << bits, 5)), [np.zeros((5, 5)), np.zeros((5, 5))]
    seen = [np.full_like(unary, 1e-3), *[np.full((5, 5), 1e-3) for _ in pair]]
    weight = np.where(y == 0, 1.0, 2.0)[:, None] / len(y)
    one = np.eye(5)[y]
    for _ in range(passes):
        z = potentials(unary, x)
        for w, e in zip(pair, (near, far)):
            np.add.at(z, e[:, 1], w[y[e[:, 0]]])
            np.add.at(z, e[:, 0], w.T[y[e[:, 1]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (one - p / p.sum(axis=1, keepdims=True)) * weight
        du = -l2 * unary
        for k in range(x.shape[1]):
            np.add.at(du, x[:, k], g)
        grads = [du]
        for w, e in zip(pair, (near, far)):
            d = -l2 * w
            np.add.at(d, y[e[:, 0]], g[e[:, 1]])
            np.add.at(d.T, y[e[:, 1]], g[e[:, 0]])
            grads.append(d)
        for w, d, s in zip([unary, *pair], grads, seen):
            s += d * d
            w += rate * d / np.sqrt(s)
    return unary, pair[0], pair[1]


def potentials(unary: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the features' weights, a column at a time."""
    z = np.zeros((len(x), unary.shape[1]))
    for k in range(x.shape[1]):
        z += unary[x[:, k]]
    return z


def marginals(model: dict, fields: list[Field], rounds: int = 8, damp: float = 0.5) -> np.ndarray:
    """Beliefs of all variables after loopy message passing, in the log domain, over all documents at once.

    Memory is a few numbers a variable and pair: pairs of a kind share one table of weights.
    """
    x, near, far = joined(fields)
    z = potentials(model["unary"], x)
    ways = [(e[:, i], e[:, 1 - i], w if i == 0 else w.T) for e, w in ((near, model["near"]), (far, model["far"])) if len(e) for i in (0, 1)]
    sent = [np.zeros((len(src), 5)) for src, _, _ in ways]
    for _ in range(rounds if ways else 0):
        belief = z.copy()
        for (_, dst, _), m in zip(ways, sent):
            np.add.at(belief, dst, m)
        fresh = []
        for k, (src, _, w) in enumerate(ways):
            own = belief[src] - sent[k ^ 1]  # without what came the other way
            new = np.stack([np.logaddexp.reduce(own + w[:, t], axis=1) for t in range(5)], axis=1)
            new -= new.max(axis=1, keepdims=True)
            fresh.append(damp * sent[k] + (1 - damp) * new)
        sent = fresh
    for (_, dst, _), m in zip(ways, sent):
        np.add.at(z, dst, m)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(texts, fields, beliefs, bases, least: float):
    """Tokens that the field labels and no base span touches, without the marks around them."""
    at = 0
    for text, f, base in zip(texts, fields, bases):
        p, out = beliefs[at : at + len(f.spans)], []
        at += len(f.spans)
        taken = sorted((s, e) for _, s, e in base)
        starts, upto = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        for (s, e), q in zip(f.spans, p):
            k = int(np.argmax(q))
            if k == 0 or q[k] < least:
                continue
            core = text[s:e].strip(_EDGE)
            a = s + text[s:e].find(core)
            b = a + len(core)
            free = bisect_left(starts, b) == 0 or upto[bisect_left(starts, b) - 1] <= a
            if len(_digits(core)) + 8 * ("@" in core) >= 7 and free:
                out.append((LABELS[k], a, b))
        yield out


def find(docs: DataFrame, model: dict, least: float = 0.9, chars: int = 1_000_000) -> DataFrame:
    """(doc_id, base, added): arrays of spans (kind, start, end) in every whole text; a null text is an empty one."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind:string,start:int,end:int>>"

    def make():
        model = box.value
        named = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

        def work(keys, values):
            base, added = [], []
            for group in _by_size([v or "" for v in values], chars):
                bases = [base_spans(t) for t in group]
                fields = [Field(t, model["bits"]) for t in group]
                beliefs = marginals(model, fields) if any(f.spans for f in fields) else np.zeros((0, 5))
                base += map(named, bases)
                added += map(named, added_spans(group, fields, beliefs, bases, least))
            return keys, base, added

        return work

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id long, base {span}, added {span}")


def _by_size(texts, chars):
    from .bpe import grouped

    return grouped(texts, chars)


def digest(spans) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in sorted(spans, key=lambda x: (order[x["kind"]], x["start"])))


def report(docs: DataFrame, model: dict) -> DataFrame:
    """Counts of base spans, their digest, and all spans, one row for each row of docs; a null or empty text has none."""

    def make():
        def work(keys, base, added):
            counts = [[sum(x["kind"] == k for x in spans) for spans in base] for k in KINDS]
            sha = [hashlib.sha256(digest(b).encode()).hexdigest() for b in base]
            return keys, *counts, sha, [digest(b + a) for b, a in zip(base, added)]

        return work

    return map_rows(
        find(docs, model), make,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """The same columns, with every span of every text replaced by its kind in brackets and n_chars anew; null texts stay."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = box.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for group in _by_size([t or "" for t in texts], 1_000_000):
                bases = [base_spans(t) for t in group]
                fields = [Field(t, model["bits"]) for t in group]
                beliefs = marginals(model, fields) if any(f.spans for f in fields) else np.zeros((0, 5))
                for t, b, a in zip(group, bases, added_spans(group, fields, beliefs, bases, 0.9)):
                    out.append(replaced(t, b + a))
            out = [None if t is None else o for t, o in zip(texts, out)]
            cols = dict(zip(batch.schema.names, batch.columns))
            cols["text"] = pa.array(out, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if o is None else len(o) for o in out], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans) -> str:
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]
