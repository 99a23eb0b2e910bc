"""Secrets by patterns, and by a battery of randomness tests on long tokens. DataFrame functions only.

A token's encoding is inferred from its characters. Each test of the battery has two tails. One asks
whether the token could be ordinary text: letters as uneven as a language's, long runs of one class of
characters, neighbours alike. The three p-values of that are combined by Fisher's sum, and tokens are
taken under Benjamini and Hochberg's control of false discoveries over the document's tokens, with
weights by length. The other tail asks whether it could be drawn at random from its alphabet: a
token far from uniform, with too few runs, or with correlated neighbours is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters than these would be dropped, and what follows in it too.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: Tokens that the tests look at.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"

#: Ordinary text: the chance that two letters, or three, are equal; the share of neighbours of different
#: classes; the correlation of neighbours' places in the alphabet.
SAME_TWO, SAME_THREE, CHANGES, ALIKE = 0.066, 0.0055, 0.2, 0.5

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step, start: Column, levels: int = 3, width: int = 64) -> Column:
    """Running totals of an array under an associative step with a neutral start.

    Each level cuts the array into pieces of `width` and goes on with the pieces' totals, as adding to an
    array copies it: work is n * width a level, not n * n.
    """
    grow = lambda acc, x: F.array_append(acc, step(F.coalesce(F.element_at(acc, -1), start), x))
    none = F.slice(F.array(start), 1, 0)
    whole = lambda piece: F.aggregate(piece, none, lambda acc, x: F.when(F.size(acc) == 0, F.array(step(start, x))).otherwise(grow(acc, x)))
    if levels == 0:
        return whole(values)

    def cut(v: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda c: whole(F.slice(v, c * width + 1, F.lit(width))))

        def shifted(local: Column) -> Column:
            totals = F.transform(local, lambda p: F.element_at(p, -1))
            before = let(totals, lambda t: F.concat(F.array(start), running(F.slice(t, F.lit(1), F.size(t) - 1), step, start, levels - 1, width)))
            return F.flatten(F.zip_with(local, before, lambda p, b: F.transform(p, lambda x: step(b, x))))

        return let(pieces, shifted)

    return let(values, lambda v: F.when(F.size(v) == 0, none).when(F.size(v) <= width, whole(v)).otherwise(cut(v)))


def spans(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind, end, value); null if there is none.

    Where they begin follows from the lengths of what stands between them.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    zipped = F.arrays_zip(found.alias("found"), F.slice(between, F.lit(1), F.size(found)).alias("between"), values.alias("value"))
    sized = F.transform(zipped, lambda x: F.struct(F.length(x["between"]).alias("gap"), F.length(x["found"]).alias("long"), x["value"].alias("value")))

    def placed(s: Column) -> Column:
        ends = running(F.transform(s, lambda x: x["gap"] + x["long"]), lambda a, b: a + b, F.lit(0))
        return F.zip_with(s, ends, lambda x, end: F.struct((end - x["long"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))

    return F.when(text.rlike(pattern), let(sized, placed))


def untouched(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps: in the order of starts, none before ends after the token's start, and none begins in it."""
    none = F.array().cast(_SPANS)

    def apart(every: Column) -> Column:
        # The furthest end of base spans up to each place, and the next base start after it.
        upto = running(F.transform(every, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), F.lit(0))
        back = F.transform(F.reverse(every), lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(2**31 - 1))
        then = F.reverse(running(back, lambda a, b: F.least(a, b), F.lit(2**31 - 1)))
        known = F.arrays_zip(every.alias("span"), upto.alias("upto"), then.alias("then"))
        kept = F.filter(known, lambda x: (x["span"]["kind"] == 3) & (x["upto"] <= x["span"]["start"]) & (x["then"] >= x["span"]["end"]))
        return F.transform(kept, lambda x: x["span"])

    return F.when(F.size(tokens) == 0, none).when(F.size(base) == 0, tokens).otherwise(let(F.array_sort(F.concat(base, tokens)), apart))


def upper_tail(z: Column) -> Column:
    """The normal distribution's upper tail, by a rational approximation good to 1e-7 of its size at 0."""

    def tail(z: Column) -> Column:
        def positive(t: Column) -> Column:
            poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
            return poly * F.exp(-z * z / 2) * 0.3989422804014327

        return let(let(1 / (1 + 0.2316419 * F.abs(z)), positive), lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return let(z, tail)


def chi_tail(chi: Column, k: Column | float) -> Column:
    """The chi-squared upper tail at k degrees of freedom, by the cube-root transform."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return let(k, lambda k: upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))))


def without(s: Column, pattern: str) -> Column:
    """How many characters of the pattern s holds."""
    return (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("double")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def measures(s: Column) -> Column:
    """What the tests look at in a token: length, alphabet, equal characters, classes, runs and the correlation of neighbours."""
    n = F.length(s).cast("double")
    size = (
        F.when(s.rlike("^[0-9]+$"), 0).when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(s.rlike("^[A-Z2-7]+$"), 32).otherwise(64).cast("double")
    )
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]++", "-"), "[0-9]++", "0"), "[a-z]++", "a"), "[A-Z]++", "A")
    code = lambda c: F.when(c < 58, c - 48).when(c > 96, c - 87).otherwise(c - 29).cast("double")
    codes = F.transform(chars, lambda c: code(F.ascii(c)))

    def correlation(v: Column) -> Column:
        def of(off: Column) -> Column:
            later = F.slice(off, F.lit(2), F.greatest(F.size(off) - 1, F.lit(0)))
            products = F.zip_with(off, F.concat(later, F.array(F.lit(0.0))), lambda a, b: a * b)
            return total(products) / F.greatest(total(F.transform(off, lambda x: x * x)), F.lit(1e-9))

        return let(let(total(v) / F.size(v), lambda avg: F.transform(v, lambda x: x - avg)), of)

    return F.struct(
        n.alias("n"), size.alias("size"), total(F.transform(counts, lambda c: c * c)).alias("squares"), F.length(classes).cast("double").alias("runs"),
        *[without(s, c).alias(name) for name, c in (("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"))], let(codes, correlation).alias("r"),
    )


def tests(m: Column) -> Column:
    """(text, random, size) of measures."""
    n, pairs, runs, r = m["n"], m["n"] * (m["n"] - 1), m["runs"], F.abs(m["r"])
    # Equal characters: random ones are uniform, those of text repeat as a language's do.
    uniform = chi_tail(m["size"] / n * m["squares"] - n, F.greatest(m["size"], F.lit(2.0)) - 1)
    spread = F.sqrt(2 * pairs * SAME_TWO * (1 - SAME_TWO) + 4 * pairs * (n - 2) * (SAME_THREE - SAME_TWO**2))
    even = 1 - upper_tail((m["squares"] - n - pairs * SAME_TWO) / spread)
    # Runs of one class of characters: lower case, upper case, digits, others.
    same = sum(p * (p - 1) for p in (m["lower"], m["upper"], m["digit"], n - m["lower"] - m["upper"] - m["digit"])) / pairs
    few = lambda p: 1 - upper_tail((runs - 1 - (n - 1) * (1 - p)) / F.sqrt(F.greatest((n - 1) * p * (1 - p), F.lit(1e-9))))
    too_few = let(same, lambda p: F.when((p <= 0) | (p >= 1), F.lit(1.0)).otherwise(few(p)))
    often = F.when(runs < 2, F.lit(1.0)).otherwise(1 - chi_tail(2 * CHANGES * (n - 1), 2 * (runs - 1)))
    # Correlation of neighbours' places in the alphabet.
    serial = 2 * upper_tail(r * F.sqrt(n))
    unlike = 1 - upper_tail((r - ALIKE) * F.sqrt(n))
    fisher = -2 * sum(F.log(F.greatest(p, F.lit(1e-12))) for p in (even, often, unlike))
    return F.struct(chi_tail(fisher, 6).alias("text"), F.least(uniform, too_few, serial, F.lit(1.0)).alias("random"), m["size"].alias("size"))


def battery(token: Column) -> Column:
    """(text, random, size): the battery's p-values of ordinary text and of randomness, and the alphabet's size (0: no test)."""
    return let(F.regexp_replace(token, "=+$", ""), lambda s: let(measures(s), tests))


def find(docs: DataFrame, q: float = 0.01, alpha: float = 0.001, least: int = 12) -> DataFrame:
    """(doc_id, base, added): spans (start, kind, end, value) of every whole text, sorted; a null text is an empty one.

    Offsets are in code points, and repeated rows are rows of their own. added has tokens, kind 3, that
    touch no base span. q: the share of false discoveries among a document's tokens. The three tests of
    randomness share alpha.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(_SPANS)
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.filter(F.coalesce(spans(F.col("text"), ASSIGN, 0, 2), none), lambda x: F.length(x["value"]) >= least).alias("assign"),
        F.coalesce(spans(F.col("text"), ACCESS, 1), none).alias("access"),
        F.coalesce(spans(F.col("text"), HEX, 2), none).alias("hex"),
        F.filter(F.coalesce(spans(F.col("text"), TOKEN, 3), none), lambda x: x["value"].rlike("[0-9]")).alias("token"),
    )
    rows = rows.select("doc_id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "token")
    rows = rows.select("doc_id", "base", untouched(F.col("token"), F.col("base")).alias("token"))
    tested = F.transform("token", lambda x: F.struct(x.alias("span"), battery(x["value"]).alias("p")))
    rows = rows.select("doc_id", "base", F.when(F.size("token") > 0, F.filter(tested, lambda t: t["p"]["size"] > 0)).alias("tested"))
    length = lambda t: (t["span"]["end"] - t["span"]["start"]).cast("double")
    mean = total(F.transform("tested", length)) / F.size("tested")
    weighed = let(mean, lambda m: F.transform("tested", lambda t: F.struct((t["p"]["text"] * m / length(t)).alias("p"), (t["p"]["random"] * 3 > alpha).alias("fits"), t["span"].alias("span"))))
    rows = rows.select("doc_id", "base", F.array_sort(weighed).alias("ranked"))
    passed = F.filter(F.transform("ranked", lambda t, i: F.when(t["p"] <= q * (i + 1) / F.size("ranked"), i + 1).otherwise(0)), lambda k: k > 0)
    cut = F.coalesce(F.array_max(passed), F.lit(0))
    added = F.transform(F.filter(F.slice("ranked", F.lit(1), cut), lambda t: t["fits"]), lambda t: t["span"])
    return rows.select("doc_id", "base", F.array_sort(F.coalesce(F.when(cut > 0, added), none)).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans by start, then kind, for each row of docs; the method's kind is `random`."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return find(docs).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text("base"), 256).alias("base_sha256"), text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
