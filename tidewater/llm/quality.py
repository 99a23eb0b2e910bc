"""Quality rules whose thresholds follow from each language's and source's own distribution. DataFrame functions only.

Every text is measured once. The measures of texts that pass the fixed base rules go into quantile
sketches: counts by buckets of a bounded relative width, so that sketches of any parts of the data add up
to the same sketch, whatever the order. A sketch of a language and source with too few texts is merged
with those of its language, and then with all. Its quartiles give fences, and documents are joined to the
fences of their language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .secrets import let
from .shared import store

WINDOW = 8
WORD, WHITE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]++"
#: Bits kept of a value: a bucket is at most 1/32 of its lower end wide, and values under 64 have their own.
BITS = 6
#: (measure, whether small values are fenced too, the least distance of a fence from its quartile). Thousandths,
#: but for hundredths of characters in a word.
RULES = (("symbols", False, 20), ("marks", False, 100), ("word_length", True, 150), ("dup_lines", False, 400), ("repeats", False, 200))


def doubled(h: Column, step: int) -> Column:
    """Hashes of windows twice as wide as those of h, which are `step` wide."""
    n = F.greatest(F.size(h) - step, F.lit(0))
    return let(h, lambda v: F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))


def repeated_words(windows: Column) -> Column:
    """How many words stand in windows whose hash is there twice or more; windows: one hash for each start."""

    def covered(s: Column) -> Column:
        # Sorted by hash, equal windows are neighbours; of their starts each adds what the one before hasn't covered.
        again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        starts = F.sort_array(F.transform(again, lambda x: x["at"]))
        none = F.struct(F.lit(-WINDOW).alias("upto"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, none, lambda acc, x: F.struct(x.alias("upto"), (acc["n"] + F.least(F.lit(WINDOW), x - acc["upto"])).alias("n")), lambda acc: acc["n"])

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed(h), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts of every whole text and base_failed; a null text is an empty one, repeated rows are rows of their own.

    Windows are told apart by hashes of 64 bits.
    """
    text = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"[^!-/:-@\x5B-\x60\x7B-\x7E]++", "")).cast("long").alias("n_marks"),
        lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rows = rows.withColumn("h", doubled(doubled(doubled(F.col("h"), 1), 2), 4))
    rows = rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_marks", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("h")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def values() -> list[Column]:
    """The measures of RULES as whole numbers; 0 where there is nothing to measure."""
    share = lambda part, whole, times: F.coalesce(F.expr(f"({times} * {part}) div nullif({whole}, 0)"), F.lit(0)).cast("long")
    found = [("n_symbols", "word_chars", 1000), ("n_marks", "word_chars", 1000), ("word_chars", "n_words", 100), ("n_dup_lines", "n_lines", 1000), ("n_repeat_words", "n_words", 1000)]
    return [share(*x).alias(name) for x, (name, _, _) in zip(found, RULES)]


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, low, n): how many texts that pass the base have a measure in the bucket that begins at low."""
    measures = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("v")) for name, _, _ in RULES])).alias("m")
    low = F.expr(f"shiftleft(shiftright(m.v, greatest(0, length(bin(m.v)) - {BITS})), greatest(0, length(bin(m.v)) - {BITS}))")
    passed = rows.where("NOT base_failed").select("lang", "source", measures)
    return passed.groupBy("lang", "source", "m.measure", low.alias("low")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, least: int, wide: float) -> DataFrame:
    """(lang, source, and <measure>_from, <measure>_to for each of RULES): a row for each language and source in the sketch.

    Quartiles are those of the bucket that holds them. A fence is `wide` times their distance, and at least a rule's
    own, away from them. Each level of merging is one more grouping of the sketch's rows.
    """
    size = sketch.where(F.col("measure") == RULES[0][0]).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = F.sum("n").over(W.partitionBy("lang"))
    level = F.when(F.col("n") >= least, 0).when(of_lang >= least, 1).otherwise(2)
    size = size.select("lang", "source", level.alias("level"))
    by = lambda k: [F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None).cast("string")).alias("lang"), (F.col("source") if k < 1 else F.lit(None).cast("string")).alias("source")]
    levels = [sketch.groupBy(*by(k), "measure", "low").agg(F.sum("n").alias("n")) for k in range(3)]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    key = ["level", "lang", "source", "measure"]
    upto = F.sum("n").over(W.partitionBy(*key).orderBy("low"))
    every = every.select("*", upto.alias("upto"), F.sum("n").over(W.partitionBy(*key)).alias("whole"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("whole") * q, F.col("low")))
    found = every.groupBy(*key).agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    of = lambda name, c: F.max(F.when(F.col("measure") == name, c))
    columns = []
    for name, both, room in RULES:
        away = F.greatest(wide * (F.col("q3") - F.col("q1")), F.lit(float(room)))
        columns += [of(name, F.col("q1") - away if both else F.lit(0.0)).alias(f"{name}_from"), of(name, F.col("q3") + away).alias(f"{name}_to")]
    found = found.groupBy("level", "lang", "source").agg(*columns)
    keys = size.select("lang", "source", "level", F.when(F.col("level") < 2, F.col("lang")).alias("of_lang"), F.when(F.col("level") < 1, F.col("source")).alias("of_source"))
    at, own = keys.alias("s"), found.alias("f")
    same = (F.col("s.level") == F.col("f.level")) & F.col("s.of_lang").eqNullSafe(F.col("f.lang")) & F.col("s.of_source").eqNullSafe(F.col("f.source"))
    return at.join(own, same).select("s.lang", "s.source", *[F.col(f"f.{c}") for c in found.columns[3:]])


def judged(docs: DataFrame, least: int = 50, wide: float = 3.0) -> DataFrame:
    """`measured` with the measures of RULES and kept: the base is passed and every measure is within its fences.

    least: texts that a language's source needs for thresholds of its own, else those of its language count, else all.
    Null languages and sources are values of their own. An empty table gives no rows.
    """
    rows = store(measured(docs).select("*", *values()), "measured")
    found = store(fences(sketches(rows), least, wide), "fences")
    at, own = rows.alias("d"), found.alias("f")
    joined = at.join(own, F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    within = [F.col(f"d.{name}").between(F.col(f"f.{name}_from"), F.col(f"f.{name}_to")) for name, _, _ in RULES]
    fits = within[0]
    for w in within[1:]:
        fits &= w
    return joined.select("d.*", (~F.col("d.base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))


def kept(docs: DataFrame, least: int = 50, wide: float = 3.0) -> DataFrame:
    """doc_id, the base's counts, base_failed and kept of every row of docs."""
    return judged(docs, least, wide).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
