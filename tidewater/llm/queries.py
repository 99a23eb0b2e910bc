"""One query for each operator over its whole table, under fixed production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, embeddings, fingerprint, licenses, lm, packing, pii, quality, resample, secrets, simhash, toxicity
from .shared import documents, remainder


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip_digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.token_pieces(documents(spark, sf_dir), path, public_tokenizers.PATTERN))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(simhash.fingerprints(documents(spark, sf_dir)))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.report(docs, pii.train(docs))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.alignment(documents(spark, sf_dir), a, b, public_tokenizers.PATTERN)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.kept(documents(spark, sf_dir))


def queries() -> dict:
    found = [
        op1_bpe_codec, op2_embedding_near_dedup, op3_best_fit_packing, op4_toxicity, op5_simhash_near_dedup, op6_pii,
        op7_lm_scoring, op8_secret_scan, op9_fingerprints, op10_license_scan,
        op11_tokenizer_alignment, op12_importance_resampling, op13_quality_rules,
    ]
    return {f.__name__: f for f in found}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are held against brute force in tests/llm."""
    templates = ", ".join(f"('{label}', '{b' '.join(licenses.words(text)).decode()}')" for label, text in licenses.TEMPLATES)
    phrases = ", ".join(f"('{text}', '{label}')" for text, label in licenses.PHRASES.items())
    return {
        "op2_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            r AS (SELECT vec_id AS node, vec_id AS top FROM embeddings UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node),
            c AS (SELECT node, min(top) AS top FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
            SELECT x.vec_id, coalesce(n.n, 0) AS n_links, c.top AS component_id, x.vec_id = c.top AS kept FROM embeddings x JOIN c ON c.node = x.vec_id LEFT JOIN n ON n.a = x.vec_id""",
        "op10_license_scan": f"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
            p AS (SELECT string_split(a, ' ') AS pw, b AS label FROM (VALUES {phrases}) t(a, b)),
            stands AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, label, pw, unnest(range(len(w) - len(pw) + 1)) AS i FROM d, p WHERE len(w) >= len(pw) AND list_has_all(w, pw)) WHERE w[i + 1 : i + len(pw)] = pw),
            base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS labels FROM stands GROUP BY doc_id),
            t AS (SELECT label, list_distinct(string_split(x, ' ')) AS tw, len(string_split(x, ' ')) AS n FROM (VALUES {templates}) t(label, x)),
            k AS (SELECT label, tw, CASE WHEN len(tw) < 10 THEN len(tw) ELSE ceil(0.8 * len(tw) - 1e-9) END AS need, CASE WHEN len(tw) < 10 THEN n ELSE n + n // 4 END AS wide FROM t),
            hope AS (SELECT doc_id, w, label, tw, need, wide FROM (SELECT *, list_distinct(w) AS dw FROM d), k WHERE len(list_intersect(tw, dw)) >= need),
            blocks AS (SELECT label, tw, need, doc_id, w[s + 1 : s + wide] AS b FROM (SELECT *, unnest(range(0, greatest(1, len(w) - wide + 1))) AS s FROM hope)),
            met AS (SELECT doc_id, label, max(len(list_intersect(tw, b)) / len(tw)) AS share FROM blocks WHERE len(list_intersect(tw, b)) >= need GROUP BY ALL),
            more AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
            SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
                   array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
                   CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(more.share, 0.0) END::double AS score
            FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id""",
        "op12_importance_resampling": f"""
            WITH RECURSIVE bits AS (SELECT b, b AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
            c AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8), chars AS (SELECT chr(i) AS c, i FROM range(1, 128) t(i)),
            d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
            m AS (SELECT {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
            w AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT r, w FROM d UNION ALL SELECT -1, w FROM m)),
            f AS (SELECT r, array_to_string(w[i : i + n - 1], ' ') AS f FROM w, range(1, 4) t(n) WHERE i + n - 1 <= len(w)),
            g AS (SELECT r, f, count(*) AS n FROM f GROUP BY r, f),
            x AS (SELECT f, list_transform(list_filter(string_split(regexp_replace(hex(encode(f)), '(..)', '\\1,', 'g'), ','), lambda h: h <> ''), lambda h: ('0x' || h)::BIGINT) AS b FROM (SELECT DISTINCT f FROM f)),
            h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, y: xor(a >> 8, t[xor(a & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM x, c),
            k AS (SELECT bucket, sum(n) FILTER (r > 0) AS s, sum(n) FILTER (r < 0) AS t FROM g JOIN h USING (f) GROUP BY bucket),
            z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM k),
            gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM k, z),
            p AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN h USING (f) JOIN gain USING (bucket) WHERE r > 0 GROUP BY r),
            q AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN p USING (r)),
            o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM q)
            SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * fit // 100 THEN place END AS rank FROM o""",
        "op13_quality_rules": f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents)),
            g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
            again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
            covered AS (SELECT r, sum(least(8, i - before))::BIGINT AS n FROM (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS before FROM again) GROUP BY r),
            m AS (SELECT r, doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(regexp_replace(text, '[^!-/:-@\x5B-\x60\x7B-\x7E]+', '', 'g')) AS n_marks,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
            n AS (SELECT m.* EXCLUDE (lines), len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM m LEFT JOIN covered USING (r)),
            v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, unnest([
                  {{'measure': 'symbols', 'v': coalesce(1000 * n_symbols // nullif(word_chars, 0), 0)}}, {{'measure': 'marks', 'v': coalesce(1000 * n_marks // nullif(word_chars, 0), 0)}},
                  {{'measure': 'word_length', 'v': coalesce(100 * word_chars // nullif(n_words, 0), 0)}}, {{'measure': 'dup_lines', 'v': coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)}},
                  {{'measure': 'repeats', 'v': coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)}}]) AS u FROM n),
            s AS (SELECT lang, source, u.measure AS measure, ((u.v >> greatest(0, len(bin(u.v)) - 6)) << greatest(0, len(bin(u.v)) - 6)) AS low, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
            size AS (SELECT lang, source, CASE WHEN n >= 50 THEN 0 WHEN sum(n) OVER (PARTITION BY lang) >= 50 THEN 1 ELSE 2 END AS level FROM (SELECT lang, source, sum(n) AS n FROM s WHERE measure = 'symbols' GROUP BY ALL)),
            l AS (SELECT k AS level, CASE WHEN k < 2 THEN lang END AS lang, CASE WHEN k < 1 THEN source END AS source, measure, low, sum(n) AS n FROM s, range(3) t(k) GROUP BY ALL),
            c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY low) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS whole FROM l),
            q AS (SELECT level, lang, source, measure, min(low) FILTER (4 * upto >= whole) AS q1, min(low) FILTER (4 * upto >= 3 * whole) AS q3 FROM c GROUP BY ALL),
            b AS (SELECT q.level, q.lang, q.source, q.measure, CASE WHEN measure = 'word_length' THEN q1 - greatest(3 * (q3 - q1), room) ELSE 0 END AS a, q3 + greatest(3 * (q3 - q1), room) AS z
                  FROM q JOIN (VALUES {", ".join(f"('{name}', {room})" for name, _, room in quality.RULES)}) t(measure, room) USING (measure)),
            f AS (SELECT size.lang, size.source, b.measure, b.a, b.z FROM size JOIN b ON b.level = size.level AND b.lang IS NOT DISTINCT FROM CASE WHEN size.level < 2 THEN size.lang END AND b.source IS NOT DISTINCT FROM CASE WHEN size.level < 1 THEN size.source END)
            SELECT v.doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols, any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words,
                   any_value(base_failed) AS base_failed, NOT any_value(base_failed) AND bool_and(coalesce(v.u.v BETWEEN f.a AND f.z, false)) AS kept
            FROM v LEFT JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.measure = v.u.measure GROUP BY v.r, v.doc_id""",
    }
