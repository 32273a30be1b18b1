"""The registered queries of this package and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import language, token_counts, decontaminate, bpe, exact_dedup, sharding, line_dedup, mixing, near_dedup, periodic_runs, resampling, url_filters, quality
from mensura.llm.common import load


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer("byte_bpe_50k.json"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)



def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"))



def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language.train(docs.where(language.remainder("doc_id") != 2))
    held_out = F.coalesce(language.remainder("doc_id") == 2, F.lit(False))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)



def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(load(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(load(spark, sf_dir, "documents"), shards=24)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.remove_repeated(docs)
    return out.select("doc_id", "n_lines", "lines_removed", "words_removed", "removed_spans", F.sha2("text", 256).alias("text_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).drop("text")


#: The rules of op1's contract.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"), RULES)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, pages = (load(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    return quality.judge(docs, labels, pages)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, aim = (load(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resampling.resample(docs.select("doc_id", "text"), aim).select("doc_id", "n_features", "weight", "score", "rank")


def made_periodic(key: int | None, words: np.ndarray) -> np.ndarray:
    """op12's contract: for a tenth of the keys, by crc32, the words from one place on repeat the first few from there."""
    h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % period]])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.collapse_runs(docs, edit=made_periodic))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken_words(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op2_token_counts": op2_token_counts,
    "op9_language_id": op9_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op1_url_filters": op1_url_filters,
    "op7_quality_classifier": op7_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_mixing": op13_source_mixing,
}

#: SQL of crc32: steps is the table over one byte's values, {bytes} a list of byte values.
_STEPS = """steps AS (SELECT list(list_reduce([i] || [k::BIGINT FOR k IN range(8)], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS step FROM range(256) r(i))"""
_CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || [('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(encode({0})))], lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])))"

SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t""",
    "op11_importance_resampling": f"""
        WITH {_STEPS},
        words AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
            UNION ALL SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
        features AS (SELECT side, doc_id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS f FROM words),
        bags AS (SELECT side, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
        buckets AS (SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM bags), steps),
        counted AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM bags JOIN buckets USING (f) GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM counted),
        weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM bags JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
        scored AS (SELECT d.doc_id, len(w) AS n_words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM words d LEFT JOIN weights USING (doc_id) WHERE side = 0),
        places AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank FROM places""",
    "op12_periodic_runs": f"""
        WITH {_STEPS},
        given AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC.format("doc_id::VARCHAR")} AS h FROM documents, steps),
        chosen AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS edited, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM given),
        edited AS (SELECT doc_id, n, CASE WHEN edited THEN [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] FOR i IN range(n)] ELSE w END AS w FROM chosen),
        words AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
        pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i, row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS k
            FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 3),
        stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM pairs GROUP BY doc_id, q, i - k HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
        best AS (SELECT doc_id, count(*) AS n_runs, arg_min([start, length, period], (-(length / period), start, period)) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS every FROM runs GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words w
            WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = w.doc_id AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b[1] AS start, b[2] AS length, b[3] AS period, 1000 * b[2] // b[3] AS exponent_milli, sha256(coalesce(every, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_source_mixing": """
        WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('42:' || doc_id) AS hashed FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS size FROM sizes GROUP BY source),
        sources AS (SELECT source, size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM totals),
        stops AS (SELECT source, 2.0::DOUBLE * size / weight AS stop, 2.0::DOUBLE * size AS cap, weight, row_number() OVER (ORDER BY 2.0::DOUBLE * size / weight, source) AS k FROM sources),
        levels AS (SELECT k, stop, (sum(cap) OVER () * 0.75 - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM stops),
        level AS (SELECT level FROM levels WHERE level < stop ORDER BY k LIMIT 1),
        aims AS (SELECT source, size AS source_size, least(2.0::DOUBLE * size, coalesce((SELECT level FROM level), 0) * weight) AS target FROM sources),
        placed AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS most, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY hashed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
            FROM sizes s JOIN aims ON s.source IS NOT DISTINCT FROM aims.source)
        SELECT doc_id, size, source_size, target, (greatest(least(place + size, most) - place, 0) + greatest(least(place + source_size + size, most) - place - source_size, 0))::BIGINT AS taken FROM placed""",
}
