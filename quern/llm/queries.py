"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, exact_dedup, line_dedup, mixing, near_dedup, pieces, ppm, prefix_tries, quality, sharding, substring_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_multi_index_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "copies")


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.clean_documents(docs))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pieces.decoded(pieces.encoded(docs))
    return both.select("doc_id", "n_pieces", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op11_prefix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tries.prefix_nodes(prefix_tries.rebuilt(_table(spark, sf_dir, "conversations")))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.sharded(_table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index_ann": op1_multi_index_ann,
    "op2_ppm_score": op2_ppm_score,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_fuzzy_line_dedup": op6_fuzzy_line_dedup,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_tries": op11_prefix_tries,
    "op12_external_shuffle": op12_external_shuffle,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op3_temperature_mixing": f"""
        WITH RECURSIVE d AS (
               SELECT doc_id, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n FROM documents),
             s AS (SELECT source, sum(n)::DOUBLE AS t FROM d GROUP BY source),
             a AS (SELECT sum(t) AS t, count(*) AS n FROM s WHERE t > 0),
             b(step, lo, hi) AS (
               SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL
               SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
               FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
                            (SELECT (ln(sum(pow(s.t / a.t, (lo + hi) / 2))) - sum(pow(s.t / a.t, (lo + hi) / 2) * (lo + hi) / 2 * ln(s.t / a.t)) / sum(pow(s.t / a.t, (lo + hi) / 2))) / ln(any_value(a.n))
                             FROM s, a WHERE s.t > 0) >= {mixing.ENTROPY} AS ok
                     FROM b WHERE step < {mixing.STEPS})),
             e AS (SELECT CASE WHEN (SELECT (ln(sum(s.t / a.t)) - sum(s.t / a.t * ln(s.t / a.t))) / ln(any_value(a.n)) FROM s, a WHERE s.t > 0) >= {mixing.ENTROPY}
                          THEN 1 ELSE (SELECT lo FROM b WHERE step = {mixing.STEPS}) END AS x),
             p AS (SELECT source, s.t, CASE WHEN s.t > 0 THEN pow(s.t / a.t, e.x) ELSE 0 END AS w FROM s, a, e),
             q AS (SELECT source, t, round(w / sum(w) OVER (), 9) AS weight, floor(round(w / sum(w) OVER (), 9) * sum(t) OVER ()) AS quota FROM p),
             f AS (SELECT source, weight, CASE WHEN t > 0 THEN floor(quota / t) ELSE 0 END AS full_, quota - CASE WHEN t > 0 THEN floor(quota / t) ELSE 0 END * t AS rest FROM q),
             o AS (SELECT d.*, weight, full_::BIGINT AS full_, rest,
                          sum(n) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', '{mixing.SEED}', full_::BIGINT, doc_id)), text ROWS UNBOUNDED PRECEDING) AS upto
                   FROM d JOIN f USING (source))
        SELECT doc_id, source, n AS n_tokens, weight, full_ + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS copies FROM o""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op4_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents),
             p AS (SELECT doc_id, unnest(range(1, len(a) - 11)) AS i, a FROM w WHERE len(a) >= 13),
             h AS (SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS s FROM p),
             m AS (SELECT s, min(doc_id) AS lo FROM h GROUP BY s HAVING min(doc_id) < max(doc_id)),
             g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM h JOIN m USING (s) WHERE doc_id > lo),
             k AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
             r AS (SELECT w.doc_id, len(a) AS n, coalesce(len(gone), 0) AS x,
                          list_filter(a, lambda e, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM w LEFT JOIN k USING (doc_id))
        SELECT doc_id, n AS n_words, x AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM r""",
    "op11_prefix_tries": """
        WITH t AS (SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS label, length(coalesce(text, '')) AS chars
                   FROM conversations WHERE conv_id IS NOT NULL),
             o AS (SELECT conv_id, list({'label': label, 'chars': chars} ORDER BY turn NULLS FIRST, label) AS own FROM t GROUP BY conv_id),
             crc AS (SELECT n::UBIGINT AS n, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, n::UBIGINT) AS v FROM range(256) r(n)),
             tab AS (SELECT list(v ORDER BY n) AS a FROM crc),
             h AS (SELECT conv_id, own, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
                          lambda c, b: xor(a[(xor(c, b) & 255::UBIGINT)::BIGINT + 1], c >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) % 6 AS h FROM o, tab),
             r AS (SELECT h.conv_id, list_concat(coalesce(f.own, [])[1:h.h], h.own[h.h + 1:]) AS w FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 100),
             p AS (SELECT conv_id, len(w) AS n, d, list_transform(w[1:d], lambda x: x.label) AS path, w[d].chars AS chars FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)),
             s AS (SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars), 0) AS chars,
                          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM p GROUP BY path),
             k AS (SELECT path[1:depth - 1] AS path, count(*) AS kids FROM s WHERE depth > 0 GROUP BY 1),
             x AS (SELECT s.*, coalesce(kids, 0) AS kids, u.conv_id AS parent FROM s LEFT JOIN k USING (path) LEFT JOIN s u ON s.depth > 0 AND u.path = s.path[1:s.depth - 1]),
             y AS (SELECT path[1:a] AS path, count(*) FILTER (kids = 0) AS leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM x) GROUP BY 1)
        SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
        FROM x JOIN y USING (path)""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
             w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
             v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
             g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (lang)),
             c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
             gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
             p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(gn.n, 0) + 5 * g.v) AS p
                   FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
             l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
             pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN (SELECT x.lang, x.source AS sa, y.source AS sb, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY ALL) z ON z.lang = a.lang AND sa = a.source AND sb = b.source),
             term AS (SELECT p.lang, source, term AS item, p - q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
             every AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
