"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkscale.llm import exact_dedup, html, jaccard, licenses, lm, mixing, negatives, packing, pii, quality, secrets, simhash, spelling

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_exact_copies(_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_near_copies(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_near_copies(_table(spark, sf_dir, "documents"), size=3)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_personal_data, op3_best_fit_packing, op4_secret_scan, op5_quality_rules, op6_source_mixing, op7_license_scan, op8_html_extraction, op9_ngram_jaccard_join, op10_lm_scoring, op11_simhash_near_dedup, op12_spelling_variants, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS r FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, r = 1 AS kept, sha256(norm) AS text_sha256 FROM g
""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.node) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE
lots AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
own AS MATERIALIZED (SELECT row_number() OVER () AS i, run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL)),
crc(i, x, p, a) AS (SELECT i, x, 1, 4294967295::BIGINT FROM own UNION ALL
  SELECT i, x, p + 2, xor(a >> 8, t[(xor(a, ('0x' || substr(x, p, 2))::BIGINT) & 255) + 1]) FROM crc, lots WHERE p < length(x)),
h AS (SELECT i, xor(a, 4294967295) AS h FROM crc WHERE p > length(x)),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM own JOIN h USING (i)),
w AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS MATERIALIZED (SELECT word, n, k, left(word, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS k FROM w)),
near AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN w ON w.word = c.rest UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN w ON w.word = c.rest),
f AS MATERIALIZED (SELECT word, count(*) AS n_near, CASE WHEN max(near_n) >= 10 * any_value(n) THEN arg_min(near, struct_pack(a := -near_n, b := encode(near))) END AS form, CASE WHEN max(near_n) >= 10 * any_value(n) THEN max(near_n) END AS form_n FROM near GROUP BY word),
up(word, node) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.node WHERE f.form IS NOT NULL),
ends AS (SELECT up.word, up.node FROM up LEFT JOIN f ON f.word = up.node WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(ends.node, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n FROM w LEFT JOIN f USING (word) LEFT JOIN ends USING (word)
""",
    "op13_hard_negatives": r"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
""",
}
