"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html, lines, lm, mixing, oracles, packing, pivots, prefixes, quality, ranked, simhash, tokens, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.measured(table(spark, sf_dir, "documents"))
    taken = mixing.with_takes(sized, mixing.plan(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "begin", "end", "n_words", "first_doc_id", "first_begin")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.learn_and_score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.components(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_mixing, op3_simhash, op4_quality, op5_exact_dedup, op6_substring_dedup, op7_lm_scoring, op8_token_counts, op9_html_extract, op10_packing, op11_pivots, op12_prefix_trie, op13_ranked_search, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    """The contract's measures, and the threshold table written out for DuckDB."""
    stop = ", ".join(f"'{w}'" for v in dict.fromkeys(quality.STOP_WORDS) for w in dict.fromkeys((v, v.capitalize())))
    held = []
    for name, least, most, since in quality.RULES:
        bounds = " AND ".join([f"{name} >= {least}"] * (least is not None) + [f"{name} <= {most}"] * (most is not None))
        held.append(f"({bounds}{f' OR n_words < {since}' if since else ''})")
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT r, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS s FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT r, least(5, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 5)) AS g FROM twice),
covered AS (SELECT r, sum(g) AS n FROM gaps GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(list_concat(words, ['']), 'string_agg', ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
    FROM w LEFT JOIN covered c USING (r)),
x AS (SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars, n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio,
    n_stop_words::DOUBLE / greatest(n_words, 1) AS stop_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio,
    n_capitals::DOUBLE / greatest(word_chars, 1) AS shouted_ratio, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(held)} AS kept FROM x"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((strpos('0123456789abcdef', substr(x, 1 + (i * 5) // 4, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(x, 2 + (i * 5) // 4, 1)) - 1, 0) >> (3 - (i * 5) % 4)) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to FROM d""",
    "op4_quality": _quality_sql(),
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)""",
    "op11_pivots": oracles.VECTORS,
    "op12_prefix_trie": oracles.TRIE,
    "op13_ranked_search": oracles.RANKED,
}
