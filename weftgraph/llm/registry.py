"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .common import held_out, table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .html_extract import BLOCK, extract
from .language_id import FOLD as LANG_FOLD
from .language_id import FOLDS as LANG_FOLDS
from .language_id import fit_languages, identify_languages
from .line_dedup import line_dedup
from .quality import fit_quality, score_quality
from .simhash import near_duplicates
from .token_counts import count_tokens
from .toxicity import FOLD, FOLDS, fit_toxicity, score_toxicity


def _marked(scored: DataFrame, at: float) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _marked(score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"))), 0.5)


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out("doc_id", LANG_FOLDS, LANG_FOLD).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _marked(score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))), 0.3)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode_back=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_decontamination, op4_simhash, op5_exact_dedup, op6_language_id, op7_quality, op8_bpe, op9_html_extract, op10_line_dedup)}


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dwin d JOIN iwin i ON d.win = i.win AND d.n = i.n),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: Greedy longest match: the longest token at each place of each different word, then the walk from its start; bytes as two hexadecimal digits each.
OP2_SQL = f"""
WITH RECURSIVE tokens AS (
  SELECT hex(from_base64(string_split(line, ' ')[1])) AS t
  FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM read_text('{VOCABULARY}')) WHERE line <> ''),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+') AS w FROM documents),
words AS (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM docs)),
coded AS (SELECT w, hex(encode(' ' || w)) AS h FROM words),
most AS (SELECT max(length(t)) AS m FROM tokens),
places AS (SELECT w, h, unnest(range(1, length(h), 2)) AS p FROM coded),
tried AS (SELECT w, h, p, unnest(range(2, least(m, length(h) - p + 1) + 1, 2)) AS n FROM places, most),
longest AS (SELECT w, p, max(n) AS n FROM tried JOIN tokens ON t = substr(h, p, n) GROUP BY w, p),
walk AS (
  SELECT w, 1 AS p, 0 AS k FROM coded
  UNION ALL SELECT walk.w, walk.p + longest.n, k + 1 FROM walk JOIN longest ON longest.w = walk.w AND longest.p = walk.p),
counts AS (SELECT w, max(k) AS k FROM walk GROUP BY w),
each AS (SELECT r, count(*) AS n_words, sum(k) AS n_tokens FROM (SELECT r, unnest(w) AS w FROM docs) JOIN counts USING (w) GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens FROM docs LEFT JOIN each USING (r)
"""

#: What these pages hold of <article>: blocks by their tags, without adverts and reader comments.
OP9_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?is)<article\b[^>]*>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(x, '(?is)<div class="?(ad|comments)"?>.*?</div>', chr(1), 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?i)</?(BLOCKS)\b[^>]*>', chr(1), 'g'), '(?i)<br\b[^>]*>', ' ', 'g'), '(?i)</?[a-z][^>]*>', '', 'g') AS x FROM b),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM c),
e AS (SELECT page_id, url, list_filter(list_transform(string_split(x, chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '') AS x FROM d)
SELECT page_id, url, array_to_string(x, chr(10) || chr(10)) AS text, CAST(length(array_to_string(x, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM e
""".replace("BLOCKS", "|".join(sorted(BLOCK)))

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.keep <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.keep IS NULL OR c.keep = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_token_counts": OP2_SQL, "op3_decontamination": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op9_html_extract": OP9_SQL, "op10_line_dedup": OP10_SQL}
