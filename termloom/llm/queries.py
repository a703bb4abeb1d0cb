"""The registered query of each training-data operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import literal_rows, table
from termloom.llm.exact_dedup import exact_dedup
from termloom.llm.language import identify_language
from termloom.llm.line_dedup import line_dedup
from termloom.llm.mixing import mix
from termloom.llm.neighbours import nearest
from termloom.llm.ngram_join import ngram_join
from termloom.llm.packing import pack
from termloom.llm.quality import score_quality
from termloom.llm.token_counts import token_counts
from termloom.llm.url_filter import url_filter

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "text", "lines", "dropped")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), split AS (
  SELECT doc_id, line, place, list_filter(regexp_split_to_array(line, '\s+'), lambda t: t <> '') AS words FROM lines
), masked AS (
  SELECT doc_id, line, place, len(words) AS n, len(words) // 3 AS third,
         list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t
  FROM split
), runs AS (
  SELECT *, array_to_string(t[1:2], ' ') AS head, array_to_string(t[1:third], ' ') AS a,
         array_to_string(t[third + 1:2 * third], ' ') AS b, array_to_string(t[2 * third + 1:n], ' ') AS c
  FROM masked WHERE n > 0
), keys AS (
  SELECT doc_id, place, n, unnest(CASE WHEN n >= 9
    THEN ['3|' || a || '|' || b || '|' || c, '0|' || head || '|' || b || '|' || c, '1|' || head || '|' || a || '|' || c,
          '2|' || head || '|' || a || '|' || b]
    ELSE ['3|' || a || '|' || b || '|' || c] END) AS key
  FROM runs
), recurring AS (
  SELECT n, key, min(doc_id) AS first_doc FROM keys
  GROUP BY n, key HAVING count(DISTINCT doc_id) >= CASE WHEN n >= 20 THEN 2 ELSE 10 END
), firsts AS (
  SELECT n, key, doc_id, min(place) AS place FROM keys JOIN recurring USING (n, key) WHERE doc_id = first_doc GROUP BY n, key, doc_id
), gone AS (
  SELECT DISTINCT keys.doc_id, keys.place FROM keys JOIN firsts USING (n, key)
  WHERE keys.doc_id <> firsts.doc_id OR keys.place <> firsts.place
), marked AS (
  SELECT lines.doc_id, lines.line, lines.place, gone.place IS NOT NULL AS went
  FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.place = gone.place
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT went), '') AS text,
       CAST(count(*) AS INTEGER) AS lines, CAST(count(*) FILTER (WHERE went) AS INTEGER) AS dropped
FROM marked GROUP BY doc_id
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


#: Every pair that shares an n-gram is compared here: right for small tables only.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents
), texts AS (
  SELECT doc_id, w, len(w) AS n, array_to_string(w, ' ') AS t FROM words
), grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, n - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM texts WHERE n >= 5
), sizes AS (
  SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), near AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE common >= 0.8 * (a.size + b.size - common) - 1e-9
), same AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM texts a JOIN texts b ON a.t = b.t AND a.doc_id <> b.doc_id
), linked AS (
  SELECT x, y FROM near UNION SELECT x, y FROM same
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM texts UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x
), classes AS (
  SELECT x AS doc_id, min(y) AS class_id, count(*) AS class_docs FROM reach GROUP BY x
), copies AS (
  SELECT t, count(*) - 1 AS copies FROM texts GROUP BY t
), links AS (
  SELECT x AS doc_id, count(*) AS links FROM linked GROUP BY x
)
SELECT doc_id, class_id, class_docs, copies, CAST(coalesce(links, 0) AS BIGINT) AS links, doc_id = class_id AS keeps
FROM texts JOIN classes USING (doc_id) JOIN copies USING (t) LEFT JOIN links USING (doc_id)
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH norm AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), grouped AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM norm JOIN grouped USING (text_sha256)
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, [dict(zip(("host", "path", "verdict"), r, strict=True)) for r in URL_RULES], "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


OP5_SQL = """
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), bare AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
    THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS bare
  FROM pages
), parts AS (
  SELECT page_id, split_part(bare, '/', 1) AS raw_host, substr(bare, length(split_part(bare, '/', 1)) + 1) AS path FROM bare
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT urls.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits ON urls.page_id = fits.page_id AND place = 1
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).documents


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op5_url_filter": OP5_SQL}
