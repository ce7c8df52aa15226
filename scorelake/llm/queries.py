"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, collocations, gif, htmltext, jaccard, packing, quality, rules, substring, tokenfile, urlrules, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir).select("doc_id", "text")).drop("set_id")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.quality_scores(_documents(spark, sf_dir).select("doc_id", "text"), labels)


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digests(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_columns(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return rules.quality_rules(_documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs marked by the labels of the document that each shows: low quality or toxic.

    The document's number is the last number of the path.
    """
    number = F.regexp_extract(urlrules.path_of(F.col("url")), r"([0-9]+)[^0-9]*$", 1)
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("marked"))
    return pages.select("url").withColumn("doc_id", number.try_cast("bigint")).join(marks, "doc_id").select("url", "marked")


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return urlrules.url_verdicts(pages, labelled_urls(pages, labels))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrase_collocations(_documents(spark, sf_dir).select("lang", "text"))


@query
def op12_best_fit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pack_windows(_documents(spark, sf_dir).select("doc_id", "text"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_counts(_documents(spark, sf_dir).select("doc_id", "text"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES["op1_ngram_jaccard"] = f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)
"""

ORACLES["op3_substring_dedup"] = f"""
WITH
w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS v FROM g),
c AS (SELECT doc_id, list(DISTINCT i) AS starts FROM h WHERE v IN (SELECT v FROM h GROUP BY v HAVING count(*) > 1) GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 35)))) AS g FROM c),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
         list_transform(list_filter(range(1, len(ws) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)), lambda i: ws[i]) AS kept
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

ORACLES["op8_html_main_text"] = r"""
WITH
p AS (SELECT page_id, url, coalesce(html, '') AS html, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
a AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS x FROM p),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a),
r AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(html, '<(article|script|style|title)[^>]*>.*?</(article|script|style|title)>', '<p>', 'gs'), '<!--.*?-->', '', 'gs'), '</?a[^>]*>', '', 'g') AS x FROM p),
k AS (SELECT page_id, host, generate_subscripts(bs, 1) AS block, unnest(bs) AS b FROM (SELECT page_id, host, regexp_split_to_array(x, '<[^>]*>') AS bs FROM r)),
w AS (SELECT page_id, host, block, regexp_extract_all(regexp_replace(b, '&[a-z]+;?', '&', 'g'), '[^\s]+') AS ws FROM k),
g AS (SELECT page_id, host, block, unnest(range(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 6),
h AS (SELECT page_id, host, block, i, array_to_string(ws[i:i + 5], ' ') AS v FROM g),
m AS (SELECT host, v FROM h GROUP BY host, v HAVING count(DISTINCT page_id) > 1),
c AS (SELECT page_id, block, unnest(range(i, i + 6)) AS place FROM h SEMI JOIN m USING (host, v)),
n AS (SELECT page_id, count(DISTINCT (block, place)) AS n FROM c GROUP BY page_id)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars, CAST(coalesce(n.n, 0) AS BIGINT) AS n_boilerplate FROM t LEFT JOIN n USING (page_id)
"""

ORACLES["op11_phrase_collocations"] = r"""
WITH
d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, k, unnest(CASE WHEN len(ws) >= k THEN list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')) ELSE [] END) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) v(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT x.lang, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, (CAST(2000000 AS HUGEINT) * x.a) // (l.a + r.a) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[x.cut + 1:x.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, array_to_string(ws[1:k - 1], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(ws[2:k], ' ') AS phrase, a FROM c) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, CAST(score AS BIGINT) AS score
FROM b JOIN n USING (lang) LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase
WHERE NOT coalesce(100 * CAST(e.longer AS HUGEINT) >= 80 * CAST(b.a AS HUGEINT), false)
QUALIFY rank <= 2000
"""
