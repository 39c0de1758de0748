"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bpe, decontaminate, jaccard, langid, negatives, periodic, perplexity, quality, secrets, simhash, urls, warc
from .common import fresh_path, read

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
RATIO = secrets.Ratio(RANKS, PATTERN)
RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), RATIO)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs.filter(~langid.held_out(docs["doc_id"]))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff.score(read(spark, sf_dir, "documents"))
    return scores.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"))


def _planted(doc_id: int | None, text: bytes) -> list[bytes]:
    """A text's words; in about a tenth of the documents the words from some place on repeat the first of them with a period."""
    words = text.split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [*words[:a], *(words[a : a + p] * -(-(n - a) // p))[: n - a]]


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.col("vec_id")
    return negatives.mine(read(spark, sf_dir, "embeddings"), ids % 100 == 0, F.when(ids % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digested(periodic.scan(read(spark, sf_dir, "documents"), words_of=_planted))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_perplexity, op2_secrets, op3_warc, op4_langid, op5_bpe, op6_urls, op7_quality, op8_backoff, op9_decontamination, op10_jaccard, op11_negatives, op12_periodic, op13_simhash)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alone(term: str) -> str:
    return f"regexp_matches(coalesce(low, ''), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_OP6 = f"""
WITH parts AS (
  SELECT page_id, url, {_LOWER.format("url")} AS low,
         {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS place
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
hits AS (
  SELECT page_id, host, path,
         {" + ".join(f"{_alone(t)}::int" for t in urls.STRICT)} AS n_strict,
         {" + ".join(f"{_alone(t)}::int" for t in urls.SOFT)} AS n_soft,
         {" + ".join(f"{w} * {_alone(t)}::int" for t, w in urls.SOFT.items())} AS weight
  FROM parts)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN n_strict > 0 OR (n_soft > 1 AND weight >= {urls.LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict::bigint AS n_strict, n_soft::bigint AS n_soft
FROM hits LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (page_id)
"""

_WORDS9 = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP9 = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS9}, []) AS ws FROM documents),
items AS (SELECT item_id, coalesce({_WORDS9}, []) AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
placed AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows)),
found AS (
  SELECT doc_id, item_id, i, p.k AS k
  FROM (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win FROM placed) p JOIN windows w ON p.k = w.k AND p.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS digest
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(h.n, 0)::bigint AS n_hit, coalesce(l.n, 0)::bigint AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

_OP3 = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS one FROM own GROUP BY hex),
coded AS (
  SELECT page_id, strlen(body)::bigint AS payload_bytes, one,
         list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::int, 5))::bigint) AS parts
  FROM own JOIN first USING (hex))
SELECT page_id, payload_bytes,
       array_to_string(list_transform(parts, lambda n: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31)::int + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> one THEN one END AS refers_to, true AS complete
FROM coded
"""
_WORDS10 = f"coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+'), [])"
_SETS10 = f"""
docs AS (SELECT doc_id, {_WORDS10} AS ws FROM {{documents}}),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared x JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * x.n >= 80 * (p.n + q.n - x.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)"""
_OP10 = f"""
WITH RECURSIVE {_SETS10.format(documents="documents")}
SELECT d.doc_id, coalesce(s.n, 0)::bigint AS n_shingles, r.least AS component_id
FROM docs d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
_OP8 = f"""
WITH docs AS (SELECT doc_id, {_WORDS10} AS ws FROM documents),
words AS (
  SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS before, CASE WHEN i > 2 THEN ws[i - 2] END AS first
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs)),
one AS (SELECT w, count(*) AS n FROM words GROUP BY w),
two AS (SELECT before, w, count(*) AS n FROM words WHERE before IS NOT NULL GROUP BY ALL),
three AS (SELECT first, before, w, count(*) AS n FROM words WHERE first IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*)::double AS n FROM words),
scored AS (
  SELECT doc_id, CASE WHEN three.n >= 2 THEN ln(three.n / p.n::double)
                      ELSE CASE WHEN x.first IS NULL THEN 0 ELSE ln(0.4::double) END
                           + CASE WHEN two.n >= 2 THEN ln(two.n / c.n::double)
                                  ELSE ln(a.n / total.n) + CASE WHEN x.before IS NULL THEN 0 ELSE ln(0.4::double) END END END AS s
  FROM words x JOIN one a ON a.w = x.w LEFT JOIN two ON two.before = x.before AND two.w = x.w LEFT JOIN one c ON c.w = x.before
  LEFT JOIN three ON three.first = x.first AND three.before = x.before AND three.w = x.w
  LEFT JOIN two p ON p.before = x.first AND p.w = x.before, total)
SELECT d.doc_id, count(s)::bigint AS n_words, round(coalesce(sum(s), 0), 4) AS log_score, round(avg(s), 6) AS mean_log_score
FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id
"""
_OP11 = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.e, b.e)::bigint AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same) WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, place::int AS rank, negative_id, positive_score, negative_score FROM negatives WHERE place <= 5
"""
ORACLE: dict[str, str] = {"op3_warc": _OP3, "op6_urls": _OP6, "op8_backoff": _OP8, "op9_decontamination": _OP9, "op10_jaccard": _OP10, "op11_negatives": _OP11}
