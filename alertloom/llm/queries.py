"""Registered corpus queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.llm.bpe_tree import encode_documents, read_ranks
from alertloom.llm.decision_list import judge
from alertloom.llm.feistel_pii import pseudonymise
from alertloom.llm.lattice_lm import score_documents
from alertloom.llm.lsi_decontam import find_leaks
from alertloom.llm.rlz_dedup import remove_repeats
from alertloom.llm.secret_scan import scan_secrets
from alertloom.llm.simhash_gray import near_duplicates
from alertloom.llm.trie_counts import count_tokens
from alertloom.llm.unigram_vocab import prior, read_pieces
from alertloom.llm.url_filter import Rule, filter_urls

#: Stands for a secret that a deployment supplies; fixed here so that results repeat.
PSEUDONYM_KEY = "registered query"
#: Fixed rules of the URL query.
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Names of unwanted sites; each is listed under three domains, and one subdomain by itself.
LISTED_SITES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED_HOST = "WWW.blog.tiontion.example.net/"
#: Single pages that are listed: every fifth number below a bound, on two hosts.
LISTED_PAGES, PAGE_NUMBERS = ("blog.tionsh.example.com/fr/", "www.ththon.example.org/de/"), (0, 20_000, 5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(_table(spark, sf_dir, "documents"), pieces, np.log(prior(pieces)).tolist())


def op6_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("n_factors")


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_lsi_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), listed_urls(spark), list(URL_RULES))


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list of unwanted URLs (entry), as a deployment would read it from a table."""
    sites = F.explode(F.array(*[F.lit(f"{site}.{domain}/") for site in LISTED_SITES for domain in LISTED_DOMAINS], F.lit(LISTED_HOST)))
    pages = F.explode(F.array(*[F.concat(F.lit(x), F.col("id").cast("string")) for x in LISTED_PAGES]))
    return spark.range(1).select(sites.alias("entry")).unionByName(spark.range(*PAGE_NUMBERS).select(pages.alias("entry")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every corpus query by name."""
    return {
        "op1_feistel_pii": op1_feistel_pii,
        "op2_lattice_lm": op2_lattice_lm,
        "op3_bpe_tree": op3_bpe_tree,
        "op4_secret_scan": op4_secret_scan,
        "op5_trie_counts": op5_trie_counts,
        "op6_rlz_dedup": op6_rlz_dedup,
        "op7_decision_list": op7_decision_list,
        "op8_lsi_decontam": op8_lsi_decontam,
        "op9_simhash_gray": op9_simhash_gray,
        "op10_url_filter": op10_url_filter,
    }


#: DuckDB SQL of the URL query; a site's entry covers its host and subdomains, without user, port and ``www.``;
#: a page's entry covers its URL without a closing slash or index page.
OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), named AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), listed AS (
  SELECT site || '.' || domain AS entry
  FROM (SELECT unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS site)
  CROSS JOIN (SELECT unnest(['example.com', 'example.net', 'example.org']) AS domain)
  UNION ALL SELECT 'blog.tiontion.example.net'
), single AS (
  SELECT page || k AS entry FROM (SELECT unnest(['blog.tionsh.example.com/fr/', 'ththon.example.org/de/']) AS page) CROSS JOIN range(0, 20000, 5) AS t(k)
), judged AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
    END AS rule,
    regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\\.+$', '') AS bare
  FROM named
)
SELECT page_id, host, path, rule,
  CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN EXISTS (SELECT 1 FROM listed WHERE bare = entry OR bare LIKE '%.' || entry) THEN 'block'
    WHEN regexp_replace(bare, '^www\\.', '') || regexp_replace(path, '(/index\\.html?)?/*$', '') IN (SELECT entry FROM single) THEN 'block'
    ELSE 'allow'
  END AS verdict
FROM judged
"""


#: DuckDB SQL of the substring query: every window by its words, the smallest document of each.
OP6_SQL = """
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS run FROM split, unnest(range(1, len(ws) - 11)) AS t(i)
), firsts AS (
  SELECT run, min(doc_id) AS least FROM windows GROUP BY run
), hits AS (
  SELECT doc_id, i FROM windows JOIN firsts USING (run) WHERE least < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hits, unnest(range(13)) AS t(k)
), words AS (
  SELECT doc_id, i, ws[i] AS word FROM split, unnest(range(1, len(ws) + 1)) AS t(i)
), marked AS (
  SELECT w.doc_id, w.i, word, c.i IS NOT NULL AS gone FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.i = w.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
)
SELECT s.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express; the others are tested against brute force."""
    return {"op6_rlz_dedup": OP6_SQL, "op10_url_filter": OP10_SQL}
