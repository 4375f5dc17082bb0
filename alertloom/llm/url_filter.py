"""URL filter: path rules first, then a blocked Bloom filter of listed canonical URLs with an exact check.

A listed entry is a URL ``host/path``, made canonical like the pages' own. One
whose canonical path is ``/`` covers its host and all subdomains, any other
covers just itself. Each distinct URL
yields its probes: every host suffix as a site, and its own canonical form. A
probe selects one block of the filter by one hash and tests one bit in each of
the block's eight words by another; possible hits go on to a hash join with
the list, so false positives only cost time. The filter has at most
``MAX_BLOCKS`` rows of nine longs (under 5 MB): that bound is why it may be
broadcast. A longer list raises the share of possible hits, not the result.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is allowed; rows that repeat are judged alike; an empty table
gives an empty result; null entries of the list are ignored; extra columns of
either input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import checked_columns, lower_ascii

MAX_BLOCKS = 65_536
#: Bits of a block for each entry expected in it.
BITS_PER_ENTRY = 16
WORDS = 8


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of two as long, one that blocks."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def canonical_host(host: Column) -> Column:
    """Without user, port, closing dots and a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", ""), r"\.+$|^www\.", "")


def canonical_path(path: Column) -> Column:
    """Without a closing slash or index page; an empty one is ``/``."""
    bare = F.regexp_replace(path, r"(/index\.html?)?/*$", "")
    return F.when(bare == "", "/").otherwise(bare)


def canonical_entry(entry: Column) -> Column:
    """Host and path of a listed URL without scheme, both canonical."""
    host, path = F.regexp_extract(entry, "^[^/?#]*", 0), F.regexp_extract(entry, "^[^/?#]*([^?#]*)", 1)
    return F.concat(canonical_host(lower_ascii(host)), canonical_path(path))


def probes_of(host: Column, path: Column) -> Column:
    """Canonical entries that would list a URL: each host suffix as a site, and the URL itself."""
    name = canonical_host(host)
    labels = F.split(name, r"\.")
    sites = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")),
    )
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_append(sites, F.concat(name, canonical_path(path)))))


def _hashed(entry: Column, blocks: int) -> list[Column]:
    """The block of an entry, and its bit in each of the block's words."""
    bits = F.xxhash64(entry, F.lit("bits"))
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 5 * k).bitwiseAND(31).cast("int")) for k in range(WORDS)]
    return [F.pmod(F.xxhash64(entry), F.lit(blocks)).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(masks)]]


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """The filter: a row (block, f0..f7) for each block that has an entry."""
    hashed = entries.select(*_hashed(F.col("entry"), blocks))
    return hashed.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"f{k}") for k in range(WORDS)])


def listed_hits(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of ``probes`` whose column ``probe`` is one of ``entries`` (distinct, column entry)."""
    n = entries.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_ENTRY // (32 * WORDS))))
    filt = F.broadcast(bloom_blocks(entries, blocks).withColumnRenamed("block", "at"))
    masks = _hashed(F.col("probe"), blocks)
    tested = probes.select("*", *masks).join(filt, F.col("block") == F.col("at"))
    for k in range(WORDS):
        tested = tested.where(F.col(f"w{k}").bitwiseAND(F.col(f"f{k}")) != 0)
    return tested.select(*probes.columns).join(entries.hint("shuffle_hash"), F.col("probe") == F.col("entry")).select(*probes.columns)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by the rules and by ``listed`` (entry: canonical URLs).

    Returns page_id, host, path, rule and verdict (allow or block).
    """
    rows = checked_columns(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    entries = checked_columns(listed, "entry").where("entry is not null").select(canonical_entry(F.col("entry")).alias("entry")).distinct()
    urls = rows.select(F.col("host").alias("on_host"), F.col("path").alias("on_path")).where("host <> ''").distinct()
    probes = urls.select("on_host", "on_path", F.explode(probes_of(F.col("on_host"), F.col("on_path"))).alias("probe"))
    hits = listed_hits(probes, entries).select("on_host", "on_path").distinct()
    judged = rows.join(hits, (F.col("host") == F.col("on_host")) & (F.col("path") == F.col("on_path")), "left")
    chosen = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", "on_host", chosen.alias("chosen")).select(
        "page_id",
        "host",
        "path",
        F.col("chosen.rule").alias("rule"),
        F.coalesce("chosen.verdict", F.when(F.col("on_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
