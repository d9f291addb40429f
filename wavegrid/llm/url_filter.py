"""Operator 1, URL filters: longest-match rules, then a blocked Bloom filter before an exact hash join.

Built of SQL functions only. A URL that a rule fits takes the rule's verdict. The canonical form of any
other URL is tested against a blocked Bloom filter of the listed canonical URLs: one 256-bit block per
URL, eight bits in it. The few that pass go to an exact join with the list, which removes the false
positives; all others never leave their task. The filter grows with the list, 12 bits a URL, and stands in
rows of SEGMENT blocks. Up to BROADCAST_BLOCKS blocks of 32 bytes it is broadcast; beyond, the join with its
rows is an ordinary one, in which URLs meet their block by its number.

Up to CASE_RULES rules are tried by one expression; more are a table, joined by host suffix to each distinct
(host, path), of whose fitting rules the first in order is kept.

Defined cases: a null URL, or one without ``://``, has empty host and path, no canonical form, fits only
a rule without a host and is else allowed; repeated rows stay repeated; of equally long rules a blocking one wins, then the smaller
string; an empty list or table works; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm._store import materialise
from wavegrid.llm.words import lower_ascii

#: 12 bits a listed URL: about 20 URLs in a block of 256 bits, one false positive in 200 or so.
BITS_PER_URL = 12
BROADCAST_BLOCKS = 1 << 18
SEGMENT = 1024
CASE_RULES = 100


@dataclass(frozen=True)
class Rule:
    """verdict for every URL on host (or below it) whose path begins with path."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host) :]


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without www. or a default port, path without closing slashes or .html, query without tracking keys; null without ``://``."""
    site = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_\w+|gclid|fbclid|ref)(=|$)")))
    return F.when(F.contains(url, F.lit("://")), F.concat(site, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _fits(rule: Rule, h: Column, p: Column) -> Column:
    on = (h == rule.host) | F.endswith(h, F.lit("." + rule.host)) if rule.host else F.lit(True)
    return on & F.startswith(p, F.lit(rule.path))


def _ruled(judged: DataFrame, best: list[Rule]) -> DataFrame:
    """Adds rule and by_rule, its verdict, of the first of the rules that fits."""
    if len(best) <= CASE_RULES:
        first = lambda value: F.coalesce(*[F.when(_fits(r, F.col("host"), F.col("path")), F.lit(value(r))) for r in best], F.lit(None).cast("string"))
        return judged.withColumns({"rule": first(lambda r: r.rule), "by_rule": first(lambda r: r.verdict)})
    rows = [(r.host, r.path, r.rule, r.verdict, i) for i, r in enumerate(best)]
    table = judged.sparkSession.createDataFrame(rows, "site string, start string, rule string, verdict string, place int")
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    places = judged.select("host", "path").distinct()
    tried = places.withColumn("site", F.explode(F.array_distinct(F.concat(tails, F.array(F.lit(""))))))
    found = tried.join(table, "site").where(F.startswith("path", "start"))
    found = found.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), "place").alias("r")).select("host", "path", "r.rule", F.col("r.verdict").alias("by_rule"))
    return judged.join(found, ["host", "path"], "left")


def _mask(url: Column) -> list[Column]:
    """Four longs with two bits each: the URL's bits in its block, taken from 40 bits of a second hash."""
    h = F.xxhash64(url, F.lit(1))
    bit = lambda i: F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31))
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    return [one(bit(2 * i)).bitwiseOR(one(bit(2 * i + 1) + 32)) for i in range(4)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """segment, words: four longs for each of SEGMENT blocks (fewer in the last), in their order."""
    masks = [m.alias(f"m{i}") for i, m in enumerate(_mask(F.col("canonical_url")))]
    bits = listed.select(_block(F.col("canonical_url"), blocks).alias("block"), *masks)
    every = listed.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), *[F.lit(0).cast("long").alias(f"m{i}") for i in range(4)])
    words = bits.unionByName(every).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(4)])
    block = F.struct("block", F.array("w0", "w1", "w2", "w3").alias("w"))
    rows = words.groupBy(F.floor(F.col("block") / SEGMENT).cast("int").alias("segment")).agg(F.array_sort(F.collect_list(block)).alias("b"))  # SEGMENT blocks
    return rows.select("segment", F.flatten(F.transform("b", lambda b: b["w"])).alias("words"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed; ``listed`` has a column canonical_url."""
    listed = materialise(listed.select("canonical_url").where("canonical_url is not null").distinct(), "listed")
    blocks = listed.count() * BITS_PER_URL // 256 + 1
    words = bloom_filter(listed, blocks)
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words  # 10 MB at most

    judged = pages.select("page_id", F.col("url").alias("_url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    judged = _ruled(judged, sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule)))
    judged = judged.withColumn("canonical_url", canonical(F.col("_url"))).drop("_url")

    block = _block(F.col("canonical_url"), blocks)
    hit = F.col("segment") == F.floor(block / SEGMENT).cast("int")
    for i, m in enumerate(_mask(F.col("canonical_url"))):
        hit = hit & (F.element_at("words", block % SEGMENT * 4 + (i + 1)).bitwiseAND(m) == m)
    hit = hit & F.col("by_rule").isNull()
    possible = judged.join(words, hit, "left_semi")
    out = ["page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical_url", "listed"]
    sure = judged.join(words, hit, "left_anti").withColumn("listed", F.lit(False))
    exact = possible.join(listed.withColumn("_in", F.lit(True)), "canonical_url", "left").withColumn("listed", F.coalesce("_in", F.lit(False)))
    return sure.select(*out).unionByName(exact.select(*out))


def urls_on_hosts(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """A list to filter by: canonical URLs of the pages on (or below) the given hosts."""
    h = host(F.col("url"))
    on = F.lit(False)
    for name in hosts:
        on = on | (h == name) | F.endswith(h, F.lit("." + name))
    return pages.where(on).select(canonical(F.col("url")).alias("canonical_url"))
