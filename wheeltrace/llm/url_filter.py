"""Judge URLs: host and path rules first, then a list of canonical URLs.

The list goes into a blocked Bloom filter: each listed URL sets four bits in one 64-bit block
that its hash chooses, and blocks are rows (block, bits). URLs whose four bits are all set are
possible hits; only these enter an exact join with the list, which removes false positives.
DataFrame operations only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheeltrace.llm.common import known_small
from wheeltrace.operators.scale import materialize

# Blocks are made so many that a listed URL has this many bits on average.
BITS_PER_URL = 16
BITS_SET = 4
# A filter of up to so many blocks (16 bytes each) is broadcast, a larger one is joined.
BROADCAST_BLOCKS = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query. A host without a path of its own has "/".
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
# Host labels of the sites whose pages the query lists.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without www., m. or port, and path without .html and closing slashes."""
    short = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":\d*$", "")
    return F.concat(short, F.regexp_replace(path, r"(\.html?|/+)$", ""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's. `rules` is a
    setting of the caller and becomes part of the plan; of equally long ones the first wins.
    """
    longest = sorted(rules, key=lambda rule: -len(rule.text))
    fitting = [
        F.when(
            ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}")))
            & F.startswith(path, F.lit(rule.path)),
            F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")),
        )
        for rule in longest
    ]
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*fitting, none)


def _block(hashed: Column, blocks: int) -> Column:
    return F.pmod(hashed, F.lit(blocks))


def _bits(url: Column) -> Column:
    """Four bits of a block, from a hash other than the one that chooses the block."""
    second = F.xxhash64(F.lit("bits"), url)
    bits = F.lit(0).cast("bigint")
    for k in range(BITS_SET):
        place = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return bits


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the listed URLs (canonical)."""
    return listed.groupBy(_block(F.xxhash64("canonical"), blocks).alias("block")).agg(
        F.bit_or(_bits(F.col("canonical"))).alias("bits")
    )


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url"
) -> DataFrame:
    """All columns of `pages` with host, path, canonical, rule and verdict.

    The longest fitting rule decides. Otherwise a URL is blocked if its canonical form is in
    `listed` (column canonical), else allowed. A null URL, or one without "://", has an empty
    host and path, fits no rule and is allowed. Repeated rows are judged one by one; empty
    tables on either side are fine; input columns with the names above are replaced.
    """
    listed = materialize(
        listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed"
    )
    count = listed.count()
    blocks = max(1, math.ceil(count * BITS_PER_URL / 64))
    filter_blocks = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_blocks = F.broadcast(filter_blocks)
    read = pages.drop("host", "path", "canonical", "rule", "verdict")
    read = read.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    read = read.withColumn("canonical", canonical_url(F.col("host"), F.col("path")))
    read = read.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    hashed = F.xxhash64("canonical")
    probed = (
        read.withColumn("_block", _block(hashed, blocks))
        .join(filter_blocks, F.col("_block") == F.col("block"), "left")
        .withColumn(
            "_possible",
            F.col("_rule").isNull()
            & F.coalesce(
                F.col("bits").bitwiseAND(_bits(F.col("canonical"))) == _bits(F.col("canonical")),
                F.lit(False),
            ),
        )
        .drop("block", "bits", "_block")
    )
    # Possible hits only: the null keys of an outer join over all pages would be a hot key.
    hits = known_small(listed, BROADCAST_BLOCKS // 16).withColumn("_listed", F.lit(True))
    checked = probed.where("_possible").join(hits, "canonical", "left")
    passed = probed.where("NOT _possible").withColumn("_listed", F.lit(None).cast("boolean"))
    both = checked.select(*passed.columns).union(passed)
    verdict = F.coalesce(
        F.col("_rule.verdict"), F.when(F.col("_listed"), F.lit("block")), F.lit("allow")
    )
    return both.select(
        *[c for c in read.columns if c != "_rule"],
        F.col("_rule.rule").alias("rule"),
        verdict.alias("verdict"),
    )


def listed_by_label(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS) -> DataFrame:
    """Canonical URLs of the pages whose host has one of the labels."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select(host.alias("host"), path.alias("path"))
    return own.where(F.arrays_overlap(F.split("host", r"\."), F.lit(list(labels)))).select(
        canonical_url(F.col("host"), F.col("path")).alias("canonical")
    )


_SQL_PARTS = r"""
parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':\d*$', '')
         || regexp_replace(path, '(\.html?|/+)$', '') AS canonical
  FROM split),
rules(verdict, host, path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT p.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM named p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id),
listed AS (
  SELECT DISTINCT canonical FROM named
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'spam-farm', 'casino-win',
                     'adult-x', 'cheap-pills', 'free-bets']))
"""

ORACLE_SQL = f"""
WITH {_SQL_PARTS}
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END)
         AS verdict
FROM named p LEFT JOIN best b USING (page_id) LEFT JOIN listed l USING (canonical)
"""
