"""URL filters in DataFrame functions only.

A list of canonical URLs (of any size) and a list of rules (host, path prefix,
verdict) are entries under one kind of key: host and path, written together.
A URL is expanded to the keys under which an entry could fit it.  A blocked
Bloom filter of all entries' keys, four bits of a 64-bit block a key, passes the
possible hits; an exact hash join with the entries removes the false positives.
The filter is a subquery's array of BLOOM_BYTES at most (with a longer list it
only passes more).  The entries are broadcast if they are measured to take
BROADCAST_BYTES at most, else joined by key.  What a page's keys have found is
combined by page: map-side first, so one narrow row a page is shuffled, once,
and no URL is a key of a shuffle.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A rule fits its
host and all subdomains if the path begins with the rule's; the longest rule
wins (then the longest host, then the text).  A listed URL fits a URL of the
same canonical form, and a listed site (path ``/`` alone) all of its site and
subdomains.  Canonical form: host without a leading ``www.`` and path without
trailing slashes, but at least ``/``; scheme, query and fragment don't count.

Edge cases: a null URL, or one without ``://``, has empty host and path and
fits nothing, so it is allowed; repeated rows get equal verdicts; duplicate
entries count once; empty rules or an empty list are fine; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Bloom filter's size at most.
BLOOM_BYTES = 4 << 20
#: Up to this measured size the entries are broadcast.
BROADCAST_BYTES = 32 << 20
#: Rules are a parameter, not a table.
MOST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Sites that the pages query lists.
LISTED = ["spam-farm.example.org/", "cheap-pills.example.com/", "spam-farm.example.com/", "cheap-pills.example.org/", "spam-farm.example.net/", "cheap-pills.example.net/"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(host, r"^www\.", "")
    trimmed = F.regexp_replace(path, r"/+$", "")
    return F.concat(bare, F.when(trimmed == "", F.lit("/")).otherwise(trimmed))


def _bits(key: Column) -> Column:
    """Four of 64 bits."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", one, F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: the array of blocks that hold the bits of the column key."""
    held = keys.select(_block(F.col("key"), blocks).alias("block"), _bits(F.col("key")).alias("own")).groupBy("block").agg(F.bit_or("own").alias("bits"))
    every = keys.sparkSession.range(blocks).join(held, F.col("id") == F.col("block"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, or null), listed, verdict (allow or block).

    listed has a column ``key`` of canonical URLs.
    """
    spark = pages.sparkSession
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    own = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = own.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    # a rule's number grows with its right of way
    ordered = sorted({(len(host + path), len(host), host + path, verdict, path != "") for verdict, host, path in rules})
    of_rules = spark.createDataFrame([(key, verdict, n, below) for n, (_, _, key, verdict, below) in enumerate(ordered)], "key string, rule_verdict string, number int, below boolean")
    of_list = listed.select("key").where("key is not null").distinct().select("key", F.lit(None).cast("int").alias("number"), F.lit(False).alias("below"), F.lit(True).alias("in_list"))
    entries = of_rules.select("key", "number", "below", F.lit(False).alias("in_list")).union(of_list)
    count, size = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    blocks = max(1, min(-(-count * 16 // 64), BLOOM_BYTES // 8))
    bits = bloom_filter(entries.select("key"), blocks).scalar()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted({len(path) for _, _, path in rules})]).cast("array<int>"), lambda n: n <= F.length("path"))
    of_prefix = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substr(F.col("path"), F.lit(1), n)))))
    sites = F.transform(suffixes, lambda s: F.concat(s, F.lit("/")))
    whole = F.array(F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))))
    # every page keeps one row without a key
    probes = own.withColumn("key", F.explode(F.array_distinct(F.concat(of_prefix, sites, whole, F.array(F.lit(None).cast("string"))))))
    own_bits = _bits(F.col("key"))
    possible = probes.where(F.col("key").isNull() | (F.get(bits, _block(F.col("key"), blocks).cast("int")).bitwiseAND(own_bits) == own_bits))
    if size <= BROADCAST_BYTES:
        met = possible.join(F.broadcast(entries), "key", "left")
    else:  # pages without a key have one of their own, so that no task gets them all
        met = possible.withColumn("key", F.coalesce("key", F.concat(F.lit("\0"), F.col("row").cast("string")))).join(entries, "key", "left")
    # a site's key also stands for a rule with path "/": such a rule needs a path
    fits = F.when(~F.col("below") | (F.col("path") != ""), F.col("number"))
    told = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("number"), F.max(F.coalesce("in_list", F.lit(False)).cast("int")).alias("found"))
    told = told.join(F.broadcast(of_rules.withColumnRenamed("key", "rule")), "number", "left")
    return told.select("page_id", "host", "path", "rule", (F.col("found") == 1).alias("listed"), F.coalesce("rule_verdict", F.when(F.col("found") == 1, "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    listed = ", ".join(f"('{x[:-1]}')" for x in LISTED)
    return f"""
WITH p AS (SELECT page_id, url, row_number() OVER () AS rn, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, rn, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, h, pre) AS (VALUES {rules}),
l(site) AS (VALUES {listed}),
m AS (SELECT rn, h || pre AS rule, verdict, row_number() OVER (PARTITION BY rn ORDER BY length(h || pre) DESC, length(h) DESC, h || pre DESC) AS k FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)),
s AS (SELECT DISTINCT rn FROM u JOIN l ON host = site OR ends_with(host, '.' || site))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, CASE WHEN s.rn IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM u LEFT JOIN m ON m.rn = u.rn AND m.k = 1 LEFT JOIN s ON s.rn = u.rn
"""


OP4_SQL = _sql()
