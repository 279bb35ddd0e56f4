"""URL rules and lists, behind a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block has WORDS longs; a listed key sets one bit in each. Keys a block, as it is sized.
WORDS, KEYS_PER_BLOCK = 4, 16
#: Filters of up to so many blocks (40 bytes each) are sent to all executors; larger ones are joined by block, with the same result.
SENT_BLOCKS = 1 << 17


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def _plain(text: Column) -> Column:
    """text with percent signs decoded where they stand for letters, digits and -._~, and other codes in capitals."""

    def part(x: Column, i: Column) -> Column:
        char = F.call_function("char", F.conv(F.substring(x, 1, 2), 16, 10).cast("bigint"))
        code = F.when(char.rlike(r"^[A-Za-z0-9._~-]$"), char).otherwise(F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2))))
        return F.when(i == 0, x).when(x.rlike(r"^[0-9A-Fa-f]{2}"), F.concat(code, F.substring(x, F.lit(3), F.length(x)))).otherwise(F.concat(F.lit("%"), x))

    return F.when(F.contains(text, F.lit("%")), F.array_join(F.transform(F.split(text, "%"), part), "")).otherwise(text)


def canonical_host(url: Column) -> Column:
    """The host without user, port 80 or 443, and dot at the end."""
    return F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r"[.]?(:(80|443)?)?$", "")


def canonical(url: Column) -> Column:
    """One form for urls that differ in scheme, capitals of the host, user, default port, needless percent codes or fragment; a missing path is /."""
    where = F.regexp_replace(_plain(path(url)), r"^$", "/")
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]+)", 1)
    return F.concat(canonical_host(url), where, _plain(query))


def entries(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a few rules written in code."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\0"), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    at = [F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in at]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0, w1, ...): the filter of column `key`, a row for each block that isn't empty."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def _probed(keys: DataFrame, key: str, listed: DataFrame, n: int, how: str) -> tuple[DataFrame, Column]:
    """keys joined to their block of the filter of listed, and the test whether all bits are set."""
    blocks = 1 << max(0, (n // KEYS_PER_BLOCK).bit_length())
    table = bloom(listed, blocks)
    table = F.broadcast(table) if blocks <= SENT_BLOCKS else table
    rows = keys.withColumn("_block", _block(F.col(key), blocks)).join(table, F.col("_block") == F.col("block"), how)
    test = F.lit(True)
    for k, bit in enumerate(_bits(F.col(key))):
        test = test & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    return rows, F.coalesce(test, F.lit(False))


def passing(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of keys whose `key` may be a `key` of listed."""
    rows, test = _probed(keys, "key", listed, listed.count(), "inner")
    return rows.where(test).select(*keys.columns)


def split_by(rows: DataFrame, key: str, listed: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be one of the n keys of listed, and the others, whose key certainly isn't."""
    probed, test = _probed(rows, key, listed, n, "left")
    return probed.where(test).select(*rows.columns), probed.where(~test).select(*rows.columns)


def judge(pages: DataFrame, rules: DataFrame, urls: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of pages.

    A rule (host, path, verdict) fits its host and all subdomains if the url's
    path starts with its own; the longest host and path goes first, then block
    before allow. A url without a rule is blocked if its canonical form is a
    `key` of urls; listed tells it. Without either the verdict is the default.
    Null urls and urls without :// have empty host and path, which only a rule
    with an empty host fits, and are not listed; rules and keys with nulls fit
    nothing; urls of any length are compared whole; equal urls are judged once,
    equal rows each have a row; other columns are not read; no rows give no rows.
    """
    named = rules.where("host is not null and path is not null").select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", _key(F.col("host"), F.col("path")).alias("key"))
    lengths = sorted(r[0] for r in named.select(F.length("rule_path")).distinct().collect())  # as many as paths of rules differ in length
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    seen = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.transform(F.filter(F.lit(lengths or [0]), lambda n: F.length("path") >= n), lambda n: F.substring("path", F.lit(1), n))
    keys = seen.select("host", "path", F.explode(ends).alias("h")).select("host", "path", "h", F.explode(heads).alias("p"))
    keys = keys.select("host", "path", _key(F.col("h"), F.col("p")).alias("key"))
    hits = passing(keys, named.select("key").distinct()).join(named, "key")
    rule = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(rule)).alias("length"), (F.col("verdict") != "block").alias("allows"), rule.alias("rule"), "verdict")
    best = hits.groupBy("host", "path").agg(F.min(order).alias("best")).select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best")
    out = rows.join(best, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    if urls is None:
        out = out.withColumn("hit", F.lit(False))
    else:
        known = urls.select(F.col("key").alias("key")).where("key is not null").distinct()
        asked = rows.where(F.contains("url", F.lit("://"))).select("url", canonical(F.col("url")).alias("key")).distinct()
        found = passing(asked, known).join(known, "key", "left_semi").select(F.col("url").alias("of_url"), F.lit(True).alias("hit"))
        out = out.join(found, F.col("url") == F.col("of_url"), "left")
    listed = F.col("best").isNull() & F.coalesce("hit", F.lit(False))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(listed, "block").otherwise(F.coalesce("best.verdict", F.lit(default))).alias("verdict"), listed.alias("listed"))
