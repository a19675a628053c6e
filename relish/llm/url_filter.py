"""Block and allow rules for urls, held in a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for those, and so
on until nothing is mistaken.  A key is listed if the first level that does not
know it is an even one.  Over the keys it was built with the cascade is
exact, at a few bits a key, and judging a url needs no join with the list.

Everything is built from DataFrame functions.  Keys are spread over segments of
bounded size; a single segment is attached as a scalar, more are joined by
segment number, which moves bits, never the list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relish.session import stage

SEGMENT_BITS = 1 << 25  # of all levels of a segment: 4 MB
LATER_RATE = 1 / 16  # false positives of every level but the first
MOST_LEVELS = 60


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://`` or for null."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys, longest first, of rules that could fit: every domain above the host with every path start of a given length."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths])
    keys = F.flatten(F.transform(domains, lambda d: F.transform(F.filter(starts, lambda p: p.isNotNull()), lambda p: F.concat(d, p))))
    by_length = F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return F.transform(by_length, lambda s: s["k"])


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    first, step = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in range(2))
    return [(first + F.lit(i) * step) % F.lit(bits) for i in range(hashes)]


def _known(key: Column, words: Column, level: int, bits: int, hashes: int) -> Column:
    """Whether all bits of the key are set in ``words``, an array of 64-bit words."""
    found = F.lit(True)
    for at in _positions(key, level, bits, hashes):
        word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
        found = found & (F.getbit(word, at.bitwiseAND(63).cast("int")) == 1)
    return found


class Cascade:
    """Exact membership in ``listed`` for the keys of ``universe``.

    ``keys(key, listed)``: distinct keys, each once.  Null keys are not allowed.
    """

    def __init__(self, keys: DataFrame, segment_bits: int = SEGMENT_BITS):
        spark = keys.sparkSession
        counts = keys.agg(F.count_if("listed"), F.count("*")).first()
        listed, others = counts[0], counts[1] - counts[0]
        self.levels: list[tuple[int, int]] = []  # bits of a segment's level and hashes
        first_rate = min(0.5, max(listed, 1) / max(others, 1) / 4)
        need = 1.5 * (listed * 1.45 * math.log2(1 / first_rate) + 8 * listed) + 64
        self.segments = max(1, math.ceil(need / segment_bits))
        keys = keys.withColumn("segment", self.segment("key"))
        inside, outside, filters = keys.filter("listed"), keys.filter("not listed"), None
        many = listed
        for level in range(MOST_LEVELS):
            if not many:
                break
            rate = first_rate if level == 0 else LATER_RATE
            hashes = max(1, round(math.log2(1 / rate)))
            share = many / self.segments
            bits = 64 * math.ceil((share + (4 * math.sqrt(share) if self.segments > 1 else 0)) * 1.45 * math.log2(1 / rate) / 64 + 1)
            self.levels.append((bits, hashes))
            at = F.explode(F.array(*_positions(F.col("key"), level, bits, hashes)))
            words = (inside.select("segment", at.alias("at"))
                     .groupBy("segment", F.shiftright("at", 6).alias("word"))
                     .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("value")))
            width = bits // 64
            frame = spark.range(self.segments * width).select((F.col("id") % width).alias("word"), F.floor(F.col("id") / width).alias("segment"))
            dense = frame.join(words, ["segment", "word"], "left").groupBy("segment").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0)).alias("value")))), lambda s: s["value"]).alias(f"level_{level}"))
            one = stage(dense)
            filters = one if filters is None else filters.join(one, "segment")
            outside_next = stage(self._attach(outside, one).filter(_known(F.col("key"), F.col(f"level_{level}"), level, bits, hashes)).select("key", "segment"))
            inside, outside = outside_next, inside
            many = inside.count()
        else:
            raise RuntimeError("the cascade does not end")
        self.filters = stage(filters) if filters is not None else None

    def segment(self, key) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.segments)).cast("long")

    def _attach(self, rows: DataFrame, filters: DataFrame) -> DataFrame:
        names = [c for c in filters.columns if c != "segment"]
        if self.segments == 1:
            return rows.withColumns({c: filters.select(c).scalar() for c in names})
        return rows.join(filters, "segment")

    def attach(self, rows: DataFrame, key: str) -> DataFrame:
        """``rows`` with the filter's arrays for column ``key`` (several segments: joined by segment)."""
        if self.filters is None:
            return rows
        return self._attach(rows.withColumn("segment", self.segment(key)), self.filters)

    def listed(self, key: Column) -> Column:
        """Whether an attached row's key is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            bits, hashes = self.levels[level]
            found = F.when(_known(key, F.col(f"level_{level}"), level, bits, hashes), found).otherwise(F.lit(level % 2 == 1))
        return found


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed_urls: DataFrame, url: str = "url",
          segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: (verdict, host/path), as ``("block", "example.com/de/")``.  A rule
    fits its host and all subdomains if the url's path starts with the rule's;
    the longest wins (same length: first in text order).  Urls that no rule fits are blocked if
    their host and path are in ``listed_urls(host, path)``, else allowed.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and are allowed unless that empty pair is listed.  Repeated rows are judged
    alike, an empty table gives an empty result, and columns of ``pages`` with
    the result's names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_path(F.col(url))
    lengths = sorted({len(rule) - rule.index("/") for _, rule in rules})
    parsed = pages.withColumn("host", host).withColumn("path", path)
    keyed = parsed.withColumn("_rules", rule_keys(F.col("host"), F.col("path"), lengths))

    marks = keyed.sparkSession.createDataFrame(
        [(f"rule {rule}",) for _, rule in rules] + [(f"block {rule}",) for verdict, rule in rules if verdict == "block"], "key string")
    urls = listed_urls.select(F.concat(F.lit("url "), "host", "path").alias("key"))
    listed = marks.union(urls).select("key", F.lit(True).alias("listed"))
    seen = keyed.select(F.explode(F.concat(
        F.flatten(F.transform("_rules", lambda k: F.array(F.concat(F.lit("rule "), k), F.concat(F.lit("block "), k)))),
        F.array(F.concat(F.lit("url "), "host", "path")))).alias("key"), F.lit(False).alias("listed"))
    keys = stage(listed.union(seen).filter(F.col("key").isNotNull()).groupBy("key").agg(F.bool_or("listed").alias("listed")))
    cascade = Cascade(keys, segment_bits)

    if cascade.segments == 1:
        with_bits = cascade.attach(keyed, "host")
        decided = with_bits.withColumn("rule", F.when(F.size("_rules") > 0, F.try_element_at(
            F.filter("_rules", lambda k: cascade.listed(F.concat(F.lit("rule "), k))), F.lit(1))))
        key = F.when(F.col("rule").isNull(), F.concat(F.lit("url "), "host", "path")).otherwise(F.concat(F.lit("block "), "rule"))
        decided = decided.withColumn("_key", key)
        return decided.withColumn("verdict", F.when(cascade.listed(F.col("_key")), "block").otherwise("allow")).select(*parsed.columns, "rule", "verdict")
    with_id = stage(keyed.withColumn("_row", F.monotonically_increasing_id()))
    tried = cascade.attach(with_id.select("_row", F.posexplode("_rules").alias("_at", "_rule")).withColumn("_key", F.concat(F.lit("rule "), "_rule")), "_key")
    best = tried.filter(cascade.listed(F.col("_key"))).groupBy("_row").agg(F.min_by("_rule", "_at").alias("rule"))
    key = F.when(F.col("rule").isNull(), F.concat(F.lit("url "), "host", "path")).otherwise(F.concat(F.lit("block "), "rule"))
    decided = cascade.attach(with_id.join(best, "_row", "left").withColumn("_key", key), "_key")
    return decided.withColumn("verdict", F.when(cascade.listed(F.col("_key")), "block").otherwise("allow")).select(*parsed.columns, "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(verdict, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
listed AS (
  SELECT DISTINCT host, path FROM parsed SEMI JOIN (SELECT doc_id::VARCHAR AS d FROM labels WHERE toxic = 1) t
    ON t.d = regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1))
SELECT p.page_id, p.host, p.path, first(r.rule ORDER BY length(r.rule) DESC, r.rule) AS rule,
  coalesce(first(r.verdict ORDER BY length(r.rule) DESC, r.rule), CASE WHEN bool_or(l.host IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed p
LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
LEFT JOIN listed l ON l.host = p.host AND l.path = p.path
GROUP BY p.page_id, p.host, p.path
"""
