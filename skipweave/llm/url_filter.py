"""URL filters: a sort-merge range join of pages and rules on reversed hosts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skipweave.llm.common import scratch_table

# The rules (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Keys that are sampled for each partition to find its bounds.
SAMPLE = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    """org.example. for example.org: the keys of a host and its subdomains are those that begin with the host's key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(default: str):
    """Sorted rows, rules before pages of one key: a stack holds the rules whose host covers the present key."""

    def run(frames):
        part, stack = None, []  # of (host key, {path: rule}, path lengths from the longest down)
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                if row.part != part:
                    part, stack = row.part, []
                while stack and not row.key.startswith(stack[-1][0]):
                    stack.pop()
                if row.is_rule:
                    if not stack or stack[-1][0] != row.key:
                        stack.append((row.key, {}, []))
                    _, paths, sizes = stack[-1]
                    rule = (len(row.host) + len(row.path), len(row.host), row.verdict, f"{row.host}{row.path}")
                    paths[row.path] = min(paths.get(row.path, rule), rule, key=lambda r: r[2] != "block")
                    if len(row.path) not in sizes:
                        sizes.append(len(row.path))
                        sizes.sort(reverse=True)
                    continue
                best = None
                for _, paths, sizes in stack:
                    for n in sizes:
                        rule = paths.get(row.path[:n])
                        if rule and len(row.path) >= n:
                            best = rule if best is None else max(best, rule)
                            break
                out.append((row.page_id, row.host, row.path, best[3] if best else None, best[2] if best else default))
            frame = pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"])
            frame["rule"] = frame["rule"].astype(object).where(frame["rule"].notna(), None)
            yield frame

    return run


def url_filter(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict.

    rules has verdict, host and path. A rule fits its host and all subdomains where the path begins with the rule's path; of
    those that fit, the longest host and path together wins, then the longer host; of equal rules one that blocks. Null urls and
    urls without :// have empty host and path, no rule and the default verdict. Repeated rows are judged each on its own;
    empty pages give no rows, empty rules the default; other columns play no part.

    Pages and rules are put in ranges of (reversed host, hash of the url), so that one host's pages can lie in many ranges. A rule goes to
    every range that its interval of keys meets: a range holds the rules that begin in it and the few nested ones that reach into it.
    """
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    spread = F.lpad(F.hex(F.xxhash64(F.col(url_col), F.col(id_col))), 16, "0")
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), spread.alias("spread"))
    urls = urls.select("page_id", "host", "path", F.concat(host_key(F.col("host")), F.lit("\x01"), "spread").alias("key"))
    urls = scratch_table(spark, urls, "urls")

    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = urls.count()
    share = min(1.0, SAMPLE * parts / max(rows, 1))
    # at most about SAMPLE keys for each partition, whatever the input
    sample = sorted(r.key for r in urls.filter(F.abs(F.xxhash64("key") % (1 << 40)) < int(share * (1 << 40)) + 1).select("key").collect())
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    shared = spark.sparkContext.broadcast(np.array(bounds, object))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy(object), "right") if len(shared.value) else np.zeros(len(keys), int), dtype="int32")

    placed = urls.select(part_of("key").alias("part"), "key", F.lit(False).alias("is_rule"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    spans = rules.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict").distinct()
    reach = F.explode(F.sequence(part_of("key"), part_of(F.concat("key", F.lit("\U0010ffff")))))
    spans = spans.select(reach.alias("part"), "key", F.lit(True).alias("is_rule"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict")
    both = placed.unionByName(spans).repartition(parts, "part").sortWithinPartitions("part", "key", F.desc("is_rule"))
    return both.mapInPandas(_sweep(default), f"page_id {kind}, host string, path string, rule string, verdict string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), best AS (
  SELECT u.page_id, u.host, u.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
