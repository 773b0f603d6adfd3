"""URL filter: a sort-merge range join of urls with host and path rules.

A host's canonical key is its labels in reverse order, each followed by a dot: www.example.org is org.example.www. and
the rule host example.org is the prefix org.example., so that a host and all its subdomains are one interval of the
key order. Urls and rules are dealt to ranges of that order, sorted, and swept once: a stack holds the rules whose
intervals contain the current key, each nested in the one below it. At every level the longest path prefix is looked
up; of all that fit, the longest rule (host and path together) wins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, hashed_sample, utf8

#: Ranges that urls are dealt to, for each shuffle partition, and the keys that their bounds are taken from.
RANGES_PER_PARTITION, SAMPLED_KEYS = 4, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """urls with host, path, rule (host and path of the rule that decides, else null) and verdict (its verdict, else `default`).

    `rules` has host, path and verdict strings; rows with a null in one are no rules; of rules with the same host and
    path the smallest verdict holds; among different rules of equal length that with the longer host wins. Urls that
    are null or without :// have empty host and path; only a rule with both empty would fit them. Repeated urls
    are judged row by row; an empty table gives an empty table. Columns of urls named like ours give way to them.

    A url that fills several ranges is dealt over all of them. A rule goes to the ranges its interval meets; what a
    range holds in memory is the stack: the rules of one host and its parents.
    """
    spark = urls.sparkSession
    ours = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    urls, schema = appended(urls, ours)
    width, names = len(urls.columns), schema.names
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or parts * RANGES_PER_PARTITION

    keyed = urls.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    keyed = keyed.withColumn("_key", host_key(F.col("host"))).withColumn("_full", F.concat("_key", F.lit("\0"), "path"))
    drawn = hashed_sample(keyed.select("_full"), F.xxhash64("_full", F.monotonically_increasing_id()), SAMPLED_KEYS, urls.count())
    sample = sorted(r["_full"] for r in drawn.collect())
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample[1:]
    marks = [b.encode() for b in bounds]

    @F.pandas_udf("struct<low: int, high: int>")
    def between(keys: pd.Series, ends: pd.Series) -> pd.DataFrame:
        """How many bounds are below a key, and how many below its end, by binary search."""
        low, high = ([bisect_left(marks, x.encode()) for x in own] for own in (keys, ends))
        return pd.DataFrame({"low": low, "high": high}, dtype="int32")

    # a url equal to some bounds may go to any of the ranges between them
    spread = between("_full", F.concat("_full", F.lit("\0")))
    blank_rule = {"_rhost": F.lit(None).cast("string"), "_rpath": F.lit(None).cast("string"), "_rverdict": F.lit(None).cast("string")}
    dealt = keyed.withColumn("_at", spread).withColumn("_part", F.col("_at.low") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_at.high") - F.col("_at.low") + 1).cast("int")).withColumn("_kind", F.lit(1)).withColumns(blank_rule)

    good = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    good = good.withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    good = good.withColumn("_key", host_key(F.col("host")))
    # a host's keys begin with its own and its last dot; what follows them all has a slash there
    met = between("_key", F.concat(F.expr("substring(_key, 1, char_length(_key) - 1)"), F.lit("/")))
    ruled = good.withColumn("_at", met).withColumn("_part", F.explode(F.sequence("_at.low", "_at.high"))).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in urls.schema.fields], F.lit(None).cast("string").alias("host"), F.lit("").alias("path"), "_key", F.lit("").alias("_full"), "_part", F.lit(0).alias("_kind"),
        F.col("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_rverdict"),
    )
    columns = [*[F.col(f"`{c}`") for c in urls.columns], "host", "path", "_key", "_part", "_kind", "_rhost", "_rpath", "_rverdict"]
    both = dealt.select(*columns).union(ruled.select(*columns)).repartition(parts, "_part").sortWithinPartitions("_part", "_key", "_kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []  # (key, {path: (rule, verdict)}, path lengths)
        for batch in batches:
            host, path, key, where, kind, rhost, rpath, rverdict = (utf8(c) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns[width:])
            keep, rule, verdict = [], [], []
            for i in range(len(key)):
                if where[i] != part:
                    part, stack = where[i], []
                while stack and not key[i].startswith(stack[-1][0]):
                    stack.pop()
                if kind[i] == 0:
                    if not stack or stack[-1][0] != key[i]:
                        stack.append((key[i], {}, set()))
                    stack[-1][1][rpath[i]] = (rhost[i] + rpath[i], rverdict[i], len(rhost[i]))
                    stack[-1][2].add(len(rpath[i]))
                    continue
                best = None
                for _, rules_here, lengths in stack:
                    for n in sorted(lengths, reverse=True):
                        got = rules_here.get(path[i][:n]) if n <= len(path[i]) else None
                        if got is not None:
                            if best is None or (len(got[0]), got[2]) > (len(best[0]), best[2]):
                                best = got
                            break
                keep.append(i)
                rule.append(best and best[0])
                verdict.append(best[1] if best else default.encode())
            if keep:
                own = batch.take(pa.array(keep, pa.int64()))
                yield pa.record_batch([*own.columns[: width + 2], pa.array(rule, pa.binary()).cast(pa.string()), pa.array(verdict, pa.binary()).cast(pa.string())], names=names)

    return both.mapInArrow(sweep, schema)
