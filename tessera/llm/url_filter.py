"""URL rules as a sort-merge range join over reversed-host keys, in DataFrame operations only.

The key of a rule is its host's labels in reverse, a mark, and its path, so that a rule covers an
interval of keys: those that begin with its own. Urls get the key of each ancestor host that is as
deep as some rule's. Rules and urls are sorted together, and the sweep over them keeps a stack of the
rules that may still be open: for each length of rule keys the one that it passed last. Of these the
longest that covers the url wins.

Intervals are nested or apart. A rule that covers a url is the last of its length that was passed:
all keys between it and the url begin with it, so another one of its length would be equal to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, union_all, without

#: Neither a host nor a path can hold it.
_MARK = "#"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column, depth: int) -> Column:
    """The key of the ancestor host with that many labels; null if the host has fewer."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), F.lit(depth))
    return F.when((F.size(labels) >= depth) & (host != ""), F.concat(F.array_join(F.reverse(last), "."), F.lit(_MARK), path))


def keyed_rules(rules: DataFrame) -> DataFrame:
    """(depth, key, size, rule, verdict) of each rule. Equal rules with two verdicts: block wins."""
    labels = F.split("host", r"\.")
    keyed = rules.select(F.size(labels).alias("depth"), F.concat(F.array_join(F.reverse(labels), "."), F.lit(_MARK), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    return keyed.groupBy("depth", "key", "rule").agg(F.max("verdict").alias("verdict")).withColumn("size", F.length("rule"))


def filter_urls(pages: DataFrame, rules: DataFrame, depths: list[int], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules has (host, path, verdict); a rule fits its host and all subdomains if the url's path
    starts with the rule's; of those that fit, the longest host and path wins, and of equally long
    ones that with the deeper host. Without a rule the verdict is the default and the rule null.
    depths lists the numbers of labels of the rules' hosts.

    Rows are dealt to as many sweeps as there are shuffle partitions, by a row number and not by
    their key, so that a hot host or url is spread evenly; every sweep gets all rules, whose number
    should stay below that of its urls. The stack has a place for each length of rule keys: a list of
    lengths, bounded by the longest rule, is all that the driver learns of the rules.

    Null urls and those without :// have an empty host and path; very long urls are judged whole;
    repeated rows are kept; an empty table gives an empty one; input columns named as results are
    replaced, others may have any name.
    """
    n_sweeps = shuffle_partitions(pages.sparkSession)
    pages = without(pages, "host", "path", "rule", "verdict")
    columns = pages.columns
    keyed = keyed_rules(rules)
    lengths: dict[int, list[int]] = {}
    for r in keyed.select("depth", F.length("key").alias("n")).distinct().collect():
        lengths.setdefault(r["depth"], []).append(r["n"])
    host, path = url_host(F.col(url)), url_path(F.col(url))
    urls = pages.select(F.struct(*columns).alias("_row"), host.alias("host"), path.alias("path"), F.pmod(F.monotonically_increasing_id(), F.lit(n_sweeps)).cast("int").alias("_sweep"))
    urls = urls.select("*", *[_key(F.col("host"), F.col("path"), d).alias(f"_key{d}") for d in depths], F.lit(None).cast("struct<size:int,key:string,rule:string,verdict:string>").alias("_entry"))
    passing = keyed.select(
        F.lit(None).cast(urls.schema["_row"].dataType).alias("_row"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
        F.explode(F.sequence(F.lit(0), F.lit(n_sweeps - 1))).alias("_sweep"),
        *[F.when(F.col("depth") == d, F.col("key")).alias(f"_key{d}") for d in depths],
        F.struct("size", "key", "rule", "verdict").alias("_entry"),
    )
    swept = union_all([urls, passing])
    best = []
    for d in depths:
        key = F.col(f"_key{d}")
        sweep = Window.partitionBy("_sweep").orderBy(key.asc_nulls_first(), F.col("_entry").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # From the innermost rule outwards: a null entry is of another depth or length, and is passed over.
        stack = [F.last(F.when(key.isNotNull() & (F.length("_entry.key") == n), F.col("_entry")), ignorenulls=True).over(sweep).alias(f"_open{d}_{n}") for n in sorted(lengths.get(d, ()), reverse=True)]
        names = [f"_open{d}_{n}" for n in sorted(lengths.get(d, ()), reverse=True)]
        if not names:
            continue
        swept = swept.select("*", *stack)
        covering = F.coalesce(*[F.when(key.startswith(F.col(f"{n}.key")), F.col(n)) for n in names])
        swept = swept.withColumn(f"_best{d}", covering).drop(*names)
        best.append(F.struct(F.col(f"_best{d}.size").alias("size"), F.lit(d).alias("depth"), F.col(f"_best{d}.rule").alias("rule"), F.col(f"_best{d}.verdict").alias("verdict")))
    won = F.array_max(F.filter(F.array(*best), lambda e: e["size"].isNotNull())) if best else F.lit(None).cast("struct<rule:string,verdict:string>")
    swept = swept.where(F.col("_entry").isNull()).withColumn("_won", won)
    return swept.select(*[F.col("_row").getField(c).alias(c) for c in columns], "host", "path", F.col("_won.rule").alias("rule"), F.coalesce("_won.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, list[int]]:
    """The rules as a table, and the depths of their hosts."""
    return spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string"), sorted({r.host.count(".") + 1 for r in rules})
