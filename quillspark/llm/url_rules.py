"""URL filters as a sort-merge range join with a stack of nested rules. DataFrame functions only.

Canonical keys: a host's labels are reversed (``www.example.com`` is ``com.example.www.``), so that a host and its
subdomains share a prefix, and the path follows. A url is looked up once for each suffix of its host; for a given suffix a rule
fits if its key is a prefix of the url's, which is an interval of keys, from the key itself to the key and a byte above all
UTF-8. Such intervals nest or are apart. Urls and the ends of intervals are sorted together; at every end the row says which
rule is then on top of the stack (at a start the rule, at an end the rule around it), so the last such row before a url names
its innermost rule. Of the rules found for its suffixes the longest wins (of
equally long ones that with the longer host).

Only distinct (host, path) pairs are sorted, and only suffixes that a rule has. A suffix such as ``com.`` can hold most rows, so
they are dealt to ``SALTS`` sorts, each with all the ends of that suffix's rules.

A null url, or one without ``://``, has an empty host and path; no rule fits, and ``DEFAULT`` is its verdict. Rows that repeat
a page_id get a row each. Rules may repeat (the first by verdict counts); a rule whose host or path is null never fits.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import table

SALTS, DEFAULT = 128, "allow"
#: The rules of the contract, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(url, _URL, 2).alias("path"),
    )


def _key(labels, path) -> F.Column:
    return F.concat(F.array_join(labels, "."), F.lit("."), path).cast("binary")


def innermost(urls: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """host, path, rule, rule_verdict of the distinct urls (host, path) that a rule fits; rules have verdict, host, path."""
    labels = F.reverse(F.split("host", r"\."))
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"))
    rules = rules.select(
        F.array_join(labels, ".").alias("suffix"), _key(labels, F.col("path")).alias("key"),
        F.struct(F.concat("host", "path").alias("rule"), "rule_verdict", F.length("host").alias("host_length")).alias("top"),
    )
    # the rule around a rule: the longest other rule that its key starts with
    heads = rules.select("suffix", "key", F.explode(F.expr("transform(sequence(1, octet_length(key) - 1), n -> substring(key, 1, n))")).alias("head"))
    around = heads.join(rules.select("suffix", F.col("key").alias("head"), F.col("top").alias("outer")), ["suffix", "head"])
    around = around.groupBy("suffix", "key").agg(F.max_by("outer", F.octet_length("head")).alias("outer"))
    ends = rules.join(around, ["suffix", "key"], "left").select(
        "suffix", F.explode(F.array(
            F.struct("key", F.lit(True).alias("known"), F.col("top").alias("top")),
            F.struct(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(True).alias("known"), F.col("outer").alias("top")),
        )).alias("end"),
    )
    ends = ends.select("suffix", "end.key", F.lit(0).alias("turn"), F.struct("end.top").alias("now"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    ends = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    urls = urls.select("host", "path").distinct().withColumn("labels", labels)
    asked = urls.select("host", "path", "labels", F.explode(F.expr("sequence(1, size(labels))")).alias("n")).select(
        F.array_join(F.slice("labels", F.lit(1), F.col("n")), ".").alias("suffix"), "host", "path"
    )
    asked = asked.join(rules.select("suffix").distinct(), "suffix", "left_semi").select(
        "suffix", F.concat("suffix", F.lit("."), "path").cast("binary").alias("key"), F.lit(1).alias("turn"), F.lit(None).cast(ends.schema["now"].dataType).alias("now"),
        "host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
    )
    sweep = W.partitionBy("suffix", "salt").orderBy("key", "turn").rowsBetween(W.unboundedPreceding, 0)
    swept = ends.select(asked.columns).union(asked).withColumn("now", F.last("now", ignorenulls=True).over(sweep)).where("turn = 1 and now.top is not null")
    best = F.max(F.struct(F.length("now.top.rule").alias("n"), F.col("now.top.host_length").alias("h"), F.col("now.top").alias("top")))
    return swept.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.top.rule", "best.top.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    urls = split_urls(pages)
    return urls.join(innermost(urls, rules, salts), ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(DEFAULT)).alias("verdict")
    )


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
h as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from u),
r(v, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
select page_id, host, path,
       (select rh || rp from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc limit 1) as rule,
       coalesce((select v from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rh || rp) desc limit 1), 'allow') as verdict
from h
"""
QUERIES, ORACLES = {"op2_url_rules": op2_url_rules}, {"op2_url_rules": SQL}
