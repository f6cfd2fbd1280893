"""URL filter rules by a sort-merge range join over reversed-host keys (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.session import table

#: (host, path, verdict) of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: The verdict of a url that no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a rule's interval [key, key + LAST): above every character that may follow the key's final dot.
_LAST = "\U0010ffff"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?`` or ``#``. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot: ``a.b.org`` -> ``org.b.a.``; all subdomains of a host share its key as prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, active): from this key on, up to the next boundary, exactly the rules in ``active`` hold by their host.

    Rule intervals nest or are disjoint. Each interval opens at the host's key and closes after its last subdomain; what is active after either is the chain of enclosing rule hosts, found by an equi-join of each rule host with its own suffixes.
    """
    by_host = rules.groupBy("host").agg(F.array_sort(F.collect_set(F.struct(F.length("path").alias("n"), "path", "rule", "verdict"))).alias("own"))
    hosts = by_host.select("host", F.split("host", r"\.").alias("l"))
    up = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("upper"))
    chain = up.join(by_host.withColumnRenamed("host", "upper"), "upper").select("host", "upper", F.length("upper").alias("d"), "own")
    opened = chain.groupBy("host").agg(F.collect_list(F.struct("d", "own")).alias("a"))
    closed = chain.where("upper <> host").groupBy("host").agg(F.collect_list(F.struct("d", "own")).alias("a"))
    starts = opened.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "a")
    ends = hosts.select("host").join(closed, "host", "left").select(F.concat(host_key(F.col("host")), F.lit(_LAST)).alias("key"), F.lit(0).alias("kind"), F.coalesce("a", F.expr("cast(array() as array<struct<d:int,own:array<struct<n:int,path:string,rule:string,verdict:string>>>>)")).alias("a"))
    return starts.unionByName(ends)


def match_rules(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", lanes: int | None = None) -> DataFrame:
    """pages with host, path, rule and verdict columns.

    rules: (host, path, verdict). A rule fits a url if its host is the url's host or a parent domain of it and the url's path starts with the rule's path. The longest rule (characters of host and path) wins; ties go to the longer host, then by path and verdict. No fitting rule: rule is null, verdict is ``default``.
    Distinct hosts are dealt evenly over ``lanes``; each lane merges its hosts with all rule boundaries in one sorted sweep, keeping the stack of active rules, so neither a frequent host nor a broad rule meets in one task. A null url has an empty host and path. Rules with null fields are ignored; a trailing clash of column names (host, path, rule, verdict) in pages is resolved in favour of this operator.
    """
    lanes = lanes or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").withColumn("rule", F.concat("host", "path"))
    host, path = split_url(F.col(url))
    work = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    hosts = work.select("host").distinct().select("host", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("host"), F.lit(lanes)).alias("lane"))
    marks = _boundaries(rules).select(F.lit(None).cast("string").alias("host"), "key", "kind", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))).alias("lane"))
    sweep = hosts.withColumn("a", F.lit(None).cast(marks.schema["a"].dataType)).select(*marks.columns).unionByName(marks)
    order = Window.partitionBy("lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacks = sweep.withColumn("stack", F.last("a", ignorenulls=True).over(order)).where("host is not null").select("host", F.coalesce(F.flatten(F.transform("stack", lambda s: F.transform(s["own"], lambda r: F.struct((s["d"] + r["n"]).alias("n"), s["d"].alias("d"), r["path"].alias("path"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))), F.expr("cast(array() as array<struct<n:int,d:int,path:string,rule:string,verdict:string>>)")).alias("stack"))
    # hosts without any active rule need no partner
    stacks = stacks.where(F.size("stack") > 0)
    best = F.array_max(F.filter("stack", lambda r: F.col("path").startswith(r["path"])))
    out = work.join(stacks, "host", "left").withColumn("_best", best)
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best", "stack")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """(host, path, verdict) from literals, without a Python worker."""
    rows = [F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return match_rules(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with r(rh, rp, rv) as (values ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
m as (select page_id, rh || rp as rule, rv, row_number() over (partition by page_id order by length(rh || rp) desc) as k
      from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select h.page_id, host, path, m.rule, coalesce(rv, 'allow') as verdict from h left join m on h.page_id = m.page_id and k = 1
"""
