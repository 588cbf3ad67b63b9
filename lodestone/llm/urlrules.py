"""URL filters: a list of rules, and association rules mined from the verdicts it gives.

The list: a rule (host, path prefix) fits its host and all subdomains if the url's path starts with the rule's; the
longest rule that fits decides. The method decides the rest: URLs that the list decides are labels; Spark's FP-growth
mines combinations of URL tokens that occur with each verdict; rules below the least confidence or support are
pruned, as are those that a shorter rule with the same verdict and no less confidence makes needless. An inverted index
from each rule's rarest token finds the rules whose tokens a URL holds; the most confident wins (then the longer,
then ``block``). Where no rule fits, the verdict is ``allow``.

Matching works on distinct token sets, so a host may hold any share of the rows. A URL that is null or has no
``://`` has empty host and path, no token and the verdict ``allow``. Repeated rows and ties are decided alike. Extra
columns are ignored. Everything runs as DataFrame expressions and Spark's own FP-growth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules of the list are constants in the plan; longer lists belong in a joined table.
MOST_RULES = 10_000


def parts(url):
    """(host, path) columns."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, F.lit("://")) + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = common.ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host, path, rules=RULES):
    """The longest rule that fits, as struct (rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = F.lit(None)
    for verdict, rhost, rpath in sorted(rules, key=lambda r: len(r[1] + r[2])):
        ok = ((host == rhost) | host.endswith("." + rhost)) & path.startswith(rpath)
        fits = F.when(ok, F.struct(F.lit(rhost + rpath).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def tokens(host, path):
    """The distinct tokens of a URL, sorted: parts of the host by place, and path segments without digits."""
    labels = F.split(host, r"[.]")
    words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    top = F.array(F.concat(F.lit("t:"), F.element_at(labels, -1)))
    site = F.array(F.concat(F.lit("s:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))
    path_words = F.transform(F.filter(F.split(common.ascii_lower(path), r"[/.]"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(words, top, site, path_words))))


def mine(sets: DataFrame, support: float = 0.01, confidence: float = 0.9) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, key) from (tokens, verdict): one row for each labelled URL."""
    from pyspark.ml.fpm import FPGrowth

    spark = sets.sparkSession
    labelled = sets.where("verdict is not null").select(F.array_union("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    labelled = common.written(labelled, "url-baskets")
    n = labelled.count()
    schema = "tokens array<string>, verdict string, confidence double, key string"
    if not n:
        return spark.createDataFrame([], schema)
    # Tokens below the support can be in no rule; without them baskets are short and one-off host names cost nothing.
    often = labelled.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support * n)
    # At most (items in a basket) / support tokens remain, at any size of input.
    kept = sorted((r.item, r.n) for r in often.collect())
    names = F.array(*[F.lit(t) for t, _ in kept]) if kept else F.array().cast("array<string>")
    baskets = labelled.select(F.array_intersect("items", names).alias("items")).where(F.size("items") > 1)
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets
    found = common.written(found.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    plain = found.where(~F.exists("items", lambda x: x.startswith("="))).select(F.col("items").alias("tokens"), F.col("freq").alias("seen"))
    told = found.where(F.exists("items", lambda x: x.startswith("=")) & (F.size("items") > 1))
    told = told.select(F.filter("items", lambda x: ~x.startswith("=")).alias("tokens"), F.substring(F.element_at(F.filter("items", lambda x: x.startswith("=")), 1), 2, 99).alias("verdict"), "freq")
    rules = told.join(plain, "tokens").withColumn("confidence", F.col("freq") / F.col("seen")).where(F.col("confidence") >= confidence).select("tokens", "verdict", "confidence")
    rules = common.written(rules, "url-rules")
    # A shorter rule inside a longer one shares one of its tokens: compared within the tokens' rules only.
    shorter = rules.select(F.col("tokens").alias("short"), F.col("verdict"), F.col("confidence").alias("c2"), F.element_at("tokens", 1).alias("t"))
    covered = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t")).join(shorter, ["verdict", "t"]).where((F.size("short") < F.size("tokens")) & (F.col("c2") >= F.col("confidence")) & (F.size(F.array_except("short", "tokens")) == 0)).select("tokens", "verdict").distinct()
    rare = F.array_min(F.transform("tokens", lambda t: F.struct(F.coalesce(F.element_at(F.map_from_arrays(names, F.array(*[F.lit(c) for _, c in kept])), t), F.lit(0)).alias("n"), t.alias("t")))).t
    return rules.join(covered, ["tokens", "verdict"], "left_anti").withColumn("key", rare)


def judge(pages: DataFrame, rules=RULES, support: float = 0.01, confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    url = F.col("url").cast("string")
    host, path = parts(url)
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("list", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    rows = common.written(rows.select("page_id", "host", "path", "list.rule", "list.verdict", "tokens"), "url-rows")
    mined = common.written(mine(rows.select("tokens", "verdict"), support, confidence), "url-mined")
    index = common.broadcast_if_small(mined.withColumnRenamed("tokens", "needs").withColumnRenamed("verdict", "says"), mined.count())
    sets = rows.where("rule is null").select("tokens").distinct()
    hits = sets.withColumn("key", F.explode("tokens")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.max(F.struct("confidence", F.size("needs").alias("n"), "says")).alias("best")).select("tokens", F.col("best.says").alias("says"))
    best = common.written(best, "url-best")
    # Token sets with a thousandth of the rows or more are a thousand at most: broadcast, so no task gets all rows of one.
    n = rows.count()
    hot = rows.groupBy("tokens").agg(F.count("*").alias("n")).where(F.col("n") * 1000 >= n).select("tokens")
    hot = common.written(hot, "url-hot")
    some = F.broadcast(hot.join(best, "tokens", "left"))
    out = rows.join(some, "tokens").unionByName(rows.join(F.broadcast(hot), "tokens", "left_anti").join(best, "tokens", "left"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "says", F.lit("allow")).alias("verdict"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
