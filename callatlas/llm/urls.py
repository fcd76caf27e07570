"""URL filters: fixed host and path rules, and association rules over URL tokens, with DataFrame functions only.

The fixed rules decide where one fits. For the other URLs, labelled ones among them teach which token combinations are
blocked: FP-growth mines the combinations of the blocked ones, every labelled URL counts for or against them, and the rules
that hold are looked up by their rarest token.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rest of a URL after the first ://, in two groups: host and path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed rules of the registered query: (host and path, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Fixed word list: words of hosts that public block lists are named for (gambling, adult, pharmacy, spam).
SEEDS = ("casino", "bet", "bets", "poker", "adult", "porn", "xxx", "pills", "viagra", "spam", "ads")


def host_of(url: Column) -> Column:
    """Host with A-Z in lower case; empty for null and for URLs without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct<rule,verdict> of the longest rule that fits (ties: first in code point order), null if none does.

    A rule's host fits itself and all subdomains, its path every path that starts with it. The list is written into the
    plan, so it is bounded: at most 1000 rules.
    """
    if len(rules) > 1000:
        raise ValueError("more than 1000 fixed rules; mine or join them instead")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the last that fits is outermost
        at = rule.find("/") if "/" in rule else len(rule)
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host, the words of labels of several words, path segments (digits as #), names
    of query fields."""
    nonempty = lambda a: F.filter(a, lambda t: F.length(t) > 0)
    named = lambda kind, a: F.transform(a, lambda t: F.concat(F.lit(f"{kind}:"), t))
    labels = named("host", nonempty(F.split(host, r"\.")))
    words = named("word", nonempty(F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda t: t.rlike("[_-]")), lambda t: F.split(t, "[_-]")))))
    segments = F.transform(nonempty(F.split(path, "/")), lambda t: F.concat(F.lit("path:"), F.regexp_replace(t, "[0-9]+", "#")))
    fields = named("field", F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)))
    return F.array_distinct(F.concat(labels, words, segments, fields))


def page_labels(pages: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, blocked for pages that are labelled: true where a word of the host is a seed, or where the page's document,
    whose doc_id is the number in the second part of its path, is toxic or of quality 0; false where it is neither.

    pages: page_id, url; labels: doc_id, quality, toxic (of repeated rows the worst counts). Pages of no labelled document and
    no seed have no row; null URLs have none.
    """
    words = F.split(host_of(F.col("url")), r"[._-]")
    number = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1).try_cast("bigint")
    rows = pages.select("page_id", number.alias("doc_id"), F.arrays_overlap(words, F.array(*map(F.lit, seeds))).alias("seed"))
    bad = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max((F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))).alias("bad"))
    judged = rows.join(bad, "doc_id", "left").select("page_id", F.when(F.col("seed"), True).otherwise(F.col("bad")).alias("blocked"))
    return judged.where(F.col("blocked").isNotNull())


def mine_rules(labelled: DataFrame, min_count: int, min_support: float, min_confidence: float, most_tokens: int, partitions: int) -> DataFrame:
    """antecedent (array of tokens), confidence, support, anchor (its rarest token): combinations that block.

    labelled: rid (one for each URL), tokens, blocked. A rule's support is the number of blocked URLs that have all its tokens,
    at least `min_count` and `min_support` of them; its confidence their share among all labelled URLs that have them. Only
    tokens of such support can be in a rule, and of a URL with more than `most_tokens` of these the rarest are combined, so
    no URL gives more than 2 ** most_tokens combinations; each other one is still a rule by itself. Rules that add tokens to a
    more general one without gaining confidence are pruned.
    """
    spark = labelled.sparkSession
    blocked = labelled.where("blocked")
    n = blocked.count()
    least = max(min_count, ceil(min_support * n))
    singles = blocked.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    singles = durable(singles)
    schema = "antecedent array<string>, support bigint"
    if singles.isEmpty():
        return spark.createDataFrame([], f"{schema}, confidence double, anchor string")
    known = blocked.select("rid", F.explode("tokens").alias("token")).join(singles, "token")
    chosen = known.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("x"))
    items = durable(chosen.select(F.transform(F.slice("x", 1, most_tokens), lambda x: x["token"]).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(items.count(), 1)), numPartitions=partitions).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("support")).where(F.size("antecedent") > 1)
    sets = durable(sets.unionByName(singles.select(F.array("token").alias("antecedent"), F.col("freq").alias("support"))))
    # each labelled URL that is allowed counts against the combinations that it has, found by their rarest token
    counts = singles.select("token", "freq")
    anchored = sets.select("antecedent", "support", F.explode("antecedent").alias("token")).join(counts, "token")
    anchored = durable(anchored.groupBy("antecedent", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor")))
    against = matching(labelled.where("not blocked"), anchored).groupBy("antecedent").agg(F.count(F.lit(1)).alias("against"))
    rules = anchored.join(against, "antecedent", "left").withColumn("confidence", F.col("support") / (F.col("support") + F.coalesce("against", F.lit(0))))
    rules = durable(rules.where(F.col("confidence") >= min_confidence).select("antecedent", "support", "confidence", "anchor"))
    weaker = rules.select(F.col("anchor").alias("token"), F.col("antecedent").alias("general"), F.col("confidence").alias("c"))
    inside = (F.size("general") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("general", "antecedent")) == 0)
    beaten = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(weaker, "token").where(inside).select("antecedent").distinct()
    return rules.join(beaten, "antecedent", "left_anti")


def matching(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rid and rule of each rule whose tokens a row (rid, tokens) has all of: a row meets the rules that are anchored at one of
    its tokens only, and is then held against the whole combination."""
    met = rows.select("rid", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    return met.where(F.size(F.array_except("antecedent", "tokens")) == 0).drop("tokens")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, min_count: int = 5, min_support: float = 0.002, min_confidence: float = 0.9, most_tokens: int = 16,
) -> DataFrame:
    """A verdict, allow or block, for each URL.

    pages: page_id, url; labels: page_id, blocked (see page_labels; of repeated rows true counts); other columns are ignored.
    The fixed rules decide where one fits. Of the URLs without one, the labelled ones are mined (mine_rules), and those that
    have all tokens of a mined rule are blocked, by the rule of the highest confidence (ties: fewer tokens, then later
    text); the others are allowed.

    Returns one row for each row of pages: page_id, host, path, rule, verdict, mined (the deciding combination, space-joined,
    else null), confidence. Null URLs and URLs without :// have empty host and path, no tokens, and are allowed; repeated
    rows give equal rows, each is labelled, and they count as often as they occur; long URLs take linear time; an empty
    table gives none; without labels nothing is mined.
    """
    spark = pages.sparkSession
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("fixed", rule_for(F.col("host"), F.col("path"), rules))
    tokens = F.when(F.col("fixed").isNull() & F.col("url").contains("://"), tokens_of(F.col("host"), F.col("path"), F.col("url")))
    parts = durable(parts.select(F.monotonically_increasing_id().alias("rid"), "page_id", "host", "path", "fixed", tokens.alias("tokens")))
    left = parts.where(F.size("tokens") > 0).select("rid", "page_id", "tokens")
    taught = labels.groupBy("page_id").agg(F.max("blocked").alias("blocked")).where(F.col("blocked").isNotNull())
    labelled = durable(left.join(taught, "page_id").select("rid", "tokens", "blocked"))
    mined = mine_rules(labelled, min_count, min_support, min_confidence, most_tokens, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.array_join("antecedent", " ")
    best = F.max_by(F.struct(name.alias("mined"), "confidence"), F.struct("confidence", -F.size("antecedent"), name))
    found = matching(left.select("rid", "tokens"), mined).groupBy("rid").agg(best.alias("b")).select("rid", "b.mined", "b.confidence")
    judged = parts.join(found, "rid", "left")
    return judged.select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.when(F.col("fixed").isNotNull(), F.col("fixed.verdict")).when(F.col("mined").isNotNull(), "block").otherwise("allow").alias("verdict"), "mined", "confidence")
