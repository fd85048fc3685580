"""URL filters: a list of host and path rules, and association rules that FP-growth mines from labelled URLs.

All in DataFrame functions. A URL's tokens are its host's labels and its path's parts without numbers. FP-growth over the token sets of labelled URLs, with the label as one
more item, gives token combinations; those that imply "bad" with enough support and confidence, also on URLs they weren't mined from, are rules. A rule is
indexed under its rarest token; URLs that have this token are checked for the rest. Support must be at least SUPPORT of
the labelled rows and LEAST rows.

FP-growth alone lists every subset of what many rows share, so it doesn't get tokens but sets of them: only frequent tokens count, those that always come together
in labelled rows are one (a rule with any of them has the same figures), and sets of one, two and three are taken in turn, none that holds a rule already found. A row of k frequent tokens that part from each other
gives at most k(k - 1)(k - 2) / 6 sets, and rows of one template give one.

Null URLs and those without "://" have empty host and path, no tokens, and are allowed. Rows that repeat are judged alike. Where no rule is mined (without labels,
with few, or with labels that URLs don't tell), the verdict of URLs that no listed rule fits is allow. Null labels are no labels. URLs of any length work. An
empty table gives an empty table. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewatch.llm.tables import attached, coded, decoded, dropped, saved

SUPPORT = 0.005
LEAST = 10
CONFIDENCE = 0.8
LONGEST = 3
BAD = "label:bad"


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.filter(F.split(path, r"[/._-]"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$"))
    return F.array_distinct(F.concat(labels, F.transform(parts, lambda x: F.concat(F.lit("path:"), x))))


def listed(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest of the rules (host/path: allow or block) that fits, and what it says; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def holding(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of rows (tokens, ...) with every rule it holds; rules is (key, rule). Rows meet a rule under its key only."""
    return rows.withColumn("key", F.explode("tokens")).join(rules, "key").where(F.size(F.array_except("rule", "tokens")) == 0).drop("key")


def sets_of(items: Column, size: int) -> Column:
    """All sets of so many of an array's items, in its order."""
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    return F.flatten(F.transform(items, lambda x, i: F.transform(sets_of(rest(i), size - 1), lambda s: F.concat(F.array(x), s))))


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(key, rule) and (token, item) from (tokens, bad boolean, held boolean): sets of items that imply bad, each under its rarest; an item stands for
    tokens that always come together.

    Mined from rows that aren't held back, of which at least LEAST and a share of support must be bad and hold the set. A rule must reach the confidence
    on the held-back rows that it hits, one of them bad at least, and over all rows with one more good one. No rule holds another.
    """
    spark = labelled.sparkSession
    known = saved(labelled.where("bad is not null and size(tokens) > 0").select(F.array_sort("tokens").alias("tokens"), "bad", "held"), "url-labelled")
    n = known.where("not held").count()
    need = max(LEAST, math.ceil(support * n))
    count = lambda c: F.count(F.when(c, 1))
    each = known.select(F.explode("tokens").alias("token"), "bad", "held", F.xxhash64("tokens", "bad", "held").cast("decimal(38,0)").alias("row"))
    frequent = each.groupBy("token").agg(count(F.col("bad") & ~F.col("held")).alias("b"), F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("b") >= need)
    names = saved(frequent.select("token", F.min("token").over(Window.partitionBy("n", "rows")).alias("item"), "n"), "url-items")
    items = F.array_sort(F.collect_set("item"))
    told = known.withColumn("row", F.monotonically_increasing_id())  # over a table just written
    rows = saved(told.select("row", "bad", "held", F.explode("tokens").alias("token")).join(names.select("token", "item"), "token").groupBy("row", "bad", "held").agg(items.alias("tokens")).drop("row"), "url-sets")
    rarity = names.groupBy(F.col("item").alias("key")).agg(F.min("n").alias("freq"))
    indexed = lambda rules: rules.select("rule", F.explode("rule").alias("key")).join(rarity, "key").groupBy("rule").agg(F.min_by("key", F.struct("freq", "key")).alias("key"))
    rules = spark.createDataFrame([], "rule array<string>, key string")
    grouped = rows.groupBy("tokens", "bad", "held").agg(F.count("*").alias("n"))
    for size in range(1, LONGEST + 1):
        open_ = grouped.withColumn("id", F.xxhash64("tokens", "bad", "held"))
        sets = open_.select("id", "bad", "held", "n", F.explode(sets_of(F.col("tokens"), size)).alias("rule"))
        if size > 1:  # none that holds a rule
            part = rules.select("key", F.col("rule").alias("part"))
            beaten = sets.select("rule").distinct().withColumn("key", F.explode("rule")).join(part, "key").where(F.size(F.array_except("part", "rule")) == 0).select("rule").distinct()
            sets = sets.join(beaten, "rule", "left_anti")
        one = sets.where("not held").select(F.to_json("rule").alias("item"), "bad", F.explode(F.expr("sequence(1L, n)")).alias("nth"))
        one = saved(one.select(F.when(F.col("bad"), F.array("item", F.lit(BAD))).otherwise(F.array("item")).alias("items")), "url-transactions")
        total = one.count()
        if not total:
            break
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / total), minConfidence=confidence).fit(one)
        found = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD)).select(F.from_json(F.element_at("antecedent", 1), "array<string>").alias("rule"))
        hit = holding(grouped, indexed(found))
        bad, held = F.when(F.col("bad"), F.col("n")).otherwise(0), F.when(F.col("held"), F.col("n")).otherwise(0)
        held_bad = F.when(F.col("bad"), held).otherwise(0)
        sure = hit.groupBy("rule").agg(F.sum("n").alias("n"), F.sum(bad).alias("b"), F.sum(held).alias("hn"), F.sum(held_bad).alias("hb"))
        sure = sure.where((F.col("hb") >= 1) & (F.col("hb") >= confidence * F.col("hn")) & (F.col("b") >= confidence * (F.col("n") + 1))).select("rule")
        new = saved(indexed(sure), f"url-rules-{size}").select("rule", "key")
        dropped(one)
        rules = rules.unionAll(new)
    return rules.select("key", "rule"), names.select("token", "item")


#: The columns that judged adds.
ADDED = ("host", "path", "rule", "verdict")


def judged(pages: DataFrame, rules: dict[str, str], labelled: DataFrame) -> DataFrame:
    """pages(url, ...) with host, path, rule and verdict; columns of pages of these names are replaced. labelled is (url, bad boolean); about a third
    of the URLs, by their hash, is held back. Token sets that a rule hits are joined back by attached: one token set may hold a third of the pages."""
    held = F.substring(F.md5("url"), 1, 1) < "5"
    index, items = mined(labelled.select("bad", tokens(*parts_of(F.col("url"))).alias("tokens"), F.coalesce(held, F.lit(False)).alias("held")))
    host, path = parts_of(F.col("url"))
    rows = pages.select(*coded(pages.columns), host.alias("host"), path.alias("path")).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    distinct = rows.select("tokens").distinct().where("size(tokens) > 0")  # pages of one host share most
    told = items.join(index.select(F.explode("rule").alias("item")).distinct(), "item", "left_semi")  # tokens that are in a rule
    named = distinct.select(F.col("tokens").alias("all"), F.explode("tokens").alias("token")).join(told, "token").groupBy("all").agg(F.collect_set("item").alias("tokens"))
    hits = saved(holding(named, index).select(F.col("all").alias("tokens")).distinct().withColumn("_hit", F.lit(True)), "url-hits")
    rule, verdict = listed(rules, F.col("host"), F.col("path"))
    out = attached(rows, hits, "tokens").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("_hit"), "block").otherwise("allow")))
    return out.select(*decoded(pages.columns, ADDED), *ADDED)
