"""URL filters: fixed host and path rules, then association rules mined by FP-growth.

Labelled URLs become sets of tokens (host suffixes and labels, path parts, numbers,
endings, query names); tokens that always stand together are one class. Spark's
FP-growth finds the combinations of classes in marked URLs, a join counts them in
the others; rules under the confidence or support are dropped, those whose confidence
is not clearly above the share of marked URLs too, and so are rules that a smaller
one implies; a rule may have any number of tokens. An inverted index keyed by the
class of a rule that fewest URLs have finds the rules that a URL can satisfy; a URL
is blocked if it has a token of each class of one of them.
Everything on the main path is DataFrame functions and JVM code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import store

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that the rows of one URL are dealt to.
_SLOTS = 8


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with its subdomains and paths that begin alike."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the registered query.
DEFAULT_RULES = (
    UrlRule("com/en/", "block"),
    UrlRule("example.com/en/7", "allow"),
    UrlRule("net/de/", "allow"),
    UrlRule("example.net/de/8", "block"),
    UrlRule("org/es/", "block"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """The host after the first ``://``, A-Z lower-cased; empty for a null url or one without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where the host is undefined."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls; of equal lengths the first listed."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL.

    Scheme, host suffixes, host labels but the last (and their parts between
    hyphens), path parts, the last part's ending, query names and fragment. Digits
    stand as a sign, so that numbers that occur once make no tokens of their
    own; a part that is a number adds its length with its first digit.
    """
    host, path = host_of(url), path_of(url)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    some = lambda xs: F.filter(xs, lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    labels = some(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    words = F.concat(inner, F.flatten(F.transform(inner, lambda x: some(F.split(x, "-")))))
    parts = some(F.split(path, "/"))
    numbers = F.transform(F.filter(parts, lambda x: x.rlike("^[0-9]+")), lambda x: F.concat(F.length(F.regexp_extract(x, "^[0-9]+", 0)).cast("string"), F.lit(":"), F.substring(x, 1, 1)))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,8})$", 1)
    whole = F.coalesce(url, F.lit(""))
    query = F.transform(some(F.split(F.regexp_extract(whole, r"\?([^#]*)", 1), "&")), lambda x: plain(F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.lower(F.regexp_extract(whole, "^([^:/?#]*)://", 1))
    made = F.concat(
        F.array(F.concat(F.lit("c:"), scheme)), named("s:", suffixes), named("h:", F.transform(words, plain)), named("p:", F.transform(parts, plain)),
        named("n:", numbers), named("e:", some(F.array(ending))), named("q:", query), named("f:", some(F.array(plain(F.regexp_extract(whole, "#(.*)$", 1))))),
    )
    return F.array_sort(F.array_distinct(F.filter(made, lambda x: ~F.contains(x, F.lit("\x00")))))


def _classed(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes (class, members, n, m) of tokens, and the rows as (items, n, m) in them.

    Tokens that stand in the same rows are one class, named by its smallest
    token. Row sets are compared by count and two hashes of the distinct token
    sets. Tokens with fewer than ``least`` marked rows are in no rule and left out.
    """
    whole = rows.groupBy(tokens_of(F.col("url")).alias("t")).agg(F.count("*").alias("n"), F.count_if("marked").alias("m"))
    sets = store(whole.withColumn("_slot", F.pmod(F.xxhash64("t"), F.lit(_SLOTS)).cast("int")), "token-sets")
    alike = sets.select("n", "m", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"), F.explode("t").alias("token")).groupBy("token")
    known = alike.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("sets"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g")).where(F.col("m") >= least)
    classes = store(known.groupBy("n", "m", "sets", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.get("members", F.lit(0)).alias("class"), "members", "n", "m"), "classes")
    named = classes.select("class", F.col("class").alias("token")).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1))))
    found = sets.select("t", "n", "m", "_slot", F.explode("t").alias("token")).join(named, ["token", "_slot"])
    items = found.groupBy("t", "n", "m").agg(F.array_sort(F.collect_list("class")).alias("items"))
    return classes, store(items.groupBy("items").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "class-sets")


def _counted(itemsets: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``itemsets(items, freq)`` with n, the rows that hold all items.

    An item set meets only the rows that hold its rarest item; rows are dealt to
    slots, so a frequent one is never one task's.
    """
    sizes = classes.select("class", F.col("n").alias("all"))
    rarest = itemsets.select("items", "freq", F.explode("items").alias("class")).join(sizes, "class").groupBy("items", "freq").agg(F.min(F.struct("all", "class")).alias("k"))
    index = rarest.select(F.col("items").alias("needed"), "freq", F.col("k.class").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1))).alias("_slot"))
    spread = rows.select("items", "n", F.pmod(F.xxhash64("items"), F.lit(_SLOTS)).cast("int").alias("_slot"), F.explode("items").alias("class"))
    hits = spread.join(index, ["class", "_slot"]).where(F.size(F.array_except("needed", "items")) == 0)
    return hits.groupBy(F.col("needed").alias("items"), "freq").agg(F.sum("n").alias("n"))


def mine_classes(labelled: DataFrame, least_support: float = 0.005, least_confidence: float = 0.3, least_rows: int = 10, least_lift: float = 1.25, least_z: float = 2.58) -> DataFrame:
    """Rules (needed array<array<string>>, confidence, support) from ``labelled(url, marked boolean)``.

    A URL fits a rule if it has a token of each array in ``needed``. Tokens that
    stand in the same labelled URLs are one array, and FP-growth mines
    these classes over the marked URLs alone, so tokens that always come together
    don't multiply item sets; the other URLs are counted by a join.

    ``least_support`` is the share of labelled URLs that hold the tokens and the
    mark; it stands for ``least_rows`` of them at least, so that a few rows make no
    rule by chance. A rule's confidence must also be ``least_lift`` times the share of
    marked URLs and ``least_z`` standard errors above it: a fixed
    confidence alone means little where marks are rare or common. Rules have as
    many tokens as they need. Null urls or marks are left out, repeated rows
    count each; with fewer than ``least_rows`` rows, or without a mark, there are no rules.
    """
    none = labelled.sparkSession.createDataFrame([], "needed array<array<string>>, confidence double, support double")
    rows = labelled.where(F.col("url").isNotNull() & F.col("marked").isNotNull())
    n, marked = rows.agg(F.count("*"), F.count_if("marked")).first()
    least = max(1, math.ceil(max(least_support * n, least_rows) - 1e-9))
    if n < least_rows or marked < least:
        return none
    classes, sets = _classed(rows, least)
    if classes.isEmpty():
        return none
    baskets = sets.where("m > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("copy"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / marked).fit(baskets)  # half a row less: no rounding of the product
    frequent = store(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "item-sets")
    base = marked / n
    held = _counted(frequent, classes, sets).withColumn("confidence", F.col("freq") / F.col("n"))
    z = (F.col("confidence") - base) / F.sqrt(base * (1 - base) / F.col("n"))
    strong = held.where((F.col("confidence") >= max(least_confidence, least_lift * base)) & (F.lit(marked == n) | (z >= least_z)))
    rules = store(_smallest(strong.select(F.col("items").alias("tokens"), "confidence", (F.col("freq") / n).alias("support"))), "rules")
    members = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("class")).join(classes.select("class", "members"), "class")
    return members.groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("needed")).select("needed", "confidence", "support")


def mine(labelled: DataFrame, *settings: float, **named: float) -> DataFrame:
    """Rules (tokens array, confidence, support): those of ``mine_classes`` spelt out, for reports.

    Each choice of one token a class is a rule of its own, so rules over large
    classes are many; ``matched`` takes the classes as they are.
    """
    chosen = F.aggregate(
        "needed", F.array(F.array().cast("array<string>")),
        lambda acc, some: F.flatten(F.transform(acc, lambda x: F.transform(some, lambda t: F.concat(x, F.array(t))))),
    )
    return mine_classes(labelled, *settings, **named).select(F.explode(chosen).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def _smallest(rules: DataFrame) -> DataFrame:
    """``rules`` without those that say nothing new, as a rule with part of their tokens exists.

    From few tokens to many: each size is final, and larger rules that hold one of it
    go before they are compared with one another.
    """
    left, final = store(rules, "rules"), []
    sizes = sorted(r.n for r in left.select(F.size("tokens").alias("n")).distinct().collect())
    for n in sizes:
        final.append(left.where(F.size("tokens") == n))
        if n < sizes[-1]:
            larger = left.where(F.size("tokens") > n)
            index = final[-1].select(F.get("tokens", F.lit(0)).alias("token"), F.col("tokens").alias("part"))
            implied = larger.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("part", "tokens")) == 0).select("tokens").distinct()
            left = store(larger.join(implied, "tokens", "left_anti"), "rules")
    return reduce(DataFrame.unionAll, final) if final else left


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``urls(url)`` that fit one of ``rules(needed)``, found by an inverted index of the rules.

    A rule stands in the index under the tokens of the class that the fewest URLs
    have; one with a class that no URL has matches nothing. URLs are dealt to
    slots, so a frequent token is never one task's.
    """
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("_tokens", tokens_of(F.col("url"))).withColumn("_slot", F.pmod(F.xxhash64("url"), F.lit(_SLOTS)).cast("int"))
    spread = rules.select("needed", F.explode("needed").alias("class")).withColumn("token", F.explode("class"))
    seen = distinct.select(F.explode("_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(spread.select("token").distinct(), "token", "left_semi")
    sizes = spread.join(seen, "token", "left").groupBy("needed", "class").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = sizes.groupBy("needed").agg(F.min(F.struct("n", "class")).alias("k")).where("k.n > 0")
    index = rarest.select(F.col("needed").alias("_needed"), F.explode("k.class").alias("token"), F.sequence(F.lit(0), F.lit(_SLOTS - 1)).alias("_slots")).select("_needed", "token", F.explode("_slots").alias("_slot"))
    hits = distinct.withColumn("token", F.explode("_tokens")).join(index, ["token", "_slot"])
    return hits.where(F.forall("_needed", lambda some: F.arrays_overlap(some, F.col("_tokens")))).select("url").distinct()


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: tuple[UrlRule, ...] = DEFAULT_RULES, **settings: float) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule and verdict (allow or block).

    The longest fixed rule decides; without one the mined rules block, else the
    URL is allowed. Null urls have an empty host and path and are allowed.
    Repeated rows are kept; other columns are ignored. Of fixed rules of equal
    length the first listed decides. Rows of one URL are dealt to ``_SLOTS`` tasks.
    """
    rows = pages.select("page_id", F.col("url").cast("string")).withColumn("_slot", F.pmod(F.xxhash64("page_id"), F.lit(_SLOTS)).cast("int"))
    blocked = matched(rows, mine_classes(labelled, **settings)).select("url", F.lit(True).alias("_blocked"), F.explode(F.sequence(F.lit(0), F.lit(_SLOTS - 1))).alias("_slot"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.join(blocked, ["url", "_slot"], "left").withColumn("host", host).withColumn("path", path)
        .select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"))
    )
