"""URL verdicts: a list of host and path rules first, then association rules mined from labels, in DataFrame operations.

Every URL becomes a set of tokens: host labels (``h:``), path words (``p:``, numbers as ``p:#``) and query keys (``q:``).
Tokens on exactly the same pages are one item, so a slug's words or a template's keys don't make a set for each choice of
them.  An item that blocks well alone is a rule; FP-growth mines the sets of the other items of all pages, with what is known
of a page as more items: that it is decided, and that it is blocked.  A rule blocks what has all its items; it is kept where
it reaches the ``SUPPORT``, where at least ``CONFIDENCE`` of the decided pages with its items are blocked, and where those are
the ``MAJORITY`` of all pages with its items, so that a few decided pages don't speak for many of another kind.  Of the
rules kept, those that contain another go, size by size.  They match by an inverted index: a rule is filed under the rarest
of its items, meets the URLs that have it in an equi-join, and fires where all its items are found.  Only distinct URLs are
matched, so a URL that many pages share is one row.  The work grows with the sets of items that are frequent on blocked
pages, no rules alone, and told apart by some page.

The labels are the listed rules' own verdicts: what the pages have in common that they block decides about those that they
don't reach.  Other labels can be given instead, as a table of url and bad (null: not known).

Null URLs and URLs without ``://`` have an empty host and path and no tokens, and are allowed; without labelled pages no
rule is mined; a page with several labels counts each; listed rules of equal length go by the later host, and no URL fits
two such rules of this list; rows that repeat get the same verdict; a very long URL is a long token set, of which only
frequent tokens are mined; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import lower_ascii, materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
CONFIDENCE, MAJORITY = 0.8, 0.5
#: Share of the pages that a rule's blocked ones are, and pages at least.
SUPPORT, LEAST_PAGES = 0.002, 20
BLOCK, DECIDED = "=block", "=decided"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES, verdict: bool = False) -> Column:
    """The longest rule that fits (or its verdict); null where none does."""
    out = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last, and longest, is asked first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, v if verdict else h + p).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    def words(text: Column, mark: str, pattern: str) -> Column:
        parts = F.filter(F.split(text, pattern), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(mark), F.when(x.rlike("^[0-9]+$"), "#").otherwise(x)))

    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(words(host_of(url), "h:", r"[.]"), words(lower_ascii(path_of(url)), "p:", r"[/._-]"), keys))


def listed_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, bad): whether a listed rule blocks a page; null where none decides."""
    verdict = rule_column(host_of(F.col("url")), path_of(F.col("url")), rules, verdict=True)
    return pages.select("url", (verdict == "block").alias("bad"))


def labelled_tokens(labelled: DataFrame) -> DataFrame:
    """(url, bad) to url, bad and tokens, of URLs that have a host."""
    return labelled.filter(F.contains(F.col("url"), F.lit("://"))).select("url", "bad", url_tokens(F.col("url")).alias("tokens"))


def token_items(pages: DataFrame, least: float) -> DataFrame:
    """(url, bad, tokens) to (token, item, pages, decided, blocked): tokens on exactly the same pages are one item, named by
    the first of them. Only tokens on ``least`` blocked pages are looked at, as a rule can't hold others."""
    each = pages.select(F.explode("tokens").alias("token"), "bad", F.xxhash64("url").alias("x"), F.xxhash64(F.lit(7), "url").alias("y"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    counts = F.count("*").alias("pages"), F.count("bad").alias("decided"), F.count_if(F.col("bad")).alias("blocked")
    tokens = each.groupBy("token").agg(*counts, total("x"), total("y")).filter(F.col("blocked") >= least)
    names = tokens.groupBy("pages", "x", "y").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"), F.first("decided").alias("decided"), F.first("blocked").alias("blocked"))
    return names.select(F.explode("tokens").alias("token"), "item", "pages", "decided", "blocked")


def _blocks(bad: str, decided: str, pages: str) -> Column:
    return (F.col(bad) >= CONFIDENCE * F.col(decided)) & (F.col(bad) > MAJORITY * F.col(pages))


def _with_items(pages: DataFrame, items: DataFrame, *keep: str) -> DataFrame:
    """Rows with the set of items that their tokens name; rows without any go."""
    met = pages.select(*keep, F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return met.groupBy(*keep).agg(F.array_sort(F.collect_set("item")).alias("held"))


def minimal(sets: DataFrame) -> DataFrame:
    """sets (tokens, rule), every non-empty subset of each among them, to the rules that hold no other: a set is covered
    where one without one of its tokens is a rule or covered, which goes from size to size."""
    sizes = [r[0] for r in sets.select(F.size("tokens").alias("k")).distinct().orderBy("k").collect()]  # of a set's tokens
    out, below = None, None
    for k in sizes:
        own = sets.filter(F.size("tokens") == k).withColumn("covered", F.lit(False))
        if below is not None:
            parts = own.select("tokens", F.explode("tokens").alias("t")).select("tokens", F.array_remove("tokens", F.col("t")).alias("part"))
            hit = parts.join(below.withColumnRenamed("tokens", "part"), "part").select("tokens").distinct().withColumn("hit", F.lit(True))
            own = own.drop("covered").join(hit, "tokens", "left").withColumn("covered", F.coalesce("hit", F.lit(False))).drop("hit")
        own = materialize(own.select("tokens", "rule", "covered"), "sets")
        below = own.filter("rule or covered").select("tokens")
        found = own.filter("rule and not covered").select("tokens")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else sets.select("tokens")


def mined_rules(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, bad) to the items (token, item) and the inverted index (lead, tokens) of the rules that block, in items."""
    pages = materialize(labelled_tokens(labelled), "pages")
    n = pages.count()
    least = math.ceil(max(SUPPORT * n, LEAST_PAGES))
    items = materialize(token_items(pages, least), "items")
    alone = _blocks("blocked", "decided", "pages")
    single = items.filter(alone).select("item").distinct()
    # A set with an item that is a rule alone isn't minimal, so such items aren't mined with others.
    others = items.filter(~alone)
    marks = F.when(F.col("bad"), F.array(F.lit(DECIDED), F.lit(BLOCK))).when(~F.col("bad"), F.array(F.lit(DECIDED))).otherwise(F.array().cast("array<string>"))
    spread = pages.select("bad", "tokens", F.monotonically_increasing_id().alias("row"))
    baskets = materialize(_with_items(spread, others, "row", "bad").select(F.concat("held", marks).alias("items")), "baskets")
    rules = single.select(F.array("item").alias("tokens"))
    if not baskets.isEmpty():
        frequent = FPGrowth(minSupport=min(1.0, (least - 0.5) / baskets.count())).fit(baskets).freqItemsets
        marked = F.array(F.lit(DECIDED), F.lit(BLOCK))
        sets = frequent.select(F.array_sort(F.array_except("items", marked)).alias("tokens"), F.array_intersect("items", marked).alias("marks"), "freq").filter(F.size("tokens") > 0)
        count = lambda m: F.max(F.when(m, F.col("freq")))
        has = lambda x: F.array_contains("marks", x)
        # A frequent set's subsets are frequent, so where the blocked pages are counted the others are.
        counted = sets.groupBy("tokens").agg(count(has(BLOCK)).alias("bad"), count(has(DECIDED) & ~has(BLOCK)).alias("decided"), count(F.size("marks") == 0).alias("pages"))
        counted = counted.filter("bad is not null").select("tokens", _blocks("bad", "decided", "pages").alias("rule"))
        rules = rules.unionByName(minimal(materialize(counted, "counted")))
    often = items.select("item", "pages").distinct().withColumnRenamed("item", "token")
    each = rules.select("tokens", F.explode("tokens").alias("token")).join(often, "token")
    index = each.groupBy("tokens").agg(F.min_by("token", F.struct("pages", "token")).alias("lead")).select("lead", "tokens")
    return items.select("token", "item"), materialize(index, "index")


def _all_in(tokens: str, held: str) -> Column:
    return F.size(F.array_except(tokens, held)) == 0


def fired(urls: DataFrame, items: DataFrame, index: DataFrame) -> DataFrame:
    """Of distinct urls, those that a rule matches."""
    used = index.select(F.explode("tokens").alias("item")).distinct()
    tokens = _with_items(urls.select("url", url_tokens(F.col("url")).alias("tokens")), items.join(used, "item"), "url")
    met = tokens.select("url", "held", F.explode("held").alias("lead")).join(index, "lead")
    return met.filter(_all_in("tokens", "held")).select("url").distinct()


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule fires; null where a listed rule decides)."""
    rows = pages.select("page_id", "url")
    parsed = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    listed = parsed.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules), "given": rule_column(F.col("host"), F.col("path"), rules, verdict=True)})
    items, index = mined_rules(listed_verdicts(pages, rules) if labelled is None else labelled.select("url", "bad"))
    open_ = listed.filter(F.col("rule").isNull() & F.contains(F.col("url"), F.lit("://"))).select("url").distinct()
    hit = fired(open_, items, index)
    joined = listed.join(hit.select(F.concat("url", F.lit("")).alias("url"), F.lit(True).alias("hit")), "url", "left")
    mined = F.when(F.col("rule").isNull(), F.coalesce("hit", F.lit(False)))
    verdict = F.coalesce("given", F.when(F.coalesce("hit", F.lit(False)), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), mined.alias("mined"))
