"""URL filtering by association rules, in built-in DataFrame functions and Spark's FP-growth.

A url becomes a set of tokens (scheme, host suffixes, words of hyphenated host labels, path words, query keys).
FP-growth mines the token sets of the distinct urls labelled bad for combinations of enough support; each combination
is the left side of a rule that concludes "bad", and its confidence is counted over all distinct labelled urls.  A rule
stands on at least ``MIN_COUNT`` distinct bad urls, and it is the lower limit of its confidence (Wilson's, at
``Z`` standard errors, as many rules are tried) that must reach the confidence and lift thresholds.  Rules that contain
another kept rule of at least their confidence go.

Tokens that occur in exactly the same bad urls are one item of FP-growth: every itemset is then closed over them, and
urls of one template, however many tokens they share, make one itemset instead of one for each subset.

Rules are matched by an inverted index: each is listed under its rarest token, a url looks up its tokens, and the rest
of each listed rule is compared.  Explicit (host, path) rules come first: the longest decides.

Edge cases: a null url or one without ``://`` has empty host and path, no tokens and the verdict "allow"; empty tables
give empty results; repeated rows are judged one by one but teach once: a url is bad if more than half of its
labelled rows are; labels that are null or whose page is missing teach nothing; very long urls are cut into tokens like
any other; two fitting rules of one length have the same host and path, so they can't tie; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.session import cut_lineage

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 0.5, 2.0
#: Distinct bad urls that a rule needs, whatever its support, and standard errors below the observed confidence.
MIN_COUNT, Z = 20, 3.3
#: Rules are broadcast up to this number, and joined by their token beyond it; the same for urls that a rule hits.
MAX_RULES, MAX_HITS = 100_000, 500_000
RULE = "rule_id long, token string, tokens array<string>, n_tokens int, confidence double, support double"
_COLUMNS = [c.split()[0] for c in RULE.split(", ")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, its leading ``/`` included, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    words = F.transform(F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda w: F.concat(F.lit("hw="), w))
    paths = F.transform(F.split(F.lower(path), r"[/.\-_]"), lambda w: F.concat(F.lit("pw="), F.regexp_replace(w, r"^\d+$", "#")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda w: F.concat(F.lit("q="), w))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1))))
    tokens = F.array_distinct(F.concat(scheme, suffixes, words, paths, keys))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(tokens, lambda t: ~t.rlike("^[a-z]+=$")))


def lower_confidence(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower limit of Wilson's interval for a share of ``hits`` in ``n``."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def labelled_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(url, bad) of the pages whose document of the same id has a quality label: bad where that is 0."""
    marked = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad")).where(F.col("_id").isNotNull() & F.col("bad").isNotNull())
    return pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")).where("_id is not null and url is not null").join(marked, "_id").select("url", "bad")


def token_sets(labelled: DataFrame) -> DataFrame:
    """(row, bad, items) of each distinct labelled url, stored."""
    votes = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.avg(F.col("bad").cast("double")).alias("share"))
    sets = votes.select(F.xxhash64("url").alias("row"), (F.col("share") > 0.5).alias("bad"), url_tokens(F.col("url")).alias("items"))
    return cut_lineage(sets, "urlsets")


def itemsets(sets: DataFrame, least: int) -> DataFrame:
    """(tokens, bad_freq): token combinations of at least ``least`` bad urls, each with all tokens that go with it."""
    tokens = sets.where("bad").select("row", F.explode("items").alias("token"))
    # Tokens of one and the same set of urls: equal number and equal sum and mixture of the urls' hashes.
    where = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("row")).alias("x")).where(F.col("n") >= least)
    item = cut_lineage(where.groupBy("n", "s", "x").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.element_at("tokens", 1).alias("item"), "n", "tokens"), "urlitems")
    own = tokens.join(item.select(F.col("item").alias("token")), "token")
    baskets = own.groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"))
    total = baskets.count()
    if not total:
        return sets.sparkSession.createDataFrame([], "tokens array<string>, bad_freq long")
    # Half a basket less, so that rounding can't lose an itemset of exactly ``least``.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(least - 0.5, 0.5) / total)).fit(baskets.select("items"))
    found = model.freqItemsets.select(F.xxhash64(F.array_sort("items")).alias("set"), F.col("freq").alias("bad_freq"), F.explode("items").alias("item"))
    wide = found.join(item.select("item", "tokens"), "item")
    return wide.groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"), F.max("bad_freq").alias("bad_freq")).select("tokens", "bad_freq").where(F.col("bad_freq") >= least)


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT, z: float = Z) -> DataFrame:
    """Pruned rules (columns of ``RULE``) from rows (url, bad boolean); all labelled urls are mined and counted."""
    sets = token_sets(labelled)
    size = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    least = max(min_count, -(-int(min_support * size.n * 1e9) // 10**9), 1)
    if size.bad < least:
        return labelled.sparkSession.createDataFrame([], RULE)
    found = cut_lineage(itemsets(sets, least).withColumn("rule_id", F.xxhash64("tokens")), "itemsets")
    seen = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = found.select("rule_id", F.explode("tokens").alias("token")).join(seen, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    found = found.join(rarest, "rule_id").withColumn("n_tokens", F.size("tokens"))
    total = _containing(sets.select("row", "items"), found.select("rule_id", "token", "tokens")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("freq"))
    rules = found.join(total, "rule_id").withColumn("confidence", F.col("bad_freq") / F.col("freq")).withColumn("support", F.col("bad_freq") / F.lit(float(size.n)))
    sure = lower_confidence(F.col("bad_freq").cast("double"), F.col("freq").cast("double"), z)
    rules = rules.where((sure >= min_confidence) & (sure >= min_lift * size.bad / size.n))
    rules = cut_lineage(rules.select(*_COLUMNS), "rules")
    other = rules.select(F.col("rule_id").alias("small"), "token", F.col("tokens").alias("small_tokens"), F.col("n_tokens").alias("small_n"), F.col("confidence").alias("small_c"))
    wider = rules.select("rule_id", "tokens", "n_tokens", "confidence", F.explode("tokens").alias("token")).join(other, "token")
    covered = wider.where("small_n < n_tokens and small_c >= confidence and size(array_except(small_tokens, tokens)) = 0").select("rule_id").distinct()
    return rules.join(covered, "rule_id", "left_anti").select(*_COLUMNS)


def _containing(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (with ``items``) times the rules whose tokens they all hold, through the token index."""
    index = F.broadcast(rules) if rules.limit(MAX_RULES + 1).count() <= MAX_RULES else rules
    return sets.withColumn("token", F.explode("items")).join(index, "token").where(F.size(F.array_except("tokens", "items")) == 0)


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct urls that at least one rule matches: url, n_rules, confidence (the highest)."""
    sets = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", url_tokens(F.col("url")).alias("items"))
    return _containing(sets, rules).groupBy("url").agg(F.count(F.lit(1)).alias("n_rules"), F.max("confidence").alias("confidence"))


def explicit_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest explicit rule that fits, else nulls; ``rules`` is a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, n_rules (mined rules that match) for every row of ``pages``."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    mined = mine_rules(labelled, **mining)
    if mined.limit(1).count():
        hit = cut_lineage(match_rules(pages, mined, url_col).select(F.col("url").alias("_hit"), "n_rules"), "urlhits")
        few = hit.limit(MAX_HITS + 1).count() <= MAX_HITS
        # Null urls match nothing and would all meet in one task: each gets a key of its own kind.
        key = F.coalesce("url", F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id"), F.lit(4096)).cast("string")))
        out = base.join(F.broadcast(hit) if few else hit, key == F.col("_hit"), "left")
    else:
        out = base.withColumn("n_rules", F.lit(0).cast("long"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("n_rules") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"))
