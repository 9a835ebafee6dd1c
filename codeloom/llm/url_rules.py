"""Operator 7: URL filtering by mined association rules.

Stated rules come first: the longest one whose host is the URL's or a parent of it
and whose path begins the URL's decides. For the rest, Spark's FP-growth mines
combinations of URL tokens (host labels, path words, query keys; digits are one
token) that go with a label, ``block`` or ``allow``. A rule is kept from ``min_count``
labelled pages on, however many pages are labelled, if its confidence beats the label's
share of all labelled pages by ``min_lift`` and even its lower bound, ``z`` standard
deviations down, is above that share: where few pages are blocked, half of a token's pages
may be reason enough, and chance is not. Rules that a shorter one of no less confidence
covers are dropped. Each rule is posted under its rarest token
only; a URL meets the rules posted under its tokens, and of those whose tokens it has
all, the one of the largest lift decides. Where none fits, the verdict is ``allow``.

Labels come from a table (id, quality, toxic): a page whose id it knows is ``block`` if
its quality is 0 or it is toxic. URLs with equal token sets are matched once, so a host
with a third of all pages is a few rows there. All of it is DataFrame expressions and
Spark's own FP-growth.

Cases: a null URL or one without ``://`` has an empty host and path, no rule and no
tokens, and is allowed; null ids keep their row and carry no label; of repeated labels of
an id each counts; equal rules in length go to the smaller; of mined rules equal in lift,
the one of more confidence, then support, then ``block``, then the larger tokens decides;
no labels or nothing frequent means no mined rules; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: the item that a page's label adds to its tokens, which all hold their kind before a ``=``
LABEL = "label="


def url_parts(url):
    """(host, path) of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def stated_rule(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules`` is a short list that becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url, host, path):
    """The distinct tokens of a URL, sorted."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    hosts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h="), x))
    words = F.transform(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p="), F.regexp_replace(x, r"\d+", "#")))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.regexp_replace(F.regexp_extract(x, r"^([^=]*)", 1), r"\d+", "#")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(hosts, words, keys), lambda x: F.length(x) > 2)))


def lower_bound(share, n, z: float):
    """The least share of a label that ``n`` pages with that share speak for, ``z`` standard deviations down (Wilson's interval)."""
    spread = F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - z * spread) / (1 + z * z / n)


def mine_rules(baskets: DataFrame, *, min_count: int = 30, min_lift: float = 1.05, z: float = 4.0) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, lift, support) from rows of (tokens, block)."""
    spark = baskets.sparkSession
    n, n_block = baskets.agg(F.count("*"), F.count_if("block")).first()
    if n < min_count:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, lift double, support double")
    min_support = (min_count - 0.5) / n  # Spark rounds the product with n up: half a page less stays clear of its rounding
    label = F.when(F.col("block"), F.lit(LABEL + "block")).otherwise(F.lit(LABEL + "allow"))
    found = durable(FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets.select(F.concat("tokens", F.array(label)).alias("items"))).freqItemsets)
    own = F.get(F.filter("items", lambda x: F.startswith(x, F.lit(LABEL))), F.lit(0))
    sets = found.select(F.array_sort(F.filter("items", lambda x: ~F.startswith(x, F.lit(LABEL)))).alias("tokens"), own.alias("label"), "freq").where(F.size("tokens") > 0)
    with_label = sets.where("label is not null").select("tokens", F.substr("label", F.lit(len(LABEL) + 1)).alias("verdict"), F.col("freq").alias("k"))
    share = F.when(F.col("verdict") == "block", F.lit(n_block / n)).otherwise(F.lit(1 - n_block / n))
    rules = with_label.join(sets.where("label is null").select("tokens", "freq"), "tokens").withColumn("confidence", F.col("k") / F.col("freq"))
    rules = rules.withColumns({"lift": F.col("confidence") / share, "support": F.col("k") / F.lit(n), "bound": lower_bound(F.col("confidence"), F.col("freq"), z)}).where((F.col("lift") >= min_lift) & (F.col("bound") > share))
    rules = durable(rules.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "lift", "support"))
    shorter = rules.select(F.element_at("tokens", 1).alias("token"), "verdict", F.col("tokens").alias("short"), F.col("confidence").alias("short_confidence"))
    covered = rules.select("rule_id", "tokens", "verdict", "confidence", F.explode("tokens").alias("token")).join(shorter, ["token", "verdict"])
    covered = covered.where((F.size("short") < F.size("tokens")) & (F.col("short_confidence") >= F.col("confidence")) & (F.size(F.array_except("short", "tokens")) == 0))
    return rules.join(covered.select("rule_id").distinct(), "rule_id", "left_anti")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, verdict, tokens, lift, confidence) of the strongest rule that each row (set_id, tokens) has all tokens of, by an index of each rule's rarest token."""
    common = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.select("rule_id", "verdict", "confidence", "lift", "support", F.col("tokens").alias("rule_tokens"), F.explode("tokens").alias("token")).join(common, "token")
    strength = F.struct("lift", "confidence", "support", "verdict", "rule_tokens")
    index = posted.groupBy("rule_id").agg(F.min_by(F.struct("token", strength.alias("rule")), F.struct("n", "token")).alias("r")).select("r.token", "r.rule")
    met = sets.select("set_id", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    best = met.where(F.size(F.array_except("rule.rule_tokens", "tokens")) == 0).groupBy("set_id").agg(F.max("rule").alias("rule"))
    return best.select("set_id", "rule.verdict", F.col("rule.rule_tokens").alias("tokens"), "rule.lift", "rule.confidence")


def _baskets(pages: DataFrame, labels: DataFrame, id_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """The pages with their parts and tokens, and (tokens, block) of those that have a label."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).withColumn("set_id", F.xxhash64("tokens"))
    known = labels.select(F.col("doc_id").alias("page_id"), F.coalesce((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), F.lit(False)).alias("block"))
    return rows, rows.select("page_id", "tokens", "set_id").join(known, "page_id").select("page_id", "tokens", "set_id", "block")


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, mined_tokens, lift) of every row; ``mined``: a mined rule fits, whose verdict counts where no stated one does."""
    rows, labelled = _baskets(pages, labels, id_col, url_col)
    mined = mine_rules(durable(labelled.select("tokens", "block")), **options)
    sets = rows.select("set_id", "tokens").distinct()
    # written, so that its size is known: small, it is broadcast by Spark; else AQE splits the rows of a hot host
    fits = durable(match_rules(sets, mined)).select("set_id", F.col("verdict").alias("mined_verdict"), F.col("tokens").alias("mined_tokens"), "lift")
    rule, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    out = rows.select("page_id", "host", "path", "set_id", rule.alias("rule"), verdict.alias("stated")).join(fits, "set_id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("stated", "mined_verdict", F.lit("allow")).alias("verdict"), F.col("mined_verdict").isNotNull().alias("mined"), "mined_tokens", "lift")


def held_out_precision(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(verdict, pages, right, share): mined verdicts on the half of the labelled pages (odd crc32 of the id) that rules weren't mined from, and the share of all labels there."""
    _, labelled = _baskets(pages, labels, id_col, url_col)
    labelled = durable(labelled.withColumn("odd", F.crc32(F.col("page_id").cast("string").cast("binary")) % 2 == 1))
    test = labelled.where("odd")
    mined = mine_rules(labelled.where("not odd").select("tokens", "block"), **options)
    fits = match_rules(test.select("set_id", "tokens").distinct(), mined).select("set_id", "verdict")
    share = test.agg(F.avg(F.col("block").cast("double"))).scalar()
    out = test.join(fits, "set_id").groupBy("verdict").agg(F.count("*").alias("pages"), F.count_if((F.col("verdict") == "block") == F.col("block")).alias("right"))
    return out.withColumn("share", F.when(F.col("verdict") == "block", share).otherwise(1 - share))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_url_rules": op7_url_rules}
ORACLE_SQL: dict[str, str] = {}
