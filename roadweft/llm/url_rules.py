"""URL filtering by association rules mined with FP-growth.

A URL is a set of tokens: its host's suffixes, path segments and query names. FP-growth (Spark
MLlib, JVM-side, distributed) finds the token combinations that are frequent among labelled URLs;
those whose confidence for a label is high enough become rules. Minimal rules are kept, and match
through an inverted index (token -> rules that hold it): a rule fires where all its tokens are met.

Hand-written rules (host, path) take precedence; the longest that fits wins. Without other labels
their verdicts on three quarters of the URLs that they cover are what is learnt from; URLs that
they don't cover are unlabelled, and judged by the mined rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.llm.columns import named
from roadweft.session import materialize

#: (action, host, path)
Rule = tuple[str, str, str]

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
#: URLs of this remainder are not learnt from, so that mined rules can be held against them.
FOLDS, HELD_OUT = 4, 2
_LABEL = "label="
_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"(?s)\A([^/?#]*)", 1), _A, _Z), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: every suffix of the host and its first label, every path segment by its
    place and the last one's extension, names in the query. Runs of digits become 0."""
    labels = F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.lit("host"), n.cast("string"), F.lit("="), F.array_join(F.slice(labels, -n, n), ".")))
    parts = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), plain(s)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("query="), plain(F.substring_index(p, "=", 1))))
    kind = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})\z", 1)
    more = F.array(F.concat(F.lit("first="), F.element_at(labels, 1)), F.concat(F.lit("type="), plain(kind)))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, parts, names, more)))


def listed(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest rule that fits, or null. A rule fits its host and all
    subdomains where the path starts with the rule's. ``rules`` is a configuration of fixed size."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the last that fits is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _frequent(labelled: DataFrame, min_support: float) -> tuple[DataFrame, DataFrame]:
    """(baskets of frequent tokens and the label per labelled URL: items; frequent tokens: token, as_).

    Tokens that stand on exactly the same URLs, as a site's long common path does, are one item, the
    first of them: it says as much as any combination of them, of which there would be 2 to the
    power of their number."""
    rows = materialize(labelled.select("_tokens", "_label").withColumn("_row", F.monotonically_increasing_id()), "url-labels")
    held = rows.select("_row", F.explode("_tokens").alias("_t"))
    seen = held.groupBy("_t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("_row").cast("decimal(38,0)")).alias("on")).filter(F.col("n") >= min_support * rows.count())
    alike = seen.groupBy("n", "on").agg(F.collect_list("_t").alias("all")).select(F.explode("all").alias("token"), F.array_min("all").alias("as_"))
    alike = materialize(alike, "url-tokens")
    firsts = alike.filter("token = as_").select(F.col("token").alias("_first"))
    kept = held.join(firsts, F.col("_t") == F.col("_first"), "left_semi").groupBy(F.col("_row").alias("_of")).agg(F.collect_list("_t").alias("kept"))
    label = F.array(F.concat(F.lit(_LABEL), "_label"))
    baskets = rows.join(kept, F.col("_row") == F.col("_of"), "left").select(F.when(F.col("kept").isNull(), label).otherwise(F.concat("kept", label)).alias("items"))
    return materialize(baskets, "url-baskets"), alike


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """(rules, tokens): rules (rule_id, label, tokens, confidence, support) from ``labelled``
    (_tokens, _label), and the item (as_) that each frequent token counts as in them.

    Frequent sets come from all labelled rows. Of the rules for a label, those that hold a smaller
    rule's tokens are dropped. With relative support s there are at most (tokens per URL) / s
    frequent tokens, so the rules don't grow with the input.
    """
    baskets, alike = _frequent(labelled, min_support)
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "rule_id bigint, label string, tokens array<string>, confidence double, support double"), alike
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith(_LABEL)).select(
        F.substring(F.element_at("consequent", 1), len(_LABEL) + 1, 1 << 20).alias("label"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    )
    rules = materialize(rules.filter(~F.exists("tokens", lambda t: t.startswith(_LABEL))), "url-rules")
    small, big = rules.alias("a"), rules.alias("b")
    # a smaller rule shares its first token with every rule that holds it
    holds = (F.col("a.label") == F.col("b.label")) & (F.size("a.tokens") < F.size("b.tokens")) & (F.size(F.array_except("a.tokens", "b.tokens")) == 0)
    keyed = big.withColumn("_t", F.explode("b.tokens"))
    redundant = keyed.join(small.withColumn("_first", F.element_at("a.tokens", 1)), (F.col("_t") == F.col("_first")) & holds).select(F.col("b.label").alias("label"), F.col("b.tokens").alias("tokens")).distinct()
    minimal = rules.join(redundant, ["label", "tokens"], "left_anti")
    return materialize(minimal.select(F.xxhash64("label", F.array_join("tokens", "\u0001")).alias("rule_id"), "label", "tokens", "confidence", "support"), "url-minimal"), alike


def match(urls: DataFrame, rules: DataFrame, alike: DataFrame) -> DataFrame:
    """(_u, mined_rule, mined_label): of the rules that fire on ``urls`` (_u, _tokens), the one of
    highest confidence, then support, then smallest id. _u must be unique. A token stands for the
    item that it counts as."""
    index = rules.select(F.explode("tokens").alias("_t"), "rule_id", F.size("tokens").alias("_need"), "label", "confidence", "support", F.array_join("tokens", " ").alias("shown"))
    index = index.join(alike, F.col("_t") == F.col("as_")).select("token", "as_", "rule_id", "_need", "label", "confidence", "support", "shown")
    hits = urls.select("_u", F.explode("_tokens").alias("token")).join(index, "token").dropDuplicates(["_u", "rule_id", "as_"])
    fired = hits.groupBy("_u", "rule_id", "_need", "label", "confidence", "support", "shown").agg(F.count(F.lit(1)).alias("_got")).filter("_got = _need")
    best = fired.groupBy("_u").agg(F.max(F.struct("confidence", "support", (-F.col("rule_id")).alias("i"), "label", "shown")).alias("m"))
    return best.select("_u", F.col("m.shown").alias("mined_rule"), F.col("m.label").alias("mined_label"))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    labels: DataFrame | None = None,
    url: str = "url",
    page_id: str = "page_id",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, mined_rule for every row of ``pages``.

    Labels to mine from are ``labels`` (url, label: allow or block) if given, else the verdicts of
    the hand-written rules on the URLs that they cover, but for those of crc32 remainder HELD_OUT;
    URLs that no rule covers are unlabelled. Where no hand-written rule fits, the page gets the
    label of the mined rule that fires with the highest confidence, then support, or is allowed if
    none fires. Each distinct URL is judged once, so a URL that many rows share costs one row.

    Defined cases: a null URL, or one without ://, has empty host and path, no tokens, and is
    allowed; of mined rules that tie the one of smallest id decides; long URLs are read whole;
    repeated rows are all returned; without labels nothing is mined; an empty table gives an empty
    result; other columns are not read.
    """
    slim = pages.select(named(page_id).alias("page_id"), named(url).alias("_url"))
    urls = slim.filter("_url IS NOT NULL").select("_url").distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"), tokens_of(F.col("_url")).alias("_tokens"))
    urls = materialize(urls.withColumn("_by", listed(F.col("_host"), F.col("_path"), rules)).withColumn("_u", F.monotonically_increasing_id()), "urls")
    if labels is None:
        learnt = F.col("_by").isNotNull() & (F.crc32(F.col("_url").cast("binary")) % FOLDS != HELD_OUT)
        labelled = urls.filter(learnt).select("_tokens", F.col("_by.action").alias("_label"))
    else:
        labelled = labels.filter(F.col("url").isNotNull() & F.col("label").isNotNull()).select(tokens_of(F.col("url")).alias("_tokens"), F.col("label").alias("_label"))
    mined = match(urls.filter("_by IS NULL").select("_u", "_tokens"), *mine(labelled, min_support, min_confidence))
    judged = urls.filter("_by IS NULL").select("_url", "_u").join(mined, "_u").select(F.col("_url").alias("_of"), "mined_rule", "mined_label")
    shown = slim.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    shown = shown.withColumn("_by", listed(F.col("host"), F.col("path"), rules)).join(judged, F.col("_url") == F.col("_of"), "left")
    return shown.select(
        "page_id",
        "host",
        "path",
        F.col("_by.rule").alias("rule"),
        F.coalesce(F.col("_by.action"), F.col("mined_label"), F.lit("allow")).alias("verdict"),
        F.when(F.col("_by").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )
