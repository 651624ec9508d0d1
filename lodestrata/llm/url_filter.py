"""URL filters (operator 7, native): host and path rules, then association rules mined from labels.

Everything runs as DataFrame expressions and Spark's own FP-growth in the JVM.
A url's verdict is that of the longest fixed rule that fits; where none fits, it
is blocked if a mined rule matches. Mined rules have combinations of URL tokens
as antecedent and the label "bad" as consequent; those under a least support or
confidence are pruned, and so is a rule whose antecedent holds that of another
kept rule of no lower confidence. Rules are matched by an inverted index: each
is filed under its rarest token, so common tokens lead to no candidates.

Cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Repeated rows get the same verdict each. Without labels, or
if no rule survives, the method allows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, small_enough

#: Host, path and verdict of the fixed rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled rows that must hold a rule's tokens and label, however many rows are labelled; and the share of bad rows among those that hold its tokens.
MIN_ROWS, MIN_CONFIDENCE = 30, 0.5
BAD = "label:bad"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(host: str = "host", path: str = "path", url: str = "url") -> Column:
    """Distinct tokens: the host's suffixes, path segments (numbers as one sign), file ending and query keys."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.when(
        F.col(host) != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    ).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(F.lower(F.col(path)), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#")))
    ending = F.regexp_extract(F.col(path), r"\.([A-Za-z]{1,5})$", 1)
    ending = F.when(ending != "", F.array(F.concat(F.lit("end:"), F.lower(ending)))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.regexp_extract(s, "^[^=]*", 0)))
    return F.array_distinct(F.concat(suffixes, segments, ending, keys))


def fixed_rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path`` (of equally long ones, the first by name)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))[::-1]:
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def mine_rules(labelled: DataFrame, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """antecedent, confidence, support of the kept rules, from rows with ``tokens`` and a boolean ``bad``."""
    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    # Half a row less, as the library rounds the product of share and rows up.
    min_support = (min_rows - 0.5) / max(1, labelled.count())
    if min_support > 1:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    found = materialise(model.associationRules.filter(F.col("consequent") == F.array(F.lit(BAD))).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    # A shorter rule of no lower confidence makes a longer one needless. Shorter ones are found by their tokens.
    a = found.select(F.col("antecedent").alias("long"), F.col("confidence").alias("own"), F.explode("antecedent").alias("token"))
    b = found.select(F.col("antecedent").alias("short"), F.col("confidence").alias("other"), F.element_at("antecedent", 1).alias("token"))
    needless = a.join(b, "token").filter((F.size("short") < F.size("long")) & (F.size(F.array_except("short", "long")) == 0) & (F.col("other") >= F.col("own"))).select(F.col("long").alias("antecedent")).distinct()
    return found.join(needless, "antecedent", "left_anti")


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, url: str = "url", page_id: str = "page_id", rules: Sequence[tuple[str, str, str]] = RULES, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the best mined rule that matched): one row for each page.

    ``labels`` has doc_id, quality and toxic; a page is labelled through the
    document number in its path. Bad: quality 0 or toxic 1.
    """
    host, path = host_and_path(url)
    name, verdict = fixed_rule(rules)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("page_id", "url", "host", "path", url_tokens().alias("tokens"), name.alias("rule"), verdict.alias("fixed"))
    # A stable number for each row, as page ids may repeat.
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    out = rows.select("row", "page_id", "host", "path", "rule", "fixed")
    matched = None
    if labels is not None:
        number = F.regexp_extract("path", r"/(\d{1,18})(?:[./]|$)", 1)
        known = labels.filter("doc_id is not null").groupBy("doc_id").agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad")).filter("bad is not null")
        labelled = rows.filter(number != "").withColumn("doc_id", number.cast("long")).join(known, "doc_id").select("tokens", "bad")
        labelled = materialise(labelled, "labelled")
        if not labelled.isEmpty():
            kept = mine_rules(labelled, min_rows, min_confidence)
            often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
            filed = kept.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(often, "token").groupBy("antecedent", "confidence").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
            filed = materialise(filed, "index")
            if not filed.isEmpty():
                index = F.broadcast(filed) if small_enough(filed) else filed
                matched = rows.filter("fixed is null").select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence"))
    out = out.join(matched, "row", "left") if matched is not None else out.withColumn("confidence", F.lit(None).cast("double"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
