"""Verdicts on URLs: the longest fitting rule, or else gradient-boosted trees on what the URL looks like.

Rules judge the URLs that they fit, and these are the labelled URLs from which the trees are trained: lengths, depth, digits,
entropies, parameters, and the share of blocked URLs among the labelled ones of the same host ending, first folder and file
ending. Those shares are counted over all labelled URLs; a labelled URL takes them from the folds of other hosts. All is in
DataFrame functions and MLlib, so work stays in the JVM and is divided by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tables import lower_az, slim, stage

ALLOW, BLOCK = "allow", "block"
FOLDS = 5
#: keys of the counted endings: column, and the weight of the overall share in labelled URLs
ENDINGS = ["tld", "site", "folder", "file"]
PRIOR = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return lower_az(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # a longer rule comes before the shorter ones
        if says not in (ALLOW, BLOCK) or "/" not in text:
            raise ValueError(f"{text} {says} is no rule")
        host, slash, path = text.partition("/")
        own = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = own & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> Column:
    """Entropy in bits of the characters of a column."""
    letters = F.split(F.col(text), "")
    n = F.size(letters)
    # runs of the sorted letters: each distinct one with its count
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c))))


def with_features(df: DataFrame) -> DataFrame:
    """Lexical columns of ``_url``, ``host`` and ``path``, and the keys of endings."""
    count = lambda text, what: F.length(text) - F.length(F.regexp_replace(text, what, ""))
    labels = F.split("host", r"\.")
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    last = F.element_at(F.split("path", "/"), -1)
    return df.select(
        "*",
        F.length("_url").cast("double").alias("f_length"),
        F.length("host").cast("double").alias("f_host_length"),
        F.length("path").cast("double").alias("f_path_length"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double").alias("f_depth"),
        F.size(labels).cast("double").alias("f_host_depth"),
        (count("_url", "[0-9]") / F.greatest(F.length("_url"), F.lit(1))).alias("f_digits"),
        (count("host", "[0-9]") / F.greatest(F.length("host"), F.lit(1))).alias("f_host_digits"),
        count("host", "-").cast("double").alias("f_hyphens"),
        entropy("host").alias("f_host_entropy"),
        entropy("path").alias("f_path_entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "[&;]")).cast("double")).alias("f_parameters"),
        F.col("_url").contains("#").cast("double").alias("f_fragment"),
        F.col("_url").startswith("https:").cast("double").alias("f_secure"),
        F.element_at(labels, -1).alias("tld"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("site"),
        F.regexp_extract("path", r"^/([^/]*)/", 1).alias("folder"),
        F.regexp_extract(last, r"\.([^.]*)$", 1).alias("file"),
        F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int").alias("fold"),
    )


LEXICAL = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_host_depth", "f_digits", "f_host_digits", "f_hyphens", "f_host_entropy", "f_path_entropy", "f_parameters", "f_fragment", "f_secure"]
SHARES = [f"s_{e}" for e in ENDINGS]


def count_endings(labelled: DataFrame) -> DataFrame:
    """ending, key, fold, n and blocked: counts of the labelled URLs, in one pass; fold -1 has all of them."""
    keys = F.array(*[F.struct(F.lit(e).alias("ending"), F.col(e).alias("key")) for e in ENDINGS])
    rows = labelled.select("fold", "blocked", F.inline(keys))
    by_fold = rows.groupBy("ending", "key", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"))
    by_fold = stage(by_fold)
    return stage(by_fold.unionByName(by_fold.groupBy("ending", "key").agg(F.lit(-1).alias("fold"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))))


def with_shares(df: DataFrame, counts: DataFrame, overall: float) -> DataFrame:
    """Smoothed shares of blocked URLs by ending; labelled rows leave out the fold of their host."""
    for ending in ENDINGS:
        mine = counts.where(F.col("ending") == ending)
        whole = mine.where("fold = -1").select(F.col("key").alias(ending), F.col("n").alias("_n"), F.col("blocked").alias("_b"))
        part = mine.where("fold >= 0").select(F.col("key").alias(ending), "fold", F.col("n").alias("_fn"), F.col("blocked").alias("_fb"))
        df = df.join(whole, ending, "left").join(part, [ending, "fold"], "left")
        own = F.col("blocked").isNotNull()
        n = F.coalesce("_n", F.lit(0)) - F.when(own, F.coalesce("_fn", F.lit(0))).otherwise(0)
        b = F.coalesce("_b", F.lit(0)) - F.when(own, F.coalesce("_fb", F.lit(0))).otherwise(0)
        df = df.withColumn(f"s_{ending}", (b + overall * PRIOR) / (n + PRIOR)).drop("_n", "_b", "_fn", "_fb")
    return df


def fit_trees(labelled: DataFrame, rounds: int, depth: int, seed: int = 7) -> GBTClassificationModel:
    """``labelled`` has the vector column ``features`` and the double ``blocked``."""
    return GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=64, seed=seed).fit(labelled)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], most_labelled: int = 20_000, rounds: int = 12, depth: int = 4, at_least: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and blocked: the trees' probability, null where a rule decides.

    The trees see at most ``most_labelled`` labelled URLs, the first by a hash of the URL and the id; the shares of endings
    count all of them, and every URL is judged. If rules give only one verdict, that one holds for all URLs, and without any
    labelled URL all are allowed. A null URL has an empty host and path and is judged like any other, and so are null ids and
    repeated rows, each by itself. An empty table gives no row. Other columns are neither read nor kept, so names cannot clash.
    """
    own = slim(pages, page_id=page_id, _url=url).withColumn("_url", F.coalesce(F.col("_url").cast("string"), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    rule, verdict = fitting_rule(rules)
    own = own.select("page_id", "_url", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), verdict.alias("says"))
    known = with_features(own.withColumn("blocked", (F.col("says") == BLOCK).cast("double")))
    known = stage(known)
    labelled, rest = known.where("says is not null"), known.where("says is null")
    out = ["page_id", "host", "path", "rule"]
    by_rule = labelled.select(*out, F.col("says").alias("verdict"), F.lit(None).cast("double").alias("blocked"))
    seen = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")).first()
    if not seen.n or seen.b in (0, seen.n):
        constant = BLOCK if seen.n and seen.b else ALLOW
        return by_rule.unionByName(rest.select(*out, F.lit(constant).alias("verdict"), F.lit(float(constant == BLOCK)).alias("blocked")))
    overall, counts = seen.b / seen.n, count_endings(labelled)
    assemble = VectorAssembler(inputCols=LEXICAL + SHARES, outputCol="features")
    # a hash of the rows gives about the bound; the limit only takes off what chance has put above it
    share = min(1.0, 0.9 * most_labelled / seen.n)
    sample = labelled if seen.n <= most_labelled else labelled.where(F.pmod(F.xxhash64("_url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most_labelled)
    sample = stage(assemble.transform(with_shares(sample, counts, overall)).select("features", "blocked"))
    model = fit_trees(sample, rounds, depth)
    judged = model.transform(assemble.transform(with_shares(rest, counts, overall)))
    chance = vector_to_array("probability")[1]
    by_trees = judged.select(*out, F.when(chance >= at_least, BLOCK).otherwise(ALLOW).alias("verdict"), chance.alias("blocked"))
    return by_rule.unionByName(by_trees)
