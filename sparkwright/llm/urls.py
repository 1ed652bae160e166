"""URL filters: allow and block rules, else gradient-boosted trees on lexical features.

Everything is DataFrame expressions: parsing, rules and features are built-in
functions, the trees are fitted by the library's own DataFrame-based trainer and
then compiled into CASE expressions, so that scoring needs neither vectors nor
Python and stays in generated code. No list of words is used: length, depth, digits,
entropy, parameters, hyphens and the block rate of the host's suffix decide.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) rules; the longest that fits a URL decides.
Rule = tuple[str, str, str]

#: Parts of hosts, and suffixes, from which labelled URLs are made where none are given.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ba ce di fu go ka lo mi pu ra su vi zo".split()
USUAL = "com com com org org net edu gov io de fr co.uk".split()
DOUBTFUL = "top xyz click online info biz icu com net".split()


def parse(df: DataFrame, url_col: str) -> DataFrame:
    """Adds host (A-Z lower-cased), path and query; all empty for a null URL or one without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return (
        df.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
        .withColumn("query", F.regexp_extract("_rest", "^[^?#]*\\?([^#]*)", 1))
        .drop("_rest")
    )


def rule_of(rules: list[Rule], give: str) -> Column:
    """The longest rule's text (``give`` = "rule") or verdict, null where none fits.
    A rule fits its host and all subdomains where the path begins with its path."""
    out = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path if give == "rule" else verdict)).otherwise(out)
    return out


def labelled_urls(spark: SparkSession, count: int = 4000) -> DataFrame:
    """url, block (0/1), made from a rule. A third are blocked, each for one of four
    reasons: a host of words strung together by hyphens, a host of random letters and
    digits, a deep path with many parameters, a short host with digits under a
    doubtful suffix. The others have spoken hosts, few of them with a hyphen, and
    ordinary paths; both kinds share subdomains, languages and tails."""
    draw = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (draw(len(words), salt) + 1).cast("int"))
    each = lambda least, more, salt, f: F.transform(F.sequence(F.lit(1), (F.lit(least) + draw(more, salt)).cast("int")), lambda i: f(F.pmod(F.xxhash64("id", i, F.lit(salt)), F.lit(1_000_000))))
    spoken = lambda salt: F.concat_ws("", each(2, 4, salt, lambda n: F.element_at(F.array(*map(F.lit, SYLLABLES)), (n % len(SYLLABLES) + 1).cast("int"))))
    block, why = (draw(3, 0) == 0), draw(4, 1)
    strung = F.concat(spoken(10), F.lit("-"), F.when(draw(3, 19) == 0, pick(["x", "1", "go", "24"], 18)).otherwise(spoken(20)), F.when(draw(3, 30) == 0, F.concat(F.lit("-"), pick(SYLLABLES, 31))).otherwise(F.lit("")))
    random = F.substring(F.translate(F.md5(F.concat(F.lit("u"), F.col("id").cast("string"))), "0246", "kqzx"), 1, 22).substr(F.lit(1), (11 + draw(11, 32)).cast("int"))
    short = F.concat(pick(SYLLABLES, 33), pick(SYLLABLES, 34), (10 + draw(990, 35)).cast("string"))
    plain = F.concat(spoken(36), F.when(draw(60, 40) == 0, F.concat(F.lit("-"), pick(SYLLABLES, 41))).otherwise(F.lit("")))
    core = F.when(block & (why == 0), strung).when(block & (why == 1), random).when(block & (why == 3), short).otherwise(plain)
    suffix = F.when(block & ((why == 3) | (draw(3, 42) == 0)), pick(DOUBTFUL[:7], 43)).when(draw(20, 44) == 0, pick(DOUBTFUL, 45)).otherwise(pick(USUAL, 46))
    host = F.concat(pick(["", "", "www.", "m.", "blog.", "news."], 47), core, F.lit("."), F.when(draw(3, 48) == 0, F.concat(spoken(49), F.lit("."))).otherwise(F.lit("")), suffix)
    dated = F.concat_ws("/", (1990 + draw(40, 50)).cast("string"), (1 + draw(12, 51)).cast("string"), (1 + draw(28, 52)).cast("string"), spoken(57))
    paged = F.concat_ws("/", pick(["en", "fr", "de", "es", "a", "p"], 53), F.when(draw(2, 54) == 0, draw(9000, 55).cast("string")).otherwise(spoken(56)), F.when(draw(3, 60) == 0, F.concat(spoken(61), F.lit("-"), spoken(62))))
    plainly = F.concat(F.lit("/"), F.when(draw(6, 58) == 0, dated).when(draw(6, 59) == 0, F.lit("")).otherwise(paged))
    deep = F.concat(F.lit("/"), F.concat_ws("/", each(6, 5, 65, lambda n: F.when(n % 2 == 0, (n % 9999).cast("string")).otherwise(F.substring(F.md5(n.cast("string")), 1, 5)))))
    tail = pick(["", "", "/", ".html", "?page=2&ref=x", "?q=a", "#top"], 66)
    many = F.concat(F.lit("?"), F.concat_ws("&", each(4, 5, 67, lambda n: F.concat(F.substring(F.md5(n.cast("string")), 1, 2), F.lit("="), n.cast("string")))))
    url = F.concat(pick(["http://", "https://"], 68), host, F.when(block & (why == 2), F.concat(deep, many)).otherwise(F.concat(plainly, tail)))
    return spark.range(0, count, 1, 1).select(url.alias("url"), block.cast("int").alias("block"))


FEATURES = ("length", "host_length", "depth", "digits", "host_digits", "entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_rate")
#: Rows that the overall block rate counts for in that of a suffix.
PRIOR = 8


def with_features(df: DataFrame, url_col: str) -> DataFrame:
    """Adds FEATURES, but for ``suffix_rate``, and ``suffix`` to a parsed table."""
    url, host = F.coalesce(F.col(url_col), F.lit("")), F.col("host")
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s)))).cast("double")
    ratio = lambda c: F.coalesce(F.try_divide((F.length(c) - F.length(F.translate(c, string.digits, ""))).cast("double"), F.length(c).cast("double")), F.lit(0.0))
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    share = lambda c: (F.length(host) - F.length(F.replace(host, c))).cast("double") / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(host, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log(2.0, share(c)))
    parts = F.split(host, "[.]")
    return df.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "depth": count(F.col("path"), "/"), "digits": ratio(url),
        "host_digits": ratio(host), "entropy": entropy, "parameters": count(F.col("query"), "="), "hyphens": count(host, "-"), "labels": F.size(parts).cast("double"),
        "longest_label": F.array_max(F.transform(parts, lambda p: F.length(p))).cast("double"), "suffix": F.element_at(parts, -1),
    })


class UrlModel:
    """Block rates of suffixes and the trees; ``margin`` is an expression over
    FEATURES, ``splits`` says how often the trees ask for each of them."""

    def __init__(self, rates: dict[str, float], rate: float, margin: Column, splits: dict[str, int]):
        self.rates, self.rate, self.margin, self.splits = rates, rate, margin, splits

    def suffix_rate(self) -> Column:
        if not self.rates:
            return F.lit(self.rate)
        table = F.create_map(*(F.lit(x) for kv in sorted(self.rates.items()) for x in kv))
        return F.coalesce(F.try_element_at(table, F.col("suffix")), F.lit(self.rate))


def _splits(node, found: dict[str, int]) -> None:
    if node.getClass().getSimpleName() != "LeafNode":
        found[FEATURES[node.split().featureIndex()]] += 1
        _splits(node.leftChild(), found)
        _splits(node.rightChild(), found)


def _case(node) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= float(split.threshold()), _case(node.leftChild())).otherwise(_case(node.rightChild()))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "block", most: int = 20_000, trees: int = 12, depth: int = 4, suffixes: int = 256) -> UrlModel:
    """Fit on at most ``most`` labelled URLs, those of the smallest hashes. The block
    rate of a suffix is that of the other half of the rows while the trees are fitted,
    so that no row's own label is in its features; scoring has the rates of all rows
    for the ``suffixes`` most frequent ones, and the overall rate for others."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    drawn = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("block"))
    drawn = drawn.orderBy(F.xxhash64("url"), "url", "block").limit(most)
    table = with_features(parse(drawn, "url"), "url").withColumn("half", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(2)))
    counts = table.groupBy("suffix", "half").agg(F.count("*").alias("n"), F.sum("block").alias("b"))
    rate = F.coalesce(F.try_divide(F.sum("b"), F.sum("n")), F.lit(0.5))
    overall = counts.agg(rate.alias("r")).first()["r"]
    smooth = lambda b, n: (b + F.lit(PRIOR * overall)) / (n + F.lit(PRIOR))
    other = counts.select("suffix", (1 - F.col("half")).alias("half"), smooth(F.col("b"), F.col("n")).alias("suffix_rate"))
    table = table.join(other, ["suffix", "half"], "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(overall)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table.select(*FEATURES, F.col("block").cast("double").alias("block")).sort(*FEATURES, "block").coalesce(1))
    model = GBTClassifier(labelCol="block", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7, cacheNodeIds=False).fit(vectors)
    terms, splits = [], dict.fromkeys(FEATURES, 0)
    for w, t in zip(model.treeWeights, model.trees, strict=True):
        root = t._call_java("rootNode")
        _splits(root, splits)
        terms.append(F.lit(float(w)) * _case(root))
    total = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).orderBy(F.desc("n"), "suffix").limit(suffixes)
    rates = {r["suffix"]: r["rate"] for r in total.select("suffix", smooth(F.col("b"), F.col("n")).alias("rate")).collect()}
    return UrlModel(rates, overall, functools.reduce(lambda a, b: a + b, terms), splits)


def judge(pages: DataFrame, rules: list[Rule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule (null where none fits), verdict (the rule's, else
    block where the trees' margin is above 0), margin.

    A null URL, or one without ``://``, has an empty host and path and no rule and
    is left to the trees. A URL of any length is read whole. Ids pass through, null or
    repeated; other columns, also ones that share a name with what is made here, are
    not looked at. An empty table gives an empty result."""
    narrow = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    full = with_features(parse(narrow, "_url"), "_url").withColumn("suffix_rate", model.suffix_rate()).withColumn("rule", rule_of(rules, "rule")).withColumn("margin", model.margin)
    verdict = F.coalesce(rule_of(rules, "verdict"), F.when(F.col("margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return full.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "margin")
