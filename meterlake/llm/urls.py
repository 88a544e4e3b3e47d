"""URL filter: longest-match rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions. The labelled URLs are those that a rule decides. The trees
are grown level by level from histograms that Spark sums over binned features, so a level costs
one small aggregate whatever the number of rows, and are applied as nested conditions.

Suffix statistics are counted over all URLs and cover all suffixes. No label is used twice: a hash of the host
deals hosts into folds, and the share of a suffix's URLs that rules block is taken from those of one
group of folds (``STATISTICS``), the trees are fitted on another (``FITTED``), their threshold is set on a third
(``CALIBRATED``), and the last is for nothing but to see how well they do (``held_out``). So all URLs of a suffix
have the same share, where trees are fitted and where they judge. Only the fit is bounded: at most
about ``MAX_LABELLED`` labelled rows.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and a
verdict by its features; repeated rows are judged alike; without labelled rows the trees allow;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import lookup, stored, whole

#: Rules of the registered query: verdict, host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules that are one expression; more are a table that is joined.
RULES_INLINE = 200
MAX_LABELLED = 20_000
#: Ruled URLs of a suffix that count as much as the prior share of blocked ones.
PRIOR_ROWS, PRIOR = 10, 0.5
BINS, TREES, DEPTH, RATE, RIDGE = 16, 8, 3, 0.4, 1.0
FEATURES = (
    "length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "longest_label",
    "path_digits", "hyphens", "suffix_share", "suffix_rate_apart",
)
#: Folds of hosts, and what those with labels serve for.
FOLDS, STATISTICS, FITTED, CALIBRATED, HELD_OUT = 6, (0, 1), (2, 3), 4, 5
#: Labelled URLs of either verdict without which the threshold stays where both weigh alike.
LEAST_CALIBRATED = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(rules: tuple[tuple[str, str], ...], host: Column, path: Column) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null; of equals the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def fitted(rows: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows of host and path with the longest fitting rule as ``fit``."""
    if len(rules) <= RULES_INLINE:
        return rows.withColumn("fit", matched(rules, F.col("host"), F.col("path")))
    table = rows.sparkSession.createDataFrame([(rule.partition("/")[0], "".join(rule.partition("/")[1:]), rule, verdict, -k) for k, (verdict, rule) in enumerate(rules)], "domain string, start string, rule string, verdict string, place long")
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    places = rows.groupBy("host", "path").agg(F.count("*").alias("_n"))
    found = places.select("host", "path", "_n", F.explode(ends).alias("domain")).join(table, "domain").where(F.col("path").startswith(F.col("start")))
    best = found.groupBy("host", "path", "_n").agg(F.max(F.struct(F.length("rule").alias("n"), "place", "rule", "verdict")).alias("best"))
    keyed = best.select(F.struct("host", "path").alias("_at"), "_n", F.struct("best.rule", "best.verdict").alias("fit"))
    return lookup(rows.withColumn("_at", F.struct("host", "path")), keyed, "_at", "_n", rows.count()).drop("_at")


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column) -> Column:
    """Bits per character of the characters' frequencies; 0 for the empty text."""
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.array_distinct(F.array_remove(F.split(text, ""), ""))
    return F.when(n == 0, 0.0).otherwise(F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))))


def described(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """page_id, host, path, rule, and the lexical features but for the suffix statistics."""
    url = F.col("url")
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long"), whole("url").alias("url")).withColumns({"host": host, "path": path})
    rows = fitted(rows, rules)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    return rows.select(
        "page_id", "host", "path", "fit", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"),
        F.element_at(labels, -1).alias("suffix"),
        F.length(url).cast("double").alias("length"),
        _without(F.col("path"), "/").cast("double").alias("depth"),
        F.when(F.length(url) == 0, 0.0).otherwise(_without(url, "[0-9]") / F.length(url)).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double").alias("parameters"),
        F.length("host").cast("double").alias("host_length"),
        F.size(labels).cast("double").alias("host_labels"),
        F.array_max(F.transform(labels, F.length)).cast("double").alias("longest_label"),
        _without(F.col("path"), "[0-9]").cast("double").alias("path_digits"),
        _without(url, "-").cast("double").alias("hyphens"),
    )


def block_rate(blocked: Column, ruled: Column) -> Column:
    """The smoothed share of blocked URLs among ruled ones."""
    return (blocked + PRIOR_ROWS * PRIOR) / (ruled + PRIOR_ROWS)


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """For every host suffix how many URLs it has, how many a rule decides and how many a rule blocks, and these of the hosts set apart for them."""
    ruled, blocked, apart = F.col("fit").isNotNull(), F.col("fit.verdict") == "block", F.col("fold").isin(*STATISTICS)
    counts = {"ruled": ruled, "blocked": blocked, "ruled_apart": ruled & apart, "blocked_apart": blocked & apart}
    return rows.groupBy("suffix").agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counts.items()])


def featured(rows: DataFrame) -> DataFrame:
    """Stored rows with the statistics of their suffixes; suffixes that many rows have are joined apart."""
    counts = stored(suffix_statistics(rows), "suffixes")
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = counts.withColumns({"weight": F.col("n"), "suffix_share": F.col("n") / total}).drop("n")
    joined = lookup(rows, share, "suffix", "weight", total)
    return joined.withColumns({"suffix_block_rate": block_rate(F.col("blocked"), F.col("ruled")), "suffix_rate_apart": block_rate(F.col("blocked_apart"), F.col("ruled_apart"))})


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    at: float
    low: "Split | Leaf"
    high: "Split | Leaf"


def scored(base: float, trees: list) -> Column:
    """The trees' summed score as an expression."""

    def value(node: Split | Leaf) -> Column:
        if isinstance(node, Leaf):
            return F.lit(node.value)
        return F.when(F.col(node.feature) <= node.at, value(node.low)).otherwise(value(node.high))

    score = F.lit(base)
    for tree in trees:
        score = score + value(tree)
    return score


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Split | Leaf:
    """One tree on rows with the columns g (gradient), h (curvature) and b_<feature> (bin)."""
    leaves: dict[int, tuple] = {1: ()}
    chosen: dict[int, tuple[str, int]] = {}
    totals: dict[int, tuple[float, float]] = {}
    used = [f for f in cuts if cuts[f]]
    for _ in range(DEPTH):
        node = F.lit(1)
        for parent, (feature, cut) in sorted(chosen.items()):
            node = F.when(node == parent, F.when(F.col(f"b_{feature}") <= cut, 2 * parent).otherwise(2 * parent + 1)).otherwise(node)
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in used]))
        sums = rows.select(node.alias("node"), "g", "h", each.alias("x")).groupBy("node", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        table: dict[tuple[int, str], dict[int, tuple[float, float]]] = {}
        for r in sums:
            table.setdefault((r["node"], r["feature"]), {})[r["bin"]] = (r["g"], r["h"])
        splits = {}
        for (at, feature), bins in sorted(table.items()):
            if at not in leaves:
                continue
            g, h = (sum(v[k] for v in bins.values()) for k in (0, 1))
            totals[at] = g, h
            left_g = left_h = 0.0
            for b in sorted(bins)[:-1]:
                left_g, left_h = left_g + bins[b][0], left_h + bins[b][1]
                gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                if gain > 1e-6 and gain > splits.get(at, (0.0,))[0] * (1 + 1e-9):
                    splits[at] = gain, feature, b, (left_g, left_h), (g - left_g, h - left_h)
        if not splits:
            break
        leaves = {}
        for at, (_, feature, b, low, high) in splits.items():
            chosen[at] = feature, b
            for child, sum_ in ((2 * at, low), (2 * at + 1, high)):
                leaves[child], totals[child] = (), sum_

    def built(at: int) -> Split | Leaf:
        if at in chosen:
            feature, cut = chosen[at]
            return Split(feature, cuts[feature][cut], built(2 * at), built(2 * at + 1))
        g, h = totals.get(at, (0.0, 0.0))
        return Leaf(-RATE * g / (h + RIDGE))

    return built(1)


def fit(rows: DataFrame) -> tuple[float, list]:
    """Boosted trees for blocking, from the rows that a rule decides: the base score, above which with the trees' sum 0 blocks, and the trees."""
    ruled = rows.where("fit is not null").where(F.col("fold").isin(*FITTED))
    n = ruled.count()
    if not n:
        return -1.0, []
    share = int(min(1.0, MAX_LABELLED / n) * (1 << 20))
    chosen = ruled.where(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20)) < share)
    y = (F.col("fit.verdict") == "block").cast("double")
    sample = stored(chosen.select(y.alias("y"), *FEATURES), "urls")
    marks = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    first = sample.agg(F.avg("y"), *[F.percentile_approx(f, marks) for f in FEATURES]).first()
    if first[0] is None:
        return -1.0, []
    rate = min(max(first[0], 1e-3), 1 - 1e-3)
    weight = F.when(F.col("y") == 1, 0.5 / rate).otherwise(0.5 / (1 - rate))  # both verdicts weigh alike, so rules of one kind set no prior
    base, trees = 0.0, []
    cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, first[1:], strict=True)}
    binned = sample.withColumns({f"b_{f}": sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES})
    binned = binned.persist()
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-scored(base, trees)))
        step = binned.withColumn("p", p).withColumns({"g": weight * (F.col("p") - F.col("y")), "h": weight * F.col("p") * (1 - F.col("p"))})
        trees.append(_grown(step, cuts))
    binned.unpersist()
    return base - threshold(rows, base, trees), trees


def threshold(rows: DataFrame, base: float, trees: list) -> float:
    """The score above which blocking agrees best with the rules on hosts that the trees have not seen, both verdicts weighing alike.

    The counts by score, rounded to hundredths, are few whatever the number of rows.
    """
    seen = rows.where((F.col("fold") == CALIBRATED) & F.col("fit").isNotNull())
    score = F.round(scored(base, trees), 2).alias("score")
    counts = seen.groupBy(score).agg(F.count_if(F.col("fit.verdict") == "block").alias("block"), F.count_if(F.col("fit.verdict") == "allow").alias("allow")).collect()
    table = sorted((r["score"], r["block"], r["allow"]) for r in counts)
    blocks, allows = (sum(t[k] for t in table) for k in (1, 2))
    if min(blocks, allows) < LEAST_CALIBRATED:
        return 0.0

    def agreed(at: float) -> float:
        return sum(b for s, b, _ in table if s > at) / blocks + sum(a for s, _, a in table if s <= at) / allows

    between = [(x[0] + y[0]) / 2 for x, y in zip(table, table[1:], strict=False)]
    best = max([0.0, *between], key=lambda at: (round(agreed(at), 9), -abs(at)))
    return best if agreed(best) > agreed(0.0) else 0.0


def held_out(rows: DataFrame, base: float, trees: list) -> DataFrame:
    """How the trees judge ruled URLs of hosts kept from statistics, fit and threshold: the rules' verdict, theirs, and how many."""
    apart = rows.where((F.col("fold") == HELD_OUT) & F.col("fit").isNotNull())
    own = F.when(scored(base, trees) > 0, "block").otherwise("allow")
    return apart.groupBy(F.col("fit.verdict").alias("verdict"), own.alias("judged")).agg(F.count("*").alias("n"))


def used_features(trees: list) -> set[str]:
    """The features that any tree splits by."""
    found, open_ = set(), list(trees)
    while open_:
        node = open_.pop()
        if isinstance(node, Split):
            found.add(node.feature)
            open_ += [node.low, node.high]
    return found


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per URL: its parts, the rule that decides it if any, and the verdict."""
    rows = featured(stored(described(pages, rules), "url-features"))
    base, trees = fit(rows)
    blocks = 1 / (1 + F.exp(-scored(base, trees)))
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return rows.withColumn("block_score", blocks).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "block_score"
    )
