"""Operator 13: URL filters by rules, and by gradient-boosted trees where no rule speaks.

The rules label the URLs they fit; trees over lexical features (lengths, depth, shares of digits,
entropy, numbers of parameters, statistics of the host's suffix) learn from these and judge the rest.
All of it is DataFrame functions: a level of a tree is one sum of gradients by node, feature and bin,
of which the driver sees a bounded table, and a trained tree is one expression.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tastemill.operators import skew
from tastemill.session import stage

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols told apart by the entropy of a URL; all others count as one more.
SYMBOLS = DOWN + "0123456789-._~/?=&%:#+"
#: Labelled URLs that the trees are fitted on (those with the smallest hashes), and bins of a feature.
SAMPLE_URLS, BINS = 8000, 32
ROUNDS, DEPTH, RATE, SHRINK = 12, 3, 0.3, 1.0
#: Gradients are summed as integers of this unit, so that sums do not depend on their order.
UNIT = 1 << 20
#: The suffix is the host's last label; its statistics for a URL to learn from come from other folds.
SUFFIX, FOLDS = "substring_index(host, '.', -1)", 8
#: Suffixes of a table small enough to broadcast.
FEW_SUFFIXES = 100_000
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens",
    "digit_ratio", "host_digit_ratio", "parameters", "entropy", "suffix_blocked", "suffix_urls",
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Split(NamedTuple):
    """Rows whose feature is at most the cut (whose bin is at most the given one) go left."""

    feature: int
    bin: int
    cut: float
    left: object
    right: object


class Model(NamedTuple):
    base: float
    trees: list
    suffixes: DataFrame


# -- parts of a URL and rules --------------------------------------------------------------------------


def parts(url: str) -> dict[str, Column]:
    """Host (A-Z lower-cased), path and query of a URL column; empty for null or without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, DOWN)
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)}


def ruled(rules: list[Rule], what) -> Column:
    """``what(rule)`` of the longest rule that fits the columns ``host`` and ``path``, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        found = F.when(host & F.col("path").startswith(rule.path), F.lit(what(rule))).otherwise(found)
    return found


# -- features ------------------------------------------------------------------------------------------


def lexical(rows: DataFrame, url: str) -> DataFrame:
    """Add the features that a URL has by itself."""
    text = F.coalesce(F.col(url), F.lit(""))
    length = F.char_length(text)
    low = F.translate(text, UPPER, DOWN)
    counts = F.transform(F.array(*(F.lit(s) for s in SYMBOLS)), lambda s: length - F.char_length(F.replace(low, s, F.lit(""))))
    ratio = lambda value: F.regexp_count(value, F.lit("[0-9]")) / F.greatest(F.char_length(value), F.lit(1))
    rows = rows.withColumns(
        {
            "url_length": length.cast("double"),
            "host_length": F.char_length("host").cast("double"),
            "path_length": F.char_length("path").cast("double"),
            "query_length": F.char_length("query").cast("double"),
            "depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"),
            "labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "digit_ratio": ratio(text),
            "host_digit_ratio": ratio(F.col("host")),
            "parameters": F.regexp_count("query", F.lit("[^&]+")).cast("double"),
            "counts": counts,
        }
    )
    known = F.aggregate("counts", F.lit(0), lambda a, c: a + c)
    rows = rows.withColumn("counts", F.concat("counts", F.array(F.col("url_length").cast("int") - known)))
    term = lambda c: F.when(c > 0, -c / F.col("url_length") * F.log2(c / F.col("url_length"))).otherwise(F.lit(0.0))
    return rows.withColumn("entropy", F.aggregate("counts", F.lit(0.0), lambda a, c: a + term(c))).drop("counts")


def suffix_counts(labelled: DataFrame, *also: str) -> DataFrame:
    """Labelled URLs (``n``) and blocked ones (``b``) of each suffix."""
    return labelled.groupBy("suffix", *also).agg(F.count("*").alias("n"), F.sum("y").alias("b"))


def other_folds(suffixes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Counts of each suffix without those of one fold, for the URLs of that fold.

    A URL's own label must not be in its features: the trees would read it from there. The counts
    are scaled up to those of all folds, which verdicts go by.
    """
    scaled = lambda c: (F.col(c) - F.col(f"own_{c}")) * FOLDS / (FOLDS - 1)
    own = suffix_counts(labelled, "fold").withColumnsRenamed({"n": "own_n", "b": "own_b"})
    return own.join(suffixes, "suffix").select("suffix", "fold", scaled("n").alias("n"), scaled("b").alias("b"))


def with_suffixes(rows: DataFrame, suffixes: DataFrame, key: list[str]) -> DataFrame:
    """Add the statistics of the suffix: log2 of its labelled URLs, and their smoothed share of blocked ones."""
    if suffixes.count() <= FEW_SUFFIXES:
        found = rows.join(F.broadcast(suffixes), key, "left")
    else:
        found = skew.lookup(rows, suffixes, key, ["url"], "left")
    n, b = F.coalesce("n", F.lit(0)), F.coalesce("b", F.lit(0))
    return found.withColumns({"suffix_urls": F.log2(n + 1.0), "suffix_blocked": (b + 1.0) / (n + 2.0)}).drop("n", "b")


# -- trees ---------------------------------------------------------------------------------------------


def expression(tree, test) -> str:
    """A tree as SQL; ``test(split)`` is the condition of its left side."""
    if not isinstance(tree, Split):
        return f"{tree!r}D" if isinstance(tree, float) else str(tree)
    return f"CASE WHEN {test(tree)} THEN {expression(tree.left, test)} ELSE {expression(tree.right, test)} END"


def margin(base: float, trees: list, test) -> str:
    return " + ".join([f"{base!r}D", *(f"({expression(t, test)})" for t in trees)])


def by_bin(split: Split) -> str:
    return f"bins[{split.feature}] <= {split.bin}"


def by_value(split: Split) -> str:
    return f"{FEATURES[split.feature]} <= {split.cut!r}D"


def grown(sums: dict, cuts: list[list[float]]) -> tuple[Split, list] | None:
    """The best split of a node by its sums (gradient, weight) per (feature, bin), and its sides' sums.

    Among equal gains the first feature and bin win. None if no split gains.
    """
    total = [0, 0]
    for (feature, _), (g, h) in sums.items():
        if feature == 0:
            total = [total[0] + g, total[1] + h]
    worth = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + SHRINK)
    best, found = 1e-9, None
    for feature, cut in enumerate(cuts):
        g = h = 0
        for k in range(len(cut)):
            more = sums.get((feature, k), (0, 0))
            g, h = g + more[0], h + more[1]
            gain = worth(g, h) + worth(total[0] - g, total[1] - h) - worth(*total)
            if gain > best:
                best, found = gain, (Split(feature, k, cut[k], None, None), [(g, h), (total[0] - g, total[1] - h)])
    return found


def placed(tree, leaves: dict):
    """The tree with its numbered leaves replaced."""
    if isinstance(tree, Split):
        return tree._replace(left=placed(tree.left, leaves), right=placed(tree.right, leaves))
    return leaves.get(tree, tree)


def boosted(sample: DataFrame, cuts: list[list[float]], base: float, rounds: int = ROUNDS, depth: int = DEPTH) -> list:
    """Trees fitted to ``sample`` (``bins``, ``n`` rows of which ``b`` are blocked) by logistic loss.

    Each level is one job, whose result has at most 2 ** depth * features * bins rows.
    """
    trees = []
    for _ in range(rounds):
        p = f"1 / (1 + exp(-({margin(base, trees, by_bin)})))"
        rows = sample.selectExpr("bins", "n", "b", f"{p} AS p").selectExpr(
            "bins", f"CAST(round((b - n * p) * {UNIT}) AS BIGINT) AS g", f"CAST(round(n * p * (1 - p) * {UNIT}) AS BIGINT) AS h"
        )
        tree, open_leaves, values, number = 0, {0}, {}, 1
        for _ in range(depth):
            at = rows.selectExpr(f"{expression(tree, by_bin)} AS leaf", "posexplode(bins) AS (feature, bin)", "g", "h")
            sums: dict[int, dict] = {}
            for r in at.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["leaf"], {})[r["feature"], r["bin"]] = (r["g"], r["h"])
            splits = {}
            for leaf in sorted(open_leaves):
                found = grown(sums.get(leaf, {}), cuts)
                if found:
                    split, sides = found
                    splits[leaf] = split._replace(left=number, right=number + 1)
                    values |= {number + k: RATE * g / (h + SHRINK * UNIT) for k, (g, h) in enumerate(sides)}
                    open_leaves |= {number, number + 1}
                    number += 2
                open_leaves.discard(leaf)
            if not splits:
                break
            tree = placed(tree, splits)
        if tree == 0:
            break
        trees.append(placed(tree, values))
    return trees


def learn(labelled: DataFrame, url: str = "url", label: str = "blocked", sample_urls: int = SAMPLE_URLS) -> Model:
    """A model of labelled URLs: ``label`` is a boolean; null labels are left out, a null URL is empty.

    Each distinct URL counts once, as blocked if any of its rows is. Statistics of suffixes come from
    all of them; the trees are fitted on the ``sample_urls`` of them with the smallest hashes. No URLs,
    or one label only, give a model without trees.
    """
    rows = labelled.where(F.col(label).isNotNull()).groupBy(F.coalesce(F.col(url), F.lit("")).alias("url"))
    rows = rows.agg(F.max(F.col(label).cast("int")).alias("y")).withColumns(parts("url"))
    rows = stage(rows.withColumns({"suffix": F.expr(SUFFIX), "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")}), "urls")
    suffixes = stage(suffix_counts(rows), "suffixes")
    n, b = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    base = math.log((b + 1) / (n - b + 1))
    if not 0 < b < n:
        return Model(base, [], suffixes)
    chosen = rows.orderBy(F.xxhash64("url", F.lit(1)), "url").limit(sample_urls)
    others = stage(other_folds(suffixes, rows), "suffix-folds")
    measured = with_suffixes(lexical(chosen, "url"), others, ["suffix", "fold"]).select("y", *FEATURES)
    measured = stage(measured.coalesce(1), "url-features")
    places = "array(" + ", ".join(f"{(k + 1) / (BINS + 1)!r}D" for k in range(BINS)) + ")"
    bounds = measured.selectExpr(*(f"percentile({f}, {places}) AS {f}" for f in FEATURES)).first()
    cuts = [sorted(set(bounds[f])) for f in FEATURES]
    bins = F.array(*(sum((F.col(f) > c).cast("int") for c in cut) for f, cut in zip(FEATURES, cuts)))
    binned = measured.select("y", bins.alias("bins")).groupBy("bins").agg(F.count("*").alias("n"), F.sum("y").alias("b"))
    return Model(base, boosted(stage(binned.coalesce(1), "url-bins").coalesce(1), cuts, base), suffixes)


# -- verdicts ------------------------------------------------------------------------------------------


def judge(pages: DataFrame, model: Model, rules: list[Rule], url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """Carried columns, ``host``, ``path``, ``rule`` (like ``net/``, else null), ``verdict``, ``score``.

    The verdict is the longest fitting rule's; without one, ``block`` if the trees' ``score`` (0 to 1)
    is above 0.5, else ``allow``. A null URL, or one without ``://``, has an empty host and path and
    goes by its features. Equal rows get equal verdicts; no rows give none. A carried column named
    like a result gives way to it.
    """
    new = ["host", "path", "rule", "verdict", "score"]
    carry = [c for c in (pages.columns if carry is None else carry) if c not in new]
    # the carried columns travel in one struct, so that no name clashes
    row = F.struct(F.lit(True).alias("_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)))
    rows = pages.select(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), row.alias("row")).withColumns(parts("url"))
    rows = rows.withColumns({"rule": ruled(rules, lambda r: r.host + r.path), "ruling": ruled(rules, lambda r: r.verdict)})
    rows = with_suffixes(lexical(rows.withColumn("suffix", F.expr(SUFFIX)), "url"), model.suffixes, ["suffix"])
    score = F.expr(f"1 / (1 + exp(-({margin(model.base, model.trees, by_value)})))")
    verdict = F.coalesce("ruling", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)]
    return rows.withColumn("score", score).select(*kept, "host", "path", "rule", verdict.alias("verdict"), "score")


def by_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """URLs that a rule fits, with its verdict as the label ``blocked``."""
    rows = pages.select(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url")).withColumns(parts("url"))
    return rows.select("url", ruled(rules, lambda r: r.verdict).alias("ruling")).where("ruling IS NOT NULL").select("url", (F.col("ruling") == "block").alias("blocked"))


def verdicts(pages: DataFrame, rules: list[Rule], url: str = "url", carry: list[str] | None = None) -> DataFrame:
    """Rules, and trees trained on the URLs that the rules decide; see ``judge``."""
    return judge(pages, learn(by_rules(pages, rules, url)), rules, url, carry)
