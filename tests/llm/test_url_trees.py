"""URL rules, features and boosted trees against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from tastemill.llm import queries, url_trees as ut
from tastemill.session import stage

FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG/es/1", "http://example.org", "http://example.org/en/1?x=/es/",
    "http://example.org/en/2", "http://notexample.org/es/1", "http://a.b.example.org/es/", "http://x.com/de/1#a?b=c", "http://com/fr/9",
    "http://com/de/", "http://xcom/de/", "x://y.com?/de/", "http://x.com/DE/1", "http://ÄÖ.COM/fr/é", "a://b://c.org/", "http://org\n/x",
    "http://x.com:80/de/1", "http://-a-b-.net/1/22//333/?a=1&b=2&&c#z", "http://e.net/" + "long/" * 20_000, "http://" + "\U0001f600." * 50 + "org/",
]


def plain_parts(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    query = rest[len(host) + len(path) :]
    query = query[1:].split("#")[0] if query.startswith("?") else ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path, query


def plain_rule(host, path):
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def plain_features(url):
    url = url or ""
    host, path, query = plain_parts(url)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url)
    counts = [low.count(s) for s in ut.SYMBOLS]
    counts.append(len(url) - sum(counts))
    digits = lambda s: len(re.findall("[0-9]", s)) / max(len(s), 1)
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "query_length": len(query),
        "depth": len([x for x in path.split("/") if x]), "labels": len([x for x in host.split(".") if x]), "hyphens": host.count("-"),
        "digit_ratio": digits(url), "host_digit_ratio": digits(host), "parameters": len([x for x in query.split("&") if x]),
        "entropy": -sum(c / len(url) * math.log2(c / len(url)) for c in counts if c),
    }


def plain_boosted(rows, cuts, base, rounds, depth):
    """Trees over (bins, n, b), written as nested tuples; a second statement of the same rule."""
    trees = []

    def value(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    def grow(part, left):
        g, h = sum(r[1] for r in part), sum(r[2] for r in part)
        worth = lambda a, b: (a / ut.UNIT) ** 2 / (b / ut.UNIT + ut.SHRINK)
        best = (1e-9, None)
        for f, cut in enumerate(cuts if left else []):
            for k in range(len(cut)):
                low = [r for r in part if r[0][f] <= k]
                lg, lh = sum(r[1] for r in low), sum(r[2] for r in low)
                gain = worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h)
                if gain > best[0]:
                    best = (gain, (f, k))
        if best[1] is None:
            return ut.RATE * g / (h + ut.SHRINK * ut.UNIT)
        f, k = best[1]
        return (f, k, grow([r for r in part if r[0][f] <= k], left - 1), grow([r for r in part if r[0][f] > k], left - 1))

    for _ in range(rounds):
        part = []
        for bins, n, b in rows:
            p = 1 / (1 + math.exp(-(base + sum(value(t, bins) for t in trees))))
            part.append((bins, round((b - n * p) * ut.UNIT), round(n * p * (1 - p) * ut.UNIT)))
        tree = grow(part, depth)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
    return trees


def as_tuples(tree):
    return (tree.feature, tree.bin, as_tuples(tree.left), as_tuples(tree.right)) if isinstance(tree, ut.Split) else tree


def near(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and near(a[2], b[2]) and near(a[3], b[3])
    return abs(a - b) < 1e-5


def test_parts_and_rules(spark):
    urls = ODD + [r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("url").collect()]
    rows = spark.createDataFrame([(k, u, "own", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, bins long").repartition(3)
    got = {r["page_id"]: r for r in ut.verdicts(rows, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, _ = plain_parts(u)
        rule = plain_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["bins"]) == (host, path, 1), u
        assert got[k]["rule"] == (rule and rule.host + rule.path), u
        assert got[k]["verdict"] == (rule.verdict if rule else "block" if got[k]["score"] > 0.5 else "allow"), u
        assert 0 <= got[k]["score"] <= 1


def test_features(spark):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(ODD)], "k long, url string").withColumns(ut.parts("url"))
    for r in ut.lexical(rows, "url").collect():
        for name, value in plain_features(ODD[r["k"]]).items():
            assert abs(r[name] - value) < 1e-9, (name, ODD[r["k"]])


def test_trees_equal_plain_boosting(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(300):
        bins = tuple(rng.randrange(5) for _ in range(3))
        n, b = rows.get(bins, (0, 0))
        rows[bins] = (n + 1, b + (rng.random() < (0.9 if bins[1] > 2 and bins[0] < 2 else 0.2)))
    rows = [(list(k), n, b) for k, (n, b) in rows.items()]
    cuts = [[0.5, 1.5, 2.5, 3.5]] * 3
    sample = stage(spark.createDataFrame(rows, "bins array<int>, n long, b long").coalesce(1), "bins").coalesce(1)
    got = [as_tuples(t) for t in ut.boosted(sample, cuts, -0.5, 4, 3)]
    want = plain_boosted(rows, cuts, -0.5, 4, 3)
    assert len(got) == len(want) == 4 and all(near(a, b) for a, b in zip(got, want))


def test_held_out_accuracy(spark):
    """Blocked URLs are long, with digits and parameters, or end in .bad; labels of other hosts stay unseen."""
    rng = random.Random(5)

    def made(k):
        blocked = rng.random() < 0.4
        host = "".join(rng.choice("abcdefghij") for _ in range(6)) + (rng.choice([".bad", ".com"]) if blocked else rng.choice([".com", ".org"]))
        path = "/".join("x" * rng.randrange(2, 6) for _ in range(rng.randrange(1, 4)))
        if blocked and host.endswith(".com"):
            path += "".join(rng.choice("0123456789") for _ in range(15)) + "?a=1&b=2&c=3"
        return f"http://{host}/{path}", blocked

    rows = [made(k) for k in range(1500)]
    model = ut.learn(spark.createDataFrame(rows[:1000], "url string, blocked boolean"))
    assert model.trees
    got = ut.judge(spark.createDataFrame(rows[1000:], "url string, blocked boolean"), model, []).collect()
    right = sum((r["verdict"] == "block") == r["blocked"] for r in got)
    assert right >= 0.95 * len(got)


def test_few_labels(spark):
    """No label, one label only, null labels, an empty table, repeated rows."""
    for rows in ([], [("http://a.b/", True)], [("http://a.b/", None)], [(None, False), (None, False)]):
        model = ut.learn(spark.createDataFrame(rows, "url string, blocked boolean"))
        assert model.trees == []
        got = ut.judge(spark.createDataFrame([("http://a.b/",), ("http://a.b/",), (None,)], "url string"), model, queries.URL_RULES).collect()
        assert len(got) == 3 and all(r["rule"] is None and 0 < r["score"] < 1 for r in got)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert ut.verdicts(empty, queries.URL_RULES).collect() == []


def test_a_hot_url_counts_once(spark):
    """Copies of one URL do not push others out of the sample, nor weigh in the statistics."""
    rows = [("http://hot.net/", True)] * 500 + [(f"http://h{k}.net/{k}", False) for k in range(50)]
    model = ut.learn(spark.createDataFrame(rows, "url string, blocked boolean"), sample_urls=40)
    assert [tuple(r) for r in model.suffixes.collect()] == [("net", 51, 1)]


def test_native(spark):
    plan = queries.QUERIES["op13_url_trees"](spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|RDD", plan)
    read = plan[plan.index("Physical Plan") :]
    assert "html" not in read and F is not None
