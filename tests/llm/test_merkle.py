"""The manifest and its proofs against plain Python."""

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tastemill.llm import merkle
from tastemill.session import stage

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int, `group` string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def raised(nodes):
    """Levels of one tree, from its leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """(place, others) of each level, from the leaf up."""
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append((at % 16, run[: at % 16] + run[at % 16 + 1 :]))
        at //= 16
    return out


def plain(rows):
    groups = {}
    for doc_id, *rest in rows:
        own = [doc_id, *rest]
        leaf = h("".join(map(field, own)))
        changed = leaf
        if doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0:
            changed = h("".join(map(field, [*own[:4], lowered(own[4])])))
        groups.setdefault(rest[0], []).append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: raised([r[2] for r in sorted(groups[s])]) for s in names}
    top = raised([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, doc_id, changed) in enumerate(sorted(groups[s])):
            steps = path(trees[s], at) + path(top, k)
            up = changed
            for place, others in steps:
                up = h("".join(others[:place]) + up + "".join(others[place:]))
            proof = h("".join("".join(others) for _, others in steps))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, up, up == top[-1][0]))
    return sorted(out, key=repr)


def made(sizes):
    rows, doc_id = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            doc_id += 1
            text = [None, "", f"Text {doc_id} É", "plain é", "X" * 50_000 if doc_id % 97 == 0 else "Ab"][doc_id % 5]
            rows.append((doc_id * 7, source, [None, "en"][doc_id % 2], None if doc_id % 3 == 0 else doc_id, text))
    return rows


CASES = {
    "one row": made({"a": 1}),
    "one source": made({"a": 273}),
    "borders": made({None: 16, "": 17, "a": 1, "Z": 256, "é": 257, "z": 2, "\U0001f600": 33}),
    "many sources": made({f"s{k}": 1 + k % 18 for k in range(40)}),
    "hot source": made({"hot": 1200, "b": 3, "c": 1}),
    "repeats": [*made({"a": 20, None: 3}) * 2, *[(5, "a", "en", 1, "Same")] * 40, (None, "a", None, None, None), (None, None, None, None, "X"), (-35, "a", "x", -1, "NEGATIVE")],
}


@pytest.mark.parametrize("name", CASES)
def test_documents(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, "other", 7, "clash") for r in rows], SCHEMA).repartition(4)
    got = merkle.verdicts(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)


def test_no_rows(spark):
    assert merkle.verdicts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_is_seen(spark):
    rows = plain(CASES["borders"])
    assert any(not r[-1] for r in rows) and any(r[-1] for r in rows)


def test_few_requests_visit_few_records(spark):
    """Requests for three leaves read the records on their paths only."""
    docs = spark.createDataFrame(made({"hot": 600, "b": 20}), SCHEMA.split(", leaf")[0])
    manifest = merkle.build(stage(merkle.documents_leaves(docs), "d"), ["doc_id"])
    asked = stage(manifest.leaves.where("`group` = '=hot' AND rank IN (0, 1, 599)"), "asked")
    empty = F.array().cast(merkle.PATH)
    starts = manifest.groups.where("`group` = '=hot'").select("group", F.col("subroot").alias("digest"), "height", empty.alias("path"))
    runs = merkle.descend(starts, manifest.store, asked).collect()
    assert sorted((r["rank"], len(r["children"])) for r in runs) == [(0, 16), (37, 8)]
    proofs = merkle.prove(manifest, asked).select("leaf", merkle.folded(F.col("leaf")).alias("up")).collect()
    assert len(proofs) == 3 and {r["up"] for r in proofs} == {manifest.root}


def test_equal_subtrees_are_one_record(spark):
    rows = [(1, "a", "en", 1, "same")] * 64
    manifest = merkle.build(stage(merkle.documents_leaves(spark.createDataFrame(rows, SCHEMA.split(", leaf")[0])), "d"), ["doc_id"])
    assert [level.count() for level in manifest.store] == [1, 1]
