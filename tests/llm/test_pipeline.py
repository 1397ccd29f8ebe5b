"""The pipeline's stages against plain Python, each on what the stage before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tastemill.llm import bpe, fertility, pii
from tests.llm import brute
from tests.llm.test_contracts import FOLDER, ODD


@pytest.fixture(scope="module", autouse=True)
def short_training():
    """Base spans do not depend on the tagger, so a little training is enough here."""
    was = pii.SAMPLE_WINDOWS, pii.EPOCHS
    pii.SAMPLE_WINDOWS, pii.EPOCHS = 200, 1
    yield
    pii.SAMPLE_WINDOWS, pii.EPOCHS = was


@pytest.fixture(scope="module")
def chain(spark):
    """Input and output rows of each stage, over the small documents with odd rows and other columns."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(-1)).withColumn("spans", F.lit(None).cast("int"))
    out, frames = [], [docs]
    for _, work in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stage(work(spark, frames[-1], FOLDER), "test"))
        out.append(([r.asDict() for r in frames[-2].collect()], [r.asDict() for r in frames[-1].collect()]))
    return docs, frames, out


def texts(rows):
    return sorted((repr((r["doc_id"], r["text"])) for r in rows))


def test_columns_stay(chain):
    docs, frames, out = chain
    assert all(f.columns == docs.columns for f in frames[:-1]) and set(docs.columns) < set(frames[-1].columns)
    assert all(r["kept"] == "mine" and r["n_words"] == -1 and r["spans"] is None for r in out[-1][1])


def test_quality_stage(chain):
    _, frames, out = chain
    before, after = out[0]
    failed = [repr(r[0]) for r in brute.quality([(repr((r["doc_id"], r["text"])), r["text"]) for r in before]) if r[-1]]
    assert not {f.strip("\"") for f in failed} & set(texts(after))
    judged = fertility.verdicts(frames[0].select("doc_id", "text", "lang")).where("NOT base_failed").count()
    assert 0.8 * judged <= len(after) <= judged


def test_near_duplicate_stage(chain):
    before, after = chain[2][1]
    groups = {}
    for r, (_, _, least) in zip(before, brute.jaccard([(r["doc_id"], r["text"]) for r in before], size=5, part=100, whole=80)):
        if r["doc_id"] == least:
            groups[repr((r["doc_id"], r["text"]))] = 1
    assert sorted(groups) == texts(after) and len(after) < len(before)


def test_decontamination_stage(chain, spark):
    before, after = chain[2][2]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute.decontaminate([(r["doc_id"], r["text"]) for r in before], items)
    assert texts(after) == texts([r for r, f in zip(before, found) if not f[-1]])


def test_personal_data_stage(chain):
    before, after = chain[2][3]
    assert sorted(map(repr, (r["doc_id"] for r in before))) == sorted(map(repr, (r["doc_id"] for r in after)))
    assert all(not brute.private(r["text"]) for r in after) and any(brute.private(r["text"]) for r in before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    kept = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        if not any(c.isdigit() or c == "@" for c in r["text"]):
            assert kept[r["doc_id"]] == r["text"]
        spans = pii.base_spans(r["text"])
        if spans:
            assert all(f"<{pii.KINDS[k]}>" in kept[r["doc_id"]] for _, k, _ in spans[:1])


def test_token_stage(chain):
    before, after = chain[2][4]
    want = {d: w for d, *w in brute.bpe([(r["doc_id"], r["text"]) for r in before])}
    assert len(before) == len(after)
    for r in after:
        n, ids, decoded = want[r["doc_id"]]
        assert (r["n_tokens"], brute.sha(bytes(r["ids"])), r["decoded_sha256"]) == (n, ids, decoded)


def test_run(spark):
    df = corpus_pipeline.run(spark, FOLDER)
    assert 0 < df.count() <= 200 and df.where("n_tokens <= 0").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, work in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(work(spark, docs, FOLDER), "test")
        assert docs.count() == 0
    assert bpe.encode(docs, carry=["doc_id"]).count() == 0
