"""Operator 10: toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: look-alike letters of other scripts, accents, full-width forms, invisible
characters, and digits or signs written for letters. Lexicon entries are word beginnings whose
weight is their log odds in toxic against other labelled documents. Hits inside an exception phrase
(a word pair that is common around hits in documents labelled clean) do not count. A logistic
function of the summed weights, as they are and per length, gives the score.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import map_texts
from tastemill.session import stage

#: Bound of the labelled documents that the lexicon and the weights are fitted on.
SAMPLE_ROWS = 8000
#: Lengths of word beginnings; least number and share of toxic documents, and least log odds, of an entry.
LENGTHS = (3, 10)
LEAST_DOCS, LEAST_SHARE = 5, 0.01
LEAST_ODDS = 2.0
#: A beginning gives way to a longer one that has this share of its documents.
SAME_SHARE = 0.95
LEXICON_ROWS = 4000
EXCEPTION_ROWS = 4000
#: A longer beginning is kept beside a shorter one only with this much more log odds.
GAIN = 1.0

# Letters of other scripts, digits and signs that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
    "у": "y", "х": "x", "ԝ": "w", "г": "r", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i", "ɡ": "g",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
}
#: Letters that the same sign stands for, written as one.
MERGED = {"l": "i"}


def folded(char: str) -> str:
    """One character as folded letters; a space for what separates words, nothing if invisible."""
    out = []
    for c in unicodedata.normalize("NFKD", char.lower()):
        c = LOOK_ALIKES.get(c, c)
        kind = unicodedata.category(c[0])
        if kind in ("Mn", "Me", "Cf"):
            continue
        out.append("".join(MERGED.get(x, x) for x in c) if kind[0] == "L" else " ")
    return "".join(out)


class Folding(dict):
    """Table for str.translate that learns characters as they come."""

    def __missing__(self, code: int) -> str:
        self[code] = out = folded(chr(code))
        return out


def fold(text: str, table: Folding) -> str:
    """Folded words with one space around each; words are runs of letters, digits and signs."""
    return f" {' '.join(text.translate(table).split())} "


def automaton(entries: dict[str, float]) -> ahocorasick.Automaton | None:
    if not entries:
        return None
    own = ahocorasick.Automaton()
    for k, w in entries.items():
        own.add_word(k, (len(k), w))
    own.make_automaton()
    return own


def hits(text: str, lexicon, exceptions) -> dict[int, float]:
    """Largest weight of the entries at each word start, without those that an exception covers."""
    found: dict[int, float] = {}
    if lexicon is None:
        return found
    for end, (size, weight) in lexicon.iter(text):
        at = end - size + 1
        if weight > found.get(at, -1.0):
            found[at] = weight
    if found and exceptions is not None:
        for end, (size, _) in exceptions.iter(text):
            # an exception is a pair of words with its spaces: hits start at either word's space
            first = end - size + 1
            for at in (first, text.index(" ", first + 1)):
                found.pop(at, None)
    return found


def measures(text: str, found: dict[int, float]) -> tuple[float, float]:
    """Summed weight, and summed weight per hundred words."""
    total = sum(found.values())
    return np.log1p(total), np.log1p(100 * total / (text.count(" ") + 19))


def _per_task(df: DataFrame, count, schema: str) -> DataFrame:
    """Rows of a Counter that ``count`` fills from (text, label) pairs, one set of rows per task."""

    def run(batches):
        seen: Counter = Counter()
        table = Folding()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen.update((key, label) for key in count(fold(text or "", table)))
        if seen:
            keys, labels, n = zip(*((k, y, n) for (k, y), n in seen.items()))
            for a in range(0, len(keys), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(labels[part], pa.int32()), pa.array(n[part], pa.int64())], names=["key", "label", "n"])

    found = df.mapInArrow(run, schema)
    return found.groupBy("key").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good")
    )


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text`` and ``label`` of at most ``rows`` labelled documents, by a hash of the id; equal texts once."""
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy(F.xxhash64("text").alias("h")).agg(F.max(F.struct("label", "text")).alias("r")).select("r.text", "r.label")


class Model:
    def __init__(self, lexicon: dict[str, float], exceptions: dict[str, float], weights: list[float]):
        self.lexicon, self.exceptions, self.weights = lexicon, exceptions, weights


def _prune(rows: list[tuple[str, float, int]]) -> dict[str, float]:
    """Entries (beginning, weight, documents) as long as they stay as frequent, without lesser longer ones."""
    longer: dict[str, int] = {}
    for entry, _, docs in rows:
        longer[entry[:-1]] = max(docs, longer.get(entry[:-1], 0))
    kept: dict[str, float] = {}
    for entry, weight, docs in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if longer.get(entry, 0) < SAME_SHARE * docs and all(weight > kept.get(entry[:k], -np.inf) + GAIN for k in range(1, len(entry))):
            kept[entry] = weight
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> list[float]:
    """Weights (the first is the constant) by Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon, exceptions and weights from at most ``rows`` labelled documents.

    Documents without an id or label teach nothing; repeated labels of an id count as toxic if one
    of them is. Without toxic and clean examples the model scores every text 0.
    """
    rows = stage(sample(docs, labels, rows), "toxicity-sample").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return Model({}, {}, [])
    low, high = LENGTHS

    def beginnings(text):
        return {f" {w[:k]}" for w in set(text.split()) for k in range(low, min(high, len(w)) + 1)}

    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    found = _per_task(rows, beginnings, "key string, label int, n long")
    entries = found.where(F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * bad)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    best = entries.orderBy(F.desc("odds"), "key").limit(LEXICON_ROWS).collect()
    lexicon = _prune([(r["key"], r["odds"], r["bad"]) for r in best])

    def pairs(text):
        own = automaton(lexicon) if not hasattr(pairs, "own") else pairs.own
        pairs.own = own
        out = set()
        for at in hits(text, own, None):
            end = text.index(" ", at + 1)
            after, before = text.find(" ", end + 1), text.rfind(" ", 0, at) if at else -1
            out |= {text[at : after + 1]} if after > 0 else set()
            out |= {text[before : end + 1]} if before >= 0 else set()
        return out

    around = _per_task(rows, pairs, "key string, label int, n long").where((F.col("good") >= 3) & (F.col("bad") * good < F.col("good") * bad))
    exceptions = {r["key"]: 0.0 for r in around.orderBy(F.desc("good"), "key").limit(EXCEPTION_ROWS).collect()}
    found = score(rows, Model(lexicon, exceptions, []), carry=["label"]).select("label", "total", "rate").collect()  # bounded by the sample
    x, y = np.array([[r["total"], r["rate"]] for r in found]), np.array([r["label"] for r in found])
    return Model(lexicon, exceptions, _logistic(x, y))


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``hits``, ``total``, ``rate`` and ``score`` (0 to 1) to each document.

    Null and empty texts have no hits; their score is the model's lowest. Repeated rows score alike
    and an empty table stays empty. An input column named like an output gives way to it. The
    lexicon and the exceptions have a fixed largest size, so each task gets them whole.
    """
    weights = np.array(model.weights or [-np.inf, 0.0, 0.0])

    def work():
        lexicon, exceptions, table = automaton(model.lexicon), automaton(model.exceptions), Folding()

        def step(batch):
            n, x = [], []
            for value in batch.column(text).to_pylist():
                own = fold(value or "", table)
                found = hits(own, lexicon, exceptions)
                n.append(len(found))
                x.append(measures(own, found))
            x = np.array(x).reshape(-1, 2)
            return {"hits": n, "total": x[:, 0], "rate": x[:, 1], "score": 1 / (1 + np.exp(-(weights[0] + x @ weights[1:])))}

        return step

    return map_texts(docs, work, "hits long, total double, rate double, score double", text, carry)
