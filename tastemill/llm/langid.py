"""Operator 3: language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot is a mask with a bit per language, so
the AND of an n-gram's slots is the set of all languages that contain it. For each language the
popcount of a text's n-grams, corrected for the share of false positives, gives its evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastemill.llm.common import LOWER, map_texts, mix, raw, received, share, steps
from tastemill.session import stage

#: Bytes of an n-gram, least slots of the filter, slots per n-gram, and slots for each n-gram of the
#: language with most: a language's bits then fill at most a quarter.
GRAM = 5
SLOTS = 1 << 21
PROBES = 2
ROOM = 8
#: Least count of an n-gram: 3, fewer in languages of fewer n-grams than this; and its least share of
#: all n-grams of its language, so that at most 1 / LEAST_RATE of them count.
LEAST_COUNT, SMALL = 3, 100_000
LEAST_RATE = 4e-7
#: Least frequency of an n-gram against the language that uses it most.
LEAST_SHARE = 0.1
#: Languages that a filter can hold, 64 for each mask word.
MOST_LANGUAGES = 1024
UNKNOWN = "und"

#: Bytes that can belong to letters: ASCII letters and all bytes beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True


def grams(data: np.ndarray, offsets: np.ndarray, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """n-grams as integers, and the row of each: lower-case bytes, one space for what is no letter.

    Two spaces stand before each row and some after it, so that the shortest word has n-grams; an
    n-gram never spans two rows, and one of spaces alone is left out.
    """
    rows = len(offsets) - 1
    letter = LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[firsts] = letter[firsts]  # which does not reach into the next row
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    counts = kept[offsets[1:]] - kept[offsets[:-1]]
    sizes = counts + size
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = int(begin[-1])
    text = np.full(n + size, 0x20, np.uint8)
    text[np.repeat(begin[:-1] + 2 - kept[offsets[:-1]], counts) + np.arange(kept[-1])] = np.where(letter, LOWER[data], 0x20)[keep]
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = code << np.uint64(8) | text[k : n + k]
    inside = code != np.uint64(int.from_bytes(b" " * size, "big"))
    for k in range(size - 1):  # the last places of a row begin n-grams that would leave it
        inside[begin[1:] - 1 - k] = False
    return code[inside], np.repeat(np.arange(rows), sizes)[inside]


def slots(codes: np.ndarray, size: int, probes: int) -> list[np.ndarray]:
    first, second = mix(codes), mix(codes ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return [((first + np.uint64(k) * second) & np.uint64(size - 1)).astype(np.int64) for k in range(probes)]


class Filter:
    """Masks of all slots (slot, word of 64 languages), the languages and the share of set bits."""

    def __init__(self, languages: list[str], masks: np.ndarray, probes: int, size: int, common: str | None):
        self.languages, self.masks, self.probes, self.size, self.common = languages, masks, probes, size, common
        fill = [np.count_nonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / len(masks) for k in range(len(languages))]
        self.wrong = np.array(fill) ** probes

    def containing(self, codes: np.ndarray) -> np.ndarray:
        """Mask of all languages that contain each n-gram."""
        at = slots(codes, len(self.masks), self.probes)
        found = self.masks[at[0]]
        for more in at[1:]:
            found &= self.masks[more]
        return found


def gram_counts(train: DataFrame, size: int) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows; each task sums its own rows first."""

    def run(batches):
        held: dict[str, list] = {}
        waiting = 0

        def flush():
            for lang, parts in held.items():
                codes = np.concatenate([c for c, _ in parts])
                order = np.argsort(codes, kind="stable")
                codes, n = codes[order], np.concatenate([n for _, n in parts])[order]
                first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                total = np.add.reduceat(n, first)
                for a in range(0, len(first), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(first[part])), pa.array(codes[first[part]].astype(np.int64)), pa.array(total[part])], names=["lang", "gram", "n"]
                    )
            held.clear()

        for batch in batches:
            for part in steps(batch, "text"):
                column = np.array(part.column("lang").to_pylist(), object)
                code, row = grams(*raw(part.column("text")), size)
                own = column[row]
                for lang in dict.fromkeys(column.tolist()):
                    found = np.unique(code[own == lang], return_counts=True)
                    if len(found[0]):
                        held.setdefault(lang, []).append(found)
                        waiting += len(found[0])
                if waiting > 1 << 21:
                    yield from flush()
                    waiting = 0
        yield from flush()

    return train.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def least_count(total: int) -> float:
    """Least count of an n-gram that tells of a language with ``total`` n-grams."""
    return float(max(1, min(LEAST_COUNT, LEAST_COUNT * total / SMALL), LEAST_RATE * total))


def learn(train: DataFrame, size: int = GRAM, slot_count: int = SLOTS, probes: int = PROBES) -> Filter:
    """Filter from all rows of ``train`` (``text``, ``lang``; rows with a null in either teach nothing).

    Each n-gram that is frequent enough in a language, also against the language that uses it most,
    sets that language's bit in its slots. Counting and the choice are Spark's; the driver receives
    the filter's slots: at least ``slot_count``, more if a language has many n-grams, bounded by
    ROOM / LEAST_RATE. All languages are learned; more than MOST_LANGUAGES are an error.
    """
    train = train.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counted = stage(gram_counts(train, size), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = {r["lang"]: r["n"] for r in totals}
    languages = sorted(sizes)
    words = max(1, (len(languages) + 63) // 64)
    if languages:
        spark = train.sparkSession
        known = [(x, k, float(sizes[x]), least_count(sizes[x])) for k, x in enumerate(languages)]
        known = spark.createDataFrame(known, "lang string, place int, total double, least double")
        rated = counted.join(F.broadcast(known), "lang").where(F.col("n") >= F.col("least"))
        rated = rated.withColumn("rate", F.col("n") / F.col("total"))
        most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
        uses = rated.join(most, "gram").where(F.col("rate") >= LEAST_SHARE * F.col("most"))
        uses = stage(uses.select("gram", "place"), "grams-used")
        largest = uses.groupBy("place").count().agg(F.max("count")).first()[0] or 1
        slot_count = max(slot_count, 1 << (ROOM * largest - 1).bit_length())
        bit = F.expr("shiftleft(1L, cast(pmod(place, 64) AS int))")
        own = lambda w: F.bit_or(F.when(F.floor(F.col("place") / 64) == w, bit).otherwise(F.lit(0).cast("long")))
        masked = uses.groupBy("gram").agg(*(own(w).alias(f"w{w}") for w in range(words)))

        def spread(batches):
            for batch in batches:
                codes = batch.column("gram").to_numpy().astype(np.uint64)
                for at in slots(codes, slot_count, probes):
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(batch.column(f"w{w}") for w in range(words))], names=["slot", *(f"w{w}" for w in range(words))])

        names = [f"w{w}" for w in range(words)]
        bits = masked.mapInArrow(spread, "slot long, " + ", ".join(f"{n} long" for n in names)).groupBy("slot").agg(*(F.bit_or(n).alias(n) for n in names))
        found = bits.toArrow()  # a row per slot at most
        masks = np.zeros((slot_count, words), np.uint64)
        for w, n in enumerate(names):
            masks[found.column("slot").to_numpy(), w] = found.column(n).to_numpy().astype(np.int64).view(np.uint64)
    else:
        masks = np.zeros((slot_count, words), np.uint64)
    common = max(languages, key=lambda x: (sizes[x], x)) if languages else None
    return Filter(languages, masks, probes, size, common)


def predict(docs: DataFrame, model: Filter, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``n_grams`` to each document.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Equal
    evidence goes to the first language by name; a text without any known n-gram gets the language
    with the most training text, with score 0. Whole texts count, however long; a row's prediction
    depends on its text alone.
    """
    shared = share(docs.sparkSession, model)  # slots and languages are bounded

    def work():
        own: Filter = received(shared)
        names = np.array([*own.languages, own.common or UNKNOWN, UNKNOWN], object)
        some = len(own.languages)

        def step(batch):
            column = batch.column(text)
            data, offsets = raw(column)
            rows = batch.num_rows
            code, row = grams(data, offsets, own.size)
            found = own.containing(code)
            n = np.bincount(row, minlength=rows)
            share = np.zeros((rows, some))
            for k in range(some):
                bit = (found[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.float64)
                share[:, k] = np.bincount(row, bit, minlength=rows) / np.maximum(n, 1)
            share = np.clip((share - own.wrong) / np.maximum(1 - own.wrong, 1e-9), 0, 1) if some else share
            best = np.argmax(share, axis=1) if some else np.zeros(rows, np.int64)
            top = share[np.arange(rows), best] if some else np.zeros(rows)
            best = np.where(top > 0, best, some)
            ascii_letter = np.zeros(len(data) + 1, np.int64)
            np.cumsum(LETTER[data] & (data < 0x80), out=ascii_letter[1:])
            plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for r in np.flatnonzero(~plain):
                if not any(c.isalpha() for c in column[int(r)].as_py() or ""):
                    best[r], top[r] = some + 1, 0.0
            return {"lang_pred": pa.array(names[best].tolist(), pa.string()), "score": top, "n_grams": n}

        return step

    return map_texts(docs, work, "lang_pred string, score double, n_grams long", text, carry)
