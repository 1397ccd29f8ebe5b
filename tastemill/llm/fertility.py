"""Operator 4: quality rules from tokeniser fertility, over counts of words, lines and symbols.

Public vocabularies measure each text: characters per token, the share of byte-fallback tokens
(tokens that are not whole characters) and the entropy of the tokens. Each language (where it is
unknown: each script) has a band for each measure and text length, from the quartiles of its own
distinct texts; a document outside a band is rejected.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tastemill.llm.bpe import encoding, pieces
from tastemill.llm.common import WHITE, map_texts, raw, row_sums, run_hashes, window_hashes, words
from tastemill.session import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: The vocabulary for plain texts, and the one for texts with many characters beyond ASCII.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Share of bytes beyond ASCII from which the second vocabulary measures.
PLAIN_SHARE = 0.02
#: Quartile distances that a band reaches below and above the quartiles, and the least such distance.
#: A text of unusually varied tokens is less suspicious than one that repeats itself.
REACH = {"chars_per_token": (3.0, 3.0), "byte_share": (3.0, 3.0), "entropy_gap": (6.0, 3.0)}
FLOORS = {"chars_per_token": 0.03, "byte_share": 0.02, "entropy_gap": 0.12}
#: Lengths of fewer documents use the band of the whole group, such groups the band of all.
LEAST_ROWS = 50
#: Bands are judged on texts of this many tokens at least; shorter ones have no stable measure.
LEAST_TOKENS = 40
#: First code points of scripts beyond Latin, by their UTF-8 lead bytes (fixed values).
SCRIPTS = {"greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD3), "semitic": (0xD6, 0xDB), "indic": (0xE0, 0xE0), "asian": (0xE3, 0xED)}

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MEASURES = "n_tokens long, chars_per_token double, byte_share double, entropy_gap double, vocabulary int, script string"


def repeated(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: does its group hold it twice or more, and is there an earlier one."""
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    twice, later = np.zeros(len(v), bool), np.zeros(len(v), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    inside = ~WHITE[data]
    starts, ends, first = words(data, offsets, inside)
    counts = np.diff(first)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # lines with a word
    begin, end, line_first = words(data, offsets, data != 0x0A)
    has = np.searchsorted(starts, begin) < np.searchsorted(starts, end)
    begin, end = begin[has], end[has]
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    _, again = repeated(run_hashes(data, begin, end), line_row)
    # windows of words that lie in one row
    windows = window_hashes(run_hashes(data, starts, ends), WINDOW)
    row = np.repeat(np.arange(rows), counts)
    at = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    twice, _ = repeated(windows[at], row[at])
    cover = np.zeros(len(starts) + 1, np.int64)
    hit = at[twice]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    return {
        "n_words": counts,
        "word_chars": row_sums(chars[ends] - chars[starts], first),
        "n_symbols": row_sums(symbol[data], offsets),
        "n_dup_lines": np.bincount(line_row[again], minlength=rows),
        "n_repeat_words": row_sums(np.cumsum(cover[:-1]) > 0, first),
    }


def scripts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The script whose lead bytes are most frequent in each row; Latin (and no letter) otherwise."""
    names = ["latin", *SCRIPTS]
    lead = [row_sums((data < 0x80) & (data > 0x40) | (data >= 0xC2) & (data <= 0xC9), offsets)]
    lead += [row_sums((data >= a) & (data <= b), offsets) for a, b in SCRIPTS.values()]
    return [names[k] for k in np.argmax(np.stack(lead), axis=0)]


def fertility(texts: list[str | None], second: np.ndarray, encoders: list) -> dict[str, np.ndarray]:
    """Token measures of each text; ``entropy_gap`` is log2 of the token count less the entropy."""
    ids, sizes = [], np.zeros(len(texts), np.int64)
    for k, value in enumerate(texts):
        own = encoders[int(second[k])][0]
        for piece in pieces(value or ""):
            found = own.encode_ordinary(piece)
            sizes[k] += len(found)
            ids.append(np.array(found, np.int64))
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(texts)), sizes)
    partial = np.where(second[row], encoders[1][1][ids], encoders[0][1][ids])
    pairs, counts = np.unique(row << 20 | ids, return_counts=True)
    n = np.maximum(sizes, 1)
    gap = np.bincount(pairs >> 20, counts * np.log2(counts), minlength=len(texts)) / n
    chars = np.array([len(t or "") for t in texts], np.float64)
    return {"n_tokens": sizes, "chars_per_token": chars / n, "byte_share": row_sums(partial, offsets) / n, "entropy_gap": gap}


def measure(docs: DataFrame, text: str = "text", vocabularies: tuple[str, str] = VOCABULARIES, carry: list[str] | None = None) -> DataFrame:
    """Add the base counts and the token measures of each text (null: no words, no tokens)."""
    files = [public_tokenizers.path(v) for v in vocabularies]

    def work():
        encoders = []
        for f in files:
            own = encoding(f, public_tokenizers.PATTERN)
            partial = np.zeros(own.n_vocab, bool)
            for k in range(own.n_vocab):
                try:
                    own.decode_single_token_bytes(k).decode()
                except UnicodeDecodeError:
                    partial[k] = True
            encoders.append((own, partial))

        def step(batch):
            column = batch.column(text)
            data, offsets = raw(column)
            second = row_sums(data >= 0x80, offsets) > PLAIN_SHARE * np.diff(offsets)
            out = base_counts(data, offsets)
            out |= fertility(column.to_pylist(), second, encoders)
            return out | {"vocabulary": second.astype(np.int32), "script": pa.array(scripts(data, offsets))}

        return step

    return map_texts(docs, work, f"{COUNTS}, {MEASURES}", text, carry)


def group(lang: str | None) -> Column:
    """The language, else the script, with the vocabulary that measured."""
    own = F.col("script") if lang is None else F.coalesce(F.col(f"`{lang}`"), F.col("script"))
    return F.concat_ws("/", own, F.col("vocabulary").cast("string"))


def length() -> Column:
    """Half octaves of the token count: entropy and its spread depend on the length."""
    return F.floor(2 * F.log2(F.col("n_tokens"))).cast("int")


def bands(measured: DataFrame, lang: str | None = "lang", digest: str | None = None) -> DataFrame:
    """``low`` and ``high`` for each group, length and measure.

    Rows with a null length are for all lengths of a group, those with a null group for all
    documents. With the texts' ``digest`` each distinct text counts once in a group, so copies do
    not pull the quartiles to them. Quartiles are exact on values rounded to 1/200, from a count per value, so they do
    not depend on how the rows are dealt out and no task holds the documents of a group.
    """
    texts = [F.col(f"`{digest}`").alias("digest")] if digest else []
    each = measured.where(F.col("n_tokens") >= LEAST_TOKENS).select(group(lang).alias("group"), length().alias("length"), *FLOORS, *texts)
    long = (each.distinct() if digest else each).select(
        "group",
        "length",
        F.explode(F.create_map(*(x for m in FLOORS for x in (F.lit(m), F.col(m))))).alias("measure", "value"),
    )
    counted = long.groupBy("group", "length", "measure", F.round(F.col("value") * 200).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    pooled = counted.groupBy("group", none("int").alias("length"), "measure", "bin").agg(F.sum("n").alias("n"))
    total = counted.groupBy(none("string").alias("group"), none("int").alias("length"), "measure", "bin").agg(F.sum("n").alias("n"))
    one = Window.partitionBy("group", "length", "measure")
    ranked = counted.unionByName(pooled).unionByName(total)
    ranked = ranked.withColumn("upto", F.sum("n").over(one.orderBy("bin"))).withColumn("all", F.sum("n").over(one))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) / 200
    quartiles = ranked.groupBy("group", "length", "measure").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("all").alias("rows"))
    of = lambda values: F.element_at(F.create_map(*(x for m, v in values.items() for x in (F.lit(m), F.lit(v)))), F.col("measure"))
    spread = F.greatest(F.col("q3") - F.col("q1"), of(FLOORS))
    low, high = (of({m: r[side] for m, r in REACH.items()}) for side in (0, 1))
    return quartiles.where(F.col("group").isNull() | (F.col("rows") >= LEAST_ROWS)).select(
        "group", "length", "measure", (F.col("q1") - low * spread).alias("low"), (F.col("q3") + high * spread).alias("high")
    )


def judge(measured: DataFrame, limits: DataFrame, lang: str | None = "lang") -> DataFrame:
    """Add ``base_failed``, ``fertile`` (within all bands) and ``kept``."""
    sides = [(side, m) for side in ("low", "high") for m in FLOORS]

    def wide(part: DataFrame, prefix: str, *keys: str) -> DataFrame:
        return part.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
            *(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{prefix}_{side}_{m}") for side, m in sides)
        )

    known = F.col("group").isNotNull()
    common = {r["measure"]: r for r in limits.where(~known).collect()}  # a row for each measure
    own = wide(limits.where(known & F.col("length").isNotNull()), "_own", "group", "length")
    pooled = wide(limits.where(known & F.col("length").isNull()), "_pooled", "group")
    joined = measured.withColumn("_group", group(lang)).withColumn("_length", length())
    joined = joined.join(own, ["_group", "_length"], "left").join(pooled, "_group", "left")
    inside = F.lit(True)
    for m in FLOORS:
        low, high = (
            F.coalesce(F.col(f"_own_{side}_{m}"), F.col(f"_pooled_{side}_{m}"), F.lit(common[m][side] if m in common else None))
            for side in ("low", "high")
        )
        inside = inside & F.coalesce(F.col(m).between(low, high), F.lit(True))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fertile = (F.col("n_tokens") < LEAST_TOKENS) | inside
    return (
        joined.withColumn("base_failed", failed)
        .withColumn("fertile", fertile)
        .withColumn("kept", ~F.col("base_failed") & F.col("fertile"))
        .drop("_group", "_length", *(f"{prefix}_{side}_{m}" for side, m in sides for prefix in ("_own", "_pooled")))
    )


def verdicts(docs: DataFrame, text: str = "text", lang: str | None = "lang", carry: list[str] | None = None) -> DataFrame:
    """Measure, learn the bands from all distinct texts and judge each document.

    Null texts have no words and fail the base rule; a null language uses the band of the script;
    repeated rows are judged alike; an empty table gives an empty table. Input columns named like
    an output give way to it. If the texts are to be carried they are measured twice, once for the
    bands and once beside the text, rather than stored again.
    """
    keep = list(docs.columns if carry is None else carry)
    need = list(dict.fromkeys([*keep, *([lang] if lang else [])]))
    wide = text in keep
    digest = "_digest"
    while digest in docs.columns:
        digest += "_"
    named = docs.withColumn(digest, F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))))
    measured = stage(measure(named, text, carry=[*([lang] if lang and wide else [] if wide else need), digest]), "fertility")
    limits = stage(bands(measured, lang, digest), "fertility-bands")
    out = judge(measure(docs, text, carry=need) if wide else measured.drop(digest), limits, lang)
    return out.drop(*(c for c in need if c not in keep))
