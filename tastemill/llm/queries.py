"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.llm import bond, bpe, decontaminate, fertility, jaccard, langid, merkle, pii, pitman_yor, repeats, sharding, toxicity, url_trees
from tastemill.llm.common import remainder, table
from tastemill.session import TEXT_SETTINGS, tune


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(tune(spark, TEXT_SETTINGS), folder, "documents").select(*columns)


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder, "doc_id", "text"))


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.verdicts(documents(spark, folder, "doc_id", "text"))


def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    docs = documents(spark, folder, "doc_id", "text", "lang").select("*", held)
    model = langid.learn(docs.where(~F.col("held_out")))
    found = langid.predict(docs, model, carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.verdicts(documents(spark, folder, "doc_id", "text", "lang"), carry=["doc_id"])


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = table(spark, folder, "benchmark").select("item_id", "text")
    return decontaminate.verdicts(documents(spark, folder, "doc_id", "text"), benchmark)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.verdicts(documents(spark, folder, "doc_id", "text"))


def op7_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.verdicts(documents(spark, folder, "doc_id", "text"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.by_text(documents(spark, folder, "doc_id", "text"))


def op9_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(documents(spark, folder, "doc_id", "text"), rule=jaccard.JOIN)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    docs = documents(spark, folder, "doc_id", "text").select("*", held)
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    found = toxicity.score(docs, toxicity.learn(docs, labels), carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verdicts(documents(spark, folder, *merkle.FIELDS))


def op12_bond(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(tune(spark, TEXT_SETTINGS), folder, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


URL_RULES = [
    url_trees.Rule("allow", "org", "/"),
    url_trees.Rule("block", "example.org", "/es/"),
    url_trees.Rule("block", "example.org", "/en/1"),
    url_trees.Rule("allow", "com", "/fr/"),
    url_trees.Rule("block", "com", "/de/"),
]


def op13_url_trees(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(tune(spark, TEXT_SETTINGS), folder, "pages").select("page_id", "url")
    return url_trees.verdicts(pages, URL_RULES, carry=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_repeats": op2_repeats,
    "op3_langid": op3_langid,
    "op4_fertility": op4_fertility,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_sharding": op8_sharding,
    "op9_jaccard": op9_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_bond": op12_bond,
    "op13_url_trees": op13_url_trees,
}
UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

REPEATS_SQL = """
with d as (select row_number() over () r, doc_id, coalesce(doc_id, 9223372036854775807) doc, hex(encode(coalesce(text, ''))) h from documents),
w as (select r, doc, i, substr(h, 2 * i - 1, 100) s from (select *, unnest(range(1, len(h) // 2 - 48)) i from d)),
least_doc as (select s, min(doc) m from w group by 1 having count(*) > 1),
hit as (select r, i, lag(i) over (partition by r order by i) before, lead(i) over (partition by r order by i) after
  from w join least_doc using (s) where m < doc),
runs as (select r, i, max(i) over (partition by r, run) + 49 stop, first from (
  select *, sum(first::int) over (partition by r order by i) run from (select *, before is null or i > before + 50 first from hit))),
spans as (select r, i a, stop b from runs where first),
sums as (select r, count(*) n_spans, sum(b - a + 1) n_removed from spans group by 1),
rest as (select r, string_agg(substr(h, 2 * lo - 1, 2 * (hi - lo + 1)), '' order by lo) kept from (
  select d.r, h, coalesce(lag(b) over (partition by d.r order by a), 0) + 1 lo, a - 1 hi from spans join d using (r)
  union all select d.r, h, max(b) + 1, len(h) // 2 from spans join d using (r) group by all) where hi >= lo group by 1)
select doc_id, len(h) // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when n_spans is null then h else coalesce(kept, '') end)) kept_sha256
from d left join sums using (r) left join rest using (r)
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATE_SQL = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{DOWN}'), '{WORDS}') w from documents),
b as (select distinct item_id::varchar i, regexp_extract_all(translate(text, '{UPPER}', '{DOWN}'), '{WORDS}') w from benchmark where text is not null),
p as (select distinct i, least(len(w), 13) n, array_to_string(w[k:k + 12], ' ') s from (select *, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) k from b)),
q as (select r, n, k, array_to_string(w[k:k + n - 1], ' ') s from (select *, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from p) where len(w) >= n)),
found as (select r, q.n, k, i from q join p on p.s = q.s and p.n = q.n),
hits as (select r, count(distinct place) n_hit from (select r, unnest(range(k, k + n)) place from (select distinct r, n, k from found)) group by 1),
items as (select r, count(*) n, string_agg(i, ',' order by i) ids from (select distinct r, i from found where i is not null) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hits using (r) left join items using (r)
"""

JACCARD_SQL = rf"""
with recursive d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{DOWN}'), '[^\x20\x09-\x0D]+') w from documents),
sets as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) end s from d),
e as (select r, unnest(s) x from sets),
met as (select a.r x, b.r y, count(*) n from e a join e b on a.x = b.x and a.r < b.r group by 1, 2),
pairs as (select x, y from met join sets a on a.r = x join sets b on b.r = y where 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
links as (select x, y from pairs union all select y, x from pairs),
reach as (select r, r z from sets union select reach.r, y from reach join links on x = z)
select any_value(a.doc_id) doc_id, any_value(len(a.s))::bigint n_shingles, min(b.doc_id) component_id
from reach join sets a on a.r = reach.r join sets b on b.r = z group by a.r
"""



def merkle_sql(leaf_levels: int = 7, top_levels: int = 5) -> str:
    """Levels of 16 unrolled, enough for 16 ** 7 documents of a source and 16 ** 5 sources."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def leaf(text: str) -> str:
        return f"sha256(concat({', '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"

    def raised(name: str, levels: int) -> str:
        return "".join(
            f"{name}run{k} as (select g, r // 16 r, string_agg(d, '' order by r) s, (n + 15) // 16 n from {name}{k - 1} where n > 1 group by 1, 2, n),\n"
            f"{name}{k} as (select g, r, sha256(s) d, n from {name}run{k}),\n"
            for k in range(1, levels + 1)
        )

    def last(name: str, levels: int) -> str:
        return " union all ".join(f"select g, d from {name}{k} where n = 1" for k in range(levels + 1))

    def folded(name: str, levels: int) -> tuple[str, str, str]:
        joins, siblings, steps = "", [], ""
        for k in range(1, levels + 1):
            at = f"64 * (({name}.r // {16 ** (k - 1)}) % 16)"
            joins += f" left join {name}run{k} {name}_{k} on {name}_{k}.g = {name}.g and {name}_{k}.r = {name}.r // {16 ** k}"
            siblings.append(f"coalesce(left({name}_{k}.s, {at}) || substr({name}_{k}.s, {at} + 65), '')")
            steps += f", {name}_{k}.s {name}s{k}, {at} {name}at{k}"
        return joins, " || ".join(siblings), steps

    leaf_joins, leaf_siblings, leaf_steps = folded("a", leaf_levels)
    top_joins, top_siblings, top_steps = folded("b", top_levels)
    names = [f"a{{}}{k}" for k in range(1, leaf_levels + 1)] + [f"b{{}}{k}" for k in range(1, top_levels + 1)]
    up = "".join(
        f", u{k + 1} as (select * exclude (f), case when {n.format('s')} is null then f else sha256(left({n.format('s')}, {n.format('at')}) || f || substr({n.format('s')}, {n.format('at')} + 65)) end f from u{k})"
        for k, n in enumerate(names)
    )
    return f"""
with crc as (select list(v order by i) t from (select i, list_reduce([i] || range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) z(i))),
docs as (select *, translate(text, '{UPPER}', '{DOWN}') low,
  xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) crc from documents, crc),
leaves as (select doc_id, coalesce('=' || source, '') g, {leaf('text')} d, case when crc % 5 = 0 then {leaf('low')} end changed from docs),
a0 as (select *, row_number() over (partition by g order by doc_id nulls first, d) - 1 r, count(*) over (partition by g) n from leaves),
{raised('a', leaf_levels)}subroots as ({last('a', leaf_levels)}),
b0 as (select '' g, g name, d, row_number() over (order by g) - 1 r, count(*) over () n from subroots),
{raised('b', top_levels)}root as ({last('b', top_levels)}),
upper_tree as (select b.name, b.d subroot, {top_siblings} p{top_steps} from b0 b{top_joins}),
proofs as (select a.doc_id, a.d leaf, coalesce(a.changed, a.d) f, a.g g, {leaf_siblings} p{leaf_steps} from a0 a{leaf_joins}),
u0 as (select proofs.* exclude (p), upper_tree.* exclude (p), proofs.p || upper_tree.p p, root.d root from proofs join upper_tree on proofs.g = name, root){up}
select doc_id, leaf, subroot, root, sha256(p) proof_sha256, f folded_root, f = root verified from u{len(names)}
"""


BOND_SQL = """
with e as (select row_number() over () r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
  list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r ar, a.vec_id anchor_id, a.l = e.l same, e.r, e.vec_id, list_dot_product(a.v, e.v)::bigint score from e a, e where a.vec_id % 50 = 0 and a.r <> e.r),
p as (select * from s where same qualify row_number() over (partition by ar order by score desc, vec_id, r) <= 5),
f as (select p.anchor_id, p.vec_id positive_id, n.vec_id negative_id, p.score positive_score, n.score negative_score,
  row_number() over (partition by p.ar, p.r order by n.score desc, n.vec_id, n.r) k
  from p join s n on n.ar = p.ar and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, k::int "rank", negative_id, positive_score, negative_score from f where k <= 3
"""

#: The others hold trained models, token ids or a partition that SQL cannot state; tests compare them
#: with plain Python.
ORACLES: dict[str, str] = {
    "op2_repeats": REPEATS_SQL,
    "op5_decontaminate": DECONTAMINATE_SQL,
    "op9_jaccard": JACCARD_SQL,
    "op11_merkle": merkle_sql(),
    "op12_bond": BOND_SQL,
}
