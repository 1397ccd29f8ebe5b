"""Reference SQL per query, put together from shared common table expressions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def sql(body: str, recursive: bool = False) -> str:
    """Prefix the expressions a statement needs, each once and in order of definition."""
    wanted, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(CTES[name])
    parts = [f"{name} as materialized (\n{CTES[name]}\n)" for name in CTES if name in wanted]
    if not parts:
        return body.strip()
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def rounded(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# --- ratings ------------------------------------------------------------------------------

cte("order_ratings", """
select o_custkey user_id, l_partkey item_id, cast(ceil(max(l_quantity) / 10) as double) rating,
       cast(floor(epoch(max(o_orderdate))) as bigint) ts
from orders join lineitem on o_orderkey = l_orderkey group by 1, 2
""")  # fmt: skip
cte("event_ratings", """
select user_id, cast(json_extract(props, '$.k') as bigint) item_id, max(value) rating,
       max(cast(floor(epoch(ts)) as bigint)) ts
from events group by 1, 2
""")  # fmt: skip
cte("brand_lines", """
select l_orderkey, l_quantity, cast(substr(p_brand, 7) as bigint) item_id
from lineitem join part on l_partkey = p_partkey
""")  # fmt: skip
cte("brand_ratings", """
select o_custkey user_id, item_id, cast(ceil(max(l_quantity) / 10) as double) rating,
       cast(floor(epoch(max(o_orderdate))) as bigint) ts
from brand_lines join orders on o_orderkey = l_orderkey group by 1, 2
""")  # fmt: skip
for _set in ("order", "event", "brand"):
    cte(f"{_set}_cut", f"select user_id, quantile_cont(cast(ts as double), 0.8) cut from {_set}_ratings group by 1")
    cte(f"{_set}_old", f"select r.* from {_set}_ratings r join {_set}_cut using (user_id) where ts <= cut")
    cte(f"{_set}_new", f"select r.* from {_set}_ratings r join {_set}_cut using (user_id) where ts >= cut")
    cte(f"{_set}_means", f"select user_id, avg(rating) user_mean from {_set}_old group by 1")
    cte(
        f"{_set}_centred",
        f"select o.*, user_mean, round(rating - user_mean, 9) centred from {_set}_old o join {_set}_means using (user_id)",
    )
    cte(f"{_set}_recent", f"""
select user_id, item_id from {_set}_old join
  (select user_id, quantile_cont(cast(ts as double), 0.8) c from {_set}_old group by 1) using (user_id)
where ts > c
""")  # fmt: skip

# --- features -----------------------------------------------------------------------------

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
FLAGS = "[" + ", ".join(f"case when p_type = '{t}' then 1.0::double else 0.0::double end" for t in TYPES) + "]"
SEGMENT_CODE = "case c_mktsegment " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEGMENTS)) + " end"
UNIT = "case when len2 > 0 then list_transform(raw, lambda x: x / sqrt(len2)) else list_transform(raw, lambda x: 0.0::double) end"


def impute(prefix: str, group: str) -> None:
    cte(f"{prefix}_known", f"""
select p_partkey item_id, {group} grp, cast(embedding as double[]) tags
from part left join embeddings on vec_id = p_partkey
""")  # fmt: skip
    cte(f"{prefix}_cells", f"select item_id, grp, unnest(tags) x, unnest(range(0, len(tags))) tag_id from {prefix}_known where tags is not null")
    cte(f"{prefix}_group_mean", f"select grp, tag_id, avg(x) x from {prefix}_cells group by 1, 2")
    cte(f"{prefix}_mean", f"select tag_id, avg(x) x from {prefix}_cells group by 1")
    cte(f"{prefix}_imputed", f"""
select item_id, tag_id, x from {prefix}_cells
union all
select k.item_id, m.tag_id, coalesce(g.x, m.x) from {prefix}_known k cross join {prefix}_mean m
left join {prefix}_group_mean g on g.grp = k.grp and g.tag_id = m.tag_id where k.tags is null
""")  # fmt: skip


impute("typed", "p_type")
impute("fine", "p_type || '/' || p_size")
impute("nested", "p_type || case when p_size > 40 then '/' || p_size else '' end")
cte("item_raw", f"""
select item_id, list_concat(any_value({FLAGS}), list(x order by tag_id)) raw
from typed_imputed join part on p_partkey = item_id group by 1
""")  # fmt: skip
cte("item_len", "select *, list_inner_product(raw, raw) len2 from item_raw")
cte("item_vec", f"select item_id, {UNIT} vec from item_len")
cte("user_raw", f"""
select c_custkey user_id, [({SEGMENT_CODE})::double,
  (c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()),
  (c_nationkey - min(c_nationkey) over ()) / (max(c_nationkey) over () - min(c_nationkey) over ())::double] raw
from customer
""")  # fmt: skip
cte("user_len", "select *, list_inner_product(raw, raw) len2 from user_raw")
cte("user_vec", f"select user_id, {UNIT} vec from user_len")

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
cte("topic_means", """
select cast(json_extract(props, '$.k') as bigint) item_id, event_type, avg(value) - (select avg(value) from events) m
from events group by 1, 2
""")  # fmt: skip
cte("topic_raw", "select item_id, [" + ", ".join(f"coalesce(max(case when event_type = '{t}' then m end), 0.0)" for t in EVENT_TYPES) + "] raw from topic_means group by 1")
cte("topic_len", "select *, list_inner_product(raw, raw) len2 from topic_raw")
cte("topic_vec", f"select item_id, {UNIT} vec from topic_len")
cte("tag_len", "select vec_id item_id, cast(embedding as double[]) raw, list_inner_product(raw, raw) len2 from embeddings where vec_id in (select p_partkey from part)")
cte("tag_vec", f"select item_id, {UNIT} vec from tag_len")

# --- baskets ------------------------------------------------------------------------------

cte("gaps", """
select *, case when ts - lag(ts) over (partition by user_id order by ts, item_id) <= 25 * 86400 then 0 else 1 end brk
from order_old
""")  # fmt: skip
cte("gap_numbered", """
select user_id, item_id, sum(brk) over (partition by user_id order by ts, item_id rows unbounded preceding) basket_no
from gaps
""")  # fmt: skip
cte("gap_baskets", """
select * from (select user_id, cast(basket_no as bigint) basket_no, item_id,
  count(*) over (partition by user_id, basket_no) basket_size from gap_numbered) where basket_size > 1
""")  # fmt: skip
SHIFT_SECONDS = 25 * 86400


def mean_shift(prefix: str, old: str) -> None:
    """Mean-shift baskets: seeds move to the mean around them until they rest, the strongest centres stay."""
    cte(f"{prefix}_points", f"select * from (select *, count(*) over (partition by user_id) of_user from {old}) where of_user > 1")
    cte(f"{prefix}_moves", f"""
select distinct user_id, ts::double seed, ts::double centre, 0::bigint held, 0 step, false rest from {prefix}_points
union all
select user_id, seed, mean, n, step + 1, abs(mean - centre) < {SHIFT_SECONDS * 1e-3} or step >= 300 from (
  select m.user_id, seed, centre, step, min(p.ts) + sum(p.ts - (select min(ts) from {prefix}_points))::double / count(*)
    - (min(p.ts) - (select min(ts) from {prefix}_points)) mean, count(*) n
  from {prefix}_moves m join {prefix}_points p on p.user_id = m.user_id and abs(p.ts - centre) <= {SHIFT_SECONDS}
  where not rest group by all)
""")  # fmt: skip
    cte(f"{prefix}_centres", f"""
select user_id, list({{'w': held, 'c': centre}} order by held desc, centre desc) open
from (select distinct user_id, held, centre from {prefix}_moves where rest) group by 1
""")  # fmt: skip
    cte(f"{prefix}_kept", f"""
select user_id, []::double[] kept, open from {prefix}_centres
union all
select user_id, list_append(kept, open[1].c), list_filter(open, lambda x: abs(x.c - open[1].c) > {SHIFT_SECONDS})
from {prefix}_kept where len(open) > 0
""")  # fmt: skip
    cte(f"{prefix}_labels", f"""
select user_id, item_id, nth basket_no from (
  select p.user_id, item_id, nth, row_number() over (partition by p.user_id, item_id order by round(abs(ts - middle), 3), nth) place
  from {prefix}_points p join (select user_id, unnest(kept) middle, unnest(range(1, len(kept) + 1)) nth from {prefix}_kept where len(open) = 0)
  using (user_id)) where place = 1
""")  # fmt: skip
    cte(f"{prefix}_baskets", f"""
select * from (select user_id, cast(basket_no as bigint) basket_no, item_id,
  count(*) over (partition by user_id, basket_no) basket_size from {prefix}_labels) where basket_size > 1
""")  # fmt: skip


mean_shift("shift", "order_old")
mean_shift("brand_shift", "brand_old")
cte("raters", "select item_id, count(rating) raters from order_old group by 1")
for _prefix, _source in (("", "gap"), ("shift_", "shift")):
    cte(f"{_prefix}co", f"""
select a.item_id i, b.item_id j, count(*) n from {_source}_baskets a join {_source}_baskets b
on a.user_id = b.user_id and a.basket_no = b.basket_no and a.item_id < b.item_id group by 1, 2
""")  # fmt: skip
    cte(f"{_prefix}buy", f"""
select i, j, n / sqrt(a.raters * b.raters) w from {_prefix}co join raters a on a.item_id = i join raters b on b.item_id = j
""")  # fmt: skip
    cte(f"{_prefix}buy_both", f"select i, j, w from {_prefix}buy union all select j, i, w from {_prefix}buy")


def top(source: str, n: int = 10, user: str = "user_id", item: str = "item_id") -> str:
    """Top-N lists from (user, item, score) rows."""
    return f"""
select {user}, cast(rank as integer) rank, {item}, round(score, 6) + 0.0 score from (
  select {user}, {item}, score, row_number() over (partition by {user} order by score::float desc, {item}) rank
  from ({source})) where rank <= {n}"""


def settled(total: str) -> str:
    """A sum of terms of both signs without rounding noise around 0."""
    return f"case when abs({total}) < 1e-12 then 0.0 else {total} end"


# --- lists --------------------------------------------------------------------------------

cte("hot", """
select p_partkey item_id, coalesce(s, 0.0) score from part
left join (select item_id, sum(rating) s from order_old group by 1) on item_id = p_partkey
""")  # fmt: skip
cte("hot_lists", top("select c_custkey user_id, item_id, score from customer cross join (select * from hot order by score desc, item_id limit 10)"))
cte("item_order", "select p_partkey item_id, row_number() over (order by md5(p_partkey::varchar), p_partkey) - 1 pos from part")
cte("draws", """
select c_custkey user_id, greatest((select count(*) from part) - 10, 0) j, []::bigint[] taken from customer
union all
select user_id, j + 1, list_append(taken, case when list_contains(taken, t) then j else t end) from (
  select *, ('0x' || substr(md5(user_id || '-' || j || '-0'), 1, 15))::bigint % (j + 1) t
  from draws where j < (select count(*) from part))
""")  # fmt: skip
cte("random_lists", """
select user_id, cast(nth as integer) rank, item_id, 0.0::double score from (
  select user_id, unnest(taken) pos, unnest(range(1, len(taken) + 1)) nth from draws
  where j = (select count(*) from part)) join item_order using (pos)
""")  # fmt: skip
for _prefix in ("", "shift_"):
    cte(f"{_prefix}cf_rated", f"""
select user_id, item_id, {settled("sum(score)")} score from (
  select user_id, item_id, centred score from order_centred
  union all
  select a.user_id, a.item_id, w * b.centred from order_centred a join order_centred b on a.user_id = b.user_id
  join {_prefix}buy_both on i = a.item_id and j = b.item_id) group by 1, 2
""")  # fmt: skip
    cte(f"{_prefix}cf_lists", top(f"select * from {_prefix}cf_rated"))
cte("cf_reachable", f"""
select user_id, item_id, {settled("sum(score)")} score from (
  select user_id, item_id, centred score from order_centred
  union all
  select user_id, i, w * centred from order_centred join buy_both on j = item_id) group by 1, 2
""")  # fmt: skip
cte("tag_context", f"""
select user_id, list(x order by pos) raw, list_inner_product(raw, raw) len2 from (
  select user_id, pos, sum(x) x from (
    select user_id, unnest(vec) x, unnest(range(0, len(vec))) pos from order_recent join tag_vec using (item_id)) group by 1, 2) group by 1
""")  # fmt: skip
cte("tag_scores", f"""
select user_id, t.item_id, list_inner_product(c.vec, t.vec) score from (select user_id, {UNIT} vec from tag_context) c cross join tag_vec t
""")  # fmt: skip
cte("tag_lists", top("select * from tag_scores"))
cte("tag_mean", """
select user_id, list(x order by pos) vec from (
  select user_id, pos, avg(x) x from (
    select user_id, unnest(vec) x, unnest(range(0, len(vec))) pos from order_recent join tag_vec using (item_id)) group by 1, 2) group by 1
""")  # fmt: skip
cte("tag_likely", """
select user_id, item_id, exp(s) / sum(exp(s)) over (partition by user_id) p from (
  select user_id, t.item_id, list_inner_product(c.vec, t.vec) s from tag_mean c cross join tag_vec t)
""")  # fmt: skip
cte("draw_ranges", """
select item_id, sum(w) over (order by item_id) high, high - w low, sum(w) over () total from (
  select item_id, round(pow(count(*), 0.75) * 10000)::bigint w from gap_baskets group by 1 having count(*) >= 5)
""")  # fmt: skip

# --- rules --------------------------------------------------------------------------------

cte("brand_sets", "select distinct l_orderkey basket_id, item_id from brand_lines where l_orderkey in (select o_orderkey from orders)")
cte("shift_members", "select user_id || '-' || basket_no basket_id, item_id from brand_shift_baskets")


def mined(prefix: str, members: str, support: float, confidence: float) -> None:
    """Itemsets of up to four items, their rules, and the lists that follow from recent brands."""
    cte(f"{prefix}n_sets", f"select count(distinct basket_id) total from {members}")
    share = f"count(*) / (select total from {prefix}n_sets) >= {support}"
    for size in (1, 2, 3, 4):
        names = "abcd"[:size]
        joins = " ".join(f"join {members} {y} on a.basket_id = {y}.basket_id and {x}.item_id < {y}.item_id" for x, y in zip(names, names[1:]))
        items = ", ".join(f"{x}.item_id" for x in names)
        cte(f"{prefix}sets{size}", f"select [{items}] items, count(*) freq from {members} a {joins} group by {items} having {share}")
    cte(f"{prefix}sets", " union all ".join(f"select * from {prefix}sets{size}" for size in (1, 2, 3, 4)))
    cte(f"{prefix}sides", f"""
select items, freq, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) antecedent,
       list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) consequent
from (select *, unnest(range(1, (1 << len(items)) - 1)) mask from {prefix}sets where len(items) > 1)
""")  # fmt: skip
    cte(f"{prefix}rules", f"""
select antecedent, consequent, s.freq / (select total from {prefix}n_sets) support, s.freq / b.freq confidence
from {prefix}sides s join {prefix}sets b on b.items = s.antecedent where s.freq / b.freq >= {confidence}
""")  # fmt: skip
    cte(f"{prefix}rules_one", f"select * from {prefix}rules where len(consequent) = 1")
    for name, agg in ((f"{prefix}rules", "min"), (f"{prefix}rules_one", "max")):
        cte(f"{name}_leads", f"""
select antecedent, item_id, {agg}(confidence) confidence
from (select antecedent, unnest(consequent) item_id, confidence from {name}) group by 1, 2
""")  # fmt: skip
        cte(f"{name}_met", f"""
select user_id, antecedent from (select distinct antecedent, unnest(antecedent) item_id from {name}_leads)
join brand_recent using (item_id) group by 1, 2 having count(*) = len(antecedent)
""")  # fmt: skip
        cte(f"{name}_lists", top(f"""
select user_id, item_id, {agg}(confidence) score from {name}_met join {name}_leads using (antecedent) group by 1, 2
"""))  # fmt: skip


mined("", "brand_sets", 0.003, 0.005)
mined("shift_", "shift_members", 0.02, 0.05)

# --- dense ALS, two factors, two sweeps ----------------------------------------------------

LAMBDA = 0.1
cte("event_users", "select distinct user_id from event_ratings")
cte("event_items", "select distinct item_id from event_ratings")


def _start(key: str, f: int) -> str:
    return f"(({key} * 7919 + {104729 * (f + 1)}) % 1000) / 1000.0::double"


for _key, _ids in (("user_id", "event_users"), ("item_id", "event_items")):
    cte(f"als_{_key}_0", f"select {_key}, {_start(_key, 0)} a, {_start(_key, 1)} b from {_ids}")


def _update(step: int, key: str, other: str, source: str, prefix: str = "als") -> None:
    """Least-squares update of one side with the closed-form inverse of the 2 x 2 matrix."""
    name = f"{prefix}_{key}_{step}"
    cte(f"{name}_gram", f"select sum(a * a) + {LAMBDA} p, sum(a * b) q, sum(b * b) + {LAMBDA} r from {source}")
    cte(f"{name}_right", f"""
select {key}, sum(centred * a) x, sum(centred * b) y from event_centred join {source} using ({other}) group by 1
""")  # fmt: skip
    cte(name, f"""
select {key}, (x * r - y * q) / (p * r - q * q) a, (y * p - x * q) / (p * r - q * q) b
from {name}_right cross join {name}_gram
""")  # fmt: skip


for _step in (1, 2):
    _update(_step, "user_id", "item_id", f"als_item_id_{_step - 1}")
    _update(_step, "item_id", "user_id", f"als_user_id_{_step}")


def _loss(step: int) -> str:
    return f"""
select {step} step, round((select sum(centred * centred) from event_centred)
  - 2 * (select sum(centred * (u.a * i.a + u.b * i.b)) from event_centred
         join als_user_id_{step} u using (user_id) join als_item_id_{step} i using (item_id))
  + (u.p * i.p + 2 * u.q * i.q + u.r * i.r) + {LAMBDA} * (u.p + u.r) + {LAMBDA} * (i.p + i.r), 4) loss
from (select sum(a * a) p, sum(a * b) q, sum(b * b) r from als_user_id_{step}) u
cross join (select sum(a * a) p, sum(a * b) q, sum(b * b) r from als_item_id_{step}) i"""


for _key, _ids in (("user_id", "event_users"), ("item_id", "event_items")):
    cte(f"part_{_key}_0", f"select {_key}, {_start(_key, 0)} a, {_start(_key, 1)} b from {_ids}")
for _step in (1, 2):
    # only the first two items are ever updated
    _update(_step, "user_id", "item_id", f"part_item_id_{_step - 1}", "part")
    _update(_step, "item_id", "user_id", f"part_user_id_{_step}", "fresh")
    cte(f"part_item_id_{_step}", f"""
select item_id, case when known then coalesce(f.a, 0.0) else p.a end a, case when known then coalesce(f.b, 0.0) else p.b end b
from (select *, item_id in (select item_id from event_items order by item_id limit 2) known from part_item_id_{_step - 1}) p
left join fresh_item_id_{_step} f using (item_id)
""")  # fmt: skip


def _als_cells(step: int, prefix: str = "als") -> str:
    return f"""
select user_id, item_id, coalesce(u.a * i.a + u.b * i.b, 0.0) score from event_users cross join event_items
left join {prefix}_user_id_{step} u using (user_id) left join {prefix}_item_id_{step} i using (item_id)"""


for _step in (0, 1, 2):
    cte(f"als_cells_{_step}", _als_cells(_step))
    cte(f"als_lists_{_step}", top(f"""
select user_id, item_id, score from als_cells_{_step} anti join event_old using (user_id, item_id) where score >= -1e-12
"""))  # fmt: skip
    cte(f"als_rmse_{_step}", f"""
select round(sqrt(avg(pow(rating - (score + coalesce(user_mean, 0)), 2))), 6) rmse
from event_new join als_cells_{_step} using (user_id, item_id) left join event_means using (user_id)
""")  # fmt: skip

cte("close_items", """
select a.item_id i, b.item_id j from topic_vec a join topic_vec b on list_inner_product(a.vec, b.vec) >= 0.8
where a.item_id in (select item_id from event_items) and b.item_id in (select item_id from event_items)
""")  # fmt: skip

# --- walks --------------------------------------------------------------------------------

ALPHA = 0.8
cte("edges", "select user_id, item_id from event_centred where centred >= 0")
cte("user_deg", "select user_id, count(*) du from edges group by 1")
cte("item_deg", "select item_id, count(*) ds from edges group by 1")
cte("walk_1", f"""
select a.user_id x, b.user_id y, sum({ALPHA * ALPHA}::double / (du * ds)) v from edges a join edges b using (item_id)
join item_deg using (item_id) join user_deg d on d.user_id = a.user_id group by 1, 2
""")  # fmt: skip
cte("sum_1", """
select x, y, sum(v) v from (select x, y, v from walk_1 union all select user_id, user_id, 1.0::double from user_deg) group by 1, 2
""")  # fmt: skip
WALK_LEVELS = 7
for _level in range(2, WALK_LEVELS + 1):
    _p = _level - 1
    cte(f"walk_{_level}", f"select a.x, b.y, sum(a.v * b.v) v from walk_{_p} a join walk_{_p} b on a.y = b.x group by 1, 2")
    cte(f"sum_{_level}", f"""
select x, y, sum(v) v from (select x, y, v from sum_{_p}
union all select a.x, b.y, a.v * b.v from sum_{_p} a join walk_{_level} b on a.y = b.x) group by 1, 2
""")  # fmt: skip
cte("walk_cells", f"""
select y user_id, item_id, {ALPHA}::double * sum(v) / any_value(ds) score from sum_{WALK_LEVELS}
join edges e on e.user_id = x join item_deg using (item_id) group by 1, 2
""")  # fmt: skip


def walk_lists(scale: str) -> str:
    return top(f"""
select user_id, item_id, coalesce(score * {scale}, 0.0) score from event_users cross join event_items
left join walk_cells using (user_id, item_id) left join user_deg using (user_id) left join item_deg using (item_id)
""")  # fmt: skip


cte("walk_top", walk_lists("1"))

# --- evaluation ---------------------------------------------------------------------------


def diversity(lists: str, factor: str = "0.5", vectors: str = "item_vec") -> str:
    return f"""
select a.user_id, 1 - (sum(list_inner_product(v.vec, x.vec)) - any_value(n)) / ({factor} * any_value(n) * (any_value(n) - 1)) diversity
from {lists} a join {lists} b on a.user_id = b.user_id join {vectors} v on v.item_id = a.item_id
join {vectors} x on x.item_id = b.item_id
join (select user_id, count(*) n from {lists} group by 1) c on c.user_id = a.user_id
where n > 1 group by 1"""


def evaluation(lists: str, new: str, items: str, key: str, factor: str | None = "0.5", extra: str = "", vectors: str = "item_vec") -> str:
    mean = f", (select round(avg(diversity), 6) from ({diversity(lists, factor, vectors)})) diversity" if factor else ""
    return f"""
select hits, listed, selected, round(hits / listed, 6) as "precision", round(hits / selected, 6) as recall,
  case when hits > 0 then round(2 * (hits / listed) * (hits / selected) / (hits / listed + hits / selected), 6) end f_measure,
  round((select count(distinct item_id) from {lists}) / (select count(distinct {key}) from {items}), 6) coverage
  {mean}{extra}
from (select (select count(*) from {lists} semi join {new} using (user_id, item_id)) hits,
  (select count(*) from {lists}) listed, (select count(*) from {new}) selected)"""


def curve() -> str:
    rows = []
    for step in (0, 1, 2):
        mean = f"(select round(avg(diversity), 6) from ({diversity(f'als_lists_{step}', vectors='topic_vec')}))"
        cover = f"round((select count(distinct item_id) from als_lists_{step}) / (select count(*) from event_items), 6)"
        rows.append(f"select {step} step, (select rmse from als_rmse_{step}) rmse, {cover} coverage, {mean} diversity")
    return " union all ".join(rows)


def similar(vectors: str, key: str) -> str:
    ranked = top(
        f"select a.{key} i, b.{key} j, list_inner_product(a.vec, b.vec) score from {vectors} a join {vectors} b on a.{key} <> b.{key}",
        user="i",
        item="j",
    )
    return f"select i, rank, j, score sim from ({ranked})"


def text(items: str) -> str:
    return f"array_to_string({items}, ',')"


def scaled(column: str, positive: bool = True) -> str:
    low, high = f"min({column}) over ()", f"max({column}) over ()"
    upper = f"{column} - {low}" if positive else f"{high} - {column}"
    return f"case when {low} = {high} then 1.0 else round(({upper}) / ({high} - {low})::double, 6) end"


SCORES = "select vec_id item_id, unnest(range(0, len(embedding))) tag_id, round(unnest(embedding)::double, 6) relevance from embeddings"
cte("scores", SCORES)
HOT_UNSEEN = "select c_custkey user_id, item_id, score from customer cross join hot anti join order_old o on o.user_id = c_custkey and o.item_id = hot.item_id"

SIZES = ("TINY", "LITTLE", "MIDDLE", "BIG", "HUGE")
GENRES = "p_type || '|' || (['" + "', '".join(SIZES) + "'])[least((p_size - 1) // 10, 4) + 1]"

ORACLES: dict[str, str] = {
    "ratings_view": sql("select user_id, item_id, rating, ts from order_ratings"),
    "event_ratings_view": sql("select user_id, item_id, rating, ts from event_ratings"),
    "dat_scan": sql("select user_id, item_id, rating, ts from order_ratings"),
    "csv_scan": sql("select item_id, tag_id, relevance from scores"),
    "matrix_scan": sql("select item_id, user_id, rating from event_ratings"),
    "time_matrix": sql("select item_id, user_id, ts from event_old"),
    "basket_scan": sql(f"""select user_id, basket_no, (nth - 1) // 1000 piece, {text("list(item_id order by item_id)")} items
        from (select *, row_number() over (partition by user_id, basket_no order by item_id) nth from gap_baskets) group by 1, 2, 3"""),
    "tag_scores_view": sql("select item_id, tag_id, relevance from scores"),
    "bound_filter": sql("select * from scores where item_id <= (select max(p_partkey) from part)"),
    "bound_filter_corrected": sql("select * from scores where item_id in (select p_partkey from part)"),
    "genre_onehot": "select p_partkey item_id, "
    + ", ".join(f"cast(list_contains(string_split({GENRES}, '|'), '{t}') as integer) as \"{t}\"" for t in (*TYPES, *SIZES))
    + " from part",
    "category_codes": f"select c_custkey user_id, {SEGMENT_CODE} segment from customer",
    "minmax_users": f"""select c_custkey user_id, {SEGMENT_CODE} segment, {scaled("c_acctbal")} balance,
        {scaled("c_nationkey")} nation from customer""",
    "minmax_users_inverted": f"""select c_custkey user_id, {scaled("c_acctbal", False)} balance,
        {scaled("c_nationkey", False)} nation from customer""",
    "rating_labels": sql("""select 'U_' || user_id user_label, 'S_' || item_id item_label, item_id, true is_user,
        round(ts / 86400, 6) as "day" from order_ratings"""),
    "rating_threshold": sql("select user_id, item_id from order_ratings where rating >= 3"),
    "rated_counts": sql("""select c_custkey user_id, coalesce(n, 0) rated, (select count(*) from part) - coalesce(n, 0) unrated
        from customer left join (select user_id, count(*) n from order_old group by 1) on user_id = c_custkey"""),
    "impute_features": sql(f"select item_id, tag_id, {rounded('x')} as \"value\" from typed_imputed"),
    "impute_features_fine": sql(f"select item_id, tag_id, {rounded('x')} as \"value\" from fine_imputed"),
    "sample_items": """select p_partkey item_id, p_name title, p_type genres from part
        qualify row_number() over (order by md5(p_partkey || 'items'), p_partkey) <= round_even((select count(*) from part) * 0.1, 0)""",
    "sample_users": """select c_custkey user_id from customer
        qualify row_number() over (order by md5(c_custkey || 'users'), c_custkey) <= round_even((select count(*) from customer) * 0.2, 0)""",
    "sample_ratings": sql("""select user_id, item_id, rating, ts from order_ratings
        where item_id in (select p_partkey from part qualify row_number() over (order by md5(p_partkey || 'items'), p_partkey)
              <= round_even((select count(*) from part) * 0.1, 0))
          and user_id in (select c_custkey from customer qualify row_number() over (order by md5(c_custkey || 'users'), c_custkey)
              <= round_even((select count(*) from customer) * 0.2, 0))"""),
    "sample_tag_scores": sql("select item_id, tag_id, relevance from scores where item_id in (select p_partkey from part)"),
    "items_with_vectors": sql("""select p_partkey item_id, p_type genres, tag_id, relevance as "value"
        from part left join scores on scores.item_id = p_partkey"""),
    "time_matrix_new": sql("select item_id, user_id, ts from event_new"),
    "users_scan": f"""select c_custkey user_id, case when c_acctbal < 0 then 'F' else 'M' end gender, c_nationkey::integer age,
        ({SEGMENT_CODE})::integer occupation, c_mktsegment zip from customer""",
    "items_scan": f"select p_partkey item_id, p_name title, {GENRES} genres from part",
    "tags_scan": sql("select distinct tag_id, 'tag, ' || tag_id tag from scores"),
    "impute_features_corrected": sql(f"""select item_id, tag_id, {rounded('x')} as "value" from nested_cells
        union all select k.item_id, m.tag_id, {rounded('coalesce(g.x, t.x, m.x)')} from nested_known k cross join nested_mean m
        left join nested_group_mean g on g.grp = k.grp and g.tag_id = m.tag_id
        left join nested_group_mean t on t.grp = string_split(k.grp, '/')[1] and t.tag_id = m.tag_id where k.tags is null"""),
    "mean_shift_baskets": sql("select * from shift_baskets", recursive=True),
    "item_cf_mean_shift": sql("select * from shift_cf_lists", recursive=True),
    "eval_item_cf_mean_shift": sql(evaluation("shift_cf_lists", "order_new", "part", "p_partkey"), recursive=True),
    "rules_mean_shift": sql(f"""select {text("antecedent")} antecedent, {text("consequent")} consequent,
        round(support, 6) support, round(confidence, 6) confidence from shift_rules""", recursive=True),
    "rule_recommend_mean_shift": sql("select * from shift_rules_lists", recursive=True),
    "eval_rules_mean_shift": sql(evaluation("shift_rules_lists", "brand_new", "brand_ratings", "item_id", None), recursive=True),
    "svd_moments": sql("""select 2 "power", round(sum(centred * centred), 3) total from event_centred
        union all select 4, round(sum(v * v), 3) from (select sum(a.centred * b.centred) v from event_centred a
          join event_centred b using (user_id) group by a.item_id, b.item_id)"""),
    "svd_full_rank": sql(f"select user_id, item_id, {rounded('centred')} pred from event_centred"),
    "als_recommend_reference": sql(top(f"""select user_id, item_id, score from ({_als_cells(2, "part")})
        anti join event_old using (user_id, item_id) where score >= -1e-12""")),
    "als_predictions": sql(f"select user_id, item_id, rating, {rounded('score')} pred from event_new join als_cells_2 using (user_id, item_id)"),
    "w2v_reload": sql("select item_id, true same from gap_baskets group by 1 having count(*) >= 5"),
    "embedding_recommend": sql("select * from tag_lists"),
    "embedding_recommend_unseen": sql(top("select * from tag_scores anti join order_old using (user_id, item_id)")),
    "embedding_status": sql("""select status, count(*) n_users from (
        select case when c_custkey not in (select user_id from order_recent) then 1 when n is null then 2 when n < 10 then 3 else 0 end status
        from customer left join (select user_id, count(*) n from tag_lists group by 1) on user_id = c_custkey) group by 1"""),
    "output_probabilities": sql("""select user_id, cast(rank as integer) rank, item_id, round(p, 9) score from (
        select *, row_number() over (partition by user_id order by p::float desc, item_id) rank from tag_likely) where rank <= 10"""),
    "negative_samples": sql("""select user_id, cast(slot as integer) slot, item_id from (
        select *, ('0x' || substr(md5(user_id || '-' || slot), 1, 15))::bigint % (select max(total) from draw_ranges) spot
        from (select c_custkey user_id, unnest(range(0, 5)) slot from customer)) join draw_ranges on spot >= low and spot < high"""),
    "eval_embedding": sql(evaluation("tag_lists", "order_new", "part", "p_partkey")),
    "user_cuts": sql("select user_id, round(cut, 3) cut from order_cut"),
    "split_old": sql("select user_id, item_id, rating, ts from order_old"),
    "split_new": sql("select user_id, item_id, rating, ts from order_new"),
    "split_new_corrected": sql("select r.* from order_ratings r join order_cut using (user_id) where ts > cut"),
    "recent_items": sql("select user_id, item_id from order_recent"),
    "center_ratings": sql(f"select user_id, item_id, rating, ts, {rounded('user_mean')} user_mean, {rounded('centred')} centred from order_centred"),
    "gap_baskets": sql("select * from gap_baskets"),
    "cooccurrence": sql("select * from co"),
    "item_raters": sql("select * from raters"),
    "item_similarity_buy": sql("select i, j, round(w, 6) w from buy_both union all select p_partkey, p_partkey, 1.0 from part"),
    "item_pair_cosine": sql(f"""select i, j, {rounded("list_inner_product(a.vec, b.vec)")} sim from co
        join item_vec a on a.item_id = i join item_vec b on b.item_id = j"""),
    "similar_items": sql(similar("item_vec", "item_id")),
    "user_cosine": sql(similar("user_vec", "user_id")),
    "frequent_itemsets": sql(f"select {text('items')} items, freq, round(freq / (select total from n_sets), 6) support from sets"),
    "assoc_rules": sql(f"""select {text("antecedent")} antecedent, {text("consequent")} consequent,
        round(support, 6) support, round(confidence, 6) confidence from rules"""),
    "assoc_rules_corrected": sql(f"""select {text("antecedent")} antecedent, {text("consequent")} consequent,
        round(support, 6) support, round(confidence, 6) confidence from rules_one"""),
    "rule_recommend": sql("select * from rules_lists"),
    "rule_recommend_corrected": sql("select * from rules_one_lists"),
    "hot_items": sql("select * from hot"),
    "hot_recommend": sql("select * from hot_lists"),
    "hot_recommend_unseen": sql(top(HOT_UNSEEN)),
    "random_recommend": sql("select * from random_lists", recursive=True),
    "item_cf_recommend": sql("select * from cf_lists"),
    "item_cf_recommend_unrated": sql(top("""select c_custkey user_id, p_partkey item_id, coalesce(score, 0.0) score
        from customer cross join part left join cf_reachable c on c.user_id = c_custkey and c.item_id = p_partkey
        anti join order_old o on o.user_id = c_custkey and o.item_id = p_partkey""")),
    "als_losses": sql(" union all ".join(_loss(s) for s in (0, 1, 2))),
    "als_recommend": sql("select * from als_lists_2"),
    "als_recommend_dissimilar": sql(top("""select user_id, item_id, score from als_cells_2 c
        anti join event_old using (user_id, item_id) where score >= -1e-12 and not exists (
          select 1 from event_old o join als_cells_2 l on l.user_id = o.user_id and l.item_id = o.item_id
          join close_items s on s.j = o.item_id where o.user_id = c.user_id and s.i = c.item_id and l.score >= -1e-12)""")),
    "als_curve": sql(curve()),
    "graph_transitions": sql("""select user_id, item_id, round(1 / du, 6) p_item, round(1 / ds, 6) p_user
        from edges join user_deg using (user_id) join item_deg using (item_id)"""),
    "walk_recommend": sql("select * from walk_top"),
    "walk_push": sql("select * from walk_top"),
    "walk_table": sql("select user_id, item_id, round(score, 6) + 0.0 score from walk_cells where user_id % 50 = 0 and score >= 1e-6"),
    "walk_recommend_corrected": sql(walk_lists("ds / du")),
    "eval_hot": sql(evaluation("hot_lists", "order_new", "part", "p_partkey")),
    "eval_hot_corrected": sql(evaluation("hot_lists", "order_new", "part", "p_partkey", "1")),
    "diversity_random": sql(f"select user_id, {rounded('diversity')} diversity from ({diversity('random_lists')})", recursive=True),
    "eval_random": sql(evaluation("random_lists", "order_new", "part", "p_partkey"), recursive=True),
    "eval_item_cf": sql(evaluation("cf_lists", "order_new", "part", "p_partkey")),
    "eval_rules": sql(evaluation("rules_lists", "brand_new", "brand_ratings", "item_id", None)),
    "eval_als": sql(evaluation("als_lists_2", "event_new", "event_items", "item_id", extra=", (select rmse from als_rmse_2) rmse", vectors="topic_vec")),
    "eval_walk": sql(evaluation("walk_top", "event_new", "event_items", "item_id", vectors="topic_vec")),
}
