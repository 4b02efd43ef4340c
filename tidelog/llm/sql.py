"""DuckDB SQL for those queries whose whole result SQL can express.

The others (personal data and secrets: offsets of matches and boosted trees; HTML; licenses: diagonal votes) are held
against brute-force versions in the tests.
"""

from __future__ import annotations

from .quality import RULES, STOP_WORDS, Rule

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RATIOS = {"mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "stop_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "lettered_ratio": ("n_lettered", "n_words")}


def _rule(r: Rule) -> str:
    a, b = _RATIOS[r.statistic]
    value = f"(case when {b} > 0 then {a} / {b} else 0.0 end)"
    return " and ".join([f"{value} >= {r.low}"] * (r.low is not None) + [f"{value} <= {r.high}"] * (r.high is not None))


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
 case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]]) else [] end as g from d),
r as (select row_number() over () as row, * from l),
e as (select row, unnest(range(1, len(g) + 1)) as i, unnest(g) as x from r),
c as (select *, count(*) over (partition by row, x) as n from e),
h as (select row, count(distinct p) as n_repeat_words from (select row, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by row),
s as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
 coalesce(n_repeat_words, 0) as n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({_STOP}))) as n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as n_lettered
 from r left join h using (row)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(map(_rule, RULES))} as kept from b"""


def near(percent: int = 85, width: int = 5) -> str:
    return rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) end) as s from d),
u as (select doc_id, unnest(s) as x from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as n from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
k as (select a, b from p join g ga on ga.doc_id = a join g gb on gb.doc_id = b where 100 * n >= {percent} * (len(ga.s) + len(gb.s) - n)),
e as (select a, b from k union all select b, a from k),
r as (select doc_id, doc_id as reach from g union select r.doc_id, e.b from r join e on r.reach = e.a)
select g.doc_id, len(s) as n_shingles, m.c as component_id, g.doc_id = m.c as kept from g join (select doc_id, min(reach) as c from r group by 1) m using (doc_id)"""


WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
 case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f"""

MIXING = rf"""
with d as (select doc_id, source, len({_WORDS}) as size from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, i % 3 + 1 as weight, (i % 3 - 1) * cast(0.5 as double) as tilt, 3 * source_size as cap from s),
v as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0) as double) / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0)) as level from w),
c as (select *, level * weight > cap as capped from v),
t as (select *, case when capped then cast(cap as double) else (select arg_min(level, cap / weight) from c where not capped) * weight end as target from c),
o as (select d.doc_id, d.size, t.source_size, t.target, t.tilt, coalesce(sum(d.size) over (partition by d.source order by sha256(coalesce(cast(d.doc_id as varchar), '')), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start
 from d join t on d.source is not distinct from t.source),
n as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as turns, least(cast(start as double) / nullif(target, 0), 1.0) as share from o),
k as (select *, turns * size + greatest(0, least(size, floor(target - turns * source_size + 0.5) - start)) as taken, (1 - tilt) + sqrt(greatest((1 - tilt) * (1 - tilt) + 4 * tilt * share, 0)) as root from n)
select doc_id, size, cast(source_size as bigint) as source_size, target, cast(taken as bigint) as taken,
 case when taken > 0 then round(case when tilt = 0 or share <= 0 then share else least(2 * share / nullif(root, 0), 1.0) end, 9) end as position from k"""

LINES = f"""
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select row, doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from d),
k as (select *, {_LOWER.format(f"trim(x, {_WHITE})")} as key from e),
h as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct row) >= 5),
g as (select k.*, h.key is not null and k.doc_id <> h.last as gone from k left join h on k.key = h.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from g group by row"""

LEAKS = f"""
with b as (select coalesce(cast(item_id as varchar), '') as item, {_PLAIN} as w from benchmark),
win as (select distinct item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) as x from b where len(w) > 0),
lens as (select distinct len(x) as n from win),
d as (select row_number() over () as row, doc_id, {_PLAIN} as w from documents),
g as (select row, i, n, w[i:i + n - 1] as x from (select row, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join lens where len(w) >= n)),
m as (select row, i, n, item from g join win using (x)),
hit as (select row, count(distinct p) as n_hit from (select row, unnest(range(i, i + n)) as p from m) group by row),
it as (select row, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct row, item from m) group by row)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join hit using (row) left join it using (row)"""

SQL: dict[str, str] = {
    "op2_quality": QUALITY,
    "op4_near_dedup": near(),
    "op7_warc": WARC,
    "op8_mixing": MIXING,
    "op9_line_dedup": LINES,
    "op10_decontaminate": LEAKS,
}
