"""DuckDB SQL for the operators that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"

OP3 = rf"""with d as (select doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, s, array_to_string(w[i : i + s - 1], ' ') win from (select item, w, least(13, len(w)) s, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, s, i, array_to_string(w[i : i + s - 1], ' ') win from (select doc_id, w, s, unnest(range(1, len(w) - s + 2)) i from d cross join (select distinct s from bw))),
found as (select doc_id, i, dw.s, item from dw join bw on dw.s = bw.s and dw.win = bw.win),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + s)) p from (select distinct doc_id, i, s from found)) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) list from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(list, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hit on hit.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

#: A text's bytes as hexadecimal digits, in blocks of 512 starts, as a place in a long string is found by counting.
OP4 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents),
blocks as (select doc_id, n, k, substr(h, 1 + 1024 * k, 1822) hb from (select doc_id, n, h, unnest(range(0, (n + 511) // 512)) k from d where n >= 400)),
starts as (select doc_id, 512 * k + i s, md5_number(substr(hb, 2 * i + 1, 800)) m from (select doc_id, n, k, hb, unnest(range(0, 512)) i from blocks) where 512 * k + i + 400 <= n),
again as (select doc_id, s from starts where m in (select m from starts group by m having count(*) > 1)),
islands as (select doc_id, s, sum(new) over (partition by doc_id order by s) island from (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= 400 then 0 else 1 end new from again)),
spans as (select doc_id, min(s) a, max(s) + 400 e from islands group by doc_id, island),
gaps as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) before from spans),
kept as (select d.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || any_value(substr(h, 2 * last + 1)) k, count(*) n_spans, cast(sum(e - a) as bigint) n_removed
  from gaps join d on d.doc_id = gaps.doc_id join (select doc_id, max(e) last from spans group by doc_id) l on l.doc_id = d.doc_id group by d.doc_id)
select d.doc_id, cast(n as bigint) n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(k, h))) kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""

OP8 = f"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, {SPACED}) w from documents),
sh as (select distinct doc_id, hash(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) x from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) i from d where len(w) > 0)),
sizes as (select doc_id, count(*) n from sh group by doc_id),
pairs as (select p.doc_id a, q.doc_id b, count(*) shared from sh p join sh q on p.x = q.x and p.doc_id < q.doc_id group by p.doc_id, q.doc_id),
links as (select a, b from pairs join sizes s on s.doc_id = a join sizes t on t.doc_id = b where 100 * shared >= 75 * (s.n + t.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from d union select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b),
names as (select a doc_id, min(b) component_id from reach group by a)
select d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept from d join names on names.doc_id = d.doc_id left join sizes on sizes.doc_id = d.doc_id"""

BASE_RULES = rf"""with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {SPACED}) w from documents),
lines as (select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, {SPACED}) group by doc_id),
windows as (select doc_id, i, array_to_string(w[i : i + 4], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d)),
often as (select doc_id, x from windows group by doc_id, x having count(*) > 1),
covered as (select doc_id, count(distinct p) n from (select v.doc_id, unnest(range(i, i + 5)) p from windows v join often o on o.doc_id = v.doc_id and o.x = v.x) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  coalesce(lines.n, 0) n_dup_lines, coalesce(covered.n, 0) n_repeat_words, len(w) < 10 or 100 * coalesce(covered.n, 0) > 20 * len(w) base_failed
from d left join lines on lines.doc_id = d.doc_id left join covered on covered.doc_id = d.doc_id"""
