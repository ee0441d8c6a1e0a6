"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op8_chat_format
from .decontamination import op1_string_tiling
from .jaccard import op4_prefix_join
from .language import language_of_pages, op3_language_fusion
from .linededup import op2_cuckoo_lines
from .media import op7_mpeg_audio
from .merkle import op11_merkle_manifest
from .packing import op6_genetic_packing
from .search import op12_impact_search
from .secrets import op9_entropy_secrets
from .sharding import op10_best_fit_shards
from .sumsquares import op13_sum_of_squares
from .tokenfile import op5_huffman_ids

QUERIES = {
    "op2_cuckoo_lines": op2_cuckoo_lines,
    "op1_string_tiling": op1_string_tiling,
    "op3_language_fusion": op3_language_fusion,
    "op4_prefix_join": op4_prefix_join,
    "op5_huffman_ids": op5_huffman_ids,
    "op6_genetic_packing": op6_genetic_packing,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_chat_format": op8_chat_format,
    "op9_entropy_secrets": op9_entropy_secrets,
    "op10_best_fit_shards": op10_best_fit_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_impact_search": op12_impact_search,
    "op13_sum_of_squares": op13_sum_of_squares,
    "language_of_pages": language_of_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op2_cuckoo_lines": """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
m as (select k.doc_id, k.i, k.line, s.owner is not null and s.owner <> k.doc_id as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by doc_id
""",
    "op8_chat_format": """
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
 union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
m as (select conv_id, turn, role, text, coalesce(role = lag(role) over (partition by conv_id order by turn, role, text), false) as same,
 regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|ROLE\\]|TEXT\\]|NEXT\\]|END\\])', '\\1\\\\\\2\\3', 'g') as esc from t),
r as (select conv_id, turn, role, text, length(esc) + case when same then 6 else length(role) + 17 end as n from m)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 (sum(n) + 7)::bigint as formatted_chars
from r group by conv_id
""",
    "op11_merkle_manifest": """
with recursive poly(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from poly where k < 8),
crc as (select list(c order by i) as t from poly where k = 8),
f as (select row_number() over () as uid, doc_id, lang, n_chars, text,
 coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
 coalesce(strlen(text) || ':' || text, '-') as tail,
 xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) % 7 = 0 as hit
 from documents, crc),
l as (select uid, doc_id, coalesce('=' || lang, '') as tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
 sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) as forged, hit from f),
n as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, uid) - 1 as pos from l),
inner_nodes as (select tree, 0 as lvl, pos, leaf as h from n union all
 select tree, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by tree) as many from inner_nodes) where many > 1 group by tree, lvl, pos // 2),
sub as (select tree, h as subroot, row_number() over (order by tree) - 1 as grp from inner_nodes i where lvl = (select max(lvl) from inner_nodes j where j.tree = i.tree)),
top_nodes as (select 0 as lvl, grp as pos, subroot as h from sub union all
 select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as many from top_nodes) where many > 1 group by lvl, pos // 2),
heights as (select tree, max(lvl) as height from inner_nodes group by tree),
steps as (select n.uid, g.lvl, case when (n.pos >> g.lvl) & 1 = 1 then 'R' else 'L' end || coalesce(i.h, '') as step
 from n join heights using (tree) join lateral (select range as lvl from range(64)) g on g.lvl < height
 left join inner_nodes i on i.tree = n.tree and i.lvl = g.lvl and i.pos = xor(n.pos >> g.lvl, 1)
 union all select n.uid, 64 + g.lvl, case when (sub.grp >> g.lvl) & 1 = 1 then 'R' else 'L' end || coalesce(i.h, '')
 from n join sub using (tree) join (select range as lvl from range(64)) g on g.lvl < (select max(lvl) from top_nodes)
 left join top_nodes i on i.lvl = g.lvl and i.pos = xor(sub.grp >> g.lvl, 1)),
paths as (select uid, list(step order by lvl) as steps, string_agg(step[2:], '' order by lvl) as siblings from steps group by uid),
root as (select h as root from top_nodes where lvl = (select max(lvl) from top_nodes))
select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256,
 list_reduce(coalesce(steps, []::varchar[]), lambda h, s: sha256(case when s[1] = 'R' then s[2:] || h else h || s[2:] end), case when hit then forged else leaf end) as folded_root, folded_root = root as verified
from n join sub using (tree) left join paths using (uid), root
""",
    "op12_impact_search": """
with t as (select row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
 from (select row_number() over () as row, doc_id, text from documents)),
n as (select row, count(*)::bigint as n from t group by row),
g as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
p as (select row, doc_id, term, count(*)::bigint as tf from t group by row, doc_id, term),
f as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::double))::bigint as w from p, g group by term, docs),
q as (select item, item_id, term, count(*)::bigint as times from (select item, item_id,
 unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
 from (select row_number() over () as item, item_id, text from benchmark)) group by item, item_id, term),
s as (select item, item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
 from q join f using (term) join p using (term) join n using (row), g group by item, item_id, row, doc_id)
select item_id, row_number() over (partition by item order by score desc, doc_id nulls first)::int as rank, doc_id, score from s where score > 0
qualify rank <= 10
""",
}
