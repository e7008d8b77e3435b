"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op10_exact_dedup": """
        with d as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
        )
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
        from d window w as (partition by t)
    """,
    "op9_decontamination": r"""
        with dw as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ), bw as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
        ), win as (
            select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as k
            from bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(p) where len(w) > 0
        ), occ as (
            select doc_id, p, s.n, array_to_string(w[p : p + s.n - 1], ' ') as k
            from dw, (select distinct n from win) s, unnest(range(1, len(w) - s.n + 2)) as t(p)
        ), hit as (
            select occ.doc_id, occ.p, occ.n, win.item_id from occ join win on occ.k = win.k and occ.n = win.n
        ), covered as (
            select doc_id, count(distinct q) as n_hit from hit, unnest(range(p, p + n)) as t(q) group by doc_id
        ), items as (
            select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from hit group by doc_id
        )
        select dw.doc_id, len(dw.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from dw left join covered using (doc_id) left join items using (doc_id)
    """,
    "op4_chat_format": r"""
        with c as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as own(t, r)
        )
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
               sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
               sum(4 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 9)::bigint as formatted_chars
        from c group by conv_id
    """,
}
