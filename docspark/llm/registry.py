"""Queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import decontaminate, extraction, neardup, packing, pii, quality, secret_scan, tokens, toxicity, warc

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_token_ids": tokens.op2_token_ids,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_html_extraction": extraction.op5_html_extraction,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_personal_data": pii.op8_personal_data,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_minhash_near_dedup": neardup.op10_minhash_near_dedup,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
r as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from r""",
    "op4_quality_rules": r"""
with d as (select doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)),
hit as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from hit) group by 1),
l as (select doc_id, unnest(string_split(t, chr(10))) x from d), dup as (select doc_id, count(*) - count(distinct x) n from l where regexp_matches(x, '[^\x20\x09-\x0D]') group by 1),
f as (select doc_id, source, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
 coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from d left join rep using (doc_id) left join dup using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f),
h as (select source, count(*)::double n, sum(base_failed::int)::double failed from b where source is not null group by 1),
m as (select sum(n) n, greatest(1e-4, least(1 - 1e-4, sum(failed) / sum(n))) mean, count(*) k, sum(n * (failed / n) * (failed / n)) squares, sum(n * n) n2 from h),
v as (select *, case when n - n2 / n > 0 then ((squares / n - mean * mean) * n - (k - 1) * mean * (1 - mean)) / (n - n2 / n) else 0 end variance from m),
s as (select mean, case when variance > 0 then least(1000.0, greatest(2.0, mean * (1 - mean) / variance - 1)) else 1000.0 end strength from v),
q as (select source, failed + mean * strength a, n - failed + (1 - mean) * strength b from h, s),
bad as (select source from q where a / (a + b) - 3 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and (source is null or source not in (select source from bad)) as kept from b""",
    "op9_decontamination": f"""
with d as (select doc_id, {_WORDS} w from documents), b as (select item_id, {_WORDS} w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') g from (select item_id, w, least(10, len(w)) k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0)),
ks as (select distinct k from bw), dw as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks where len(w) >= k)),
hit as (select doc_id, i, k, item_id::varchar item from dw join bw using (k, g)), own as (select distinct doc_id, item from hit),
items as (select doc_id, count(*) n, string_agg(item, ',' order by item) s from own group by 1), words as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from hit) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(words.n, 0)::bigint as n_hit, coalesce(items.n, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
}
