"""SQL of the text-corpus queries that SQL can express."""

_TERMS = """
with pages as (select distinct page_id, template from webpage),
pairs as (select distinct on (pair_id) pair_id, obj_text, pred_candidates from candidate_pairs),
terms as (
  select 'template' as field_name, page_id as rec, template as raw from pages
  union all select 'obj_text', pair_id, obj_text from pairs
  union all select 'pred_text', pair_id, unnest(pred_candidates).text from pairs),
clean as (select field_name, rec, lower(trim(regexp_replace(raw, '[ \\t\\r\\n\\x{00A0}]+', ' ', 'g'), ' ')) as val from terms where raw is not null),
counts as (select field_name, val, count(*) as n_occurrences, count(distinct rec) as n_records from clean group by 1, 2),
totals as (
  select 'template' as field_name, count(distinct page_id) as n from pages
  union all select 'obj_text', count(*) from pairs union all select 'pred_text', count(*) from pairs),
marked as (
  select field_name, val, n_occurrences, n_records,
         case when n_records < 3 then 'rare' when n_records > 0.03 * n then 'common' end as mark
  from counts join totals using (field_name))
"""

ORACLES: dict[str, str] = {
    "p7_found": _TERMS + "select field_name, val, mark from marked where mark is not null",
    "p7_counts": _TERMS + "select field_name, val, n_occurrences, n_records, mark from marked",
}
