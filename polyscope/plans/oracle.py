"""Pieces of DuckDB SQL that stand for the fixtures and what is parsed of them."""

from __future__ import annotations

import re

from . import fixtures


def duck(sql: str) -> str:
    """A fixture's text for DuckDB: plain table names, list indexing."""
    return re.sub(r"element_at\(embedding,(\d+)\)", r"embedding[\1]", re.sub(r"\{(\w+)\}", r"\1", sql))


def label(c: str) -> str:
    """The label that an answer starts with: what is before it is cut off, then the label and what stands behind it are looked at."""
    named = f"(case when regexp_matches(lower(trim({c})), '^answer *[:：]') then ltrim(regexp_replace(trim({c}), '^[^:：]*[:：]', '')) else trim({c}) end)"
    bare = f"ltrim(case when {named}[1] in ('(', '[') then {named}[2:] else {named} end)"
    head, tail = f"upper({bare}[1])", f"{bare}[2:]"
    return f"case when {head} in ('A','B','C','D') and ({tail} = '' or {tail}[1] = ' ' or ({tail}[1] in (')', ']', '.', ':', '：') and ({tail}[2:] = '' or {tail}[2] = ' '))) then {head} end"


QA = f"qa as ({duck(fixtures.QA)})"
M = f"""{QA},
cut0 as (select p_partkey, language, unnest(regexp_extract_all(question, '[^:：]*[:：]|[^:：]+$')) as cut, generate_subscripts(regexp_extract_all(question, '[^:：]*[:：]|[^:：]+$'), 1) as pos from qa),
cut1 as (select *, rtrim(cut[:-2]) as body, cut[-1] in (':', '：') and regexp_matches(rtrim(cut[:-2]), '(^|[^A-Za-z0-9])[A-D]$') as opens from cut0),
cut2 as (select *, coalesce(sum(opens::int) over (partition by p_partkey, language order by pos rows between unbounded preceding and 1 preceding), 0) as piece from cut1),
cut3 as (select p_partkey, language, piece, trim(string_agg(case when opens then body[:-2] else cut end, '' order by pos)) as text, max(case when opens then body[-1] end) as next_label from cut2 group by all),
cut4 as (select p_partkey, language, list(text order by piece) || case when arg_max(next_label is not null, piece) then [''] else [] end as pieces, list(next_label order by piece) filter (next_label is not null) as labels from cut3 group by all),
m0 as (select qa.*, substr(asset, 11) as key, replace(replace(substr(asset, 11), '/' || language || '/', '/'), '_' || language || '_', '_') as state_key,
  {label("answer")} as gold_label, coalesce(labels, []) as labels, pieces, p_partkey % 37 <> 0 as asset_exists from qa join cut4 using (p_partkey, language)),
m1 as (select *, len(labels) > len(list_distinct(labels)) as dup, len(list_distinct(labels)) < 4 as few from m0),
m as (select *, dimension || '::' || state_key as parallel_id, dimension || '::' || state_key || '::' || language as sample_id,
  case when dup then 'failed_duplicate_label' when few then 'failed_missing_label' when list_contains(pieces[2:], '') then 'failed_empty_option' else 'ok' end as option_parse_status,
  case when dup or few then trim(question) else pieces[1] end as question_stem,
  'data/images/' || key as asset_path,
  case when is_episode and asset_exists then list_transform(range(1, 3 + p_partkey % 7), lambda i: 'data/images/' || key || '/frame_' || i || '.jpg') else ['data/images/' || key] end as images from m1)"""
INDEX = f"""{M},
ix as (select parallel_id, list_sort(list(language)) as languages, count(distinct gold_label) + max((gold_label is null)::int) = 1 as consistent from m group by 1),
ixc as (select *, languages = ['en','fr','ja','ru','th','zh'] as complete from ix)"""
OUT = f"o0 as ({duck(fixtures.OUTPUTS)}), o as (select *, {label('raw_output')} as parsed_label from o0)"
OK = f"{OUT}, ok as (select *, (parsed_label is not distinct from gold_label)::int as good from o where status = 'success')"
_z = lambda s, x: f"greatest({s}_{x}, 0.0::double)"
_t = lambda s: "(" + " + ".join(_z(s, x) for x in "abcd") + ")"
NORM = f"s0 as ({duck(fixtures.SCORES)}), s as (select vec_id, question_language, gui_language, gold_label, " + ", ".join(f"case when {_t(s)} = 0 then 0.25::double else {_z(s, x)} / {_t(s)} end as {s}_{x}" for s in "mxo" for x in "abcd") + " from s0)"
_h = lambda a, b: f"case when {a} > 0 and {a} + {b} > 0 then {a} * ln({a} / (0.5::double * ({a} + {b}))) else 0.0::double end"


def js(p: str, q: str) -> str:
    return "(0.5::double * (" + " + ".join(_h(f"{p}_{x}", f"{q}_{x}") for x in "abcd") + ") + 0.5::double * (" + " + ".join(_h(f"{q}_{x}", f"{p}_{x}") for x in "abcd") + "))"
