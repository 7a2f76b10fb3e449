"""DuckDB counterparts of the registered queries, where SQL can express them."""

from .licenses import TEMPLATES

#: formatted_chars: 12 for <|im_start|>, 1 line break, 11 for <|im_end|> and its line break; one more
#: for every escaped lead.
OP1 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id,
       count(*)::BIGINT as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::BIGINT as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT as formatted_chars
from rows group by conv_id
"""

OP3 = r"""
with sized as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT as size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT as key
  from documents
), sources as (
  select source, sum(size)::BIGINT as source_size,
         ((row_number() over (order by source nulls last) - 1) % 3 + 1)::BIGINT as weight
  from sized group by source
), ranked as (
  select *, 3 * source_size as cap,
         sum(source_size) over () as words_all, sum(weight) over () as weight_all,
         coalesce(sum(3 * source_size) over before, 0) as capped, coalesce(sum(weight) over before, 0) as weighed
  from sources
  window before as (order by (3 * source_size)::DOUBLE / weight, source nulls last rows between unbounded preceding and 1 preceding)
), marked as (
  select *, cap * (weight_all - weighed) <= (words_all - capped) * weight as stopped,
         row_number() over (order by cap::DOUBLE / weight, source nulls last) as place
  from ranked
), rate as (
  select words_all - capped as words_left, weight_all - weighed as weight_left from marked where not stopped order by place limit 1
), targets as (
  select source, source_size,
         case when stopped then cap::DOUBLE else weight::DOUBLE * (select words_left from rate)::DOUBLE / (select weight_left from rate)::DOUBLE end as target
  from marked
), placed as (
  select doc_id, size, source_size, target,
         floor(target)::BIGINT // greatest(source_size, 1) as copies,
         floor(target)::BIGINT % greatest(source_size, 1) as missing,
         coalesce(sum(size) over (partition by sized.source order by key range between unbounded preceding and current row exclude group), 0)::BIGINT as below,
         count(*) over (partition by sized.source, key) as members
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
       (copies * size + greatest(0, least(size, (missing - below) // members)))::BIGINT as taken
from placed
"""

def _license_sql() -> str:
    """Exact containment of every template, without the windows."""
    rows = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in TEMPLATES.items())
    words = "string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ')"
    shingles = "list_distinct(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: array_to_string(ws[i:i + 4], ' ')))"
    return f"""
with templates as (select license, {shingles} as own from (select license, {words} as ws from (values {rows}) t(license, text))),
texts as (select doc_id, {shingles} as had from (select doc_id, {words} as ws from documents)),
met as (
  select doc_id, license, len(own)::BIGINT as n_shingles, len(list_intersect(own, had))::BIGINT as n_shared from texts, templates
)
select *, n_shared / n_shingles as containment from met where n_shared >= 0.8 * n_shingles
"""


ORACLES = {"op1_chat_formatting": OP1, "op3_mixing": OP3, "op9_license_scans": _license_sql()}
