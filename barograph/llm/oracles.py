"""DuckDB SQL for the queries of this package that SQL expresses on whole tables."""

from __future__ import annotations

#: CRC-32 of every distinct word of both tables, one table step a byte.
IMPORTANCE_RESAMPLING = r"""
with recursive steps as (
  select i as byte, i as c, 0 as k from range(256) t(i)
  union all
  select byte, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (
  select list(c order by byte) as step from steps where k = 8
), own as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), target as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), own_words as (
  select doc_id, word, count(*) as n from (select doc_id, unnest(words) as word from own) group by all
), target_words as (
  select word, count(*) as n from (select unnest(words) as word from target) group by all
), hashed as (
  select word, xor(list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select word from own_words union select word from target_words), crc
), s as (
  select bucket, sum(n) as n from own_words join hashed using (word) group by bucket
), t as (
  select bucket, sum(n) as n from target_words join hashed using (word) group by bucket
), totals as (
  select coalesce((select sum(n) from s), 0)::double as s, coalesce((select sum(n) from t), 0)::double as t
), gains as (
  select bucket, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * (totals.s + 10000) / ((coalesce(s.n, 0)::double + 1) * (totals.t + 10000))))::bigint as gain
  from (select distinct bucket from hashed) left join s using (bucket) left join t using (bucket), totals
), weights as (
  select doc_id, floor(sum(n * gain) / sum(n)::double)::bigint as weight
  from own_words join hashed using (word) join gains using (bucket) group by doc_id
), scored as (
  select doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from own left join weights using (doc_id)
), ranks as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end::bigint as rank
from scored left join ranks using (doc_id)
"""

FILL_IN_MIDDLE = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || doc_id) as h from documents
), units as (
  select doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') as units,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) as h
  from drawn
), cuts as (
  select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 100 then 'plain'
         when h[4] % 100 < 50 then 'spm' else 'psm' end as form
  from units
), parts as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
  from cuts
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

ORACLES: dict[str, str] = {
    "op11_importance_resampling": IMPORTANCE_RESAMPLING,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
}
