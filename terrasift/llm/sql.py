"""DuckDB SQL for the queries that SQL can express."""

OP7_MIXING = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('20:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rk from s),
w as (select *, (case rk % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w, (2 * source_size)::double as cap from r),
f as (select *, cap / w as f from w),
l as (select *, (1.5::double * (sum(source_size) over ())::double
      - coalesce(sum(cap) over (order by f, rk rows between unbounded preceding and 1 preceding), 0))
      / (sum(w) over () - coalesce(sum(w) over (order by f, rk rows between unbounded preceding and 1 preceding), 0)) as level from f),
t as (select source, source_size, cap, w, (select arg_min(level, (f, rk)) from l where f >= level) as level from l),
g as (select source, source_size, case when level is null then cap else least(cap, level * w) end as target from t),
k as (select d.source, length(bin(d.size)) as b, sum(d.size)::bigint as words, any_value(g.source_size) as source_size, any_value(g.target) as target
  from d join g on d.source is not distinct from g.source group by all),
ka as (select *, sum(words * b) over (partition by source)::double
      - coalesce(sum(words * b) over (partition by source order by b desc rows between unbounded preceding and 1 preceding), 0)::double as weight,
    target - 2 * coalesce(sum(words) over (partition by source order by b desc rows between unbounded preceding and 1 preceding), 0)::double as rest from k),
kb as (select *, case when weight > 0 then rest / weight end as lev from ka),
kc as (select *, arg_max(lev, b) filter (lev * b <= 2) over (partition by source) as lv from kb),
kd as (select *, least(2.0::double, coalesce(lv * b, 2.0::double)) as copies from kc),
n as (select source, any_value(source_size) as source_size, any_value(target) as target, any_value(lv) as lv,
    any_value(target) - sum(floor(copies) * words)::double as want from kd group by source),
c as (select d.*, n.source_size, n.target, n.want,
    case when n.source_size > 0 then least(2.0::double, coalesce(lv * length(bin(d.size)), 2.0::double)) else 0 end as r
  from d join n on d.source is not distinct from n.source),
p as (select *, floor(r) as whole, r - floor(r) as p from c),
q as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from p),
o as (select *, q / (1 + q) as x from q),
e as (select *, case when x is not null then sum(size) over (partition by source, x is null order by x, doc_id, size
      rows unbounded preceding) end as e from o)
select doc_id, size, source_size, target,
  (size * (whole + case when x is null then 0 when e <= want then 1
     when e - size < want and e - want <= want - e + size then 1 else 0 end))::bigint as taken
from e
"""

# States of the role grammar: 0 nothing yet, s after the system row, u after a user, p after a pair. A state's value is the least
# (cost, audit, repaired text); crc32 is taken bit by bit.
_LEAST = "list_min(list_filter([{}], lambda x: x is not null))"


def _edit(state: str, cost: str, letter: str, row: str | None) -> str:
    text = f"{state}.t" if row is None else f"case when {state}.b then {state}.t || chr(10) else '' end || {row}"
    begun = f"{state}.b" if row is None else "true"
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}, 'b': {begun}}} end"


def _steps(target: str) -> str:
    """Candidates for a state after one more row: deleted, kept or given another role."""
    before, initial, role = {"o": ([], "", ""), "s": (["o"], "s", ""), "u": (["o", "s", "p"], "u", "user"), "p": (["u"], "a", "assistant")}[target]
    found = [_edit(target, "4", "D", None)]
    for state in before:
        found.append(f"case when not r.gone and r.initial = '{initial}' then {_edit(state, 'r.mend', 'K', 'r.row')} end")
        if role:
            found.append(f"case when not r.gone then {_edit(state, '3 + r.mend', 'R', f"('{role}:' || r.text)")} end")
    return _LEAST.format(", ".join(found))


_INSERT_U = _LEAST.format("u, " + ", ".join(_edit(x, "3", "I", "'user:'") for x in "osp"))
_INSERT_P = _LEAST.format("p, " + _edit("u", "3", "I", "'assistant:'"))

OP13_CONVERSATION_REPAIR = rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
hashed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), [1::bigint, 2, 3, 4, 5, 6, 7, 8]),
      lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) % 20 as kind from keyed),
hurt as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case kind when 3 then [0, 1] else [0] end) as copy from hashed where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n from hurt),
numbered as (
  select conv_id, turn, role, text, n, n > min(n) over (partition by conv_id, role, text) as seen,
    regexp_matches(text, '[^\x20\x09-\x0D]') as word, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as ended from placed),
r as (
  select conv_id, turn, role, text, n, left(role, 1) as initial, role || ':' || text as row, not word as blank, word and seen as duplicate,
    word and not seen and not ended as truncated, not word or seen as gone,
    case when word and not seen and not ended then 3 else 0 end as mend,
    lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair from numbered),
ids as (select distinct conv_id from conversations),
step as (
  select conv_id, 0::bigint as n, {{'c': 0::bigint, 'a': '', 't': '', 'b': false}} as o, null::struct(c bigint, a varchar, t varchar, b boolean) as s,
    {{'c': 3::bigint, 'a': 'I', 't': 'user:', 'b': true}} as u,
    {{'c': 6::bigint, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:', 'b': true}} as p from ids
  union all
  select conv_id, n, o, s, u, {_INSERT_P} as p from (
    select conv_id, n, o, s, p, {_INSERT_U} as u from (
      select step.conv_id, step.n + 1 as n, {_steps("o")} as o, {_steps("s")} as s, {_steps("u")} as u, {_steps("p")} as p
      from step join r on r.conv_id is not distinct from step.conv_id and r.n = step.n + 1))),
ended as (select conv_id, n, {_LEAST.format("o, p")} as best from step),
final as (select conv_id, arg_max(best, n) as best from ended group by conv_id),
stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select final.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit,
  left(best.t, 1) = 's' as with_system, sha256(best.t) as repaired_sha256
from final left join stats on stats.conv_id is not distinct from final.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op7_mixing": OP7_MIXING, "op13_conversation_repair": OP13_CONVERSATION_REPAIR}
