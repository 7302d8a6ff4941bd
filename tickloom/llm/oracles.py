"""DuckDB statements for the queries of this subpackage that SQL can express."""

_WORDS = r"'[\x20\x09-\x0D]+'"

PERSPECTIVES = """
with t as (
  select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations),
p as (select distinct conv_id as cid, role as speaker from t where role <> 'system'),
r as (
  select t.conv_id, p.speaker, t.turn, t.role as said, t.text,
    case when t.role = p.speaker then '<|assistant|>' || chr(10) when t.role = 'system' then '<|system|>' || chr(10)
         else '<|user name=' || t.role || '|>' || chr(10) end as head
  from t join p on t.conv_id is not distinct from p.cid),
s as (
  select *, head || text || '<|end|>' || chr(10) as segment,
    cast(coalesce(sum(length(head) + length(text) + 8) over (
      partition by conv_id, speaker order by turn, said, text rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from r)
select conv_id, speaker, turn,
  case when said = speaker then 'assistant' when said = 'system' then 'system' else 'user' end as role,
  case when said <> speaker and said <> 'system' then said end as name, segment, start,
  start + length(head) as mask_start, start + length(head) + length(text) + 8 as mask_end, said = speaker as trained
from s
"""

TRIE_JOIN = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    """ + _WORDS + r"""), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
k as (select doc_id, cast(len(sh) as bigint) as n, case when len(sh) > 0 then min(doc_id) over (partition by list_sort(sh)) else doc_id end as rep, sh from s),
t as (select doc_id, n, unnest(sh) as g from k where doc_id = rep),
c as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common
  from t a join t b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
e as (select x, y from c where 100 * common >= 80 * (na + nb - common)),
d as (select x as a, y as b from e union select y, x from e),
r as (select distinct a as node, a as seen from d union select r.node, d.b from r join d on d.a = r.seen),
m as (select node, min(seen) as least from r group by 1)
select k.doc_id, k.n as n_shingles, least(k.rep, coalesce(m.least, k.rep)) as component_id
from k left join m on m.node = k.rep
"""


def mixing(weights: dict, share: tuple[int, int], max_epochs: int, seed: int) -> str:
    """The mix as plain SQL: one level of the tree after another, then running sums in md5 order."""
    def weight(level: str) -> str:
        given = weights.get(level, {})
        cases = " ".join(f"when {level} = '{name}' then {value}" for name, value in given.items())
        return f"cast(case {cases} else 1 end as hugeint)" if cases else "cast(1 as hugeint)"

    levels = ("domain", "lang", "source")
    parts = [f"""
d as (select doc_id, lang, source, 'd' || cast(coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') as bigint), 0) % 4 as varchar) as domain,
  cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents),
f as (select * replace (coalesce(lang, '?') as lang, coalesce(source, '?') as source), lang as lang0, source as source0,
  md5('{seed}:' || coalesce(cast(doc_id as varchar), '')) as key from d),
l as (select domain, lang, source, cast(sum(n_tokens) as hugeint) as supply from f group by all),
g0 as (select cast(least(sum(supply) * {max_epochs}, sum(supply) * {share[0]} // {share[1]}) as hugeint) as budget, 0 as root from l)"""]
    above: list[str] = ["root"]
    for i, level in enumerate(levels):
        keys = ["root", *levels[: i + 1]]
        by = ", ".join(above)
        parts.append(f"""
n{i} as (select 0 as root, {", ".join(levels[: i + 1])}, sum(supply) * {max_epochs} as cap, {weight(level)} as weight
  from l group by {", ".join(levels[: i + 1])}),
w{i} as (select n{i}.*, budget,
  budget - coalesce(sum(cap) over (partition by {by} order by cast(cap as double) / cast(weight as double), {level} rows between unbounded preceding and 1 preceding), 0) as rest,
  sum(weight) over (partition by {by} order by cast(cap as double) / cast(weight as double), {level} rows between current row and unbounded following) as wsum
  from n{i} join g{i} using ({by})),
z{i} as (select *, cap * wsum <= weight * rest as isfull from w{i}),
y{i} as (select *, first_value(rest) over q as lrest, first_value(wsum) over q as lsum from z{i}
  window q as (partition by {by} order by case when isfull then 1 else 0 end, cast(cap as double) / cast(weight as double), {level})),
g{i + 1} as (select {", ".join(keys)}, cast(case when isfull then cap else weight * lrest // lsum end as hugeint) as budget from y{i})""")
        above = keys
    parts.append("""
b as (select f.*, cast(l.supply as bigint) as leaf_tokens, cast(g3.budget as bigint) as leaf_budget,
  cast(sum(n_tokens) over (partition by f.domain, f.lang, f.source order by key, doc_id, n_tokens rows between unbounded preceding and current row) as bigint) as run
  from f join l using (domain, lang, source) join g3 using (domain, lang, source))""")
    return "with " + ",".join(parts) + f"""
select doc_id, domain, lang0 as lang, source0 as source, n_tokens, leaf_tokens, leaf_budget,
  cast(case when leaf_tokens = 0 then 0 else leaf_budget // leaf_tokens
    + case when run <= leaf_budget % leaf_tokens and leaf_budget // leaf_tokens < {max_epochs} then 1 else 0 end end as integer) as copies
from b"""


def _crc_table() -> list[int]:
    """The reflected CRC-32 of each byte, by its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: crc32 is folded over the bytes; letter runs hold no byte but letters, so the hex form of the bytes is cut in pairs.
VARIANTS = r"""
with recursive r as (
  select coalesce(cast(doc_id as varchar), '') as id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run
  from documents),
g as (select id, run, count(*) as c from r where length(run) >= 7 group by all),
h as (
  select run, c, xor(list_reduce(list_transform(range(1, length(hex(encode(id || ':' || run))) // 2 + 1),
      lambda i: cast('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2) as bigint)),
    lambda x, b: xor(x >> 8, ([""" + ",".join(map(str, _crc_table())) + r"""])[(xor(x, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
  from g),
w as (
  select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, c
  from h),
v as (select word, cast(sum(c) as bigint) as n from w where length(word) >= 7 group by 1 having sum(c) >= 2),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (
  select a.word, b.word as near, b.n as near_n from d a join d b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from d a join v b on a.cut = b.word
  union select b.word, a.word, a.n from d a join v b on a.cut = b.word),
b as (select word, count(*) as n_near, max(near_n) as top, arg_min(near, (-near_n, near)) as near from p group by 1),
f as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.top >= 10 * v.n then b.near end as form,
    case when b.top >= 10 * v.n then b.top end as form_n
  from v left join b on v.word = b.word),
c as (select word, word as root, 0 as depth from f union all
  select c.word, f.form, c.depth + 1 from c join f on f.word = c.root where f.form is not null)
select f.word, f.form, arg_max(c.root, c.depth) as root, f.n, cast(f.n_near as bigint) as n_near, f.form_n
from f join c on c.word = f.word group by f.word, f.form, f.n, f.n_near, f.form_n
"""

COLLOCATIONS = r"""
with t as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from t),
s as (select unnest(range(1, 6)) as m),
g as (
  select lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) as phrase
  from w, s where len(ws) >= m),
f as (select lang, m, phrase, count(*) as a from g group by all having count(*) >= 100),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by 1),
c as (select lang, m, phrase, a, string_split(phrase, ' ') as ws from f where m >= 2),
k as (
  select c.*, k, array_to_string(ws[1:k], ' ') as x, array_to_string(ws[k + 1:m], ' ') as y
  from c, (select unnest(range(1, 5)) as k) where k < m),
q as (
  select k.lang, k.phrase, k.m, k.a, k.k, x.a as l, y.a as r, n.n,
    cast((1000::hugeint * k.a * n.n) // (x.a::hugeint * y.a) as bigint) as score
  from k join f x on x.lang = k.lang and x.phrase = k.x join f y on y.lang = k.lang and y.phrase = k.y join n on n.lang = k.lang),
o as (select * from q qualify row_number() over (partition by lang, phrase order by score, k) = 1),
z as (
  select c.lang, array_to_string(ws[i:i + j - 1], ' ') as phrase, max(a) as held
  from c, (select unnest(range(2, 5)) as j), (select unnest(range(1, 5)) as i) where j < m and i + j - 1 <= m group by 1, 2),
u as (
  select o.*, row_number() over (partition by o.lang order by score desc, a desc, o.phrase) as rank
  from o left join z on z.lang = o.lang and z.phrase = o.phrase where z.held is null or 100 * z.held < 100 * a)
select lang, rank, phrase, a, l, r, n, score from u where rank <= 2000
"""
