"""DuckDB SQL for the corpus operators whose whole result SQL can express: repeated
windows of words and repeated strings of bytes are equal values of a key there. Keys
are MD5 sums of whole windows."""

from __future__ import annotations

from .secret_scan import BASE, RULES

#: Words covered by a 50-word window that a document with a smaller id has, too.
SUBSTRING_DEDUP = r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
    select doc_id, unnest(range(1, len(words) - 48)) as p, unnest([md5_number(array_to_string(words[s:s + 49], ' ')) for s in range(1, len(words) - 48)]) as k
    from split where len(words) >= 50),
lowest as (select k, min(doc_id) as low from windows group by k),
covered as (select distinct doc_id, unnest(range(p, p + 50)) as i from windows join lowest using (k) where low < doc_id),
placed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from split),
marked as (select p.doc_id, p.word, p.i, c.i is not null as gone from placed p left join covered c on c.doc_id = p.doc_id and c.i = p.i)
select d.doc_id, count(m.word) as n_words, count(*) filter (where m.gone) as n_removed,
    sha256(coalesce(string_agg(m.word, ' ' order by m.i) filter (where not m.gone), '')) as kept_sha256
from documents d left join marked m on m.doc_id = d.doc_id group by d.doc_id
"""

#: Bytes covered by a 100-byte string that starts earlier, too. Two hex digits are a
#: byte; starts of repeated strings at most 100 apart belong to one removed run.
SUFFIX_DEDUP = """
with bytes as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
strings as (
    select doc_id, unnest(range(1, n - 98)) as p, unnest([md5_number(substr(x, 2 * s - 1, 200)) for s in range(1, n - 98)]) as k
    from bytes where n >= 100),
again as (select doc_id, p from strings qualify row_number() over (partition by k order by doc_id, p) > 1),
opened as (select doc_id, p, p - lag(p, 1, -1000) over (partition by doc_id order by p) > 100 as opens from again),
numbered as (select doc_id, p, count(*) filter (where opens) over (partition by doc_id order by p) as run from opened),
runs as (select doc_id, run, min(p) as a, max(p) + 100 as b from numbered group by doc_id, run),
pieces as (
    select doc_id, coalesce(lag(b) over (partition by doc_id order by run), 1) as a, a as b from runs
    union all select doc_id, max(b), null from runs group by doc_id),
kept as (
    select p.doc_id, string_agg(substr(x, 2 * p.a - 1, 2 * (coalesce(p.b, n + 1) - p.a)), '' order by p.a) as x
    from pieces p join bytes using (doc_id) group by p.doc_id),
removed as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from runs group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, bytes.x))) as kept_sha256
from bytes left join removed using (doc_id) left join kept using (doc_id)
"""

#: Runs of words: stretches of six-word windows that repeat at one distance. The checksum
#: of the decimal id is made bit by bit.
PERIODIC_RUNS = r"""
with split as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[(ord(c) >> j) & 1 for j in range(8)] for c in string_split(cast(doc_id as varchar), '')])),
            lambda crc, bit: xor(crc >> 1, case when xor(crc, bit) & 1 = 1 then 3988292384 else 0 end))) as h
    from documents),
made as (select doc_id, w, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from split),
docs as (
    select doc_id, n, case when a is null then w else list_concat(w[1:a], [w[a + 1 + i % (1 + (n - a) // (3 + g % 8))] for i in range(n - a)]) end as words
    from made),
windows as (
    select doc_id, n, unnest(range(n - 5)) as i, unnest([md5_number(array_to_string(words[s:s + 5], ' ')) for s in range(1, n - 4)]) as k
    from docs where n >= 12),
pairs as (select x.doc_id, x.i, y.i - x.i as q from windows x join windows y on x.doc_id = y.doc_id and x.k = y.k and y.i > x.i and 2 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as s, max(i) + 6 + q as e from islands group by doc_id, q, island),
runs as (select doc_id, s, e - s as n, min(q) as q from stretches where e - s >= greatest(12, 2 * q) group by doc_id, s, e),
best as (select doc_id, s, n, q from runs qualify row_number() over (partition by doc_id order by n desc, s, q) = 1),
listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as x from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + n)) as i from runs),
placed as (select doc_id, unnest(words) as word, unnest(range(n)) as i from docs),
kept as (select doc_id, string_agg(word, ' ' order by i) as x from placed anti join dropped using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(l.n_runs, 0) as n_runs, b.s as start, b.n as length, b.q as period, 1000 * b.n // b.q as exponent_milli,
    sha256(coalesce(l.x, '')) as runs_sha256, sha256(coalesce(k.x, '')) as collapsed_sha256
from docs d left join listed l using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""

#: Nodes are JSON texts of prefixes; a node's subtree are the nodes whose smallest member
#: has it as a prefix.
PREFIX_TRIE = r"""
with own as (
    select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first) as l,
        xor(4294967295, list_reduce(list_prepend(4294967295, flatten([[(ord(c) >> j) & 1 for j in range(8)] for c in string_split(cast(conv_id as varchar), '')])),
            lambda crc, bit: xor(crc >> 1, case when xor(crc, bit) & 1 = 1 then 3988292384 else 0 end))) % 4 as h
    from conversations where conv_id is not null group by conv_id),
made as (
    select x.conv_id, case when y.l is null then x.l[x.h + 1:] else list_concat(y.l[1:x.h], x.l[x.h + 1:]) end as l
    from own x left join own y on y.conv_id = x.conv_id - x.conv_id % 20),
places as (select conv_id, l, unnest(range(len(l) + 1)) as d from made),
occurs as (
    select conv_id, d, len(l) = d as last, md5(cast(to_json(l[1:d]) as varchar)) as k, case when d > 0 then md5(cast(to_json(l[1:d - 1]) as varchar)) end as p,
        case when d > 0 then len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) else 0 end as words
    from places),
nodes as (
    select d, k, any_value(p) as p, min(conv_id) as c, count(*) as n, any_value(words) as words,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where last), '')) as ends_sha256
    from occurs group by d, k),
kids as (select p, d - 1 as d, count(*) as n from nodes where d > 0 group by p, d),
known as (select x.*, coalesce(y.n, 0) as n_children, (x.n - 1) * x.words as saved from nodes x left join kids y on y.p = x.k and y.d = x.d),
below as (
    select o.d, o.k, count(*) filter (where x.n_children = 0) as n_leaves, cast(sum(x.saved) as bigint) as saved
    from known x join occurs o on o.conv_id = x.c and o.d <= x.d group by o.d, o.k)
select x.c as conv_id, x.d as depth, y.c as parent_conv_id, x.n as n_convs, x.n_children, b.n_leaves, b.saved as saved_tokens, x.ends_sha256
from known x join below b on b.d = x.d and b.k = x.k left join nodes y on y.d = x.d - 1 and y.k = x.p
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Matches of every rule; their places from the lengths of the pieces between them.
SECRET_SCAN = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
rules as (select * from (values {", ".join(f"({k}, {_quoted(r.kind)}, {r.kind in [b.kind for b in BASE]})".lower() for k, r in enumerate(RULES))}) r(place, kind, base)),
hits as ({" union all ".join(f"""
    select doc_id, {k} as place, {r.least} as least, unnest(regexp_extract_all(t, {_quoted(r.pattern)})) as m, unnest(regexp_extract_all(t, {_quoted(r.pattern)}, {r.group})) as v,
        unnest(string_split_regex(t, {_quoted(r.pattern)})[:-2]) as gap, unnest(range(len(regexp_extract_all(t, {_quoted(r.pattern)})))) as i
    from texts where regexp_matches(t, {_quoted(r.pattern)})""" for k, r in enumerate(RULES))}),
placed as (select *, sum(length(gap) + length(m)) over (partition by doc_id, place order by i) as e from hits),
spans as (
    select doc_id, place, kind, base, cast(e - length(m) as bigint) as s, kind || ':' || cast(e - length(m) as bigint) || ':' || cast(e as bigint) as x
    from placed join rules using (place) where length(v) >= least)
select d.doc_id, {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)},
    sha256(coalesce(string_agg(x, ',' order by s, place) filter (where base), '')) as base_sha256, coalesce(string_agg(x, ',' order by s, place), '') as spans
from documents d left join spans using (doc_id) group by d.doc_id
"""

ORACLE_SQL = {"op12_prefix_trie": PREFIX_TRIE, "op13_secret_scan": SECRET_SCAN, "op11_periodic_runs": PERIODIC_RUNS, "op3_substring_dedup": SUBSTRING_DEDUP, "op7_suffix_dedup": SUFFIX_DEDUP}
