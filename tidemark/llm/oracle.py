"""DuckDB SQL for queries that SQL can express, written by hand from their contracts."""

from __future__ import annotations

WARC = r"""
with p as (select page_id, coalesce(url, '') as uri, coalesce(html, '') as html from pages),
a as (select *, regexp_replace(html, '<!--(?s:.*?)-->', '', 'g') as x from p),
b as (select *, regexp_replace(x, '<[sS][cC][rR][iI][pP][tT]([\t\n\v\f\r /][^>]*)?>(?s:.*?)</[sS][cC][rR][iI][pP][tT]([\t\n\v\f\r /][^>]*)?>', '', 'g') as y from a),
c as (select *, regexp_replace(y, '<[sS][tT][yY][lL][eE]([\t\n\v\f\r /][^>]*)?>(?s:.*?)</[sS][tT][yY][lL][eE]([\t\n\v\f\r /][^>]*)?>', '', 'g') as z from b),
d as (select *, regexp_replace(z, '<[hH][eE][aA][dD]([\t\n\v\f\r /][^>]*)?>(?s:.*?)</[hH][eE][aA][dD]([\t\n\v\f\r /][^>]*)?>', '', 'g') as body from c),
e as (select *, regexp_replace(body, '<([bB][rR]|/([pP]|[dD][iI][vV]|[lL][iI]|[hH][1-6]|[tT][rR]|[tT][iI][tT][lL][eE]|[aA][rR][tT][iI][cC][lL][eE]|[nN][aA][vV]|[uU][lL]))[^>]*>', chr(10), 'g') as broken from d),
f as (select *, replace(replace(replace(replace(replace(replace(regexp_replace(broken, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as plain from e),
g as (select *, trim(regexp_replace(regexp_replace(plain, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as text, md5('response|' || coalesce(page_id::varchar, '') || '|' || uri) as h from f),
r as (select *, '<urn:uuid:' || regexp_replace(h, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' as refers_to from g),
k as (select *, md5(record_type || '|' || refers_to) as own from r, (values ('metadata'), ('conversion')) v(record_type))
select page_id, record_type, '<urn:uuid:' || regexp_replace(own, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') || '>' as record_id, refers_to, uri as target_uri,
       'sha256:' || sha256(html) as source_digest, regexp_extract(html, '<[tT][iI][tT][lL][eE][^>]*>([^<]*)', 1) as title,
       case record_type when 'conversion' then sha256(text) else '' end as text_sha256,
       case record_type when 'conversion' then strlen(text) else -1 end::bigint as text_bytes,
       case record_type when 'metadata' then len(regexp_extract_all(html, '<[aA][\t\n\v\f\r ]')) else -1 end::bigint as n_links
from k"""

FIM = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h from documents),
l as (select doc_id, t, h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines from d),
n as (select *, len(lines)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
             ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from l),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as q,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from n),
s as (select *, array_to_string(list_slice(lines, 1, p), '') as prefix, array_to_string(list_slice(lines, p + 1, q), '') as middle,
             array_to_string(list_slice(lines, q + 1, n), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
       case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from s"""


def clusters(k: int = 40, rounds: int = 5, seed: str = "2", size: int = 64, scale: int = 256) -> str:
    """Each round: the nearest centroid by squared distance, then floors of the clusters' means."""
    parts = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
            where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = {size})""",
        f"""c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select v, sha256('{seed}:' || coalesce(vec_id::varchar, '')) as h from kept
            qualify row_number() over (order by h, v) <= {k}))""",
    ]
    for i in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(v, m), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint"
        parts.append(f"a{i} as materialized (select r, vec_id, v, c as cluster, d as distance from (select *, {away} as d from kept, c{i}) qualify row_number() over (partition by r order by d, c) = 1)")
        if i < rounds:
            parts.append(f"u{i} as (select cluster, j, sum(v[j])::bigint as s, count(*) as n from a{i}, (select unnest(range(1, {size} + 1)) as j) group by cluster, j)")
            parts.append(f"w{i} as (select cluster, list((s - ((s % n) + n) % n) // n order by j) as m from u{i} group by cluster)")
            parts.append(f"c{i + 1} as materialized (select c, coalesce(w{i}.m, c{i}.m) as m from c{i} left join w{i} on c = cluster)")
    return (
        "with " + ",\n".join(parts) + f"""
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
       sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} on cluster = c"""
    )
