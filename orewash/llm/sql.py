"""SQL twins of the queries that SQL can express; DuckDB runs them over the same tables."""

from __future__ import annotations

# Words outside ASCII white space; a window is known by a hash of its words, a repeated one by its place in their order.
OP2_SUBSTRINGS = r"""
with texts as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
placed as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as place from texts),
windows as (
    select doc_id, place, row_number() over (partition by sha256(array_to_string(words, ' ')) order by doc_id, place) as copy
    from (select doc_id, place, list(word) over (partition by doc_id order by place rows between current row and 19 following) as words from placed)
    where len(words) = 20),
gone as (select distinct doc_id, unnest(range(place, place + 20)) as place from windows where copy > 1),
kept as (
    select doc_id, count(*) as n_kept, string_agg(word, ' ' order by place) as text
    from placed anti join gone using (doc_id, place) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
    sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join kept using (doc_id)
"""

# Equal lines of two places that lie as far apart as those before and after them are one run.
OP7_LINES = r"""
with texts as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
placed as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from texts where text is not null),
pairs as (
    select later.doc_id, later.place, length(later.line) as chars, earlier.doc_id as other, later.place - earlier.place as apart
    from placed later join placed earlier on later.line = earlier.line
    where (earlier.doc_id, earlier.place) < (later.doc_id, later.place)),
runs as (
    select doc_id, min(place) as first, count(*) as n
    from (select *, place - row_number() over (partition by doc_id, other, apart order by place) as run from pairs)
    group by doc_id, other, apart, run having sum(chars) >= 10),
longest as (select doc_id, max(n) as n from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(first, first + n)) as place from (select doc_id, first, max(n) as n from runs group by all)),
kept as (select doc_id, count(*) as n_kept, string_agg(line, chr(10) order by place) as text from placed anti join gone using (doc_id, place) group by doc_id)
select doc_id, cast(coalesce(len(lines), 0) as bigint) as n_lines, cast(coalesce(len(lines), 0) - coalesce(n_kept, 0) as bigint) as n_removed,
    cast(coalesce(pow(2, floor(log2(longest.n))), 0) as bigint) as longest_run, sha256(coalesce(kept.text, '')) as kept_sha256
from texts left join kept using (doc_id) left join longest using (doc_id)
"""

OP13_NEGATIVES = """
with rows as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
    select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_dot_product(a.x, b.x) as bigint) as score
    from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where own = label
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
    vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where own <> label and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

ORACLES = {"op2_substrings": OP2_SUBSTRINGS, "op7_lines": OP7_LINES, "op13_negatives": OP13_NEGATIVES}
