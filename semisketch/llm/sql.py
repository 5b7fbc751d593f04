"""DuckDB SQL for the rows of the queries, where SQL can express them."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_scan import HOLDER_LINE, KNOWN, NOT_WORD, SIGNS, SPELLINGS

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWERED = f"'{UPPER}', '{LOWER}'"

LINE_DEDUP = f"""
with lines as (
  select doc_id, i, line, translate(trim(line, {BLANKS}), {LOWERED}) as key
  from (select doc_id, unnest(l) as line, unnest(range(len(l))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
), held as (
  select key, max(doc_id) as last_doc from lines where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
), marked as (
  select l.*, h.key is not null and l.doc_id < h.last_doc as dropped
  from lines l left join held h using (key)
)
select doc_id, count(*) as n_lines, sum(dropped::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""


def _canonical(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(translate(coalesce({text}, ''), {LOWERED}), {quoted(HOLDER_LINE)}, '', 'g')"
    form = f"translate({form}, {quoted(SIGNS)}, {quoted(' ' * len(SIGNS))})"
    form = f"trim(regexp_replace({form}, {quoted(NOT_WORD)}, ' ', 'g'), ' ')"
    for spelling, one in SPELLINGS:
        pattern = rf"\b(?:{spelling})\b" if "$1" not in one else rf"\b{spelling}\b"
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(one.replace('$1', chr(92) + '1'))}, 'g')"
    return form


def license_scan(documents: str = "documents") -> str:
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    return f"""
with known as (
  select sha256({_canonical('text')}) as digest, min(license_id) as license_id
  from (values {known}) k(license_id, text) group by 1
), scanned as (select doc_id, sha256({_canonical('text')}) as digest from {documents})
select doc_id, digest, license_id from scanned left join known using (digest)
"""


def planted_licenses() -> str:
    """The scan of documents of which every tenth is a licence in another spelling."""
    texts = ", ".join("'{}'".format(t.replace("'", "''")) for _, t in KNOWN)
    text = f"[{texts}][(doc_id // 10) % {len(KNOWN)} + 1]"
    spelt = f"'Copyright (c) 2020 Someone' || chr(10) || replace(upper({text}), ', ', ' ; ')"
    return license_scan(f"(select doc_id, case when doc_id % 10 = 0 then {spelt} else text end as text from documents)")


MIXING = r"""
with docs as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as ticket from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from docs group by source
), levels as (
  select *, (1.5::double * sum(source_size) over ()
             - coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last
                        rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by 2 * source_size / weight, source nulls last
                        rows between current row and unbounded following) as level
  from sources
), goals as (
  select source, source_size, least(weight * max(level) over (), 2.0::double * source_size) as target from levels
), placed as materialized (
  select row_number() over () as item, doc_id, d.source, size, ticket, source_size, target,
         (sum(size) over (partition by d.source order by ticket, doc_id nulls first, size rows unbounded preceding) - size)::bigint as before
  from docs d join goals g on d.source is not distinct from g.source
), copies as (
  select *, (turn * source_size + before + size) / target as finish
  from (select *, unnest([0, 1]) as turn from placed where size > 0 and target > 0)
), queue as (
  select item, size, sum(size) over (order by finish, ticket, doc_id nulls first, size, coalesce('=' || source, ''), turn
                                     rows unbounded preceding) as done from copies
), mix as (
  select item, sum(size)::bigint as taken from queue where done <= 1.5::double * (select sum(size) from docs) group by item
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from placed left join mix using (item)
"""


JACCARD = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
  select distinct doc_id, g from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g
    from words)
), sizes as (select doc_id, count(*) as n from grams group by doc_id
), links as (
  select x.doc_id as a, y.doc_id as b from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id
  join sizes s on s.doc_id = x.doc_id join sizes t on t.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, s.n, t.n having 100 * count(*) >= 85 * (s.n + t.n - count(*))
), reach(doc_id, other) as (
  select a, b from links union select r.doc_id, l.b from reach r join links l on r.other = l.a
)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id
from words left join sizes using (doc_id)
left join (select doc_id, min(other) as m from reach group by doc_id) using (doc_id)
"""

USABLE = """
vectors as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""

NEAREST = f"""
with {USABLE}, scored as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score
  from vectors q join vectors v on v.vec_id <> q.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

NEAR_VECTORS = f"""
with recursive {USABLE}, links as (
  select x.vec_id as a, y.vec_id as b from vectors x join vectors y on x.vec_id <> y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.95
), reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), found as (
  select vec_id, (select count(*) from links where a = vec_id) as n_links,
         least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as component_id
  from embeddings
)
select vec_id, n_links, component_id, vec_id = component_id as kept from found
"""

TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

RANKED_SEARCH = f"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), {TERM})) as term from documents
), wanted as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), {TERM})) as term from benchmark)
  group by item_id, term
), sizes as (select doc_id, count(*) as n from terms group by doc_id
), totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes
), counts as (
  select doc_id, term, count(*) as tf from terms where term in (select term from wanted) group by doc_id, term
), weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from counts, totals group by term, n_docs
), scored as (
  select item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::bigint as score
  from wanted join counts using (term) join weights using (term) join sizes using (doc_id), totals
  group by item_id, doc_id
), ranked as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""

# the checksum goes through a feature's bytes, eight steps each (its polynomial is a fixed value)
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, length(hex(feature)), 2), lambda i: ('0x' || hex(feature)[i:i + 1])::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

RESAMPLING = f"""
with words as (
  select true as own, doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), {TERM}) as w from documents
  union all
  select false, item_id, regexp_extract_all(translate(coalesce(text, ''), {LOWERED}), {TERM}) from benchmark
), features as (
  select own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from words
), hashed as (
  select feature, {_CRC} % 10000 as bucket from (select distinct feature from features)
), counts as (
  select bucket, count(*) filter (own) as s, count(*) filter (not own) as t from features join hashed using (feature) group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double
                               / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain from counts
), weights as (
  select doc_id, floor(sum(gain)::double / count(*))::bigint as weight
  from features join hashed using (feature) join gains using (bucket) where own group by doc_id
), scored as (
  select doc_id, len(w)::bigint as n_words, greatest(2 * len(w) - 1, 0)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from words left join weights using (doc_id) where own
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_words >= 20
)
select doc_id, n_features, weight, score, case when rank <= (25 * (select count(*) from ranked)) // 100 then rank end as rank
from scored left join ranked using (doc_id)
"""
