"""The queries of the training-data operators, and their SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.llm import additive_ann, collocations, decontaminate, jaccard_join, mixing, pii, quality, recompression, sort_means, token_store, toxicity, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document: toxicity.py."""
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share nine tenths of their word triples:
    jaccard_join.py."""
    return jaccard_join.similar(_table(spark, sf_dir, "documents"), n=3, percent=90)


#: The rules of the query, in place of a rule file.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: url_rules.py."""
    rules = (*(url_rules.host_rule(action, rule) for action, rule in HOST_RULES), *url_rules.OWN_RULES)
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that each document holds: decontaminate.py."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every 20th vector: additive_ann.py."""
    return additive_ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, as read back: warc.py."""
    return warc.archived(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document: quality.py."""
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: mixing.py."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps where 20 words that stand before go:
    recompression.py."""
    return recompression.dedup(_table(spark, sf_dir, "documents"), 20)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of every document stand, and their checksum, as read from
    the files: token_store.py."""
    return token_store.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document: pii.py."""
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 closest phrases of every language: collocations.py."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector: sort_means.py."""
    return sort_means.clusters(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_url_filters, op4_decontaminate, op5_additive_ann, op6_warc, op7_quality, op8_mixing, op9_recompression, op10_token_store, op11_pii, op12_collocations, op13_sort_means)
}

_HOST_CASES = {
    "org/": r"(\A|\.)org\n/",
    "example.org/es/": r"(\A|\.)example\.org\n/es/",
    "example.org/en/1": r"(\A|\.)example\.org\n/en/1",
    "com/fr/": r"(\A|\.)com\n/fr/",
    "com/de/": r"(\A|\.)com\n/de/",
}
_BY_LENGTH = sorted(HOST_RULES, key=lambda r: -len(r[1]))
_OWN = " or ".join(f"regexp_matches(u, '{r.pattern}')".replace(r"\Z", r"\z").replace(r"(?:\A", r"(?:^") for r in url_rules.OWN_RULES)
_FITS = " ".join(f"when regexp_matches(u, '{_HOST_CASES[rule]}') then '{rule}'" for _, rule in _BY_LENGTH)
_ACTION = " ".join(f"when '{rule}' then '{action}'" for action, rule in HOST_RULES)

_SEEDS, _ROUNDS, _DIM = 16, 3, 64
_NEAREST = """
a{i} as materialized (
  select p, vec_id, x, min_by(c, d * {seeds} + c)::int as cluster, min(d) as distance from (
    select v.p, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v, c{i} m)
  group by all)"""
_MOVED = """
c{j} as materialized (
  select c, coalesce(n.x, m.x) as x from c{i} m left join (
    select cluster as c, list(q order by place) as x from (
      select cluster, place, (sum(y)::bigint - ((sum(y)::bigint % count(*)) + count(*)) % count(*)) // count(*) as q from (select cluster, unnest(x) as y, generate_subscripts(x, 1) as place from a{i}) group by cluster, place)
    group by cluster) n using (c))"""

ORACLE: dict[str, str] = {
    "op12_collocations": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), p as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as k from pieces
), g as (
  select lang, size, unnest(list_transform(range(1, len(k) - size + 2), lambda i: array_to_string(k[i:i + size - 1], ' '))) as phrase from p, range(1, 6) s(size)
), f as materialized (
  select lang, size, phrase, count(*)::bigint as a from g group by all
), total as (
  select lang, sum(a)::bigint as n from f where size = 1 group by lang
), c as (
  select * from f where size > 1 and a >= 100
), kept as (
  select * from c where not exists (select 1 from c o where o.lang = c.lang and o.size > c.size and 100 * o.a >= 100 * c.a and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts as (
  select lang, size, phrase, a, string_split(phrase, ' ') as k, unnest(range(1, size)) as cut from kept
), parts as (
  select cuts.lang, cuts.phrase, cuts.a, cut, l.a as l, r.a as r, n, ((1000::hugeint * cuts.a * n) // (l.a::hugeint * r.a))::bigint as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = array_to_string(k[1:cut], ' ') join f r on r.lang = cuts.lang and r.phrase = array_to_string(k[cut + 1:], ' ') join total on total.lang = cuts.lang
), lowest as (
  select * from parts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
)
select lang, rank, phrase, a, l, r, n, score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank from lowest) where rank <= 2000""",
    "op13_sort_means": f"""
with v as materialized (
  select row_number() over () as p, vec_id, list_transform(embedding, lambda y: floor({_DIM} * y::double)::bigint) as x from embeddings
  where len(embedding) = {_DIM} and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
), c0 as materialized (
  select row_number() over (order by h, x) - 1 as c, x from (select *, sha256('1:' || vec_id) as h from v where vec_id is not null order by h, x limit {_SEEDS})
), {",".join(_NEAREST.format(i=i, seeds=_SEEDS) + "," + _MOVED.format(i=i, j=i + 1) for i in range(_ROUNDS))},{_NEAREST.format(i=_ROUNDS, seeds=_SEEDS)}
select vec_id, cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
from a{_ROUNDS} join c{_ROUNDS} m on m.c = cluster""",
    "op2_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as k from documents
), s as (
  select distinct doc_id, unnest(case when len(k) >= 3 then list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) when len(k) > 0 then [array_to_string(k, ' ')] else []::varchar[] end) as g from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), sig as (
  select doc_id, n, md5(string_agg(md5(g), '' order by g)) as sig from s join n using (doc_id) group by doc_id, n
), rep as (
  select sig, n, min(doc_id) as rep from sig group by sig, n
), r as (
  select rep, n, g from rep join s on s.doc_id = rep.rep
), p as (
  select a.rep as a, b.rep as b, a.n as an, b.n as bn, count(*) as c from r a join r b on a.g = b.g and a.rep < b.rep and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) group by all
), l as (
  select a, b from p where 100 * c >= 90 * (an + bn - c) union all select b, a from p where 100 * c >= 90 * (an + bn - c)
), t as (
  select rep as node, rep as m from rep union select t.node, l.b from t join l on l.a = t.m
), o as (
  select node, min(m) as component_id from t group by node
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(o.component_id, w.doc_id) as component_id
from w left join n using (doc_id) left join sig on sig.doc_id = w.doc_id left join rep on rep.sig = sig.sig and rep.n = sig.n left join o on o.node = rep.rep""",
    "op9_recompression": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as k from documents
), x as (
  select doc_id, unnest(k) as word, generate_subscripts(k, 1) as pos, len(k) as n from w
), v as (
  select doc_id, word, pos, case when pos + 19 <= n then md5(string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 19 following)) end as g from x
), f as (
  select *, case when g is not null and row_number() over (partition by g order by doc_id, pos) > 1 then 1 else 0 end as again from v
), c as (
  select doc_id, word, pos, sum(again) over (partition by doc_id order by pos rows between 19 preceding and current row) > 0 as gone from f
), a as (
  select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept from c group by doc_id
)
select w.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join a using (doc_id)""",
    "op3_url_filters": f"""
with cut as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), both_parts as (
  select *, host || chr(10) || path as u from parts
), ruled as (
  select *, case {_FITS} end as rule from both_parts
)
select page_id, host, path, rule,
  case when rule is not null then (case rule {_ACTION} end) when {_OWN} then 'block' else 'allow' end as verdict
from ruled""",
    "op6_warc": """
with p as (
  select page_id, coalesce(html, '') as payload, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), g as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first from p
)
select page_id, payload_bytes, payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from g""",
    "op8_mixing": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as total from d group by source
), w as (
  select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, 2.0::double * total as cap from s
), t as (
  select *, 1.5::double * sum(total) over () as pool,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest
  from w
), l as (
  select min_by((pool - capped) / rest, cap / weight) as level from t where (pool - capped) / rest <= cap / weight
), g as (
  select source, total, least(cap, weight * coalesce(level, cap / weight)) as target from t, l
), k as (
  select d.*, g.total, g.target, round(g.target)::bigint as budget,
    coalesce(sum(size) over (partition by d.source order by substr(md5('mix|' || doc_id), 1, 13), doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join g on d.source is not distinct from g.source
)
select doc_id, size, total as source_size, target,
  (case when total > 0 then budget // total else 0 end * size
   + greatest(0, least(budget - (case when total > 0 then budget // total else 0 end) * total - before, size)))::bigint as taken
from k""",
}
