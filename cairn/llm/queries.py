"""The opN_ queries: thin wrappers that apply each operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, decontaminate, language, line_dedup, ngram_jaccard, quality, token_files, url_filter, warc
from cairn.llm.common import table


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.ngram_jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_repeats=True)


def op4_warc(spark, sf_dir):
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op5_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids")


def op7_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_token_files(spark, sf_dir):
    return token_files.token_file_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_language_id(spark, sf_dir):
    return language.language_id(table(spark, sf_dir, "documents")).withColumn("languages", F.to_json("languages"))


def op10_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_rules, op3_line_dedup, op4_warc, op5_chat_format, op6_decontaminate, op7_url_filter, op8_token_files, op9_language_id, op10_byte_bpe)}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


_OP1 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) end as grams
  from w),
g as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
c as (select min(doc_id) over (partition by md5(array_to_string(list_sort(grams), chr(10)))) as rep, doc_id, len(grams) as n from s where len(grams) > 0),
f as (select gram, count(*) as df from g where doc_id in (select rep from c) group by gram),
o as (
  select doc_id, n, gram, row_number() over (partition by doc_id order by df, gram) as pos
  from g join f using (gram) where doc_id in (select rep from c)),
p as (select * from o where pos <= n - (9 * n + 9) // 10 + 1),
k as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from p a join p b on a.gram = b.gram and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
v as (select k.a, k.b from k join o x on x.doc_id = k.a join o y on y.doc_id = k.b and y.gram = x.gram group by k.a, k.b, k.na, k.nb having 100 * count(*) >= 90 * (k.na + k.nb - count(*))),
e as (select a, b from v union select b, a from v),
r(id, root) as (select rep, rep from (select distinct rep from c) union select e.b, r.root from r join e on e.a = r.id)
select s.doc_id, len(s.grams)::bigint as n_shingles, coalesce(m.root, s.doc_id) as component_id
from s left join c using (doc_id) left join (select id, min(root) as root from r group by id) m on m.id = c.rep
"""

_OP7 = f"""
with u as (select page_id, url, strpos(coalesce(url, ''), '://') as mark, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from pages),
h as (select *, case when mark = 0 then '' else substr(url, mark + 3) end as rest from u),
p as (select *, regexp_extract(rest, '^[^/?#]*') as raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from h),
q as (select page_id, low, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
rules(rh, rp, rv) as (values {_values(url_filter.RULES)}),
best as (
  select q.*, (select max_by(struct_pack(rule := rh || rp, verdict := rv), length(rh || rp)) from rules
    where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as hit from q),
strict(term) as (values {_values((t,) for t in url_filter.STRICT)}),
soft(term) as (values {_values((t,) for t in url_filter.SOFT)}),
n as (
  select *, (select count(*) from strict where regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')) as hard,
    (select count(*) from soft where regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')) as mild
  from best)
select page_id, host, path, hit.rule as rule,
  coalesce(hit.verdict, case when hard > 0 or mild >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end) as verdict, hard::int as strict_terms, mild::int as soft_terms
from n
"""

_OP4 = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body) as n, upper(sha1(body)) as hex from p),
f as (select *, min(page_id) over (partition by hex, n) as lead from d),
b as (
  select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint) >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') as digest from f)
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = lead then 'response' else 'revisit' end as record_type,
  case when page_id <> lead then lead end as refers_to
from b
"""

ORACLES = {"op4_warc": _OP4, "op1_ngram_jaccard": _OP1, "op7_url_filter": _OP7}
