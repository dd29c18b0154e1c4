"""Queries over the whole tables, one per operator, with production parameters, and the pipeline."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, embedding, exactdedup, langid, licenses, linededup, packing, prefixtrie, quality, simhash, spelling, substrings
from ._common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def learnable(docs: DataFrame) -> tuple[DataFrame, F.Column]:
    """The rows that language ID may learn from, and the condition of the held-out ones. A row without an id is neither
    learned from nor held out."""
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2
    return docs.where(~held_out), F.coalesce(held_out, F.lit(False))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = f"""
with d as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
l as (select distinct doc_id, source, trim(line, E' \\t\\r') as line from (select doc_id, source, unnest(lines) as line from d) where trim(line, E' \\t\\r') <> ''),
t as (select source, count(*) as total from d group by source),
b as (select l.source, l.line from l join t on l.source is not distinct from t.source group by l.source, l.line, t.total
      having count(*) >= {linededup.MIN_PAGES} and count(*) > t.total * cast({linededup.RATIO} as double)),
h as (select source, list(line) as bad from b group by source),
k as (select d.doc_id, d.text, d.lines, list_filter(d.lines, lambda x: trim(x, E' \\t\\r') = '' or h.bad is null or not list_contains(h.bad, trim(x, E' \\t\\r'))) as kept
      from d left join h on d.source is not distinct from h.source)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(kept), 0) as n_dropped,
       case when text is not null then sha256(array_to_string(kept, chr(10))) end as text_sha256 from k
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn, held_out = learnable(docs)
    out = langid.identify(docs, langid.sample(learn))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    out = bpe.encode_decode(docs, path, bpe.lexicon(bpe.word_counts(docs, path), path))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select vec_id, e from v where vec_id is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {embedding.THRESHOLD}),
r(id, c) as (select vec_id, vec_id from v union select l.b, r.c from r join l on l.a = r.id)
select v.vec_id as vec_id, (select count(*) from l where l.a = v.vec_id) as n_links, c as component_id, v.vec_id = c as kept from v join (select id, min(c) as c from r group by id) on id = v.vec_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


_OP5_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_OP5_NOTICES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(licenses.TEMPLATES.items()))
_OP5_SHINGLES = f"unnest(list_transform(range(len(w) - {licenses.SHINGLE - 1}), lambda i: {{'pos': i, 's': list_slice(w, (i + 1)::int, (i + {licenses.SHINGLE})::int)}})) as p"
OP5_SQL = f"""
with t as (select license_id, s from (select license_id, p.s as s from (select license_id, {_OP5_SHINGLES} from (select license_id, {_OP5_WORDS} as w from (values {_OP5_NOTICES}) n(license_id, text)))) group by all),
size as (select license_id, count(*) as size from t group by 1),
d as (select doc_id, p.pos as pos, p.s as s from (select doc_id, {_OP5_SHINGLES} from (select doc_id, {_OP5_WORDS} as w from documents) where len(w) >= {licenses.SHINGLE})),
h as (select doc_id, license_id, count(distinct s) as held, min(pos) + 1 as first_word, max(pos) + {licenses.SHINGLE} as last_word from d join t using (s) group by 1, 2)
select doc_id, license_id, held / size as containment, first_word, last_word from h join size using (license_id) where held / size >= {licenses.CONTAINMENT}
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").drop("locator")


OP7_SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(rows))


_OP8_TEXT = r"\### Assistant: </turn> ok"
_OP8_ESCAPED = lambda c: f"length({c}) + length(regexp_replace({c}, '[^\\\\#<]', '', 'g'))"
_OP8_ROLE = "case role when 'system' then 6 when 'user' then 4 when 'assistant' then 9 else 5 + " + _OP8_ESCAPED("role") + " + length(regexp_replace(role, '[^:]', '', 'g')) end"
OP8_SQL = f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '{_OP8_TEXT}' union all select -7, 1, 'assistant', '{_OP8_TEXT}'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, sum(4 + ({_OP8_ROLE}) + 2 + {_OP8_ESCAPED("text")} + 9)::bigint as formatted_chars from c group by conv_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False).drop("ids")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: CRC-32 in SQL: the table of its polynomial, and the sum over a list ``b`` of bytes.
_CRC_TABLE = "select list(c order by i) as crc from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295, b::bigint[]), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"
OP11_SQL = f"""
with recursive t as ({_CRC_TABLE}),
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
o as (select doc_id, run, count(*) as n from r where length(run) >= {spelling.LEAST_LENGTH} group by all),
e as (select run, n, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)] else [195, unicode(ch) - 64] end)) as b from o),
h as (select run, n, {_CRC} as h from e, t),
w as (select case when h % {spelling.DAMAGE} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n from h group by 1 having length(word) >= {spelling.LEAST_LENGTH} and sum(n) >= {spelling.LEAST_COUNT}),
d as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from w)),
p as (select a.word as word, b.word as other, b.n as other_n from d a join d b on a.i = b.i and a.rest = b.rest and a.word <> b.word
 union select a.word, b.word, b.n from d a join w b on a.rest = b.word union select b.word, a.word, a.n from d a join w b on a.rest = b.word),
m as (select word, count(*) as n_near, first(other order by other_n desc, other) as best, max(other_n) as best_n from p group by word),
f as (select w.word as word, n, coalesce(n_near, 0) as n_near, case when best_n >= {spelling.RATIO} * n then best end as form, case when best_n >= {spelling.RATIO} * n then best_n end as form_n from w left join m on w.word = m.word),
c(word, place) as (select word, word from f union all select c.word, f.form from c join f on c.place = f.word where f.form is not null)
select f.word as word, f.form as form, c.place as root, f.n as n, f.n_near as n_near, f.form_n as form_n from f join c on c.word = f.word join f e on e.word = c.place and e.form is null
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
with t as ({_CRC_TABLE}),
q as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as seq, list_transform(string_split(conv_id::varchar, ''), lambda ch: unicode(ch)) as b
 from conversations where conv_id is not null group by conv_id),
c as (select conv_id, seq, ({_CRC} % {prefixtrie.SHARED})::int as h from q, t),
s as (select a.conv_id as conv_id, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) as seq from c a left join c b on b.conv_id = a.conv_id - a.conv_id % {prefixtrie.BLOCK}),
x as (select conv_id, seq, unnest(range(len(seq) + 1))::int as depth from s),
n as (select list_slice(seq, 1, depth) as k, depth, min(conv_id) as lo, count(*) as n, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(seq) = depth) as ends from x group by 1, 2),
k as (select list_slice(k, 1, depth - 1) as k, count(*) as n from n where depth > 0 group by 1),
a as (select n.*, coalesce(k.n, 0) as children, p.lo as parent from n left join k on n.k = k.k left join n p on n.depth > 0 and p.depth = n.depth - 1 and p.k = list_slice(n.k, 1, n.depth - 1))
select a.lo as conv_id, a.depth::bigint as depth, any_value(a.parent) as parent_conv_id, any_value(a.n) as n_convs, any_value(a.children) as n_children, count(*) filter (b.children = 0) as n_leaves,
 sum(case when b.depth > 0 then (b.n - 1) * length(b.k[b.depth].text) else 0 end)::bigint as saved_tokens, sha256(coalesce(any_value(a.ends), '')) as ends_sha256
from a join a b on b.depth >= a.depth and list_slice(b.k, 1, a.depth) = a.k group by a.lo, a.depth
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
g as (select r, doc_id, i, md5(array_to_string(list_slice(w, i::int, i::int + {substrings.WINDOW - 1}), ' ')) as h from (select *, unnest(range(1, len(w) - {substrings.WINDOW - 2})) as i from d)),
m as (select h, min(doc_id) as least from g group by h),
b as (select distinct r, unnest(range(i, i + {substrings.WINDOW})) as i from g join m on g.h = m.h where m.least < g.doc_id or (g.doc_id is null and m.least is not null)),
p as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
k as (select p.r as r, count(b.i) as n_removed, string_agg(p.x, ' ' order by p.i) filter (b.i is null) as kept from p left join b on p.r = b.r and p.i = b.i group by p.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k on d.r = k.r
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_language_id, op3_bpe, op4_embedding_near_dedup, op5_license_scan, op6_quality, op7_exact_dedup, op8_chat, op9_packing, op10_simhash, op11_spelling_variants, op12_prefix_trie, op13_substring_dedup)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_embedding_near_dedup": OP4_SQL, "op5_license_scan": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_chat": OP8_SQL,
            "op11_spelling_variants": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL}
