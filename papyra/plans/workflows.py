"""Queries of the record workflows: lookups, file names, updates, full validation, statistics, hierarchies, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import numbered, shared_dir
from ..functions import dates, files, text as T
from ..operators import calls, entities, issues, nearest, records, stats, validate
from ..sources import mailbox, sinks, storage, tables
from .catalogue import _FLAGS, _FOUND, _OCRV, _transliterated, _WHOLE, ocr_results, query, read, spread, tags, whole_docs

_EXTRA = f"""{_WHOLE}, full_docs as (select *, case document_id % 5 when 0 then 'not-a-date' when 1 then '2024-03-05T10:00:00Z' when 2 then '2024-03-05' end as made, case when document_id % 4 < 3 then '2024-02-01T00:00:00' end as changed,
 case document_id % 3 when 0 then 'scan ' || document_id || '.PDF' when 1 then '2024-03-05_' || correspondent || '_' || document_type || '.pdf' end as filename from docs)"""


def full_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("document_id")
    return whole_docs(spark, d).withColumns({
        "created": F.when(i % 5 == 0, "not-a-date").when(i % 5 == 1, "2024-03-05T10:00:00Z").when(i % 5 == 2, "2024-03-05"), "modified": F.when(i % 4 < 3, "2024-02-01T00:00:00"),
        "filename": F.when(i % 3 == 0, F.concat(F.lit("scan "), i.cast("string"), F.lit(".PDF"))).when(i % 3 == 1, F.concat(F.lit("2024-03-05_"), "correspondent", F.lit("_"), "document_type", F.lit(".pdf")))})


@query("select doc_id, length(text) > 0 as has_text from documents where doc_id in (3, 5, 8, 1000000)")
def q62_point_lookup(spark, d):
    return tables.by_id(read(spark, d, "documents"), [3, 5, 8, 1_000_000], "doc_id").select("doc_id", (F.length("text") > 0).alias("has_text"))


@query("select n_nationkey as id, n_name as name from nation where n_nationkey in (0, 7, 24)")
def q63_dimension_lookup(spark, d):
    return tables.by_id(read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), [0, 7, 24])


@query("select p_name as name from part group by 1 order by 1 limit 100")
def q64_first_names(spark, d):
    return tables.first_names(tags(spark, d))


@query(f"with {_WHOLE} select document_id from docs where created >= '2024-01-01' and created <= '2024-01-31' and correspondent = 'src1' and document_type = 'en' and length(text) > 0")
def q65_filtered_scan(spark, d):
    return tables.filtered(whole_docs(spark, d), since="2024-01-01", until="2024-01-31", correspondent="src1", document_type="en", has_ocr=True, order="-created").select("document_id")


@query("select extract(quarter from o_orderdate)::int as quarter, count(*) as n from orders where extract(year from o_orderdate) = 1996 group by 1")
def q66_quarters(spark, d):
    o, t = read(spark, d, "orders"), F.col("o_orderdate")
    of = F.coalesce(*[F.when(dates.within(t, *dates.quarter_range(1996, q)), q) for q in (1, 2, 3, 4)])
    return o.select(of.alias("quarter")).where("quarter is not null").groupBy("quarter").agg(F.count("*").alias("n"))


@query("select doc_id from documents where contains(lower(text), 'license')")
def q67_text_search(spark, d):
    return tables.searched(read(spark, d, "documents"), "License").select("doc_id")


@query()
def q68_tag_similarity(spark, d):
    """Every pair of a bounded dimension of tags and spelling variants with its similarity, decision and words."""
    t = tags(spark, d).select("name")
    t = t.unionByName(t.select(F.concat("name", F.lit("s")).alias("name"))).unionByName(spark.createDataFrame([(x,) for p in records.FALSE_PAIRS for x in p], "name string"))
    p = t.select(F.col("name").alias("a")).join(t.select(F.col("name").alias("b")), F.col("a") < F.col("b")).withColumn("score", records.tag_similarity_of("a", "b"))
    from ..functions.similarity import plural_pair

    return p.select("a", "b", "score", (F.col("score") >= records.UNIFY).alias("unify"), records.unified(F.col("a"), F.col("b")).alias("unified"), records.explained(F.col("score"), plural_pair(F.col("a"), F.col("b"))).alias("words"))


@query()
def q69_sequential_match(spark, d):
    """Proposed tags of each part, one after the other, against the tags that there are."""
    known = numbered(tags(spark, d).select("name"), ["name"], "pos")  # the dimension, in the order of its names
    proposed = F.array(F.initcap("p_name"), F.col("p_brand"), F.concat("p_brand", F.lit(" ")), F.col("p_type"))
    return nearest.matched(read(spark, d, "part").select("p_partkey", proposed.alias("tags")), known).select("p_partkey", F.explode("matches").alias("m")).select("p_partkey", "m.tag", "m.match", "m.score")


def _metadata_sql(strict: bool) -> str:
    types = ", ".join(f"'{t}'" for t in validate.DOCUMENT_TYPES)
    kind = f"case when document_type is null or document_type = '' then 'Dokumenttyp fehlt' when document_type not in ({types}) then 'Unbekannter Dokumenttyp' end"
    iso = lambda c: f"try_cast(replace(case when regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') then {c} end, 'Z', '') as timestamp)"
    tidy = lambda c, n: f"regexp_replace(left(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), {n}), '[-\\s]+', '-', 'g')"
    suffix = "regexp_extract(filename, '(\\.[^.]+)$', 1)"
    return rf"""with {_EXTRA}, w as (select *, {iso('made')} as c, {iso('changed')} as m, case when filename is not null and {iso('made')} is not null then strftime({iso('made')}, '%Y-%m-%d') || '_' || {tidy('correspondent', 30)} || '_' || {tidy('document_type', 20)} || {suffix} end as wanted from full_docs),
 e as (select *, list_filter([case when title is null or title = '' then 'Titel fehlt' end, case when title <> '' and length(title) < 3 then 'Titel zu kurz' end, case when length(title) > 255 then 'Titel zu lang' end,
  case when regexp_matches(lower(title), '{validate.PLACEHOLDER}') then 'Titel scheint ein Platzhalter zu sein' end, case when correspondent is null or correspondent = '' then 'Korrespondent fehlt' end, case when length(correspondent) = 1 then 'Korrespondent zu kurz' end, {'' if not strict else kind + ','}
  case when len(tags) < 3 then 'Zu wenige Tags' end, case when len(list_filter(tags, lambda t: length(t) < 2 or length(t) > 50 or regexp_matches(t, '^[0-9]+$'))) > 0 then 'Ungültige Tags gefunden' end,
  case when length(note) > 128 then 'Beschreibung zu lang' when length(note) between 1 and 9 then 'Beschreibung zu kurz' end], lambda x: x is not null) as errors,
  list_filter([{kind}, case when made is not null and c is null then 'Ungültiges Datumsformat für created' end, case when changed is not null and m is null then 'Ungültiges Datumsformat für modified' end, case when c > m then 'Erstellungsdatum liegt nach Änderungsdatum' end,
   case when filename is not null and not regexp_matches(filename, '^\d{{4}}-\d{{2}}-\d{{2}}') then 'Dateiname sollte mit Datum beginnen (YYYY-MM-DD)' end, case when wanted is not null and wanted <> filename then 'Dateiname-Format empfohlen' end], lambda x: x is not null) as warnings from w)
 select document_id, len(errors) = 0 as is_valid, array_to_string({'errors' if strict else "list_concat(errors, list_transform(warnings, lambda x: 'Warnung: ' || x))"}, '; ') as issues, wanted as filename_suggestion from e"""


def _metadata(spark, d, strict):
    return records.metadata(full_docs(spark, d), strict).select("document_id", "is_valid", F.array_join("issues", "; ").alias("issues"), "filename_suggestion")


@query(_metadata_sql(False))
def q70_metadata_full(spark, d):
    return _metadata(spark, d, False)


@query(_metadata_sql(True))
def q71_metadata_strict(spark, d):
    return _metadata(spark, d, True)


_GERMAN = rf"(regexp_matches(lower(x), '[äöüß]') or regexp_matches(lower(x), '({'|'.join(T.GERMAN_ENDINGS)})$') or len(list_intersect(string_split_regex(lower(x), '\s+'), [{', '.join(repr(w) for w in T.GERMAN_SIGNS)}])) > 0)"


@query(f"select doc_id, {_GERMAN} as german from (select doc_id, string_split(text, chr(10))[1] as x from documents)")
def q72_german_hint(spark, d):
    return read(spark, d, "documents").select("doc_id", T.likely_german(F.split_part("text", F.lit("\n"), F.lit(1))).alias("german"))


@query(f"""with {_WHOLE}, e as (select list_filter([case when len(tags) < 2 then 'Zu wenige Tags' when len(tags) > 4 then 'Zu viele Tags' end, case when length(note) > 128 then 'Beschreibung zu lang' end, case when length(title) > 255 then 'Titel zu lang' end], lambda x: x is not null) as e from docs)
 select null::varchar as message, count(*) filter (len(e) = 0) as ok, count(*) filter (len(e) > 0) as failed from e union all select m, 0, count(*) from (select unnest(e) as m from e) group by 1""")
def q73_batch_updates(spark, d):
    return records.batch_outcome(whole_docs(spark, d), records.update_errors())


_PLAIN = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace({_transliterated(c)}, '[^a-zA-Z0-9_\s-]', '', 'g'), '\s+', '_', 'g'), '_{{2,}}', '_', 'g'), '_-')"


_TITLE = "left(string_split(text, chr(10))[1], 200)"
_RESERVED = ", ".join(f"'{x}'" for x in files.RESERVED)


@query(rf"""select doc_id, case when n = '' then 'unnamed_file' when upper(string_split(w, '.')[1]) in ({_RESERVED}) then 'file_' || w else w end as name from (select doc_id, n, trim(left(case when {_PLAIN('n')} = '' then 'document' else {_PLAIN('n')} end, 196) || '.pdf', '.') as w from (select doc_id, replace(replace({_TITLE}, '.', ' '), '/', ' ') as n from documents))""")
def q74_safe_name(spark, d):
    title = F.regexp_replace(F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(200)), "[./]", " ")
    return read(spark, d, "documents").select("doc_id", files.sanitised(F.when(title == "", title).otherwise(F.concat(title, F.lit(".PDF")))).alias("name"))


@query(rf"""with s as (select doc_id, string_split(text, chr(10))[1] as t from documents) select doc_id, regexp_replace('info' || '_' || 'acme' || '_' || left({_PLAIN('t')}, 80) || '_scan_pdfPDF', '_{{2,}}', '_', 'g') || '.pdf' as name from s""")
def q75_mail_name(spark, d):
    return read(spark, d, "documents").select("doc_id", files.mail_attachment_name(F.lit("info@acme.example"), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("scan pdf.PDF")).alias("name"))


@query()
def q76_short_name(spark, d):
    """Names of a first line and a date, within 64 characters."""
    name = F.concat(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(" 2024-05-06.PDF"))
    return spread(read(spark, d, "documents").select("doc_id", name.alias("name"))).select("doc_id", files.shortened(F.col("name"), 64).alias("name"))


@query(r"""select page_id, regexp_replace(url, '[<>:"/\\|?*]', '_', 'g') as windows, replace(url, '/', '_') as posix from pages""")
def q77_platform_names(spark, d):
    return read(spark, d, "pages").select("page_id", files.windows_name(F.col("url")).alias("windows"), files.posix_name(F.col("url")).alias("posix"))


@query(r"""with n as (select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) as n from pages), x as (select *, case when regexp_matches(n, '^.+\.[^.]+$') then regexp_extract(n, '(\.[^.]+)$', 1) else '' end as suffix from n) select page_id, left(n, length(n) - length(suffix)) as stem, suffix from x""")
def q78_stem_suffix(spark, d):
    stem, suffix = files.stem_and_suffix(F.col("url"))
    return read(spark, d, "pages").select("page_id", stem.alias("stem"), suffix.alias("suffix"))


_KIND = "case o_orderkey % 4 when 0 then 'Rechnung' when 1 then 'Quittung' when 2 then 'Kassenbon' else 'Vertrag' end"
_MAIL = f"(select o_orderkey, {_KIND} as kind, o_orderdate as sent from orders)"


def _mails(spark, d):
    k = F.col("o_orderkey") % 4
    kind = F.when(k == 0, "Rechnung").when(k == 1, "Quittung").when(k == 2, "Kassenbon").otherwise("Vertrag")
    return read(spark, d, "orders").select("o_orderkey", kind.alias("kind"), F.col("o_orderdate").alias("sent"), F.lit("Example <info@acme.example>").alias("sender"), F.lit("scan.pdf").alias("name"), F.lit("Ihre Unterlagen").alias("subject"))


@query(f"select o_orderkey, kind in ('Rechnung', 'Quittung') as invoice, kind in ('Kassenbon') as receipt, array_to_string([case kind when 'Quittung' then 'Rechnung' else kind end, strftime(sent, '%Y'), 'Acme'], '|') as tags from {_MAIL}")
def q79_invoice_tags(spark, d):
    c = F.col
    return _mails(spark, d).select("o_orderkey", files.is_invoice(c("kind"), c("name"), c("subject")).alias("invoice"), files.is_receipt(c("kind"), c("name"), c("subject")).alias("receipt"),
                                   F.array_join(files.attachment_tags(c("kind"), c("name"), c("subject"), c("sender"), c("sent")), "|").alias("tags"))


@query(f"select o_orderkey, kind || ' von Example ' || strftime(sent, '%d.%m.%Y') || ' - Ihre Unterlagen' as description, 'base/' || strftime(sent, '%Y') || '/' || strftime(sent, '%m-%B') || '/Example' as directory from {_MAIL}")
def q80_description(spark, d):
    c = F.col
    return _mails(spark, d).select("o_orderkey", files.description(c("kind"), c("sender"), c("sent"), c("subject")).alias("description"), files.target_directory("base", c("sender"), c("sent"), True, True).alias("directory"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m') as month, strftime(o_orderdate, '%d.%m.%Y') as german, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d-%b-%Y') as imap from orders")
def q81_date_formats(spark, d):
    return read(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in dates.formats(F.col("o_orderdate")).items()])


@query("select event_id, case event_id % 3 when 0 then null else strftime(ts, '%Y-%m-%dT%H:%M:%S') end as parsed, case when event_id % 2 = 0 then epoch(date_trunc('second', timestamp '2024-03-01') - date_trunc('second', ts))::double end as seconds from events")
def q82_iso_duration(spark, d):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    text = F.when(e % 3 == 0, F.concat(F.lit("at "), F.date_format(ts, "yyyy"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return read(spark, d, "events").select("event_id", F.date_format(dates.parsed_iso(text), "yyyy-MM-dd'T'HH:mm:ss").alias("parsed"), dates.seconds_between(F.date_trunc("second", ts), F.when(e % 2 == 0, F.lit("2024-03-01").cast("timestamp"))).alias("seconds"))


_ISSUES_OF = f"with i as (select document_id, is_valid, string_split(issues, '; ') as issues from ({_metadata_sql(False)})), k as (select split_part(x, ':', 1) as issue, count(*) as n from (select unnest(issues) as x from i) where x <> '' group by 1)"


@query(_ISSUES_OF + """ select (select count(*) from i) as total, (select count(*) filter (is_valid) from i) as valid, (select round_even(count(*) filter (is_valid) / count(*), 6) from i) as rate, (select string_agg(issue, '; ' order by n desc, issue) from (select * from k order by n desc, issue limit 10)) as top,
 count(*) filter (regexp_matches(lower(issue), 'fehlt')) as missing_fields, count(*) filter (regexp_matches(lower(issue), 'format|ungültig')) as invalid_format, count(*) filter (regexp_matches(lower(issue), 'empfänger|absender')) as business_rules, count(*) filter (regexp_matches(lower(issue), 'lang|kurz')) as length_issues from k""")
def q83_metadata_summary(spark, d):
    return records.summary(records.metadata(full_docs(spark, d)))


_ERR = "(select event_id as error_id, event_type as phase, case event_id % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity, user_id % 2 = 0 as recoverable, 'took ' || props as message, value as processing_time from events)"


def _errors(spark, d):
    k = F.col("event_id") % 4
    severity = F.when(k == 0, "critical").when(k == 1, "high").when(k == 2, "medium").otherwise("low")
    return read(spark, d, "events").select(F.col("event_id").alias("error_id"), F.col("event_type").alias("phase"), severity.alias("severity"), (F.col("user_id") % 2 == 0).alias("recoverable"), F.concat(F.lit("took "), "props").alias("message"), F.col("value").alias("processing_time"))


@query(f"select phase, severity, count(*) as errors, count(*) filter (recoverable) as recoverable from {_ERR} group by grouping sets ((phase), (severity), ())")
def q84_error_summary(spark, d):
    return stats.error_summary(_errors(spark, d))


@query(f"select error_id, phase, message from {_ERR} where severity = 'critical' order by error_id limit 10")
def q85_first_critical(spark, d):
    return stats.first_critical(_errors(spark, d)).select("error_id", "phase", "message")


@query(f"select phase || ':' || left(message, 50) as error, count(*) as n from {_ERR} group by 1 order by n desc, error limit 10")
def q86_common_errors(spark, d):
    return stats.common_errors(_errors(spark, d))


@query(f"select round_even(avg(processing_time), 6) as mean_time, min(processing_time) as least_time, max(processing_time) as most_time, round_even(60.0 / avg(processing_time), 6) as per_minute from {_ERR}")
def q87_times(spark, d):
    return stats.times(_errors(spark, d))


@query("""with t as (select distinct p_name as name from part), c as (select left(name, 2) as cluster, name, min(name) over (partition by left(name, 2)) as rep from t), s as (select cluster, name, case when name <> rep then 100.0 * least(length(name), length(rep)) / greatest(length(name), length(rep)) end as sim from c),
 g as (select cluster, count(*) as size, avg(sim) as mean from s group by 1), z as (select count(*) as clusters, sum(size)::bigint as clustered, sum(size - 1)::bigint as removable, min(size) as smallest, max(size) as largest, avg(size) as mean_size, 1 - coalesce(avg(mean), 0) / 100 as consistency from g), y as (select *, greatest(0.0::double, 1 - (mean_size - 2) / 10) as organisation from z)
 select clusters, clustered, removable, smallest, largest, round_even(clustered / (select count(*) from t), 3) as duplication, round_even(removable / (select count(*) from t), 6) as reduction, round_even(consistency, 3) as consistency, round_even(organisation, 3) as organisation, round_even((consistency + organisation) / 2, 3) as overall from y""")
def q88_tag_quality(spark, d):
    """Clusters by the first letters; the share of lengths stands in for the similarity, which q130 has."""
    t = tags(spark, d).select(F.left("name", F.lit(2)).alias("cluster"), "name")
    rep = t.groupBy("cluster").agg(F.min("name").alias("rep"))
    sim = F.when(F.col("name") != F.col("rep"), F.lit(100.0) * F.least(F.length("name"), F.length("rep")) / F.greatest(F.length("name"), F.length("rep")))
    return stats.tag_quality(t.join(rep, "cluster").select("cluster", "name", sim.alias("similarity")), t)


@query("select user_id as account, count(*) as processed, sum(event_id % 3)::bigint as attachments, max((event_type = 'error')::int) = 1 as has_error from events group by rollup (user_id)")
def q89_mail_statistics(spark, d):
    return stats.accounts(read(spark, d, "events").select(F.col("user_id").alias("account"), (F.col("event_id") % 3).alias("attachments"), (F.col("event_type") == "error").alias("failed")))


_EDGES = "(select distinct string_split(p_name, ' ')[1] as parent, p_name as child from part)"


def _edges(spark, d):
    return read(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("parent"), F.col("p_name").alias("child")).distinct()


@query(f"with e as {_EDGES} select (select count(*) from (select parent from e union select child from e)) as tags, count(distinct parent) as roots, count(*) as unified, round_even(count(*) / (select count(*) from (select parent from e union select child from e)), 6) as rate from e")
def q90_match_statistics(spark, d):
    return stats.matching(_edges(spark, d))


@query(f"with e as {_EDGES}, n as (select parent as name from e union select child from e) select name, (select min(parent) from e where child = name) as parent, coalesce((select string_agg(child, '|' order by child) from e where e.parent = name), '') as children from n")
def q91_hierarchy_lookup(spark, d):
    return records.relatives(_edges(spark, d)).select("name", "parent", F.array_join("children", "|").alias("children"))


@query("select count(*) filter (event_type <> 'error') as processed, count(*) filter (event_type = 'error') as errors, count(distinct case when event_type not in ('error', 'view') then props end) as new_tags, count(*) filter (event_type = 'view') as matches, round_even(count(*) filter (event_type <> 'error') * 100.0::double / count(*), 1) as success_percent from events")
def q92_run_statistics(spark, d):
    return stats.run_statistics(read(spark, d, "events").select((F.col("event_type") == "error").alias("failed"), F.col("props").alias("tag"), (F.col("event_type") == "view").alias("matched")))


@query(_FLAGS + ", a as (select count(*) as n from flags) " + " union all ".join(f"select '{f}' as flag, count(*) filter ({f}) as documents, round_even(count(*) filter ({f}) * 100.0::double / count(*), 1) as percent from flags" for f in issues.FLAGS))
def q93_flag_table(spark, d):
    return stats.flag_table(issues.scan_flags(whole_docs(spark, d)), issues.FLAGS)


@query("select doc_id as document_id from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def q94_needs_metadata(spark, d):
    c = whole_docs(spark, d)
    return records.needs_metadata(c.withColumn("correspondent", F.when(F.col("document_id") % 3 != 0, F.col("correspondent"))).withColumn("tags", F.when(F.col("document_id") % 5 != 0, F.col("tags")))).select("document_id")


@query("select o_orderkey, o_orderkey % 4 <> 3 as scanned, o_orderkey % 4 < 2 as mailed from (select o_orderkey from orders)")
def q95_type_filter(spark, d):
    k = F.col("o_orderkey") % 4
    name = F.concat(F.lit("Scan."), F.when(k == 0, "PDF").when(k == 1, "jpeg").when(k == 2, "tiff").otherwise("exe"))
    return read(spark, d, "orders").select("o_orderkey", tables.allowed(name).alias("scanned"), tables.allowed(name, [".pdf", ".png", ".jpg", ".jpeg"]).alias("mailed"))


@query("select c_custkey, contains(lower(c_mktsegment), 'auto') or contains(lower(c_mktsegment), 'house') as a, contains(lower(c_mktsegment), 'mach') as b, false as c from customer")
def q96_recipients(spark, d):
    s = F.col("c_mktsegment")
    return read(spark, d, "customer").select("c_custkey", records.is_recipient(s, ["auto", "House"]).alias("a"), records.is_recipient(s, ["mach"]).alias("b"), records.is_recipient(s, []).alias("c"))


@query(f"with {_WHOLE} select document_id, case when title <> '' then title end as title, s_suppkey as correspondent_id, null::int as document_type_id, case when note <> '' then note end as notes from docs left join supplier on lower(s_name) = lower('Supplier#' || lpad((document_id % 7)::varchar, 9, '0'))")
def q97_updates(spark, d):
    c = whole_docs(spark, d).withColumn("correspondent", F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("document_id") % 7).cast("string"), 9, "0")))
    return records.updates(c, read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


_PRIMARY = "(select name, first(name) over (partition by left(name, 2) order by n desc, name) as prim from (select p_name as name, count(*) as n from part group by 1))"


@query(f"select p_partkey, array_to_string(case when name = prim then [p_brand, p_name, p_type] else [p_brand, p_type, prim] end, '|') as tags, (name <> prim)::bigint as updates from part join {_PRIMARY} on p_name = name")
def q98_unify(spark, d):
    rep = entities.representative(tags(spark, d).withColumn("cluster", F.left("name", F.lit(2))))
    members = rep.join(rep.where("rn = 1").select("cluster", F.col("name").alias("primary")), "cluster").select("name", "primary")
    p = read(spark, d, "part").select("p_partkey", F.array("p_brand", "p_name", "p_type").alias("tags"))
    return records.unified_tags(p, members, "p_partkey").select("p_partkey", F.array_join("tags", "|").alias("tags"), "updates")


@query("""with t as (select p_brand as cluster, p_name as name, count(*) as document_count, min(p_partkey) as pos from part group by 1, 2), x as (select *, not regexp_matches(name, '(en|er|s|e)$') as plain from t)
 select cluster, name from (select *, row_number() over (partition by cluster order by document_count desc, plain desc, case when plain then pos end, length(name), pos) as rn from x) where rn = 1""")
def q99_representative(spark, d):
    t = read(spark, d, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")).agg(F.count("*").alias("document_count"), F.min("p_partkey").alias("pos"))
    return records.representative(t).where("rn = 1").select("cluster", "name")


@query(f"with {_WHOLE} select 'correspondent' as kind, * from (select correspondent as name, count(*) as n from docs group by 1 order by n desc, name limit 20) union all select 'document_type', * from (select document_type as name, count(*) as n from docs group by 1 order by n desc, name limit 15)")
def q100_top_names(spark, d):
    top = lambda c, k: whole_docs(spark, d).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select(F.lit(c).alias("kind"), "name", "n")
    return top("correspondent", 20).unionByName(top("document_type", 15))


@query("select user_id % 3 as account, event_id from events where user_id % 3 < 2 union all select 9, event_id from events where event_type = 'error'")
def q101_union_accounts(spark, d):
    e = read(spark, d, "events")
    own = e.select((F.col("user_id") % 3).alias("account"), "event_id")
    return own.where("account = 0").unionByName(own.where("account = 1")).unionByName(e.where("event_type = 'error'").select(F.lit(9).cast("long").alias("account"), "event_id"))


@query("select event_id, json_extract_string(props, '$.k')::int as k, event_type = 'error' as failed, value >= 95 as high, value >= 85 and value < 95 as medium from events")
def q102_derived_flags(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), (F.col("event_type") == "error").alias("failed"), (v >= 95).alias("high"), ((v >= 85) & (v < 95)).alias("medium"))


@query("select event_type as model, round_even(sum(value::decimal(18, 6)), 4)::double as cost, sum(event_id % 7)::bigint as tokens, count(*) as requests, event_type is null and sum(value::decimal(18, 6)) > 100 as alert from events group by rollup (event_type)")
def q103_ledger(spark, d):
    return stats.ledger(read(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("cost"), (F.col("event_id") % 7).alias("tokens")), 100.0)


@query("select user_id, event_id, count(*) over w as so_far, round_even(sum(value::decimal(18, 6)) over w, 4)::double as cost_so_far from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)")
def q104_running_totals(spark, d):
    return stats.running(read(spark, d, "events").select("user_id", "event_id", F.col("value").alias("cost")), "user_id", "event_id")


@query(f"""with {_WHOLE} select document_id, document_id::varchar || ',' || case when regexp_matches(title, '[",\\r\\n]') then '"' || replace(title, '"', '""') || '"' else title end || ',"' || array_to_string(tags, ', ') || '"' as line from docs""")
def q105_csv_lines(spark, d):
    c = whole_docs(spark, d).select("document_id", "title", "tags")
    return sinks.csv_lines(c).select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("document_id"), "line")


@query("select doc_id as document_id, left(text, 5) as title, length(text)::varchar as chars from (select doc_id, regexp_replace(text, '[^a-zA-Z ]', '', 'g') as text from documents)")
def q106_extraction(spark, d):
    """Fields that a pluggable extractor answers; here a rule stands in for a model."""
    def complete(text: str) -> str:
        return f'Sure:\n```json\n{{"title": "{text[:5]}", "chars": "{len(text)}"}}\n```'

    plain = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("text"))
    return records.extracted(plain, complete, ["title", "chars"], most=10_000_000)


@query("select p_partkey, case when n = 0 then p_name || '.pdf' else p_name || '_' || n || '.pdf' end as name from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)")
def q107_unique_names(spark, d):
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return read(spark, d, "part").select("p_partkey", files.numbered(F.concat("p_name", F.lit(".pdf")), turn).alias("name"))


_FIELDS = ["title", "correspondent", "document_type"]


@query("select doc_id as document_id, array_to_string(list_filter([case when doc_id % 2 = 0 then 'title' end, case when doc_id % 3 = 0 then 'correspondent' end], lambda x: x is not null), '|') as missing from documents")
def q108_missing_fields(spark, d):
    """Required fields that a record lacks."""
    i = F.col("document_id")
    have = F.array_compact(F.array(F.when(i % 2 != 0, "title"), F.when(i % 3 != 0, "correspondent"), F.lit("document_type")))
    return whole_docs(spark, d).select("document_id", F.array_join(F.array_except(F.array(*map(F.lit, _FIELDS)), have), "|").alias("missing"))


@query("select a.doc_id as doc_id, b.doc_id as other_id from (select doc_id, row_number() over (order by doc_id) as i from documents) a join (select doc_id, row_number() over (order by n_chars, doc_id) as i from documents) b using (i)")
def q109_zip_join(spark, d):
    """Rows by their place: the documents by id beside the documents by length."""
    t = read(spark, d, "documents")
    return records.zipped(t.select("doc_id"), t.select("n_chars", F.col("doc_id").alias("other_id")), ["doc_id"], ["n_chars", "other_id"]).select("doc_id", "other_id")


@query(_metadata_sql(False))
def q110_metadata_batch(spark, d):
    c = full_docs(spark, d)
    rows = c.select("document_id", "title", F.when(F.col("document_id") % 2 == 0, F.col("correspondent")).alias("correspondent"), F.col("correspondent").alias("correspondent_name"), F.lit("").alias("document_type"), F.col("document_type").alias("document_type_name"),
                    F.transform("tags", lambda t: F.struct(t.alias("name"))).alias("tags"), F.col("note").alias("description"), "created", "modified", "filename", F.lit(None).cast("string").alias("original_filename"))
    return records.batch(rows).select("document_id", "is_valid", F.array_join("issues", "; ").alias("issues"), "filename_suggestion")


@query("""select p_partkey, case when p_size % 2 = 0 then p_brand else 'Unbekannt' end as correspondent, p_type as document_type, p_name || '|' || p_brand as tags, left(p_name || ' ' || p_type, 12) as note,
 '2024-05-06_' || case when p_size % 2 = 0 then replace(p_brand, '#', 'nr') else 'Unbekannt' end || '_' || p_type as filename, case when p_size % 2 = 0 then '' else 'correspondent|' end || case when length(p_name || ' ' || p_type) > 12 then 'description|' else '' end || 'filename' as changed from part""")
def q111_repaired(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("document_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("correspondent"), F.col("p_type").alias("document_type"), F.concat("p_name", F.lit(", "), "p_brand", F.lit(",x")).alias("tags"),
                                      F.concat("p_name", F.lit(" "), "p_type").alias("note"), F.lit("2024-05-06T10:00:00").alias("created"), F.lit(None).cast("string").alias("filename"))
    return records.repaired(p, note_chars=12).select(F.col("document_id").alias("p_partkey"), "correspondent", "document_type", F.array_join("tags", "|").alias("tags"), "note", "filename", F.array_join("changed", "|").alias("changed"))


@query("select event_id as id, case when event_id % 5 = 4 then null else 'reply ' || event_id end as reply, case when event_id % 5 = 4 then null when event_id % 2 = 0 then 'first' else 'second' end as provider, case when event_id % 5 = 4 then 0 else 7 end as tokens, case when event_id % 5 = 4 then 'second: down' end as error from events")
def q112_completions(spark, d):
    """Ranked providers with fallback; functions stand in for the services."""
    def first(prompt: str) -> tuple[str, int, float]:
        if int(prompt) % 2 or int(prompt) % 5 == 4:
            raise OSError("down")
        return f"reply {prompt}", 7, 0.5

    def second(prompt: str) -> tuple[str, int, float]:
        if int(prompt) % 5 == 4:
            raise OSError("down")
        return f"reply {prompt}", 7, 0.25

    own = [calls.Provider("second", 2, second), calls.Provider("off", 0, first, enabled=False), calls.Provider("first", 1, first)]
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("prompt"))
    return calls.completions(rows, own, sleep=_no_wait).select("id", "reply", "provider", "tokens", "error")


def _no_wait(seconds: float) -> None:
    pass


@query("select 'a' || s_suppkey % 3 as account, s_suppkey::varchar as uid, null::varchar as error from supplier union all select 'broken', null, 'no connection'")
def q113_accounts_fetch(spark, d):
    """Suppliers as mails of three accounts, and an account that can't be reached: every account on its own. A mailbox in a folder answers."""
    folder = shared_dir(spark, "accounts")
    read(spark, d, "supplier").select(F.concat(F.lit("a"), (F.col("s_suppkey") % 3).cast("string")).alias("account"), F.col("s_suppkey").cast("string").alias("uid")).repartition("account").write.partitionBy("account").json(folder)

    def fetch(account: dict, asked: str):
        place = f"{folder}/account={account['account']}"
        parts = [n for n in storage.names(place) if n.startswith("part-")]
        if not parts:
            raise OSError("no connection")
        for name in parts:
            for line in storage.get(f"{place}/{name}").splitlines():
                yield json.loads(line)["uid"], b"x"

    return mailbox.fetched(spark, [{"account": a} for a in ("a0", "a1", "a2", "broken")], fetch).select("account", "uid", "error")


@query("select p_brand as directory, p_name || '.pdf' as filename, case when n = 0 then p_brand || '/' || p_name || '.pdf' else p_brand || '/' || p_name || '_' || n || '.pdf' end as path from (select p_brand, p_name, row_number() over (partition by p_brand, p_name order by p_partkey) - 1 as n from part)")
def q114_attachment_paths(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("directory"), F.concat("p_name", F.lit(".pdf")).alias("filename"))
    return mailbox.attachment_files(p).select("directory", "filename", "path")


@query("select user_id, string_agg(event_id::varchar, '|' order by event_id) as first_errors from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'error') where n <= 10 group by 1")
def q115_first_errors(spark, d):
    """A payload of the first ten errors of each account."""
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = read(spark, d, "events").where("event_type = 'error'").withColumn("turn", turn).where("turn <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return e.select("user_id", F.array_join(F.col("ids").cast("array<string>"), "|").alias("first_errors"))


_RANGES = {
    "last_quarter": ("date_trunc('quarter', o) - interval 3 month", "date_trunc('quarter', o) - interval 1 day"), "current_quarter": ("date_trunc('quarter', o)", "date_trunc('quarter', o) + interval 3 month - interval 1 day"),
    "last_3_months": ("date_trunc('month', o) - interval 3 month", "date_trunc('month', o) - interval 1 day"), "last_month": ("date_trunc('month', o) - interval 1 month", "date_trunc('month', o) - interval 1 day"),
    "current_month": ("date_trunc('month', o)", "date_trunc('month', o) + interval 1 month - interval 1 day"), "year_to_date": ("date_trunc('year', o)", "o"), "last_year": ("date_trunc('year', o) - interval 1 year", "date_trunc('year', o) - interval 1 day")}


@query(" union all ".join(f"select '{k}' as option, ({a})::date as first, ({b})::date as last from (select date_trunc('day', max(o_orderdate)) as o from orders)" for k, (a, b) in _RANGES.items()))
def q12_quick_ranges(spark, d):
    """The seven ranges relative to the last order."""
    last = read(spark, d, "orders").agg(F.max("o_orderdate").alias("o"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("option"), dates.quick_range_of(k, F.col("o")).alias("r")) for k in _RANGES])).alias("e")
    return last.select(each).select("e.option", "e.r.first", "e.r.last")


@query("select o_orderkey, " + ", ".join(f"strftime({a}, '%Y%m%d') || '-' || strftime({b}, '%Y%m%d') as {k}" for k, (a, b) in _RANGES.items()) + " from (select o_orderkey, date_trunc('day', o_orderdate) as o from orders)")
def q116_quick_ranges_of(spark, d):
    """The seven ranges relative to every order's date."""
    def shown(k: str):
        r = dates.quick_range_of(k, F.col("o_orderdate"))
        return F.concat(F.date_format(r["first"], "yyyyMMdd"), F.lit("-"), F.date_format(r["last"], "yyyyMMdd")).alias(k)

    return read(spark, d, "orders").select("o_orderkey", *[shown(k) for k in _RANGES])


@query(_FOUND + " select issue_type, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low")) + " from found group by 1")
def q117_severities(spark, d):
    return issues.by_severity(issues.issues(whole_docs(spark, d)))


@query("select user_id as batch_id, case when count(*) filter (event_type = 'signup') = 0 then round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) end as wall_seconds, round_even(avg(value), 6) as mean_time from events group by 1")
def q118_batch_times(spark, d):
    e = read(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return stats.batch_times(e.select(F.col("user_id").alias("batch_id"), ts.alias("started"), F.when(F.col("event_type") != "signup", ts).alias("ended"), F.col("value").alias("processing_time")))


@query(_OCRV + " select language, count(*) as n from r group by 1")
def q119_ocr_languages(spark, d):
    return validate.languages(ocr_results(spark, d))
