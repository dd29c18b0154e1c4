"""Queries of the sources, sinks, streams, folds and table functions, over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import shared_dir, written
from ..operators import entities, folds, issues, records, reports, scanner
from ..sources import commits, paged
from ..streaming import duplicates as arrivals, ledger, mail
from .catalogue import _FOUND, _GROUPS, _LCS, _PAIRS, _WHOLE, docs, query, read, tags, whole_docs

#: Rows of a page, mails of a part of a mailbox, and accounts.
PAGE, PART, ACCOUNTS = 1000, 1000, 3


@query("select doc_id, lang, n_chars, md5(text) as hash from documents where lang = 'de' and n_chars >= 200")
def q120_paged_scan(spark, d):
    """Documents laid down as pages and read through the paged source: both conditions go to it, and only pages that may hold such rows are read."""
    t = read(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    client = paged.laid_down(t, shared_dir(spark, "paged"), ["lang", "doc_id"], ["lang", "n_chars"], PAGE)
    rows = paged.paged(spark, client, t.schema, [("lang", "=", "de"), ("n_chars", ">=", 200)])
    return rows.select("doc_id", "lang", "n_chars", F.md5("text").alias("hash"))


@query(f"""{_FOUND} select 'Dokument-ID,Problem-Typ,Schweregrad' as line union all select document_id || ',' || issue_type || ',' || severity from found""")
def q121_csv_file(spark, d):
    """The issue report as one CSV file with its header, as the sink has committed it; Spark's reader drops the byte order mark."""
    folder = shared_dir(spark, "reports")
    commits.csv_file(issues.issues(whole_docs(spark, d)).select("document_id", "issue_type", "severity"), folder, "issues.csv")
    return spark.read.option("lineSep", "\n").text(f"{folder}/issues.csv").select(F.col("value").alias("line"))


@query("select page_id, octet_length(encode(html)) as bytes, sha256(html) as hash, '{\"page_id\":' || page_id || '}' as sidecar from pages")
def q122_attachment_files(spark, d):
    """Pages as attachments with sidecars, written and committed as files, read again from the folder."""
    folder = shared_dir(spark, "attachments")
    rows = read(spark, d, "pages").where("html is not null").select(F.concat(F.pmod("page_id", F.lit(16)).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"), "page_id")
    commits.files(rows, folder)
    stored = spark.read.format("binaryFile").load(f"{folder}/[0-9]*/")
    number = F.regexp_extract("path", r"/(\d+)\.html", 1).cast("long").alias("page_id")
    of = stored.groupBy(number).agg(F.max(F.when(F.col("path").endswith(".html"), F.struct("length", F.sha2("content", 256).alias("hash")))).alias("f"), F.max(F.when(F.col("path").endswith(".json"), F.decode("content", "utf-8"))).alias("sidecar"))
    return of.select("page_id", F.col("f.length").alias("bytes"), "f.hash", "sidecar")


@query(f"select 'account' || doc_id % {ACCOUNTS} as account, doc_id // {ACCOUNTS} + 1 as uid, sha256(coalesce(text, '')) as hash from documents")
def q123_mail_stream(spark, d):
    """Documents as mails of three accounts, in two deliveries; the stream stops after the first and goes on with the second."""
    rows = read(spark, d, "documents").select(F.concat(F.lit("account"), (F.col("doc_id") % ACCOUNTS).cast("string")).alias("account"), (F.floor(F.col("doc_id") / ACCOUNTS) + 1).alias("uid"),
                                              F.lit("2024-01-15 10:00:00").cast("timestamp").alias("sent"), F.coalesce("text", F.lit("")).alias("content"))
    half = rows.agg(F.max("uid")).first()[0]
    folder = shared_dir(spark, "mail")
    server = mail.FolderServer(f"{folder}/box")
    for first in (True, False):
        mail.delivered(rows.where((F.col("uid") * 2 <= F.lit(half)) == first), f"{folder}/box", PART)
        taken = mail.taken(mail.mails(spark, server, 1 << 40), f"{folder}/taken", f"{folder}/log")
    return taken.select("account", "uid", F.sha2("content", 256).alias("hash"))


_USAGE = "select coalesce(source, 'unknown') as model, coalesce(n_chars, 0) as tokens, round(coalesce(n_chars, 0) * 0.000125, 6)::decimal(24, 6) as cost from documents"
LIMIT = 5.0


@query(f"""with u as ({_USAGE}), m as (select model, count(*) as requests, sum(tokens)::bigint as tokens, sum(cost) as cost from u group by 1 union all select 'total', count(*), sum(tokens)::bigint, sum(cost) from u)
 select model, requests, tokens, round_even(cost, 4)::double as cost, (model = 'total' and cost > {LIMIT})::bigint as alerts from m""")
def q124_running_ledger(spark, d):
    """Costs by source as a stream with state: totals, and one alert at the limit."""
    folder = shared_dir(spark, "ledger")
    rows = ledger.usage(spark, f"{d}/documents.parquet", "source string, n_chars long", files=128)
    cost = F.round(F.coalesce("n_chars", F.lit(0)).cast("decimal(24,6)") * F.lit(0.000125).cast("decimal(24,6)"), 6)
    stream = rows.select(F.col("source").alias("model"), F.col("n_chars").alias("tokens"), cost.alias("cost"))
    return ledger.kept(stream, LIMIT, f"{folder}/out", f"{folder}/log")


@query(f"{_PAIRS} select id1, id2, n1, n2, score from pairs")
def q125_arriving_duplicates(spark, d):
    """Documents in two arrivals, the second after a stop: the class pairs of one pass over all."""
    folder = shared_dir(spark, "arrivals")
    rows = docs(spark, d).select("document_id", "title", "correspondent", "created")
    schema = "document_id long, title string, correspondent string, created string"
    for part in (0, 1):
        rows.where(F.pmod(F.xxhash64("document_id"), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        arrivals.arrived(arrivals.documents(spark, f"{folder}/in", schema, files=1 << 20), f"{folder}/state")
    return arrivals.found(spark, f"{folder}/state").drop("batch")


@query(f"""{_FOUND}, i as (select document_id, issue_type from found) select 'issue' as kind, document_id, issue_type, 1::bigint as n from i union all select 'total', null, issue_type, count(*) from i group by issue_type
 union all select 'total', null, null, count(*) from docs""")
def q126_scan(spark, d):
    """Issues and their statistics from one pass of a table function."""
    return scanner.scanned(whole_docs(spark, d), issues.issue_types())


_THEME = "select p_name as name from part group by 1 having min(p_partkey) % 3 = 0"
_APART = "select x.name as a, y.name as b from t x join t y on x.name < y.name and string_split(x.name, ' ')[2] = string_split(y.name, ' ')[2] and length(string_split(x.name, ' ')[2]) = 3"
_FREE = f"where ratio >= 85 and (p.name in ({_THEME})) = (q.name in ({_THEME})) and not exists (select 1 from ({_APART}) f where f.a = least(p.name, q.name) and f.b = greatest(p.name, q.name)))"
_GROUPS_APART = _GROUPS.replace("where ratio >= 85)", _FREE)


def _constraints(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    word = F.split_part("name", F.lit(" "), F.lit(2))
    side = lambda c: t.select(F.col("name").alias(c), word.alias("w"))
    return side("a").join(side("b"), "w").where("a < b and length(w) = 3").select("a", "b"), t.where("pos % 3 = 0").select("name")


@query(f"""{_GROUPS_APART} select parent, name as child from (select name, first(name) over w as parent, row_number() over w as rn from g join t using (pos)
 window w as (partition by group_pos order by document_count desc, not regexp_matches(name, '(en|er|s|e)$') desc, case when not regexp_matches(name, '(en|er|s|e)$') then pos end, length(name), pos)) where rn > 1""")
def q127_hierarchy_apart(spark, d):
    """Groups of tags that aren't told apart by name or by theme, and their representatives."""
    t = written(tags(spark, d), "tags")
    return entities.hierarchy_apart(t, *_constraints(t))


@query(f"{_GROUPS_APART} select group_pos, pos, name from g join t using (pos)")
def q128_groups_apart(spark, d):
    t = written(tags(spark, d), "tags")
    apart, themes = _constraints(t)
    return entities.greedy_groups(t, apart=apart, themes=themes)


_CLUSTERS = f"""with recursive t as (select distinct p_name as name from part), c as (select left(name, 2) as cluster, name, min(name) over (partition by left(name, 2)) as rep from t), np as (select distinct lower(name) as a, lower(rep) as b from c where name <> rep),
 {_LCS.format('l1', 'np')}, s as (select cluster, name, ratio from c left join l1_ratio on a = lower(name) and b = lower(rep) and name <> rep),
 k as (select cluster, count(*) as size, count(ratio) as compared, min(ratio) as least, max(ratio) as most, avg(ratio) as mean from s group by 1)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    t = tags(spark, d).select(F.left("name", F.lit(2)).alias("cluster"), "name")
    return t.join(t.groupBy("cluster").agg(F.min("name").alias("representative")), "cluster")


@query(f"{_CLUSTERS} select cluster, size, compared, round_even(least, 6) as least, round_even(most, 6) as most, round_even(mean, 6) as mean from k")
def q129_cluster_likeness(spark, d):
    """How alike the members of each cluster are to its representative, by a fold whose states merge."""
    shown = lambda c: F.bround(c, 6).alias(c)
    return folds.likeness(_clusters(spark, d)).select("cluster", "size", "compared", shown("least"), shown("most"), shown("mean"))


@query(f"""{_CLUSTERS}, z as (select count(*) as clusters, sum(size)::bigint as clustered, sum(size - 1)::bigint as removable, min(size) as smallest, max(size) as largest, avg(size) as mean_size, avg(mean) as mean_similarity, count(*) filter (least >= 95) as safe_merges from k where size > 1),
 y as (select *, greatest(1, (select count(*) from t)) as total, 1 - coalesce(mean_similarity, 0) / 100 as consistency, greatest(0.0::double, 1 - (mean_size - 2) / 10) as organisation from z)
 select total, clusters, clustered, removable, smallest, largest, safe_merges, round_even(mean_similarity, 6) as mean_similarity, round_even(clustered / total, 3) as duplication, round_even(removable / total, 6) as reduction, round_even(consistency, 3) as consistency,
 round_even(organisation, 3) as organisation, round_even((consistency + organisation) / 2, 3) as overall from y""")
def q130_tag_analysis(spark, d):
    """The measures of a tag analysis with similarities to the representatives, counted tags, and safe merges."""
    return folds.tag_analysis(_clusters(spark, d), tags(spark, d))


@query("select lang as parent, array_to_string(list(source order by source), '|') as children, sum(n)::bigint as documents from (select lang, source, count(*) as n from documents where source is not null group by all) group by 1")
def q131_tree(spark, d):
    """A level of a hierarchy, languages over sources, by a fold."""
    one: Column = F.lit(1).cast("long")
    rows = read(spark, d, "documents").where("source is not null").select(F.col("lang").alias("parent"), F.col("source").alias("child"), one.alias("documents"))
    return folds.tree(rows).select("parent", F.array_join("children", "|").alias("children"), "documents")


_N = "(select count(*) from found"
_LINES = ", ".join(f"({k + 1}, '{n}', {c})" for k, (n, c) in enumerate(zip(reports.LABELS, [f"{_N})", "(select count(distinct document_id) from found)", *[f"{_N} where severity = '{s}')" for s in ("critical", "high", "medium", "low")]])))
_RANK = "row_number() over (order by n desc, k) as ord, k, n"
_OVER = " or ".join(f"(issue_type = '{k}' and count(*) > {v})" for k, v in issues.RECOMMEND.items())


@query(f"""{_FOUND}, b as (select issue_type as k, count(*) as n from found group by 1), r as (select issue_type as k, count(*) as n from found group by issue_type having {_OVER}),
 t as (select document_id as k, count(*) as n from found group by 1 order by n desc, k limit 10)
 select '{reports.TITLES['summary']}' as section, ord::bigint as ord, key, value::varchar as value from (values {_LINES}) v(ord, key, value) union all select '{reports.TITLES['by_type']}', ord, k, n::varchar from (select {_RANK} from b)
 union all select '{reports.TITLES['recommendations']}', ord, k, n::varchar from (select {_RANK} from r) union all select '{reports.TITLES['top_documents']}', ord, k::varchar, n::varchar from (select {_RANK} from t)""")
def q132_report_sections(spark, d):
    """All sections of the quality report."""
    return reports.sections(issues.issues(whole_docs(spark, d)))


_CORPUS = f"""with {_WHOLE}, e as (select 'overview' as section, null as key, text from docs union all select 'correspondent', coalesce(correspondent, 'Unassigned'), text from docs union all select 'type', coalesce(document_type, 'Unassigned'), text from docs
 union all select 'month', left(created, 7), text from docs where created is not null union all select 'tag', tag, text from (select unnest(tags) as tag, text from docs) where tag is not null),
 c as (select section, key, count(*) as documents, count(*) filter (length(text) > 0) as with_ocr from e group by 1, 2)"""


@query(f"{_CORPUS} select * from c")
def q133_corpus_report(spark, d):
    """The corpus by sender, type, month and tag, and over all, in one pass."""
    return reports.corpus(whole_docs(spark, d))


@query(f"""{_CORPUS} select section, null::bigint as ord, key, documents from c where section in ('overview', 'month')
 union all select section, ord, key, documents from (select *, row_number() over (partition by section order by documents desc, key) as ord from c where section in ('correspondent', 'type', 'tag')) where ord <= case section when 'correspondent' then 20 when 'type' then 15 else 10 end""")
def q134_statistics_report(spark, d):
    return reports.statistics(whole_docs(spark, d))


@query("""with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as came, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
 s(user_id, event_id, place, came, start) as (select user_id, event_id, place, came, came from e where place < 3 union all select e.user_id, e.event_id, e.place, e.came, greatest(e.came, s.start + 86400.0) from s join e on e.user_id = s.user_id and e.place = s.place + 3)
 select event_id, place, round_even(start, 3) as start, round_even(start - came, 3) as waited from s""")
def q135_limiter(spark, d):
    """When requests may begin if a user has three a day."""
    e = read(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"))
    shown = lambda c: F.bround(c, 3).alias(c)
    return reports.limited(e, "user_id", "at", 3, 86400.0, ["event_id"]).select("event_id", "place", shown("start"), shown("waited"))


@query(f"""with {_WHOLE}, x as (select doc_id, max(case when quality = 1 then 'good' when quality = 0 then 'bad' end) as ocr from labels group by 1)
 select document_id, created, ocr, ocr is not null as fetched from docs left join x on doc_id = document_id where created between '2024-01-01' and '2024-03-31'""")
def q136_enriched_quarter(spark, d):
    """The documents of a quarter with what was fetched for each; those for which nothing was stay as they are."""
    told = read(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("ocr"))
    return reports.enriched(whole_docs(spark, d), told, "2024-01-01", "2024-03-31").select("document_id", "created", "ocr", "fetched")


_NAMED = "select row_number() over (order by name) as id, name from (select distinct {} as name from documents where {} is not null)"


@query(f"""with {_WHOLE}, s as ({_NAMED.format('source', 'source')}), l as ({_NAMED.format('lang', 'lang')}), n as (select row_number() over (order by name) as id, name from (select distinct unnest(tags) as name from docs) where name is not null),
 h as (select document_id, list(n.id order by pos) as ids from (select document_id, unnest(tags) as tag, generate_subscripts(tags, 1) as pos from docs) x join n on n.name = x.tag group by 1)
 select document_id, md5(coalesce(title, '')) as title, s.id as correspondent, l.id as document_type, array_to_string(ids, ',') as tags, document_id * 10 as archive_serial_number
 from docs left join s on s.name = correspondent left join l on l.name = document_type left join h using (document_id)""")
def q137_update_data(spark, d):
    """What updates send, read back from their JSON: titles, ids of names and tags, and a field that passes as it is."""
    t = whole_docs(spark, d).withColumn("archive_serial_number", F.col("document_id") * 10)
    dim = lambda c: t.select(c.alias("name")).where("name is not null").distinct()
    ids = lambda c: records.indexed(dim(c), ["name"]).select((F.col("index") + 1).alias("id"), "name")
    data = records.update_data(t, ids(F.col("correspondent")), ids(F.col("document_type")), ids(F.explode("tags")), ["archive_serial_number"])
    r = F.from_json("data", "title string, correspondent long, document_type long, tags array<long>, archive_serial_number long")
    return data.select("document_id", r.alias("r")).select("document_id", F.md5(F.coalesce("r.title", F.lit(""))).alias("title"), "r.correspondent", "r.document_type", F.array_join(F.col("r.tags").cast("array<string>"), ",").alias("tags"), "r.archive_serial_number")
