"""The queries of the ten operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import dedup_vectors

    return dedup_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import RULES, filter_urls

    rules = spark.sql("values " + ", ".join(f"('{r}', '{a}')" for r, a in RULES)).toDF("rule", "action")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import dedup_simhash

    return dedup_simhash(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def host_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line dedup of op6 over web pages: the site is the url's host."""
    from .linededup import dedup_lines, visible_lines
    from .urlfilter import url_parts

    pages = table(spark, sf_dir, "pages").select("page_id", url_parts(F.col("url"))[0].alias("host"), visible_lines(F.col("html")).alias("text"))
    return dedup_lines(pages, "host")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score_quality, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_suffixes

    out = dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_url_filter, op3_source_mix, op4_license_scan, op5_simhash_dedup, op6_line_dedup, op7_quality_classifier, op8_packing, op9_quality_rules, op10_suffix_dedup, host_line_dedup)}

SQL = {
    "op2_url_filter": """
with parts as (
  select page_id,
         case when url is null or position('://' in url) = 0 then '' else translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
         case when url is null or position('://' in url) = 0 then '' else regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) end as path
  from pages),
rules(rule, host, path, action) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best as (
  select p.*, (select max(struct_pack(n := length(r.rule), rule := r.rule, action := r.action)) from rules r
               where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)) as b
  from parts p)
select page_id, host, path, b.rule as rule, coalesce(b.action, 'allow') as verdict from best
""",
    "op6_line_dedup": """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents),
seen as (select source, trim(line, ' ') as bare, count(distinct doc_id) as n from lines where trim(line, ' ') <> '' group by 1, 2),
pages as (select source, count(*) as pages from documents group by 1),
drops as (select s.source, s.bare from seen s join pages p on s.source is not distinct from p.source where s.n >= 3 and s.n > 0.1::double * p.pages),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.k) as text, count(*) as n
  from lines l left join drops d on l.source is not distinct from d.source and trim(l.line, ' ') = d.bare
  where d.bare is null group by 1)
select d.doc_id, d.source, case when d.text is null then null else coalesce(k.text, '') end as text,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) - coalesce(k.n, 0) end as n_dropped
from documents d left join kept k using (doc_id)
""",
    "host_line_dedup": r"""
with docs as (
  select page_id,
         case when url is null or position('://' in url) = 0 then '' else translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end as host,
         trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g'), '\n[ \n\t\r]*', chr(10), 'g'), ' ') as text
  from pages),
lines as (
  select page_id, host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from docs),
seen as (select host, trim(line, ' ') as bare, count(distinct page_id) as n from lines where trim(line, ' ') <> '' group by 1, 2),
sizes as (select host, count(*) as pages from docs group by 1),
drops as (select s.host, s.bare from seen s join sizes p using (host) where s.n >= 3 and s.n > 0.1::double * p.pages),
kept as (
  select l.page_id, string_agg(l.line, chr(10) order by l.k) as text, count(*) as n
  from lines l left join drops d on l.host = d.host and trim(l.line, ' ') = d.bare
  where d.bare is null group by 1)
select d.page_id, d.host, case when d.text is null then null else coalesce(k.text, '') end as text,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as n_lines,
       case when d.text is null then 0 else len(string_split(d.text, chr(10))) - coalesce(k.n, 0) end as n_dropped
from docs d left join kept k using (page_id)
""",
}
