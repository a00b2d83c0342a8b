"""All queries of the engine but those of the training-data folder, and their SQL.

Blocks come from the lines of documents; where the documents hold nothing an operator looks
for, its docstring names the table that stands in as a carrier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as p
from ..functions import text as t
from ..operators import grouped, layout, verify, windows
from ..sources.blocks import blocks_from_lines

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_lines(table(spark, sf_dir, "documents"))


def inline(spark: SparkSession, rows: str, *names: str) -> DataFrame:
    return spark.sql(f"values {rows}").toDF(*names)


BLOCKS = """lines as (
  select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1)::int - 1 as ord from documents),
blocks as (
  select doc_id, (ord // 20 + 1)::int as page_number, ord, 'p' || (ord // 20 + 1) || '_b' || (ord % 20) as id, content,
         case when length(content) < 25 then 'heading' when (ord + doc_id) % 5 < 2 then 'reference' when (ord * 3 + doc_id) % 11 = 4 then 'table' else 'paragraph' end as type,
         case when length(content) >= 200 or ord % 2 = 0 then 50 else 320 end as x0, 40 + 36 * (ord % 20) as y0,
         case when length(content) >= 200 then 550 when ord % 2 = 0 then 280 else 550 end as x1,
         40 + 36 * (ord % 20) + least(70, 12 + length(content) // 10) as y1, 8 + length(content) % 5 as font_size
  from lines where trim(content, ' ') <> '')"""
KEY = r"trim(lower(regexp_replace(content, '\s+', ' ', 'g')), ' ')"


@query(f"with {BLOCKS} select * from blocks")
def blocks_of_documents(spark, sf_dir):
    return blocks(spark, sf_dir)


@query(f"""with {BLOCKS}, keyed as (select *, count(*) over (partition by doc_id, {KEY}) as n from blocks)
select doc_id, count(*) as n_blocks, max(page_number) as n_pages, count(*) filter (type = 'heading') as n_headings, count(*) filter (type = 'reference') as n_references,
       count(*) filter (n >= 2) as n_repeated, array_to_string(list_sort(list_distinct(list(font_size)))[1:8], ',') as font_sizes from keyed group by 1""")
def structure_report(spark, sf_dir):
    """One row for each document: its blocks by type, its pages, repeated lines, and type sizes."""
    of = lambda kind: F.count_if(F.col("type") == kind).alias(kind)
    # Blocks are counted by a digest of their key, then by document: sums before the shuffles, no window.
    same = blocks(spark, sf_dir).withColumns(key_digest()).groupBy("doc_id", "_a", "_b").agg(F.count("*").alias("n"), F.max("page_number").alias("page"), of("heading"), of("reference"), F.collect_set("font_size").alias("sizes"))
    sizes = F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sizes")))), 1, 8), ",")
    sums = [F.sum(c).alias(as_) for c, as_ in (("n", "n_blocks"), ("heading", "n_headings"), ("reference", "n_references"))]
    return same.groupBy("doc_id").agg(sums[0], F.max("page").alias("n_pages"), *sums[1:], F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("n_repeated"), sizes.alias("font_sizes"))


def key_digest() -> dict:
    """96 bits that stand for a block's key."""
    key = t.header_key(F.col("content"))
    return {"_a": F.xxhash64(key), "_b": F.hash(key)}


@query(f"with {BLOCKS} select type, count(*) as n, sum(length(content)) as n_chars from blocks group by 1")
def type_histogram(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query(f"with {BLOCKS} select doc_id, page_number, case when count(*) filter (x0 + x1 < 600 and x1 - x0 < 360) > 0 and count(*) filter (x0 + x1 >= 600 and x1 - x0 < 360) > 0 then 2 else 1 end as n_columns from blocks group by 1, 2")
def column_layout(spark, sf_dir):
    narrow, left = F.col("x1") - F.col("x0") < 360, F.col("x0") + F.col("x1") < 600
    both = (F.count_if(narrow & left) > 0) & (F.count_if(narrow & ~left) > 0)
    return blocks(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.when(both, 2).otherwise(1).alias("n_columns"))


REPEATED = f"select doc_id, {KEY} as key, count(*) as n from blocks where length(content) <= 400 group by 1, 2 having count(*) >= 2"


def _repeated(df: DataFrame) -> DataFrame:
    return df.where(F.length("content") <= 400).groupBy("doc_id", t.header_key(F.col("content")).alias("key")).agg(F.count("*").alias("n")).where("n >= 2")


@query(f"with {BLOCKS} {REPEATED}")
def repeated_lines(spark, sf_dir):
    return _repeated(blocks(spark, sf_dir))


@query(f"with {BLOCKS}, r as ({REPEATED}) select doc_id, ord from blocks b where exists (select 1 from r where r.doc_id = b.doc_id and r.key = {KEY.replace('content', 'b.content')})")
def repeated_semi_join(spark, sf_dir):
    # One shuffle of digests; the texts stay where they are.
    b = blocks(spark, sf_dir).select("doc_id", "ord", (F.length("content") <= 400).alias("short"), *[c.alias(k) for k, c in key_digest().items()])
    n = F.count_if("short").over(Window.partitionBy("doc_id", "_a", "_b"))
    return b.withColumn("n", n).where("n >= 2").select("doc_id", "ord")


@query(f"with {BLOCKS}, w as (select doc_id, font_size, sum(length(trim(content, ' '))) as n, min(ord) as o from blocks where length(trim(content, ' ')) > 3 and page_number <= 5 group by 1, 2) select doc_id, arg_max(font_size, (n, -o)) as body_size from w group by 1")
def weighted_mode(spark, sf_dir):
    """The size that most characters of the first five pages have."""
    b = blocks(spark, sf_dir).where((F.length(F.trim("content")) > 3) & (F.col("page_number") <= 5))
    w = b.groupBy("doc_id", "font_size").agg(F.sum(F.length(F.trim("content"))).alias("n"), F.min("ord").alias("o"))
    return w.groupBy("doc_id").agg(F.max_by("font_size", F.struct("n", -F.col("o"))).alias("body_size"))


@query(f"with {BLOCKS}, m as (select doc_id, min(struct_pack(o := ord, c := content)) filter (type = 'heading') as title from blocks group by 1) select doc_id, title.c as title from m where title is not null")
def document_title(spark, sf_dir):
    return blocks(spark, sf_dir).where("type = 'heading'").groupBy("doc_id").agg(F.min_by("content", "ord").alias("title"))


@query("""with r as (select l_orderkey, l_linenumber, l_returnflag = 'N' as f, sum((l_returnflag <> 'N')::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag rows unbounded preceding) as island from lineitem),
s as (select *, count(*) over (partition by l_orderkey, f, island) as island_size from r) select l_orderkey, l_linenumber, island_size from s where f and island_size >= 2""")
def reference_runs(spark, sf_dir):
    """Carrier: the lines of an order; those flagged N stand for reference blocks."""
    return windows.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], F.col("l_returnflag") == "N").select("l_orderkey", "l_linenumber", "island_size")


@query(f"with {BLOCKS}, e as (select doc_id, ord, case when type = 'heading' and length(content) % 3 = 0 then true when type = 'heading' then false end as ev from blocks) select doc_id, ord, coalesce(last_value(ev ignore nulls) over (partition by doc_id order by ord rows unbounded preceding), false) as in_section from e")
def section_state(spark, sf_dir):
    """Carrier: headings whose length divides by 3 open a section, other headings close it."""
    head = F.col("type") == "heading"
    opens = head & (F.length("content") % 3 == 0)
    return windows.section_state(blocks(spark, sf_dir), ["doc_id"], ["ord"], opens, head).select("doc_id", "ord", "in_section")


@query("""with e as (select event_id, user_id, case when event_type = (select min(event_type) from events) then event_id % 50 end as a, row_number() over (partition by user_id order by ts, event_id) as rn from events),
i as (select *, count(a) over (partition by user_id order by rn rows unbounded preceding) as k from e)
select event_id, user_id, case when k = 0 then rn else max(a) over (partition by user_id, k) + rn - min(rn) over (partition by user_id, k) end as number from i""")
def running_number(spark, sf_dir):
    """Carrier: a user's events; those of the first type carry a number of their own."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_type")).scalar()
    return windows.running_number(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == first, F.col("event_id") % 50)).select("event_id", "user_id", "number")


BREAKER = """e as (select event_id, user_id, value < 40 as failed, row_number() over (partition by user_id order by ts, event_id) as rn from events),
g as (select *, sum(case when failed then 0 else 1 end) over (partition by user_id order by rn rows unbounded preceding) as good from e),
s as (select *, sum(case when failed then 1 else 0 end) over (partition by user_id, good order by rn rows unbounded preceding) as streak from g),
t as (select *, min(case when streak >= 3 then rn end) over (partition by user_id) as trip from s),
o as (select event_id, user_id, rn, case when rn > trip then 'skipped' when failed then 'failed' else 'done' end as outcome from t)"""


def _breaker(spark, sf_dir):
    return windows.circuit_breaker(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 40, 3)


@query(f"with {BREAKER} select event_id, user_id, rn, outcome from o")
def circuit_breaker(spark, sf_dir):
    """Carrier: a user's events are calls; low values are failures; three in a row trip."""
    return _breaker(spark, sf_dir).select("event_id", "user_id", "rn", "outcome")


@query(f"with {BREAKER} select user_id, count(*) as total, count(*) filter (outcome = 'done') as done, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'skipped') as skipped, coalesce(array_to_string(list_sort(list(rn) filter (outcome = 'failed'))[1:3], ','), '') as first_failures from o group by 1")
def run_report(spark, sf_dir):
    return verify.run_report(_breaker(spark, sf_dir), "user_id")


@query("""with c as (select l_orderkey * 10 + l_linenumber as id, 'dose ' || l_partkey || ' mg, ' || l_quantity::int || ' and ' || l_suppkey as src, case when l_partkey % 3 = 0 then 'dose ' || l_partkey || ' mg, ' || l_suppkey else 'dose ' || l_partkey || ' mg, ' || l_quantity::int || ' and ' || l_suppkey || ' of 7' end as tgt from lineitem ),
a as (select id, unnest(regexp_extract_all(src, '\\d+(?:[.,]\\d+)?')) as token from c), b as (select id, unnest(regexp_extract_all(tgt, '\\d+(?:[.,]\\d+)?')) as token from c),
x as (select id, token, count(*) as n from a group by 1, 2), y as (select id, token, count(*) as m from b group by 1, 2)
select id, token, greatest(coalesce(n, 0) - coalesce(m, 0), 0) as missing, greatest(coalesce(m, 0) - coalesce(n, 0), 0) as added from x full join y using (id, token) where coalesce(n, 0) <> coalesce(m, 0)""")
def number_multiset_diff(spark, sf_dir):
    """Carrier: sentences made from order lines; a third of the targets lose a number, the rest gain one."""
    n = lambda c: F.col(c).cast("int" if c == "l_quantity" else "bigint").cast("string")
    dose = F.concat(F.lit("dose "), n("l_partkey"), F.lit(" mg, "))
    full = F.concat(dose, n("l_quantity"), F.lit(" and "), n("l_suppkey"))
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), full.alias("src"), F.when(F.col("l_partkey") % 3 == 0, F.concat(dose, n("l_suppkey"))).otherwise(F.concat(full, F.lit(" of 7"))).alias("tgt"))
    return verify.multiset_difference(verify.tokens(c, "id", "src", P.NUMBER), verify.tokens(c, "id", "tgt", P.NUMBER), "id")


@query()
def unit_multiset(spark, sf_dir):
    """Rows only: the pattern looks around itself, which the oracle's engine cannot."""
    return verify.tokens(table(spark, sf_dir, "documents"), "doc_id", "text", verify.units_pattern())


@query("select doc_id, sha256('model' || chr(0) || coalesce(lang, '') || chr(0) || text) as key from documents where text is not null")
def cache_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", t.cache_key(F.lit("model"), F.coalesce("lang", F.lit("")), F.col("text")).alias("key"))


@query("with k as (select doc_id, sha256('model' || chr(0) || text) as key from documents), c as (select distinct key from k where doc_id % 3 = 0) select doc_id, key, key in (select key from c) as hit from k")
def cache_join(spark, sf_dir):
    """What a run over every third document has left in the cache serves all its copies."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = t.cache_key(F.lit("model"), F.col("text"))
    cache = d.where("doc_id % 3 = 0").select(key.alias("key"))
    return verify.cached_work(d, cache, key).select("doc_id", "key", "hit")


@query("with w as (select conv_id, turn, split_part(text, ' ', 1) as term from conversations), r as (select *, row_number() over (partition by lower(term) order by conv_id, turn, term) as k from w where term <> '') select lower(term) as key, term from r where k = 1")
def dedupe_first_spelling(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("term")).where("term <> ''").withColumn("key", F.lower("term"))
    return windows.first_occurrence(w, ["key"], ["conv_id", "turn", "term"]).where("is_first").select("key", "term")


@query("with w as (select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as k from conversations) select conv_id, turn, role, k = 1 as is_first from w")
def first_occurrence(spark, sf_dir):
    return windows.first_occurrence(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role", "is_first")


def _any_sql(c: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, '{x[5:] if x.startswith('(?-i)') else '(?i)' + x}')" for x in patterns) + ")"


@query(f"with {BLOCKS} select doc_id, ord from blocks where length(content) <= 600 and {_any_sql('content', P.FRONT_MATTER)}")
def frontmatter_filter(spark, sf_dir):
    return blocks(spark, sf_dir).where(p.front_matter(F.col("content"))).select("doc_id", "ord")


@query(f"with {BLOCKS} select doc_id, ord from blocks where {_any_sql('content', P.RUNNING_HEADER)}")
def running_header_filter(spark, sf_dir):
    return blocks(spark, sf_dir).where(p.running_header(F.col("content"))).select("doc_id", "ord")


@query("with n as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply from conversations) select conv_id, turn from n where length(text) <= 200 and length(reply) <= 400")
def short_replies(spark, sf_dir):
    """The length gates of the reply guard, wider so that the table's pairs pass."""
    n = table(spark, sf_dir, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return n.where((F.length("text") <= 200) & (F.length("reply") <= 400)).select("conv_id", "turn")


REPLIES = "('Conclusion', 'Please provide the English text.'), ('References', 'Please send the list.'), ('Conclusion', 'Fazit'), ('A sentence. Here', 'please send the text'), ('Results', '')"


@query(f"select s as source, r as reply, length(s) <= 60 and not contains(s, '.') and length(r) <= 160 and ({' or '.join(f'''contains(lower(r), '{m.replace(chr(39), chr(39) * 2)}')''' for m in P.ASKING_MARKERS)}) as asks from (values {REPLIES}) as v(s, r)")
def non_translation_guard(spark, sf_dir):
    v = inline(spark, REPLIES, "source", "reply")
    return v.withColumn("asks", p.asks_for_text(F.col("source"), F.col("reply")))


@query(r"with m as (select conv_id, string_agg(text, chr(10) || chr(10) order by turn) filter (role = 'system') as system, string_agg(case when role = 'assistant' then 'Assistant: ' || text else text end, chr(10) || chr(10) order by turn) filter (role <> 'system') as prompt from conversations group by 1) select conv_id, coalesce(system, '') as system, coalesce(prompt, '') as prompt from m")
def message_flatten(spark, sf_dir):
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("m"))
    line = lambda x: F.when(x["role"] == "assistant", F.concat(F.lit("Assistant: "), x["text"])).otherwise(x["text"])
    return c.select("conv_id", F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["text"]), "\n\n").alias("system"), F.array_join(F.transform(F.filter("m", lambda x: x["role"] != "system"), line), "\n\n").alias("prompt"))


@query(r"""with s as (select page_id, url, rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#;]*)', 1), '/') as path from pages),
n as (select *, regexp_replace(case when path = '' then 'article' else regexp_extract(path, '[^/]*$') end, '[^a-zA-Z0-9_\-\.]', '_', 'g') as name from s)
select page_id, left(sha1(url), 10) || '_' || case when ends_with(lower(name), '.pdf') then name else name || '.pdf' end as file_name from n""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.safe_filename(F.col("url")).alias("file_name"))


@query("select page_id, case when regexp_matches(lower(url), '^https?:') then 'url' else 'path' end as kind, case when length(html) < 100 then 'too small' when contains(substr(html, 1, 1024), '%PDF-') then 'pdf' when contains(lower(substr(html, 1, 1024)), '<html') or contains(lower(substr(html, 1, 1024)), '<!doctype html') then 'inaccessible' else 'invalid' end as status from pages")
def source_classify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", p.url_kind(F.col("url")).alias("kind"), p.sniff(F.col("html")).alias("status"))


ERRORS = "('401 unauthorized', 401), ('Connection error: connection refused', null), ('Request timed out after 30 seconds', null), ('too many requests', 429), ('bad request', 400), ('rate limit', 400), ('odd', 503), ('odd', null)"


def _has(c: str, markers: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({c}, '{m}')" for m in markers) + ")"


@query(f"select m as message, s as status, case when {_has('lower(m)', P.TRANSIENT_MARKERS)} then 'retryable' when s = 429 or s >= 500 then 'retryable' when s in {P.PERMANENT_STATUS} then 'permanent' when {_has('lower(m)', P.PERMANENT_MARKERS)} then 'permanent' else 'retryable' end as class from (values {ERRORS}) as v(m, s)")
def error_taxonomy(spark, sf_dir):
    return inline(spark, ERRORS, "message", "status").withColumn("class", p.error_class(F.col("message"), F.col("status")))


@query("select n as attempt, least(12.0::double, 1.5::double * pow(2.0::double, n - 1)) as delay from (values (1), (2), (3), (4), (5)) as v(n)")
def retry_schedule(spark, sf_dir):
    return inline(spark, "(1), (2), (3), (4), (5)", "attempt").withColumn("delay", p.retry_delay(F.col("attempt")))


@query(f"""with {BLOCKS}, f as (select *, x1 - x0 >= 360 as full_width from blocks where type <> 'other'),
a as (select *, coalesce(sum(full_width::int) over (partition by doc_id, page_number order by y0, ord rows between unbounded preceding and 1 preceding), 0) * 2 + full_width::int as band, case when full_width then 0 when x0 + x1 >= 600 then 1 else 0 end as s from f),
b as (select *, case when min(s) over w < max(s) over w then s else 0 end as side from a window w as (partition by doc_id, page_number, band))
select doc_id, page_number, ord, row_number() over (partition by doc_id, page_number order by band, side, y0, ord) as reading_ord from b""")
def reading_order(spark, sf_dir):
    return layout.reading_order(blocks(spark, sf_dir)).select("doc_id", "page_number", "ord", "reading_ord")


@query(f"with {BLOCKS} select doc_id, ord from blocks b where type <> 'table' and not exists (select 1 from blocks t where t.type = 'table' and t.doc_id = b.doc_id and t.page_number = b.page_number and (b.x0 + b.x1) / 2 between t.x0 and t.x1 and (b.y0 + b.y1) / 2 between t.y0 and t.y1)")
def table_anti_join(spark, sf_dir):
    return layout.outside_tables(blocks(spark, sf_dir)).select("doc_id", "ord")


@query(f"with {BLOCKS}, w as (select doc_id, page_number, ord, y0, y1 from blocks where x1 - x0 >= 360) select b.doc_id, b.page_number, b.ord, min(struct_pack(t := w.y0, o := w.ord)).o as band_ord from blocks b join w on b.doc_id = w.doc_id and b.page_number = w.page_number and (b.y0 + b.y1) / 2 between w.y0 - 5 and w.y1 + 5 where b.x1 - b.x0 < 360 group by 1, 2, 3")
def band_range_join(spark, sf_dir):
    return layout.band_members(blocks(spark, sf_dir))


@query(f"with {BLOCKS} select doc_id, page_number, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from blocks group by 1, 2")
def bbox_union(spark, sf_dir):
    return layout.page_boxes(blocks(spark, sf_dir))


@query(f"with {BLOCKS}, f as (select * from blocks where page_number = 1), a as (select doc_id, max(struct_pack(s := font_size, o := -ord, y := y0)).y as top from f where y0 < 400 group by 1) select f.doc_id, f.ord from f left join a using (doc_id) where top is null or y1 > top + 2 or length(content) >= 300")
def masthead_drop(spark, sf_dir):
    return layout.drop_masthead(blocks(spark, sf_dir)).select("doc_id", "ord")


@query(rf"""with {BLOCKS}, cut as (select * replace (case when (ord + doc_id) % 2 = 0 then lower(rtrim(content, '.')) else content end as content) from blocks), l as (select doc_id, page_number, max(struct_pack(o := ord, c := content)) as l from cut where type = 'paragraph' group by 1, 2),
f as (select doc_id, page_number, min(struct_pack(o := ord, c := content)) as f from cut where type not in ('figure', 'figure_caption', 'table') group by 1, 2)
select l.doc_id, l.page_number, l.l.o as last_ord, f.f.o as first_ord from l join f on l.doc_id = f.doc_id and l.page_number = f.page_number - 1 where not regexp_matches(l.l.c, '[.!?:;»"]$') and regexp_matches(f.f.c, '^\p{{Ll}}')""")
def cross_page_merge(spark, sf_dir):
    """Carrier: every other line loses its capital and full stop, as if it went on."""
    cut = F.when(F.pmod(F.col("ord") + F.col("doc_id"), F.lit(2)) == 0, F.lower(F.rtrim("content", F.lit(".")))).otherwise(F.col("content"))
    return layout.page_breaks(blocks(spark, sf_dir).withColumn("content", cut))


@query(r"with w as (select p_partkey, trim(lower(regexp_replace(p_name || 's', '\s+', ' ', 'g')), ' ') as k from part) select p_partkey, case when length(k) > 3 and regexp_matches(k, 's$') and not regexp_matches(k, '(ss|is|us)$') then left(k, length(k) - 1) else k end as key from w")
def plural_fold(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.term_key(F.concat("p_name", F.lit("s"))).alias("key"))


@query("select n_nationkey, n_name, coalesce(r_name, 'no note') as note from nation left join (select * from region where r_regionkey < 3) r on n_regionkey = r_regionkey")
def glossary_left_join(spark, sf_dir):
    """Carrier: nations are terms, three regions are notes; a missing note falls back."""
    notes = table(spark, sf_dir, "region").where("r_regionkey < 3")
    n = table(spark, sf_dir, "nation")
    return n.join(notes, n.n_regionkey == notes.r_regionkey, "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("no note")).alias("note"))


@query("with c as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey, l_returnflag || ' | ' || l_linestatus || ' | ' || l_partkey as line from lineitem) select l_orderkey, string_agg(line, chr(10) order by l_linenumber, l_returnflag, l_linestatus, l_partkey::varchar) as grid, count(*) as n_rows from c group by 1")
def table_flatten_regroup(spark, sf_dir):
    """Carrier: an order's lines are a table's rows; cells are joined, rows put back in order."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")).alias("cells"))
    g = c.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "cells"))).alias("rows"))
    return g.select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], " | ")), "\n").alias("grid"), F.size("rows").cast("bigint").alias("n_rows"))


MODELS = "('zen/alpha-free'), ('zen/beta'), ('gamma-free'), ('a/b/c')"


@query(f"select m as model, regexp_replace(m, '^[^/]*/', '') as name, ends_with(m, '-free') as free from (values {MODELS}) as v(m)")
def model_split(spark, sf_dir):
    m = inline(spark, MODELS, "model")
    return m.select("model", t.strip_provider(F.col("model")).alias("name"), F.col("model").endswith("-free").alias("free"))


@query(f"with {BLOCKS} select doc_id, ord, trim(regexp_replace(content, '[ \\t]+', ' ', 'g')) as clean, translate(content, '0123456789', '{P.PERSIAN_DIGITS}') as local from blocks")
def text_normalise(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "ord", t.normalise_text(F.col("content")).alias("clean"), t.persian_digits(F.col("content")).alias("local"))


@query()
def collapse_duplicates(spark, sf_dir):
    """Rows only: a backreference, which the oracle's engine lacks."""
    return blocks(spark, sf_dir).select("doc_id", "ord", t.collapse_repeats(F.col("content")).alias("content"))


@query()
def line_reflow(spark, sf_dir):
    """Rows only: each line is held against all that was merged before it."""
    return grouped.reflow(blocks(spark, sf_dir))


@query()
def figure_components(spark, sf_dir):
    """Rows only: a transitive closure within pages. Carrier: tables are figures."""
    return grouped.figure_groups(blocks(spark, sf_dir).where("type = 'table'"))


@query()
def caption_match(spark, sf_dir):
    """Rows only: a greedy one-to-one match. Carrier: headings are a page's captions, numbered in
    order, tables its figures."""
    head = F.col("type") == "heading"
    n = F.count_if(head).over(Window.partitionBy("doc_id", "page_number").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return grouped.match_captions(blocks(spark, sf_dir), F.when(head, n), F.when(F.col("type") == "table", F.col("ord") % 7))


from . import exchange, structure, translation, articles  # noqa: E402, F401  they register their queries here
