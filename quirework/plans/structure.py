"""Queries of block types, sections, bylines, requests and rendering, and their SQL.

Where documents hold too few of a kind, samples stand in; what a query runs over is always
the whole table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as p
from ..functions import text as t
from ..operators import grouped, layout, rendering
from .catalog import BLOCKS, blocks, inline, query, table


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({c}, {quoted(x[5:] if x.startswith('(?-i)') else '(?i)' + x)})" for x in patterns) + ")"


SAMPLES = (
    "Correspondence should be addressed to A. Author",
    "Case Reports in Medicine 4 of 9",
    "A Rare Finding in a Young Patient",
    "Figure 2: The left side after a week.",
    "Department of Surgery, Some University",
    "3. Case Presentation",
    "3 | Differential findings",
    "Authors' Contributions",
    "References",
    "Funding statement",
    "Hideki Suito 1 | Yuuri Oku 1 | Tomoyuki Kondo 1",
    "Anna Lee, Bo van Dam, Carl Ek, MD",
    "This is a sentence. Another one, with commas, follows",
    "Short and bold",
    "[12] Some Author, A title of a work, 2001.",
    "7. Some Author, Another title.",
    "Plain prose that goes on without any mark of its own.",
)
LINES = ", ".join(f"({k}, {quoted(s)})" for k, s in enumerate(SAMPLES))
BYLINE_SQL = f"""(length(content) between 1 and 400 and not regexp_matches(content, '(^|[^A-Z])[.!?]\\s+[A-Z]')
  and (contains(content, '|') or contains(content, '•') or length(content) - length(replace(content, ',', '')) >= 2)
  and len(list_filter(regexp_split_to_array(content, '{P.BYLINE_SPLIT}'), lambda w: w <> '')) between 3 and 60
  and len(list_filter(regexp_split_to_array(content, '{P.BYLINE_SPLIT}'), lambda w: w <> '' and (regexp_full_match(w, {quoted(P.NAMEY_TOKEN)}) or lower(w) in {P.PARTICLES})))
      >= 0.6::double * len(list_filter(regexp_split_to_array(content, '{P.BYLINE_SPLIT}'), lambda w: w <> ''))
  and len(regexp_extract_all(content, {quoted(P.NAME_TOKEN)})) >= 3)"""
TYPE_SQL = f"""case when rotated or (length(content) <= 600 and {any_of('content', P.FRONT_MATTER)}) then 'other'
  when (y1 <= 72 or y0 >= 728) and length(content) < 300 and {any_of('content', P.RUNNING_HEADER)} then 'other'
  when page_number = 1 and font_size >= 12.15 and length(content) < 300 and y0 < 300 then 'title'
  when {any_of('content', (P.CAPTION,))} then 'figure_caption'
  when {any_of('content', (P.AFFILIATION,))} and length(content) < 500 then 'other'
  when length(content) < 100 and {any_of('content', P.HEADING)} then 'heading'
  when page_number = 1 and {BYLINE_SQL} then 'author'
  when (bold or font_size >= 10.35) and length(content) < 120 and not ends_with(content, '.') then 'heading'
  when regexp_matches(content, {quoted(P.REFERENCE_ITEM)}) then 'reference' else 'paragraph' end"""


def typed(df):
    return p.block_type(F.col("content"), F.col("font_size"), F.lit(9.0), F.col("bold"), F.col("page_number"), F.col("y0"), F.col("y1"), F.lit(800), F.col("rotated"))


@query(f"with {BLOCKS}, b as (select *, ord % 7 = 3 as bold, ord % 97 = 5 as rotated from blocks) select doc_id, ord, {TYPE_SQL} as block_type from b")
def block_classifier(spark, sf_dir):
    """Carrier: lines at fixed places are bold or turned; 9 is the size of the body."""
    b = blocks(spark, sf_dir).withColumns({"bold": F.col("ord") % 7 == 3, "rotated": F.col("ord") % 97 == 5})
    return b.select("doc_id", "ord", typed(b).alias("block_type"))


@query(f"with s as (select k, content, 9 as font_size, k = 13 as bold, false as rotated, 1 as page_number, case when k = 1 then 40 else 400 end as y0, case when k = 1 then 52 else 420 end as y1 from (values {LINES}) as v(k, content)), b as (select * replace (case when k = 2 then 14 else font_size end as font_size, case when k = 2 then 200 else y0 end as y0) from s) select k, {TYPE_SQL} as block_type from b")
def block_classifier_samples(spark, sf_dir):
    at, title = F.when(F.col("k") == 1, 40).when(F.col("k") == 2, 200).otherwise(400), F.when(F.col("k") == 2, 14).otherwise(9)
    b = inline(spark, LINES, "k", "content").withColumns({"font_size": title, "bold": F.col("k") == 13, "rotated": F.lit(False), "page_number": F.lit(1), "y0": at, "y1": F.when(F.col("k") == 1, 52).otherwise(420)})
    return b.select("k", typed(b).alias("block_type"))


@query(f"select k, {any_of('content', (P.AFFILIATION,))} as affiliation, {BYLINE_SQL} as byline, length(content) < 100 and {any_of('content', P.HEADING)} as heading, case when {any_of('content', P.REFERENCE_SECTION)} then 'opens' when {any_of('content', P.OTHER_SECTION)} then 'closes' end as event from (values {LINES}) as v(k, content)")
def line_predicates(spark, sf_dir):
    c = F.col("content")
    return inline(spark, LINES, "k", "content").select("k", p.affiliation(c).alias("affiliation"), p.byline(c).alias("byline"), p.section_heading(c).alias("heading"), p.section_event(c).alias("event"))


TERMS = ", ".join(f"({quoted(x)})" for x in ("Maxillary central incisor", "incisors", "Crown fracture", "Case Report", "Dental School", "root CANINE", "Oral surgery", "funding"))


@query(f"select x as term, regexp_matches(x, {quoted('(?i)' + p.anatomical_pattern())}) as anatomical, regexp_extract(x, {quoted('(?i)' + p.anatomical_pattern())}) as found, lower(x) in {P.LABELS} or {any_of('x', P.LABEL_PATTERNS)} as label from (values {TERMS}) as v(x)")
def term_predicates(spark, sf_dir):
    x, pattern = F.col("term"), "(?iu)" + p.anatomical_pattern()
    return inline(spark, TERMS, "term").select("term", x.rlike(pattern).alias("anatomical"), F.regexp_extract(x, pattern, 0).alias("found"), p.label(x).alias("label"))


@query("""with t as (select r_regionkey as k, r_name as term from region
union all select 100 + n_nationkey, upper(left(n_name, 1)) || lower(substr(n_name, 2)) from nation union all select 200 + n_nationkey, n_name from nation),
o as (select *, row_number() over (partition by lower(term) order by k) as n from t) select k, term from o where n = 1""")
def term_union(spark, sf_dir):
    """Regions, and nations in two spellings: each term once, as first spelled."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    low = F.concat(F.upper(F.left("n_name", F.lit(1))), F.lower(F.substring("n_name", 2, 1 << 20)))
    all_ = r.select(F.col("r_regionkey").cast("bigint").alias("k"), F.col("r_name").alias("term")).unionByName(n.select((100 + F.col("n_nationkey")).cast("bigint").alias("k"), low.alias("term"))).unionByName(n.select((200 + F.col("n_nationkey")).cast("bigint").alias("k"), F.col("n_name").alias("term")))
    return all_.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct("k", "term")).alias("m")).select("m.k", "m.term")


@query(f"with c as (select p_partkey, p_name || ' | ' || p_size as row from part), x as (select p_partkey, unnest(string_split(row, ' | ')) as cell, generate_subscripts(string_split(row, ' | '), 1) as col from c) select p_partkey, col, cell, regexp_matches(cell, '[A-Za-z\\x{{0600}}-\\x{{06FF}}]{{2,}}') as textual from x")
def textual_cells(spark, sf_dir):
    """A part's name and size are a row of a table; cells without words pass as they are."""
    row = F.split(F.concat(F.col("p_name"), F.lit(" | "), F.col("p_size").cast("string")), r" \| ")
    x = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(row).alias("at", "cell"))
    return x.select("p_partkey", (F.col("at") + 1).cast("bigint").alias("col"), "cell", F.col("cell").rlike(P.TEXTUAL_CELL).alias("textual"))


@query(rf"""with {BLOCKS}, c as (select doc_id, ord, case when ord % 3 = 0 then lower(rtrim(content, '.')) else content end as content from blocks),
g as (select *, lag(content) over (partition by doc_id order by ord) as before from c),
e as (select *, ltrim(content) <> '' and (regexp_matches(ltrim(content), '^\p{{Ll}}') or coalesce(rtrim(before) <> '' and not regexp_matches(rtrim(before), '[.!?»"]$'), false)) as goes_on from g),
i as (select *, sum((not goes_on)::int) over (partition by doc_id order by ord rows unbounded preceding) as entry from e)
select doc_id, entry, min(ord) as first_ord, count(*) as n_blocks from i group by 1, 2""")
def reference_continuation(spark, sf_dir):
    """Carrier: lines are entries of a bibliography; every third lost its capital and full stop."""
    cut = F.when(F.col("ord") % 3 == 0, F.lower(F.rtrim("content", F.lit(".")))).otherwise(F.col("content"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = blocks(spark, sf_dir).select("doc_id", "ord", cut.alias("content")).withColumn("on", p.goes_on(F.col("content"), F.lag("content").over(w)))
    b = b.withColumn("entry", F.sum((~F.col("on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc_id", "entry").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_blocks"))


REQUESTS = "(1, 'localhost:8080', null, 'Bearer key', 'application/json', false, 'hi'), (2, 'example.org', null, 'Bearer key', null, false, 'hi'), (3, '127.0.0.1', 'http://a.b', 'Bearer key', null, false, 'hi'), (4, '127.0.0.1', null, 'Bearer other', null, false, 'hi'), (5, 'LOCALHOST', null, 'bearer key ', 'text/plain; q=1', false, 'hi'), (6, 'localhost', '', 'Bearer key', 'Application/JSON; charset=utf-8', true, 'hi'), (7, 'localhost', null, 'Bearer key', '', false, ''), (8, null, null, null, null, null, null), (9, 'localhost', null, null, null, false, 'hi')"


@query(f"""select id, case when lower(trim(split_part(coalesce(host, ''), ':', 1))) not in {P.LOOPBACK} then 403 when coalesce(origin, '') <> '' then 403
when not coalesce(starts_with(lower(auth), 'bearer ') and trim(substr(auth, 8)) = 'key', false) then 401
when lower(trim(split_part(coalesce(kind, ''), ';', 1))) not in ('', 'application/json') then 415 when coalesce(text, '') = '' or coalesce(stream, false) then 400 else 200 end as status
from (values {REQUESTS}) as v(id, host, origin, auth, kind, stream, text)""")
def request_admission(spark, sf_dir):
    names = ("host", "origin", "auth", "kind", "stream", "text")
    return inline(spark, REQUESTS, "id", *names).select("id", p.admission(*map(F.col, names), token="key").alias("status"))


REJECTIONS = "('Model x is not supported', 400), ('inference_failed', 400), ('not found', 404), ('bad request', 400), ('model', null)"


@query(f"select m as message, s as status, coalesce(s = 400 and (contains(lower(m), 'inference_failed') or contains(lower(m), 'model') or contains(lower(m), 'not found')), false) as rejected from (values {REJECTIONS}) as v(m, s)")
def model_rejection(spark, sf_dir):
    return inline(spark, REJECTIONS, "message", "status").withColumn("rejected", F.coalesce(p.model_rejected(F.col("message"), F.col("status")), F.lit(False)))


@query("with n as (select n_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation), a as (select n_regionkey, i, rtrim(n_name || '.', '.') as rendering from n where i % 2 = 1) select n_regionkey, n.i, n_name, rendering from n left join a using (n_regionkey, i)")
def numbered_payload(spark, sf_dir):
    """A region's nations are numbered into one request; the reply has every other line, with a full stop."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("t"))
    n = n.select("n_regionkey", F.transform("t", lambda x: x["n_name"]).alias("t"))
    payload = F.array_join(F.transform("t", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    reply = F.filter(F.split(payload, "\n"), lambda _, i: i % 2 == 0)
    lines = F.transform(reply, lambda x: F.struct(F.regexp_extract(x, P.NUMBERED_REPLY, 1).cast("bigint").alias("i"), F.rtrim(F.regexp_extract(F.concat(x, F.lit(".")), P.NUMBERED_REPLY, 2), F.lit(".")).alias("rendering")))
    terms = n.select("n_regionkey", F.posexplode("t").alias("i", "n_name")).withColumn("i", (F.col("i") + 1).cast("bigint"))
    replies = n.select("n_regionkey", F.inline(lines)).where("i > 0")
    return terms.join(replies, ["n_regionkey", "i"], "left")


@query("select conv_id, trim(coalesce(string_agg(text, chr(10) order by turn) filter (role = 'assistant' and text <> ''), ''), ' ' || chr(10)) as text from conversations group by 1")
def reply_text(spark, sf_dir):
    """Carrier: an assistant's turns are the text parts of a reply, the other turns are tool parts."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "assistant", "text").otherwise("tool").alias("kind"), "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("parts"))
    chosen = F.filter("parts", lambda x: (x["kind"].isNull() | (x["kind"] == "text")) & (F.coalesce(x["text"], F.lit("")) != ""))
    return c.select("conv_id", F.trim(F.array_join(F.transform(chosen, lambda x: x["text"]), "\n"), F.lit(" \n")).alias("text"))


IMAGES = "('png', 'abc'), ('tiff', 'xyz'), ('gif', ''), ('jpeg', 'a b')"


@query(f"select e as ext, 'data:image/' || case when e in {P.IMAGE_TYPES} then e else 'png' end || ';base64,' || base64(b::blob) as uri from (values {IMAGES}) as v(e, b)")
def data_uri(spark, sf_dir):
    v = inline(spark, IMAGES, "ext", "b")
    return v.select("ext", F.concat(F.lit("data:"), p.image_type(F.col("ext")), F.lit(";base64,"), F.base64(F.col("b").cast("binary"))).alias("uri"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _tag(t: str) -> str:
    return f"'<{t} id=\"' || {ESCAPED.format('id')} || '\">' || {ESCAPED.format('content')} || '</{t}>'"


@query(f"""with {BLOCKS}, e as (select *, case when type = 'heading' then ord % 3 = 0 when type = 'paragraph' then false end as event from blocks),
b as (select *, coalesce(last_value(event ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), false) as before from e),
p as (select doc_id, ord, event, case when before and event is not null then '{rendering.CLOSE}' else '' end || case type when 'heading' then {_tag('h2')} when 'paragraph' then {_tag('p')} when 'reference' then {_tag('li')} when 'table' then {_tag('pre')} else '' end || case when event then '{rendering.OPEN}' else '' end as part from b)
select doc_id, string_agg(part, chr(10) order by ord) || case when coalesce(arg_max(event, ord) filter (event is not null), false) then '{rendering.CLOSE}' else '' end as html from p group by 1""")
def html_bodies(spark, sf_dir):
    """Carrier: headings whose number divides by 3 open a bibliography."""
    return rendering.html_bodies(blocks(spark, sf_dir), F.col("ord") % 3 == 0)


@query()
def duplicate_images(spark, sf_dir):
    """Rows only: each image is held against those kept before it. Carrier: blocks moved together are images."""
    near = blocks(spark, sf_dir).withColumns({"y1": F.col("y1") - F.col("y0") + F.floor(F.col("y0") / 8), "y0": F.floor(F.col("y0") / 8)})
    return grouped.drop_overlapping(near.select("doc_id", "page_number", "ord", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))


@query(f"""with {BLOCKS}, i as (select * from blocks where type in ('table', 'reference')), f as (select * from i where type = 'table')
select i.doc_id, i.page_number, i.ord, min(f.ord) as primary_ord from i join f on i.doc_id = f.doc_id and i.page_number = f.page_number and i.type = 'reference'
and least(i.x1, f.x1) - greatest(i.x0, f.x0) >= 0.4::double * least(i.x1 - i.x0, f.x1 - f.x0) and least(abs(i.y0 - f.y1), abs(f.y0 - i.y1)) <= 280 group by 1, 2, 3""")
def panel_absorb(spark, sf_dir):
    """Carrier: tables are figures with a caption, references the other images."""
    return layout.absorb_panels(blocks(spark, sf_dir).where("type in ('table', 'reference')"), F.col("type") == "table")


@query(f"with {BLOCKS} select doc_id, ord, json_object('id', id, 'type', type, 'page', page_number, 'bbox', json_object('x0', x0, 'y0', y0, 'x1', x1, 'y1', y1))::varchar as block from blocks")
def block_json(spark, sf_dir):
    bbox = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    return blocks(spark, sf_dir).select("doc_id", "ord", F.to_json(F.struct("id", "type", F.col("page_number").alias("page"), bbox)).alias("block"))


@query()
def post_process(spark, sf_dir):
    """Rows only: a backreference, which the oracle's engine lacks."""
    done = blocks(spark, sf_dir).withColumn("content", t.post_process(F.col("content"), F.col("type")))
    return done.where((F.col("content") != "") | (F.col("type") == "figure")).select("doc_id", "ord", "content")
