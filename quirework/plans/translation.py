"""Queries of pages with real measures, bibliographies, term pairs and translation runs, and
their SQL. Where documents hold nothing of a kind, a carrier is made from their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as p
from ..functions import text as t
from ..operators import pages, provider, references, rendering, term_pairs, translate
from ..sources.sample import sample_blocks
from .catalog import BLOCKS, KEY, SQL, blocks, inline, query, table
from .exchange import WORDS
from .structure import quoted


def measured(df: DataFrame) -> DataFrame:
    return df.withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})


@query(f"""with {BLOCKS}, b as (select * replace (case when ord % 20 = 0 and doc_id % 2 = 0 then 'Some Journal  of Records' else content end as content) from blocks),
k as (select *, {KEY} as key, (y1 <= 72 or y0 >= 728) and length(trim(content, ' ')) between 1 and 400 as counted from b),
n as (select *, count(*) filter (counted) over (partition by doc_id, key) as n, max(page_number) over (partition by doc_id) as pages from k)
select doc_id, ord, case when pages >= 2 and n >= 2 then 'other' else type end as type from n""")
def running_headers_marked(spark, sf_dir):
    """Carrier: the pages of every other document begin with one line."""
    same = (F.col("ord") % 20 == 0) & (F.col("doc_id") % 2 == 0)
    b = blocks(spark, sf_dir).withColumn("content", F.when(same, "Some Journal  of Records").otherwise(F.col("content")))
    return pages.mark_running_headers(measured(b)).select("doc_id", "ord", "type")


@query(f"""with {BLOCKS}, b as (select * replace (case when type = 'heading' and length(content) % 7 = 0 then 'title' else type end as type) from blocks),
a as (select doc_id, min(struct_pack(k := case when type = 'title' then 0 else 1 end, s := case when type = 'title' then 0 else -font_size end, o := ord, y := y0)) as a from b where page_number = 1 and type not in ('figure', 'figure_caption', 'table') group by 1)
select doc_id, ord from b left join a using (doc_id) where not (page_number = 1 and coalesce(a.y < 400 and (a.k = 0 or a.s < 0), false) and type not in ('title', 'figure', 'figure_caption', 'table') and y1 <= coalesce(a.y, 0) + 2 and length(content) < 300)""")
def above_title_dropped(spark, sf_dir):
    """Carrier: headings whose length divides by 7 are titles; elsewhere the largest type counts."""
    title = (F.col("type") == "heading") & (F.length("content") % 7 == 0)
    return pages.drop_above_title(measured(blocks(spark, sf_dir).withColumn("type", F.when(title, "title").otherwise(F.col("type"))))).select("doc_id", "ord")


@query()
def pages_in_order(spark, sf_dir):
    """Tested against a plain version: bands by centre, blocks between bands."""
    return pages.order_pages(measured(blocks(spark, sf_dir)))


def cut_lines(df: DataFrame) -> DataFrame:
    """Carrier: lines of one size; every other loses its capital and full stop, as if it went on,
    and a page's first line is a paragraph."""
    first = F.when(F.col("ord") % 20 == 0, "paragraph").otherwise(F.col("type"))
    return df.withColumns({"font_size": F.lit(9), "type": first}).withColumn("content", F.when(F.pmod(F.col("ord") + F.col("doc_id"), F.lit(2)) == 0, F.lower(F.rtrim("content", F.lit(".")))).otherwise(F.col("content")))


@query()
def pages_merged(spark, sf_dir):
    """Tested against a plain version that goes from page to page."""
    out = pages.merge_over_pages(measured(cut_lines(blocks(spark, sf_dir))))
    return out.select("doc_id", "page_number", "ord", "content", "x0", "y0", "x1", "y1", "merged_page")


@query(f"""with {BLOCKS}, b as (select * replace (case when type = 'heading' and length(content) % 3 = 0 then 'References' else content end as content) from blocks),
e as (select *, sum((type <> 'reference')::int) over (partition by doc_id, page_number order by ord rows unbounded preceding) as island, case when type = 'heading' then content = 'References' end as event from b),
s as (select *, coalesce(last_value(event ignore nulls) over (partition by doc_id order by ord rows unbounded preceding), false) as in_section, count(*) filter (type = 'reference') over (partition by doc_id, page_number, island) as run from e)
select doc_id, ord, type = 'reference' and (run >= 2 or in_section) as in_run from s""")
def reference_run_flags(spark, sf_dir):
    """Carrier: headings whose length divides by 3 name the bibliography."""
    named = (F.col("type") == "heading") & (F.length("content") % 3 == 0)
    b = blocks(spark, sf_dir).withColumn("content", F.when(named, "References").otherwise(F.col("content")))
    return pages.reference_runs(b).select("doc_id", "ord", "in_run")


def bibliographies(df: DataFrame) -> DataFrame:
    """Carrier: a document's first line opens its bibliography; other lines lose their end or get
    one or two markers, and some a heading's type."""
    n, c = F.length("content"), F.col("content")
    first = F.initcap(F.split_part(c, F.lit(" "), F.lit(1)))
    text = F.when(F.col("ord") == 0, "References").when(n % 5 == 0, F.concat(F.lit("["), (F.col("ord") + 1).cast("string"), F.lit("] A. "), c)).when(n % 5 == 1, F.concat(c, F.lit(" 12. "), first, F.lit(" 1989, 3. "), first)).when(n % 5 == 2, F.rtrim(c, F.lit("."))).otherwise(c)
    kind = F.when(F.col("ord") == 0, "heading").when(n % 17 == 3, "figure").otherwise("paragraph")
    return df.withColumns({"type": kind, "content": F.when(n % 23 == 5, "Funding").otherwise(text)}).withColumn("type", F.when(F.col("content") == "Funding", "heading").otherwise(F.col("type")))


@query()
def reference_entries(spark, sf_dir):
    """Tested against a plain version: the pattern looks around itself, entries go on over blocks."""
    return references.bibliography(bibliographies(blocks(spark, sf_dir)))


@query()
def reference_split(spark, sf_dir):
    """Tested against a plain version: each block cut into its numbered entries."""
    x = references.entries_of_blocks(bibliographies(blocks(spark, sf_dir)))
    return x.select("doc_id", "ord", "position", "id", "ref_number", "entry")


@query()
def figures_linked(spark, sf_dir):
    """Tested against a plain version. Carrier: tables are figures, short lines their captions."""
    b = measured(blocks(spark, sf_dir)).withColumns({c: F.col(c).cast("double") for c in pages.BOX})
    figures = b.where("type = 'table'").withColumn("figure_num", F.col("ord") % 7)
    captions = b.where("type = 'heading'").withColumn("caption_num", F.col("ord") % 7)
    return pages.link_figures(figures, captions)


@query()
def figures_united(spark, sf_dir):
    """Tested against a plain version. Carrier: tables are figures, moved together."""
    b = blocks(spark, sf_dir).where("type = 'table'").withColumns({"y1": (F.col("y1") - F.col("y0") + F.floor(F.col("y0") / 24)).cast("double"), "y0": F.floor(F.col("y0") / 24).cast("double"), "x0": F.col("x0").cast("double"), "x1": F.col("x1").cast("double")})
    return pages.unite_figures(b)


STATUS = (200, 200, 200, 200, 404, 401, 500, 200, 403, 200)
DOWNLOADS = f"""select page_id, {list(STATUS)}[page_id % 10 + 1] as status, case when page_id % 4 = 0 then 'Text/HTML; charset=utf-8' else 'application/pdf' end as kind,
case when page_id % 3 = 0 then '%PDF-1.7 ' || url else html end as head, (page_id % 50) * 5000000 as declared, case when page_id % 6 = 0 then 50 else length(html) end as size from pages"""


@query(f"""with d as ({DOWNLOADS}) select page_id, case when status in (401, 403) then 'inaccessible' when status >= 400 then 'failed' when contains(lower(substr(head, 1, 1024)), '<html') or contains(lower(kind), 'text/html') then 'inaccessible'
when not contains(substr(head, 1, 1024), '%PDF-') then 'invalid' when declared > 157286400 or size > 157286400 then 'failed' when size < 100 then 'invalid' else 'ok' end as outcome from d""")
def download_outcomes(spark, sf_dir):
    """Carrier: pages get a status, a type and sizes from their number; some hold a document."""
    n = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, STATUS)), (n % 10 + 1).cast("int"))
    kind, head = F.when(n % 4 == 0, "Text/HTML; charset=utf-8").otherwise("application/pdf"), F.when(n % 3 == 0, F.concat(F.lit("%PDF-1.7 "), "url")).otherwise(F.col("html"))
    size = F.when(n % 6 == 0, 50).otherwise(F.length("html"))
    return table(spark, sf_dir, "pages").select("page_id", p.download_outcome(status, kind, head, (n % 50) * 5_000_000, size).alias("outcome"))


@query("""select page_id, case when page_id % 2 = 0 then url else substr(url, 9) end as source, page_id % 2 = 0 as remote, contains(url, 'localhost') or page_id % 5 = 0 as local, page_id % 3 = 0 as own
from pages where url is not null""")
def source_resolve(spark, sf_dir):
    """Carrier: urls with blanks and quotes around them, some of local hosts; files of two kinds."""
    n, url = F.col("page_id"), F.col("url")
    given = F.concat(F.lit(" \t\"'"), F.when(n % 2 == 0, url).otherwise(F.substring(url, 9, 1 << 20)), F.lit("'\"\n "))
    host = F.when(n % 5 == 0, "http://127.0.0.1:80/v1").otherwise(url)
    name = F.concat(F.when(n % 3 == 0, "figure-").otherwise("photo-figure-"), n.cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "pages").where("url is not null").select("page_id", p.source_path(given).alias("source"), p.local_endpoint(host).alias("local"), p.own_asset(name).alias("own"))
    return rows.withColumn("remote", p.url_kind(F.col("source")) == "url")


def with_pairs(df: DataFrame) -> DataFrame:
    """Carrier: lines with a sentence of a rendering and its English name, some spoiled."""
    names, words = list(P.CLINICAL_TERMS), list(P.CLINICAL_TERMS.values())
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("ord") * 7 + F.col("doc_id"), F.lit(len(names))) + 1).cast("int"))
    lead = F.element_at(F.array(*map(F.lit, (". درمان شد و ", "، با ", " «نقل» ", " و ", ": این متن بسیار دراز است و پیش از نام هیچ مرز دیگری ندارد تا جستجو ناکام بماند و "))), (F.col("ord") % 5 + 1).cast("int"))
    name = F.when(F.col("ord") % 11 == 0, "maxillary incisor").when(F.col("ord") % 13 == 0, "Dental School").otherwise(F.lower(pick(names)))
    return df.withColumn("content", F.concat("content", lead, pick(words), F.lit(" ("), name, F.lit(") & (x < 1) (plain 3%)")))


@query()
def pairs_in_text(spark, sf_dir):
    """Tested against a plain version that goes back character by character."""
    return term_pairs.term_pairs(with_pairs(blocks(spark, sf_dir)), ["doc_id", "ord"])


@query()
def terms_marked(spark, sf_dir):
    """Tested against a plain version."""
    return term_pairs.mark_terms(with_pairs(blocks(spark, sf_dir)).select("doc_id", "ord", "content")).select("doc_id", "ord", "markup")


@query()
def renderings_of_documents(spark, sf_dir):
    """Tested against a plain version: each term as first written in its document."""
    return term_pairs.first_renderings(term_pairs.term_pairs(with_pairs(blocks(spark, sf_dir)), ["doc_id", "ord"]), "doc_id", ["ord"])


FOLD = r"case when length({0}) > 3 and regexp_matches({0}, 's$') and not regexp_matches({0}, '(ss|is|us)$') then left({0}, length({0}) - 1) else {0} end"


@query(rf"""with w as (select p_partkey, p_name || case when p_partkey % 2 = 0 then 's' else '' end as english, case when p_partkey % 3 = 0 then '' else p_type end as rendering from part),
k as (select *, trim(lower(regexp_replace(english, '\s+', ' ', 'g')), ' ') as k from w), q as (select *, {FOLD.format('k')} as key from k),
n as (select trim(lower(regexp_replace(p_name, '\s+', ' ', 'g')), ' ') as k, p_brand as note, p_partkey as place from part where p_partkey % 7 = 0),
a as (select {FOLD.format('k')} as key, arg_max(note, place) as note from n group by 1)
select p_partkey, english, coalesce(a.note, case when rendering <> '' then english || {quoted(P.TERM_NOTE[1])} || rendering || {quoted(P.TERM_NOTE[2])} end, 'no note') as note from q left join a using (key)""")
def notes_merge(spark, sf_dir):
    """Carrier: parts are terms, their types renderings, every seventh has a note of its own."""
    n = F.col("p_partkey")
    terms = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(n % 2 == 0, "s").otherwise("")).alias("english"), F.when(n % 3 == 0, "").otherwise(F.col("p_type")).alias("rendering"))
    notes = table(spark, sf_dir, "part").where(n % 7 == 0).select(F.upper("p_name").alias("term"), F.col("p_brand").alias("note"), n.alias("place"))
    return term_pairs.notes_for(terms.withColumn("term_key", t.term_key(F.col("english"))), notes, "no note").select("p_partkey", "english", "note")


KNOWN = ", ".join(f"({k}, {quoted(x)})" for k, x in enumerate((*P.CLINICAL_TERMS, *P.ANATOMICAL_TERMS)))


@query(f"""with t as (select k, term from (values {KNOWN}) as v(k, term) union all select 1000 + p_partkey, p_name from part), o as (select *, row_number() over (partition by lower(term) order by k) as n from t) select k, term from o where n = 1""")
def known_terms(spark, sf_dir):
    """The clinical and anatomical terms, then those a run meets (parts), as first spelled."""
    met = table(spark, sf_dir, "part").select((1000 + F.col("p_partkey")).alias("k"), F.col("p_name").alias("term"))
    all_ = inline(spark, KNOWN, "k", "term").withColumn("k", F.col("k").cast("bigint")).unionByName(met)
    return all_.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct("k", "term")).alias("m")).select("m.k", "m.term")


MODEL = "offline-1"


def run_over(spark, sf_dir) -> translate.Run:
    """Carrier: every fourth reference is in a run, texts of some lengths fail or are cached, with
    noughts turned to ones."""
    b = blocks(spark, sf_dir).withColumn("in_run", F.col("ord") % 4 == 0)
    kind = F.when(F.col("type") == "reference", "reference").otherwise("text")
    cached = b.where(F.length("content") % 3 == 0).select(t.cache_key(F.lit(MODEL), kind, F.lit(""), F.col("content")).alias("key"), F.translate("content", "0", "1").alias("value")).distinct()
    ask = lambda texts: provider.provider("offline")(texts, terms=WORDS)
    return translate.translation_run(b, cached, ask, MODEL, 3, F.length("content") % 4 == 1)


RUN = f"""with {BLOCKS}, j as (select *, type = 'reference' and ord % 4 = 0 as kept, type in ('heading', 'paragraph', 'reference') and not (type = 'reference' and ord % 4 = 0) as job from blocks),
f as (select *, length(content) % 4 = 1 as failed, length(content) % 3 = 0 as hit, row_number() over (partition by doc_id order by ord) as rn from j where job),
g as (select *, sum((not failed)::int) over (partition by doc_id order by ord rows unbounded preceding) as good from f),
s as (select *, sum(failed::int) over (partition by doc_id, good order by ord rows unbounded preceding) as streak from g),
r as (select *, min(case when streak >= 3 then rn end) over (partition by doc_id) as trip from s),
o as (select *, case when rn > trip then 'skipped' when failed then 'failed' else 'done' end as outcome from r)"""


@query(f"""{RUN},
a as (select j.doc_id, j.ord, j.id, j.kept, j.type, j.content, o.outcome, o.hit from j left join o on j.doc_id = o.doc_id and j.ord = o.ord)
select doc_id, count(outcome) as total, count(*) filter (outcome = 'done') as translated, count(*) filter (outcome = 'failed') as failed, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (kept) as kept_original,
count(*) filter (hit) as cache_hits, count(*) filter (outcome = 'done' and hit and type = 'paragraph' and contains(content, '0')) as with_warnings, coalesce(bool_or(outcome = 'skipped'), false) as breaker_open,
coalesce(array_to_string((list(id order by ord) filter (outcome = 'failed'))[1:3], ','), '') as first_failures from a group by 1""")
def translation_report(spark, sf_dir):
    """The report of a whole run; total = translated + failed + skipped."""
    return run_over(spark, sf_dir).report


@query()
def translation_blocks(spark, sf_dir):
    """Tested against a plain version of the run."""
    return run_over(spark, sf_dir).blocks.select("doc_id", "ord", "translated", "outcome", "reason", "hit")


@query(f"""{RUN}, x as (select * from o where outcome = 'done' and not hit)
select distinct sha256('{MODEL}' || chr(0) || case when type = 'reference' then 'reference' else 'text' end || chr(0) || '' || chr(0) || content) as key, left(content, 400) as source from x""")
def cache_inserts(spark, sf_dir):
    """What the cache gets: texts that were translated and not known, each once."""
    return run_over(spark, sf_dir).cache.select("key", "source")


CELL = "case when regexp_matches({0}, '[A-Za-z\\x{{{{0600}}}}-\\x{{{{06FF}}}}]{{{{2,}}}}') and length({0}) % 5 <> 0 then '<' || {0} || '>' else {0} end".replace("{{{{", "{{").replace("}}}}", "}}")


@query(f"""with c as (select conv_id, turn, role, turn::varchar as n, left(coalesce(text, ''), 20) as snippet from conversations),
r as (select conv_id, turn, {CELL.format('role')} || ' | ' || n || ' | ' || {CELL.format('snippet')} as line,
  regexp_matches(role, '[A-Za-z]{{2,}}')::int + regexp_matches(snippet, '[A-Za-z\\x{{0600}}-\\x{{06FF}}]{{2,}}')::int as cells,
  (regexp_matches(role, '[A-Za-z]{{2,}}') and length(role) % 5 = 0)::int + (regexp_matches(snippet, '[A-Za-z\\x{{0600}}-\\x{{06FF}}]{{2,}}') and length(snippet) % 5 = 0)::int as bad from c)
select conv_id, string_agg(line, chr(10) order by turn) as grid, sum(cells)::bigint as n_cells, sum(bad)::bigint as n_failed from r group by 1""")
def table_translation(spark, sf_dir):
    """Carrier: a conversation's turns are a table's rows; the provider puts cells in brackets and
    has nothing for some."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.left(F.coalesce("text", F.lit("")), F.lit(20)).alias("s")))), lambda x: F.array(x["role"], x["turn"].cast("string"), x["s"]))
    grids = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(rows.alias("rows")).withColumn("ord", F.lit(0))
    ask = lambda texts: texts.withColumn("reply", F.when(F.length("text") % 5 == 0, "").otherwise(F.concat(F.lit("<"), "text", F.lit(">"))))
    out = translate.translate_tables(grids, ask)
    grid = F.array_join(F.transform("translated", lambda r: F.array_join(r, " | ")), "\n")
    return out.select(F.col("doc_id").alias("conv_id"), grid.alias("grid"), "n_cells", "n_failed")


@query()
def caption_replies(spark, sf_dir):
    """Tested against a plain version. Carrier: lines are captions of figures, some without a number."""
    c = F.concat(F.element_at(F.array(*map(F.lit, ("Figure ", "Fig. ", "شکل ", "Note "))), (F.col("ord") % 4 + 1).cast("int")), F.col("ord").cast("string"), F.lit(". "), "content")
    texts = blocks(spark, sf_dir).select("doc_id", "ord", F.lit("caption").alias("kind"), c.alias("text"))
    return provider.offline(texts, WORDS).select("doc_id", "ord", "reply")


@query()
def number_warnings(spark, sf_dir):
    """Tested against a plain version. Carrier: lines, with noughts turned to ones and signs gone."""
    b = blocks(spark, sf_dir).withColumn("w", translate.number_warnings(F.col("content"), F.translate("content", "0%", "1")))
    return b.where(F.size("w") > 0).select("doc_id", "ord", F.array_join("w", "\n").alias("warnings"))


@query(SQL["message_flatten"])
def request_scan(spark, sf_dir):
    """Requests as JSON bodies, parsed and flattened. Carrier: conversations are the bodies' messages,
    every other text as a list of parts, of which those of type text count."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.to_json(F.array(part("image", F.lit("skip")), part("text", F.col("text"))))
    content = F.when(F.col("turn") % 2 == 0, parts).otherwise(F.to_json(F.array("text")))
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))).alias("messages"), F.lit(False).alias("stream")))
    bodies = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))
    return translate.parse_requests(bodies, "conv_id", "body").drop("stream")


@query(f"with {BLOCKS} select doc_id, ord, row_number() over (partition by doc_id order by ord) as number from blocks where type = 'table'")
def figures_in_order(spark, sf_dir):
    """Carrier: tables are figures."""
    return pages.figures_in_order(blocks(spark, sf_dir), "table").select("doc_id", "ord", "number")


@query(f"with {BLOCKS} select doc_id, ord from blocks where type in ('title', 'heading', 'paragraph', 'figure_caption', 'reference') and trim(content, ' ') <> ''")
def translatable_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).where(translate.translatable(F.col("type"), F.col("content"))).select("doc_id", "ord")


@query(f"""with h as ({SQL['html_bodies']}), m as ({SQL['document_title']})
select doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="fa" dir="rtl">' || chr(10) || '<head><meta charset="utf-8"><title>' || n || '</title></head>' || chr(10) || '<body>' || chr(10) || '<header><h1>' || n || '</h1></header>' || chr(10) || '<main>' || chr(10) || html || chr(10) || '</main>' || chr(10) || '<script type="application/json" id="notes">[]</script>' || chr(10) || '</body>' || chr(10) || '</html>' as html
from (select doc_id, html, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as n from h left join m using (doc_id))""")
def html_documents(spark, sf_dir):
    b = blocks(spark, sf_dir)
    bodies = rendering.html_bodies(b, F.col("ord") % 3 == 0)
    titles = b.where("type = 'heading'").groupBy("doc_id").agg(F.min_by("content", "ord").alias("title"))
    return bodies.join(titles, "doc_id", "left").select("doc_id", rendering.html_document(F.col("title"), F.col("html"), F.lit("[]")).alias("html"))


@query()
def sample_document(spark, sf_dir):
    """The document with a real layout, through the whole of page and document rules."""
    b = pages.drop_above_title(pages.mark_running_headers(sample_blocks(spark)))
    order = pages.order_pages(b)
    b = b.join(order, ["doc_id", "page_number", "ord"]).withColumn("ord", (F.col("page_number") * 1000 + F.col("reading_ord")).cast("int")).drop("reading_ord")
    return pages.merge_over_pages(b).select("doc_id", "page_number", "ord", "type", "content", "merged_page")
