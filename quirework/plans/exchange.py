"""Queries of terms, requests and replies, marks and scans of tables and images, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as t
from ..operators import terms
from .catalog import inline, query, table
from .structure import quoted

WORDS = {"the": "DIE", "and": "UND", "of the": "DER", "to": "ZU"}


def _inject_sql(source: str, renderings: dict[str, str]) -> str:
    pattern = quoted("(?i)" + terms.term_pattern(renderings))
    case = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in renderings.items())
    return f"""with s as ({source}), c as (select id, ord, regexp_split_to_array(content, {pattern}) as parts, regexp_extract_all(content, {pattern}) as hits from s),
x as (select id, ord, parts, hits, unnest(range(1, len(parts) + 1)) as pos from c), y as (select id, ord, pos, parts[pos] as before, case when pos <= len(hits) then lower(hits[pos]) end as term from x),
z as (select *, row_number() over (partition by id, term order by ord, pos) = 1 as first, case term {case} end as put from y)
select id, ord, string_agg(before || case when term is null then '' when first then put || ' (' || term || ')' else put end, '' order by pos) as content from z group by 1, 2"""


@query(_inject_sql("select conv_id as id, turn as ord, text as content from conversations where text is not null", WORDS))
def term_injection(spark, sf_dir):
    """Carrier: some short words are the terms, conversations the documents."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    return terms.inject_terms(c, WORDS, "id")


PROSE = "(1, 0, 'A complicated crown-root fracture and a crown-root fracture; the Pulp tissue.'), (1, 1, 'The pulp, the PULP TISSUE, pulpal walls, radiolucent.'), (2, 0, 'Pulp.'), (2, 1, ''), (2, 2, 'No term')"


@query(_inject_sql(f"select * from (values {PROSE}) as v(id, ord, content)", P.GLOSSARY))
def glossary_injection(spark, sf_dir):
    return terms.inject_terms(inline(spark, PROSE, "id", "ord", "content"), P.GLOSSARY, "id")


HEADS = "('Abstract'), ('1. Introduction'), ('Case report'), ('Methods'), ('')"


@query(f"select h as heading, coalesce(case lower(h) {' '.join(f'when {quoted(k)} then {quoted(v)}' for k, v in P.HEADING_RENDERINGS.items())} end, h) as rendering from (values {HEADS}) as v(h)")
def heading_rendering(spark, sf_dir):
    h = inline(spark, HEADS, "heading")
    return h.withColumn("rendering", F.coalesce(terms.rendering_of(F.col("heading"), P.HEADING_RENDERINGS), "heading"))


CATALOGUES = """(1, '{"data": [{"id": "zen/b"}, {"id": "zen/a-free"}]}'), (2, '{"models": [{"id": "c"}, {"name": "no id"}]}'), (3, '{"data": []}'), (4, 'broken')"""


@query(f"""with c as (select k, case when json_valid(j) then j::json end as j from (values {CATALOGUES}) as v(k, j)), m as (select k, unnest(case when json_array_length(j, '$.data') > 0 then json_extract_string(j, '$.data[*].id') else json_extract_string(j, '$.models[*].id') end) as model from c) select k, model, row_number() over (partition by k order by model) as place from m where model is not null""")
def model_catalogue(spark, sf_dir):
    """The ids under data, or else under models, in order."""
    ids = "array<struct<id:string>>"
    c = inline(spark, CATALOGUES, "k", "j").withColumn("j", F.from_json("j", f"data {ids}, models {ids}"))
    listed = F.when(F.size("j.data") > 0, F.col("j.data")).otherwise(F.col("j.models"))
    models = F.array_sort(F.filter(F.transform(listed, lambda x: x["id"]), lambda x: x.isNotNull()))
    return c.select("k", F.posexplode(models).alias("place", "model")).withColumn("place", (F.col("place") + 1).cast("bigint"))


@query("""select r_regionkey, replace(replace(json_object('term', r_name, 'note', '</script> <' || r_name || '>')::varchar, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e') as note from region""")
def script_notes(spark, sf_dir):
    """Notes as JSON that may stand in a script of a page."""
    note = F.concat(F.lit("</script> <"), F.col("r_name"), F.lit(">"))
    return table(spark, sf_dir, "region").select("r_regionkey", t.script_safe_json(F.to_json(F.struct(F.col("r_name").alias("term"), note.alias("note")))).alias("note"))


@query("""select conv_id, turn, json_object('object', 'chat.completion', 'choices', json_array(json_object('index', 0, 'message', json_object('role', 'assistant', 'content', role), 'finish_reason', 'stop')), 'usage', json_object('prompt_tokens', 0, 'completion_tokens', 0, 'total_tokens', 0))::varchar as response from conversations""")
def chat_response(spark, sf_dir):
    """Replies in the shape clients know, with no usage. Carrier: roles are the contents."""
    def zero(*names):
        return F.struct(*[F.lit(0).alias(n) for n in names])

    message = F.struct(F.lit("assistant").alias("role"), F.col("role").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    body = F.struct(F.lit("chat.completion").alias("object"), F.array(choice).alias("choices"), zero("prompt_tokens", "completion_tokens", "total_tokens").alias("usage"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(body).alias("response"))


@query("""with c as (select l_orderkey, l_linenumber, l_returnflag as a, case when l_partkey % 4 > 0 then l_linestatus else '' end as b, case when l_partkey % 3 = 0 then '' else l_returnflag end as c from lineitem),
r as (select l_orderkey, count(*) filter (trim(c) <> '' or trim(b) <> '') as n_rows from c group by 1) select l_orderkey, n_rows from r where n_rows >= 2 and l_orderkey % 100 < 80""")
def table_scan(spark, sf_dir):
    """Grids of at least two rows that are not empty, two columns, and at most 0.8 of the page.
    Carrier: an order's lines are rows, the key's last digits the area in percent."""
    odd = F.when(F.col("l_partkey") % 4 > 0, F.col("l_linestatus")).otherwise(""), F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.col("l_returnflag"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(*odd)).alias("rows"), F.first(F.col("l_orderkey") % 100).alias("area"))
    full = F.filter("rows", lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    g = g.withColumn("rows", full).where((F.col("area") < 80) & (F.size("rows") >= 2))
    wide = g.where(F.array_max(F.transform("rows", F.size)) >= 2)
    return wide.select("l_orderkey", F.size("rows").cast("bigint").alias("n_rows"))


SCANS = "(1, 'png', 3, 0, 100.0, 40.0), (2, 'jpx', 3, 0, 90.0, 90.0), (3, 'jpeg', 4, 0, 60.0, 60.0), (4, 'jpeg', 3, 9, 60.0, 60.0), (5, 'png', 3, 9, 39.0, 90.0), (0, 'gif', 3, 0, 90.0, 90.0), (7, 'tiff', 3, 0, null, 90.0), (8, 'png', 1, 2, 50.0, 50.0)"


@query(f"with s as (select * from (values {SCANS}) as v(xref, ext, space, mask, w, h) where least(w, h) >= 40 and w is not null and h is not null and xref <> 0), c as (select *, ext not in ('png', 'jpeg', 'jpg', 'gif', 'webp') or space = 4 or (mask > 0 and ext <> 'png') as encode from s) select xref, encode, 'figure-' || row_number() over (partition by xref % 2 order by xref) || '.' || case when encode then 'png' else ext end as file from c")
def image_scan(spark, sf_dir):
    """Images of 40 points and more with a place; which are encoded anew, and their files, numbered
    in each document. Carrier: odd and even numbers are two documents."""
    s = inline(spark, SCANS, "xref", "ext", "space", "mask", "w", "h").where(F.col("w").isNotNull() & F.col("h").isNotNull() & (F.least("w", "h") >= 40) & (F.col("xref") != 0))
    encode = ~F.col("ext").isin("png", "jpeg", "jpg", "gif", "webp") | (F.col("space") == 4) | ((F.col("mask") > 0) & (F.col("ext") != "png"))
    number = F.row_number().over(Window.partitionBy(F.col("xref") % 2).orderBy("xref")).cast("string")
    return s.select("xref", encode.alias("encode"), F.concat(F.lit("figure-"), number, F.lit("."), F.when(encode, "png").otherwise(F.col("ext"))).alias("file"))


@query("select conv_id, turn, case when role = 'user' then coalesce(text, '') else role end as source, coalesce(nullif(case when turn % 3 = 0 then '' else text end, ''), case when role = 'user' then coalesce(text, '') else role end) as target, turn % 3 = 0 or coalesce(text, '') = '' as untranslated, case when turn % 3 = 0 or coalesce(text, '') = '' then left('empty result for ' || coalesce(text, ''), 300) end as reason from conversations")
def mark_untranslated(spark, sf_dir):
    """Carrier: users' turns are texts, other turns captions kept in role; every third reply is empty."""
    source = F.when(F.col("role") == "user", F.coalesce("text", F.lit(""))).otherwise(F.col("role"))
    reply = F.nullif(F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")), F.lit(""))
    reason = F.left(F.concat(F.lit("empty result for "), F.coalesce("text", F.lit(""))), F.lit(300))
    c = table(spark, sf_dir, "conversations").withColumns({"source": source, "reply": reply})
    return c.select("conv_id", "turn", "source", F.coalesce("reply", "source").alias("target"), F.col("reply").isNull().alias("untranslated"), F.when(F.col("reply").isNull(), reason).alias("reason"))


MARKS = "('[12] A work'), ('7. A work'), ('3) A work'), ('2000. A year'), ('[1234] No marker'), ('No marker'), ('  [5]  Spaced')"


@query(f"select x as line, coalesce(nullif(regexp_extract(x, {quoted(P.REFERENCE_MARKER)}, 1), ''), nullif(regexp_extract(x, {quoted(P.REFERENCE_MARKER)}, 2), '')) as number, regexp_replace(x, {quoted(P.REFERENCE_MARKER)}, '') as text from (values {MARKS}) as v(x)")
def marker_strip(spark, sf_dir):
    x = F.col("line")
    number = F.coalesce(*[F.nullif(F.regexp_extract(x, P.REFERENCE_MARKER, k), F.lit("")) for k in (1, 2)])
    return inline(spark, MARKS, "line").select("line", number.alias("number"), F.regexp_replace(x, P.REFERENCE_MARKER, "").alias("text"))
