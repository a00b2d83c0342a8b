"""Queries of text layers, inspections and article bodies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import article, term_pairs
from ..sources import spans
from .catalog import BLOCKS, QUERIES, SQL, blocks, query


def raw_layer(spark, sf_dir) -> DataFrame:
    """Carrier: a document's lines are blocks of its text layer, cut at commas into lines of two spans,
    whose size and weight follow from their length; some lines are turned."""
    piece = lambda x: F.struct(
        F.when(F.col("block_no") % 97 == 5, 1.0).otherwise(0.0).alias("dir_y"),
        F.transform(F.array(F.left(x, F.lit(5)), F.substring(x, F.lit(6), F.length(x))), lambda t: F.struct(
            t.alias("text"), (F.lit(8.25) + F.length(x) % 5).alias("size"), F.when(F.length(x) % 11 == 0, 16).otherwise(0).alias("flags"), F.when(F.length(x) % 7 == 0, "Times-Bold").otherwise("Times").alias("font"),
        )).alias("spans"),
    )
    b = blocks(spark, sf_dir).withColumnRenamed("ord", "block_no")
    return b.select("doc_id", "page_number", "block_no", F.transform(F.split("content", ", "), piece).alias("lines"), "x0", "y0", "x1", "y1", F.lit(800.0).alias("page_height"))


LAYER = f"with {BLOCKS}, r as (select doc_id, page_number, ord as n, string_split(content, ', ') as p from blocks)"


@query(rf"""{LAYER}, t as (select doc_id, page_number, n, list_filter(p, lambda x: x <> '') as q, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> '') as clean from r),
s as (select *, array_to_string(clean, ' ') as content, list_max(list_transform(q, lambda x: 8.25::double + length(x) % 5)) as font_size, len(list_filter(q, lambda x: length(x) % 11 = 0 or length(x) % 7 = 0)) > 0 as is_bold,
  list_sum(list_transform(q, lambda x: length(trim(left(x, 5), ' ')) + length(trim(substr(x, 6), ' '))))::bigint as char_count from t)
select doc_id, row_number() over (partition by doc_id order by n) - 1 as ord, 'p' || page_number || '_b' || row_number() over (partition by doc_id, page_number order by n) as id, content, font_size, is_bold, char_count, n % 97 = 5 as rotated
from s where length(regexp_replace(content, '[^A-Za-z0-9\x{{0600}}-\x{{06FF}}]', '', 'g')) >= 2""")
def text_layer(spark, sf_dir):
    return spans.text_blocks(raw_layer(spark, sf_dir)).select("doc_id", "ord", "id", "content", "font_size", "is_bold", "char_count", "rotated")


@query(f"""{LAYER}, x as (select doc_id, n, unnest(p) as piece, generate_subscripts(p, 1) as line from r where n // 20 + 1 <= 5),
sp as (select doc_id, n, line, 1 as k, left(piece, 5) as t, length(piece) as l from x union all select doc_id, n, line, 2, substr(piece, 6), length(piece) from x),
z as (select doc_id, round_even(8.25::double + l % 5, 1) as size, length(trim(t, ' ')) as c, n, line, k from sp where length(trim(t, ' ')) > 3),
w as (select doc_id, size, sum(c) as c, min(struct_pack(n := n, line := line, k := k)) as f from z group by 1, 2),
m as (select doc_id, arg_min(size, struct_pack(c := -c, f := f)) as body_size from w group by 1)
select d.doc_id, coalesce(body_size, 10.0::double) as body_size from (select distinct doc_id from blocks) d left join m using (doc_id)""")
def body_sizes(spark, sf_dir):
    return spans.body_sizes(raw_layer(spark, sf_dir))


@query(f"""with c as ({SQL['column_layout']}), r as ({SQL['reference_run_flags']}), t as ({SQL['document_title']}), w as ({SQL['weighted_mode']}), h as ({SQL['structure_report']}) 
select h.doc_id, title, body_size, h.n_blocks, h.n_pages, n_two_columns, h.n_headings, h.n_references, n_kept, h.n_repeated, h.font_sizes
from h left join t on h.doc_id = t.doc_id left join w on h.doc_id = w.doc_id
left join (select doc_id, count(*) filter (n_columns = 2) as n_two_columns from c group by 1) c on h.doc_id = c.doc_id left join (select doc_id, count(*) filter (in_run) as n_kept from r group by 1) r on h.doc_id = r.doc_id""")
def inspection(spark, sf_dir):
    """What a parser made of each document: its title, sizes, columns, types, what stays in English."""
    q = lambda name: QUERIES[name](spark, sf_dir)
    columns = q("column_layout").groupBy("doc_id").agg(F.count_if(F.col("n_columns") == 2).alias("n_two_columns"))
    kept = q("reference_run_flags").groupBy("doc_id").agg(F.count_if("in_run").alias("n_kept"))
    out = q("structure_report")
    for part in (q("document_title"), q("weighted_mode"), columns, kept):
        out = out.join(part, "doc_id", "left")
    return out


def article_blocks(df: DataFrame) -> DataFrame:
    """Carrier: lines as a translated document, of which some failed, have warnings or are figures."""
    n, c = F.length("content"), F.col("content")
    kind = F.when((F.col("type") == "table") & (F.col("ord") % 2 == 0), "figure").when(n % 19 == 1, "figure_caption").otherwise(F.col("type"))
    b = df.withColumns({"type": kind, "content": F.when((F.col("type") == "heading") & (n % 3 == 0), "References").otherwise(c)})
    b = b.withColumns(
        {
            "translated": F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.col("content")).otherwise(F.concat(F.lit("پالپ (Pulp) & "), "content")),
            "failed": n % 4 == 0,
            "warnings": F.when(n % 5 == 0, F.array(F.lit("1 < 2"), F.lit("b"))),
            "ref_number": F.when(n % 6 == 0, F.col("ord")),
            "figure_id": F.when(n % 2 == 0, F.lit("f")),
            "figure_num": F.when(n % 3 > 0, F.col("ord")),
            "sources": F.array(F.lit("a.png"), F.when(n % 3 == 0, "").otherwise("b.png")),
            "caption_markup": F.when(n % 3 == 1, F.lit("<i>c</i>")),
            "rows_markup": F.when(n % 3 > 0, F.array(F.array(F.lit("h"), F.lit("i")), F.array(F.lit("x")))),
        }
    )
    return term_pairs.mark_terms(b.withColumn("_show", F.coalesce("translated", "content")), "_show", "markup").drop("_show")


@query()
def article_bodies(spark, sf_dir):
    """Tested against a plain version."""
    return article.article_bodies(article_blocks(blocks(spark, sf_dir)), bilingual=True)


@query()
def report_banners(spark, sf_dir):
    """Tested against a plain version."""
    return article.report_banner(QUERIES["translation_report"](spark, sf_dir)).select("doc_id", "banner")
