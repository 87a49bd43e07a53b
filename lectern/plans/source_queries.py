"""Readers and writers over files that Spark derives from the given tables, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions.maths import round6
from lectern.functions.markup import VIDEO_SUFFIXES
from lectern.operators.cut import shared_folder
from lectern.plans.catalog import query, table
from lectern.plans.frame_queries import _FRAMES, _events, _with, frames
from lectern.plans.geometry_queries import _QUADS, _RING, quads, r6
from lectern.plans.text_queries import _clean
from lectern.sources import readers, sinks


def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_LINE = _clean("replace(text, chr(10), ' ')")


@query("src_transcript", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item_idx, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 9.5::DOUBLE AS \"end\", turn * 10.0::DOUBLE + 4.75::DOUBLE AS center, {_LINE} AS text FROM conversations WHERE {_LINE} <> ''")
def src_transcript(spark, sf):
    """Conversations written as transcripts, a file for each, and read again."""
    path = fresh(spark, "transcripts")
    c = table(spark, sf, "conversations")
    line = F.concat(F.lit("["), (F.col("turn") * 10).cast("string"), F.lit(" - "), (F.col("turn") * 10 + 9.5).cast("string"), F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" ")))
    files = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r.x), "\n\n").alias("value"))
    files.write.partitionBy("conv_id").text(path)
    return readers.transcript(spark, path).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("item_idx").cast("long").alias("item_idx"), "start", "end", "center", "text")


@query("src_listing", "SELECT conv_id, count(*) AS files FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1")
def src_listing(spark, sf):
    """Files below a folder, by the folder of each."""
    path = fresh(spark, "listed")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.first("role").alias("value"))
    c.write.partitionBy("conv_id").text(path)
    found = readers.listing(spark, path, (".txt", ".mp4"))
    return found.select(F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("files"))


@query("src_metrics_cache", _with(_FRAMES) + f"SELECT event_id, {r6('score')} AS score FROM scored")
def src_metrics_cache(spark, sf):
    """Metrics computed and written once; the second time they are read."""
    from lectern.plans.frame_queries import scored

    path = fresh(spark, "metrics")
    readers.cached(spark, path, lambda: scored(_events(spark, sf)))
    return readers.cached(spark, path, lambda: frames(_events(spark, sf))).select("event_id", round6("score").alias("score"))


@query("src_region", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey::INT END AS x1, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey::INT + 7 END AS y2 FROM orders")
def src_region(spark, sf):
    """Regions written as JSON and read again; those without four numbers are null."""
    o, x = table(spark, sf, "orders"), F.col("o_custkey").cast("int")
    roi = F.when(F.col("o_orderkey") % 4 == 0, F.array(x, x)).otherwise(F.array(x, x + 1, x + 5, x + 7))
    text = sinks.region_json(F.col("o_orderpriority"), F.lit(120), F.lit(90), F.col("o_totalprice"), F.col("o_orderkey"), roi)
    r = o.select("o_orderkey", readers.region(text).alias("r"))
    return r.select("o_orderkey", F.get("r", F.lit(0)).alias("x1"), F.get("r", F.lit(3)).alias("y2"))


@query("snk_csv", "SELECT p_partkey, p_name, '' AS comment FROM part")
def snk_csv(spark, sf):
    """A CSV for spreadsheets, with a missing column, read again."""
    path = fresh(spark, "csv")
    sinks.csv_fields(table(spark, sf, "part"), ["p_partkey", "p_name", "comment"], path, bom=True)
    back = spark.read.csv(path, header=True, emptyValue="")
    names = [c.replace("﻿", "") for c in back.columns]
    return back.toDF(*names).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.coalesce("comment", F.lit("")).alias("comment"))


@query("snk_append", "SELECT c_custkey AS id, c_mktsegment AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def snk_append(spark, sf):
    """Rows of two tables appended to one file, read again."""
    path = fresh(spark, "appended")
    sinks.append_rows(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), path)
    sinks.append_rows(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return spark.read.csv(path, header=True, schema="id long, name string")


@query("snk_stages", "SELECT 'orders' AS name, count(*) AS n, sum(o_custkey)::BIGINT AS checksum FROM orders UNION ALL SELECT 'parts', count(*), sum(p_size)::BIGINT FROM part")
def snk_stages(spark, sf):
    """A run's tables written by name and read again."""
    path = fresh(spark, "run")
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    sinks.stages({"orders": o, "parts": p}, o.agg(F.max("o_orderdate").alias("until")), path)
    back = lambda name, c: spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(c).cast("long").alias("checksum"))
    return back("orders", "o_custkey").unionByName(back("parts", "p_size"))


@query("snk_ids", "SELECT s_suppkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, 10 * (s_nationkey + 1) AS area FROM supplier")
def snk_ids(spark, sf):
    """New images numbered on from the largest id, with their areas."""
    new = table(spark, sf, "supplier").select("s_suppkey", (10 * (F.col("s_nationkey") + 1)).alias("area"))
    return sinks.next_ids(new, table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "s_suppkey")


@query("snk_annotations", f"WITH {_QUADS}, {_RING} SELECT l_orderkey::VARCHAR || '.jpg' AS file_name, l_orderkey AS frame_idx, least(119, greatest(0, floor(list_min(list_transform(q, lambda p: p.x)))))::INT AS bbox_x, least(89, greatest(0, ceil(list_max(list_transform(q, lambda p: p.y)))))::INT - least(89, greatest(0, floor(list_min(list_transform(q, lambda p: p.y)))))::INT AS bbox_h, {r6('o[1].x')} AS quad_x1, {r6('o[4].y')} AS quad_y4, 29 AS n FROM ordered")
def snk_annotations(spark, sf):
    """Annotation rows with all their columns."""
    i = lambda v: F.lit(v)
    d = quads(spark, sf).select(
        F.concat(F.lit("out/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image_path"), F.lit("in/v.mp4").alias("video_path"), F.col("l_orderkey").alias("frame_idx"), F.col("l_quantity").alias("timestamp_sec"), F.lit("model").alias("source_mode"),
        F.struct(i(1).alias("x"), i(2).alias("y"), i(3).alias("w"), i(4).alias("h")).alias("model"), G.box(i(0), i(0), i(9), i(9)).alias("search"), F.col("q").alias("quad"),
    )
    rows = sinks.annotation_rows(d, 120, 90)
    return rows.select("file_name", "frame_idx", "bbox_x", "bbox_h", round6("quad_x1").alias("quad_x1"), round6("quad_y4").alias("quad_y4"), F.lit(len(rows.columns)).alias("n"))


@query("snk_overlays", "SELECT l_orderkey, l_linenumber, l_discount < 0.07 AS failures, TRUE AS everything, FALSE AS nothing FROM lineitem")
def snk_overlays(spark, sf):
    good = F.col("l_discount") >= 0.07
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[sinks.wants_overlay(p, good).alias(n) for p, n in (("failures", "failures"), ("all", "everything"), ("none", "nothing"))])


@query("snk_progress", "SELECT event_id, least(100, greatest(0, floor(value - 20)::INT)) AS percent FROM events")
def snk_progress(spark, sf):
    """Progress rows appended with their percentages in bounds."""
    path = fresh(spark, "progress")
    sinks.append_progress(_events(spark, sf).select("event_id", F.floor(F.col("value") - 20).cast("int").alias("percent")), path)
    return spark.read.parquet(path)


@query("snk_note", "SELECT conv_id AS lecture_id, md5(string_agg('## ' || regexp_replace(role, '([\\\\*_])', '\\\\\\1', 'g') || chr(10) || chr(10) || '*' || printf('%02d:%02d', (turn * 50) // 60, (turn * 50) % 60) || '–' || printf('%02d:%02d', (turn * 50 + 40) // 60, (turn * 50 + 40) % 60) || '*' || CASE WHEN trim(text) <> '' THEN chr(10) || chr(10) || trim(text) ELSE '' END, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def snk_note(spark, sf):
    """A note of each lecture's segments."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("index"), F.col("role").alias("title"), (F.col("turn") * 50.0).alias("start"), (F.col("turn") * 50.0 + 40).alias("end"), F.col("text").alias("summary"))
    return sinks.note_markdown(c).select("lecture_id", F.md5("note").alias("h"))


@query("snk_report", "SELECT n, line FROM (SELECT row_number() OVER (ORDER BY r_regionkey) AS n, '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region) UNION ALL SELECT * FROM (VALUES (-4, '# Regions'), (-3, ''), (-2, '| r_regionkey | r_name |'), (-1, '| --- | --- |'))")
def snk_report(spark, sf):
    return sinks.report(table(spark, sf, "region"), "Regions", "r_regionkey")


@query("snk_merged_text", "SELECT conv_id, md5(string_agg('=== ' || lpad(turn::VARCHAR, 6, '0') || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS h FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def snk_merged_text(spark, sf):
    """The texts of a lecture's pictures in one."""
    c = table(spark, sf, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("stem"), "text")
    return sinks.merged_text(c, "conv_id").select("conv_id", F.md5("text").alias("h"))


@query("snk_text_files", "SELECT page_id, length(trim(html)) AS n FROM pages WHERE trim(html) <> ''".replace("length(trim(html))", "length(replace(html, chr(10), ' '))"))
def snk_text_files(spark, sf):
    """A text file for each page, read again by its folder."""
    path = fresh(spark, "texts")
    sinks.ocr_files(table(spark, sf, "pages").select(F.col("page_id").alias("stem"), F.replace("html", F.lit("\n"), F.lit(" ")).alias("text")), path)
    back = spark.read.text(path)
    return back.select(F.col("stem").cast("long").alias("page_id"), F.length("value").cast("long").alias("n"))


@query("snk_expendable", "SELECT DISTINCT l_orderkey AS note, 'in/' || l_orderkey || CASE l_linenumber % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mkv' ELSE '.md' END AS path FROM lineitem WHERE l_linenumber % 3 <> 2")
def snk_expendable(spark, sf):
    """Source videos that go when a note is done."""
    k = F.col("l_linenumber") % 3
    path = F.concat(F.lit("in/"), F.col("l_orderkey").cast("string"), F.when(k == 0, ".MP4").when(k == 1, ".mkv").otherwise(".md"))
    return sinks.expendable(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("note"), path.alias("path")), VIDEO_SUFFIXES)
