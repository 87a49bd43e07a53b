"""Text formats over files that Spark derives from the given tables: written to the shared folder, read by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import maths as M
from lectern.plans.catalog import query, table
from lectern.plans.frame_queries import _events
from lectern.plans.source_queries import _LINE, fresh
from lectern.plans.text_queries import _clean
from lectern.sources import growing, readers


def _flat(c: str):
    return F.replace(c, F.lit("\n"), F.lit(" "))


def _ordered(lines, sep: str):
    """A conversation's lines in order of turns, as the text of one file."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("x")))), lambda r: r.x), sep).alias("value")


@query("src_ocr_texts", f"SELECT md5({_clean('string_agg(text, chr(10) ORDER BY turn)')}) AS h FROM conversations GROUP BY conv_id")
def src_ocr_texts(spark, sf):
    """A text file for each conversation, cleaned as one text."""
    path = fresh(spark, "ocr")
    table(spark, sf, "conversations").groupBy("conv_id").agg(_ordered(F.col("text"), "\n")).write.partitionBy("conv_id").text(path)
    return readers.ocr_texts(spark, path).select(F.md5("text").alias("h"))


@query("src_keyframe_manifest", "SELECT CASE WHEN event_id % 3 = 0 THEN 'roi/' || event_id || '.jpg' ELSE 'img/' || event_id || '.jpg' END AS path, value AS time FROM events WHERE event_id % 5 <> 0")
def src_keyframe_manifest(spark, sf):
    """A manifest with a cropped picture for some frames and without a time for others."""
    path, k = fresh(spark, "manifest"), F.col("event_id")
    name = lambda folder: F.concat(F.lit(folder), k.cast("string"), F.lit(".jpg"))
    rows = _events(spark, sf).select(
        F.col("event_type").alias("variant_name"), F.col("user_id").alias("segment_id"), k.alias("frame_idx"), F.when(k % 5 != 0, F.col("value")).alias("time_sec"),
        F.lit(0.5).alias("content_score"), name("img/").alias("image_path"), F.when(k % 3 == 0, name("roi/")).otherwise(F.lit(" ")).alias("roi_path"),
    )
    rows.write.csv(path, header=True)
    return readers.keyframe_manifest(spark, path)


@query(
    "src_normalise_frames",
    """SELECT stem, path, time FROM (SELECT *, row_number() OVER (PARTITION BY floor(time * 100 + 0.5), path ORDER BY time, stem) AS n FROM
    (SELECT 'e' || event_id AS stem, CASE WHEN event_id % 3 = 0 THEN 'crop_' || user_id || '.jpg' WHEN event_id % 7 = 0 THEN 'f.jpg' ELSE 'f' || event_id || '_' || (event_id % 500) || '.25s.jpg' END AS path,
    CASE WHEN event_id % 2 = 0 THEN (event_id % 40) / 4.0::DOUBLE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 500 + 0.25::DOUBLE END AS time FROM events)) WHERE n = 1""",
)
def src_normalise_frames(spark, sf):
    """Frames with a time of their own or in their name, cropped pictures by stem, one row for each time and path."""
    k = F.col("event_id")
    e = _events(spark, sf).select("event_id", "user_id", F.concat(F.lit("e"), k.cast("string")).alias("stem"))
    name = F.concat(F.lit("f"), k.cast("string"), F.lit("_"), (k % 500).cast("string"), F.lit(".25s.jpg"))
    frames = e.select(F.when(k % 7 == 0, F.lit("f.jpg")).otherwise(name).alias("path"), F.when(k % 2 == 0, (k % 40) / 4.0).alias("time"), "stem")
    crops = e.where(k % 3 == 0).select("stem", F.concat(F.lit("crop_"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"))
    return readers.normalise_frames(frames, crops)


@query("src_labelled_csv", "SELECT p_brand AS variant_name, (p_size % 2)::VARCHAR AS is_true_positive, p_partkey::VARCHAR AS frame_idx FROM part")
def src_labelled_csv(spark, sf):
    """A labelled table as a spreadsheet saves it: a byte-order mark and semicolons, found out by the reader."""
    path = fresh(spark, "labelled")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("﻿variant_name"), (F.col("p_size") % 2).cast("string").alias("is_true_positive"), F.col("p_partkey").cast("string").alias("frame_idx"))
    rows.write.csv(path, header=True, sep=";")
    return readers.labelled_csv(spark, path).select("variant_name", "is_true_positive", "frame_idx")


_BOX = "WITH b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, [l_discount * 300 - 5, l_tax * 200 - 3, l_quantity * 2, l_quantity + l_linenumber]::DOUBLE[] AS bbox, (l_linenumber = 1)::INT AS crowd FROM lineitem), p AS (SELECT l_suppkey, arg_max(bbox, (bbox[3] * bbox[4], -id)) AS b FROM b WHERE crowd = 0 GROUP BY 1)"


@query(
    "src_annotations",
    f"{_BOX}, c AS (SELECT l_suppkey, least(60.0::DOUBLE, greatest(0.0::DOUBLE, b[1])) AS x, least(40.0::DOUBLE, greatest(0.0::DOUBLE, b[2])) AS y, least(60.0::DOUBLE, greatest(0.0::DOUBLE, b[1] + b[3])) AS x2, least(40.0::DOUBLE, greatest(0.0::DOUBLE, b[2] + b[4])) AS y2 FROM p) "
    "SELECT l_suppkey || '.jpg' AS image_path, floor(x / 60 * 1000000 + 0.5) / 1000000 AS x, floor(y / 40 * 1000000 + 0.5) / 1000000 AS y, floor((x2 - x) / 60 * 1000000 + 0.5) / 1000000 AS w, floor((y2 - y) / 40 * 1000000 + 0.5) / 1000000 AS h FROM c",
)
def src_annotations(spark, sf):
    """Annotation files of one image each: the largest box outside crowds, clipped and relative."""
    path = fresh(spark, "coco")
    d = lambda c: c.cast("double")
    box = F.array(d(F.col("l_discount") * 300 - 5), d(F.col("l_tax") * 200 - 3), d(F.col("l_quantity") * 2), d(F.col("l_quantity") + F.col("l_linenumber")))
    mark = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("image_id"), box.alias("bbox"), (F.col("l_linenumber") == 1).cast("int").alias("iscrowd"))
    image = F.array(F.struct(F.col("l_suppkey").alias("id"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(60).alias("width"), F.lit(40).alias("height")))
    files = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list(mark).alias("annotations")).select("l_suppkey", F.to_json(F.struct("annotations", image.alias("images"))).alias("value"))
    files.write.partitionBy("l_suppkey").text(path)
    a = readers.annotations(spark, path)
    return a.select("image_path", *[M.round6(c).alias(c) for c in "xywh"])


@query("src_timings", "SELECT turn * 100 AS start, replace(text, chr(10), ' ') AS text, turn * 100 + 95 AS \"end\" FROM conversations")
def src_timings(spark, sf):
    """Records of four lines each, read across the splits of their files."""
    path = fresh(spark, "timings")
    start = F.col("turn").cast("long") * 100
    record = F.concat_ws("\n", start.cast("string"), _flat("text"), (start + 95).cast("string"), F.lit(""))
    table(spark, sf, "conversations").select(record.alias("value")).write.text(path)
    return readers.timings(spark, path)


@query("src_chapters", "SELECT l_quantity AS start, l_returnflag || ' ' || l_orderkey AS title, l_quantity + l_tax AS \"end\" FROM lineitem")
def src_chapters(spark, sf):
    path = fresh(spark, "chapters")
    title = F.concat_ws(" ", "l_returnflag", F.col("l_orderkey").cast("string"))
    table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double"), title, (F.col("l_quantity") + F.col("l_tax")).cast("double")).write.csv(path, sep="\t")
    return readers.chapters(spark, path)


@query("src_subtitles", "SELECT md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY turn), '\\s+', ' ', 'g'))) AS h FROM conversations GROUP BY conv_id")
def src_subtitles(spark, sf):
    """Subtitles of each conversation, with headers, cue times and tags that go."""
    path = fresh(spark, "subtitles")
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n00:00:01.000 --> 00:00:02.000 align:start\n<c>"), _flat("text"), F.lit("</c>\n"))
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(_ordered(cue, "\n"))
    files.select("conv_id", F.concat(F.lit("WEBVTT - turns\n\n"), "value").alias("value")).write.partitionBy("conv_id").text(path)
    return readers.subtitles(spark, path).select(F.md5("text").alias("h"))


@query("src_growing_lines", f"SELECT turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 9.5::DOUBLE AS \"end\", md5({_LINE}) AS h FROM conversations WHERE {_LINE} <> ''")
def src_growing_lines(spark, sf):
    """Transcripts through the data source for files that grow: byte ranges of whole lines."""
    path = fresh(spark, "growing")
    line = F.concat(F.lit("["), (F.col("turn") * 10).cast("string"), F.lit(" - "), (F.col("turn") * 10 + 9.5).cast("string"), F.lit("] "), _flat("text"))
    table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    spark.dataSource.register(growing.GrowingLines)
    lines = spark.read.format("growing_lines").load(path).select("path", F.col("start").alias("place"), "line")
    return readers.transcript_items(lines).select("start", "end", F.md5("text").alias("h"))


@query("mth_duration", "SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, l_quantity - 20 * l_linenumber) AS seconds FROM lineitem")
def mth_duration(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.duration(20 * F.col("l_linenumber"), F.col("l_quantity")).cast("double").alias("seconds"))
