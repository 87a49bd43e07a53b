"""Readers of the text formats that transcripts, frames and annotations come in.

All are declarative scans: paths go to Spark's readers, so any store that Spark can open will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, time_from_name

#: Columns of the key-frame manifest, and of hand-labelled evaluations.
MANIFEST = "variant_name string, segment_id long, frame_idx long, time_sec double, content_score double, image_path string, roi_path string"
LABELLED = ("variant_name", "row_type", "is_true_positive", "fn_count")
_LINE = r"^\[(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\]\s*(.*)$"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, block, line) of text files that Spark cuts into byte ranges (blocks), whole lines each. Folders named key=value add their keys."""
    raw = spark.read.option("lineSep", "\n").text(path)
    folders = [c for c in raw.columns if c != "value"]
    m = F.col("_metadata")
    return raw.select(*folders, m["file_path"].alias("path"), m["file_name"].alias("file"), m["file_block_start"].alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of split_lines, also filtered ones, with their number from 0 within their file.

    A block's rows have running ids; where a block begins in its file follows from the counts of the blocks
    before it, one row a block. So no file is in one task, however large, and no row is sorted.
    """
    ids = rows.withColumn("_id", F.monotonically_increasing_id())
    blocks = ids.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.select("path", "block", (before - F.col("_first")).alias("_shift"))
    return ids.join(shift, ["path", "block"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_shift")


def transcript(spark: SparkSession, path: str) -> DataFrame:
    """(file, item_idx, start, end, center, text) of lines `[start-end] text`; other lines and empty texts are skipped.

    Files are split: one of many gigabytes is read by many tasks. Folders named key=value add their keys as columns.
    """
    lines = split_lines(spark, path)
    folders = [c for c in lines.columns if c not in ("path", "file", "block", "line")]
    item = numbered(transcript_items(lines), "item_idx")
    return item.select(*folders, "file", F.col("item_idx").cast("int").alias("item_idx"), "start", "end", ((F.col("start") + F.col("end")) / 2).alias("center"), "text")


def transcript_items(lines: DataFrame) -> DataFrame:
    """Lines (line, ...) of the form `[start-end] text`, with start, end and their cleaned text in the line's place."""
    others = [c for c in lines.columns if c != "line"]
    parsed = lines.select(*others, *[F.regexp_extract("line", _LINE, k).alias(n) for k, n in ((1, "s"), (2, "e"), (3, "t"))]).where("s <> ''")
    return parsed.select(*others, F.col("s").cast("double").alias("start"), F.col("e").cast("double").alias("end"), clean_text(F.col("t")).alias("text")).where("text <> ''")


def ocr_texts(spark: SparkSession, path: str) -> DataFrame:
    """(stem, text) of the text files of a folder, but for the merged one."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    return files.where("name <> 'ocr_merged.txt'").select(F.regexp_replace("name", "[.]txt$", "").alias("stem"), clean_text(F.col("value")).alias("text"))


def keyframe_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, time) of key frames in order of time: the cropped picture where there is one."""
    rows = spark.read.csv(path, schema=MANIFEST, header=True)
    image = F.coalesce(F.nullif(F.trim("roi_path"), F.lit("")), F.nullif(F.trim("image_path"), F.lit("")))
    return rows.select(image.alias("path"), F.col("time_sec").alias("time")).where("path IS NOT NULL AND time IS NOT NULL").orderBy("time", "path")


def normalise_frames(frames: DataFrame, cropped: DataFrame) -> DataFrame:
    """Frames (path, time, stem) with the cropped picture of equal stem; the time from the name, or 0, where a record has none; one row for each time and path."""
    j = frames.join(cropped.select("stem", F.col("path").alias("crop")), "stem", "left")
    time = F.coalesce("time", time_from_name(F.col("path")), F.lit(0.0))
    out = j.select("stem", F.coalesce("crop", "path").alias("path"), time.alias("time"))
    w = Window.partitionBy(F.round("time", 2), "path").orderBy("time", "stem")
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """(start, text, end) of files of four lines a record: start, text, end (hundredths of a second) and a blank.

    Lines are numbered across the splits of a file and meet by record, so a record may lie in two splits.
    """
    lines = numbered(split_lines(spark, path), "n")
    place = lambda k, name: F.max(F.when(F.col("n") % 4 == k, F.col("line"))).alias(name)
    records = lines.groupBy("path", F.floor(F.col("n") / 4).alias("record")).agg(place(0, "a"), place(1, "text"), place(2, "b"))
    rows = records.select(F.col("a").try_cast("long").alias("start"), "text", F.col("b").try_cast("long").alias("end"))
    return rows.where("start IS NOT NULL AND end IS NOT NULL")


def chapters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="start double, title string, end double", sep="\t")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of WebVTT files without headers, cue times and tags."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    t = F.regexp_replace("value", r"(?m)^WEBVTT.*$|^\d{2}:\d{2}.*-->.*$|^\d+$", "")
    return files.select("file", F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", ""), r"\s+", " ")).alias("text"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, x, y, w, h) of COCO files: the largest box of each image outside crowds, clipped to it and relative to its size."""
    raw = spark.read.json(path, multiLine=True)
    box = raw.select(F.explode("annotations").alias("a")).select("a.image_id", "a.id", "a.bbox", F.coalesce("a.iscrowd", F.lit(0)).alias("crowd")).where("crowd = 0 AND size(bbox) = 4")
    best = box.groupBy("image_id").agg(F.max_by("bbox", F.struct(F.col("bbox")[2] * F.col("bbox")[3], -F.col("id"))).alias("b"))
    image = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), F.col("i.file_name").alias("image_path"), F.col("i.width").cast("double").alias("wide"), F.col("i.height").cast("double").alias("high"))
    fit = lambda c, top: F.least(top, F.greatest(F.lit(0.0), c.cast("double")))
    x, y = fit(F.col("b")[0], F.col("wide")), fit(F.col("b")[1], F.col("high"))
    x2, y2 = fit(F.col("b")[0] + F.col("b")[2], F.col("wide")), fit(F.col("b")[1] + F.col("b")[3], F.col("high"))
    return best.join(image, "image_id").select("image_path", (x / F.col("wide")).alias("x"), (y / F.col("high")).alias("y"), ((x2 - x) / F.col("wide")).alias("w"), ((y2 - y) / F.col("high")).alias("h"))


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A hand-labelled table in whatever encoding and separator a spreadsheet wrote; says what it tried if none fits."""
    tried = []
    for encoding in ("UTF-8", "windows-1251"):
        for sep in (",", ";", "\t"):
            df = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
            names = {c: c.replace("﻿", "").strip() for c in df.columns}
            if set(LABELLED[:1]) | {"is_true_positive"} <= set(names.values()):
                return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items() if not n.startswith(("Unnamed", "_c"))])
            tried.append(f"{encoding} {sep!r}: {list(names.values())[:6]}")
    raise ValueError("no variant_name and is_true_positive columns; tried " + "; ".join(tried))


def region(c) -> Column:
    """The region of a cached selection, {"roi": [x1, y1, x2, y2]}: null unless it has just four whole numbers."""
    roi = F.from_json(F.get_json_object(c, "$.roi"), "array<int>")
    return F.when((F.size(roi) == 4) & ~F.exists(roi, lambda v: v.isNull()), roi)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A table that is read where it has been written before, else computed and written."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of all files below a folder with one of the suffixes, each once; says so if there is none. Nothing but names and sizes is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    wanted = files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$")).dropDuplicates(["path"])
    if wanted.isEmpty():
        raise FileNotFoundError(f"no file with {', '.join(suffixes)} below {folder}")
    return wanted
