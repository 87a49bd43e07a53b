"""Writers: tables, reports and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as G
from lectern.functions.text import escape_markdown, format_ts
from lectern.operators.cut import cut


def csv_fields(df: DataFrame, fields: list[str], path: str, bom: bool = False) -> None:
    """A CSV of just these fields; missing ones and nulls are empty. With bom its files begin with a byte-order mark, for spreadsheets."""
    rows = df.select(*[(F.col(f).cast("string") if f in df.columns else F.lit("")).alias(f) for f in fields]).na.fill("")
    rows = rows.withColumnRenamed(fields[0], f"\ufeff{fields[0]}") if bom else rows
    rows.write.csv(path, header=True, mode="overwrite", emptyValue="")


def append_rows(df: DataFrame, path: str) -> None:
    """Rows behind those of a CSV, with a header in each new file."""
    df.write.csv(path, header=True, mode="append", emptyValue="")


def stages(tables: dict[str, DataFrame], config: DataFrame, path: str) -> None:
    """A run's tables as Parquet by name, and its settings (rows) as JSON lines."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}", mode="overwrite")
    config.write.json(f"{path}/config", mode="overwrite")


def markdown_rows(df: DataFrame) -> DataFrame:
    """One line of a Markdown table for each row; bars escaped, newlines as spaces."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), "\r?\n", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))


def note_markdown(segments: DataFrame) -> DataFrame:
    """(lecture_id, note) of segments (lecture_id, index, title, start, end, summary): a heading, a time span and a text for each."""
    span = F.concat(F.lit("*"), format_ts(F.col("start")), F.lit("–"), format_ts(F.col("end")), F.lit("*"))
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), escape_markdown(F.col("title"))), span, F.nullif(F.trim("summary"), F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("index", part.alias("p")))), lambda r: r.p)
    return segments.groupBy("lecture_id").agg(F.array_join(parts, "\n\n").alias("note"))


def next_ids(new: DataFrame, old: DataFrame, order: str) -> DataFrame:
    """New rows numbered on from the largest id there is.

    Rows are dealt out in ranges of the order and numbered within these; a range
    begins where the counts of those before it end, one number a range.
    """
    dealt = cut(new.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    numbered = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(order)))
    placed = numbered.join(F.broadcast(before.crossJoin(top)), "_range")
    return placed.withColumn("id", F.col("_top") + F.col("_before") + F.col("_place")).drop("_range", "_place", "_before", "_top")


def progress(log: DataFrame) -> DataFrame:
    """Log rows with their percentage between 0 and 100."""
    return log.withColumn("percent", F.least(F.lit(100), F.greatest(F.lit(0), F.col("percent"))))


def append_progress(log: DataFrame, path: str) -> None:
    progress(log).write.parquet(path, mode="append")


def report(df: DataFrame, title: str, order: str) -> DataFrame:
    """(n, line) of a Markdown report: a title, the column names, and a table row for each row, in order; a report is short by nature."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    top = df.sparkSession.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "n long, line string")
    rows = markdown_rows(df.withColumn("_n", F.row_number().over(Window.orderBy(order))).select(*df.columns, "_n"))
    body = rows.select(F.regexp_extract("line", r"\| (\d+) \|$", 1).cast("long").alias("n"), F.regexp_replace("line", r" \d+ \|$", "").alias("line"))
    return top.unionByName(body)


def ocr_files(texts: DataFrame, path: str) -> None:
    """A text file for each picture (stem, text) that has text, in a folder of its stem."""
    texts.where(F.trim("text") != "").select("stem", "text").write.mode("overwrite").partitionBy("stem").text(path)


def merged_text(texts: DataFrame, by: str) -> DataFrame:
    """(by, text) of all pictures' texts one after the other, by stem; empty ones are left out."""
    some = texts.where(F.trim("text") != "")
    block = F.concat(F.lit("=== "), F.col("stem"), F.lit(" ===\n"), F.col("text"))
    return some.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stem", block.alias("b")))), lambda r: r.b), "\n\n").alias("text"))


def region_json(video: Column, width: Column, height: Column, time: Column, frame: Column, roi: Column) -> Column:
    """A selected region as JSON, to be read again by readers.region."""
    return F.to_json(F.struct(video.alias("video_path"), width.alias("frame_width"), height.alias("frame_height"), time.alias("selected_time_sec"), frame.alias("selected_frame_idx"), roi.alias("roi")))


def wants_overlay(policy: str, success: Column) -> Column:
    """Whether a frame's picture is saved: for all, for failures only, or for none."""
    return {"all": F.lit(True), "failures": ~success}.get(policy, F.lit(False))


def expendable(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(note, path) of source videos that go once a note is done, each once; anything else is left alone."""
    return files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$")).select("note", "path").distinct()


def annotation_rows(df: DataFrame, width: int, height: int) -> DataFrame:
    """The columns of an annotation file from (image_path, video_path, frame_idx, timestamp_sec, source_mode, model (x, y, w, h), search (x1, y1, x2, y2), quad)."""
    q = df.withColumn("q", G.order_quad(F.col("quad"))).withColumn("b", G.quad_box(F.col("quad")))
    b = G.clamp_box(F.col("b.x1"), F.col("b.y1"), F.col("b.x2"), F.col("b.y2"), width, height)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return q.withColumn("box", b).select(
        name(F.col("image_path")).alias("file_name"), "image_path", "video_path", name(F.col("video_path")).alias("video_name"), "frame_idx", "timestamp_sec", F.lit(width).alias("image_width"), F.lit(height).alias("image_height"), "source_mode",
        *[F.col(f"model.{c}").cast("double").alias(f"model_{c}") for c in "xywh"], *[F.col(f"search.{c}").cast("int").alias(f"search_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.col("box.x1").alias("bbox_x"), F.col("box.y1").alias("bbox_y"), (F.col("box.x2") - F.col("box.x1")).alias("bbox_w"), (F.col("box.y2") - F.col("box.y1")).alias("bbox_h"),
        *[F.get("q", F.lit(k))[c].alias(f"quad_{c}{k + 1}") for k in range(4) for c in "xy"],
    )
