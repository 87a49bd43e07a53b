from __future__ import annotations

import json

from pyspark.sql import functions as F

from lectern.sources import readers, sinks


def test_transcript(spark, tmp_path):
    (tmp_path / "t.txt").write_text("[0-2.5] Hello  there\n\nno bracket\n[3 - 4]\n[4-6] bye", encoding="utf-8")
    got = readers.transcript(spark, str(tmp_path / "t.txt")).orderBy("item_idx").collect()
    assert [(r.item_idx, r.start, r.end, r.center, r.text) for r in got] == [(0, 0.0, 2.5, 1.25, "Hello there"), (1, 4.0, 6.0, 5.0, "bye")]


def test_texts_manifest_and_frames(spark, tmp_path):
    for name, text in (("a.txt", "one  two"), ("ocr_merged.txt", "all"), ("b.csv", "no")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in readers.ocr_texts(spark, str(tmp_path)).collect()] == [("a", "one two")]
    (tmp_path / "m.csv").write_text("variant_name,segment_id,frame_idx,time_sec,content_score,image_path,roi_path\nv,1,5,2.0,0.5,x.jpg,\nv,0,1,1.0,0.5,y.jpg,z.jpg\nv,2,9,,0.5,q.jpg,\n")
    assert [tuple(r) for r in readers.keyframe_manifest(spark, str(tmp_path / "m.csv")).collect()] == [("z.jpg", 1.0), ("x.jpg", 2.0)]
    frames = spark.createDataFrame([("f_1.50s.jpg", None, "a"), ("g.jpg", 3.0, "b"), ("g.jpg", 3.001, "b"), ("h.jpg", None, "c")], "path string, time double, stem string")
    crops = spark.createDataFrame([("crop_b.jpg", "b")], "path string, stem string")
    got = {(r.path, r.time) for r in readers.normalise_frames(frames, crops).collect()}
    assert got == {("f_1.50s.jpg", 1.5), ("crop_b.jpg", 3.0), ("h.jpg", 0.0)}


def test_annotations_and_labels(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "i.jpg", "width": 100, "height": 50}], "categories": [{"id": 1, "name": "s"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [10.0, 10.0, 20.0, 20.0], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 1, "bbox": [50.0, 0.0, 80.0, 50.0], "iscrowd": 0}, {"id": 3, "image_id": 1, "category_id": 1, "bbox": [0.0, 0.0, 100.0, 50.0], "iscrowd": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    r = readers.annotations(spark, str(tmp_path / "c.json")).first()
    assert (r.image_path, r.x, r.y, r.w, r.h) == ("i.jpg", 0.5, 0.0, 0.5, 1.0)
    (tmp_path / "l.csv").write_text("﻿variant_name;is_true_positive;Unnamed: 3\nv;да;x\n", encoding="utf-8")
    assert readers.labelled_csv(spark, str(tmp_path / "l.csv")).columns == ["variant_name", "is_true_positive"]


def test_small_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("100\nfirst\n200\n\n300\nsecond\n400\n")
    assert [tuple(r) for r in readers.timings(spark, str(tmp_path / "t.txt")).collect()] == [(100, "first", 200), (300, "second", 400)]
    (tmp_path / "c.tsv").write_text("0\tIntro\t10.5\n")
    assert [tuple(r) for r in readers.chapters(spark, str(tmp_path / "c.tsv")).collect()] == [(0.0, "Intro", 10.5)]
    (tmp_path / "s.vtt").write_text("WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Hi</c> you\n")
    assert readers.subtitles(spark, str(tmp_path / "s.vtt")).first().text == "Hi you"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "id long, s string")
    assert [r.line for r in sinks.markdown_rows(df).collect()] == ["| 1 | a\\|b c |", "| 2 |  |"]
    sinks.csv_fields(df, ["s", "gone"], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["s", "gone"]
    seg = spark.createDataFrame([(1, 2, "B_", 60.0, 90.0, None), (1, 1, "A", 0.0, 60.0, "text")], "lecture_id long, index long, title string, start double, end double, summary string")
    assert sinks.note_markdown(seg).first().note == "## A\n\n*00:00–01:00*\n\ntext\n\n## B\\_\n\n*01:00–01:30*"
    new = sinks.next_ids(spark.createDataFrame([("x",), ("y",)], "s string"), df, "s")
    assert [(r.s, r.id) for r in new.orderBy("id").collect()] == [("x", 3), ("y", 4)]
    assert [r.percent for r in sinks.progress(spark.createDataFrame([(-5,), (120,)], "percent int")).collect()] == [0, 100]
