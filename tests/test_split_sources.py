"""Files that are read in splits equal the same files read whole; files that grow are read once, line by line."""

from __future__ import annotations

import random

import pytest

from lectern.sources import growing, readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "500b", "spark.sql.files.openCostInBytes": "0b", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def test_transcripts_in_splits(spark, tmp_path, small_splits):
    r = random.Random(1)
    want = []
    for name in ("a.txt", "b.txt", "c.txt"):
        lines, n = [], 0
        for k in range(r.randint(100, 300)):
            kind = r.random()
            if kind < 0.2:
                lines.append(r.choice(("", "no bracket", "[1-2]", "[x-2] y")))
                continue
            text = "é" * r.randint(1, 60) + f" {k}"
            lines.append(f"[{k}-{k + 0.5}] {text}")
            want.append((name, n, float(k), k + 0.5, text))
            n += 1
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() if name == "b.txt" else "\n".join(lines).encode())
    df = readers.transcript(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 1 and readers.split_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert sorted((x.file, x.item_idx, x.start, x.end, x.text) for x in df.collect()) == sorted(want)


def test_records_of_four_lines_in_splits(spark, tmp_path, small_splits):
    r = random.Random(2)
    want = [(k, "" if k % 7 == 0 else "w" * r.randint(1, 90), k + 5) for k in range(200)]
    (tmp_path / "t.txt").write_text("".join(f"{a}\n{t}\n{b}\n\n" for a, t, b in want))
    assert sorted(map(tuple, readers.timings(spark, str(tmp_path / "t.txt")).collect())) == sorted(want)


@pytest.mark.parametrize("size", [1, 7, 64, 10**9])
def test_every_line_is_in_one_range(tmp_path, size):
    r = random.Random(3)
    for name in ("x", "y"):
        lines = ["z" * r.choice((0, 1, 5, 40)) for _ in range(30)]
        (tmp_path / name).write_bytes(b"".join(x.encode() + b"\n" for x in lines) + b"no end")
        got = [x for part in growing.ranges({}, growing.whole_lines(str(tmp_path / name), {}), size) for b in growing.lines_of(str(tmp_path / name), part) for x in b["line"].to_pylist()]
        assert got == lines


def test_chunks_smaller_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "_CHUNK", 3)
    (tmp_path / "x").write_bytes(b"\n".join([b"a" * 10, b"", b"bb", b"c" * 7]) + b"\n")
    for size in (1, 4, 100):
        got = [(s, x) for part in growing.ranges({}, growing.whole_lines(str(tmp_path / "x"), {}), size) for b in growing.lines_of(str(tmp_path / "x"), part) for s, x in zip(b["start"].to_pylist(), b["line"].to_pylist())]
        assert got == [(0, "a" * 10), (11, ""), (12, "bb"), (15, "c" * 7)]


def test_growing_files(spark, tmp_path):
    spark.dataSource.register(growing.GrowingLines)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("[0-1] one\n[1-2] tw")
    stream = spark.readStream.format("growing_lines").option("range_bytes", 8).load(str(folder))

    def start():
        return readers.transcript_items(stream.select("path", "start", "line").withColumnRenamed("start", "place")).writeStream.format("memory").queryName("grown").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()

    query = start()
    query.processAllAvailable()
    texts = lambda: sorted((r.path.rsplit("/", 1)[-1], r.place, r.text) for r in spark.table("grown").collect())
    assert texts() == [("a.txt", 0, "one")]
    with (folder / "a.txt").open("a") as f:
        f.write("o\n[2-3] three\n")
    (folder / "b.txt").write_text("[0-9] other\n")
    query.processAllAvailable()
    query.stop()
    assert texts() == [("a.txt", 0, "one"), ("a.txt", 10, "two"), ("a.txt", 20, "three"), ("b.txt", 0, "other")]
    batch = spark.read.format("growing_lines").option("range_bytes", 5).load(str(folder))
    assert batch.count() == 4 and {r.line for r in batch.collect()} >= {"[1-2] two"}
