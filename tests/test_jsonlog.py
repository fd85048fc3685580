"""The JSON-lines source: any cut into byte ranges, corrupt lines, skipped segments, a stream that goes on where it stopped."""

from __future__ import annotations

import json

import pytest

from brinewatch.sources import jsonlog


def put(folder, first, numbers, tail=""):
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps({"sequence": i, "text": "é" * (i % 7) + "x" * (i * 37 % 90)}) + "\n" for i in numbers)
    (folder / f"log-{first:016d}.jsonl").write_bytes((text + tail).encode())


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_every_line_is_read_once_whatever_the_ranges(tmp_path, size):
    put(tmp_path, 0, range(100), "\n\n" + json.dumps({"sequence": 100}))
    length = (tmp_path / "log-0000000000000000.jsonl").stat().st_size
    got = [jsonlog.numbered(line) for s in range(0, length, size) for _, line in jsonlog.lines(str(tmp_path), jsonlog.Piece("log-0000000000000000.jsonl", s, min(s + size, length))) if line.strip()]
    assert got == list(range(101))


def test_scan_from_a_number_skips_segments(spark, tmp_path):
    for k in range(4):
        put(tmp_path, 100 * k, range(100 * k, 100 * k + 100))
    (tmp_path / f"log-{0:016d}.jsonl").write_text("not json\n")  # before what is asked for: never opened
    got = jsonlog.scan(spark, str(tmp_path), 250, size=500)
    assert sorted(r.seq for r in got.collect()) == list(range(250, 400))
    assert {r.segment for r in got.collect()} == {f"log-{200:016d}.jsonl", f"log-{300:016d}.jsonl"}


@pytest.mark.parametrize("bad", ["{", '{"sequence": "5"}', "[1]", '{"text": 1}', '{"sequence": true}'])
def test_corrupt_lines_fail_or_are_kept(spark, tmp_path, bad):
    put(tmp_path, 0, range(10), bad + "\n")
    with pytest.raises(Exception, match="corrupt line at byte"):
        jsonlog.scan(spark, str(tmp_path)).collect()
    kept = jsonlog.scan(spark, str(tmp_path), corrupt="keep").where("seq is null").collect()
    assert [r.payload for r in kept] == [bad]


def test_an_empty_folder(spark, tmp_path):
    assert jsonlog.scan(spark, str(tmp_path / "none")).collect() == []


def test_write_and_read(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 5).selectExpr("id AS seq", "concat('{\"sequence\":', id, '}') AS payload")
    jsonlog.write(rows, str(tmp_path / "log"), 300)
    assert [s[:2] for s in jsonlog.segments(str(tmp_path / "log"))] == [(f"log-{i:016d}.jsonl", i) for i in (0, 300, 600, 900)]
    assert sorted(r.seq for r in jsonlog.scan(spark, str(tmp_path / "log")).collect()) == list(range(1000))


def test_the_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, out = tmp_path / "log", tmp_path / "out"

    def run():
        def write(batch, epoch):
            batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

        jsonlog.stream(spark, str(log), size=300).writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(f"{out}/rows").collect())

    put(log, 0, range(50), '{"sequence": 50, "te')  # an unfinished line
    assert run() == list(range(50))
    put(log, 0, range(60))
    put(log, 60, range(60, 90))
    assert run() == list(range(90))
    assert run() == list(range(90))
