"""Log ingest across appends, truncation and rotation; versions that are seen whole or not at all."""

from __future__ import annotations

import os

import pytest

from finelens.sources.commits import CommitLog
from finelens.streaming.logs import LogIngest


def write(path, text, mode="w"):
    with open(path, mode, newline="") as f:
        f.write(text)
    # a later time even where the clock is coarse
    os.utime(path, (os.path.getmtime(path), os.path.getmtime(path) + write.tick))
    write.tick += 1


write.tick = 1


def delivered(ingest):
    rows = ingest.lines().collect()
    return sorted((os.path.basename(r["path"]), r["generation"], r["line_no"], r["line"]) for r in rows)


def test_each_line_once_across_append_truncation_and_rotation(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    ingest = LogIngest(spark, str(logs), str(tmp_path / "out"))
    write(a, "one\n\ntwo\nthr")
    write(b, "")
    assert ingest.run() == 1  # an empty file is as good as none
    first = [("a.log", 0, 0, "one"), ("a.log", 0, 1, ""), ("a.log", 0, 2, "two")]
    assert delivered(ingest) == first
    assert ingest.run() == 0  # nothing has changed
    # the open line is finished and more follow
    write(a, "ee\nfour\n", "a")
    write(b, "b0")
    assert ingest.run() == 2
    second = first + [("a.log", 0, 3, "three"), ("a.log", 0, 4, "four")]
    assert delivered(ingest) == second
    # a is truncated and begins anew; b's only line is finished
    write(a, "five\n")
    write(b, "\nb1\n", "a")
    assert ingest.run() == 2
    third = sorted(second + [("a.log", 1, 0, "five"), ("b.log", 0, 0, "b0"), ("b.log", 0, 1, "b1")])
    assert delivered(ingest) == third
    # rotated: another file under the name, longer than what was delivered
    write(a, "six\n" + "x" * 100 + "\n")
    write(logs / "c.log", "c é\r\n\n")
    assert ingest.run() == 2
    assert delivered(ingest) == sorted(
        third + [("a.log", 2, 0, "six"), ("a.log", 2, 1, "x" * 100), ("c.log", 0, 0, "c é\r"), ("c.log", 0, 1, "")]
    )
    # a new reader of the folder goes on from there
    assert LogIngest(spark, str(logs), str(tmp_path / "out")).run() == 0


def test_a_large_file_is_numbered_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        path = tmp_path / "big.log"
        write(path, "".join(f"line {i}\n" for i in range(5000)))
        ingest = LogIngest(spark, str(path), str(tmp_path / "out"))
        assert ingest.read([str(path)]).rdd.getNumPartitions() > 1
        ingest.run()
        write(path, "".join(f"line {i}\n" for i in range(5000, 7000)), "a")
        ingest.run()
        got = sorted((r["line_no"], r["line"]) for r in ingest.lines().collect())
        assert got == [(i, f"line {i}") for i in range(7000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_run_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.log"
    write(path, "one\n")
    ingest = LogIngest(spark, str(path), str(tmp_path / "out"))
    ingest.run()
    write(path, "two\n", "a")
    monkeypatch.setattr(ingest.log, "commit", lambda n: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        ingest.run()
    assert [r["line"] for r in ingest.lines().collect()] == ["one"]
    again = LogIngest(spark, str(path), str(tmp_path / "out"))
    assert again.run() == 1
    assert sorted(r["line"] for r in again.lines().collect()) == ["one", "two"]


def test_commits_are_taken_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "x"))
    assert log.latest() is None
    log.commit(0)
    assert log.numbers() == [0]
    with pytest.raises(RuntimeError):
        log.commit(0)
