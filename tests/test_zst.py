"""Zstandard files read by runs of frames: no line lost, none twice, at any cut."""

import io
import os
import random
import tempfile

import pytest
import zstandard
from pyspark.sql import functions as F

from tagloom.plans import standins as S
from tagloom.sources import dumps as DU
from tagloom.sources import zst as Z
from tests.conftest import SF_SMALL

SKIP = Z.SKIPPABLE.to_bytes(4, "little") + (5).to_bytes(4, "little") + b"notes"


def packed(data: bytes, cuts: list[int], *, skip: bool = False, **kw) -> bytes:
    c = zstandard.ZstdCompressor(**kw)
    edges = [0, *sorted(cuts), len(data)]
    frames = [c.compress(data[a:b]) for a, b in zip(edges, edges[1:])]
    return (SKIP if skip else b"").join([b"", *frames] if skip else frames)


def expected(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


def read_all(blob: bytes, split_bytes: int) -> tuple[list[bytes], int]:
    found = list(Z.runs(Z.frame_ends(io.BytesIO(blob), len(blob)), split_bytes))
    return [x for s, e in found for x in Z.lines_of(io.BytesIO(blob), s, e)], len(found)


def test_any_cut_gives_every_line_once():
    draw = random.Random(7)
    for n in range(400):
        data = bytes(draw.choice(b"ab\n\n") if draw.random() < 0.5 else 120 for _ in range(draw.randrange(0, 60)))
        cuts = [draw.randrange(0, len(data) + 1) for _ in range(draw.randrange(0, 8))]
        blob = packed(data, cuts, skip=n % 3 == 0, write_checksum=n % 2 == 0, write_content_size=n % 5 != 0)
        for split_bytes in (1, 25, 10_000):
            assert read_all(blob, split_bytes)[0] == expected(data), (data, cuts, split_bytes)


def test_lines_longer_than_blocks_and_runs():
    """Raw, repeated and compressed blocks; a line over several frames."""
    draw = random.Random(3)
    noise = bytes(draw.randrange(11, 256) for _ in range(400_000))
    data = b"first\n" + noise + b"\n" + b"z" * 500_000 + b"\n" + b"word " * 100_000 + b"end"
    blob = packed(data, [3, 100_000, 200_000, 300_000, 400_007, 900_000], write_checksum=True)
    lines, parts = read_all(blob, 1)
    assert lines == expected(data) and parts == 7


def test_damaged_files_are_errors():
    blob = packed(b"one\ntwo\n" * 5000, [20_000])
    assert len(list(Z.frame_ends(io.BytesIO(blob), len(blob)))) == 2
    for cut in (1, 3, len(blob) // 3):  # half of it is one whole frame
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(Z.frame_ends(io.BytesIO(blob[:-cut]), len(blob) - cut))
    with pytest.raises(zstandard.ZstdError):
        list(Z.frame_ends(io.BytesIO(b"plain text, no frame"), 20))


def test_a_file_is_read_by_several_tasks(spark):
    base = tempfile.mkdtemp(prefix="tagloom-zst-", dir="/tmp")
    lines = [f'{{"id": "{i}", "body": "thc é {i}", "created_utc": 1600000000}}' for i in range(5000)]
    data = ("\n".join(lines) + "\n{broken").encode()
    for name, cuts in (("trees_comments.zst", [1, 70_000, 70_001, 200_000]), ("one_submissions.zst", [])):
        with open(os.path.join(base, name), "wb") as f:
            f.write(packed(data, cuts))
    open(os.path.join(base, "empty_comments.zst"), "wb").close()
    with open(os.path.join(base, "notes.txt"), "w") as f:
        f.write("not a dump\n")
    got = Z.read_frames(spark, base, split_bytes=1)
    assert got.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, got.collect())) == sorted((n, x) for n in ("trees_comments.zst", "one_submissions.zst") for x in [*lines, "{broken"])
    # one frame read by Spark's own reader gives the same lines
    own = DU.read_dump(spark, os.path.join(base, "one_submissions.zst"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, got.filter("file = 'one_submissions.zst'").collect()))


def test_long_windows_and_carriage_returns(spark):
    base = tempfile.mkdtemp(prefix="tagloom-zst-", dir="/tmp")
    params = zstandard.ZstdCompressionParameters.from_level(3, window_log=28)
    with open(os.path.join(base, "a_comments.zst"), "wb") as f, zstandard.ZstdCompressor(compression_params=params).stream_writer(f) as w:
        w.write(b"x\r\n\xff\n\ny")
    assert [r.line for r in Z.read_frames(spark, base).collect()] == ["x", "�", "", "y"]


def test_a_folder_without_runs(spark):
    base = tempfile.mkdtemp(prefix="tagloom-zst-", dir="/tmp")
    open(os.path.join(base, "empty_comments.zst"), "wb").close()
    assert Z.read_frames(spark, base).collect() == []


def test_written_frames_come_back(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="tagloom-zst-", dir="/tmp"), "dump")
    raw = S.raw_lines(spark, SF_SMALL).repartitionByRange(3, "file", "doc_id").select("file", "line")
    Z.write_frames(raw, base, frame_bytes=300)
    assert not [n for n in os.listdir(base) if n.startswith("_")]
    back = Z.read_frames(spark, base, split_bytes=1)
    files = len([n for n in os.listdir(base) if n.endswith(".zst")])
    assert back.rdd.getNumPartitions() > files
    key = F.regexp_replace("file", r"-\d+\.zst$", ".zst").alias("file")
    assert sorted(map(tuple, back.select(key, "line").collect())) == sorted(map(tuple, raw.collect()))


def test_rows_that_no_dump_can_hold_are_refused(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="tagloom-zst-", dir="/tmp"), "dump")
    for row in (("a.zst", "x\ny"), (None, "x"), ("a.zst", None)):
        with pytest.raises(Exception, match="a dump line needs"):
            Z.write_frames(spark.createDataFrame([row], "file string, line string"), base)
