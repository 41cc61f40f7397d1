"""The streaming rough cut gives the batch result on the same dump files."""

import os
import tempfile

from pyspark.sql import functions as F

from tagloom import lexicon as L
from tagloom.plans import standins as S
from tagloom.sources import dumps as DU
from tagloom.streaming import rough_filter as RF
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="tagloom-stream-", dir="/tmp")
    src = os.path.join(base, "dumps")
    os.makedirs(src)
    raw = S.raw_lines(spark, SF_SMALL)
    # a small fixture: the dump files of a few sources, under their dump names
    files = {}
    for r in raw.filter(F.col("file").rlike("^src[0-3]_")).collect():
        files.setdefault(r.file.replace(".zst", ".txt"), []).append(r.line)
    for name, lines in files.items():
        with open(os.path.join(src, name), "w") as fh:
            fh.write("\n".join(lines) + "\n")
    batch_in = spark.read.text(src).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    exp_hits = DU.rough_filter(DU.parse_json_lines(batch_in), L.FIXTURE_LEXICON)
    assert exp_hits.count() > 0
    assert {"comments", "submissions"} <= {r.kind for r in DU.parse_json_lines(batch_in).select("kind").distinct().collect()}
    q = RF.start(spark, src, os.path.join(base, "out"), L.FIXTURE_LEXICON,
                 os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = RF.hits(spark, os.path.join(base, "out")).select("id", "keywords")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp_hits.select("id", "keywords").collect()))
    counts = RF.line_counts(spark, os.path.join(base, "out"))
    want = DU.scan_line_counts(DU.tag_lines(DU.parse_json_lines(batch_in), L.FIXTURE_LEXICON))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    assert counts.agg(F.sum("total_lines")).first()[0] < batch_in.count()  # removed bodies are not counted
