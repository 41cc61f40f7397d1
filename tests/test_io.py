"""Folder readers, sinks and model persistence (save / load round trips)."""

import os
import tempfile

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from tagloom.operators import ml as ML
from tagloom.plans import standins as S
from tagloom.sources import files as FI
from tests.conftest import SF_SMALL


def test_sheet_folder_roundtrip(spark):
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    sheet = S.thread_sheet(spark, SF_SMALL)
    cols = ["post_id", "comment_id", "reply_id", "title", "post_text", "comment_body", "reply_body"]
    out = sheet.select(*[F.col(c).cast("string") for c in cols])
    FI.write_table(out.coalesce(1), os.path.join(base, "sheets"), fmt="csv")
    back = FI.read_sheet_folder(spark, os.path.join(base, "sheets"))
    assert back.count() == out.count()
    assert sorted(map(tuple, back.select(*cols).collect()), key=str) == sorted(map(tuple, out.collect()), key=str)


def test_annotations_jsonl(spark):
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    h = S.hit_keys(spark, SF_SMALL)
    ann = h.select(F.col("id").cast("string").alias("id"),
                   F.transform("keywords", lambda k: F.create_map(F.lit("compound"), k)).alias("annotations"))
    ann.write.json(os.path.join(base, "ann"))
    back = FI.read_annotations(spark, os.path.join(base, "ann"))
    assert back.count() == ann.count()


def test_model_save_load(spark):
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    lab = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    data = docs.join(lab, "id")
    tf = ML.fit_tfidf(data, "text", 200)
    feats = tf.transform(data)
    lr = ML.train_logreg(feats)
    tf.pipeline.write().overwrite().save(os.path.join(base, "tfidf"))
    lr.write().overwrite().save(os.path.join(base, "lr"))
    tf2 = PipelineModel.load(os.path.join(base, "tfidf"))
    lr2 = LogisticRegressionModel.load(os.path.join(base, "lr"))
    a = sorted((r.id, r.prediction) for r in lr.transform(feats).collect())
    b = sorted((r.id, r.prediction) for r in lr2.transform(tf2.transform(data)).collect())
    assert a == b


def test_csv_columns_go_by_header(spark):
    """Files with the columns in another order, one more column, or without a text column."""
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    files = {
        "a.csv": "post_id,comment_id,reply_id,title,post_text,comment_body,reply_body\n1,2,3,t1,p1,c1,r1\n",
        "b.csv": "\ufefftitle,post_text,comment_body,reply_body,extra,post_id\n\"t,2\",\"p\n2\",c2,r2,zz,9\n",
        "c.csv": "post_id,title\n5,no texts here\n",
    }
    for name, text in files.items():
        with open(os.path.join(base, name), "w", encoding="utf-8") as f:
            f.write(text)
    got = sorted(tuple(r) for r in FI.read_sheet_folder(spark, base).select("subreddit", "post_id", "comment_id", "title", "post_text", "reply_body").collect())
    assert got == [("a", "1", "2", "t1", "p1", "r1"), ("b", "9", None, "t,2", "p\n2", "r2")]
    back = FI.read_csv_folder(spark, base, "post_id long, title string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "t1", "a.csv"), (5, "no texts here", "c.csv"), (9, "t,2", "b.csv")]
    assert FI.read_csv_folder(spark, base, "x string", ["nowhere"]).count() == 0


def test_zst_dump_is_read(spark):
    """Compressed lines, by two frames in one file, as dumps have them."""
    import zstandard
    from tagloom.sources import dumps as DU
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    lines = [f'{{"id": "{i}", "body": "thc {i}", "created_utc": 1600000000}}' for i in range(500)]
    c = zstandard.ZstdCompressor(write_checksum=True)
    with open(os.path.join(base, "trees_comments.zst"), "wb") as f:
        f.write(c.compress(("\n".join(lines[:300]) + "\n").encode()) + c.compress(("\n".join(lines[300:]) + "\n{broken\n").encode()))
    parsed = DU.parse_json_lines(DU.read_dump(spark, base))
    assert parsed.count() == 501 and parsed.filter("bad").count() == 1
    hits = DU.rough_filter(parsed, ["THC"])
    assert hits.count() == 500 and {r.short_name for r in hits.select("short_name").collect()} == {"trees_c"}


def test_json_lines_are_strict(spark):
    from tagloom.sources import dumps as DU
    ok = '{"id": "1", "body": "x {[}]", "created_utc": 1600000000}'
    rows = [ok, " " + ok + " ", ok + " trailing }", ok + "}", ok[:-1], "[" + ok + "]", ok + "," + ok, ok + "] [" + ok, "", "null", '{"id": "1"}']
    df = spark.createDataFrame([("a_comments.zst", x) for x in rows], "file string, line string")
    got = {r.line: r.bad for r in DU.parse_json_lines(df).collect()}
    assert [x for x in rows if not got[x]] == rows[:2]


def test_created_utc_takes_any_json_number(spark):
    """Fractions and exponents count; what no date can hold is a bad line, not a failed job."""
    from tagloom.sources import dumps as DU
    want = {"1600000000": 1600000000, '"1600000000"': 1600000000, "1.6e9": 1600000000, "16E+8": 1600000000, "1600000000.9": 1600000000, "-5": -5,
            "253402300799": 253402300799, "253402300800": None, "1e999": None, "99999999999999999999999": None, '"soon"': None, "null": None, "true": None}
    df = spark.createDataFrame([("a_comments.zst", f'{{"id": "{k.strip(chr(34))}", "body": "x", "created_utc": {k}}}', v) for k, v in want.items()], "file string, line string, want long")
    rows = DU.parse_json_lines(df).collect()
    assert all((r.created_utc, r.bad) == (r.want, r.want is None) for r in rows), rows
    assert DU.date_filter(DU.parse_json_lines(df).filter("not bad")).count() == 6


def test_annotations_with_text_ids_keep_file_order(spark):
    from tagloom.operators import spans as SP
    base = tempfile.mkdtemp(prefix="tagloom-io-", dir="/tmp")
    for name, ids in (("a.jsonl", ["z", "m"]), ("b.jsonl", ["c"])):
        with open(os.path.join(base, name), "w") as f:
            for i in ids:
                f.write(f'{{"id": "{i}", "annotations": [{{"compound": "{i}1"}}, {{"compound": "{i}2"}}]}}\n')
            f.write('{"id": "none"}\nnot json\n')
    rows = SP.annotation_rows(FI.read_annotations(spark, base), "id", "annotations", ["source_file", "block", "line"], ["compound"])
    got = {r.annotation_id: r.compound for r in rows.collect()}
    assert got == {"z_0": "z1", "z_1": "z2", "m_2": "m1", "m_3": "m2", "c_4": "c1", "c_5": "c2", "none_0": None}
