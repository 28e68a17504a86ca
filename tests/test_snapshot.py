import os
import zipfile

import pytest
from pyspark.sql import types as T

from firmament.sources import snapshot as SN

SCHEMA = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("a", T.StringType(), True),
                       T.StructField("n", T.IntegerType(), True)])


def write(tmp_dir, text, name="s.csv"):
    path = os.path.join(tmp_dir, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_null_rule_quotes_and_positional_header(spark, tmp_dir):
    p = write(tmp_dir, 'x,y,z\n1,"",3\n2,,\n3,"say ""hi"", ok",5\n')
    rows = {r.k: r for r in SN.load_snapshot(spark, p, SCHEMA).collect()}
    assert rows["1"].a == "" and rows["2"].a is None and rows["2"].n is None
    assert rows["3"].a == 'say "hi", ok'


def test_quoted_newline_needs_multiline(spark, tmp_dir):
    p = write(tmp_dir, 'k,a,n\n1,"two\nlines",1\n2,b,2\n')
    rows = {r.k: r.a for r in SN.load_snapshot(spark, p, SCHEMA, multiline=True).collect()}
    assert rows == {"1": "two\nlines", "2": "b"}


@pytest.mark.parametrize("body", ["k,a,n\n1,a\n", "k,a,n\n1,a,2,9\n", "k,a,n\n1,a,notanint\n"])
def test_failfast(spark, tmp_dir, body):
    p = write(tmp_dir, body)
    with pytest.raises(Exception):
        SN.load_snapshot(spark, p, SCHEMA).collect()


def test_unpack_archives(spark, tmp_dir):
    good = os.path.join(tmp_dir, "good.zip")
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("data.csv", "k,a,n\n1,a,1\n")
    out = os.path.join(tmp_dir, "out")
    r = SN.unpack_archives(spark, good, out).first()
    assert r.bytes == len("k,a,n\n1,a,1\n") and os.path.exists(r.csv_path)
    bad = os.path.join(tmp_dir, "bad.zip")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("a.csv", "x")
        z.writestr("b.csv", "y")
    with pytest.raises(Exception):
        SN.unpack_archives(spark, bad, out).collect()


def test_sources_to_load(spark):
    import datetime as dt

    t = dt.datetime
    manifest = spark.createDataFrame([("a", t(2024, 1, 2)), ("b", t(2024, 1, 2)), ("c", None), ("d", t(2024, 1, 2))],
                                     "group_type string, last_modified timestamp")
    ledger = spark.createDataFrame(
        [("a", t(2024, 1, 1), None), ("b", t(2024, 1, 2), None), ("d", t(2024, 1, 1), t(2024, 1, 3))],
        "group_type string, last_imported_timestamp timestamp, staging_imported_timestamp timestamp")
    got = {r.group_type for r in SN.sources_to_load(manifest, ledger).collect()}
    assert got == {"a", "c"}
    assert {r.group_type for r in SN.sources_to_load(manifest, ledger, force=True).collect()} == {"a", "b", "c", "d"}
