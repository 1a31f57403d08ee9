from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from breathlake.functions.keys import calendar_date, subject_key
from breathlake.operators.registry import Extractors
from breathlake.sources import files, sinks, xlsx
from breathlake.sources.names import date_from_name, subject_from_name
from breathlake.streaming.windows import stream_windows


def mat5(arrays):
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for i, (name, x) in enumerate(arrays.items()):
        x = np.asarray(x, "<f8")
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 1, len(x))) + element(1, name.encode()) + element(9, x.tobytes())
        m = element(14, body)
        out += m if i % 2 else struct.pack("<II", 15, len(zlib.compress(m))) + zlib.compress(m)
    return out


def test_files(spark, tmp_path):
    (tmp_path / "abcd_-_3_1_24.csv").write_text("time,signal\n0,1\n0.5,2\n1.0,nan\n")
    (tmp_path / "xy.csv").write_text("1\n2\n3\n")
    (tmp_path / "bad_5_6_99.csv").write_text("q,w\n1,2\n")
    got = {r.path.split("/")[-1]: r for r in files.read_csv_recordings(spark, str(tmp_path)).collect()}
    a = got["abcd_-_3_1_24.csv"]
    assert (a.subject_id, a.recording_date, a.sampling_rate, a.signal) == ("ABCD", "20240103", 2.0, [1.0, 2.0, None])
    assert got["xy.csv"].sampling_rate == 6.0 and got["xy.csv"].recording_date == "UNKNOWN"
    assert got["bad_5_6_99.csv"].status == "error" and got["bad_5_6_99.csv"].recording_date == "19990605"
    (tmp_path / "m.mat").write_bytes(mat5({"fs": [4.0], "Data": [1.0, 2.0]}))
    m = files.read_mat_recordings(spark, str(tmp_path)).first()
    assert (m.sampling_rate, m.signal, m.status) == (4.0, [1.0, 2.0], "ok")
    (tmp_path / "b.bin").write_bytes(np.array([1, -2], ">i2").tobytes())
    b = files.read_binary_recordings(spark, str(tmp_path), 5.0, "int16", "big").first()
    assert b.signal == [1.0, -2.0]
    assert files.to_samples(files.read_csv_recordings(spark, str(tmp_path))).count() == 6


def test_labels_and_workbooks(spark, tmp_path):
    df = spark.createDataFrame([(" A1 ", 1, None), ("B2", 0, 2.5)], " `SubjectID ` string, recovery int, note double".strip())
    path = str(tmp_path / "l.xlsx")
    xlsx.write_workbook(path, {"x" * 40: df, "second": df})
    back = files.read_labels(spark, path)
    assert [tuple(r) for r in back.orderBy("subject_id").collect()] == [("A1", "1", None), ("B2", "0", "2.5")]
    sinks.write_csv(df.withColumn("arr", F.array("recovery")), str(tmp_path / "c"), single=True)
    assert files.read_labels(spark, str(tmp_path / "c")).count() == 2
    with pytest.raises(KeyError):
        files.read_labels(spark, path, "Nope")
    s = {r.outcome: (r.valid, r.missing) for r in sinks.label_summary(df, ["recovery", "note"]).collect()}
    assert s == {"recovery": (2, 0), "note": (1, 1)}
    res = spark.createDataFrame([("f", 0.01, 0.5), ("g", 0.5, 0.1)], "feature string, p_value double, effect_size double")
    assert "Significant at 0.05: 1" in sinks.statistics_report(res)


def test_names_and_keys(spark):
    df = spark.createDataFrame([("d/ab.mat",), ("x/wxyz_1_2_3.mat",), (None,)], "p string")
    got = [tuple(r) for r in df.select(subject_from_name("p"), date_from_name("p")).collect()]
    assert got[0] == ("ab", "UNKNOWN") and got[1] == ("WXYZ", "20030201")
    d = spark.createDataFrame([(x,) for x in ("20240305", "2024-3-5", "5.3.2024", "05_03_24", "5/3/2024", "UNKNOWN", None, "1234")], "d string")
    assert [r[0] for r in d.select(calendar_date("d")).collect()] == ["20240305"] * 5 + [None] * 3
    k = spark.createDataFrame([(x,) for x in (" a-1", "(A1)", "Unknown ", "  ", None)], "k string")
    assert [r[0] for r in k.select(subject_key("k")).collect()] == ["A1", "A1", None, None, None]


def test_extractors_fail_alone(spark):
    w = spark.createDataFrame([(1, 1, 2.0, [1.0, 3.0]), (2, 1, 2.0, [])], "window_id long, recording_id long, sampling_rate double, window_data array<double>")
    e = Extractors().register("m", ("mean",), lambda x, r: {"mean": x.mean()}).register("bad", ("z",), lambda x, r: 1 / 0)
    got = {r.window_id: r for r in e.extract(w).collect()}
    assert got[1].m_mean == 2 and got[1].bad_z is None and got[1].failed == ["bad"] and got[2].failed == ["m", "bad"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(600).selectExpr("id % 3 as k", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 10) as ts", "double(id % 7) as x")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.read.parquet(str(tmp_path / "in"))
    want = {(r.k, r.start): r.n for r in stream_windows(src, "k", "ts", "x", "10 minutes", "5 minutes").collect()}
    q = stream_windows(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "k", "ts", "x", "10 minutes", "5 minutes", "10 minutes")
    q = q.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r.k, r.start): r.n for r in spark.sql("select * from w").collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_sheets_by_name_and_names_that_agree(spark, tmp_path):
    from breathlake.sources.xlsx import read_sheet, sheet_names, write_workbook
    from breathlake.sources.files import read_labels

    long = "a" * 31
    df = lambda v: spark.createDataFrame([(v, 1)], "SubjectID string, y int")
    at = str(tmp_path / "w.xlsx")
    write_workbook(at, {long + "x": df("p"), long + "y": df("q"), "Labels": df(" r ")})
    names = list(sheet_names(at))
    assert names == [long, "a" * 27 + " (2)", "Labels"] and read_sheet(at, names[1])[1][0] == "q" and read_sheet(at)[1][0] == "p"
    assert read_labels(spark, at, sheet="Labels").first().subject_id == "r"
    with pytest.raises(KeyError):
        read_sheet(at, "none")
