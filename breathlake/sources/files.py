"""Recordings from CSV, raw binary and MAT files, one row a file.

Files are read as ``binaryFile`` rows and decoded where they lie; a file that
cannot be decoded becomes a row with ``status = 'error'``, never an exception.
The glob is not recursive.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breathlake.sources.names import date_from_name, subject_from_name

#: Sampling rate of files that do not state theirs, in Hz.
DEFAULT_RATE = 6.0
#: Names under which a file may hold its samples or its rate, in order of preference (fixed values).
MAT_DATA_KEYS = ("ds_data", "data", "signal", "resp", "respiratory", "y", "x", "values", "samples")
MAT_RATE_KEYS = ("fs", "Fs", "sampling_rate", "sample_rate", "sr", "freq", "frequency")
CSV_DATA_COLUMNS = ("signal", "data", "respiratory", "resp", "y", "value")
CSV_TIME_COLUMNS = ("time", "t", "Time")

_ARROW = pa.schema([("path", pa.string()), ("sampling_rate", pa.float64()), ("signal", pa.list_(pa.float64())), ("status", pa.string()), ("error", pa.string())])


def _read(spark: SparkSession, folder: str, pattern: str, decode: Callable[[bytes], tuple[float, np.ndarray]]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rate, x = decode(content.as_py())
                    x = np.asarray(x, float).ravel()
                    if not len(x):
                        raise ValueError("no samples")
                    row = (path, float(rate), pa.array(x, mask=~np.isfinite(x)).to_pylist(), "ok", None)
                except Exception as e:  # the row says what went wrong
                    row = (path, None, None, "error", f"{type(e).__name__}: {e}")
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW)], schema=_ARROW)

    rows = files.mapInArrow(run, "path string, sampling_rate double, signal array<double>, status string, error string")
    return rows.select("path", subject_from_name("path").alias("subject_id"), date_from_name("path").alias("recording_date"), "sampling_rate", "signal", "status", "error")


def infer_rate(time: np.ndarray) -> float:
    """One over the median step; fewer than two points or no forward step is an error."""
    if len(time) < 2 or not (step := float(np.median(np.diff(time)))) > 0:
        raise ValueError("sampling rate cannot be inferred")
    return 1.0 / step


def decode_csv(content: bytes, signal: str | None = None, time: str | None = None, rate: float | None = None) -> tuple[float, np.ndarray]:
    """With header: named columns or the usual ones. Without: (time, signal) or (signal)."""
    import io

    import pandas as pd

    first = content.split(b"\n", 1)[0].decode().strip().split(",")

    def number(v: str) -> bool:
        try:
            float(v)
            return True
        except ValueError:
            return False

    if all(number(v) for v in first if v):
        t = pd.read_csv(io.BytesIO(content), header=None)
        x, at = (t[1], t[0]) if t.shape[1] >= 2 else (t[0], None)
    else:
        t = pd.read_csv(io.BytesIO(content))
        name = next((c for c in ([signal] if signal else CSV_DATA_COLUMNS) if c in t), None)
        if name is None:
            raise KeyError("no signal column")
        clock = next((c for c in ([time] if time else CSV_TIME_COLUMNS) if c in t), None)
        x, at = t[name], t[clock] if clock else None
    return rate or (infer_rate(at.to_numpy(float)) if at is not None else DEFAULT_RATE), x.to_numpy(float)


def read_csv_recordings(spark: SparkSession, folder: str, pattern: str = "*.csv", signal: str | None = None, time: str | None = None, rate: float | None = None) -> DataFrame:
    return _read(spark, folder, pattern, lambda b: decode_csv(b, signal, time, rate))


def read_binary_recordings(spark: SparkSession, folder: str, rate: float, dtype: str = "float64", byte_order: str = "little", pattern: str = "*.bin") -> DataFrame:
    """Headerless arrays of one type."""
    kind = np.dtype(dtype).newbyteorder("<" if byte_order == "little" else ">")
    return _read(spark, folder, pattern, lambda b: (rate, np.frombuffer(b, kind)))


#: MAT level 5 storage types that hold numbers.
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _mat_elements(b: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(b):
        head = struct.unpack_from(order + "I", b, at)[0]
        if head >> 16:  # small element: size and type share a word
            yield head & 0xFFFF, b[at + 4: at + 4 + (head >> 16)]
            at += 8
            continue
        size = struct.unpack_from(order + "I", b, at + 4)[0]
        yield head, b[at + 8: at + 8 + size]
        at += 8 + size + (-size % 8 if head != 15 else 0)


def decode_mat(content: bytes, data_key: str | None = None, rate_key: str | None = None, default_rate: float = DEFAULT_RATE) -> tuple[float, np.ndarray]:
    """Numeric arrays of a MAT level 5 file; samples and rate by name, or by the usual names."""
    order = "<" if content[126:128] == b"IM" else ">"
    found: dict[str, np.ndarray] = {}
    for kind, body in _mat_elements(content[128:], order):
        if kind == 15:
            kind, body = next(_mat_elements(zlib.decompress(body), order))
        if kind != 14:
            continue
        parts = list(_mat_elements(body, order))
        if len(parts) >= 4 and parts[3][0] in _MAT_TYPES:
            found[parts[2][1].decode().strip("\0")] = np.frombuffer(parts[3][1], order + _MAT_TYPES[parts[3][0]]).astype(float)
    lower = {k.lower(): k for k in found}
    rate_name = rate_key or next((k for k in MAT_RATE_KEYS if k in found), None)
    rest = [k for k in found if k != rate_name]
    name = data_key or next((k for k in MAT_DATA_KEYS if k in found), None) or (rest[0] if len(rest) == 1 else next((lower[k.lower()] for k in MAT_DATA_KEYS if k.lower() in lower), None))
    if name not in found:
        raise KeyError("no array of samples")
    return float(found[rate_name][0]) if rate_name in found else default_rate, found[name]


def read_mat_recordings(spark: SparkSession, folder: str, pattern: str = "*.mat", data_key: str | None = None, rate_key: str | None = None) -> DataFrame:
    return _read(spark, folder, pattern, lambda b: decode_mat(b, data_key, rate_key))


def to_samples(recordings: DataFrame) -> DataFrame:
    """The relational form of decoded files: ``recording_id, idx, x, rate``."""
    ok = recordings.filter("status = 'ok'")
    return ok.select(F.xxhash64("path").alias("recording_id"), F.col("sampling_rate").alias("rate"), F.posexplode("signal").alias("i", "x")).select("recording_id", F.col("i").cast("bigint").alias("idx"), "x", "rate")


def read_labels(spark: SparkSession, path: str, id_column: str = "SubjectID", sheet: int | str = 1) -> DataFrame:
    """Labels from CSV or a sheet of an .xlsx, by number or name; the id column may have blanks around it.

    The id becomes ``subject_id``, a trimmed string. A missing id column is an error.
    """
    if path.endswith(".xlsx"):
        from breathlake.sources.xlsx import read_sheet

        rows = read_sheet(path, sheet)
        df = spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0])) if rows else spark.createDataFrame([], "none string")
    else:
        df = spark.read.csv(path, header=True)
    name = next((c for c in df.columns if c.strip() == id_column), None)
    if name is None:
        raise KeyError(f"no column {id_column}")
    return df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias("subject_id") if c == name else F.col(f"`{c}`").alias(c.strip()) for c in df.columns])
