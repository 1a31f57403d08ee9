"""Custom extractors: functions of one window's samples, run side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: From samples (NaN where missing) and sampling rate to named numbers.
Kernel = Callable[[np.ndarray, float], dict[str, float]]


class Extractors:
    """Extractors by name; each declares its outputs, which are prefixed by its name."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[tuple[str, ...], Kernel]] = {}

    def register(self, name: str, outputs: tuple[str, ...], kernel: Kernel) -> Extractors:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = (outputs, kernel)
        return self

    def columns(self) -> list[str]:
        return [f"{n}_{o}" for n, (outs, _) in self._known.items() for o in outs]

    def extract(self, windows: DataFrame, keys: tuple[str, ...] = ("window_id", "recording_id")) -> DataFrame:
        """``keys``, all outputs, and ``failed``: the extractors that raised on this window.

        A failing extractor gives NULLs, the others still count. An empty or
        null window fails in all.
        """
        known, cols = dict(self._known), self.columns()
        rows = windows.select(*keys, "sampling_rate", windows["window_data"].cast("array<double>").alias("d"))
        head = rows.select(*keys).schema
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head] + [f"`{c}` double" for c in cols] + ["failed array<string>"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values: list[list] = [[] for _ in cols]
                failed = []
                for i in range(batch.num_rows):
                    raw, rate = batch.column(len(keys) + 1)[i].values, batch.column(len(keys))[i].as_py()
                    x = raw.to_numpy(zero_copy_only=False).astype(float) if raw is not None else np.zeros(0)
                    at, bad = 0, []
                    for name, (outs, kernel) in known.items():
                        try:
                            if not len(x) or not rate:
                                raise ValueError("no samples")
                            got = kernel(x, rate)
                            new = [got.get(o) for o in outs]
                        except Exception:
                            new, _ = [None] * len(outs), bad.append(name)
                        for v in new:
                            values[at].append(None if v is None or v != v else float(v))
                            at += 1
                    failed.append(bad)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(v, pa.float64()) for v in values], pa.array(failed, pa.list_(pa.string()))], names=[*keys, *cols, "failed"])

        return rows.mapInArrow(run, schema)
