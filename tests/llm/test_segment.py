from __future__ import annotations

import numpy as np
import pytest

from breathlake.llm.segment import CutRules, cohesion, cut_points, cut_windows, depths, words

W = "window_id long, config_id int, start_idx long, start_time double, end_time double, sampling_rate double, window_data array<double>, piece int"
C = "config_id int, window_size double, overlap double"


def breaths(n, rate):
    t = np.arange(n) / rate
    return np.maximum(np.sin(2 * np.pi * t / 5.0), 0) * 10  # rests for half of each cycle


def test_pieces_cover_fit_and_overlap(spark):
    rate = 6.0
    x = breaths(1500, rate)
    rows = [
        (1, 1, 60, 10.0, 260.0, rate, x.tolist(), 5), (1, 1, 60, 10.0, 260.0, rate, x.tolist(), 5), (2, 1, 0, 0.0, None, rate, x[:720].tolist(), 5), (3, 1, 0, 0.0, 60.0, rate, x[:360].tolist(), 5),
        (4, 1, 0, 0.0, 60.005, rate, x[:360].tolist(), 5), (5, 2, 0, 0.0, 90.0, rate, None, 5), (6, 3, 0, 0.0, 900.0, rate, [], 5), (7, 9, 0, 0.0, 900.0, rate, [1.0], 5),
        (8, 1, 0, 0.0, 70.0, rate, [None] * 420, 5), (9, 1, 0, 0.0, None, rate, None, 5), (10, None, 0, 0.0, 900.0, rate, [1.0], 5),
    ]
    out = cut_windows(spark.createDataFrame(rows, W), spark.createDataFrame([(1, 60.0, 12.0), (2, 30.0, 0.0), (3, None, 1.0), (4, 30.0, 30.0)], C)).collect()
    by = {}
    for r in out:
        by.setdefault(r.window_id, []).append(r)
    assert set(by) == {1, 2, 5, 8}
    for w, pieces in by.items():
        pieces.sort(key=lambda r: r.piece)
        size, lap = (60.0, 12.0) if w != 5 else (30.0, 0.0)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and {p.pieces for p in pieces} == {len(pieces)}
        assert all(p.end_time - p.start_time <= size + 1e-6 for p in pieces)
        assert all(a.end_idx - b.start_idx == round(lap * rate) for a, b in zip(pieces, pieces[1:]))
    assert by[1][0].start_idx == 60 and by[1][-1].end_idx == 1560
    joined = {}
    for p in by[1]:
        joined.update(zip(range(p.start_idx, p.end_idx), p.piece_data))
    assert [joined[i] for i in range(60, 1560)] == x.tolist()
    cuts = [p for p in by[1] if p.cut != "end"]
    assert sum(p.cut == "boundary" for p in cuts) >= 0.8 * len(cuts)
    assert by[5][0].piece_data is None and by[8][0].cut == "limit"


def test_valleys():
    sim = np.array([0.9, 0.5, 0.8, 0.8, 0.2, 1.0, 0.6])
    assert depths(sim).tolist() == pytest.approx([0, 0.7, 0, 0, 1.4, 0, 0])
    w = words(np.r_[np.zeros(20), np.full(20, 5.0)], 8)
    c = cohesion(w, 24, 8)
    assert np.argmin(c) in (18, 19, 20)
    for n in (1, 5, 50):
        p = cut_points(np.zeros(0), n, 10, 3, 1.0, CutRules())
        assert p[0][0] == 0 and p[-1][1] == n and all(b - a <= 10 for a, b, _ in p)
