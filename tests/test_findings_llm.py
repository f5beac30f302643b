"""Faults of corpus operators that a review found on larger tables."""

import numpy as np
import pandas as pd

from lectern.llm import lm_score


def test_all_requests_to_a_slice_are_read_at_once(monkeypatch):
    h = lm_score.mix(np.arange(1, 2001, dtype=np.uint64))
    c = np.arange(1, 2001) % 300 + 1
    frame = pd.DataFrame({"kind": [0, 1], "hashes": [h.tobytes()] * 2, "counts": [c.astype(np.uint32).tobytes()] * 2})
    known = lm_score._build_slice(0)((0,), frame)
    parts = [np.sort(h[i :: 50]) for i in range(50)] + [h[:0]]
    asked = pd.DataFrame({"batch": range(51), "slice": 0, "hashes": [x.tobytes() for x in parts], "pairs": [x.tobytes() for x in parts[::-1]]})
    calls, read = [], lm_score.read_levels
    monkeypatch.setattr(lm_score, "read_levels", lambda *a: calls.append(len(a[1])) or read(*a))
    got = lm_score._tell(0, 40)((0,), known, asked)
    assert len(calls) == 2
    for i in range(51):
        alone = lm_score._tell(0, 40)((0,), known, asked.iloc[[i]])
        assert got.iloc[i].tolist() == alone.iloc[0].tolist()


def test_exact_counts_of_each_request():
    h = np.sort(lm_score.mix(np.arange(1, 101, dtype=np.uint64)))
    known = pd.DataFrame({"hashes": [h.tobytes()], "counts": [np.arange(1, 101).tobytes()]})
    strange = lm_score.mix(np.arange(500, 503, dtype=np.uint64))
    asked = pd.DataFrame({"batch": [7, 8, 9], "hashes": [h[[0, 4, 9]].tobytes(), strange.tobytes(), h[[4]].tobytes()], "rows": [np.array(x, np.uint32).tobytes() for x in ([2, 0, 2], [0, 1, 2], [5])], "times": [np.array(x, np.uint32).tobytes() for x in ([1, 3, 2], [1, 1, 1], [4])]})
    for table, want in ((known, [{0: (3 * np.log10(6), 3), 2: (np.log10(2) + 2 * np.log10(11), 3)}, {}, {5: (4 * np.log10(6), 4)}]), (known.iloc[:0], [{}, {}, {}])):
        out = lm_score._answer((0,), table, asked)
        assert out["batch"].tolist() == [7, 8, 9]
        for row, expected in zip(out.itertuples(), want, strict=True):
            found = dict(zip(np.frombuffer(row.rows, np.uint32).tolist(), zip(np.frombuffer(row.base, np.float64), np.frombuffer(row.times, np.uint32), strict=True), strict=True))
            assert found.keys() == expected.keys() and all(np.allclose(found[k], expected[k]) for k in found)
