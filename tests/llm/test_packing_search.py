"""op6 on sizes where best fit decreasing isn't optimal: the whole distributed packing, not only its steps."""

import numpy as np

from ledgerloom.llm import packing
from ledgerloom.llm.common import Workspace


def triplets(seed, bins=8):
    rng, sizes = np.random.default_rng(seed), []
    for _ in range(bins):  # three pieces that fill a sequence exactly
        a = int(rng.integers(380, 490))
        b = int(rng.integers(max(251, 1000 - a - 370), min(499, 1000 - a - 251)))
        sizes += [a, b, 1000 - a - b]
    return sizes


def test_generations_run_where_best_fit_isnt_optimal(spark, monkeypatch):
    monkeypatch.setattr(packing, "GENERATIONS", 150)
    plain = evolved = 0
    for seed in range(3):
        sizes = triplets(seed)
        best_fit = len(packing.best_fit(list(range(len(sizes))), sizes, [], 1000))
        pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length int")
        rows = packing.pack(Workspace(spark, "search"), pieces, 1000).collect()
        assert sorted(r["uid"] for r in rows) == list(range(len(sizes)))
        filled = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert filled.get(r["sequence_id"], 0) == r["offset"]
            filled[r["sequence_id"]] = r["offset"] + sizes[r["uid"]]
        assert max(filled.values()) <= 1000 and len(filled) <= best_fit
        plain, evolved = plain + best_fit, evolved + len(filled)
    assert evolved < plain
