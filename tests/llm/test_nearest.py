import numpy as np
import pytest
from pyspark.sql import functions as F

from geomlake.llm import nearest

def asked():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault(len(v), []).append((i, np.array(v, np.float64)))
    usable = max(usable.items(), key=lambda x: (len(x[1]), x[0]))[1] if usable else []
    out = []
    for q, v in usable:
        if q % 50 == 0:
            near = sorted({(-round(float((v / np.sqrt((v * v).sum())) @ (w / np.sqrt((w * w).sum()))), 9), i) for i, w in usable if i != q})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(set(out))


def result(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9) + 0.0) for r in df.collect())


def test_hilbert_visits_every_cell_by_unit_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = nearest.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize(("window", "block", "queries"), [(128, 16_384, 4096), (8, 40, 3)])
def test_equals_brute_force(spark, monkeypatch, window, block, queries):
    for name, value in (("WINDOW", window), ("BLOCK", block), ("QUERIES", queries), ("PART", 16)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16)) * 3
    rows = [(i, (centres[i % 6] + rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(500)]
    for i in range(100, 260):
        rows[i] = (i, rows[100][1])
    rows += [(600, None), (650, [0.0] * 16), (700, [None] * 16), (750, [float("nan")] * 16), (800, [1.0] * 5), (None, rows[3][1]), (850, []), (900, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rep int, place string")
    assert result(nearest.nearest(df, asked())) == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert result(nearest.nearest(df, asked())) == brute(rows)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.nearest(spark.createDataFrame([], schema), asked()).count() == 0
    assert result(nearest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], schema), asked())) == [(0, 1, 1, 0.0)]
    assert nearest.nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema), asked()).count() == 0
