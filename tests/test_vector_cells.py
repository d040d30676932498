"""Vectors by cell give the rows of a search over all of them."""

import random

from pyspark.sql import functions as F

from textloom.operators import retrieval, vector_cells


def rows_of(found, name):
    return sorted((r["qid"], r["rank"], r["score"], r[name]) for r in found.collect())


def clustered(rng, n, around, spread, dim=8):
    out = []
    for i in range(n):
        c = rng.choice(around)
        out.append((i, [x + rng.gauss(0, spread) for x in c]))
    return out


def test_cells_give_the_rows_of_vector_search(spark, tmp_path):
    rng = random.Random(3)
    around = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = clustered(rng, 1500, around, 0.1)
    rows += [(i, rows[7][1]) for i in range(2000, 2300)]  # one vector, many ids
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [2 * x for x in rows[7][1]])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 1500, 60)] + [(-1, None), (-2, [0.0] * 8), (7, rows[7][1])], "qid long, embedding array<double>")
    plain = df.where("chunk_id <> 3002")
    for k, limit in ((20, 10), (1, 3), (200, 400)):
        path, seen = str(tmp_path / f"cells{k}"), {}
        vector_cells.store_cells(df, path, cells=k)
        got = rows_of(vector_cells.search_cells(asked, path, limit=limit, seen=seen), "id")
        assert got == rows_of(retrieval.vector_search(asked, plain, limit=limit), "chunk_id")
        if k == 20:
            assert seen["scored"] < 0.5 * seen["all"]


def test_cells_of_nothing_and_of_little(spark, tmp_path):
    none = spark.createDataFrame([(1, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    vector_cells.store_cells(none, str(tmp_path / "none"))
    assert vector_cells.search_cells(asked, str(tmp_path / "none")).collect() == []
    one = spark.createDataFrame([("a", [1.0, 1.0])], "chunk_id string, embedding array<double>")
    vector_cells.store_cells(one, str(tmp_path / "one"))
    assert [(r["id"], round(r["score"], 6), r["rank"]) for r in vector_cells.search_cells(asked, str(tmp_path / "one")).collect()] == [("a", 0.707107, 1)]
    assert vector_cells.search_cells(asked.where("qid > 9"), str(tmp_path / "one")).collect() == []
    opened = {r[0] for r in spark.read.parquet(str(tmp_path / "one" / "vectors")).select(F.input_file_name()).collect()}
    assert len(opened) == 1
