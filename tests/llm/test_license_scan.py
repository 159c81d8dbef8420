import duckdb
import pytest

from geomlake.llm import license_scan

TEXTS = [
    "Released UNDER the MIT-License. under the mit license", "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0", "under the mit licens", None, "", "x" * 9 + " cc by nc cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated documentation files", "All rights reserved", "K all rightſ reserved Kcc by nc",
    "hereby granted free of charge", "GNU General Public License, version 3", "mit license", "word " * 50_000 + "cc by nc", "é cc\x00by nc", "cc by nc CC BY NC",
]
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def oracle(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return sorted(con.sql(license_scan.oracle()).select(*COLUMNS).fetchall(), key=str)


def test_small_cases(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", "y"), (0, TEXTS[0], "x", "y")], "doc_id long, text string, words string, places string")
    found = license_scan.scanned(docs)
    got = sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)
    assert got == oracle(docs.toPandas().astype({"doc_id": "Int64"}))
    by = {r["doc_id"]: r for r in found.collect()}
    assert (by[0]["n_base"], by[0]["first_word"], by[0]["last_word"], by[0]["base_labels"]) == (2, 1, 5, "mit")
    assert (by[1]["base_labels"], by[3]["n_words"], by[3]["labels"], by[3]["first_word"]) == ("apache-2,cc-by-nc", 0, "", None)
    assert by[6]["labels"] == "mit" and 0.8 <= by[6]["score"] < 1 and by[6]["n_base"] == 0
    assert license_scan.scanned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_tables(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    got = sorted((tuple(r) for r in license_scan.scanned(spark.read.parquet(path)).select(*COLUMNS).collect()), key=str)
    assert got == oracle(duckdb.read_parquet(path).df()) and any(r[2] for r in got)


def test_no_python_in_the_plan(spark):
    plan = license_scan.scanned(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
