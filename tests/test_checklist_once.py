"""The steps of a checklist are made once."""

from __future__ import annotations

from pyspark.sql import Row

from fleetscope.plans.catalog.base import Tables
from fleetscope.plans.catalog.docs import QUERIES, checked


def test_checklist_sections_reads_steps_of_a_table(spark, tmp_path):
    """The plan of the result reads a table of the steps, and of the sources only those that name repositories."""
    documents = [
        Row(doc_id=i, text="api_key = 'kd83jKs93jdKs02'" if i == 3 else "plain words", lang=("en", "fr", "de")[i % 3], source=f"r{i % 4}", n_chars=i)
        for i in range(24)
    ]
    tables = {
        "documents": documents,
        "labels": [Row(doc_id=i, quality=i % 2, toxic=int(i % 5 == 0)) for i in range(24)],
        "supplier": [Row(s_suppkey=i, s_acctbal=1.0) for i in range(5)],
        "lineitem": [Row(l_orderkey=i, l_partkey=i % 3, l_suppkey=i % 2, l_returnflag="ANR"[i % 3 if i % 2 else 0]) for i in range(12)],
        "part": [Row(p_partkey=i, p_name="red bolt" if i % 2 else "blue rod", p_brand=f"b{i % 2}", p_size=i) for i in range(6)],
        "events": [
            Row(event_id=i, ts=1_700_000_000 + i, user_id=i % 3, event_type=("click", "view", "purchase")[i % 3], value=float(i), props=f'{{"k": {i}}}') for i in range(12)
        ],
    }
    for name, rows in tables.items():
        frame = spark.createDataFrame(rows)
        if name == "events":
            frame = frame.selectExpr("event_id", "timestamp_seconds(ts) AS ts", "user_id", "event_type", "value", "props")
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["checklist_sections"](spark, str(tmp_path))
    read = {path.split("/")[-2] for path in got.inputFiles()}
    assert read <= {"steps", "documents.parquet", "supplier.parquet"} and "steps" in read
    rows = [tuple(r) for r in got.collect()]
    busy = {r[0] for r in rows if r[1] < 8}
    assert {r[0] for r in rows if r[1] == 8} == ({f"r{i}" for i in range(4)} | {f"s{i}" for i in range(5)}) - busy
    stale = checked(Tables(spark, str(tmp_path))).filter("NOT valid").groupBy("repo").count().collect()
    assert {(r[0], r[2].split(" ")[1]) for r in rows if r[1] == 5} == {(r["repo"], str(r["count"])) for r in stale}
