"""The join that deals hot keys to parts, against a plain join."""

from palimpsest.llm import _shared


def test_hot_and_cold_keys(spark, monkeypatch):
    monkeypatch.setattr(_shared, "HOT_LEAST", 5)
    data = [(0, v) for v in range(60)] + [(k, k) for k in range(1, 9)] + [(3, 99), (3, 99), (77, 1)]
    rows = spark.createDataFrame(data, "key long, v long")
    groups = rows.where("key != 77").groupBy("key").count().withColumnRenamed("count", "size")
    found = _shared.join_dealt(rows, groups, "key", "size", len(data), "v")
    assert sorted(found.columns) == ["key", "size", "v"]
    assert sorted(map(tuple, found.select("key", "v", "size").collect())) == sorted(map(tuple, rows.join(groups, "key").select("key", "v", "size").collect()))
    assert _shared.join_dealt(rows.limit(0), groups, "key", "size", 0, "v").count() == 0
