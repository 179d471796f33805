"""How many bytes of texts a Python worker is handed at once."""

from __future__ import annotations

import pandas as pd

import __spark_entry__

from .conftest import SMALL


def test_batches_of_long_texts_have_bounded_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key)
    most = lambda: spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1 << 20) AS t").mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n int").toPandas()["n"].max()
    assert most() == 40
    __spark_entry__.queries()["prj22_str03_win05_parts"](spark, SMALL)
    __spark_entry__.queries()["str17_cleaned_text"](spark, SMALL)
    assert most() <= 9
    __spark_entry__._importable(lambda *_: None)(spark, SMALL)
    assert spark.conf.get(key) == given
