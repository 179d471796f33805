"""Marks of results under many questions."""

from __future__ import annotations

from palimpsest.operators import evaluate

from .test_growth import shuffled


def test_places_and_tokens_of_results_are_told_once(spark):
    """No row of a question and a result is shuffled, and no text is cut into tokens once a question."""
    asked = spark.range(0, 400, 1, 4).selectExpr("cast(id AS int) AS qid", "concat('how to fix w', id % 7, ' W1') AS q", "'how_to' AS intent", "array('python') AS techs", "array('fix') AS terms", "0.5D AS confidence")
    results = spark.range(0, 10, 1, 1).selectExpr("concat('i', 9 - id) AS id", "concat('W1 fix ', repeat(concat('w', id, ' '), 50)) AS content", "0.1D * (id div 2) AS score", "'turn' AS chunk_type")
    marks = evaluate.marked(asked, results)
    rows, _ = shuffled(spark, lambda: marks.write.format("noop").mode("overwrite").save())
    assert rows < 100
    found = {(r["qid"], r["id"]): (r["nth"], r["shared"], r["asked"]) for r in marks.collect()}
    assert len(found) == 4000
    places = [f"i{9 - k}" for k in (1, 0, 3, 2, 5, 4, 7, 6, 9, 8)]
    assert all(found[q, i] == (places.index(i), 3 if q % 7 > 1 and i == f"i{9 - q % 7}" else 2 + (q % 7 == 0 and i == "i9"), 5 - (q % 7 == 1)) for q, i in found)
