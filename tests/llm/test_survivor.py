from datetime import datetime

from corvane.llm.survivor import agreement, representatives, strategy, truth, valid_items
from pyspark.sql import functions as F

NAN = float("nan")
T = lambda d: datetime(2024, 1, d)


def test_ladders(spark):
    items = spark.createDataFrame(
        [
            ("q", 1, 5.0, 0.5, False, T(1)), ("q", 2, NAN, 0.9, True, T(1)), ("q", 3, 5.0, 0.5, False, T(1)), ("q", 3, 9.0, 0.5, False, None),
            ("m", 1, 1.0, 0.1, True, T(1)), ("m", 2, 1.0, 0.1, True, T(1)), ("n", 1, None, None, None, T(2)), ("n", 2, None, None, None, T(2)),
            ("o", 2, 1.0, 0.1, True, T(3)), ("o", 2, 1.0, 0.1, True, T(3)), ("o", 1, 1.0, 0.2, False, T(3)), ("x", 9, 1.0, 0.1, True, T(3)), (None, 1, 1.0, 1.0, True, T(1)),
        ],
        "content_id string, item_index bigint, quality_score double, metadata_confidence float, is_keep boolean, decided_at timestamp",
    )
    groups = spark.createDataFrame([("q", "HIGHEST-quality "), ("m", "manual"), ("n", "Newest"), ("o", "Manual"), ("x", None)], "content_id string, s string").select("content_id", strategy(F.col("s")).alias("strategy"))
    files = spark.createDataFrame([(1, 10, T(5), "A", 1.0), (2, 10, None, "  ", None), (3, 9, T(1), "C", 3.0), (3, 9, T(1), "C", 3.0)], "item_index bigint, file_size bigint, mtime timestamp, title string, rating double")
    got = {(r.content_id, r.field): (r.item_index, r.value) for r in representatives(valid_items(items), groups, files, ["title", "rating"], values=True).collect()}
    assert got == {("q", "record"): (1, None), ("n", "record"): (1, None), ("o", "record"): (2, None), ("q", "title"): (1, "A"), ("q", "rating"): (1, "1.0"), ("m", "title"): (1, "A"), ("m", "rating"): (1, "1.0"), ("n", "title"): (1, "A"), ("n", "rating"): (1, "1.0"), ("o", "title"): (1, "A"), ("o", "rating"): (1, "1.0")}
    assert representatives(valid_items(items.limit(0)), groups, files, ["title"]).count() == 0


def test_truth(spark):
    rows = []
    for i in range(60):
        for s in ("good", "fair", "third"):
            rows.append((f"e{i}", "cast", "right", s))
        if i % 2:
            rows += [(f"e{i}", "cast", "second", "good"), (f"e{i}", "cast", "second", "fair")]
        rows.append((f"e{i}", "cast", f"made up {i}", "liar"))
    rows += [(None, "cast", "x", "good"), ("e1", "cast", None, "good")] + rows[:5]
    judged, quality = truth(spark.createDataFrame(rows, "entity string, field string, value string, source string"))
    kept = {(r.entity, r.value) for r in judged.filter("probability > 0.5").collect()}
    assert kept == {(f"e{i}", "right") for i in range(60)} | {(f"e{i}", "second") for i in range(60) if i % 2}
    q = {r.source: r for r in quality.collect()}
    assert q["good"].sensitivity > 0.9 > 0.3 > q["liar"].sensitivity
    assert q["good"].specificity > q["liar"].specificity


def test_agreement(spark):
    judged = spark.createDataFrame([("a", "t", "x", 0.9), ("a", "t", "y", 0.2), ("b", "t", "x", 0.5), ("b", "t", "y", 0.5), ("c", "t", "z", 0.7), ("d", "t", "q", 0.1)], "entity string, field string, value string, probability double")
    chosen = spark.createDataFrame([("a", "t", "y"), ("b", "t", " y "), ("d", "t", "other"), ("e", "t", "m")], "entity string, field string, value string")
    assert [tuple(r) for r in agreement(chosen, judged).collect()] == [("t", 5, 1, 2, 1, 1)]


def test_truth_with_many_sources(spark, monkeypatch):
    from corvane.llm import survivor

    rows = [(f"e{i}", "f", f"v{i % 3}", f"s{j}") for i in range(20) for j in range(5) if (i + j) % 4]
    df = spark.createDataFrame(rows, "entity string, field string, value string, source string")
    told = lambda: sorted((r.entity, r.value, round(r.probability, 9)) for r in survivor.truth(df)[0].collect())
    few = told()
    monkeypatch.setattr(survivor, "FEW_SOURCES", 2)
    assert told() == few
    assert survivor.truth(df.limit(0))[0].count() == 0
