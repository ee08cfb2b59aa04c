from gleaner.functions import routing
from pyspark.sql import functions as F


def test_visual_scores(spark):
    rows = [(".pdf", 10, False, 0.0, None, None), (".pdf", 100, True, 0.0, None, None), (".docx", 0, True, 0.5, None, None), (".png", 0, False, 1.0, 1200, 900), (".png", 0, False, 1.0, 64, 640), (".png", 0, False, 1.0, None, None), (".png", 0, False, 1.0, 64, 0), (None, 0, True, 0.0, 1, 1)]
    frame = spark.createDataFrame(rows, "e string, d int, x boolean, r double, w int, h int")
    assert [r[0] for r in frame.select(routing.visual_score(*map(F.col, "edxrwh"))).collect()] == [8, 2, 2, 4, 1, 0, 0, 0]


def test_a_user_cannot_lower_what_the_content_asks_for(spark):
    frame = spark.createDataFrame([(9, "casual"), (0, "CRITICAL"), (0, "casual"), (0, "normal"), (0, None), (3, "?")], "s int, w string")
    assert [tuple(r[0]) for r in frame.select(routing.criticality(F.col("s"), F.col("w"))).collect()] == [
        ("critical", "auto"), ("critical", "user"), ("casual", "user"), ("normal", "user"), ("normal", "default"), ("normal", "default"),
    ]


def test_page_labels_and_table_stats(spark):
    frame = spark.createDataFrame([("head\n 12 \nx\ny\nz\nq",), ("p\nq\nr\ns\nt\nxiv",), ("p\nq\nr\n5\ns\nt\nu",), ("",), (None,), ("7",)], "t string")
    assert [r[0] for r in frame.select(routing.page_label(F.col("t"))).collect()] == ["12", "xiv", None, None, None, "7"]
    got = spark.range(1).select(routing.table_stats(F.lit(3), F.array(F.lit("a"), F.lit("b"))), routing.table_stats(F.lit(0), F.array().cast("array<string>"))).first()
    assert list(got) == ["\n## File statistics\n\n- **Rows:** 3\n- **Columns (2):** a, b\n", "\n## File statistics\n\n_CSV has no header row_\n"]
