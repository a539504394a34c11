"""Small inputs with the awkward cases: nulls, empty and long texts, ties, repeated rows,
extra columns whose names clash with those that the operators use inside."""

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away into the dark woods"),
    (2, "The quick brown fox jumps over the lazy dog and runs away into the dark woods"),
    (2, "The quick brown fox jumps over the lazy dog and runs away into the dark woods"),
    (3, ""),
    (4, None),
    (None, "no id here"),
    (5, "   \n\t "),
    (6, "été à la plage\nl'eau était BELLE\n\n😀 ok 漢字"),
    (7, "word " * 30_000),
    (8, "x" * 70_000 + " tail " + "9" * 3_000),
]


def messy(spark, rows=TEXTS):
    out = [(i, t, f"src{(i or 0) % 2}" if i != 3 else None, 0, 1, "k", "v", 2.0, "b") for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, source string, key int, fp int, host string, node string, score double, label string")


def empty(spark):
    return messy(spark).where("false")
