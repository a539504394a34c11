"""The best result of each keyword comes from one pass over the rows."""

from tessera.operators import retrieval


def test_best_per_keyword_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", 1, 0.9), ("a", 2, 0.9), ("b", 3, 0.2), ("c", 4, 0.05), (None, 5, 0.5), ("a", 6, 0.3)]
    scored = spark.createDataFrame(rows, "k string, id long, score double").mapInArrow(score, "k string, id long, score double")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert order(retrieval.best_per_keyword(scored, "k", "id")) == [("a", 1, 0.9, 3), ("b", 3, 0.2, 1), (None, 5, 0.5, 1)]
    assert seen.value == len(rows)
    assert order(retrieval.best_per_keyword(scored, "k", "id", enough=2)) == [("a", 1, 0.9, 2), (None, 5, 0.5, 1)]


def test_overlap_of_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, "one two two three", "two four"), (1, "", ""), (2, None, "x"), (3, "aa bb", "aa bb")], "i int, a string, b string")
    assert [r.s for r in df.select("i", retrieval.lexical_overlap(F.col("a"), F.col("b")).alias("s")).sort("i").collect()] == [0.25, 0.0, None, 1.0]
