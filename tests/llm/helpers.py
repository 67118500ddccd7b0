"""Small tables for the tests: every awkward case the operators must define."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Columns whose names an operator might use for itself.
CLASHING = ["size", "kept", "row_id", "spans", "h", "target", "component_id", "words", "run", "next_text"]


def documents(spark, rows, extra=()):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("x"))
    return df


def prose(seed, n, size=400):
    import random

    random.seed(seed)
    stock = ["".join(random.choices("abcdefghiklmnoprstuvw", k=random.randint(2, 9))) for _ in range(size)]
    return " ".join(random.choices(stock, k=n))
