

DOCS = "doc_id long, text string"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def clashing(spark, rows, schema=DOCS):
    """Rows with columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    extra = "n_shingles component_id kept id score _terms _email key word row v d1 a b value lang n_tokens start piece _gone".split()
    return df.select("*", *(F.lit(7).alias(c) for c in extra if c not in df.columns))


EDGE = [(None, None), (None, "some text of a row without an id"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "word " * 30000), (7, "é ü 😀 ñ"), (8, " ")]


