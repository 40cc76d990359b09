"""Small tables with the awkward rows every operator has to stand."""

LONG = " ".join(f"w{i}" for i in range(30_000))
WORDS = [f"word{i}" for i in range(400)]


def prose(start: int, n: int = 60) -> str:
    return " ".join(WORDS[(start * 37 + i * 7 + i * i) % 400] for i in range(n))


def documents(spark, rows, extra: str = ""):
    """(doc_id, text, source) rows, with clashing extra columns if ``extra`` names them."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in extra.split():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


AWKWARD = [
    (0, prose(1), "a"), (1, prose(1), "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "b"), (5, LONG, "a"),
    (6, "one", "é"), (7, "é ü ñ  x", None), (8, prose(2), "a"), (9, prose(2) + " tail", "a"), (10, prose(3), "b"),
]
EMPTY: list = []
