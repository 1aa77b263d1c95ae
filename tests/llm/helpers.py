"""Rows with the odd cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, label int"
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(6000))


def odd_docs(spark):
    """Null ids, texts and sources, empty and long texts, repeated rows, equal ids, columns with names that clash."""
    base = "the quick brown fox jumps over the lazy dog near the river bank while it rains " * 8
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, "   \n\t ", "fr", "b"),
        (6, LONG, "en", "a"), (6, LONG, "en", "a"), (None, base + " and more words follow here", "en", None), (7, "one", "en", "é"),
        (7, "another text with the same id", "en", "é"), (8, "日本語 😀 text\x00 with é", "ja", "z"), (None, None, None, None), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), -1, 9) for r in rows], DOCS)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
