"""Small tables with the awkward rows that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, spans string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", 0, "extra", "extra") for i, t in enumerate(texts)], DOCS)


LONG = "word and more words in a long text " * 20_000
AWKWARD = [None, "", " \n\t ", "a", "é", "same text here", "same text here", LONG, "\U0001f600 ́ x\u0000y"]
