import os

import public_tokenizers

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HAVE_DATA = os.path.isdir(DATA)

#: Null and empty texts, repeats, very long texts, clashing extra columns come on top of these.
LONG = "Lorem ipsum, dolor sit amet; " * 9000


def frame(spark, rows):
    """(doc_id, text[, source]) rows with the columns of documents."""
    return spark.createDataFrame([(i, t, "en", (s or ["a"])[0], None if t is None else len(t)) for i, t, *s in rows], DOCS)


def files(spark, tmp_path, rows):
    """The same, read from Parquet."""
    path = f"file://{tmp_path}/docs.parquet"
    frame(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


EDGE = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "a b c d e f g"), (5, LONG), (6, "x"), (7, "x"), (None, "x"), (8, " \n\t "), (9, "naïve  café über\n\nok")]
