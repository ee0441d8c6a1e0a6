"""Small tables with the cases that every operator has to stand."""

from pathlib import Path

ODD = [
    (0, None, None, None, None, 1),
    (1, "", "en", "src0", 0, 2),
    (2, "one", "en", "src0", 3, 3),
    (3, "a b c d e f g h. i j k l m n o p", "en", "src1", 9, 4),
    (4, "a b c d e f g h. i j k l m n o p", "en", "src1", 9, 4),
    (4, "a b c d e f g h. i j k l m n o p", "en", "src1", 9, 4),
    (5, "x " * 30000 + "\nlast line of a very long text", "de", "src2", 9, 5),
    (6, "\n\n \t\n", "fr", "", 4, 6),
    (7, "İstanbul ſecret: ABCDEFG <|endoftext|> token='abc123xyz' 　 wide\x0bspace", "es", "src3", 9, 7),
    (None, "no id here", None, "src3", 9, 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int"


def odd_documents(spark, empty=False):
    """Nulls, empty and long texts, ties, repeated rows, and an extra column whose name clashes."""
    return spark.createDataFrame([] if empty else ODD, SCHEMA)


def saved(df, folder: Path, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
