"""A small table with everything that may go wrong in it, and plain helpers for brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, score string, shard string,"
    " size string, copies string, hits string, language string, _language int, _hits int, row_hash string, counts map<string,int>, node int, id int, bytes int"
)
WORDS = [f"w{i:02d}" for i in range(60)]
LONG = " ".join(f"long{i % 977}x{i}" for i in range(60_000))


def base_rows() -> list[tuple]:
    story = " ".join(WORDS)
    near = " ".join(WORDS[:-1] + ["other"])
    texts = [
        (1, story), (2, near), (3, story.upper()), (3, story.upper()), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (9, "ONE two"),
        (None, story), (None, None), (10, LONG), (11, LONG + " tail"), (12, "ünïcödé ß 日本語 text"), (13, "a|b # $ % !!\nline\nline\n"), (13, "second text of the id"),
        (14, "0 1 2 3 4 5 6 7 8 9"), (15, "\x0b\x0c\x1c odd\x00 bytes  "), (16, "one one one one one one"),
    ]
    langs, sources = ["en", None, "de"], ["s1", None, "s2", "S3"]
    return [(i, t, langs[n % 3], sources[n % 4], None if t is None else len(t)) for n, (i, t) in enumerate(texts)]


def odd_docs(spark: SparkSession) -> DataFrame:
    rows = [(*r, "x", None, "y", "z", "1", None, "h", "l", 1, None, "q", {"a": 1}, 3, 4, 5) for r in base_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text: str | None) -> list[str]:
    words, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return words


def ranked(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
