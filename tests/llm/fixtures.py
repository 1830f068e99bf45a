"""A small table of documents with every odd case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(n)]
    lines = [" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12)]
    return "\n".join(lines)


def rows() -> list[tuple]:
    base = prose(1, 120)
    out = [
        (1, base, "en", "a", 0),
        (2, base, "en", "a", 0),  # an exact copy
        (3, base.replace("\n", "  \n"), "en", "b", 0),  # equal without white space, and longer
        (4, base.replace(base.split()[60], "changedword", 1), "en", "b", 0),  # a near copy
        (5, prose(2, 200), "de", None, None),
        (6, prose(2, 200), "de", None, None),
        (6, prose(2, 200), "de", None, None),  # a repeated row
        (7, None, None, None, None),
        (8, "", "fr", "c", 0),
        (9, " \n\t ", "fr", "c", 0),
        (10, "one two three", "fr", "c", 0),
        (11, prose(3, 30_000), "en", "a", 0),  # a very long text
        (12, "spam " * 300, "en", "a", 0),
        (13, "\n".join(f"Home | News | Item {i} | Contact |" for i in range(40)), "en", "d", 0),
        (None, prose(4, 80), "en", "a", 0),
        (14, prose(5, 90), "es", "aé", 0),
        (15, "naïve 漢字 \U0001f600 " + prose(6, 70), "es", "z", 0),
    ]
    return out


def documents(spark, extra: bool = False, empty: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([] if empty else rows(), SCHEMA).repartition(3)
    if extra:  # names that operators use themselves
        for name in ("size", "kept", "shard", "slot", "piece", "ids", "epochs", "target", "n_words", "clean_text", "score", "lang_pred", "digest", "id", "text_", "key_", "rank_", "place_", "filter_bit", "filter_row", "filter_words", "gone", "n_entities", "start", "at", "at_", "start_", "to_shard_", "whole", "whole_", "cut", "cut_", "p_source", "plan_source_", "row", "key", "h", "n", "k", "of", "offset", "sequence_id"):
            df = df.withColumn(name, F.lit("x"))
    return df
