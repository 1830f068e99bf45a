import re
from collections import Counter

import corpus_pipeline
from loomery.llm.quality_rules import quality_rules

from tests.llm.fixtures import documents, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    got = quality_rules(documents(spark, extra=True)).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(rows())
    for r in got:
        assert tuple(r)[2:] == brute(r["text"]), r["doc_id"]


def test_many_repeated_windows(spark):
    text = " ".join(f"w{i % 400} x{i % 397}" for i in range(4000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules(df).first()["n_repeat_words"] == brute(text)[4]


def test_verdicts_and_removed_lines(spark):
    good = prose(9, 120)
    nav = "\n".join(["Home | News | About | Contact |"] * 3)
    cases = [(1, good), (2, good + "\n" + nav), (3, nav * 20), (4, "\n".join(x + "###$$$***" * 3 for x in good.split("\n"))), (5, good + "\nAll rights reserved."), (6, "Few words here.")]
    got = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, True, False, False, True, False]
    assert got[2]["clean_text"] == good and got[5]["clean_text"] == good and got[1]["lost_chars"] == 0
    assert got[6]["base_failed"]


def test_phrases_in_long_lines(spark):
    """The pipeline's rules: a paragraph that mentions a phrase stays, a line that is one goes."""
    long = prose(10, 120).replace("\n", " ") + " Our privacy policy is new."
    cases = [(1, long), (2, prose(11, 60) + "\n" + long + "\nAll rights reserved, see our privacy policy."), (3, "Click here. " * 60)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in cases], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert got == {1: long, 2: prose(11, 60) + "\n" + long}


def test_empty_table(spark):
    assert quality_rules(documents(spark, empty=True)).count() == 0
