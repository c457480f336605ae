"""Tables of awkward rows that every operator has to take."""

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, _k string, _row int, shard string, _spans string, label string"


def table(spark, texts, start=0):
    """Rows (doc_id, text); the other columns are null or have names that operators use inside."""
    rows = [(i if isinstance(i, int) or i is None else None, t, "en", None, None if t is None else len(t), "x", 1, "s", None, "l") for i, t in (enumerate(texts, start) if not texts or not isinstance(texts[0], tuple) else texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}é" if r.random() < 0.1 else f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, short, long, odd white space, NULs, wide characters, repeats, near copies, shared passages."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[60] = "changed"
    return [
        None, "", "   \n\t ", "one", "two words", base, base, " ".join(edited), base.upper(),
        prose(3, 40) + " " + passage + "\n" + prose(4, 40), passage, prose(5, 30) + "\n" + passage, "a\x00b \x00\x00 c" * 30,
        "日本語のテキスト　です 🙂 " * 20, "x " * 3000, prose(6, 6000), "line\nline\nother\n\nline", passage + " " + passage, "é" * 150 + "y" * 120 + "é" * 150,
        "The MIT License. Licensed under CC BY-SA 4.0, or the Apache License", "cc by cc by\tcc-by", "tail \x85 \xa0 \x1c end <|endoftext|>  ",
    ]
