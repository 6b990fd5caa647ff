"""Fixtures of the text operators' tests."""

import random

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents, with an extra column of each name that operators use inside."""
    extra = ["id", "th", "key", "ctx", "c", "n", "h", "spans", "kept", "line_no", "_x"]

    def make(rows, source="s"):
        full = [(i, t, "en", source if not isinstance(source, list) else source[k], len(t or ""), *[None] * len(extra)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} int" for x in extra))

    return make


@pytest.fixture(scope="session")
def tricky():
    """Empty, blank, short, long, periodic and repeated texts; passages shared inside others; copies with changes."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 8)))
    prose = lambda n: " ".join(word() + (".\n" if r.random() < 0.1 else "") for _ in range(n))
    passage, other = prose(120), prose(60)
    base = prose(300)
    changed = base.split(" ")
    changed[150] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", "a b c", "x" * 1500, "ab" * 900, "x" * 400, "x" * 399, base, base, " ".join(changed), prose(4000),
             prose(50) + passage + prose(40), prose(10) + passage, passage + prose(5), other + " " + passage, other, other + " " + other,
             "same " * 200, "same  same\tsame " * 30, "A b C d E", "a B c D e", "<|endoftext|> A,b. C", "İstanbul ΟΔΟΣ ǅ é don't 12,5.", prose(30) + "\r\n" + base[:900]]
    return list(enumerate(texts))
