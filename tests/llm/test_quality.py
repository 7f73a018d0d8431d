"""Quality rules: features against plain Python, verdicts and edge cases."""

import random
import re

from climo.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words string"


def plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_features_equal_plain_python():
    rng = random.Random(3)
    for _ in range(150):
        parts = [rng.choice(["the", "a", "b", "É中", "x#", "\U0001f600", "\xa0y", "||"]) + rng.choice([" ", "\n", "\t", "\x0b", "  "])
                 for _ in range(rng.choice([0, 1, 8, 9, 30, 120]))]
        text = "".join(parts)
        got = quality.text_features(text)
        assert got[:5] == plain(text)
        assert abs(sum(got[5]) - bool(text)) < 1e-9 and abs(sum(got[6]) - bool(got[0])) < 1e-9


def prose(rng, n):
    return " ".join(rng.choice(quality.COMMON_WORDS["en"] + [f"word{c}" for c in "abcdefghijklmnop"]) for _ in range(n)) + "."


def test_verdicts(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 150), "en", "s", "x") for i in range(60)]
    rows += [(100, prose(rng, 150).upper().replace(" ", "!! "), "en", "s", "x"),
             (101, " ".join(w + "%%%" for w in prose(rng, 120).split()), "en", "s", "x"),
             (102, " | ".join(f"zq{rng.random()}" for _ in range(100)), "en", "s", "x"),
             (103, "ab cd " * 100, "en", "s", "x"), (104, "too short", "en", "s", "x"),
             (105, None, "en", "s", "x"), (106, "", None, None, None), (107, prose(rng, 30), "rare", "s", "x"),
             (None, prose(rng, 150), "en", "s", "x"), (5, prose(rng, 150), "en", "s", "x"), (5, prose(rng, 150), "en", "s", "x"),
             (108, "the a " + "x" * 200_000, "en", "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.kept) for r in quality.score_documents(docs).collect()]
    assert len(got) == len(rows)
    assert all(kept for d, kept in got if d is None or d < 60 or d == 107)
    assert not any(kept for d, kept in got if d in (100, 101, 102, 103, 104, 105, 106, 108))
    assert quality.score_documents(docs.limit(0)).count() == 0
