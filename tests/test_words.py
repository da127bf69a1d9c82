"""Words found in one pass: the same lines and levels as word by word."""

import random
import re

from logspark import fixed
from logspark.functions.text import any_word, first_match


def test_one_pattern_finds_any_word():
    rng = random.Random(4)
    for _ in range(300):
        words = ["".join(rng.choices(" [AB.", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))]
        found = re.compile(any_word(words))
        for _ in range(40):
            hay = "".join(rng.choices(" [AB.", k=rng.randint(0, 8)))
            assert bool(found.search(hay)) == any(w in hay for w in words), (words, hay)


def test_first_match_equals_word_by_word(spark):
    rng = random.Random(5)
    words = [w.upper() for ws in fixed.SCAN_TOKENS.values() for w in ws]
    lines = ["".join(rng.choice([rng.choice(words), rng.choice(words)[:-1], " A", "[", "É\n", "]"]) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)] + [(-1, None)], "n int, x string")
    ladders = [
        {k: [w.upper() for w in v] for k, v in fixed.SCAN_TOKENS.items()}, {k: list(v) for k, v in fixed.LOOSE_KEYWORDS.items()},
        {"A": ["[x", "[(", "[]", " .*", " \\"], "B": []}, {"A": ["", "[", "[E", "[I", "[D"]}, {"A": []},
    ]
    for ladder in ladders:
        got = {r.n: r.level for r in df.selectExpr("n", f"{first_match(ladder, 'x')} AS level").collect()}
        assert got.pop(-1) is None
        for n, x in enumerate(lines):
            assert got[n] == next((k for k, ws in ladder.items() if any(w in x for w in ws)), None)
