"""The limits of the repetition rules decide on documents that the base rule passes."""

import random

from jobtide.llm import repetition


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_repeated_passages_decide(spark):
    rng = random.Random(11)
    passage = prose(rng, 10)
    parts = [prose(rng, 10) for _ in range(30)]
    for k in range(0, 30, 3):
        parts.insert(k * 4 // 3, passage)
    repeated = " ".join(w for part in parts for w in part)
    lined = "\n".join([" ".join(prose(rng, 12)) for _ in range(7)] + ["the same line of words here again"] * 5)
    clean = [" ".join(prose(rng, n)) for n in (60, 400, 6000)]
    # A refrain of six words is no repetition to speak of in 400 words.
    clean.append(clean[1] + " one refrain of six words here " + clean[0] + " one refrain of six words here")
    frame = spark.createDataFrame(list(enumerate([repeated, lined, *clean])), "k int, text string")
    rows = {r.k: r.repetition for r in repetition.with_repetition(frame).collect()}
    assert 0.2 < rows[0].covered_10 < 0.3 and not any(rows[k].base_failed for k in rows)
    assert [rows[k].kept for k in sorted(rows)] == [False, False, True, True, True, True]
