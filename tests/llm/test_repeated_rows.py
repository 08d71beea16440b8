"""Rows that agree in everything stay as many rows in the mix."""

from collections import Counter

from jobtide.llm import mixing


def test_repeated_rows_without_words_stay(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", "t")]
    rows += [(3, "", "s")] * 3 + [(4, None, "t")] * 2 + [(None, " \t", None)] * 4 + [(None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for options in ({}, {"block_words": 2, "shard_slots": 3}):
        mixed = mixing.mix(docs, **options)[0]
        found = [(r.id, r.source, r["size"]) for r in mixed.collect()]
        assert Counter(found) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
        assert {r.taken for r in mixed.where("size = 0").collect()} == {0}
