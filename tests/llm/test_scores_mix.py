"""Language ID, toxicity, repetition, fingerprints and the mix against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from jobtide.llm import fingerprint, langid, mixing, queries, repetition, toxicity

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")
    found = queries.op1_language_id(spark, SF2).join(docs, "doc_id").collect()
    assert len(found) == docs.count() and all(r.held_out == (crc(r.doc_id, 3) == 1) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r.lang == r.lang_pred for r in found if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_language_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    model = langid.fit(odd_docs)
    found = langid.identify(odd_docs, model)
    rows = found.collect()
    assert found.columns == [*odd_docs.columns, "lang_pred", "score"] and len(rows) == len(odd_rows)
    assert {(r.lang_pred, r.score) for r in rows if not re.search("[a-z]", r.text or "")} == {("und", 0.0)}
    assert {r.lang_pred for r in rows} == {"xx", "yy", "und"}
    assert langid.fit(no_docs) is None and langid.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, None).collect()} == {"und"}


def test_kernel_counts_shared_n_grams():
    seen, lettered = langid.presence(["ab", "abab", "", "a" * 3000], langid.symbol_table())
    assert lettered.tolist() == [True, True, False, True]
    grams = lambda s: {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    assert seen.sum(axis=1).tolist() == [len(grams(f" {t} ")) for t in ("ab", "abab", "", "a" * 3000)]


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = queries.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out]
    hit = sum(r.predicted and r.toxic for r in held)
    assert hit / sum(r.toxic for r in held) > 0.75 and hit / sum(r.predicted for r in held) > 0.75


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (7, 1), (3, 0), (6, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.with_toxicity(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(odd_docs, labels.limit(0)) is None and toxicity.with_toxicity(no_docs, model).count() == 0
    assert {r.score for r in toxicity.with_toxicity(odd_docs, None).collect()} == {0.0}


def covered(text, n):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    inside = {i + k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(n)}
    return inside, sum(len(w[i]) for i in inside)


def test_repetition_matches_a_loop(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(4)
    docs += [(-k, "\n".join(rng.choice(["a b c d e f g", "x  y", " ", ""]) for _ in range(60))) for k in range(1, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    for r in repetition.with_repetition(frame).select("text", "repetition.*").collect():
        text, w = r.text or "", words(r.text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        repeat = len(covered(text, 3)[0])
        chars = sum(map(len, w))
        want = (len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, repeat)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        base = len(w) < 50 or 100 * repeat > 50 * len(w)
        assert r.base_failed == base and (not base or not r.kept)
        for n in (5, 7, 10):
            assert r[f"covered_{n}"] == pytest.approx(covered(text, n)[1] / max(1, chars))
    assert repetition.with_repetition(no_docs).count() == 0


def test_fingerprints_estimate_generalised_jaccard(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op4_fingerprints(spark, SF).collect()}

    def bag(text):
        w = words(text)
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    errors = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = bag(text), bag(other)
            errors.append(near - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.4


def test_weights_count_in_fingerprints(spark):
    rows = [("a", "p q " * 30), ("b", "p q " * 10), ("c", "p q " * 30)]
    frame = spark.createDataFrame(rows, "k string, t string")
    got = {r.k: r.samples for r in fingerprint.sample_texts(frame, ["k"], F.col("t"), samples=128).collect()}
    near = sum(x == y for x, y in zip(got["a"], got["b"], strict=True)) / 128
    assert got["a"] == got["c"] and abs(near - 16 / 56) < 0.15


def test_pairs_make_shared_values_once(spark, monkeypatch):
    """Both texts of a row get the samples that each has alone; a shingle of both is one term."""
    rng = random.Random(8)
    prose = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)) for n in (60, 90, 7, 4, 0)]
    texts = [*prose, "p q " * 30, prose[0][:150] + " p q" * 9, prose[1] + " " + prose[1], " \n "]
    rows = [(f"{i}-{j}", a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    frame = spark.createDataFrame(rows, "k string, a string, b string")
    alone = {
        t: r.samples
        for t, r in zip(texts, fingerprint.sample_texts(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], F.col("t")).orderBy("k").collect(), strict=True)
    }
    terms, least = [], fingerprint._least
    monkeypatch.setattr(fingerprint, "_least", lambda found, *how: terms.append(found) or least(found, *how))
    found = {r.k: (r.samples, r.others) for r in fingerprint.sample_pairs(frame, ["k"], F.col("a"), F.col("b")).collect()}
    assert found == {k: (alone[a], alone[b]) for k, a, b in rows}
    assert terms[0].where("k = '0-0'").count() == 56 and terms[0].where("k = '0-1'").count() == 56 + 86


def test_fingerprints_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = fingerprint.edited_neighbours(odd_docs).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert len({r.fingerprint for r in found if r.n_chars == 0}) == 1
    assert fingerprint.edited_neighbours(no_docs).count() == 0
    one = fingerprint.edited_neighbours(odd_docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0
    assert fingerprint.fingerprints(odd_docs).count() == len(odd_rows)


def targets(sizes, weights=(5, 2, 1)):
    """Shares by repeated resharing, in the order of the sources, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {**out, **share}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize("options", [{}, {"block_words": 7, "shard_slots": 5}])
def test_mix_meets_its_targets(spark, odd_docs, odd_rows, no_docs, options):
    mixed, slots = mixing.mix(odd_docs, **options)
    rows = mixed.collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, _, source, *_ in odd_rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    # Draws are off by about the root of their number.
    width, shards = options.get("block_words", mixing.BLOCK_WORDS), 1 + slots.agg(F.max("shard")).first()[0]
    assert len(rows) == len(odd_rows) and all(abs(taken[s] - want[s]) <= width * (2 + 3 * shards**0.5) for s in sizes)
    used = collections.Counter()
    for s in slots.collect():
        used[s.source] += s.used
    assert used == {k: v for k, v in taken.items() if v}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs, **options)[0].collect()))
    assert mixing.mix(no_docs)[0].count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_slots_are_spread_over_shards(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 200) as text", "concat('s', id % 3) as source")
    _, slots = mixing.mix(docs, block_words=10, shard_slots=200)
    by = {(r.shard, r.source): r["count"] for r in slots.groupBy("shard", "source").count().collect()}
    assert sum(by.values()) == 6000 and len({s for s, _ in by}) == 30
    assert all(90 < by[s, "s0"] < 160 for s in range(30))


def test_permutations_are_complete(spark):
    for n in (1, 2, 97):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_whole_documents_of_the_mix(spark, odd_docs):
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.where("trim(text) = '' or text is null").count() == 0
