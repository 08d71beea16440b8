"""Lexical search, exact top-k and the filter audit against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from jobtide.llm import interactions, lexical, maxscore, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(items, docs, k=10):
    """``item_id, rank, doc_id, score`` by scoring every pair."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in held:
            m = n_docs and 10 + 90 * sum(c.values()) * n_docs // max(1, n_all)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in own & c.keys()
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, no_id, i) in enumerate(sorted(scored)[:k], 1):
            out.append((str(item), rank, None if no_id else i, -score))
    return sorted(out, key=str)


def ranking(found):
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def test_search_of_odd_rows(spark, odd_docs, odd_rows, no_docs, rng):
    items = [(1, "ALPHA3 beta7! gamma"), (1, "short"), (2, None), (3, " .,"), (None, "mark ends"), (4, "x" * 5000), (5, "Ünïcode alpha1"), (4, "nul")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, rank string")
    docs = [(r[0], r[1]) for r in odd_rows]
    for blocks in ({}, {"block_terms": 4}):
        assert ranking(lexical.ranked_search(frame, odd_docs, **blocks)) == plain_ranking(items, docs)
    assert lexical.ranked_search(frame, no_docs).count() == lexical.ranked_search(frame.limit(0), odd_docs).count() == 0
    assert lexical.ranked_search(frame, odd_docs).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_over_many_trees_and_ties(spark, rng, monkeypatch):
    """Copies, hot terms and several topics; trees and leaves are much smaller than the table."""
    monkeypatch.setattr(lexical, "TREE_CELLS", 1 << 12)
    topics = [[f"{t}{k}" for k in range(60)] for t in "abcd"]
    docs = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(rng.randrange(1, 60)))) for i in range(900)]
    docs += [(10_000 + i, docs[7][1]) for i in range(300)] + [(50_000 + i, "a0 " * (i % 5)) for i in range(200)]
    items = [(k, " ".join(rng.choice(topics[k % 4]) for _ in range(12))) for k in range(40)] + [(99, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = lexical.ranked_search(spark.createDataFrame(items, "item_id long, text string"), frame)
    assert ranking(found) == plain_ranking(items, docs)


def _trees(rng, n_docs, n_items, words):
    ids = np.arange(n_docs)
    topic = [rng.randrange(4) for _ in range(n_docs)]
    held = [sorted({t * words + rng.randrange(words) for _ in range(20)}) for t in topic]
    row, term = np.repeat(ids, [len(h) for h in held]), np.concatenate(held)
    impact = np.array([rng.randrange(1, 10**6) for _ in term], np.int64)
    asked = [np.array(sorted({k % 4 * words + rng.randrange(words) for _ in range(10)})) for k in range(n_items)]
    weights = np.array([rng.randrange(1, 9000) for _ in range(4 * words)], np.int64)
    items = lexical.item_tree(list(range(n_items)), asked, weights)
    return items, (ids, np.zeros(n_docs, bool), row, term, impact), asked, weights


def test_node_bounds_leave_whole_batches_out():
    rng = random.Random(6)
    items, docs, asked, weights = _trees(rng, 2000, 64, 50)
    best = lexical.Ranking(items, 5)
    best.search(lexical.doc_tree(*docs, items))
    matrix = np.zeros((2000, len(weights)), np.int64)
    matrix[docs[2], docs[3]] = docs[4]
    for at, item in enumerate(items.ids):
        scores = matrix[:, asked[item]] @ weights[asked[item]]
        assert best.hits[at][0].tolist() == sorted(scores.tolist(), reverse=True)[:5]
    # Three of four topics have no term of an item: their batches must not be scored.
    assert best.compared < 0.5 * 2000 * 64


def test_bounds_of_a_node_hold_for_all_below():
    items, docs, _, weights = _trees(random.Random(8), 300, 20, 30)
    tree = lexical.doc_tree(*docs, items)
    for level, nodes in enumerate(items.levels):
        for depth, maxima in enumerate(tree.maxima):
            for node, (columns, greatest) in enumerate(nodes):
                bounds = maxima[:, columns].astype(float) @ greatest
                width = lexical.FAN**level
                for leaf in range(node * width, min((node + 1) * width, len(items.leaves))):
                    own, matrix = items.leaves[leaf]
                    scores = (matrix @ tree.impact[:, own].T.astype(float)).max(axis=0)
                    span = lexical.LEAF_DOCS * lexical.FAN**depth
                    tops = [scores[a : a + span].max() for a in range(0, len(scores), span)]
                    assert all(b >= t for b, t in zip(bounds, tops, strict=True))


def test_terms_of_long_texts_are_not_cut(monkeypatch):
    monkeypatch.setattr(lexical, "SCAN_CHARS", 10)
    names, table = lexical.term_table(["abc", "é1", "abcdefghijklmnop"])
    text = "ABC, abc abcdefghijklmnop\n é1é1 é1 " * 9
    total, row, term, count = lexical.count_terms(["", text, "abc"], table)
    assert total.tolist() == [0, 45, 1]
    got = {(int(r), names[t]): int(c) for r, t, c in zip(row, term, count, strict=True)}
    assert got == {(1, "abc"): 18, (1, "abcdefghijklmnop"): 9, (1, "é1"): 9, (2, "abc"): 1}


def plain_products(rows, k=5, every=50):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in kept:
        if i is not None and i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, own in asked.items():
        scored = [(-sum(a * b for a, b in zip(own, v, strict=True)), i is None, i or 0) for i, v in kept if len(v) == len(own) and i != q]
        out += [(q, r, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def products(found):
    return sorted((tuple(r) for r in found.collect()), key=str)


VECTORS = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("shard,cells", [(4096, 1 << 20), (16, 40)])
def test_products_match_a_loop(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.2), 4) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(50, rows[9][1]), (50, rows[9][1]), (None, rows[50][1]), (None, rows[3][1])]
    rows += [(600, None), (650, [1.0, None]), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (800, []), (850, []), (900, [0.5, 0.25]), (7, [1.0, -1.0])]
    rows += [(950, [3e30] * 3), (951, [-3e30] * 3), (952, [1e9] * 3)]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS).repartition(3)
    found = maxscore.top_products(frame, F.col("vec_id") % 50 == 0, block_cells=cells)
    small = [r for r in rows if r[0] is None or not 950 <= r[0] <= 952]
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert [r for r in products(found) if r[0] != 950] == plain_products(small)
    # Beyond 64 bits components and scores stay at the end of the range.
    top = 2**63 - 1
    assert [r for r in products(found) if r[0] == 950] == [(950, 1, 952, top), (950, 2, 951, -top - 1)]
    assert maxscore.top_products(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert maxscore.top_products(frame, F.col("vec_id") < 0).count() == 0


def test_non_essential_terms_are_probed_for_few():
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((20_000, 32)) * 40).astype(np.int64)
    query = np.rint(rng.standard_normal(32) * 40 * (np.arange(32) < 10)) + 1
    best = maxscore.Best(-1, query, 5)
    for at in range(0, 20_000, 1000):
        best.search(maxscore.Shard(np.arange(at, at + 1000), np.zeros(1000, bool), vectors[at : at + 1000].astype(float)))
    scores = vectors @ query.astype(np.int64)
    order = np.lexsort((np.arange(20_000), -scores))[:5]
    assert best.ids.tolist() == order.tolist() and best.scores == scores[order].tolist()
    assert best.probed < 0.2 * 20_000 * 32 / maxscore.STEP_TERMS


def plain_audit(rows, labels):
    firsts, marks = {}, []
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": (i > firsts[t]) if i is not None else t in firsts,
        }
        marks.append((part or "", {f for f, bad in fails.items() if bad}, *labels.get(i, (False, False))))
    out, shapley = {}, Counter()
    for part in {m[0] for m in marks}:
        own = [m for m in marks if m[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [m for m in own if f in m[1] and not m[1] & set(order[: step - 1])]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    sum(not m[1] & set(order[:step]) for m in own),
                    len(gone),
                    sum(f in m[1] for m in own) - len(gone),
                    sum(m[1] == {f} for m in own),
                    sum(m[2] for m in gone),
                    sum(m[3] for m in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(counts):
    rows = interactions.order_report(counts).collect()
    assert len({r[:3] for r in rows}) == len(rows)
    return {tuple(r[:3]): tuple(r[3:]) for r in rows}


def test_audit_matches_a_loop(spark, odd_rows, no_docs, rng, monkeypatch):
    monkeypatch.setattr(interactions, "HELD_PARTS", 2)
    rows = [(i, t, s) for i, t, _, s, *_ in odd_rows]
    for i in range(300, 420):
        text = " ".join(rng.choice(["alpha", "Beta", "x$", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([10, 250, 400])))
        rows.append((i, text if i % 3 else "COPY of a text", rng.choice(["a", "b", None, ""])))
    rows += [rows[40]] * 3 + [(None, "COPY of a text", "a")] * 2
    labels = [(i, i % 2, i % 5 == 0) for i in range(300, 400)] + [(301, 0, 0), (301, None, 1), (None, 1, 1), (2, 1, None)]
    known = defaultdict(lambda: [False, False])
    for i, good, toxic in labels:
        if i is not None:
            known[i][0] |= good == 1
            known[i][1] |= bool(toxic)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, part string")
    frame = spark.createDataFrame([(i, g, int(t) if t is not None else None) for i, g, t in labels], "doc_id long, quality int, toxic int")
    assert audit(interactions.survivors(docs, frame)) == plain_audit(rows, {k: tuple(v) for k, v in known.items()})
    assert interactions.order_report(interactions.survivors(no_docs, frame)).count() == 0
    empty = audit(interactions.survivors(docs, frame.limit(0)))
    assert {k: v[:4] for k, v in empty.items()} == {k: v[:4] for k, v in plain_audit(rows, {}).items()}


def test_carry_save_counts_every_position():
    rng = np.random.default_rng(4)
    counts, want = interactions.PositionCounts(), np.zeros(32, np.int64)
    for n in (0, 1, 2, 3, 1000, 5):
        own, times = rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(1, 1 << 40, n)
        counts.add_times(own, times)
        want += (((own[:, None] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64) * times[:, None]).sum(axis=0)
        assert counts.totals().tolist() == want.tolist()
    assert max(map(len, counts.levels)) <= 2


def test_every_part_has_all_orders(spark):
    rows = queries.op13_filter_audit(spark, SF)
    parts = spark.read.parquet(f"{SF}/documents.parquet").select("source").distinct().count()
    assert rows.count() == parts * 600 and rows.select("filter_order").distinct().count() == 120
