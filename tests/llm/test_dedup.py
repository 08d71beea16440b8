"""SimHash near-dedup and line dedup against plain versions."""

import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from jobtide.llm.components import connected_components
from jobtide.llm.linededup import dedup_lines
from jobtide.llm.queries import op6_line_dedup, op9_simhash_near_dedup
from jobtide.llm.simhash import (
    _component_roots,
    covering_masks,
    drop_near_duplicates,
    near_duplicates,
)
from jobtide.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACE = " \t\n\x0b\x0c\r"


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    return sum(
        1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes)
    )


def components(fps):
    """Index of the first reachable value of each."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(fps))]


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = covering_masks(4), random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(diff & m == 0 for m in masks)


def test_query_matches_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [simhash(t) for _, t in docs]
    want = {(i, f"{fp:016x}", docs[r][0]) for (i, _), fp, r in zip(docs, fps, components(fps), strict=True)}
    got = op9_simhash_near_dedup(spark, SF)
    assert {tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()} == want


@pytest.mark.parametrize("limit", [65536, 20])
def test_large_buckets_lose_no_link(spark, limit):
    """Chains of values around a few centres, most of them in the same buckets."""
    from jobtide.llm import simhash as module

    rng, fps = random.Random(5), []
    for _ in range(3):
        at = rng.getrandbits(64)
        for _ in range(90):
            fps.append(at)
            if rng.random() < 0.7:
                at ^= 1 << rng.randrange(64)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    free = [b for b in range(64) if not covering_masks()[0] >> b & 1]
    fps += [fps[0] ^ sum(1 << b for b in rng.sample(free[:9], rng.randrange(6))) for _ in range(200)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    rows = [(v, module._signed(f & m), s) for f, s in zip(fps, signed, strict=True) for v, m in enumerate(covering_masks())]
    frame = spark.createDataFrame(rows, "v int, key long, fp long").repartition("v", "key")
    found = frame.sortWithinPartitions("v", "key", "fp").mapInArrow(module.bucket_links(4, limit), "a long, b long")
    links = found.where("b is not null")
    large = found.where("b is null").selectExpr("a as fp").distinct()
    if limit < 100:
        assert large.count() > 0
        links = links.union(module._half_radius_links(large, 4))
    roots = {r.node: r.root for r in connected_components(links, Workspace(spark)).collect()}
    mine = defaultdict(set)
    for s in signed:
        mine[roots.get(s, s)].add(s)
    want = defaultdict(set)
    for s, r in zip(signed, components(fps), strict=True):
        want[r].add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_component_roots_of_one_group():
    rng = random.Random(2)
    fps = [rng.getrandbits(64) & 0xFFFF for _ in range(200)]
    assert _component_roots(np.array(fps, np.uint64), 4).tolist() == components(fps)


def test_components_of_long_chains(spark):
    rows = [(i + 1, i) for i in range(300)] + [(1000, 1001), (5, 5)]
    found = connected_components(spark.createDataFrame(rows, "a long, b long"), Workspace(spark))
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_odd_rows_keep_one_of_each_group(spark, odd_docs, odd_rows, no_docs):
    found = near_duplicates(odd_docs).collect()
    assert sum(r.copies for r in found) == len(odd_rows)
    blank = {r.component_id for r in found if r.n_shingles == 0}
    assert blank == {4}
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None and i < 7) == [-3, 1, 4] and len(ids) == len({r.root for r in found})
    assert near_duplicates(no_docs).count() == drop_near_duplicates(no_docs).count() == 0


def plain_lines(rows, least=5):
    keys = [[line.strip(SPACE).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    holders = defaultdict(set)
    for (i, _), own in zip(rows, keys, strict=True):
        for k in own:
            if len(k) >= 40:
                holders[k].add(i)
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, own, strict=True) if not (len(holders[k]) >= least and i != max(holders[k]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (5, 2), (7, 3)])
def test_lines_match_a_loop(spark, rng, batches, fan_out):
    shared = ["This line of text is Shared by many documents, ÉÀ " + str(k) for k in range(6)]
    shared += ["a line that is too short", "\tEdge of the blank characters around a long line \x0b"]
    rows = []
    for i in range(60):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"unique line number {i} {k} " + "z" * 30 for k in range(6)]
        if rng.random() < 0.3:
            lines = [x.upper() if x.isascii() else x for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches, fan_out=fan_out)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == plain_lines(rows)
    assert [r.text for r in got.where("doc_id = 100").collect()] == [None]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = dedup_lines(odd_docs, min_docs=2)
    assert found.columns == [*odd_docs.columns, "n_dropped", "n_lines"] and found.count() == len(odd_rows)
    kept = {(r.doc_id, r.text is None, r.n_dropped) for r in found.collect()}
    assert {(1, False, 1), (2, False, 0), (4, True, 0), (None, True, 0)} <= kept
    assert dedup_lines(no_docs).count() == 0


def test_line_query_digest(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(docs)}
    assert {tuple(r) for r in op6_line_dedup(spark, SF).collect()} == want
