"""The pipeline's stages, each held against a plain version of what it decides on its own input."""

import importlib.util
import re

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline here", allow_module_level=True)

import corpus_pipeline  # noqa: E402
import sentencepiece  # noqa: E402
from llm.test_dedup import components, plain_lines, simhash  # noqa: E402

from jobtide.llm.queries import piece_model  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        seen.append((docs, spark.read.parquet(f"{tmp_path}/{k}")))
        docs = seen[-1][1]
    rows = lambda frame: sorted((r.doc_id, r.text) for r in frame.collect())
    assert all(after.columns == COLUMNS for _, after in seen[:-1])
    before, after = map(rows, seen[0])
    assert {t for i, t in before} - {t for i, t in after} <= {t for _, t in before if not re.search("[a-zA-Z]", t or "")}
    before, after = map(rows, seen[1])
    assert after == sorted((i, t) for i, _, n, t in plain_lines(before) if t or not n)
    before, after = map(rows, seen[2])
    root = components([simhash(t) for _, t in before])
    assert after == [before[k] for k in sorted(set(root))]
    before, after = map(rows, seen[3])
    assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    assert all(r.piece_ids == library.encode(r.text) for r in seen[4][1].collect() if "▁" not in r.text)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, SF).collect()) == rows(seen[4][1].select("doc_id", "text"))


def test_stages_of_odd_and_no_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            assert docs.columns[: len(columns)] == columns
        assert (docs.count() > 0) == (name == "odd")
