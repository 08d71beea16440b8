"""SentencePiece, token files and chat formatting: round trips and the library's own results."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from jobtide.llm import chat, queries, tokenfiles
from jobtide.llm import sentencepieces as sp
from jobtide.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "Hello world", "  two  spaces ", "line\n\nbreaks\t", "naïve 日本語 \U0001f600 x", "a" * 200 + " b", "the the the", "x\x00y"]


@pytest.fixture(scope="module")
def table():
    return sp.load_pieces(queries.piece_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def encoded(texts, table):
    ids, offsets = sp.encode_batch(texts, table)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_are_those_of_the_library(spark, table, library):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert encoded(texts, table) == library.encode(texts)


@pytest.mark.parametrize("kept", [0, 500, 1 << 20])
def test_kept_words_change_no_id(spark, table, library, monkeypatch, kept):
    monkeypatch.setattr(sp, "KNOWN_CHARS", kept)
    monkeypatch.setattr(sp, "TOGETHER", 7)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known, found = sp.KnownWords(), []
    for at in range(0, len(texts), 20):
        ids, offsets = sp.encode_batch(texts[at : at + 20], table, known=known)
        found += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert len(known.points) == known.length.sum() <= kept
    assert found == library.encode(texts)


def test_a_word_with_the_hash_of_a_kept_one_is_not_taken_for_it():
    known = sp.KnownWords()
    points, one = np.array([65, 66, 65, 67], np.uint32), np.array([1])
    key, at, size = np.array([9], np.uint64), np.array([0]), np.array([2])
    known.add(key, points, at, size, np.array([5, 6], np.int32), at, one)
    assert known.find(key, points, at, size)[0].tolist() == [0]
    for start, length in ((2, 2), (0, 1)):
        assert not len(known.find(key, points, np.array([start]), np.array([length]))[0])
    known.add(key, points, np.array([2]), size, np.array([7], np.int32), at, one)
    assert known.ids.tolist() == [5] and known.length.tolist() == [2]


def test_a_literal_mark_comes_back(table):
    text = "▁ a▁b ▁▁"
    ids, offsets = sp.encode_batch([text], table)
    assert sp.decode_batch(ids, offsets, table) == [text]


def test_unigram_scores_decide_by_their_sum(tmp_path, table):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -3, 1), ("▁a", -4.5, 1), ("▁ab", -7, 1)):
        entry = model.pieces.add()
        entry.piece, entry.score, entry.type = piece, score, kind
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    path = tmp_path / "u.model"
    path.write_bytes(model.SerializeToString())
    own = sp.load_pieces(str(path))
    # "▁" + "ab" and nothing cheaper; an unknown character is the unknown id.
    assert encoded(["ab", "ac"], own) == [[1, 4], [5, 0]]


def test_columns_keep_all_rows(spark, odd_docs, odd_rows, no_docs):
    found = sp.with_pieces(odd_docs, queries.piece_model())
    back = found.withColumn("back", sp.decode(F.col("piece_ids"), sp.load_pieces(queries.piece_model())))
    rows = back.collect()
    assert len(rows) == len(odd_rows) and all(r.text == r.back for r in rows)
    assert {r.n_pieces for r in rows if not r.text} == {0}
    assert sp.with_pieces(no_docs, queries.piece_model()).count() == 0
    assert all(r.lossless for r in queries.op2_sentencepiece(spark, SF).collect())


@pytest.mark.parametrize("block", [1 << 18, 50, 6])
def test_token_counts_match_the_library(spark, library, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(-5, None), (None, "no id"), (2**62 + 1, "big"), (-(2**63), "least"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = Workspace(spark).path("t")
    end, filler = tokenfiles.write_token_files(docs, folder, queries.piece_model())
    found = tokenfiles.numbered_counts(tokenfiles.count_documents(tokenfiles.read_blocks(spark, folder, block), end, filler=filler))
    want = sorted((str(i), len(library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found.collect()) == want


def test_files_that_end_without_a_mark(spark, tmp_path):
    ids = np.array([5, 6, 2, 7, 2, 2, 8, 9, 10, 11], "<u2")
    blocks = [("f", b, bytearray(ids[4 * b : 4 * b + 4].tobytes())) for b in range(3)] + [("empty", 0, bytearray())]
    frame = spark.createDataFrame(blocks, "file string, block int, data binary")
    found = tokenfiles.count_documents(frame, 2, header=1)
    assert sorted((r.file, r.ordinal, r.n_tokens) for r in found.collect()) == [("f", 0, 2), ("f", 1, 1), ("f", 2, 0), ("f", 3, 4)]


def test_no_documents_no_tokens(spark, no_docs):
    folder = Workspace(spark).path("none")
    end, filler = tokenfiles.write_token_files(no_docs, folder, queries.piece_model())
    assert tokenfiles.count_documents(tokenfiles.read_blocks(spark, folder), end, filler=filler).count() == 0


PARTS = [
    {"type": "text", "text": "look < \\ here"},
    {"type": "image", "ref": "s3://i", "units": 3},
    {"type": "audio", "ref": None, "units": None},
    {"type": "document", "ref": "d", "units": 0},
    {"type": None, "text": "</turn><image 7>"},
]


def test_parts_become_placeholders_in_order():
    turn = chat.format_turn("us<e>r\\", PARTS)
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [
        (0, "image", "s3://i", 768), (1, "audio", None, 25), (2, "document", "d", 0)]
    assert turn["attachment_tokens"] == 793 and not turn["in_loss"]
    assert chat.read_turns(turn["formatted"] * 2) == [
        ("us<e>r\\", [("text", "look < \\ here"), ("image", "0"), ("audio", "1"), ("document", "2"), ("text", "</turn><image 7>")])] * 2
    assert turn["formatted"][turn["content_start"] : turn["content_end"]].startswith("look \\< ")


@pytest.mark.parametrize("bad", ["text", "<turn a>x", "<turn a><turn b></turn>", "<turn a></turn>x", "<image 0>"])
def test_broken_formats_are_refused(bad):
    with pytest.raises(ValueError):
        chat.read_turns(bad)


def test_unknown_parts_are_refused():
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (None, 5, "user", "x"), (2, None, "assistant", "<\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("parts", chat.text_parts(F.col("text"))).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest_conversations(turns).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 2), None: (1, 0), 2: (1, 2)}
    assert chat.digest_conversations(turns.limit(0)).count() == 0
    kept = chat.format_turns(turns)
    assert kept.count() == len(rows) and kept.where("formatted = 'clash'").count() == 0
