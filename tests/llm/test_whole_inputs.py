"""No script, length, file or draw is left out: plain versions of what the operators decide."""

import collections
import math
import random
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from jobtide.llm import chat, langid, linededup, mixing, queries, tokenfiles, toxicity
from jobtide.llm import fingerprint as fp
from jobtide.llm import sentencepieces as sp
from jobtide.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
SCRIPTS = {
    "en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω",
    "he": "אבגדהוזחטיכלמנסעפצקרשת", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hi": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभम",
    "hy": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "ka": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
    "th": "กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ", "ko": "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허",
    "ja": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほ", "zh": "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出",
}


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_twelve_scripts_are_told_apart(spark):
    rng = random.Random(12)
    rows = [(prose(rng, a, 60), lang) for lang, a in SCRIPTS.items() for _ in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    new = [(prose(rng, a, 60), lang) for lang, a in SCRIPTS.items() for _ in range(20)]
    found = langid.identify(spark.createDataFrame(new, "text string, lang string"), model).collect()
    right = collections.Counter(r.lang for r in found if r.lang_pred == r.lang)
    assert min(right[lang] for lang in SCRIPTS) >= 0.97 * 20


def test_scores_are_those_of_kernel_ridge_regression(spark):
    """With all texts as landmarks the feature map is exact, so scores are (K + cI)^-1 applied to the labels."""
    rng = random.Random(2)
    rows = [(prose(rng, a, 12), lang) for lang, a in (("x", "abcdefgh"), ("y", "efghijkl"), ("z", "ijklmnop")) for _ in range(10)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), n_landmarks=30, ridge=0.01)

    def grams(text):
        padded = "".join(c if c.isalpha() else "\0" for c in f" {text.lower()} ")
        return {padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)}

    def kernel(a, b):
        return np.array([[len(s & t) / math.sqrt(len(s) * len(t)) for t in b] for s in a])

    train, new = [grams(t) for t, _ in rows], [prose(rng, "cdefghijkl", 15) for _ in range(5)]
    k = kernel(train, train)
    centre = np.eye(30) - 1 / 30
    target = np.array([[float(lang == c) for c in "xyz"] for _, lang in rows])
    dual = np.linalg.solve(centre @ k @ centre + 0.01 * 30 * np.eye(30), centre @ target)
    across = kernel([grams(t) for t in new], train)
    want = target.mean(axis=0) + (across - k.mean(axis=0)) @ centre @ dual
    got = langid.kernel(langid.presence(new, model.symbols)[0], model) @ model.weights + model.bias
    assert np.abs(got - want).max() < 0.02


def test_words_of_long_texts_are_learned(spark):
    """Half of the toxic texts have their word only in long texts."""
    rng = random.Random(3)
    filler = lambda n: prose(rng, "aeioulmnrst", n)
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        long = i % 2 == 0
        words = filler(5000 if long else 40).split()
        if toxic:
            for _ in range(len(words) // 20):
                words[rng.randrange(len(words))] = "zwykqw" if long else "vjxqqp"
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    new = [(0, filler(20) + " zwykqw"), (1, filler(20) + " vjxqqp"), (2, filler(20)), (3, filler(4000) + " zwykqw" * 300)]
    found = toxicity.with_toxicity(spark.createDataFrame(new, "doc_id long, text string"), model).collect()
    assert [r.predicted for r in sorted(found)] == [1, 1, 0, 1]


def plain_kneser_ney(counts):
    """p(symbol | context) of every gram by the definition, over tuples; ``counts`` are those of each class."""
    def discount(c):
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.9, max(0.1, n1 / max(1, n1 + 2 * n2)))

    grams = set(counts[0]) | set(counts[1])
    levels = [grams]
    for _ in range(4):
        levels.append({g[1:] for g in levels[-1]})

    def shared(gram):
        above = levels[5 - len(gram) - 1]
        cont = collections.Counter(g[1:] for g in above)
        if len(gram) == 1:
            return (cont[gram] + 0.5) / (sum(cont.values()) + 32)
        own = {g: n for g, n in cont.items() if g[:-1] == gram[:-1]}
        if not own:
            return shared(gram[1:])
        d, total = discount(cont), sum(own.values())
        return max(cont[gram] - d, 0) / total + d * len(own) / total * shared(gram[1:])

    def p(c, gram):
        own = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return shared(gram[1:])
        d, total = discount(c), sum(own.values())
        return max(c.get(gram, 0) - d, 0) / total + d * len(own) / total * shared(gram[1:])

    return {g: math.log(p(counts[1], g)) - math.log(p(counts[0], g)) for g in grams}


def test_evidence_is_that_of_kneser_ney():
    rng = random.Random(8)
    counts = []
    for letters in ("abcd", "bcde"):
        c = collections.Counter()
        for _ in range(40):
            word = [0, 0, 0, 0] + [ord(rng.choice(letters)) - 96 for _ in range(rng.randrange(1, 6))] + [63]
            c.update(tuple(word[i : i + 5]) for i in range(len(word) - 4))
        counts.append(c)
    code = lambda g: sum(s << (6 * (4 - k)) for k, s in enumerate(g))
    arrays = [tuple(np.array(x) for x in zip(*sorted((code(g), float(n)) for g, n in c.items()), strict=True)) for c in counts]
    grams, evidence, _, _ = toxicity.language_models([(k.astype(np.int64), n) for k, n in arrays])
    want = plain_kneser_ney(counts)
    assert dict(zip(grams.tolist(), evidence, strict=True)) == pytest.approx({code(g): e for g, e in want.items()})


def test_counts_grow_with_all_labelled_texts(spark):
    rows = [(i, f"word{i % 7} text", i % 2) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    few, many = (toxicity.fit(docs, docs.select("doc_id", "toxic"), max_train=n) for n in (20, 10_000))
    assert np.array_equal(few.grams, many.grams) and np.array_equal(few.gram_evidence, many.gram_evidence)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.mark.parametrize("chunk,block", [(1 << 18, 1 << 18), (7, 6), (64, 50)])
def test_streams_go_on_over_files(spark, library, chunk, block):
    rng = random.Random(chunk)
    rows = [(i, prose(rng, "abcdefgh", rng.choice([0, 1, 3, 400]))) for i in range(60)] + [(None, "none"), (7, "again"), (7, "again"), (8, None)]
    docs = spark.createDataFrame([(i, t, "f", 1, "h") for i, t in rows], "doc_id long, text string, file string, block int, head string")
    folder = Workspace(spark).path("streams")
    end, filler = tokenfiles.write_token_files(docs.repartition(2), folder, queries.piece_model(), chunk_tokens=chunk, file_chunks=3)
    blocks = tokenfiles.read_blocks(spark, folder, block)
    if chunk < 100:
        assert blocks.agg(F.max("block")).first()[0] >> 32 > 5
    found = tokenfiles.numbered_counts(tokenfiles.count_documents(blocks, end, filler=filler))
    want = sorted((str(i), len(library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in found.collect()) == want


def test_token_counts_of_the_registered_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((r.doc_id, len(library.encode(r.text or ""))) for r in docs)
    assert sorted(tuple(r) for r in queries.op3_token_counts(spark, SF).collect()) == want


def test_keys_are_in_one_run_and_batches_add_to_it(spark):
    space = Workspace(spark)
    store = linededup.LineRuns(space, fan_out=3)
    rng, seen = random.Random(1), collections.defaultdict(set)
    for batch in range(5):
        rows = [(rng.randrange(40), 0, batch * 100 + k) for k in range(30) for _ in range(4)]
        for h, _, i in rows:
            seen[h].add(i)
        store.add(spark.createDataFrame(rows, "h1 long, h2 long, id long"))
        keys = [r.h1 for run in store.runs() for r in spark.table(run.table).collect()]
        assert len(keys) == len(set(keys)) and set(keys) == set(seen)
    assert any(run.increments for run in store.runs()) and len(store.levels) == 2
    got = {(r.h1, r.last_id) for r in store.shared(3).collect()}
    assert got == {(h, max(ids)) for h, ids in seen.items() if len(ids) >= 3}
    store.close()


def test_runs_are_dropped_when_a_step_fails(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(linededup.LineRuns, "shared", lambda self, n: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        linededup.dedup_lines(odd_docs, batches=2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_batches_follow_the_lines():
    assert [linededup._batches(n, 100) for n in (0, 100, 101, 300, 800, 801, 2000)] == [1, 1, 2, 4, 8, 16, 24]


@pytest.mark.parametrize("options", [{}, {"block_words": 7, "shard_slots": 40}])
def test_taken_is_what_the_slots_hold(spark, options):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, slots = mixing.mix(docs, **options)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t")).select("doc_id", "t", F.xxhash64(F.lit(mixing.SEED), "doc_id", "t").alias("h"))
    place = {r.doc_id: (r.h, r.doc_id, r.t) for r in keyed.collect()}
    width = options.get("block_words", mixing.BLOCK_WORDS)
    words = collections.defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: place[r[0]]):
        words[source] += [i] * len(text.split())
    want = collections.Counter()
    for s in slots.collect():
        own = words[s.source][s.block * width : (s.block + 1) * width]
        assert s.used == len(own)
        want.update(own)
    got = {r.id: r.taken for r in mixed.collect()}
    assert got == {i: want[i] for i, _, _ in rows}


def test_draws_decide_what_is_taken(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "concat('s', id % 7) as source")
    whole = mixing._drawn
    drawn = {r.id: r.taken for r in mixing.mix(docs, shard_slots=50)[0].collect()}

    def plain(quotas, n_shards, shard_slots, total, seed, spark):
        return whole(quotas, n_shards, shard_slots, total, seed + 1000, spark)

    monkeypatch.setattr(mixing, "_drawn", plain)
    other = {r.id: r.taken for r in mixing.mix(docs, shard_slots=50)[0].collect()}
    assert drawn.keys() == other.keys() and drawn != other


def test_repeated_documents_are_taken_near_their_share(spark):
    rows = [(1, "a b c d e f", "s")] * 20 + [(k, "x " * 30, "t") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.id: r.taken for r in mixing.mix(docs, block_words=3)[0].groupBy("id").agg(F.sum("taken").alias("taken")).collect()}
    times = mixing.mixed_documents(docs, block_words=3).where("doc_id = 1").count()
    assert abs(times - taken[1] / 6) <= 8 and times <= 60


def chained(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    return {(r[0], r[1]): order[(k + 1) % len(order)][1] for k, r in enumerate(order)}


@pytest.mark.parametrize("hot", [5, None])
def test_hot_and_null_ids_are_cut_into_stretches(spark, monkeypatch, hot):
    monkeypatch.setattr(fp, "STRETCH_DOCS", 50)
    rows = [(hot, f"text of row {k}") for k in range(2000)] + [(k, f"other {k}") for k in range(-100, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    after = chained(hashed)
    found = fp.edited_neighbours(docs, samples=4)
    import hashlib

    def digest(text, next_):
        third = len(text) // 3
        return hashlib.sha256((text[: len(text) - third] + next_[:third]).encode()).hexdigest()

    want = collections.Counter((i, digest(t, after[i, t])) for i, t, _ in hashed)
    assert collections.Counter((r.id, r.edited_sha256) for r in found.collect()) == want
    place, bits, stretch = fp._stretch([5] * 30 + [100] if hot else [100], 0 if hot else 2000, 50)
    keyed = docs.withColumn("text_id", F.xxhash64("text")).withColumnRenamed("doc_id", "id").withColumns({"_place": place.cast("long"), "_bits": bits})
    sizes = keyed.groupBy(stretch.alias("s")).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 200


def test_long_words_are_quick_and_right(library):
    table = sp.load_pieces(queries.piece_model())
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)) for n in (65, 511, 512, 513, 900, 3000)]
    words += ["ab" * 700, "a" * 2000, "étè日本" * 300, "x " * 400]
    for word in words:
        ids, _ = sp.encode_batch([word], table)
        assert ids.tolist() == library.encode(word)
    long = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(200_000))
    sp.encode_batch([long[:2000]], table)
    began = time.time()
    ids, _ = sp.encode_batch([long], table)
    took = time.time() - began
    assert ids.tolist() == library.encode(long) and took < 4


def test_attachments_have_numbers_of_their_own(spark):
    image = lambda ref: {"type": "image", "text": None, "ref": ref, "units": None}
    rows = [(1, 0, "user", [image("a"), image("b")]), (1, 1, "assistant", [image("c")]), (1, 2, "user", None), (1, 3, "user", [image("d")]), (2, 0, "user", [image("e")])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS_TYPE}")
    found = chat.format_turns(turns, id_col="conv_id").collect()
    numbers = {a.ref: a.number for r in found for a in r.attachments}
    assert numbers == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    assert all(f"<image {a.number}>" in r.formatted for r in found for a in r.attachments)
    assert "_first" not in found[0].asDict()
