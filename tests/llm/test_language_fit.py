"""The pipeline's language stage rejects what no learned language explains."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stage_rejects_unlearned_languages_and_noise(spark):
    rng = random.Random(9)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = docs.where("lang in ('en', 'fr', 'de')")
    other = docs.where("lang = 'es' and n_chars > 200").selectExpr(*(c if c != "lang" else "cast(null as string) lang" for c in docs.columns))
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (400, 400, 3000)]
    noise += ["\u0434\u043e\u043c \u0438 \u0441\u0430\u0434 " * 20]
    junk = spark.createDataFrame([(-1 - k, t, None, "x", len(t)) for k, t in enumerate(noise)], docs.schema)
    rows = learned.union(other).union(junk)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, rows, SF).collect()}
    clean = [r.doc_id for r in learned.where("text rlike '[a-zA-Z]'").collect()]
    assert sum(i in kept for i in clean) >= 0.995 * len(clean)
    foreign = [r.doc_id for r in other.collect()]
    assert sum(i in kept for i in foreign) < 0.2 * len(foreign) and not any(i < 0 for i in kept)
    short = spark.createDataFrame([(10**9, " ".join(learned.where("lang = 'en' and n_chars > 100").first().text.split()[:6]), None, "x", 9)], docs.schema)
    assert 10**9 in {r.doc_id for r in corpus_pipeline.identify_language(spark, rows.union(short), SF).collect()}
