"""Every language takes part in the fit, however rare or long its texts are."""

import random

from jobtide.llm import langid


def text(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))


def test_rare_and_long_languages_are_learned(spark):
    rng = random.Random(5)
    rows = [(text(rng, "abcdefg", 30), "common") for _ in range(3000)]
    rows += [(text(rng, "hijklmn", 30), "rare") for _ in range(3)]
    rows += [(text(rng, "opqrstu", 5000), "long") for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(docs, max_train=100, n_landmarks=12)
    assert model.languages == ["common", "long", "rare"]
    new = [(text(rng, a, 40), lang) for a, lang in (("abcdefg", "common"), ("hijklmn", "rare"), ("opqrstu", "long"))]
    found = langid.identify(spark.createDataFrame(new, "text string, lang string"), model).collect()
    assert [r.lang_pred for r in found] == [r.lang for r in found]


def test_quotas_share_what_small_languages_leave():
    assert langid.quotas({"a": 10_000, "b": 3, "c": 10_000}, 103) == {"a": 50, "b": 3, "c": 50}
    assert min(langid.quotas({str(k): 100 for k in range(1000)}, 2000).values()) == 8
