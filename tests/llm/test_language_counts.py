"""The language model is that of all labelled texts, not of a sample: plain counts, floors and regression."""

import random

import numpy as np
import pyarrow as pa

from jobtide.llm import langid

LETTERS = {"x": "abcdefgh", "y": "efghijkl"}


def labelled():
    """600 texts of x and 60 of y; every tenth text has words of letters that no other has."""
    rng = random.Random(8)
    rows = []
    for lang, n in (("x", 600), ("y", 60)):
        for i in range(n):
            letters = LETTERS[lang] if i % 10 else "rstuvw"
            rows.append((" ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(12)), lang))
    return rows


def seen_by_language(rows):
    own = np.array([lang for _, lang in rows])
    seen, _ = langid.presence([t for t, _ in rows], langid.symbol_table())
    return {lang: seen[own == lang] for lang in LETTERS}


def test_n_grams_and_floors_are_those_of_all_texts(spark):
    rows = labelled()
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(docs, max_train=80, n_landmarks=12)
    for k, (lang, seen) in enumerate(seen_by_language(rows).items()):
        number, size = seen.sum(axis=0, dtype=np.int64), len(seen)
        assert model.languages[k] == lang
        known = np.unpackbits(model.known[k], count=langid.N_GRAMS)
        assert np.array_equal(known == 1, number > max(1, 0.004 * size))
        others = number - 1 > max(1, 0.004 * (size - 1))
        shares = (seen & others).sum(axis=1, dtype=np.int64) / seen.sum(axis=1, dtype=np.int64)
        floor = 0.75 * np.quantile(shares, 0.05)
        assert abs(model.floors[k] - floor) < 2**-16


def test_regression_is_that_of_all_texts(spark):
    """Ridge regression of all 660 texts, weighted to 40 of each language, on the kernels with the landmarks."""
    rows = labelled()
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_train=80, n_landmarks=12, ridge=0.01)
    seen = seen_by_language(rows)
    across = np.concatenate([langid.kernel(s, model) for s in seen.values()]).astype(np.float64)
    weight = np.concatenate([np.full(len(s), 40 / len(s)) for s in seen.values()])
    target = np.repeat(np.eye(2), [len(s) for s in seen.values()], axis=0)
    middle = np.average(across, axis=0, weights=weight)
    centred = (across - middle) * weight[:, None]
    marks = model.landmarks.T.astype(np.float64)
    between = marks @ marks.T / np.outer(model.norms, model.norms)
    # With as many features as landmarks the coefficients are penalised by the landmarks' kernel.
    coef = np.linalg.solve(centred.T @ (across - middle) + 0.01 * 80 * between, centred.T @ (target - 0.5))
    want = 0.5 + (across - middle) @ coef
    assert np.abs(across @ model.weights + model.bias - want).max() < 1e-3


def test_model_does_not_depend_on_copies_or_on_how_rows_are_dealt(spark):
    rows = labelled()
    one = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_train=80, n_landmarks=12)
    docs = spark.createDataFrame(rows[::-1] + rows[:90] * 3, "text string, lang string").repartition(7)
    other = langid.fit(docs, max_train=80, n_landmarks=12)
    for name in ("vocabulary", "landmarks", "weights", "bias", "known", "floors"):
        assert np.array_equal(getattr(one, name), getattr(other, name)), name


def test_counts_are_whole_when_tasks_hand_them_on_early(spark, monkeypatch):
    rows = labelled()
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), max_train=80, n_landmarks=12)
    batches = [
        pa.RecordBatch.from_arrays([pa.array([lang for _, lang in part]), pa.array([t for t, _ in part])], names=["l", "t"])
        for part in (rows[:200], rows[200:])
    ]
    monkeypatch.setattr(langid, "HELD_PLACES", 500)
    found = [[c.to_numpy() for c in batch.columns] for batch in langid._tallies(model, np.ones(2))(iter(batches))]
    assert len(found) > 4
    slot, place, n = np.concatenate(found, axis=1)
    for k, seen in enumerate(seen_by_language(rows).values()):
        number = np.bincount(place[slot == k], n[slot == k], langid.N_GRAMS)
        assert np.array_equal(number, seen.sum(axis=0, dtype=np.int64))
