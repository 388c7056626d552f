"""Models against plain restatements of their formulas."""

import itertools
import math

import numpy as np

from tidewall.llm import langid, mixing, toxicity


def test_pairs_of_the_factorization_machine():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.arange(40), 0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    for size in (0, 1, 2, 7, 20):
        present = np.sort(rng.choice(40, size, replace=False))
        raw = m.bias + sum(m.weight[i] for i in present) + sum(float(m.factor[i] @ m.factor[j]) for i, j in itertools.combinations(present, 2))
        assert math.isclose(m.score(present), 1 / (1 + math.exp(-max(-30, min(30, raw)))), rel_tol=1e-9)


def test_a_pair_is_learned_that_no_single_word_tells():
    # label 1 where both words or none of them stand: weights alone say nothing
    rows = [np.array([k for k, on in enumerate((a, b)) if on] + [2]) for a in (0, 1) for b in (0, 1)] * 4000
    labels = np.array([float(a == b) for a in (0, 1) for b in (0, 1)] * 4000)
    m = toxicity.fit(np.arange(3), rows, labels)
    alone = toxicity.Machine(m.known, m.bias, m.weight, np.zeros_like(m.factor))
    wrong = lambda machine: sum((machine.score(r) >= 0.5) != bool(y) for r, y in zip(rows[:4], labels[:4], strict=True))
    assert wrong(m) == 0 < wrong(alone)


def grams(text):
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = "".join(c if c.isalpha() else " " for c in low).split()
    padded = f" {' '.join(words)} "
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


def bundled(text):
    total = np.zeros(langid.DIM)
    for a, b, c in (map(ord, g) for g in grams(text)):
        total += np.roll(langid._letter_vector(a), 2) * np.roll(langid._letter_vector(b), 1) * langid._letter_vector(c)
    return total


def test_profiles_and_cosines(spark):
    rows = [("le chat dort, et LE chien", "fr"), ("the cat sleeps 123 and the dog", "en"), ("der Hund schläft", "de"), ("les chats", "fr"), (None, "fr"), ("no language", None)]
    profiles = langid.prototypes(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    want = {x: sum(bundled(t) for t, lang in rows if t and lang == x) for x in ("fr", "en", "de")}
    assert set(profiles) == set(want) and all(np.allclose(profiles[x], want[x]) for x in want)
    texts = ["les chiens dorment", "dogs sleep", "Ein Hund", "a", "Ünïcode, été", "x" * 5000]
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), profiles).collect():
        likes = {x: cosine(bundled(r["text"]), want[x]) for x in want}
        assert likes[r["lang_pred"]] >= max(likes.values()) - 1e-9 and math.isclose(r["score"], min(1, max(0, max(likes.values()))), abs_tol=1e-6)


def test_scores_are_a_distribution_over_classes(spark):
    # a text's score is the product of its tokens' probabilities: of one-word texts, those of all words of a class share the class's probability
    words = [f"w{k}" for k in range(200)]
    docs = [(k, False, " ".join(words[(k * 7 + j) % 200] for j in range(50))) for k in range(60)] + [(1000 + k, True, w) for k, w in enumerate(words)]
    got = {r["doc_id"]: r for r in mixing.score_documents(spark.createDataFrame(docs, "doc_id long, held_out boolean, text string")).collect()}
    end = got[1000]["base_score"] - math.log10((sum(d[2].split().count("w0") for d in docs[:60]) + 1) / (got[1000]["train_tokens"] + 201 + 1))
    total = sum(10 ** (got[1000 + k]["score"] - end) for k in range(200))
    assert all(got[1000 + k]["score"] < 0 for k in range(200)) and total < 1.5
