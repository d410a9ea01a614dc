"""The trained models against plain loops, finite differences and optimality of their loss."""

import math
import random

import numpy as np
import pytest

from airledger.llm import language, pseudo_likelihood, quality


def plain_choice(ll):
    """choose() of one row in plain loops: ll[language][word]."""
    langs, words = len(ll), len(ll[0])

    def mixture(allowed):
        pi = {k: 1 / len(allowed) for k in allowed}
        for _ in range(3000):
            new = dict.fromkeys(allowed, 0.0)
            for w in range(words):
                p = {k: pi[k] * math.exp(ll[k][w] - max(x[w] for x in ll)) for k in allowed}
                for k in allowed:
                    new[k] += p[k] / max(1e-30, sum(p.values())) / words
            pi = new
        return pi, sum(math.log(max(1e-30, sum(pi[k] * math.exp(ll[k][w] - max(x[w] for x in ll)) for k in allowed))) + max(x[w] for x in ll) for w in range(words))

    best = max(range(langs), key=lambda k: (sum(ll[k]), -k))
    found, value = {best: 1.0}, sum(ll[best])
    full, _ = mixture(range(langs))
    order = sorted(range(langs), key=lambda k: (-full[k], k))
    for size in range(2, langs + 1):
        pi, v = mixture(order[:size])
        if v - 2 * (size - 1) * math.log(words + 1) > value + 1e-9:
            found, value = pi, v - 2 * (size - 1) * math.log(words + 1)
    return found


@pytest.mark.parametrize("langs", [1, 2, 6])
def test_mixtures_against_plain_loops(langs):
    rng = random.Random(langs)
    rows = []
    for k in range(12):
        used = rng.sample(range(langs), min(langs, 1 + k % 5))
        rows.append([[(-3 if lang == of else -14) + rng.random() for lang in range(langs)] for of in used for _ in range(rng.randint(8, 25))])
    ll = np.array([w for row in rows for w in row], dtype=np.float32).T
    pick, _ = language.choose(ll, np.array([len(x) for x in rows]))
    for k, row in enumerate(rows):
        want = plain_choice([list(x) for x in zip(*row, strict=True)])
        assert set(np.flatnonzero(pick[:, k] > 1e-6)) == {x for x, share in want.items() if share > 1e-6}
        assert all(abs(pick[x, k] - share) < 0.02 for x, share in want.items())


def hinge_loss(w, bias, rows, y, ratio, cost=1.0):
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    values = [ratio[x] / np.sqrt((ratio[x] ** 2).sum()) for x in rows]
    margins = np.array([w[x] @ v + bias for x, v in zip(rows, values, strict=True)])
    return 0.5 * (w @ w + bias**2) + cost * (balance * np.maximum(0, 1 - y * margins)).sum()


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    ratio = np.zeros(quality.BUCKETS)
    ratio[:300] = rng.standard_normal(300)
    y = np.where(rng.random(240) < 0.3, 1.0, -1.0)
    rows = [np.unique(np.concatenate([rng.integers(0, 300, 20), rng.integers(0, 12, 6) + (12 if s > 0 else 0)])) for s in y]
    w, bias = quality.fit_block(rows, y, ratio, epochs=600)
    best = hinge_loss(w, bias, rows, y, ratio)
    for _ in range(300):  # the loss is convex: no step in any direction may lower it
        step, size = np.zeros(quality.BUCKETS), 10.0 ** rng.uniform(-4, -1)
        step[:300] = rng.standard_normal(300) * size / 17
        assert hinge_loss(w + step, bias + rng.standard_normal() * size, rows, y, ratio) > best - 1e-6
    assert hinge_loss(*quality.fit_block(rows, y, ratio), rows, y, ratio) < 1.02 * best
    halves = [quality.fit_block(rows[k::2], y[k::2], ratio) for k in range(2)]
    mean, shift = (halves[0][0] + halves[1][0]) / 2, (halves[0][1] + halves[1][1]) / 2
    sign = lambda w, b: np.sign([w[x] @ (ratio[x] / np.sqrt((ratio[x] ** 2).sum())) + b for x in rows])
    assert (sign(mean, shift) == sign(w, bias)).mean() > 0.95


def test_conflicting_and_one_sided_labels(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three four"), (None, "five")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    only = quality.learn(docs, labels([(1, 1), (2, 1)]))
    assert [r.score for r in quality.score(docs, only).collect()] == [1.0] * 3
    both = quality.learn(docs, labels([(1, 1), (1, 0), (2, 0)]))  # of labels that differ the higher holds
    assert {r.doc_id: r.predicted for r in quality.score(docs, both).where("doc_id is not null").collect()} == {1: 1, 2: 0}


def test_window_network_is_a_distribution_with_right_gradients():
    rng = np.random.default_rng(5)
    w = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32) for k, x in pseudo_likelihood._initial().items()}
    around = np.tile(rng.integers(0, pseudo_likelihood.SIZE + 1, 4), (pseudo_likelihood.SIZE, 1))
    assert abs(np.exp(pseudo_likelihood.log_likelihoods(w, np.arange(pseudo_likelihood.SIZE), around)).sum() - 1) < 1e-4
    token, around = rng.integers(0, 40, 64), rng.integers(0, 40, (64, 4))
    moved = {k: x.copy() for k, x in w.items()}
    pseudo_likelihood.train_step(moved, {k: np.ones_like(x) for k, x in w.items()}, token, around)
    loss = lambda: -pseudo_likelihood.log_likelihoods(w, token, around).mean()
    for name in w:
        change = ((w[name] - moved[name]) / pseudo_likelihood.RATE).ravel().astype(float)
        gradient = change / np.sqrt(np.maximum(1e-9, 1 - change**2))  # the step is gradient / sqrt(1 + gradient**2)
        for at in np.argsort(-np.abs(gradient))[:3]:
            flat, kept = w[name].reshape(-1), w[name].reshape(-1)[at]
            flat[at] = kept + 0.01
            high = loss()
            flat[at] = kept - 0.01
            low = loss()
            flat[at] = kept
            assert abs((high - low) / 0.02 - gradient[at]) < 0.05 * abs(gradient[at]) + 1e-4


def test_words_share_their_class_by_their_counts(spark):
    """Against a plain sum, with more words than classes; the counts of the words of a class add up to its own."""
    rng = random.Random(4)
    texts = [(k, " ".join(f"w{int(3000 * rng.random() ** 2)}" for _ in range(100))) for k in range(60)]
    docs = spark.createDataFrame([*texts, (99, "never met")], "doc_id long, text string")
    model = pseudo_likelihood.train(docs.where("doc_id < 99"))
    counts = {r["word"]: r["n"] for r in model.words.collect()}
    assert sum(counts.values()) == 60 * 100
    got = {r.doc_id: r.pseudo_log_likelihood for r in pseudo_likelihood.score(docs, model).collect()}
    edge = pseudo_likelihood.SIZE - pseudo_likelihood.OTHERS
    for k, text in [*texts, (99, "never met")]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        token, _, around, h = pseudo_likelihood._token_rows(model, data, np.array([0, len(data)]))
        want = pseudo_likelihood.log_likelihoods(model.weights, token, around)
        for i, (t, word) in enumerate(zip(token, h.view(np.int64), strict=True)):
            if t >= edge:
                want[i] += math.log(counts.get(int(word), 1)) - math.log(model.met[t - edge])
        assert abs(got[k] - want.sum()) < 1e-3
    others = {}
    for word, n in counts.items():
        if np.array([word]).view(np.uint64)[0] not in model.hashes:
            others[word & (pseudo_likelihood.OTHERS - 1)] = others.get(word & (pseudo_likelihood.OTHERS - 1), 0) + n
    assert all(model.met[k] == n for k, n in others.items())


def test_pseudo_likelihood_rows_without_id_and_long_texts(spark):
    docs = spark.createDataFrame([(None, "one two three"), (None, None), (1, "one two three"), (1, "x"), (2, "word other " * 200_000)], "doc_id long, text string")
    got = pseudo_likelihood.score(docs, pseudo_likelihood.train(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (0, 3), (1, 1), (1, 3), (2, 400_000)]
    assert len({round(r.mean_log_likelihood, 6) for r in got if r.n_tokens == 3}) == 1
