"""Links in cones of vectors, and documents whose id has unlike texts."""

import numpy as np
import pytest

import corpus_pipeline
from airledger.llm import minhash, projection


@pytest.mark.parametrize("share", [0.05, 0.01, 0.001])
def test_links_in_a_cone(spark, share):
    """Vectors about one centre, of which a share of all pairs links: all links are found."""
    rng = np.random.default_rng(5)
    n, d = 4000, 64
    centre = np.zeros(d)
    centre[0] = 1
    noise = rng.standard_normal((n, d)) / 8
    low, high = 0.5, 0.95
    for _ in range(30):  # how much of the centre they have, so that the share links
        a = (low + high) / 2
        x = np.sqrt(a) * centre + np.sqrt(1 - a) * noise
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        low, high = (a, high) if near.mean() < share else (low, a)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in projection.near_duplicate_vectors(rows, block=128).collect()}
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in range(n)) and sum(got.values()) >= 0.99 * want.sum() > 0


def test_unlike_texts_of_one_id(spark):
    a, b, c = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(0, b), (1, b), (1, a), (2, a + " end"), (3, c), (4, c), (4, None), (5, c + " x"), (5, c + " x"), (6, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, words=2).collect()
    assert sorted({(r.doc_id, r.component_id, r.kept) for r in got}) == [(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (4, 3, False), (5, 3, False), (6, 6, True)]
    assert len(got) == len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, b), (3, c), (6, "alone")]


def test_a_pre_token_is_encoded_by_the_model_alone(monkeypatch):
    """Ids of op12's first tokenizer come from its model, as the tokenizer has them for any bytes."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from airledger.llm import coding

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        coder = coding.ByteLevelCoder(file.read(), plain=True)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = random.Random(3)
    parts = ["the", " The", "'s", "  ", "\n", "\t", "\x00", "\x1c", "é", "中文", "　", "\U0001f600", "<|endoftext|>", "1234", "²", "...", "_", "ﬁ", "é", "​"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert coder.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    assert coder.model is not None
