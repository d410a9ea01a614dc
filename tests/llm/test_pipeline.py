"""The pipeline's stages against brute force on a small corpus, and odd rows in each of them."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_numbered import brute_repeats, components

import corpus_pipeline
from airledger.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    say = {"en": ["river", "stone", "light", "under", "water", "every", "house"], "de": ["grund", "zwischen", "fahrt", "licht", "wasser", "haus", "jeder"]}
    make = lambda lang, n: " ".join(rng.choice(say[lang]) + str(rng.randrange(300)) for _ in range(n))
    base = [make("en", 90) for _ in range(4)]
    bench = make("en", 14)
    rows = [(i, make(rng.choice(["en", "de"]), rng.randint(5, 90))) for i in range(60)]
    for k in range(24):  # near and exact copies
        words = base[k % 4].split(" ")
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    passage = make("de", 60)
    rows += [(200 + k, make("de", 30) + " " + passage + " " + make("de", 30)) for k in range(3)]
    rows += [(300, make("en", 20) + " " + bench.upper() + " " + make("en", 20)), (301, bench)]
    rows += [(400, None), (401, ""), (402, "123 !!"), (403, "qx zvj wkq xq jzz " * 8), (404, "long " + make("en", 20_000))]
    rows += [(3, rows[3][1]), (5, make("en", 40)), (None, make("en", 30)), (None, "??"), (None, "see " + bench)]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame([(i, t, None if i == 403 else "de" if t and re.search("grund|zwischen|fahrt", t) else "en", None if k % 7 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)
    table.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, bench


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_language_stage_drops_what_no_language_explains(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.language_id(spark, docs, folder)
    assert got.columns == docs.columns
    assert pairs(got) == sorted(((i, t) for i, t in rows if t and re.search("[a-z]", t) and i != 403), key=str)


def test_near_duplicate_stage(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, []).append(t)
    sets = {}
    for i, found in texts.items():
        for n, t in enumerate(found):
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(FOLD)) if x]
            sets[i, n] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a[0], b[0]) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, texts)
    got = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns
    assert pairs(got) == sorted([(i, min(texts[i], key=lambda t: (t is not None, t or ""))) for i in texts if want[i] == i] + [r for r in rows if r[0] is None], key=str)


def test_repeated_string_stage(spark, corpus):
    folder, rows, _ = corpus
    once = {i: t for i, t in rows if i is not None}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in once.items()] + [(None, "x" * 300, "en", "s", 0)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_strings(spark, docs, folder).collect()}
    left = {d: (n, removed, digest) for d, n, removed, _, digest in brute_repeats([(i, (t or "").encode()) for i, t in once.items() if i != 404])}
    assert got.pop(None) == ("x" * 300, 0) and got.pop(404)[0] == once[404]
    assert set(got) == {d for d, (n, removed, _) in left.items() if n == 0 or removed < n}
    for d, (text, n_chars) in got.items():
        assert hashlib.sha256(text.encode()).hexdigest() == left[d][2] and n_chars == len(text)


def test_decontamination_stage(spark, corpus):
    folder, rows, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = {tuple(words(bench)[k : k + 10]) for k in range(5)}
    clean = [(i, t) for i, t in rows if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))]
    assert len(rows) - len(clean) == 3
    assert pairs(corpus_pipeline.decontaminate(spark, docs, folder)) == sorted(clean, key=str)


def test_token_stage(spark, corpus):
    folder, rows, _ = corpus
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.tokenise(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    want = [(i, np.array(known.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r.token_ids)) for r in got), key=str) == sorted(want, key=str)


def test_whole_pipeline(spark, corpus):
    folder, rows, _ = corpus
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, folder).collect()}
    assert not set(got) & {400, 401, 402, 403, 300, 301} and 4 <= sum(100 <= (i or 0) < 124 for i in got) < 24
    once = {i: t for i, t in rows}
    for i in set(range(60)) - {3, 5}:  # clean documents stay as they are
        assert got[i] == hashlib.sha256(once[i].encode()).hexdigest()


def test_stages_of_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    assert [stage(spark, docs, folder).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5
