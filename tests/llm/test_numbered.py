"""The numbered operators against brute force, exact round trips and odd rows."""

import base64
import gzip
import hashlib
import io
import random
import re
import zipfile
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from airledger.llm import bpe, decontamination, language, licences, minhash, projection, pseudo_likelihood, quality, suffixes, warc

FOLD = {i: i + 32 for i in range(65, 91)}
#: Columns whose names clash with those the operators use inside.
CLASH = "id long, row long, score double, d0 string, n long"


def docs(spark, rows):
    """(doc_id, text) rows with columns of clashing names."""
    return spark.createDataFrame([(*r, 1, 1, 0.5, "x", 1) for r in rows], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "ré", "The", "x") for b in ("n", "t", "sso", "", "9")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(80) for _ in range(12)]
    rows = [(i, make(rng.randint(0, 40))) for i in range(80)]
    for k in range(60):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, "   \n\t"), (303, "one"), (304, "ONE"), (305, "long " * 4000), (306, rows[-1][1]), (307, "!!! 123")]


def components(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_minhash(spark, texts, words):
    rows = [*texts, texts[3]]
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(FOLD)) if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = minhash.near_duplicates(docs(spark, rows), words=words).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_minhash_empty(spark):
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_minhash_rows_without_id(spark):
    text = "one two three four five six seven"
    got = minhash.near_duplicates(docs(spark, [(9, text), (None, text), (5, text), (None, "alone")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(5, 5, True), (9, 5, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, False)] * 2


def test_minhash_links_behind_an_unlike_document(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda *args: real(*args).withColumn("buckets", F.array(F.lit(1).cast("long"))))
    near = " ".join(f"w{i}" for i in range(60))
    got = minhash.near_duplicates(docs(spark, [(1, " ".join(f"v{i}" for i in range(60))), (2, near), (3, near + " more")])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2}


def test_minhash_block_links():
    import pyarrow as pa

    sets = [[1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [9, 10], [1, 2, 3, 4, 5]]
    table = pa.table({"asks": [True, False, False, False], "id": [7, 3, 5, 9], "comp": [7, 3, 5, 7], "shingles": pa.array(sets, pa.list_(pa.int64()))})
    assert minhash._linked(table, 60).to_pylist() == [{"a": 7, "b": 3}]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 24))
    rows = [(i, (base[i % 20] + rng.standard_normal(24) * rng.choice([0.02, 0.2, 0.35, 0.5])).tolist()) for i in range(400)]
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, 2.0]), (2004, [2.0, 4.0]), (2003, [1.0, 2.0]), (2005, [None] * 24), (2006, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, vec string")
    got = {r.vec_id: r for r in projection.near_duplicate_vectors(df).collect()}
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    assert len(got) == len(rows) + len(odd) - 1
    assert sum(got[i].n_links for i in range(400)) >= 0.99 * (near.sum() - 400)
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(400))
    want = components([(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)], range(400))
    assert np.mean([got[i].component_id == want[i] for i in range(400)]) > 0.99
    assert [(got[i].n_links, got[i].component_id) for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006)] == [(0, 2000), (0, 2001), (0, 2002), (1, 2003), (1, 2003), (0, 2005), (0, 2006)]
    assert projection.near_duplicate_vectors(df.limit(0)).collect() == []


def test_vectors_of_a_loose_group(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(32)
    x = centre / np.linalg.norm(centre) + rng.standard_normal((3000, 32)) * 0.048
    x = np.vstack([x, rng.standard_normal((500, 32))]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert 2000 < near[:3000].sum(axis=1).mean() < 3000
    want = components([(0, int(b)) for b in np.flatnonzero(near[:3000, :3000].any(axis=1))], range(3500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in projection.near_duplicate_vectors(df, block=1000).collect()}
    assert [got[i].n_links for i in range(3500)] == (near.sum(axis=1) - 1).tolist()
    assert [got[i].component_id for i in range(3500)] == [want[i] for i in range(3500)]


def brute_repeats(rows, length=100):
    first = {}
    for d, t in rows:
        for p in range(len(t) - length + 1):
            k = t[p : p + length]
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for d, t in rows:
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (d, p):
                cut[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(t, cut, strict=True) if not c)
        out.append((d, len(t), sum(cut), sum(1 for i in range(len(t)) if cut[i] and (i == 0 or not cut[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_strings(spark):
    rng = random.Random(3)
    words = ["ab", "cd", "é", "The", "x\0", "fgh"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(60) for _ in range(6)]
    rows = [(i, make(rng.randint(0, 30)) + "".join(b[rng.randint(0, 40) : rng.randint(60, 200)] for b in rng.sample(base, 2)) + make(rng.randint(0, 20))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 300), (304, "a" * 99), (305, rows[5][1]), (5, rows[5][1]), (306, "a" * 100)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in suffixes.remove_repeats(docs(spark, rows).repartition(3)).collect())
    assert got == brute_repeats([(d, (t or "").encode()) for d, t in rows])
    assert suffixes.remove_repeats(docs(spark, [])).collect() == []
    once = "é".join(str(i) for i in range(60))
    kept = suffixes.remove_repeats(docs(spark, [(1, once), (2, "x" + once)]), keep_text=True).orderBy("doc_id").collect()
    assert [r.kept_text for r in kept] == [once, "x"]


def test_loser_tree_merges():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 30))) for _ in range(5)]
    coded = []
    for run in runs:
        m = np.array([list(x) for x in run], dtype=np.uint8).reshape(-1, 6)
        coded.append(suffixes.decoded(*suffixes.front_code(m), 6))
    out = list(suffixes.merge_runs(coded, 6))
    assert [x[2] for x in out] == sorted(x for run in runs for x in run)
    for (_, _, a), (lcp, _, b) in zip(out, out[1:], strict=False):
        assert lcp == next((i for i in range(6) if a[i] != b[i]), 6)


@pytest.mark.parametrize("zip64", [False, True])
def test_warc(spark, tmp_path, zip64):
    rows = [(5, "http://a/\r\nx", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, None), (8, "http://c", ""), (7, "http://d", "Zq" * 50_000), (1, "http://e", "a\r\n\r\nb")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    archives = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=1000, zip64=zip64)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    for page, _, html in rows:
        raw = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "").encode() == raw)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == page else "revisit", None if first == page else first)
        assert (got[page].payload_bytes, got[page].payload_digest, got[page].record_type, got[page].refers_to) == want
        assert got[page].payload is None or (bytes(got[page].payload) == raw and got[page].intact)
    files = list((tmp_path / "w" / "archives").glob("*.zip"))
    assert files and {r.path.rpartition("/")[2] for r in warc.list_archives(spark, str(tmp_path / "w")).collect()} == {x.name for x in files}
    for file in files:
        with zipfile.ZipFile(file) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
            assert gzip.GzipFile(fileobj=io.BytesIO(z.read(warc.DATA))).read().startswith(b"WARC/1.1")
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "none"))).collect() == []


def test_warc_rows_without_id_and_repeated_ids(spark, tmp_path):
    rows = [(1, "A"), (2, "A"), (2, "B"), (3, "B"), (None, "A"), (None, None), (2, "B")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, str(tmp_path / "w"))).collect()
    found = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, bytes(r.payload) if r.payload is not None else None) for r in got if r.record_type == "response")
    assert found == [(0, "response", 0, b""), (0, "response", 0, b"A"), (1, "response", 0, b"A"), (2, "response", 0, b"B"), (2, "response", 0, b"B")]
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(2, 1), (3, 2)]


def test_warc_foreign_archives(spark, tmp_path):
    """Archives of another writer: own member names, no extension fields, gzip or plain, with or without an index; and one beyond 4 GB."""
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    plain = lambda kind, body: b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    raws = [info, plain(b"response", block)]
    packed = [gzip.compress(x) for x in raws]
    lines = "".join("com,x)/ 2020 " + f'{{"filename": "other.warc.gz", "offset": "{o}", "length": "{n}"}}\n' for o, n in ((0, len(packed[0])), (len(packed[0]), len(packed[1]))))
    made = {"a": {"archive/one.warc.gz": b"".join(packed)}, "b": {"archive/two.warc": b"".join(raws), "pages/pages.jsonl": b'{"title": "no place"}'}, "c": {"archive/other.warc.gz": b"".join(packed), "indexes/index.cdx.gz": gzip.compress(lines.encode())}}
    for name, members in made.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_STORED) as z:
            z.comment = b"a comment with PK\x05\x06 in it"
            for member, data in members.items():
                z.writestr(member, data)
    gap = 5 << 30
    with open(tmp_path / "far.zip", "wb") as f:  # the same members behind a sparse gap of 5 GB
        f.seek(gap)
        central, at = b"", gap
        for key, data in made["c"].items():
            local = warc.LOCAL + b"\x2d\0" + b"\0" * 12 + len(data).to_bytes(4, "little") * 2 + len(key).to_bytes(2, "little") + b"\0\0" + key.encode()
            f.write(local + data)
            extra = b"\1\0\x08\0" + at.to_bytes(8, "little")
            central += warc.CENTRAL + b"\x2d\0\x2d\0" + b"\0" * 12 + len(data).to_bytes(4, "little") * 2 + len(key).to_bytes(2, "little") + len(extra).to_bytes(2, "little") + b"\0" * 10 + b"\xff" * 4 + key.encode() + extra
            at += len(local) + len(data)
        end64 = at + len(central)
        f.write(central + warc.END64 + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + b"\0" * 8 + (2).to_bytes(8, "little") * 2 + len(central).to_bytes(8, "little") + at.to_bytes(8, "little"))
        f.write(warc.LOCATOR64 + b"\0" * 4 + end64.to_bytes(8, "little") + b"\1\0\0\0" + warc.END + b"\0" * 4 + b"\xff" * 12 + b"\0\0")
    got = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    assert sorted((r.record_type, bytes(r.payload), r.page_id, r.intact) for r in got) == [("response", b"hello", None, None)] * 4 + [("warcinfo", b"abc", None, None)] * 4
    with zipfile.ZipFile(tmp_path / "packed.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.warc", raws[0])
    with pytest.raises(Exception, match="compressed by the archive"):
        warc.read_archives(warc.list_archives(spark, str(tmp_path)).where("path like '%packed%'")).collect()


def test_bpe(spark, texts):
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*texts, texts[0], (400, "emoji 😀 \x00 tab\t\n  spaces   end  "), (401, "<|endoftext|>"), (402, "a" * 3000)]
    got = bpe.decode(bpe.encode(docs(spark, rows), ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(got) == len(rows)
    want = {i: known.encode_ordinary(t or "") for i, t in rows}
    text = dict(rows)
    for r in got:
        assert np.frombuffer(r.token_ids, dtype="<u4").tolist() == want[r.doc_id]
        assert bytes(r.decoded) == (text[r.doc_id] or "").encode()
    assert bpe.encode(docs(spark, []), ranks, public_tokenizers.PATTERN).collect() == []


def test_contamination(spark, texts):
    items = [(1, texts[100][1]), (2, texts[100][1][:60]), (3, "the x"), (4, None), (5, "..."), (6, "one"), (6, "one")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, win int")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    rows = [*texts, texts[0]]
    got = decontamination.contamination(docs(spark, rows), bench).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w, hit, named = words(text[r.doc_id]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest())
    assert decontamination.contamination(docs(spark, []), bench).collect() == []
    assert {r.n_hit for r in decontamination.contamination(docs(spark, texts[:5]), bench.limit(0)).collect()} == {0}


def test_language(spark):
    rng = random.Random(1)
    langs = {"aa": ["kalo", "mino", "teru"], "bb": ["zwisch", "grund", "fahrt"], "cc": ["été", "où", "garçon"]}
    say = lambda x, n: " ".join(rng.choice(langs[x]) for _ in range(n))
    rows = [(i, say(x, 30), x) for i, x in enumerate(["aa", "bb", "cc"] * 10)] + [(90, "kalo", None), (91, None, "aa")]
    train = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    model = language.learn(train)
    asked = docs(spark, [(1, say("aa", 20)), (2, say("bb", 20)), (3, say("cc", 12) + " " + say("bb", 24)), (4, None), (5, ""), (6, "123 !!"), (7, say("aa", 20000))])
    got = {r.doc_id: r for r in language.identify(asked, model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["aa", "bb", "bb", "und", "und", "und", "aa"]
    assert set(got[3].languages) == {"bb", "cc"} and 0.5 < got[3].score < 0.85 and got[4].score == 0
    assert language.identify(asked.limit(0), model).collect() == []
    assert {r.lang_pred for r in language.identify(asked, language.learn(train.limit(0))).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["calm", "river", "stone", "light"]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "win***"]) for _ in range(30))
    rows = [(i, good() if i % 2 else bad()) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 200_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(70, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    model = quality.learn(docs(spark, rows), labels)
    got = {r.doc_id: r for r in quality.score(docs(spark, rows), model).collect()}
    assert len(got) == len(rows) and all(got[i].predicted == i % 2 for i in range(60, 80)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[100].score == got[101].score
    assert {r.score for r in quality.score(docs(spark, rows), quality.learn(docs(spark, rows), labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs(spark, []), model).collect() == []


def test_pseudo_likelihood(spark, texts):
    rows = docs(spark, texts)
    model = pseudo_likelihood.train(rows)
    got = {r.doc_id: r for r in pseudo_likelihood.score(rows, model).collect()}
    assert len(got) == len(texts) and (got[300].n_tokens, got[300].pseudo_log_likelihood, got[300].mean_log_likelihood) == (0, 0.0, None)
    assert got[305].mean_log_likelihood < 0 and got[305].n_tokens == 4000
    assert pseudo_likelihood.score(docs(spark, []), model).collect() == []
    w, power = pseudo_likelihood._initial(), {k: np.full(s, 1e-6, dtype=np.float32) for k, s in pseudo_likelihood._SHAPES.items()}
    token = np.tile(np.arange(8), 500)
    around = np.stack([np.roll(token, s) for s in (2, 1, -1, -2)], axis=1)
    before = pseudo_likelihood.log_likelihoods(w, token, around).mean()
    for _ in range(60):
        pseudo_likelihood.train_step(w, power, token, around)
    assert pseudo_likelihood.log_likelihoods(w, token, around).mean() > before + 3


def test_licences(spark):
    from airledger.llm.licence_texts import MIT

    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + MIT.upper().replace("SUBLICENSE", "sub-license")), (2, "released under the MIT licence"), (3, "words\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, None), (5, ""), (6, "x " * 50_000)]
    got = {r.doc_id: r for r in licences.scan(docs(spark, rows)).collect()}
    assert (got[1].licence, got[2].licence, got[3].licence, got[4].digest) == ("MIT", "MIT", None, None)
    assert got[3].line_licences == ["CC-BY-NC-4.0", "MIT"] and got[5].line_licences == []
    assert licences.scan(docs(spark, [])).collect() == []


def test_licences_rows_with_repeated_and_null_ids(spark):
    rows = [(1, "plain words"), (1, "x\nLicensed under the MIT License."), (None, "Published under the terms of the Mozilla Public License 2.0"), (None, "no")]
    got = sorted((r.doc_id or 0, r.licence or "", ",".join(r.line_licences)) for r in licences.scan(docs(spark, rows)).collect())
    assert got == [(0, "", ""), (0, "MPL-2.0", "MPL-2.0"), (1, "", ""), (1, "", "MIT")]


def test_licences_known_in_other_wordings(spark):
    """Texts rewrapped, respelled and under another holder's copyright line; changed terms are no match."""
    import textwrap

    from airledger.llm import licence_texts as known

    fill = lambda text, width: "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))
    gnu = (known.GNU_NOTICE + "\n\n" + known.GNU_COPY).format("library", "Affero General Public License", "3")
    rows = [
        (1, "BSD 3-Clause License\n\nCopyright (c) 2011, A. Body\nAll rights reserved.\n\n" + fill(known.BSD_3, 60).replace('"AS IS"', "``AS IS''")),
        (2, "/*\n" + fill(known.MIT, 50).replace("\n", "\n * ") + "\n */"),
        (3, "Copyright © 1999 B\n" + fill(gnu, 72).replace("licens", "licenc").replace(": you", "; you")),
        (4, known.MIT.replace("free of charge", "for a fee")),
        (5, "This document is licensed under the Creative Commons Attribution-ShareAlike 3.0 License"),
        (6, fill(known.UNLICENSE, 40)),
    ]
    got = {r.doc_id: r.licence for r in licences.scan(docs(spark, rows)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "MIT", 3: "AGPL-3.0-or-later", 4: None, 5: "CC-BY-SA-3.0", 6: "Unlicense"}


def test_licences_match_their_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = sorted(map(tuple, con.execute(licences.oracle_sql() + " ").fetchall()), key=str)
    from airledger.llm.queries import op2_licence_scan

    assert sorted(map(tuple, op2_licence_scan(spark, data).collect()), key=str) == want


def test_contamination_rows_without_id_and_short_windows(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "one"), (None, "gamma"), (3, " ".join(f"w{i}" for i in range(12))), (4, None)], "item_id long, text string")
    rows = [(None, "so alpha\x00beta!"), (None, "gamma one one"), (7, "nothing"), (7, "ONE"), (8, "x " + " ".join(f"W{i}" for i in range(12)) + " y"), (9, None), (10, "one " * 400_000)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, ",".join(r.items), str([tuple(h) for h in r.hits])) for r in decontamination.contamination(docs(spark, rows), bench).collect())
    assert got == [(0, 3, 2, "1", "[(1, 2)]"), (0, 3, 2, "2", "[(1, 2)]"), (7, 1, 0, "", "[]"), (7, 1, 1, "2", "[(0, 1)]"), (8, 14, 12, "3", "[(1, 12)]"), (9, 0, 0, "", "[]"), (10, 400_000, 400_000, "2", "[(0, 400000)]")]


def test_bpe_rows_without_id_and_long_texts(spark):
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(None, "one two"), (None, None), (3, "x" * 3_000_000), (3, "other text"), (4, "a b " * 600_000)]
    got = bpe.decode(bpe.encode(docs(spark, rows), ranks, public_tokenizers.PATTERN), ranks).collect()
    raw = sorted(bytes(r.decoded) for r in got)
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "None", "None"] and raw == sorted((t or "").encode() for _, t in rows)
    for r in got:
        if len(r.decoded) < 3_000_000 or r.doc_id == 4:
            assert np.frombuffer(r.token_ids, dtype="<u4").tolist() == known.encode_ordinary(bytes(r.decoded).decode())


def test_repeated_strings_rows_without_id(spark):
    once, more = "é".join(str(i) for i in range(60)), "y" * 99 + "".join(chr(97 + i * 7 % 26) for i in range(150))
    rows = [(None, once), (None, once + "x"), (4, more), (None, more), (None, None)]
    got = sorted((suffixes.NO_ID if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in suffixes.remove_repeats(docs(spark, rows)).collect())
    assert got == brute_repeats([(suffixes.NO_ID if d is None else d, (t or "").encode()) for d, t in rows])


def test_repeated_strings_of_rows_that_share_an_id(spark):
    """Of rows of one id, and of rows without one, the smaller start is earlier, whichever row comes first in a block."""
    once = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(7, "head " + once), (7, once), (None, "more " + once[::-1]), (None, once[::-1] + "z"), (7, once + "q")]
    got = sorted((suffixes.NO_ID if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in suffixes.remove_repeats(docs(spark, rows).coalesce(1)).collect())
    assert got == brute_repeats([(suffixes.NO_ID if d is None else d, (t or "").encode()) for d, t in rows])


@pytest.mark.parametrize("spread", [0, 20])
def test_repeated_strings_of_a_passage_in_a_third_of_all_rows(spark, monkeypatch, spread):
    """Strings of frequent fingerprints meet by digest, the others in ranges that are dealt into several; the rows are the same."""
    monkeypatch.setattr(suffixes, "MAX_CUTS", 2)
    monkeypatch.setattr(suffixes, "SLICES", 3)
    monkeypatch.setattr(suffixes, "SLICE_BLOCKS", 2)
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefghi \0é") for _ in range(n))
    passage, rare = make(140), make(180)
    rows = [(i, make(rng.randint(0, 200)) + (passage[rng.randint(0, 9) : rng.randint(130, 140)] if i % 3 == 0 else rare if i % 37 == 1 else "") + make(rng.randint(0, 300))) for i in range(200)]
    rows += [(None, "x" + passage), (None, passage), (None, passage), (3, passage), (250, "a" * 700), (251, None), (252, passage * 3)]
    rng.shuffle(rows)
    got = sorted((suffixes.NO_ID if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in suffixes.remove_repeats(docs(spark, rows).repartition(12), spread=spread).collect())
    assert got == brute_repeats([(suffixes.NO_ID if d is None else d, (t or "").encode()) for d, t in rows])


def test_repeated_strings_survive_another_split(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(i, base[rng.randrange(2000) :][: rng.randint(50, 900)]) for i in range(200)]
    real = suffixes._splitters

    def changed(*args):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        return real(*args)

    monkeypatch.setattr(suffixes, "_splitters", changed)
    try:
        got = sorted(tuple(r) for r in suffixes.remove_repeats(docs(spark, rows)).collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == brute_repeats([(d, t.encode()) for d, t in rows])


def test_repeated_strings_long_texts(spark):
    """Texts of megabytes: one character, a short period, and prose with a passage far apart; anchors of a long text are those of the whole."""
    rng = random.Random(9)
    prose = "".join(rng.choice("abcdefghijkl ") for _ in range(1_500_000))
    rows = [(1, "a" * 3_000_000), (2, "abc" * 700_000), (3, prose + prose[700_000:700_300])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs(spark, rows)).collect()}
    assert got == {1: (3_000_000, 2_999_999, 1), 2: (2_100_000, 2_099_997, 1), 3: (1_500_300, 300, 1)}
    data = np.frombuffer(prose[:1_200_000].encode(), dtype=np.uint8)
    at = np.concatenate([x for x, _ in suffixes._block_anchors(data, np.array([0, len(data)]), 100)])
    assert at.tolist() == suffixes.anchors(data, np.array([0, len(data)]), 100)[0].tolist()
