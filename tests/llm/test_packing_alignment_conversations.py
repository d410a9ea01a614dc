"""Operators 11 to 13 against brute force: per-document packing, interval overlaps, a DP over single rows."""

import bisect
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from airledger.llm import alignment, conversations, packing, queries
from airledger.llm.coding import ByteLevelCoder, byte_level_tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a\n\n b\t", "don't <|endoftext|>'s", "<|endoftext|><|endoftext|>", "日本語 é ß 🙂 ՘႔0", "x" * 3000, "a\x00b\r\n", "▁ ▁▁", "<0x41> <unk> </s>", "1234 ' ''s '", "　  z", "long words " * 2500]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", 1, 1) for r in rows], "doc_id long, text string, length long, piece long, `offset` string, pair long, no long")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "radio", "Étion", "ouelle", "nicht", "42", "über", "x-ray", "…", "\n", "don't", "W7ABC", "日本"]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200])))) for i in range(120)]
    return made + [(200 + i, t) for i, t in enumerate(ODD)] + [made[5], (7, "another text of a repeated id"), (None, "no id"), (None, "no id")]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def best_fit(lengths, capacity):
    """The number of bins that best-fit decreasing opens, one piece at a time."""
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, bins = capacity, bins + 1
        if room > n:
            bisect.insort(rooms, room - n)
    return bins


def check_packed(rows, capacity):
    for bin_rows in by(rows, "sequence_id").values():
        at = 0
        for r in sorted(bin_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len({r.sequence_id for r in rows}) == best_fit([r.length for r in rows], capacity)


def by(rows, column):
    out = {}
    for r in rows:
        out.setdefault(r[column], []).append(r)
    return out


def test_cut_and_pack(spark, texts):
    tokenizer = Tokenizer.from_file(A)
    rows = packing.pack(packing.cut(docs(spark, texts), A)).collect()
    want = []
    for of, text in texts:
        ids = ids_of(tokenizer, text)
        at = 0
        n = -(-len(ids) // 1024)
        for k in range(n):
            end = len(ids) - 1024 * (n - 1 - k)
            want.append((of, k, at, end - at, struct.pack(f"<{end - at}I", *ids[at:end])))
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.token_ids)) for r in rows) == Counter(want)
    check_packed(rows, 1024)


@pytest.mark.parametrize("seed", range(4))
def test_pack_lengths(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([100, 512, 341, 700, rng.randint(1, 1024), 1024, 3][: 2 + seed * 2]) for _ in range(3000)]
    rows = spark.createDataFrame([(i // 2, n) for i, n in enumerate(lengths)], "doc_id long, length int").repartition(7)
    check_packed(packing.pack(rows).collect(), 1024)


def test_pack_bounds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.cut(empty, A)).count() == 0
    for lengths, capacity in (([5], 4), ([0], 4), ([1], 5000)):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(n,) for n in lengths], "length int"), capacity)


def test_plan_is_small():
    runs = packing.plan({n: 10**9 + n for n in range(1, 1025)}, 1024)
    assert len(runs) < 20_000
    bins = 0
    for length, _, _, _, offset in runs.tolist():
        assert 0 <= offset and offset + length <= 1024
    assert bins == 0


def test_classes_of_characters():
    """Every character splits like the tokenizer's own splitter has it, or is left to the tokenizer."""
    coder = ByteLevelCoder(open(A, "rb").read(), plain=False)
    tokenizer, points = Tokenizer.from_file(A), [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    for at in range(0, len(points), 997):
        text = "".join(f"a{chr(i)}b 1{chr(i)}2 !{chr(i)}? {chr(i)}\n" for i in points[at : at + 3])
        assert coder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def overlaps(a, b, len_a, len_b):
    """Groups and linked pairs by comparing every pair of tokens."""
    spans = []
    for ids, sizes in ((a, len_a), (b, len_b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + sizes[i]))
            at += sizes[i]
        spans.append(out)
    pairs = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
    ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
    groups = [([i for i, x in zip(a, spans[0], strict=True) if lo <= x[0] < hi], [j for j, y in zip(b, spans[1], strict=True) if lo <= y[0] < hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
    return pairs, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), len(groups)


def test_alignment(spark, texts):
    tokenizer, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    bytes_a, bytes_b = byte_level_tokens(tokenizer), alignment.piece_tokens(model)
    len_a, len_b = [len(x) for x in bytes_a], [len(x) for x in bytes_b]
    few = [(i, t) for i, t in texts if t is None or len(t) < 4000]
    want, counts, none = [], Counter(), 0
    for of, text in few:
        a, b = (tokenizer.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in a) != f" {text}".encode() or b"".join(bytes_b[i] for i in b) != f" {text}".encode():
            a, b, none = [], [], none + 1
        links, said, n = overlaps(a, b, len_a, len_b)
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        want.append((of, len(a), len(b), n, pairs, said))
    assert 2 < none < 9
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    expected = Counter((of, na, nb, n, len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), hashlib.sha256(said.encode()).hexdigest() if na else "", said) for of, na, nb, n, p, said in want)
    got = alignment.align(docs(spark, few).repartition(3), A, B, keep_groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert Counter(map(tuple, got.collect())) == expected
    assert alignment.align(docs(spark, few).limit(0), A, B).count() == 0
    assert alignment.align(docs(spark, [(1, None), (2, "")]), A, B).select("n_links", "groups_sha256").collect() == [(0, ""), (0, "")]


def test_alignment_of_several_blocks(spark, texts, monkeypatch):
    one = Counter(map(tuple, alignment.align(docs(spark, texts).coalesce(1), A, B).collect()))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1000)
    assert Counter(map(tuple, alignment.align(docs(spark, texts), A, B).collect())) == one


def test_labels_of_long_chains():
    """A group of 2,000 tokens, no two of which end together before its end."""
    a, b = np.arange(1, 1001) * 2, np.append(np.arange(1, 1001) * 2 - 1, 2000)
    group_a, group_b, first, count = alignment.group_labels(a, b)
    assert set(group_a) == set(group_b) == {1000} and count.sum() == 2000 and first[0] == 0


BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def repaired(rows):
    """Cheapest repair of rows of one conversation: best (cost, audit) per place, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = BLANK.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    least = lambda options: min(options, key=lambda x: x[:2])

    def insert(best):
        for _ in range(3):
            for p, (cost, audit, lines) in list(best.items()):
                c = "a" if p == "u" else "u"
                option = (cost + 3, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[c]])
                best[c] = least([best[c], option]) if c in best else option
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def put(place, option):
            after[place] = least([after[place], option]) if place in after else option

        for p, (cost, audit, lines) in insert(best).items():
            put(p, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] and role[:1] in follow[p]:
                put(role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            c = "a" if p == "u" else "u"
            put(c, (cost + 3 + more, audit + "R", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[c]}:{text}"]))
        best = after
    cost, audit, lines = least([x for p, x in insert(best).items() if p in ("", "a")])
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    return (turns and max(turns) - min(turns) + 1 - len(set(turns)) or 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def want_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {k: repaired(x) for k, x in groups.items()}


def talk(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usher", " "]
    texts = ["Yes.", "No!", "And then", "", " \t", "ok?  ", None, "a. ", "b. ", "Long. " * 50]
    return [(c if c else None, rng.choice([i, i, rng.randint(0, 5), None]), rng.choices(roles, [9, 9, 4, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.7 else f"text {i}.") for c in range(conversations) for i in range(rng.randint(1, longest))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, "a") for r in rows], "conv_id long, turn long, role string, text string, audit string, seq long, copies long, kind long, lines string").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_conversations(spark, seed):
    rows = talk(seed)
    rows += rows[::9]
    broken = conversations.damage(frame(spark, rows))
    assert Counter(map(tuple, broken.collect())) == Counter(damaged(rows))
    for input_rows, df in ((damaged(rows), broken), (rows, frame(spark, rows))):
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in input_rows]
        assert {r[0]: tuple(r)[1:] for r in conversations.repair(df).collect()} == want_of(plain)


def test_long_runs_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_BYTES", 500)
    rng = random.Random(1)
    rows = [(1, i, "user", f"same side {i}.") for i in range(700)] + [(1, 700, "user", "copy.")] * 300
    rows += [(1, 800 + i, "assistant" if i % 7 else "tool", "cut off %d" % (i // 2)) for i in range(300)]
    rows += [(2, rng.randint(0, 9), rng.choice(["user", "assistant"]), rng.choice(["", "a.", "b."])) for _ in range(400)]
    got = conversations.repair(frame(spark, rows), keep_lines=True).collect()
    assert {r[0]: tuple(r)[1:-1] for r in got} == want_of(rows)
    for r in got:
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.lines).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in r.lines))


def test_powers_are_repeated_steps():
    t = conversations.Transitions()
    for symbol in range(16):
        after = conversations.END
        for n in range(1, 40):
            after = t.back(symbol, 1, after)
            assert t.back(symbol, n, conversations.END) == after


def test_conversation_query(spark, tmp_path):
    rows = [*talk(9), *[(1000 + i, 0, "user", "alone.") for i in range(60)]]
    frame(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, str(tmp_path)).collect()}
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = want_of(damaged(rows))
    assert got == {c: want.get(c, gone) for c in {r[0] for r in rows}} and gone in got.values()
    assert conversations.repair(frame(spark, rows).limit(0)).count() == 0
