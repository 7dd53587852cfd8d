"""Hard negatives, importance resampling and token files against brute force, and on odd input."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import hard_negatives, importance, prefix_crc, simple8b, token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, n long, crc int, row string, words int, rank int, score int, part int"
VECTORS = "vec_id long, vector array<double>, label int, anchor string, score int, key int, window string"


# --- hard negatives -----------------------------------------------------------------
def brute_negatives(rows, is_anchor, positives=5, per=5):
    ok = {
        (i, y, tuple(math.floor(256 * x) for x in v))
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    last = float("inf")

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for i, y, v in ok:
        if i is None or not is_anchor(i):
            continue
        near = sorted({(-dot(v, w), last if j is None else j, z == y) for j, z, w in ok if j != i})
        for s, j, _ in [n for n in near if n[2]][:positives]:
            mined = [(t, k) for t, k, same in near if not same and t >= s and 100 * -t >= 80 * -s][:per]
            out += [(i, None if j == last else j, r, None if k == last else k, -s, -t) for r, (t, k) in enumerate(mined, 1)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], VECTORS).repartition(5)
    return Counter(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()))


def vectors(seed, n, d=6, labels=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(labels, d))
    return [(i, (centre[i % labels] + r.normal(size=d)).tolist(), i % labels) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"anchor_bytes": 500}])
def test_hard_negatives_by_brute_force(spark, options):
    rows = vectors(1, 300)
    rows += [(400 + i, rows[7][1], i % 3) for i in range(80)]  # one vector very often: ties in every window
    assert mined(spark, rows, **options) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors(2, 60)
    rows += rows[:30] + [(None, rows[3][1], 0), (None, rows[4][1], 1), (10, rows[5][1], 2), (10, rows[6][1], 0)]
    rows += [(70, None, 1), (80, rows[0][1], None), (90, [1.0, None], 1), (100, [1.0, float("nan")], 1), (110, [float("-inf")], 1)]
    rows += [(120, [], 1), (130, rows[9][1][:2], 0), (140, [1e6, -1e6, 3e5], 1), (150, [1.1e6, -1e6], 2), (151, [9e5, -9e5], 1)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_no_vectors_no_negatives(spark):
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])


def test_keys_sort_like_their_parts():
    r = random.Random(4)
    big = hard_negatives.LONG
    parts = [(r.randrange(3), r.choice([-big, -1, 0, 1, big]), r.randrange(2), r.choice([-big - 1, -2, 0, 5, big])) for _ in range(300)]
    keys = sorted(hard_negatives.pack_key(*p) for p in parts)
    assert [hard_negatives.unpack_key(k) for k in keys] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_pairs_grow_with_the_anchors_not_with_anchors_times_rows(spark, monkeypatch):
    handed = []
    keys = hard_negatives._Block.keys

    def counting(self, *args):
        found = keys(self, *args)
        handed.append(found.count())
        return found

    monkeypatch.setattr(hard_negatives._Block, "keys", counting)
    mined(spark, vectors(5, 4000))
    # 400 anchors and 4000 rows, 1.6 million pairs: what the last pass hands on stays near 8 x 5 x 5 an anchor
    assert handed[-1] < 400 * 5 * 5 * 8


# --- importance resampling -----------------------------------------------------------
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def buckets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target):
    s, t = (Counter(b for x in texts for b in buckets_of(x)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, x in docs:
        found = buckets_of(x)
        u = (int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(found) >= 57])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(order[: len(order) * 5 // 100], 1):
        r[4] = place
    return [(*r[:4], None if isinstance(r[4], bool) else r[4]) for r in out]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", 1, 2, "r", 3, 4, 5, 6) for i, t in docs], DOCS).repartition(3)


def texts(seed, n, longest=80):
    r = random.Random(seed)
    return [(i, " ".join(f"{r.choice(['a', 'Bé', 'c9', '漢'])}{int(r.expovariate(0.05))}{r.choice(['', ',', '. '])}" for _ in range(r.randrange(longest)))) for i in range(n)]


def test_resampling_by_brute_force(spark):
    docs = texts(6, 400)
    docs += [(500, None), (501, ""), (502, "?!"), (None, docs[9][1] * 3), (7, docs[7][1]), (7, docs[8][1])]
    target = [t for _, t in texts(7, 20)] + [None, ""]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in importance.resample(frame(spark, docs), goal).collect()]
    assert sorted(got, key=str) == sorted(brute_resample(docs, target), key=str)
    drawn = importance.drawn_documents(frame(spark, docs), goal)
    assert sorted(r["rank"] for r in drawn.collect()) == list(range(1, drawn.count() + 1))


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), goal).collect() == []
    docs = [(None, "word " * 30)] * 100
    got = importance.resample(frame(spark, docs), goal).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0] * 95 + [1, 2, 3, 4, 5]
    assert len({(r["n_features"], r["weight"], r["score"]) for r in got}) == 1


@pytest.mark.parametrize("piece", [1 << 20, 37])
def test_buckets_of_whole_texts(monkeypatch, piece):
    monkeypatch.setattr(prefix_crc, "PIECE", piece)
    r = random.Random(8)
    some = [t for _, t in texts(9, 60)] + ["", " ", "x" * 5000, " ".join("y" * r.randrange(1, 900) for _ in range(40))]
    found = prefix_crc.feature_buckets([t.encode() for t in some], 10_000)
    assert [sorted(f.tolist()) for f in found] == [sorted(buckets_of(t)) for t in some]


def test_crc_of_grams_from_prefixes():
    words = [b"ab", b"c" * 300, b"d", b"\xc3\xa9" * 70_000, b"e"]
    for n, crcs in enumerate(prefix_crc.gram_crcs(words, 5), 1):
        assert crcs.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(6 - n)]


# --- token files ---------------------------------------------------------------------
def test_words_of_any_numbers_come_back():
    r = np.random.default_rng(10)
    for _ in range(200):
        lengths = r.integers(0, 150, r.integers(1, 8))
        bits = r.integers(0, 65, lengths.sum()) if r.random() < 0.5 else np.full(lengths.sum(), r.integers(0, 65))
        numbers = np.array([int(r.integers(0, 1 << 62)) * 4 + 3 >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
        words, word_ends, escapes, escape_ends = simple8b.pack(numbers, np.cumsum(lengths))
        # runs strung together, as files hold them
        parts, a, e = [], 0, 0
        for b, f in zip(word_ends, escape_ends, strict=True):
            parts.append(simple8b.moved(words[a:b], e))
            a, e = b, f
        content = simple8b.to_file(2, 9, list(range(len(lengths))), lengths, np.concatenate(parts), escapes)
        coded = simple8b.from_file(content)
        assert np.array_equal(coded.numbers(), numbers)
        a, b = sorted(r.integers(0, len(numbers) + 1, 2))
        assert np.array_equal(coded.between(a, b), numbers[a:b])


def test_few_bits_share_a_word():
    assert len(simple8b.pack(np.ones(600, np.uint64), np.array([600]))[0]) == 10
    assert len(simple8b.pack(np.full(600, 30_000, np.uint64), np.array([600]))[0]) == 150


def test_blocks_are_read_alone(monkeypatch):
    numbers = np.random.default_rng(11).integers(0, 40_000, 50_000).astype(np.uint64)
    words, _, escapes, _ = simple8b.pack(numbers, np.array([50_000]))
    coded = simple8b.from_file(simple8b.to_file(0, 0, [1], np.array([50_000]), words, escapes))
    seen = []
    unpack = simple8b.unpack
    monkeypatch.setattr(simple8b, "unpack", lambda w, e: seen.append(len(w)) or unpack(w, e))
    assert np.array_equal(coded.between(30_000, 30_010), numbers[30_000:30_010])
    assert seen[0] <= 2 * simple8b.BLOCK_WORDS < len(words)


def test_a_damaged_file_is_refused():
    content = bytearray(simple8b.to_file(0, 0, [1], np.array([1]), *(simple8b.pack(np.array([5], np.uint64), np.array([1]))[i] for i in (0, 2))))
    content[-9] ^= 1
    with pytest.raises(ValueError):
        simple8b.from_file(bytes(content))


def expected_files(docs):
    library = Tokenizer.from_file(VOCABULARY)
    coded = []
    for i, t in docs:
        raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        coded.append((i is not None, i or 0, zlib.crc32((t or "").encode()), zlib.crc32(raw), len(raw) // 4))
    out, start = [], 0
    for known, i, _, crc, n in sorted(coded):
        out.append((i if known else None, start, n, crc))
        start += n
    return out


def test_token_files_against_the_library(spark):
    r = random.Random(12)
    odd = ["a", "B", "é", "é", " ", "\n", "\x1c", "\x1f", "\x85", "\xa0", "　", "'s", "12", "Σς", "<|endoftext|>", "|>", "́", "ﬁ", "漢", "😀", "\x00", "İ"]
    docs = [(3 * i % 301, "".join(r.choice(odd) for _ in range(r.randrange(30)))) for i in range(301)]
    docs += [(400, None), (401, ""), (None, "no id"), (None, "nor this"), (5, "again"), (5, "again"), (402, "many words " * 30_000), (403, "z" * 20_000)]
    got = token_files.token_files(frame(spark, docs), VOCABULARY).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected_files(docs)


def test_words_give_the_ids_of_their_text():
    r, table = random.Random(14), token_files._Table(VOCABULARY)
    odd = ["a", "B", "é", "É", "ß", "ÿ", "ĳ", "é", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", "'s", "'S", "1", "²", "Σς", ".", ", ", "!?", "...", "_", "|",
           "ç###", "ø%%*", "x&!", "×.", "÷!", "<|endoftext|>", "<|EndOfText|>", "<|", "́", "ﬁ", "漢", "😀", "\x00", "İ", "K", "ŉ", "ǅ"]
    for _ in range(4000):
        text = "".join(r.choice(odd) for _ in range(r.randrange(14)))
        got = np.frombuffer(table.ids([text.encode()])[0], np.uint32).tolist()
        assert got == table.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_long_texts_in_pieces_and_many_files(spark, tmp_path, monkeypatch):
    docs = texts(13, 200, 300)
    folder = f"{tmp_path}/tokens"
    files = token_files.write_token_files(frame(spark, docs), VOCABULARY, folder, file_words=50)
    assert files.count() > 20
    assert sorted(p.name for p in (tmp_path / "tokens").iterdir()) == sorted(x["file"] for x in files.collect())
    (tmp_path / "tokens" / "part-999999-000000.s8b").write_bytes(b"left by another run")
    got = token_files.read_token_files(spark, files, folder).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == expected_files(docs)
    monkeypatch.setattr(token_files, "PIECE", 100)
    long = (docs[11][1] * 9).encode()
    assert len(list(token_files._pieces(long))) > 5
    table = token_files._Table(VOCABULARY)
    assert b"".join(table.ids([p])[0] for p in token_files._pieces(long)) == table.ids([long])[0]


def test_no_documents_no_files(spark):
    assert token_files.token_files(frame(spark, []), VOCABULARY).collect() == []
