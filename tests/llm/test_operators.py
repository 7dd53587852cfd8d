"""Each corpus operator against a brute-force version, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from tokenizers import Tokenizer

from riskloom.llm import bpe, bwt, chat, exact_dedup, langid, mixing, near_dedup, repeats, sharding, topk_hash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size int, k int, run int"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def rows(*texts):
    return [(i, t, "en", f"s{i % 3}", None, "x", 1, 2, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, a very long text, ties, repeated rows and clashing columns."""
    found = rows("a b c d e f", None, "", "A B C d e f", "lone", "word " * 40_000, "é ü <|endoftext|> \x00")
    found += [found[0], (None, "without id", None, None, None, None, None, None, None), (50, "a b c d e f", None, None, None, None, None, None, None)]
    return spark.createDataFrame(found, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")


PER_DOCUMENT = {
    "language": lambda d, _: langid.identify(d),
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "repeats": lambda d, _: repeats.remove_repeats(d),
    "bpe": lambda d, _: bpe.encode_documents(d, VOCABULARY),
    "toxicity": toxicity.toxicity,
    "sharding": lambda d, _: sharding.shard_documents(d, 8),
    "exact": lambda d, _: exact_dedup.exact_duplicates(d),
    "mixing": lambda d, _: mixing.mix(d),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_odd_rows_come_back_one_by_one(odd, labels, name):
    got = sorted(str(r[0]) for r in PER_DOCUMENT[name](odd, labels).collect())
    assert got == sorted(str(r[0]) for r in odd.collect())


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_table(none, labels, name):
    assert PER_DOCUMENT[name](none, labels).collect() == []


@pytest.mark.parametrize("keep", [exact_dedup.drop_copies, near_dedup.drop_near_copies, mixing.mixed_documents])
def test_stages_keep_columns(odd, none, keep):
    assert keep(odd).columns == odd.columns
    assert keep(none).collect() == []


def test_exact_copies_keep_the_largest(odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert {(0, 50, 4, False), (3, 50, 4, False), (50, 50, 4, True), (1, 2, 2, False), (None, None, 1, True)} <= got
    assert sorted(r.doc_id or -1 for r in exact_dedup.drop_copies(odd).collect()) == [-1, 2, 4, 5, 6, 50]


def test_near_copies_by_brute_force(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(40):
        words = list(r.choice(texts).split())
        for _ in range(r.randrange(1, 4)):
            words[r.randrange(len(words))] = f"n{r.randrange(50)}"
        texts.append(" ".join(words))
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows(*texts), DOCS), words=4).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def test_a_group_just_below_the_bound_hands_on_no_pairs(spark, monkeypatch):
    r, n = random.Random(9), 800
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):  # most pairs share (396 - 50) of (396 + 50) shingles: 0.776
        words = list(base)
        for k, at in enumerate(r.sample(range(0, 400, 5), 5)):
            words[at + 2] = f"n{i}x{k}"
        texts.append(" ".join(words))
    texts += [texts[17] + " one more", texts[400].replace("w0 ", "") + " tail"]
    handed = {}
    plain = near_dedup.staged

    def counting(df, name):
        out = plain(df, name)
        handed[name] = max(out.count(), handed.get(name, 0))
        return out

    monkeypatch.setattr(near_dedup, "staged", counting)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            shared = len(x & y)
            if root[i] != root[j] and 100 * shared >= 80 * (len(x) + len(y) - shared):
                a, b = sorted((root[i], root[j]))
                root = [a if c == b else c for c in root]
    assert got == dict(enumerate(root)) and len(set(root)) < n
    assert handed["pairs"] <= near_dedup.BANDS * n and handed["open-classes"] <= near_dedup.BANDS * n and handed.get("rest-links", 0) <= n


def test_star_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    got = dict(near_dedup.star_components(spark.createDataFrame(edges, "u long, v long")).collect())
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)

    def least(x, seen):
        seen.add(x)
        for y in near[x] - seen:
            least(y, seen)
        return min(seen)

    assert got == {x: least(x, set()) for x in near if near[x] - {x}}


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for x in range(len(raw) - length + 1):
            if raw[x : x + length] in seen:
                gone[x : x + length] = b"\1" * length
            seen.add(raw[x : x + length])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_by_brute_force(spark):
    r = random.Random(5)
    base = "".join(r.choice("abc déf") for _ in range(3000))
    texts = ["".join(base[r.randrange(2800) :][: r.randrange(20, 260)] for _ in range(r.randrange(1, 9))) for _ in range(40)]
    texts += [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 300, "For " * 3000, base, base, "q" + base + "z" + base[500:]]
    got = [tuple(x[1:5]) for x in sorted(repeats.remove_repeats(spark.createDataFrame(rows(*texts), DOCS)).collect())]
    assert got == brute_repeats(texts, 100)


def test_a_phrase_between_many_surroundings(spark, monkeypatch):
    r = random.Random(9)
    around = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    phrase = "".join(r.choice("klmnop ") for _ in range(90))
    texts = ["".join(r.choice("xyz ") for _ in range(40)) + r.choice(around) + phrase + r.choice(around) + str(i) for i in range(300)]
    sizes = []
    monkeypatch.setattr(repeats, "BUCKET", 4000)
    settled = repeats._settled

    def spy(rows, key, length, bucket, total):
        sizes.extend(x.s for x in rows.groupBy("anchor", key.alias("h")).agg(repeats.F.sum(repeats.F.length("bytes")).alias("s")).collect())
        return settled(rows, key, length, bucket, total)

    monkeypatch.setattr(repeats, "_settled", spy)
    got = [tuple(x[1:5]) for x in sorted(repeats.remove_repeats(spark.createDataFrame(rows(*texts), DOCS)).collect())]
    assert got == brute_repeats(texts, 100)
    assert sizes and max(sizes) <= 4000  # what cannot be dealt apart fits a bucket


def test_merged_transforms_find_what_one_does():
    r = random.Random(2)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(5, 60))) for _ in range(50)]
    for depth in (3, 9, 20):
        seen, want = set(), []
        for s in strings:
            flags = []
            for x in range(len(s) - depth + 1):
                flags.append(s[x : x + depth] in seen)
                seen.add(s[x : x + depth])
            want.append(flags)
        for shard in (1, 100, 1 << 20):
            assert [x.tolist() for x in bwt.repeated(strings, depth, shard)] == want


def test_bpe_as_the_library(spark):
    texts = [None, "", "a<|endoftext|> b  <|endoftext|><|endoftext|>x", "   \n\n  hello    world  日本語 123½² I'll", " ", "a" * 5000 + " " * 3000, "\x85 \x1c y"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for x in bpe.encode_documents(spark.createDataFrame(rows(*texts), DOCS), VOCABULARY).collect():
        ids = tokenizer.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert x.ids == ids and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_best_fit_enters_the_tightest_bin():
    r = random.Random(4)
    weights = sorted((r.randrange(1, 90) for _ in range(300)), reverse=True)
    free = [r.randrange(100, 900) for _ in range(12)]
    want, left = [], list(free)
    for w in weights:
        fits = [(f, b) for b, f in enumerate(left) if f >= w]
        f, b = min(fits) if fits else max((f, b) for b, f in enumerate(left))
        left[b] -= w
        want.append(b)
    assert sharding.best_fit_decreasing(weights, free) == want


def test_shards_keep_groups_whole_and_sizes_near(spark):
    r = random.Random(6)
    docs = rows(*("t" * r.randrange(1, 200) for _ in range(400)))
    got = sharding.shard_documents(spark.createDataFrame(docs, DOCS), 4).collect()
    where, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for x in got:
        where[docs[x.doc_id][1]].add(x.shard)
        load[x.shard] += x.size
        slots[x.shard].append(x.slot)
    assert all(len(s) == 1 for s in where.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    fixed = sharding.shard_documents(spark.createDataFrame(docs, DOCS), capacity=9000).collect()
    load = defaultdict(int)
    for x in fixed:
        load[x.shard] += x.size
    assert max(load.values()) <= 9000


def test_nearest_codes_by_brute_force(spark):
    g = np.random.default_rng(1)
    vectors = g.normal(size=(150, 64))
    vectors[100:120] = vectors[0]
    table = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (201, [None] * 64)]
    df = spark.createDataFrame(table, "id long, vector array<double>")
    got = sorted(tuple(x) for x in topk_hash.nearest(df, df.where("id % 50 = 0"), 5).collect())
    bits = vectors > 0
    want = []
    for q in (0, 50, 100):
        d = (bits[q] != bits).sum(1)
        order = [i for i in np.lexsort((np.arange(150), d)) if i != q][:5]
        want += [(q, int(i), int(d[i]), n + 1) for n, i in enumerate(order)]
    assert got == sorted(want)


def test_a_value_that_most_codes_hold(spark, monkeypatch):
    monkeypatch.setattr(topk_hash, "BLOCK", 8)
    monkeypatch.setattr(topk_hash, "PAIRS", 32)
    rng = np.random.default_rng(3)
    vectors = np.where(rng.random((300, 64)) < 0.5, -1.0, 1.0)
    vectors[:200, :32] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vector array<double>")
    got = sorted(tuple(x) for x in topk_hash.nearest(df, df.where("id % 50 = 0"), 3).collect())
    want = []
    for q in range(0, 300, 50):
        d = (vectors != vectors[q]).sum(1).tolist()
        near = sorted((d[i], i) for i in range(300) if i != q)[:3]
        want += [(q, i, far, r + 1) for r, (far, i) in enumerate(near)]
    assert got == sorted(want)


def test_blocks_with_nothing_within_the_bound(spark):
    batch = pa.RecordBatch.from_pylist(
        [{"queries": [{"query": 0, "bound": 1}], "codes": [{"code": 7, "first": 1, "count": 1}]}],
        pa.schema([
            ("queries", pa.list_(pa.struct([("query", pa.int64()), ("bound", pa.int32())]))),
            ("codes", pa.list_(pa.struct([("code", pa.int64()), ("first", pa.int64()), ("count", pa.int32())]))),
        ]),
    )
    assert list(topk_hash._verify(3)(iter([batch]))) == []


def test_queries_and_cells_never_meet_in_the_driver(spark, monkeypatch):
    plans, staged = [], topk_hash.staged

    def seen(df, name):
        if name == "nearest-codes":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(topk_hash, "staged", seen)
    vectors = np.where(np.random.default_rng(4).random((400, 64)) < 0.5, -1.0, 1.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vector array<double>")
    assert topk_hash.nearest(df, df.where("id % 40 = 0"), 3).count() == 30
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "codes" not in line and " c#" in line.replace("[", " ")]
    assert len(joins) >= len(plans) > 1 and all("SortMergeJoin" in line for line in joins)


@pytest.mark.parametrize("codes", [0, 1, 500, 50_000, 15_000_000, 10**9])
def test_a_query_goes_to_few_cells_at_any_radius(spark, codes):
    widths = topk_hash._widths(codes)
    leading = topk_hash._leading(codes, widths)
    assert leading <= min(widths) and codes >> leading <= topk_hash.BLOCK
    for radius in range(max(widths) + 1):
        masks = spark.range(1).select(topk_hash._masks(leading, max(widths) - leading, radius)).first()[0]
        assert len(set(masks)) == len(masks) <= 1 << leading
    assert leading < 16  # so many masks are made in the driver


def test_layouts_meet_in_the_same_turns(spark):
    df = spark.createDataFrame(
        [
            (1, "hi <|end|>", "yo ~1", None, None, None, None),
            (2, None, None, "do", "it", "done", None),
            (3, None, None, "do", None, "done", None),
            (4, None, None, None, None, None, [("user", "hi <|end|>"), ("assistant", None)]),
            (5, None, None, None, None, None, None),
        ],
        "conv_id long, prompt string, response string, instruction string, input string, output string, messages array<struct<role:string,content:string>>",
    )
    turns = {x.conv_id: x for x in chat.canonical_turns(df).collect()}
    assert [turns[i].layout for i in range(1, 6)] == ["prompt", "instruction", "instruction", "messages", None]
    assert turns[2].turns[0].text == "do\nit" and turns[5].turns is None
    out = {x.conv_id: x for x in chat.read_back(chat.format_chats(chat.canonical_turns(df))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "hi <|end|>"), ("assistant", "yo ~1")]
    assert out[1].loss_text == "yo ~1" and out[4].loss_text == "" and 5 not in out
    assert chat.format_chats(chat.canonical_turns(df.limit(0))).collect() == []


def test_chats_without_optional_columns_or_texts(spark):
    df = spark.createDataFrame([(1, "do", "done"), (2, "do", None), (3, None, "done"), (4, None, None)], "conv_id long, instruction string, output string")
    formatted, rest = chat.format_table(df)
    out = {x.conv_id: [t.text for t in x.turns] for x in chat.read_back(formatted).collect()}
    assert out == {1: ["do", "done"], 2: ["do", ""], 3: ["", "done"]}
    assert rest.columns == df.columns and [tuple(x) for x in rest.collect()] == [(4, None, None)]
    df = spark.createDataFrame(
        [(1, "hi", None, [("user",)]), (2, "hi", None, None), (3, None, None, [("user",), (None,)]), (4, None, "yo", None), (5, None, None, [])],
        "conv_id long, prompt string, response string, messages array<struct<role:string>>",
    )
    formatted, rest = chat.format_table(df)
    out = {x.conv_id: [(t.role, t.text) for t in x.turns] for x in chat.read_back(formatted).collect()}
    assert out == {2: [("user", "hi"), ("assistant", "")], 3: [("user", ""), ("", "")], 4: [("user", ""), ("assistant", "yo")]}
    assert sorted(x.conv_id for x in rest.collect()) == [1, 5]


def test_mix_meets_targets(spark):
    r = random.Random(8)
    docs = [(i, "w " * r.randrange(0, 60), None, (None, "a", "b", "c")[i % 4 if i % 7 else 1], None, None, None, None, None) for i in range(1200)]
    got = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    assert all(0 <= x.taken <= 2 * x.size for x in got)
    taken, target = defaultdict(int), {}
    for x in got:
        key = docs[x.doc_id][3]
        taken[key] += x.taken
        target[key] = x.target
    assert abs(sum(target.values()) - 1.5 * sum(x.size for x in got)) < 1e-3
    assert all(abs(taken[k] - target[k]) <= 60 for k in target)


def test_languages_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.identify(df).join(df, "doc_id").where("held_out").select("lang", "lang_pred").collect()
    assert sum(a == b for a, b in both) >= 0.97 * len(both)


def test_toxicity_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    both = toxicity.toxicity(df, marks).join(marks, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert sum(a == b for a, b in both) >= 0.96 * len(both)
    assert sum(a and b for a, b in both) >= 0.85 * sum(a for a, _ in both)


def test_queries_against_sql(spark):
    from riskloom.llm.queries import QUERIES
    from tests.conftest import SMALL
    from tests.oracle import compare, connect

    duck = connect(SMALL)
    for name, (run, sql) in QUERIES.items():
        if sql is not None:
            assert compare(run(spark, SMALL), duck, sql) == [], name


# --- op1 and op5 by plain recomputation -------------------------------------------------
def test_languages_by_a_plain_version(spark):
    r = random.Random(21)
    alphabets = {"xa": "abcde ", "xb": "defgh ", "xc": "ghéçñ "}
    texts = [(i, "".join(r.choice(alphabets[k]) for _ in range(r.randrange(0, 60))), k, "s", 1) for i, k in enumerate(r.choices(list(alphabets), k=50))]
    texts[3] = (3, "123 !", "xa", "s", 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")

    def vector(text):
        grams, letters = defaultdict(int), "".join(c if c.isalpha() else " " for c in text.lower())
        if not letters.strip():
            return None
        spaced = " " + letters + " "
        spaced = "".join(c for i, c in enumerate(spaced) if i == 0 or c != " " or spaced[i - 1] != " ")
        for i in range(len(spaced) - 2):
            grams[spaced[i : i + 3]] += 1
        out = np.zeros(langid.DIMENSIONS)
        for gram, n in grams.items():
            a, b, c = (langid.letter_vector(0 if x == " " else ord(x)) for x in gram)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    sums = {}
    for i, text, lang, *_ in texts:
        if crc32(str(i).encode()) % 4 != 2 and (v := vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v / max(1e-9, np.linalg.norm(v))
    for row in langid.identify(docs).collect():
        v = vector(texts[row.doc_id][1])
        assert row.held_out == (crc32(str(row.doc_id).encode()) % 4 == 2)
        if v is None:
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) if v.any() else 0.0 for k, p in sorted(sums.items())}
        best = max(cosines, key=cosines.get)
        assert row.score == pytest.approx(max(0.0, cosines[best]), abs=1e-4)
        assert row.lang_pred == best or cosines[best] - cosines[row.lang_pred] < 1e-4


def test_long_varied_text_is_bundled_in_slices(monkeypatch):
    r = random.Random(22)
    packed, counts = langid.grams("".join(chr(0x4E00 + r.randrange(3000)) for _ in range(3000)))
    whole = langid.GramVectors().bundle(packed, counts)
    monkeypatch.setattr(langid, "SLICE", 100)
    monkeypatch.setattr(langid, "KNOWN_GRAMS", 500)
    vectors = langid.GramVectors()
    assert np.allclose(vectors.bundle(packed, counts), whole) and len(vectors.vectors) <= 1024


def test_toxicity_by_recomputation(spark, labels):
    r = random.Random(23)
    bad, mild = ["vile", "rotten", "wretch"], ["calm", "tree", "river", "stone", "you", "YOUR"]
    texts = [" ".join(r.choices(mild + (bad * 3 if i % 3 == 0 else []), k=r.randrange(1, 40))) + r.choice(["", "!!", " v1le", "?"]) for i in range(120)]
    docs = spark.createDataFrame(rows(*texts), DOCS)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    trees, weights = model.trees.trees, model.trees.treeWeights
    edges, levels = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    for row in toxicity.toxicity(docs, marks).collect():
        x = Vectors.dense(toxicity.features(texts[row.doc_id], model.lexicon))
        margin = sum(w * t.predict(x) for t, w in zip(trees, weights, strict=True))
        want = min(1.0, max(0.0, float(np.interp(1 / (1 + math.exp(-2 * margin)), edges, levels))))
        assert row.score == pytest.approx(want, abs=1e-9) and row.predicted == int(want >= 0.3)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "A" * 1_000_000, "a1" * 500_000, "vile you " * 100_000, "1" * 1_000_000, "é@" * 400_000])
def test_toxicity_of_a_megabyte_takes_linear_time(text):
    start = time.perf_counter()
    toxicity.features(text, {"vile": 5.0})
    assert time.perf_counter() - start < 3


def test_nearest_by_brute_force():
    r = random.Random(24)
    for _ in range(100):
        a, b = (sorted(r.sample(range(60), r.randrange(1, 12))) for _ in range(2))
        assert toxicity._nearest(np.array(a), np.array(b)) == [min(abs(x - y) for y in b) for x in a]


def test_shards_beside_a_group_above_an_equal_share(spark):
    texts = ["x" * 300_000, *("y" * (900 + i % 500) + str(i) for i in range(700))]
    got = sharding.shard_documents(spark.createDataFrame(rows(*texts), DOCS), 8).groupBy("shard").sum("size").collect()
    sizes = sorted(x[1] for x in got)
    assert len(sizes) == 8 and sizes[-1] == 300_001 and sizes[-2] - sizes[0] < 0.02 * sizes[0]


def test_capacities():
    assert sharding.capacities([50, 30, 10], 100, 3) == [50, 30, 20]
    assert sharding.capacities([10, 10, 10], 30, 3) == [10, 10, 10]
    assert sharding.capacities([100], 100, 1) == [100] and sharding.capacities([], 0, 2) == [1, 1]
