"""The pipeline's stages, each held against what the one before kept."""

from __future__ import annotations

from collections import Counter

from tests.conftest import SMALL

import corpus_pipeline
from riskloom.llm import exact_dedup, mixing, near_dedup

DOCS = "doc_id long, text string, lang string, source string"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    best = {}
    for r in kept["toxicity"]:
        text = r.text.translate({c: c + 32 for c in range(65, 91)})
        best[text] = max(best.get(text, -1), r.doc_id)
    assert {r.doc_id for r in kept["exact dedup"]} == set(best.values())
    sets = {}
    for r in kept["exact dedup"]:
        words = r.text.translate({c: c + 32 for c in range(65, 91)}).split()
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    left = sorted(r.doc_id for r in kept["near dedup"])
    for i, a in enumerate(left):
        for b in left[:i]:
            x, y = sets[a], sets[b]
            assert 100 * len(x & y) < 80 * len(x | y)
    assert {r.doc_id for r in kept["mixing"]} <= set(left)
    assert sorted(r.doc_id for r in kept["bpe"]) == sorted(r.doc_id for r in kept["mixing"])


def held(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_copies_go_by_row(spark):
    rows = [(7, "A", None, "s"), (7, "B", None, "s"), (9, "b", None, "s"), (None, "c", "x", None), (None, "C", None, "x"), (None, "d", None, "s")]
    docs = spark.createDataFrame(rows + [rows[5], (7, "e", None, "s"), (7, "e", None, "s")], DOCS)
    got = held(exact_dedup.drop_copies(docs))
    assert got - Counter({rows[3]: 1, rows[4]: 1}) == Counter({rows[0]: 1, rows[2]: 1, rows[5]: 1, (7, "e", None, "s"): 1})
    assert sum(got.values()) == 5
    small = held(exact_dedup.drop_copies(docs, keep="smallest"))
    assert rows[1] in small and rows[2] not in small and rows[0] in small and sum(small.values()) == 5


def test_near_copies_go_by_row(spark):
    base = [f"w{i}" for i in range(200)]
    near, other = " ".join([*base[:-1], "end"]), " ".join(f"v{i}" for i in range(60))
    far = " ".join(f"u{i}" for i in range(60))
    rows = [(1, " ".join(base), None, "s"), (5, near, None, "s"), (5, other, None, "s"), (3, far, None, "s"), (None, far, None, "s"), (6, None, None, "s"), (6, None, None, "s")]
    docs = spark.createDataFrame([*rows, (3, far, None, "t")], DOCS)
    assert [(r.component_id, r.kept) for r in near_dedup.near_duplicates(docs.where("doc_id = 5")).collect()] == [(5, True)] * 2
    got = held(near_dedup.drop_near_copies(docs))
    fars = {k: n for k, n in got.items() if k[0] == 3}
    assert sum(fars.values()) == 1
    assert got - Counter(fars) == Counter({rows[0]: 1, rows[2]: 1, rows[4]: 1, rows[5]: 2})


def test_copies_go_to_the_rows_the_mix_took(spark):
    rows = [(i % 3 or None, " ".join([f"w{i}"] * (1 + i // 8 % 5)), None, ("a", "b", None)[i % 3]) for i in range(240)]
    rows += [(i % 2 or None, f"x{i % 4}", None, "a") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    key = mixing.with_row_key(docs)
    want = Counter()
    lines = {(bytes(r["__llm_sha"]), r["__llm_row"]): tuple(r)[:4] for r in key.collect()}
    made = mixing.mix(key, key=mixing.ROW_KEY).collect()
    for r in made:
        want[lines[bytes(r["__llm_sha"]), r["__llm_row"]]] += r.copies
    assert {r.copies for r in made} >= {0, 1, 2}
    got = held(mixing.mixed_documents(docs))
    assert got == +want
    assert held(mixing.mixed_documents(docs.repartition(5, "text"))) == got
    assert sum(n * len(t[1].split()) for t, n in got.items()) == sum(r.taken for r in made)
