"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

1. Every string of ``LENGTH`` bytes is filed under its anchor, the least hash among its
   32-byte grams (``anchors``). Neighbouring starts that share it are a run; a run's digest
   stands for all bytes its strings cover. An anchor that occurs once, and whose gram does not
   return within its run, can hold no repeated string and goes.
2. Of runs with the same anchor and digest all but the earliest are repeats as a whole.
   Counts are aggregated before they move, and the rows themselves meet these counts in
   joins that adaptive execution can split, so a passage may hold any share of the rows.
3. What differs between the distinct runs of an anchor is settled by their bytes: the runs
   are dealt by anchor into buckets of about ``BUCKET`` bytes, cut into shards whose
   transforms are merged (``bwt``); repeated intervals give the starts that come later.
   An anchor whose runs exceed a bucket has them cut into single starts, dealt by anchor and
   the first and last 32 bytes of their strings. Where even these exceed a bucket, strings
   are grouped by their bytes, aggregated before they move; no task holds a group.
4. A document loses every byte that a repeated string covers.

Defined cases: a null text is an empty one; repeated rows (same doc_id and text) are one
document, and each gets its result; rows that share a doc_id but not the text are ordered by
the text's SHA-256; a null doc_id comes before all others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.anchors import GRAM, runs
from riskloom.llm.bwt import repeated
from riskloom.llm.common import arrow_rows, keyed, staged
from riskloom.llm.shingles import slices

LENGTH = 100
BUCKET = 4 << 20


def _file(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                anchor, text, x, n, digest, loops = runs(data, offsets, length)
                # runs that the same text has had before
                order = np.lexsort((x, digest, anchor, text))
                same = np.r_[False, (text[order][1:] == text[order][:-1]) & (anchor[order][1:] == anchor[order][:-1]) & (digest[order][1:] == digest[order][:-1])]
                again = np.empty(len(text), bool)
                again[order] = same[: len(text)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), batch.column(0).take(pa.array(at + text)),
                        pa.array(x.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(loops), pa.array(again),
                    ],
                    names=["anchor", "digest", "k", "x", "n", "loops", "again"],
                )

    return run


def _count(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch.column(1)):
                anchor, _, _, _, _, loops = runs(data, offsets, length)
                if not len(anchor):
                    continue
                found, where, counts = np.unique(anchor, return_inverse=True, return_counts=True)
                some = np.bincount(where, loops, len(found)) > 0
                counts = np.minimum(counts + some, 2)  # a loop counts as a second occurrence
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["anchor", "c"])

    return run


def _cut(length: int, single: bool = False):
    """The bytes of the wanted runs of each text; ``single``: of each of their starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "k", "x", "bytes")}
            size = 0
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                k = batch.column(0)[i].as_py()
                for r in batch.column(2)[i].as_py():
                    n = 1 if single else r["n"]
                    for x in range(r["x"], r["x"] + r["n"], n):
                        out["anchor"].append(r["anchor"])
                        out["k"].append(k)
                        out["x"].append(x)
                        out["bytes"].append(raw[x : x + n + length - 1])
                        size += n + length
                        if size > BUCKET:
                            yield pa.RecordBatch.from_pydict(out, _CUT)
                            out, size = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, _CUT)

    return run


_CUT = pa.schema([("anchor", pa.int64()), ("k", pa.int64()), ("x", pa.int32()), ("bytes", pa.binary())])
_RUN = pa.schema([("k", pa.int64()), ("x", pa.int32()), ("n", pa.int32())])


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge[::2], edge[1::2]


def _settle(length: int):
    """Of a bucket's runs, the starts whose string also stands earlier."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("x", "ascending")])
        out: dict[str, list] = {"k": [], "x": [], "n": []}
        strings = table["bytes"].to_pylist()
        for k, x, flags in zip(table["k"].to_pylist(), table["x"].to_pylist(), repeated(strings, length), strict=True):
            for a, b in zip(*_spans(flags), strict=True):
                out["k"].append(k)
                out["x"].append(x + int(a))
                out["n"].append(int(b - a))
        return pa.Table.from_pydict(out, _RUN)

    return run


def _apply(length: int, want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i in range(batch.num_rows):
                raw = (batch.column(1)[i].as_py() or "").encode()
                gone = np.zeros(len(raw) + 1, np.int32)
                found = batch.column(2)[i].values
                if found is not None and len(found):
                    x, n = (np.asarray(found.field(c)) for c in ("x", "n"))
                    np.add.at(gone, x, 1)
                    np.add.at(gone, x + n - 1 + length, -1)
                flags = np.cumsum(gone[: len(raw)]) > 0
                a, b = _spans(flags)
                kept = np.frombuffer(raw, np.uint8)[~flags].tobytes()
                out["doc_id"].append(batch.column(0)[i].as_py())
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(flags.sum()))
                out["n_spans"].append(len(a))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"start": int(s), "stop": int(e)} for s, e in zip(a, b, strict=True)])
                out["kept"].append(kept if want_text else None)
            yield pa.RecordBatch.from_pydict(out, _OUT)

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN), ("kept", pa.binary())]
)


def repeated_starts(texts: DataFrame, length: int = LENGTH, bucket: int | None = None) -> DataFrame:
    """k, x, n: runs of starts whose ``length`` bytes also start earlier, for texts (k, text)."""
    bucket = bucket or BUCKET
    counts = texts.mapInArrow(_count(length), "anchor bigint, c bigint")
    several = staged(counts.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select("anchor"), "repeated-anchors")
    filed = texts.mapInArrow(_file(length), "anchor bigint, digest bigint, k bigint, x int, n int, loops boolean, again boolean")
    some = staged(filed.join(several, "anchor", "left_semi"), "filed-runs")
    once = some.where("NOT again")
    whole = staged(once.groupBy("anchor", "digest").agg(F.min("k").alias("k0"), F.max("loops").alias("loops")), "distinct-runs")
    open_anchors = whole.groupBy("anchor").agg(F.count("*").alias("d"), F.max("loops").alias("l")).where("d > 1 OR l").select("anchor")
    o, w = once.alias("o"), whole.alias("w")
    met = o.join(w, (F.col("o.anchor") == F.col("w.anchor")) & (F.col("o.digest") == F.col("w.digest")))
    met = staged(met.select("o.anchor", "o.k", "o.x", "o.n", (F.col("o.k") == F.col("w.k0")).alias("first")), "met-runs")
    copies = some.where("again").select("k", "x", "n").unionByName(met.where("NOT first").select("k", "x", "n"))
    wanted = staged(met.where("first").join(open_anchors, "anchor", "left_semi").select("anchor", "k", "x", "n"), "open-runs")
    by_anchor = staged(wanted.groupBy("anchor").agg(F.sum(F.col("n") + length).alias("size")), "open-anchors")
    total = by_anchor.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy = by_anchor.where(F.col("size") > bucket).select("anchor")
    if heavy.isEmpty():
        return staged(copies.unionByName(_dealt(_held(texts, wanted), length, bucket, total)).distinct(), "repeated-starts")
    light = _dealt(_held(texts, wanted.join(heavy, "anchor", "left_anti")), length, bucket, total)
    single = _heavy(_held(texts, wanted.join(heavy, "anchor", "left_semi")), length, bucket)
    return staged(copies.unionByName(light).unionByName(single).distinct(), "repeated-starts")


def _held(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """k, text, runs: the texts with their wanted runs."""
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("anchor", "x", "n")).alias("runs"))
    t, r = texts.alias("t"), lists.alias("r")
    return t.join(r, F.col("t.k") == F.col("r.k")).select("t.k", "t.text", "r.runs")


def _settled(rows: DataFrame, key, length: int, bucket: int, total: int) -> DataFrame:
    buckets = max(1, -(-total // bucket))
    dealt = rows.withColumn("bucket", F.pmod(key, F.lit(buckets)))
    settled = dealt.groupBy("bucket").applyInArrow(_settle(length), "k bigint, x int, n int")
    return staged(settled, "settled-runs")


def _dealt(held: DataFrame, length: int, bucket: int, total: int) -> DataFrame:
    """k, x, n: what repeats, of runs dealt by their anchor."""
    cut = held.mapInArrow(_cut(length), "anchor bigint, k bigint, x int, bytes binary")
    return _settled(cut, F.xxhash64("anchor"), length, bucket, total)


def _heavy(held: DataFrame, length: int, bucket: int) -> DataFrame:
    """k, x, n: what repeats, of the runs of anchors that exceed a bucket, by single starts."""
    cut = held.mapInArrow(_cut(length, single=True), "anchor bigint, k bigint, x int, bytes binary")
    ends = F.xxhash64("anchor", F.substring("bytes", 1, GRAM), F.substring("bytes", length - GRAM + 1, GRAM))
    starts = staged(cut.withColumn("ends", ends), "single-starts")
    sizes = staged(starts.groupBy("ends").agg((F.count("*") * (length + 1)).alias("size")), "ends")
    large = sizes.where(F.col("size") > bucket).select("ends")
    total = sizes.where(F.col("size") <= bucket).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    small = starts.join(large, "ends", "left_anti").select("ends", "anchor", "k", "x", "bytes")
    found = _settled(small, F.xxhash64("ends"), length, bucket, total)
    if large.isEmpty():
        return found
    rest = starts.join(large, "ends", "left_semi").select("anchor", "k", "x", "bytes")
    first = rest.groupBy("anchor", "bytes").agg(F.min(F.struct("k", "x")).alias("f"), F.count("*").alias("c")).where("c > 1")
    r, f = rest.alias("r"), staged(first, "first-starts").alias("f")
    same = (F.col("r.anchor") == F.col("f.anchor")) & (F.col("r.bytes") == F.col("f.bytes"))
    later = r.join(f, same).where((F.col("r.k") != F.col("f.f.k")) | (F.col("r.x") != F.col("f.f.x")))
    return found.unionByName(staged(later.select("r.k", "r.x", F.lit(1).alias("n")), "later-starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (bytes, null unless asked for)."""
    arrow_rows(docs.sparkSession)
    rows, unique = keyed(docs)
    texts = rows.select("k", "text")
    if not unique:
        texts = staged(texts.dropDuplicates(["k"]), "keyed-texts")
    starts = repeated_starts(texts, length)
    lists = starts.groupBy("k").agg(F.collect_list(F.struct("x", "n")).alias("runs"))
    d, s = rows.alias("d"), lists.alias("s")
    joined = d.join(s, F.col("d.k") == F.col("s.k"), "left").select("d.doc_id", "d.text", "s.runs")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept binary"
    return joined.mapInArrow(_apply(length, text), schema)
