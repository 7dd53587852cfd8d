"""Near duplicates: MinHash bands, verification on full sets, star-contracted components.

1. One pass over the texts gives each document the number of its distinct shingles, two
   hashes of the whole set, and ``BANDS * ROWS`` universal hash minima, as band keys.
   Documents with the same set are one class from here on.
2. Classes that share a band key are candidates. At a similarity of 0.8 a pair shares none
   of 28 bands of 4 rows with a probability of 4e-7.
3. Signatures are verified first: within a bucket, blocks of ``BLOCK`` classes meet block by
   block, and only pairs of different components whose signatures agree well enough are
   handed on (a pair at 0.8 falls short with a probability of 3e-6). Those are confirmed on
   the full shingle sets of their texts.
4. Not all pairs of a group are confirmed. First a class brings its most promising partner per
   pair of blocks; confirmed links are contracted to components, and what lies in one component
   is not looked at again. Classes that still have a promising partner in another component then
   bring their full shingle sets into the buckets: blocks of ``BLOCK_BYTES`` meet block by block,
   every pair of components is compared in full by an index of the shingles, and a spanning
   forest of the links is handed on, so that what leaves a task stays below its rows even where
   a large group is all but alike.
5. Components come from alternating large-star and small-star steps on the edges.

Defined cases: a null text or one without words has no shingles, is linked with nothing and
is kept; a text with fewer words than a shingle is one shingle of all of them; a null doc_id
takes no part, has a null component and is kept; rows that share a doc_id but not the text
are documents of their own, in the order of the text's SHA-256; rows that share both are one,
returned by ``near_duplicates`` as often as they come; an empty table gives an empty result;
other columns are ignored, or kept by ``drop_near_copies``, but names that begin with ``__llm_`` are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ROW_KEY, arrow_rows, keyed, staged, with_row_key
from riskloom.llm.shingles import minima, mix, shingle_sets, slices

BANDS, ROWS = 28, 4
SLACK = 0.17  # signature agreement may lie this far below the similarity
BLOCK = 1024
BLOCK_BYTES = 2 << 20  # of the sets of one block


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                sets = shingle_sets(data, offsets, words)
                low = minima(sets, BANDS * ROWS)
                keys = np.zeros((len(sets), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + low[:, r::ROWS] + np.uint64(0x51ED270B))
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                empty = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        batch.column(2).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                        pa.array([None if e else k for e, k in zip(empty, keys, strict=True)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in low.astype(np.uint8)], pa.binary()),
                        pa.array([x.tobytes() for x in keys.astype(np.uint32)], pa.binary()),
                    ],
                    names=["id", "doc_id", "n_shingles", "sum1", "sum2", "keys", "sketch", "bands"],
                )

    return run


def _confirm(words: int, similarity: int):
    """Pairs (u, v, text_u, text_v) that share ``similarity`` percent of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                [s for _, data, offsets in slices(batch.column(c)) for s in shingle_sets(data, offsets, words)] for c in (2, 3)
            )
            good = []
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if len(x) and len(y):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= similarity * (len(x) + len(y) - shared):
                        good.append(i)
            pick = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick)], names=["u", "v"])

    return run


def star_components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) for the nodes of ``edges`` (u, v)."""
    one = F.greatest("u", "v"), F.least("u", "v")
    edges = staged(edges.where("u <> v").select(one[0].alias("u"), one[1].alias("v")).distinct(), "star-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node move to its least neighbour
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), "large-star")
        # small star: a node and its lower neighbours move to the least of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lower, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "small-star")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = new


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members (key, id, n, component) with the components that ``links`` (u, v) make."""
    m, c = members.alias("m"), star_components(links).alias("c")
    joined = m.join(c, F.col("m.id") == F.col("c.node"), "left")
    return staged(joined.select("m.key", "m.id", "m.n", F.coalesce("c.component", "m.id").alias("component")), "members")


def _promising(similarity: int, best: bool):
    """Pairs of blocks (a, b) to classes of different components whose signatures agree.

    ``best``: each class with the most alike partner (u, v). Otherwise the classes alone (key,
    id) that have a partner, each pair in the first of the bands it shares only.
    """
    least = similarity / 100 - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            for i in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = batch.column(c)[i].values
                    sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(rows), BANDS * ROWS)
                    bands = np.frombuffer(b"".join(rows.field("bands").to_pylist()), np.uint32).reshape(len(rows), BANDS)
                    sides.append([np.asarray(rows.field(f)) for f in ("id", "component", "n")] + [sketch, bands])
                (ia, ca, na, sa, ka), (ib, cb, nb, sb, kb) = sides
                here = int((ka[0] == np.uint32(batch.column(2)[i].as_py() & 0xFFFFFFFF)).argmax())
                for low in range(0, len(ia), 64):
                    part = slice(low, low + 64)
                    small, large = np.minimum(na[part, None], nb), np.maximum(na[part, None], nb)
                    open_pairs = (ca[part, None] != cb) & (100 * small >= similarity * large)
                    if not open_pairs.any():
                        continue
                    cols = np.flatnonzero(open_pairs.any(0))
                    alike = (sa[part, None] == sb[cols]).mean(2, dtype=np.float32)
                    alike[~open_pairs[:, cols] | (alike < least)] = -1
                    if best:
                        x = np.flatnonzero(alike.max(1) >= 0)
                        y = alike[x].argmax(1)
                    else:
                        x, y = np.nonzero(alike >= 0)
                    y = cols[y]
                    if not best:
                        new = ~(ka[low + x, :here] == kb[y, :here]).any(1)
                        x, y = x[new], y[new]
                    if best:
                        found.append((np.minimum(ia[low + x], ib[y]), np.maximum(ia[low + x], ib[y])))
                    else:
                        open_ids = np.unique(np.concatenate([ia[low + x], ib[y]]))
                        found.append((np.full(len(open_ids), batch.column(2)[i].as_py(), np.int64), open_ids))
            if found:
                u, v = (np.concatenate(z) for z in zip(*found, strict=True))
                u, v = np.unique(np.stack([u, v]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"] if best else ["key", "id"])

    return run


def _candidates(members: DataFrame, sketches: DataFrame, similarity: int, best: bool) -> DataFrame:
    """u, v: pairs of classes of different components that may be alike; or key, id of such classes."""
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = sizes.where("lo <> hi").select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rows = members.join(mixed, "key").join(sketches, "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    blocks = staged(rows.groupBy("key", block).agg(F.collect_list(F.struct("id", "component", "n", "sketch", "bands")).alias("rows")), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block"))).select(F.col("a.rows").alias("a"), F.col("b.rows").alias("b"), F.col("a.key").alias("key"))
    return met.mapInArrow(_promising(similarity, best), "u bigint, v bigint" if best else "key bigint, id bigint").distinct()


def _sets(words: int):
    """id and the sorted hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                found = pa.array([x.tobytes() for x in shingle_sets(data, offsets, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), found], names=["id", "hashes"])

    return run


class _Index:
    """Which sets hold a hash."""

    def __init__(self, sets: list[np.ndarray]):
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.n = hashes[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], len(sets)

    def shared(self, one: np.ndarray) -> np.ndarray:
        """Hashes that each of the sets shares with this one."""
        low, high = np.searchsorted(self.hashes, one, "left"), np.searchsorted(self.hashes, one, "right")
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.owner[at], minlength=self.n)


def _forest(similarity: int):
    """Pairs of blocks (a, b) with full sets to links (u, v) that join their components, as few as that takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for i in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    rows = batch.column(c)[i].values
                    hashes = [np.frombuffer(x, np.uint64) for x in rows.field("hashes").to_pylist()]
                    sides.append((np.asarray(rows.field("id")), np.asarray(rows.field("component")), np.array([len(x) for x in hashes]), hashes))
                (ia, ca, na, sa), (ib, cb, nb, sb) = sides
                index = _Index(sb)
                names, codes = np.unique(np.concatenate([ca, cb]), return_inverse=True)
                root, cb = np.arange(len(names)), codes[len(ca) :]
                for x in range(len(ia)):
                    shared = index.shared(sa[x])
                    alike = 100 * shared >= similarity * (na[x] + nb - shared)
                    mine = root[codes[x]]
                    for y in np.flatnonzero(alike & (root[cb] != mine)):
                        if root[cb[y]] != mine:
                            links.append((min(ia[x], ib[y]), max(ia[x], ib[y])))
                            root[root == root[cb[y]]] = mine
            u, v = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _rest(members: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """u, v: links that join all components which the buckets link, confirmed on full sets."""
    spark = members.sparkSession
    waiting = staged(_candidates(members, sketches, similarity, best=False), "open-classes")
    wanted = waiting.select("id").distinct()
    sets = staged(texts.select("id", "text").join(wanted, "id", "left_semi").mapInArrow(_sets(words), "id bigint, hashes binary"), "open-sets")
    rows = members.join(waiting, ["key", "id"])
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(8 * F.col("n")) / BLOCK_BYTES).alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
    blocks = staged(rows.groupBy("key", "block").agg(F.collect_list(F.struct("id", "component", "hashes")).alias("rows")), "set-blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block"))).select(F.col("a.rows").alias("a"), F.col("b.rows").alias("b"))
    arrow_rows(spark, 8)  # a row is two blocks
    found = staged(met.mapInArrow(_forest(similarity), "u bigint, v bigint").distinct(), "rest-links")
    arrow_rows(spark)
    return found


def _components(docs: DataFrame, words: int, similarity: int) -> tuple[DataFrame, DataFrame | None]:
    """id, doc_id, n_shingles, component_id, kept; and the documents (id, text, doc_id) unless id is doc_id."""
    spark = docs.sparkSession
    arrow_rows(spark)
    numbered, unique = keyed(docs)
    numbered = numbered.select(F.when(F.col("doc_id").isNotNull(), F.col("k")).alias("id"), "text", "doc_id")
    sig = staged(
        numbered.mapInArrow(
            _signatures(words), "id bigint, doc_id bigint, n_shingles bigint, sum1 bigint, sum2 bigint, keys array<bigint>, sketch binary, bands binary"
        ),
        "signatures",
    )
    known = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["n_shingles", "sum1", "sum2"]
    classes = staged(known.groupBy(*same).agg(F.min(F.struct("id", "doc_id", "keys", "sketch", "bands")).alias("r")).select(*same, "r.id", "r.doc_id", "r.keys", "r.sketch", "r.bands"), "set-classes")
    rows = classes.select(F.explode("keys").alias("key"), "id", F.col("n_shingles").alias("n"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = staged(rows.join(shared, "key").withColumn("component", F.col("id")), "members")
    wanted = members.select("id").distinct().alias("w")
    d = numbered.select("id", "text").alias("d")
    texts = d.join(wanted, F.col("d.id") == F.col("w.id"), "left_semi")
    texts = staged(texts.dropDuplicates(["id"]), "candidate-texts")
    sketches = classes.select("id", "sketch", "bands")
    links = None

    def joined(more: DataFrame) -> None:
        nonlocal members, links
        if not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            members = _relabel(members, links)

    pairs = staged(_candidates(members, sketches, similarity, best=True), "pairs")
    if not pairs.isEmpty():
        x = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("tv")), "v")
        x = x.join(texts.select(F.col("id").alias("u"), F.col("text").alias("tu")), "u")
        joined(staged(x.select("u", "v", "tu", "tv").mapInArrow(_confirm(words, similarity), "u bigint, v bigint"), "confirmed"))
    joined(_rest(members, sketches, texts, words, similarity))
    found = members.select("id", "component").distinct().alias("f")
    c = classes.alias("c")
    labelled = staged(
        c.join(found, F.col("c.id") == F.col("f.id"), "left").select(
            *[f"c.{k}" for k in same], F.coalesce("f.component", "c.id").alias("component")
        ),
        "set-components",
    )
    if unique:
        labelled = labelled.withColumn("component_id", F.col("component"))
    else:
        labelled = labelled.join(classes.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id")), "component")
    s, lab = sig.alias("s"), labelled.alias("l")
    linked = F.col("s.doc_id").isNotNull() & (F.col("s.n_shingles") > 0)
    out = s.join(lab, [F.col(f"s.{k}") == F.col(f"l.{k}") for k in same], "left").select(
        "s.id", "s.doc_id", "s.n_shingles",
        F.when(linked, F.col("l.component_id")).otherwise(F.col("s.doc_id")).alias("component_id"),
        (~linked | F.col("s.id").eqNullSafe(F.col("l.component"))).alias("kept"),
    )
    return out, None if unique else numbered


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _components(docs, words, similarity)[0].drop("id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: int = 80) -> DataFrame:
    """The documents with one left of each component, all columns as they were."""
    found, numbered = _components(docs, words, similarity)
    found = staged(found, "near-duplicates")
    if numbered is None:
        d, k = docs.alias("d"), found.where("kept").select("doc_id").alias("k")
        return d.join(k, F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("k.doc_id")), "left_semi")
    # Rows that share their doc_id: what goes, and what has copies, is told by doc_id and text.
    numbers = found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("id").agg(F.max("kept").alias("kept"))
    marked = with_row_key(docs)
    named = numbered.where("doc_id IS NOT NULL").select("id", "doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    stays = staged(named.distinct().join(numbers, "id").select("doc_id", "sha", "kept"), "linked-documents")
    m, n = marked.alias("m"), stays.alias("n")
    own = (F.col("m.doc_id").cast("bigint") == F.col("n.doc_id")) & (F.col("m.__llm_sha") == F.col("n.sha"))
    alone = m.join(n, own, "left_anti")
    one = m.join(n.where("kept"), own, "left_semi")
    # of rows that share doc_id and text, the one with the least hash of its columns
    least = one.groupBy("doc_id", "__llm_sha").agg(F.min("__llm_row").alias("__llm_row")).select(*ROW_KEY)
    one = one.join(least, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return alone.unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
