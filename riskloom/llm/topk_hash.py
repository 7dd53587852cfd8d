"""Exact k nearest binary codes by incremental multi-index hashing.

A vector becomes a 64-bit code of signs. Codes are cut into segments of about log2(n / 16)
bits for n distinct codes; per segment an index maps a value to the codes that hold it. The
index lies in cells, which hold the values with the same leading bits. A query goes to the
cells that are near enough, and within a cell's task it probes all values at radius 0, then 1,
2, ...; what it meets is verified by the full Hamming distance. A code at distance d differs from the query by at most
d // segments bits in some segment, so after radius r all codes up to
``segments * (r + 1) - 1`` have been met: once k verified neighbours lie within that, they
are proven and the query leaves the rounds.

Copies never multiply work: the index holds each distinct code once, with the number of its
rows (up to k + 1) and their smallest identifier, and queries with the same code are one
query. Codes of a cell meet the queries as blocks of bounded size, spread over tasks however
many codes share a value; blocks are compared in numpy, which hands on the nearest k + 1 codes
per query only, none beyond the distance that is already certain. Queries and cells are joined
by a shuffle: the file that the queries come from says nothing of how many cells they go to, so
a join by its size could bring them all to the driver.

Defined cases: a null vector, or one with a null element, is neither indexed nor a query;
ties in distance go to the smaller identifier; a query never finds its own identifier but
does find copies; fewer than k other rows give fewer results; repeated rows of the same
identifier are one; an empty table gives an empty result; other columns are ignored, whatever
their names. Vectors of over 64 elements are
folded onto 64 signed sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, staged

BITS = 64
FILL = 16  # distinct codes that hold a segment value, on average
BLOCK = 1 << 16  # codes or queries that meet as one row
CELLS = 6  # leading bits of a cell, at least
PAIRS = 1 << 20  # compared at a time


def sign_code(vector: Column) -> Column:
    """A long whose bit j tells whether element j (of 64 at most) is above zero."""
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda j: F.aggregate(
            F.filter(vector, lambda _, i: F.pmod(i, F.lit(BITS)) == j),
            F.lit(0.0),
            lambda acc, x: -acc + x.cast("double"),
        ),
    )
    values = F.when(F.size(vector) <= BITS, F.transform(vector, lambda x: x.cast("double"))).otherwise(folded)
    bits = F.transform(values, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    whole = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()), whole)


def _widths(codes: int) -> list[int]:
    """Bits of each segment: a segment value is held by about ``FILL`` of the codes, at any number of them."""
    wide = min(32, max(4, (codes // FILL).bit_length()))
    segments = -(-BITS // wide)
    return [BITS // segments + (s < BITS % segments) for s in range(segments)]


def _leading(codes: int, widths: list[int]) -> int:
    """Bits of a segment that name a cell: cells hold half a block on average, at any number of codes."""
    return min(*widths, max(CELLS, (2 * codes // BLOCK).bit_length()))


def _by_cell(codes: DataFrame, widths: list[int], leading: int) -> DataFrame:
    """The rows once per segment, with its number s and the leading bits v of ``code`` in it."""
    ends = [sum(widths[: s + 1]) for s in range(len(widths))]
    values = [F.shiftrightunsigned("code", e - leading).bitwiseAND(F.lit((1 << leading) - 1)) for e in ends]
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), v.alias("v")) for s, v in enumerate(values)])
    return codes.select("*", F.explode(pairs).alias("_at")).select("*", "_at.s", "_at.v").drop("_at")


def _set_bits(width: int, radius: int) -> list[int]:
    """All values of so many bits with ``radius`` of them set."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def _masks(leading: int, rest: int, radius: int) -> Column:
    """Array of what the leading bits of values at the radius can differ by, with ``rest`` bits below them."""
    masks = [m for r in range(max(0, radius - rest), min(radius, leading) + 1) for m in _set_bits(leading, r)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


def _nearest(keep: int, q, code, first, rows, d) -> tuple[np.ndarray, ...]:
    """Of found codes the ``keep`` nearest per query, each once; the smaller identifier wins a tie."""
    order = np.lexsort((code, first, d, q))
    q, code, first, rows, d = (x[order] for x in (q, code, first, rows, d))
    if not len(q):
        return q, code, first, rows, d
    new = np.r_[True, (q[1:] != q[:-1]) | (code[1:] != code[:-1])]
    q, code, first, rows, d = (x[new] for x in (q, code, first, rows, d))
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    near = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < keep
    return tuple(x[near] for x in (q, code, first, rows, d))


def _verify(keep: int, radius: int = 0, widths: tuple[int, ...] = (), leading: int = 0):
    """Blocks of queries against blocks of a cell's codes: the nearest ``keep`` codes per query, within its bound.

    A query meets the codes whose value is ``radius`` bits away in segment s, where the cell has the leading bits v.
    Without segments it meets all codes.
    """
    rests = np.array([w - leading for w in widths] or [0])
    low = np.cumsum(widths or [0]) - (widths or [0])
    most = int(rests.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, known = batch.column(0), batch.column(1)
            q, bound = (np.asarray(asked.values.field(c)) for c in ("query", "bound"))
            code, first, rows = (np.asarray(known.values.field(c)) for c in ("code", "first", "count"))
            qa, ca = np.asarray(asked.offsets), np.asarray(known.offsets)
            block = np.repeat(np.arange(batch.num_rows), np.diff(qa))
            at, s, v = np.arange(qa[0], qa[-1]), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if widths:
                s, v = (np.asarray(batch.column(c)).astype(np.int64) for c in (2, 3))
            below = (1 << rests[s]) - 1

            def rest(x: np.ndarray, of: np.ndarray) -> np.ndarray:
                """What a cell's name leaves out of the values, under the cell's number."""
                return of << most | x >> low[s][of] & below[of]

            # the codes of a value lie side by side
            cell = rest(code[ca[0] : ca[-1]], np.repeat(np.arange(batch.num_rows), np.diff(ca)))
            order = np.argsort(cell, kind="stable") + ca[0]
            held = np.bincount(cell, minlength=batch.num_rows << most)
            start, place = np.cumsum(held) - held, rest(q[at], block)
            left_over = np.full(len(at), radius)
            if widths:
                ahead = q[at] >> (low[s] + rests[s])[block] & ((1 << leading) - 1)
                left_over -= np.bitwise_count(ahead ^ v[block])
            best: tuple[np.ndarray, ...] | None = None
            for wide, r in product({*rests.tolist()}, range(radius + 1)):
                those = np.flatnonzero((left_over == r) & (rests[s][block] == wide))
                masks = np.array(_set_bits(wide, r), np.int64)  # none where r is more than there are bits
                for i in range(0, len(those) if len(masks) else 0, step := max(1, PAIRS // max(1, len(masks)))):
                    some = those[i : i + step]
                    value = (place[some][:, None] ^ masks).ravel()
                    met = np.flatnonzero(held[value])
                    value, who = value[met], at[some][met // len(masks)]
                    n = held[value]
                    cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), "right")
                    a = 0
                    for b in np.unique(np.r_[cuts, len(n)]).tolist():
                        if b <= a:
                            continue
                        m = n[a:b]
                        left = np.repeat(who[a:b], m)
                        right = order[np.arange(len(left)) + np.repeat(start[value[a:b]] - np.r_[0, np.cumsum(m)[:-1]], m)]
                        d = np.bitwise_count((q[left] ^ code[right]).view(np.uint64))  # of signed values it counts the magnitude
                        good = d <= bound[left]
                        left, right = left[good], right[good]
                        found = q[left], code[right], first[right], rows[right], d[good].astype(np.int32)
                        best = _nearest(keep, *(found if best is None else (np.concatenate(x) for x in zip(best, found, strict=True))))
                        a = b
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query", "code", "first", "count", "distance"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, neighbor_id, distance, rank for each of the ``queries``.

    Both tables hold (id, vector).
    """
    arrow_rows(vectors.sparkSession, 16)
    keep = k + 1  # one may be the query itself
    rows = vectors.select("id", sign_code(F.col("vector")).alias("code")).where("code IS NOT NULL AND id IS NOT NULL").distinct()
    asked = queries.select("id", sign_code(F.col("vector")).alias("code")).where("code IS NOT NULL AND id IS NOT NULL").distinct()
    asked = staged(asked, "query-codes")
    # only the k + 1 smallest identifiers of a code can ever be among the nearest
    salted = Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= keep).drop("n")
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= keep)
    few = staged(few.select("code", "id"), "code-members")
    codes = staged(few.groupBy("code").agg(F.min("id").alias("first"), F.count("*").cast("int").alias("count")), "distinct-codes")
    distinct = codes.count()
    widths = _widths(distinct)
    leading = _leading(distinct, widths)
    # a cell that more codes than a block hold is dealt over several blocks
    held = _by_cell(codes, widths, leading)
    large = held.groupBy("s", "v").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    large = staged(large.select("s", "v", F.ceil(F.col("m") / BLOCK).alias("blocks")), "large-cells")
    blocks = F.coalesce("blocks", F.lit(1))
    index = staged(
        held.join(large, ["s", "v"], "left")
        .groupBy("s", "v", F.pmod(F.xxhash64("code"), blocks).alias("c"))
        .agg(F.collect_list(F.struct("code", "first", "count")).alias("codes")),
        "segment-index",
    )
    schema = "query bigint, code bigint, first bigint, count int, distance int"
    # a row without code stands for each query, so that it stays though nothing is met
    alone = [F.lit(None).cast("bigint").alias("code"), F.lit(None).cast("bigint").alias("first"), F.lit(0).alias("count"), F.lit(BITS + 1).alias("distance")]
    state = asked.select(F.col("code").alias("query")).distinct().select("query", *alone, F.lit(BITS).alias("bound"))
    query_blocks = max(1, -(-state.count() // BLOCK))
    done: DataFrame | None = None
    per_query, order = Window.partitionBy("query"), Window.partitionBy("query").orderBy("distance", "first")
    for radius in count():
        covered = len(widths) * (radius + 1) - 1
        probes = (
            _by_cell(state.where("code IS NULL").select(F.col("query").alias("code"), "bound"), widths, leading)
            .select("s", F.col("code").alias("query"), "bound", F.explode(_masks(leading, max(widths) - leading, radius)).alias("mask"), "v")
            .select("s", F.col("v").bitwiseXOR(F.col("mask")).alias("v"), "query", "bound")
            .groupBy("s", "v", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).alias("qc"))
            .agg(F.collect_list(F.struct("query", "bound")).alias("queries"))
            .join(large, ["s", "v"], "left")
            .select("s", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("c"), "queries")
        )
        met = (
            probes.join(index.hint("merge"), ["s", "v", "c"])
            .select("queries", "codes", "s", "v")
            .mapInArrow(_verify(keep, radius, tuple(widths), leading), schema)
        )
        seen = state.drop("bound").unionByName(met).distinct().withColumn("n", F.row_number().over(order))
        seen = seen.where((F.col("n") <= keep) | F.col("code").isNull()).drop("n")
        sure = F.sum(F.when(F.col("distance") <= covered, F.col("count")).otherwise(0)).over(per_query)
        n_codes = F.count("code").over(per_query)
        proven = (sure >= keep) | (n_codes >= distinct) | F.lit(covered >= BITS)
        bound = F.when(n_codes >= keep, F.max(F.when(F.col("code").isNotNull(), F.col("distance"))).over(per_query)).otherwise(BITS)
        best = staged(seen.select("*", bound.alias("bound"), proven.alias("proven")), "nearest-codes")
        settled = best.where("proven AND code IS NOT NULL").select("query", "code", "distance")
        done = settled if done is None else done.unionByName(settled)
        state = best.where("NOT proven").drop("proven")
        if state.isEmpty():
            break
    m, d = few.alias("m"), done.alias("d")
    per_code = d.join(m.hint("merge"), F.col("d.code") == F.col("m.code")).select("d.query", F.col("m.id").alias("neighbor_id"), "d.distance")
    a = asked.alias("a")
    pairs = a.join(per_code.alias("p").hint("merge"), F.col("a.code") == F.col("p.query")).where("a.id <> p.neighbor_id")
    ranks = F.row_number().over(Window.partitionBy("a.id").orderBy("p.distance", "p.neighbor_id"))
    return (
        pairs.select(F.col("a.id").alias("query_id"), "p.neighbor_id", "p.distance", ranks.alias("rank")).where(F.col("rank") <= k)
    )
