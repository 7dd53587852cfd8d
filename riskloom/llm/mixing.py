"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source gets a target in words. Its documents all have the same expected number of
copies, target over size. Laid end to end in the order of size and doc_id, their expected
copies add up; one random offset per source is added, and a document is emitted once for
every whole number its stretch crosses. Because the stretch before any document is known to
within one copy and sizes rise along the order, the words taken miss the target by less than
the largest document of the source.

The running sum needs only a document's place within its source. Places come from ranges of
the whole order, so a source that holds a third of all rows is spread over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
a source without words has target 0 and takes nothing; repeated rows are sampled one by one;
an empty table gives an empty result; other columns are ignored, or kept by ``mixed_documents``, but
names that begin with ``__llm_`` are taken. The offset is derived from the seed and the source's
name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ROW_KEY, WORD, ranked, staged, with_row_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 17


def sizes(docs: DataFrame, key=()) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", words.cast("bigint").alias("size"), *key)


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code point order.

    Sources below their limit share by weight what is left over; those that reach it leave
    the round. Each round is one aggregation over the table of sources.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = staged(
        ranked(sums, order, "sources").select(
            "source", "source_size", w.cast("double").alias("w"), (F.col("source_size") * limit).cast("double").alias("top")
        ),
        "source-weights",
    )
    goal = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("top") < F.col("w") * level
        got = table.agg(F.sum(F.when(full, F.col("top"))), F.sum(F.when(~full, F.col("w")))).first()
        if not got[1]:
            break
        new = (goal - (got[0] or 0.0)) / got[1]
        if new == level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("top"), F.col("w") * level).alias("target"))


def offset(source, seed: int = SEED):
    """A number from 0 to 1 that depends on the seed and the source only."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED, key=()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the columns of ``key``.

    ``key`` orders the rows that share their size and doc_id.
    """
    rows = staged(sizes(docs, key), "sizes")
    targets = staged(source_targets(rows, weights, share, limit), "targets")
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("doc_id"), *map(F.col, key)]
    placed = ranked(rows, order, "mix-order")
    # a source's first place is the number of rows before it: no join on the rows needed for it
    starts = placed.groupBy("source").agg(F.min("_rank").alias("first"))
    a, b = targets.alias("a"), starts.alias("b")
    per = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.first")
    p, s = placed.alias("p"), staged(per, "mix-sources").alias("s")
    joined = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source")))
    rate = F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(0.0)
    place = F.col("p._rank") - F.col("s.first")
    u = offset(F.col("p.source"), seed)
    copies = F.floor((place + 1) * rate + u) - F.floor(place * rate + u)
    return joined.select(
        "p.doc_id", "p.size", "s.source_size", "s.target", copies.alias("copies"), (copies * F.col("p.size")).alias("taken"),
        *[F.col(f"p.{k}") for k in key],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as they were.

    Copies belong to rows, whatever their doc_id: only rows alike in every column, which are
    interchangeable, hold theirs together and are written out from one of them.
    """
    marked = with_row_key(docs)
    total = mix(marked, **options, key=ROW_KEY).groupBy(*ROW_KEY).agg(F.sum("copies").alias("__llm_times"), F.count("*").alias("__llm_alike"))
    taken = staged(total.where("__llm_times > 0"), "mix-copies")
    rows = marked.join(taken.where("__llm_alike = 1"), ROW_KEY)
    alike = taken.where("__llm_alike > 1")
    if not alike.isEmpty():
        rows = rows.unionByName(marked.join(alike, ROW_KEY).dropDuplicates(ROW_KEY))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__llm_times"))).alias("__llm_copy")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*columns, copies).drop("__llm_copy")
