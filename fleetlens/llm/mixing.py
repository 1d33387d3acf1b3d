r"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words. It takes whole epochs of the source while
they fit, then a weighted sample of documents for the rest: each document draws
an exponential key scaled by its quality weight (``-ln(u) / weight``), keys sort
within the source, and a running sum of sizes cuts the order at the budget.

``u`` comes from the MD5 of the seed and the document, so reruns agree. The
order of a source is never sorted in one task: keys fall into ``n_bins`` bins,
the bins' sums find the one bin in which the budget ends, and only that bin is
sorted. The list of sources (one row each, the mix's configuration) is the only
thing that reaches the driver; ``MAX_SOURCES`` bounds it.

Defined cases: a null text has size 0; a document of size 0 is never taken; null
is a source of its own, last; equal keys order by id, then by text hash, and equal
rows by one running number; an empty table gives an empty mix.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, stored, words_count

WEIGHTS = (5, 2, 1)
MAX_SOURCES = 100_000
#: Marks of markup and noise; their share lowers a document's quality weight.
SYMBOLS = "#$%&*|!<>{}[]~^_=+\\@"


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of code points that are no symbol marks, at least 0.1; empty: 1."""
    n = F.length(text)
    share = F.length(F.translate(text, SYMBOLS, "")) / F.greatest(n, F.lit(1))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), share))


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), cap: int = 2) -> list[Fraction]:
    """Split ``share`` of all sizes by weight; a target stops at ``cap`` times its size
    and what is over goes to the others by weight, until none is above."""
    out = [Fraction(0)] * len(sizes)
    left, open_ = Fraction(share) * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > cap * sizes[i] * total]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def exponential_key(seed: Column, weight: Column) -> Column:
    """``-ln(u) / weight`` with u in (0, 1] from 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(seed), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float(2 ** 52))) / weight


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weight: Column | None = None, weights=WEIGHTS, share: Fraction = Fraction(3, 2), cap: int = 2,
             seed: str = "mix", n_bins: int = 1024) -> DataFrame:
    """One row per document: ``id, r2, row, source, size, source_size, target, taken``.

    ``taken`` is the epochs the source is read whole, plus one if the document
    is in the sample, times its size. The document at which the budget ends is
    in if at least half of it fits, so a source misses its target by half a
    document at most.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    weight = quality_weight(text) if weight is None else weight
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    r1, r2 = row_keys(docs)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
        r1.alias("r1"), r2.alias("r2"),
        F.col(f"`{source_col}`").cast("string").alias("source"), words_count(text).alias("size"),
        exponential_key(F.encode(F.concat(F.lit(f"{seed}:"), ident), "UTF-8"), weight).alias("key"))
    rows = stored(rows, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    goal = targets([int(r["size"]) for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    plan = []
    for r, t in zip(sums, goal):
        size = int(r["size"])
        epochs = int(t // size) if size else 0
        plan.append((r["source"], size, float(t), epochs, int(t - epochs * size)))
    mix = spark.createDataFrame(plan, "source string, source_size long, target double, epochs long, budget long")
    # one row per source, MAX_SOURCES at most: rows stay where they are, however large their source
    w = rows.alias("d").join(F.broadcast(mix).alias("m"), F.col("d.source").eqNullSafe(F.col("m.source"))).select(
        "d.*", "m.source_size", "m.target", "m.epochs", "m.budget",
        F.floor(F.lit(n_bins) * (1 - F.exp(-F.col("key")))).cast("int").alias("bin"))
    bins = w.groupBy("source", "bin", "budget").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    # the bin in which the budget ends; all before it are in, all after it are out
    cut = (bins.where((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget")))
           .select(F.col("source").alias("s"), F.col("bin").alias("cut"), "before"))
    cut = stored(cut, "mix-cut")
    w = w.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at_cut = w.where(F.col("bin") == F.col("cut"))
    run = Window.partitionBy("source").orderBy("key", "id", "r1", "r2", "row").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = at_cut.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    chosen = F.col("start") + F.col("size") / 2 <= F.col("budget")
    rest = w.where(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).withColumn(
        "in", F.when(F.col("cut").isNull(), F.col("budget") > 0).otherwise(F.col("bin") < F.col("cut")))
    out = at_cut.withColumn("in", chosen).drop("start").unionByName(rest)
    copies = F.col("epochs") + F.col("in").cast("long")
    return out.select("row", "id", "r1", "r2", "source", "size", "source_size", "target",
                      F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each document as many times as its copies (same columns).

    Rows equal in every column pool their copies, which come back as copies of one of them.
    """
    plan = (plan_mix(docs, id_col, text_col, **options)
            .groupBy("r1", "r2").agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("same")).where("copies > 0"))
    r1, r2 = row_keys(docs)
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    joined = rows.join(plan, ["r1", "r2"])
    once = joined.where("same = 1").unionByName(joined.where("same > 1").dropDuplicates(["r1", "r2"]))
    return once.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
