"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, free_name, written

#: Sources at most: their totals come to one task and to the driver.
MOST_SOURCES = 100_000
#: The corpus is served in about so many slices, or a document at a time where documents are longer than a slice is needed for.
SLICES = 1 << 17
#: Ranges of virtual time that one pass over the slices tells apart, and slices that are sorted on the driver at most.
RANGES, LAST = 1024, 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: dict[str | None, float] | None = None, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row a source with its weight, and the words it gives when all queues have been served to the budget.

    totals: source, source_size. Under fair queueing a source of weight w has given min(w * v, cap) words at virtual time v,
    cap being max_repeats passes over it. The budget (share of all words) is spent at one v, found here in closed form: sources
    run out in the order of cap / w, so the first one that would not fixes v. Sources are as many as rows here, which are few;
    no document comes into these windows. Without weights, sources by code point, null last, weigh 1, 2, 3, repeating.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    if weights is None:
        w = ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
    t = totals.withColumn("weight", w).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    t = t.withColumn("runs_out", F.when(F.col("weight") > 0, F.col("cap") / F.nullif(F.col("weight"), F.lit(0.0))).otherwise(F.lit(0.0)))
    t = t.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    before = Window.orderBy("runs_out", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left_w = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    t = t.withColumn("time", F.when(left_w > 0, left / F.nullif(left_w, F.lit(0.0))).otherwise(F.lit(0.0)))
    t = t.withColumn("served_to", F.min(F.when(F.col("time") < F.col("runs_out"), F.struct("runs_out", F.col("source").isNull(), "source", "time"))).over(every)["time"])
    return t.select("source", "source_size", "weight", F.when(F.col("served_to").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("served_to"), F.col("cap"))).alias("target"))


def _cut(slices: DataFrame, budget: int, latest: float) -> tuple[float, bool, str, int, int] | None:
    """Where the budget ends in the slices' global order of (finish, source): finish, null source, source, cut slice's first word in its source, words taken of it.

    Words are summed by ranges of virtual time, and the range in which the budget ends is looked at again in finer ranges until few slices are left in it; these
    are sorted. None if the budget is not reached.
    """
    low, high, before = 0.0, latest, 0
    while True:
        here = slices.where((F.col("finish") > low) & (F.col("finish") <= high))
        at = F.least(F.lit(RANGES - 1), F.floor((F.col("finish") - low) / ((high - low) / RANGES))).cast("int").alias("range")
        found = None
        for r in sorted(here.groupBy(at).agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("lo"), F.max("finish").alias("hi")).collect()):
            if before + r.words > budget:
                found = r
                break
            before += r.words
        if found is None:
            return None
        if found.n <= LAST or found.lo == found.hi:
            break
        low, high = math.nextafter(found.lo, -math.inf), found.hi
    last = slices.where((F.col("finish") >= found.lo) & (F.col("finish") <= found.hi)).select("finish", "key", "first", "words").collect()  # LAST rows, or one a source
    for r in sorted(last, key=lambda r: (r.finish, r.key == "n", r.key)):
        if before + r.words > budget:
            return r.finish, r.key == "n", r.key, r.first, budget - before
        before += r.words
    return None


def _served(weight: float, finish: float, inclusive: bool) -> int:
    """The most words of a source whose virtual time is under (or at) finish."""
    n = int(weight * finish) + 2
    while n > 0 and (n / weight > finish or n / weight == finish and not inclusive):
        n -= 1
    return n


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None, weights: dict[str | None, float] | None = None, share: float = 1.0, max_repeats: int = 3, ordered: bool = True) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Each source is a queue of its documents, shuffled by md5(id, text) and gone through up to max_repeats times. Words are served in slices of total / SLICES
    words (a document's last one is shorter). A slice's virtual finish time is its source's words up to and with it, divided by the source's weight. All
    slices stand in one global order of these times (then by source, null last), which is cut at the total budget, share of all words: slices before the cut are
    taken, the one across it gives the words before the cut. So sources come within a slice of their targets, and a source that is
    exhausted leaves its share to the others by weight. The rows are range-sorted by the virtual finish of the document's first pass.

    Neither the running sum of a source nor the global one goes through one task: sums of (source, first digits of the md5) and a window within each
    such bucket, of about the square root of the rows; and sums by ranges of virtual time. Rows alike in id and text share a
    bucket and are interchangeable. A null text has no words; a null source is a source of its own and comes last; ids may repeat or be null. An
    empty table gives no rows. Columns of docs named in carry come along unchanged, under their own names; a new column whose name they have gets an underscore.

    Returns carry's columns (or id_col), size, source_size, target, taken, weight, virtual_finish.
    """
    carry = [id_col] if carry is None else carry
    kept = F.struct(*[F.col(f"`{c}`") for c in carry])
    text, of_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("string")
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("n")).alias("key")
    base = docs.select(kept.alias("row"), key, word_count(text).alias("size"), F.md5(F.concat(F.coalesce(of_id, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary")).alias("h"))
    narrow = written(base if carry == [id_col] else base.drop("row"), "mix")
    sums = written(narrow.groupBy("key", F.substring("h", 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-sums")
    rows, total = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    digits = max(1, min(4, math.ceil(math.log(max(rows, 16), 16) / 2)))
    sums = sums.groupBy("key", F.substring("p", 1, digits).alias("bucket")).agg(F.sum("words").alias("words"))
    totals = sums.groupBy("key").agg(F.sum("words").alias("source_size"))
    if totals.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    t = targets(totals.select(F.when(F.col("key") == "n", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30)).alias("source"), "source_size"), weights, share, max_repeats)
    t = written(t.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), "source_size", "weight", "target"), "mix-targets")
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(t, "key")

    def placed(d: DataFrame) -> DataFrame:
        within = Window.partitionBy("key", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("bucket", F.substring("h", 1, digits)).withColumn("through", F.sum("size").over(within)).join(buckets, ["key", "bucket"])
        return d.withColumn("start", F.col("ahead") + F.col("through") - F.col("size"))

    slice_ = max(1, total // SLICES)
    own = t.collect()  # MOST_SOURCES at most
    queue = written(placed(narrow.drop("row")).where("size > 0 and weight > 0").select("key", "weight", "source_size", "start", "size"), "mix-queue")
    turns = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("from", F.col("start") + F.col("turn") * F.col("source_size"))
    slices = turns.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") - 1) - (F.col("size") - 1) % slice_, F.lit(slice_).cast("long"))))
    slices = slices.withColumn("words", F.least(F.lit(slice_).cast("long"), F.col("size") - F.col("at"))).withColumn("first", F.col("from") + F.col("at"))
    slices = slices.select("key", "first", "words", ((F.col("first") + F.col("words")).cast("double") / F.col("weight")).alias("finish"))
    latest = max((max_repeats * r.source_size / r.weight for r in own if r.weight > 0), default=0.0)
    cut = _cut(slices, math.floor(share * total + 1e-9), latest) if total and latest else None
    limits = []
    for r in own:
        if r.weight <= 0:
            limits.append((r.key, 0, -1, 0))
        elif cut is None:
            limits.append((r.key, max_repeats * r.source_size, -1, 0))
        elif r.key == cut[2]:
            limits.append((r.key, cut[3], cut[3], cut[4]))
        else:
            limits.append((r.key, _served(r.weight, cut[0], (r.key == "n", r.key) < (cut[1], cut[2])), -1, 0))
    limit = docs.sparkSession.createDataFrame(limits, "key string, served long, across long, part long")
    d = placed(narrow if carry == [id_col] else base).join(F.broadcast(limit), "key")  # MOST_SOURCES rows at most
    taken = F.lit(0).cast("long")
    for turn in range(max_repeats):
        first = F.col("start") + F.col("source_size") * turn
        left = F.col("served") - first
        whole = F.when(left >= F.col("size"), F.col("size")).when(left > 0, left - left % slice_).otherwise(0)
        taken = taken + whole + F.when((F.col("across") >= first) & (F.col("across") < first + F.col("size")), F.col("part")).otherwise(0)
    new = {n: free_name(n, carry) for n in ("size", "source_size", "target", "taken", "weight", "virtual_finish")}
    finish = F.when(F.col("weight") > 0, (F.col("start") + F.col("size")) / F.nullif(F.col("weight"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    out = d.select("row.*", *[x.alias(new[n]) for n, x in (("size", F.col("size")), ("source_size", F.col("source_size")), ("target", F.col("target")), ("taken", taken), ("weight", F.col("weight")), ("virtual_finish", finish))])
    return out.orderBy(new["virtual_finish"], *([F.col(f"`{id_col}`")] if id_col in carry else [])) if ordered else out
