"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Sizes are words. Sources in code-point order (null last) weigh 5, 2, 1, repeating; each gets its weight's share of all
words, but at most max_repeats times its own, the excess shared again by weight. Each source's documents queue in a
shuffled order, once for each repeat; a document's virtual finish time is the source's words up to it, divided by the
source's target, so all sources run dry of their targets at time 1. Documents are taken in order of finish time until
the total budget is reached.

No running sum spans a source or the whole mix: both are made of sums by bucket (ranges of the shuffle key, or of finish
time), running sums over the few buckets, and running sums inside one bucket. The bucket count follows the row count.

Defined cases: null text has size 0; rows with equal or null ids stay apart, in an order by id and then text; documents
of size 0 take no words; a source of size 0 has target 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Rows of a bucket, about.
BUCKET_ROWS = 5_000
_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources whose cap lies under the common level of words for each unit of weight get their cap; the level follows from
    running sums in the order of cap by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * float(max_repeats)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (
        numbered.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    # levels rise while sources reach their caps and fall after that: the largest is that of the first that does not
    held = level.withColumn("held", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    return held.select("source", "source_size", F.when(F.col("held").isNull() | (F.col("ratio") <= F.col("held")), F.col("cap")).otherwise(F.col("weight") * F.col("held")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix", key_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row; taken: words the mix takes, repeats counted.

    With key_col, a column that names each row, that column comes first.
    """
    sizes = df.select(
        *([key_col] if key_col else []),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        # a null id is told apart by its text
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string"))))), 1, 15), 16, 10).cast("long").alias("shuffled"),
    )
    return mix_sizes(stored(sizes, "mix-sizes"), weights=weights, max_repeats=max_repeats, key_col=key_col)


def mix_sizes(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, key_col: str | None = None) -> DataFrame:
    """mix() for stored rows of (doc_id, source, size, shuffled), shuffled being a whole number from 0 to 2**60."""
    key = [key_col] if key_col else []
    # the queues: ranges of the shuffle key, a power of two of them for each source, hold about BUCKET_ROWS rows each
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(rows.select("source", "source_size"), weights, max_repeats).withColumnsRenamed({"source": "ts", "source_size": "tz"})
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("rows") / BUCKET_ROWS)))).cast("int")
    plan = stored(rows.join(targets, F.col("source").eqNullSafe(F.col("ts"))).select(F.col("source").alias("ps"), "source_size", "target", bits.alias("bits")), "mix-plan")
    placed = docs.join(plan, docs.source.eqNullSafe(plan.ps)).withColumn("bucket", F.expr("shiftrightunsigned(shuffled, 60 - bits)"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = placed.join(sums, placed.source.eqNullSafe(sums.bs) & (placed.bucket == sums.bb))
    queued = stored(queued.select(*key, "doc_id", "source", "size", "source_size", "target", "shuffled", (F.col("offset") + F.sum("size").over(inside)).alias("upto")), "mix-queued")

    # the global order: ranges of the finish time; only in the range where the budget ends are rows put in order
    ranges = max(1, min(1 << 20, docs.count() // BUCKET_ROWS))

    def finish(turn: Column) -> Column:
        return F.when(F.col("target") > 0, (F.col("upto") + turn * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))

    def in_range(turn: Column) -> Column:
        return F.least(F.floor(finish(turn) * ranges), F.lit(4 * ranges)).cast("long")

    def place(turn: Column) -> Column:
        return F.struct(finish(turn).alias("finish"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), turn.cast("int").alias("turn"), "shuffled", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "upto")

    turns = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("range", in_range(F.col("turn")))
    budget = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = turns.groupBy("range").agg(F.sum("size").alias("range_size")).withColumn("filled", F.sum("range_size").over(upto))
    edge = filled.where(F.col("filled") > budget).orderBy("range").first()
    if edge is None:  # no words at all, or every turn fits
        took = lambda turn: F.lit(True)
    else:
        order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fits = turns.where(F.col("range") == edge["range"]).select(place(F.col("turn")).alias("place"), "size").withColumn("fits", F.sum("size").over(order) <= budget - edge["filled"] + edge["range_size"])
        cut = fits.where("fits").agg(F.max("place")).first()[0]

        def took(turn: Column) -> Column:
            under = in_range(turn) < edge["range"]
            if cut is None:
                return under
            last = F.struct(*[F.lit(cut[c]).alias(c) for c in ("finish", "no_source", "source", "turn", "shuffled", "doc_id", "upto")])
            return under | ((in_range(turn) == edge["range"]) & (place(turn) <= last))

    times = sum((took(F.lit(r)).cast("long") for r in range(max_repeats)), F.lit(0))
    return queued.select(*key, "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))
