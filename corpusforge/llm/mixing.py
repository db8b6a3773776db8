"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of documents in a shuffled order that depends on nothing but the
rows and the seed. A document's virtual finish time is its source's cumulative tokens
divided by the source's weight; a source that runs out starts over, up to
``MAX_REPEATS`` times, so each document has a copy for each pass. All copies are served
in order of virtual finish time until the total budget of tokens is spent: there the
stream is cut, inside the copy then in service. What a document's copies were served
before the cut is what the mix takes of it. So a source takes its target, but for parts
of the documents in service at the cut.

Only DataFrame functions are used. Cumulative sums are made in two levels: inside a
source by shuffle buckets, and over the stream by slices of virtual time, of which only
the slice where the budget runs out is gone through copy by copy. A source with a third
of all rows is spread over its buckets. No text is shuffled for the sums; sources are
never gathered in one task, and targets come from a few aggregations over their sizes.

Defined results: a null text has size 0 and is never taken; a null source is a source of
its own and comes last; equal rows get equal totals however they are ordered; copies
that finish at one time are served by source, id, size and pass; null ids are told apart
by their texts; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusforge.session import materialize

WORD_GAP, SPACE = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
MAX_REPEATS, WEIGHTS, BUCKETS, SEED = 3, (1, 2, 3), 4096, 17
#: Slices of virtual time in each level's share of the stream.
SLICES = 4096


def word_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_GAP, -1))).cast("long")


def with_rank(df: DataFrame, order: Column, name: str = "rank") -> DataFrame:
    """Adds ``name``, the 0-based rank by ``order``: a range sort, and sums of the sorted partitions' counts."""
    part, low = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    x = materialize(df.orderBy(order).select("*", part.alias("__p"), low.alias("__i")), "sorted")
    n = x.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    ahead = n.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__ahead"))
    return x.join(F.broadcast(ahead), "__p").withColumn(name, F.col("__ahead") + F.col("__i")).drop("__p", "__i", "__ahead")


def source_targets(sized: DataFrame, budget_share: float = 1.0, repeats: int = MAX_REPEATS) -> tuple[DataFrame, int, float]:
    """(__k, source_size, weight, target) of each source, the total budget of tokens and the last virtual time.

    Weights go 1, 2, 3, 1, ... over the sources in code point order, null last. The
    level of virtual time at which the budget is spent rises as sources run out, until
    none runs out below it.
    """
    s = sized.groupBy("__k", "__src").agg(F.sum("__size").alias("source_size"))
    s = with_rank(s, F.col("__src").asc_nulls_last()).withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int")))
    s = materialize(s.withColumn("cap", (F.col("source_size") * repeats).cast("double")).drop("rank"), "sources")
    level, budget = 0.0, int(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * budget_share)
    while True:
        out = F.col("cap") <= F.lit(level) * F.col("weight")
        given, weight = s.agg(F.coalesce(F.sum(F.when(out, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~out, F.col("weight"))), F.lit(0.0))).first()
        up = (budget - given) / weight if weight else level
        if up <= level:
            break
        level = up
    last = s.agg(F.max(F.col("cap") / F.col("weight"))).first()[0] or 0.0
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap"))).drop("cap", "__src"), budget, last


def fair_queue(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = SEED, carry: list[str] | None = None, budget_share: float = 1.0, repeats: int = MAX_REPEATS) -> DataFrame:
    """The carried columns of every document, with its place in the mix.

    Adds ``__size``, ``__source_size``, ``__target``, ``__weight``, ``__before`` (tokens
    of its source ahead of it in one pass), ``__finish``, the virtual finish time of its
    first copy, and ``__taken``, the tokens served of all its copies.
    """
    carry = docs.columns if carry is None else carry
    own = [F.col(f"`{c}`") for c in carry]
    key = F.xxhash64(F.col(f"`{doc_id}`"), F.when(F.col(f"`{doc_id}`").isNull(), F.xxhash64(F.col(f"`{text}`"))), F.lit(seed))
    src = F.col(f"`{source}`")
    whole = docs.select(
        *own,
        src.alias("__src"),
        F.coalesce(F.concat(F.lit("="), src.cast("string")), F.lit("")).alias("__k"),
        F.col(f"`{doc_id}`").alias("__id"),
        word_count(F.col(f"`{text}`")).alias("__size"),
        key.alias("__u"),
        F.pmod(F.shiftrightunsigned(key, 20), F.lit(BUCKETS)).cast("int").alias("__b"),
    )
    # Sizes are written, texts are not: they are measured again on their way into the mix.
    sized = materialize(whole.select("__src", "__k", "__id", "__size", "__u", "__b"), "sized")
    targets, budget, last = source_targets(sized, budget_share, repeats)
    # First level: (source, bucket) sums; at most BUCKETS rows for each source.
    buckets = sized.groupBy("__k", "__b").agg(F.sum("__size").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = targets.select("__k", F.col("source_size").alias("__source_size"), F.col("weight").alias("__weight"), F.col("target").alias("__target"))
    buckets = materialize(buckets.withColumn("__ahead", ahead).drop("__n").join(t, "__k"), "buckets")
    # Second level: inside a bucket, in shuffled order. The key is null-free, so the join and the window share one shuffle.
    inside = W.partitionBy("__k", "__b").orderBy("__u", "__id", "__size").rowsBetween(W.unboundedPreceding, -1)

    def placed(x: DataFrame) -> DataFrame:
        x = x.join(buckets, ["__k", "__b"])
        x = x.withColumn("__before", F.col("__ahead") + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        return x.withColumn("__finish", (F.col("__before") + F.col("__size")) / F.col("__weight"))

    slim = placed(sized.select("__k", "__id", "__size", "__u", "__b"))
    cut = cut_of(copies_of(slim, repeats), budget, last)
    return placed(whole).withColumn("__taken", taken(cut, repeats))


def finish_of(e) -> Column:
    """Virtual finish time of copy ``e``."""
    return F.col("__finish") + F.lit(e) * F.col("__source_size") / F.col("__weight")


def copies_of(queued: DataFrame, repeats: int) -> DataFrame:
    """A row for each copy of a document that has tokens: its finish time and what ties are settled by."""
    copies = F.array(*[F.struct(finish_of(e).alias("at"), F.lit(e).alias("copy")) for e in range(repeats)])
    x = queued.filter("__size > 0").select("__k", "__before", "__size", F.explode(copies).alias("c"))
    return x.select(F.col("c.at").alias("at"), F.col("__k").alias("k"), F.col("__before").alias("before"), F.col("__size").alias("size"), F.col("c.copy").alias("copy"))


def cut_of(copies: DataFrame, budget: int, last: float) -> tuple | None:
    """Where the stream, sorted by finish time, passes the budget: ((at, k, before, copy) of the copy in service, tokens of it that are left); None if it never does."""
    slice_ = F.least(F.floor(F.col("at") / F.lit(max(last, 1e-300)) * SLICES), F.lit(SLICES)).cast("int")
    copies = materialize(copies.withColumn("slice", slice_), "copies")
    sums = sorted(tuple(r) for r in copies.groupBy("slice").agg(F.sum("size")).collect())  # SLICES + 1 rows at most
    spent = 0
    for number, n in sums:
        if spent + n > budget:
            break
        spent += n
    else:
        return None
    # One slice is gone through copy by copy, in sorted parts; the sums of the parts tell in which the cut lies.
    order = ["at", "k", "before", "copy"]
    part = materialize(copies.filter(F.col("slice") == number).orderBy(*order).withColumn("part", F.spark_partition_id()), "slice")
    for number, n in sorted(tuple(r) for r in part.groupBy("part").agg(F.sum("size")).collect()):
        if spent + n > budget:
            break
        spent += n
    upto = F.sum("size").over(W.orderBy(*order))
    row = part.filter(F.col("part") == number).withColumn("upto", upto).filter(F.col("upto") > budget - spent).orderBy("upto").first()
    return (row["at"], row["k"], row["before"], row["copy"]), budget - spent - (row["upto"] - row["size"])


def served(cut: tuple | None, e) -> Column:
    """Tokens that copy ``e`` of a document is served before the cut."""
    if cut is None:
        return F.col("__size")
    (at, k, before, copy), left = cut
    mine = F.struct(finish_of(e).alias("a"), F.col("__k").alias("b"), F.col("__before").alias("c"), F.lit(e).alias("d"))
    that = F.struct(F.lit(at).alias("a"), F.lit(k).alias("b"), F.lit(before).cast("long").alias("c"), F.lit(copy).alias("d"))
    return F.when(mine < that, F.col("__size")).when(mine == that, F.least(F.lit(left).cast("long"), F.col("__size"))).otherwise(F.lit(0).cast("long"))


def taken(cut: tuple | None, repeats: int) -> Column:
    return sum((served(cut, e) for e in range(1, repeats)), served(cut, 0)).cast("long")


def mix_stream(queued: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: a row for each copy served, range-sorted by virtual finish time.

    ``__copy_words`` is the copy's share of the budget: the document's size, or what
    was left when the budget ran out.
    """
    left = lambda e: F.col("__taken") - e * F.col("__size")
    copies = F.filter(
        F.array(*[F.struct(F.lit(e).alias("copy"), F.least(left(e), F.col("__size")).alias("words"), finish_of(e).alias("finish")) for e in range(repeats)]),
        lambda c: c["words"] > 0,
    )
    x = queued.withColumn("__c", F.explode(copies)).withColumns({"__copy": F.col("__c.copy"), "__copy_words": F.col("__c.words"), "__finish": F.col("__c.finish")}).drop("__c")
    return x.orderBy("__finish", "__k", "__before", "__copy")


def op7_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    q = fair_queue(docs, carry=["doc_id"])
    return q.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def stage_mix(spark, docs, sf_dir):
    """Documents with their tokens in the mix, in the order in which they are first served.

    A document that is repeated is one row; ``mix_words`` counts its tokens in all copies.
    """
    q = fair_queue(docs).filter("__taken > 0")
    return q.orderBy("__finish", "__k", "__before").select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__taken").alias("mix_words"), F.col("__finish").alias("mix_finish"))
