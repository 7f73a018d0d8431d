"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality``; within a source documents are taken in key
order until the source's word budget is spent.  Budgets above a source's size are spent as complete
epochs first, the rest selects a part of the documents.

No source is ever sorted in one task.  The prefix sum over keys is taken in two steps over fixed bins
of ``1 - exp(-key)`` (2^12 coarse bins per source, then 2^12 fine bins inside the one coarse bin where the
budget ends); only the documents of that last fine bin, one 2^24th of a source or so, are put in order.  What
reaches the documents is one row per source with the key at which it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climo.llm.tables import written

#: Characters that a document of low quality has many of (fixed value).
SYMBOLS = "#*$%&|<>!"
BIN_BITS = 12
#: Tables of at most so many sources (about 100 bytes each) are broadcast; otherwise a source is dealt to so many tasks.
FEW_SOURCES, SALTS = 50_000, 64


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight between 0.25 and 1: falls with the share of symbols among the characters."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    share = symbols / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.25), F.lit(1.0) - F.lit(6.0) * share), F.lit(1.0))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """``-ln(u) / weight``, u in (0, 1) from the first 52 bits of the MD5 of id and seed: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    u = (bits.cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes by weight.
    A target stops at ``max_epochs`` times its source's size; the excess is shared again by weight among
    the others until none is above.  In order of size per weight, a source is capped exactly when the share
    that remains for it reaches its cap, so one ordered pass finds the final level.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                       (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = (F.col("source_size") * F.lit(max_epochs)).cast("double")
    before = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ((F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), zero))
             / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), zero)))
    leveled = ranked.withColumn("_cap", cap).withColumn("_level", level)
    leveled = leveled.withColumn("_capped", F.col("_level") * F.col("_weight") >= F.col("_cap"))
    final = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    return leveled.select(*sizes.columns, F.when(F.col("_capped"), F.col("_cap"))
                          .otherwise(F.least(final * F.col("_weight"), F.col("_cap"))).alias("target"))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join on source; keeps the left side's source."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), how).drop("_source")


def _beside(rows: DataFrame, per_source: DataFrame, sources: int, source: str = "source") -> DataFrame:
    """``rows`` (with ``_key``) with the columns of their source in ``per_source``, one row each of ``sources`` in all.

    Up to FEW_SOURCES rows are broadcast.  Beyond that each source is dealt to SALTS tasks by the rows' keys, so that a source that
    holds most rows isn't met by one task.
    """
    other = per_source.withColumnRenamed("source", "_source")
    same = rows[source].eqNullSafe(other["_source"])
    if sources <= FEW_SOURCES:
        return rows.join(F.broadcast(other), same).drop("_source")
    other = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(other, same & (F.pmod(F.xxhash64("_key"), F.lit(SALTS)) == other["_salt"])).drop("_source", "_salt")


def _ending_bin(bins: DataFrame, by: str) -> DataFrame:
    """The bin of each source in which ``rest`` ends; ``rest`` becomes what is left for that bin."""
    upto = Window.partitionBy("source").orderBy(by)
    last = F.sum("_words").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    summed = bins.withColumn("_upto", last).where(F.col("_upto") > F.col("rest"))
    first = summed.groupBy("source").agg(F.min(F.struct(by, "_upto", "_words", "rest")).alias("_b"))
    return first.select("source", F.col(f"_b.{by}").alias(by),
                        (F.col("_b.rest") - F.col("_b._upto") + F.col("_b._words")).alias("rest"))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=(1, 2, 3), max_epochs: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame, int]:
    """(sized documents, one row per source with its target, epochs and where its last epoch ends, the number of sources)."""
    coarse = 1 << BIN_BITS
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                        word_count(docs[text_col]).alias("size"),
                        sampling_key(docs[id_col], quality_weight(docs[text_col]), seed).alias("_key"))
    code = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * (coarse * coarse)), F.lit(coarse * coarse - 1))
    sized = written(sized.withColumn("_code", code.cast("long")))
    by_bin = sized.groupBy("source", F.shiftright("_code", BIN_BITS).alias("_coarse")).agg(F.sum("size").alias("_words"))
    sizes = by_bin.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    epochs = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(F.lit(0)))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    wanted, sources = targets.select("source", "rest"), targets.count()
    end = _ending_bin(_same_source(by_bin, wanted), "_coarse")
    inside = _beside(sized.withColumn("_in", F.shiftright("_code", BIN_BITS)), end, sources)
    inside = inside.where(F.col("_in") == F.col("_coarse"))
    end = _ending_bin(inside.groupBy("source", "_code", "rest").agg(F.sum("size").alias("_words")), "_code")
    last = _beside(sized, end.withColumnRenamed("_code", "_end"), sources)
    last = last.where(F.col("_code") == F.col("_end"))
    order = Window.partitionBy("source").orderBy("_key", "size", "doc_id")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = F.col("_upto") - F.col("size") / 2 <= F.col("rest")
    cut = last.withColumn("_upto", upto).groupBy("source").agg(
        F.first("_end").alias("end_code"), F.max(F.when(near, F.col("_key"))).alias("end_key"))
    return sized, _same_source(targets, cut, "left"), sources


def copies_taken() -> Column:
    """How often a document is taken: its source's epochs, and once more up to where the last epoch ends."""
    code, key = F.col("_code"), F.col("_key")
    more = (code < F.col("end_code")) | ((code == F.col("end_code")) & (key <= F.col("end_key")))
    more = more & (F.col("rest") > 0)
    return (F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")).alias("copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row per input row.

    Whole documents are taken; the one on which the budget ends is taken when that comes nearer to the target.  A null or
    empty text has size 0, counts as a document and adds no words.  A null source is a source of its own.  Null
    ids share one draw.  Equal rows share a key and are taken together.  An empty table gives no rows.
    """
    sized, plan, sources = mixing_plan(docs, **options)
    out = _beside(sized, plan, sources).withColumn("copies", copies_taken())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: every document's row as often as it is taken, with the columns of ``docs``.

    Edge cases as for ``mixed_documents``; documents without words count as taken in each complete epoch.
    """
    _, plan, sources = mixing_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: names[i] for i, c in reversed(list(enumerate(docs.columns)))}
    key = sampling_key(F.col(at[id_col]), quality_weight(F.col(at[text_col])), seed)
    bins = 1 << (2 * BIN_BITS)
    rows = rows.withColumn("_key", key).withColumn(
        "_code", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * bins), F.lit(bins - 1)).cast("long"))
    taken = _beside(rows, plan, sources, at[source_col]).withColumn("_n", copies_taken()).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*names).toDF(*docs.columns)
