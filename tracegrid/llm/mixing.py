"""Mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

The mix is a row of slots of equal token counts. Slot k has the golden-ratio point frac(k * phi); the cumulative
target weights map it to a source, so any stretch of the mix holds the sources in their proportions. Within its
source a slot has a rank, and rank r takes block r of the source's shuffled token line, which runs through its documents
twice and ends at the source's target. A source has as many slots as its own target needs, so that the smallest source
meets its target to the word at any size of the others: the few slots that the points give a source beyond that are dealt
to those that lack some.

Sums along a source's line go up in levels: equal rows by parts of the input, hash buckets of about ``BUCKET_DOCS``
rows, ``running_total`` over buckets. So neither a hot source nor copies of one document meet in one task. The
table of sources, one row each, is ranked in one task: some millions of sources fit there.

Defined results: a null text has no words and is never taken; null is a source of its own, after all others;
repeated rows are documents of their own; tables that are empty or hold no word give no mix, and targets of 0. Order within a source depends
only on doc_id and text, so runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import copy_numbers, cut, running_total, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and how often a document is taken at most.
SHARE, MAX_PASSES = 1.5, 2
#: Words of a slot at most; small mixes have about ``SLOTS`` slots of fewer words.
SLOT_WORDS, SLOTS = 256, 1 << 18
#: 2**32 divided by the golden ratio, odd: k * PHI32 mod 2**32 runs through all residues evenly.
PHI32 = 2654435769
#: Slots ranked together, documents laid out together, and bins of the unit interval.
CHUNK, BUCKET_DOCS, BINS = 8192, 1024, 4096


def thin_documents(docs: DataFrame, seed: int) -> DataFrame:
    """(uid, doc_id, source, size, h, h2) of every row, written once so that uid stays the same."""
    return cut(docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"), F.xxhash64(F.lit(seed), F.col("text")).alias("h2"),
    ), "mix")


def targets(thin: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """(sid, source, source_size, target, lo, hi): the targets and each source's part of the unit interval.

    Shares above ``passes`` times a source's size are cut and the excess is shared by weight among the others, until
    none is above: with sources in the order of cap by weight, a source is capped if its cap is at most the level
    that the rest would get.
    """
    by_source = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = by_source.withColumn("sid", F.row_number().over(ordered))
    rows = rows.withColumns({
        "weight": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("sid") - 1) % len(weights) + 1),
        "cap": (F.col("source_size") * passes).cast("double"),
        "total": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    level = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rows = rows.withColumn("rest", (F.col("total") - (F.sum("cap").over(level) - F.col("cap"))) / F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.min(F.when(F.col("cap") > F.col("rest") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "sid", "rest"))).over(every)["rest"])
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    upto = F.sum("target").over(Window.orderBy("sid"))
    return rows.select("sid", "source", "source_size", "target", F.try_divide(upto - F.col("target"), F.sum("target").over(every)).alias("lo"), F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), 2.0).otherwise(F.try_divide(upto, F.sum("target").over(every))).alias("hi"))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """(sid, slot, rank): the source of each slot and the slot's rank within it, for ranks below the source's ``slots``.

    ``sources`` is what ``targets`` gives, with ``slots``; together they have ``n_slots``.
    """
    spark = sources.sparkSession
    u = (((F.col("id") % (1 << 31)) * PHI32) % (1 << 32)) / float(1 << 32)  # the product stays below 2**63
    drawn = spark.range(n_slots).select(F.col("id").alias("slot"), u.alias("u")).withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    spans = sources.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("b")).withColumn("bin", F.col("b").cast("int")).drop("b")
    drawn = drawn.join(spans, "bin").filter("u >= lo AND u < hi").select("sid", "slot", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = running_total(chunks, ["sid"], "chunk", "n", "before").drop("n")
    inside = drawn.withColumn("i", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    wanted = sources.select("sid", "slots")
    ranked = cut(inside.join(before, ["sid", "chunk"]).select("sid", "slot", (F.col("before") + F.col("i")).alias("rank")).join(wanted, "sid"), "slots")
    # what some sources are given too much, others lack: a few slots a source, which are dealt to them in order
    given = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    lacks = wanted.join(given, "sid", "left").filter(F.col("slots") > F.coalesce("n", F.lit(0)))
    lacks = lacks.select("sid", F.explode(F.sequence(F.coalesce("n", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    lacks = lacks.withColumn("k", F.row_number().over(Window.orderBy("rank", "sid")))
    spare = ranked.filter("rank >= slots").select("slot").withColumn("k", F.row_number().over(Window.orderBy("slot")))
    return ranked.filter("rank < slots").select("sid", "slot", "rank").unionByName(lacks.join(spare, "k").select("sid", "slot", "rank"))


def layout(thin: DataFrame, sources: DataFrame, n_docs: int) -> DataFrame:
    """``thin`` with sid, source_size, target and ``pos``, the place of the document on its source's shuffled token line."""
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    same = ["sid", "bucket", "h", "h2", "doc_id", "size"]
    named = thin.join(sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    # null ids and null texts are copies of each other; they have hashes all the same
    named = named.select("uid", "sid", F.pmod(F.xxhash64("h", "h2"), F.lit(buckets)).alias("bucket"), "h", "h2", F.struct("doc_id").alias("doc_id"), "size")
    copies = cut(copy_numbers(named, same), "lines")
    rows = copies.groupBy(*same).agg(F.sum(F.size("uids").cast("long") * F.col("size")).alias("n"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "h2", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
    before = running_total(rows.groupBy("sid", "bucket").agg(F.sum("n").alias("n")), ["sid"], "bucket", "n", "before").drop("n")
    starts = starts.join(before, ["sid", "bucket"]).select(*same, (F.col("before") + F.col("inside")).alias("start"))
    placed = copies.join(starts, same).select(*same, "start", "before", F.posexplode("uids").alias("i", "uid"))
    placed = placed.select("uid", "doc_id.doc_id", "size", "sid", (F.col("start") + (F.col("before") + F.col("i")) * F.col("size")).alias("pos"))
    return placed.join(sources.select("sid", "source", "source_size", "target"), "sid")


def mix_sources(thin: DataFrame, n_slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The placed documents of ``layout``, and the mix: (slot, uid, doc_id, pass, start, length) pieces of documents.

    ``start`` and ``length`` count words of the document; slots in order are the mix in order.
    """
    words, n_docs = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(1, min(SLOT_WORDS, int(-(-words * SHARE // n_slots))))
    ends = F.round("target").cast("long")
    sources = cut(targets(thin).withColumns({"ends": ends, "slots": F.ceil(ends / block)}), "targets")
    slots = schedule(sources, sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    placed = cut(layout(thin, sources, n_docs), "layout")
    # a document lies on the line once in each pass; what lies beyond the source's target is not taken
    line = placed.filter("size > 0").join(sources.select("sid", "ends"), "sid").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))))
    line = line.withColumn("from", F.col("pos") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "ends")).filter(F.col("from") < F.col("to"))
    parts = line.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    start = F.greatest(F.col("from"), F.col("rank") * block)
    pieces = parts.join(slots, ["sid", "rank"]).select("slot", "uid", "doc_id", "pass", (start - F.col("from")).alias("start"), (F.least(F.col("to"), (F.col("rank") + 1) * block) - start).alias("length"))
    return placed, pieces


def taken_words(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(uid, doc_id, size, source_size, target, taken, first_slot) of every row of ``docs``; ``first_slot`` is where the
    document first stands in the mix, null where it takes no words of it."""
    placed, pieces = mix_sources(thin_documents(docs, seed))
    taken = pieces.groupBy("uid").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "uid", "left").select("uid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix as rows of ``docs``: a document comes once for each pass that takes words of it, whole.

    Only the document at the end of a source's line can be taken in part; it comes whole too.
    """
    names = docs.columns
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), "mixdocs")
    thin = cut(numbered.select(
        F.col("_uid").alias("uid"), F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("size"),
        F.xxhash64(F.lit(seed), F.col("row.doc_id")).alias("h"), F.xxhash64(F.lit(seed), F.col("row.text")).alias("h2"),
    ), "mix")
    _, pieces = mix_sources(thin)
    copies = pieces.groupBy("uid").agg(F.countDistinct("pass").alias("copies"))
    return numbered.join(copies, F.col("_uid") == F.col("uid")).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
