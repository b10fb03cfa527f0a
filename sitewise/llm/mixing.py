"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in hash order, form a stream of words that is packed
into blocks of ``block`` words. A source's target gives its number of slots. The
slots of all sources are dealt to the places of the output shards (``shard_slots`` each) by one
pseudorandom permutation, so a shard's source counts (:func:`shard_counts`) are a multinomial draw
conditioned on the totals, which is what keeps every source at its target. Slot j of a source
maps through a pseudorandom permutation of its n block indices, a new one for each pass
(j div n): whole passes use every block once, a last one the rest of the target,
so no document is used more than ceil(target / size of its source) times. Slots
meet blocks by (source, index). The last slot takes only the words that are left
of the target.

The mix (:func:`mix`) is the shards: rows in order of shard, place and offset in the block,
each the words that a slot takes of one document, with the white space before them (after them at the end of a text).
The pieces of a whole pass over a document, in its own order, are its text. Tokenizers of bytes take a space with the word after
it, so a cut falls between their pre-tokens and the pieces' ids, one after the other, are those of the text (not so where
white space beyond ASCII stands next to a cut).

Permutations are swap-or-not shuffles over [0, n): any index is computed on its
own, from a hash of the seed, so reruns agree and nothing is sorted or collected.

A source with a third of all rows: its stream's offsets come from buckets of
about 128 documents (window per bucket, then a prefix sum over buckets); its
slots are generated in chunks that are dealt by (source, chunk). Documents meet their
pieces by a row number of their own, so repeated rows make no hot key.

Targets: weights 5, 2, 1, repeating over the sources by code point (null last),
share ``factor`` times all words; none exceeds ``most`` times its source's words,
and what it loses is reshared by weight. This is solved in closed form on one row
per source (a single sorted pass over these rows).

Edge cases: a null text has no words; documents and sources without words take
nothing. Each row is a document, repeated rows too. Columns other than doc_id,
text and source pass through ``stage`` and are not read by ``op3``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, table

BLOCK = 64
CHUNK = 4096
ROUNDS = 10
SHARD_SLOTS = 8192
WEIGHTS = (5, 2, 1)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Place of ``index`` in a pseudorandom permutation of [0, n), named by ``key``."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index, swap)


def sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, text_hash, source, key (never null, in the order of sources) and size (words) of each row."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    key = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))
    row = F.monotonically_increasing_id() if row is None else row
    return table(docs.select(row.alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "source", key.alias("key"), size.alias("size")), "sizes")


def targets(rows: DataFrame, factor: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """key, sid (its number), source_size, n_docs, target, n_blocks, whole and rest (slots of whole passes, words after them), n_slots, first_slot: a row per source."""
    sums = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    # windows over one row per source
    place = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    sums = sums.withColumns({"sid": place.cast("int"), "weight": weight, "cap": F.col("source_size") * F.lit(most)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(factor) - before) / rest
    sums = sums.withColumns({"level": level, "order": F.row_number().over(by_ratio)})
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("order"))
    found = F.min_by("level", free).over(every)  # of the first source under its cap; null if all are at theirs
    out = sums.withColumn("target", F.least("cap", F.coalesce(found * F.col("weight"), F.col("cap"))))
    # whole passes take all words of the source; a last pass takes the rest of the target
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = out.withColumns({"n_blocks": F.ceil(F.col("source_size") / block).cast("long"), "rest": F.col("target") - passes * F.col("source_size")})
    out = out.withColumns({"whole": passes * F.col("n_blocks"), "n_slots": (passes * F.col("n_blocks") + F.ceil(F.round("rest") / block)).cast("long")})
    first = F.coalesce(F.sum("n_slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table(out.withColumn("first_slot", first).drop("level", "order", "cap", "weight"), "targets")


def pieces(rows: DataFrame, aims: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, index, row, first (word of the document), words, offset (in the block): a row per document and block."""
    some = rows.where("size > 0").join(aims.select("key", "sid", "n_docs"), "key")
    order = F.xxhash64("doc_id", "text_hash")
    some = some.select("sid", "row", "doc_id", "text_hash", "size", order.alias("order"), F.pmod(order, F.ceil(F.col("n_docs") / 128)).alias("bucket"))
    within = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = some.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("sid", "bucket", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("start"))
    at = some.join(starts, ["sid", "bucket"]).select("sid", "row", "size", (F.col("start") + F.col("inner")).alias("at"))
    index = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    out = at.select("sid", "row", "size", "at", index.alias("index"))
    begin, end = F.greatest("at", F.col("index") * block), F.least(F.col("at") + F.col("size"), (F.col("index") + 1) * block)
    return out.select("sid", "index", "row", (begin - F.col("at")).alias("first"), (end - begin).cast("int").alias("words"), (begin - F.col("index") * block).cast("int").alias("offset"))


def slots(aims: DataFrame, seed: int = 1, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """sid, index (of a block), pass, take (words), shard, place: a row per slot of the mix."""
    every = F.sum("n_slots").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row per source
    chunks = aims.where("n_slots > 0").withColumn("all", every)
    chunks = chunks.select("sid", "whole", "rest", "n_blocks", "n_slots", "first_slot", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_slots") - 1) / CHUNK))).alias("chunk"))
    # a number of its own: chunk rows are short, and would be put together before they grow
    total = aims.agg(F.sum("n_slots")).first()[0] or 0
    chunks = chunks.repartition(max(aims.sparkSession.sparkContext.defaultParallelism, -(-total // (64 * CHUNK))), "sid", "chunk")
    j = F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n_slots")) - 1))
    each = chunks.withColumn("j", j).withColumn("pass", F.floor(F.col("j") / F.col("n_blocks")))
    index = permuted(F.col("j") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("pass"))
    place = permuted(F.col("first_slot") + F.col("j"), F.col("all"), F.lit(seed), F.lit("shards"))
    last = (F.col("j") == F.col("n_slots") - 1) & (F.col("j") >= F.col("whole"))
    take = F.when(last, F.round("rest") - (F.col("j") - F.col("whole")) * block).otherwise(block).cast("int")
    each = each.select("sid", index.alias("index"), F.col("pass").cast("int").alias("pass"), take.alias("take"), place.alias("at"))
    return each.select("sid", "index", "pass", "take", F.floor(F.col("at") / shard_slots).alias("shard"), (F.col("at") % shard_slots).cast("int").alias("place"))


def shard_counts(dealt: DataFrame) -> DataFrame:
    """(shard, sid, n): how many slots of each output shard a source fills."""
    return dealt.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def taken(rows: DataFrame, aims: DataFrame, seed: int = 1, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """row, pass, first, words, shard, place, offset: the words of a document that each slot takes."""
    # slots come out of few, short chunk rows: by their size the planner would broadcast what they grow to
    met = pieces(rows, aims, block).hint("merge").join(slots(aims, seed, block, shard_slots).hint("merge"), ["sid", "index"])
    words = F.least("words", F.col("take") - F.col("offset"))
    return met.select("row", "pass", "first", words.alias("words"), "shard", "place", "offset").where("words > 0")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, and the first place that takes words of the document: first_shard, first_place (null if none does)."""
    rows = sizes(docs)
    aims = targets(rows)
    sums = taken(rows, aims).groupBy("row").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "place")).alias("head"))
    out = rows.join(aims.select("key", "source_size", "target"), "key").join(sums, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("head.shard").alias("first_shard"), F.col("head.place").alias("first_place"))


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, names: tuple[str, str, str] = ("shard", "place", "offset")) -> DataFrame:
    """The mixed corpus, shard by shard: columns of ``docs``, with a slot's words of a document in ``text``,
    and the shard, the place in it and the offset in the block as ``names``."""
    docs = table(docs.drop(*names).withColumn("_sw_row", F.monotonically_increasing_id()), "numbered")
    rows = sizes(docs, F.col("_sw_row"))
    aims = targets(rows, block=block)
    some = taken(rows, aims, seed, block, shard_slots).select(F.col("row").alias("_sw_row"), F.struct("first", "words", "shard", "place", "offset").alias("p"))
    parts = some.groupBy("_sw_row").agg(F.collect_list("p").alias("_sw_parts"))  # as many as a text has blocks, per pass
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D]+[^\x20\x09-\x0D])")  # what stands at either end goes with the first or last word

    def cut(w: Column, p: Column) -> Column:
        said = F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int"))
        return F.struct(p["shard"].alias("shard"), p["place"].alias("place"), p["offset"].alias("offset"), F.array_join(said, "").alias("text"))

    bound = F.transform(F.array(words), lambda w: F.transform("_sw_parts", lambda p: cut(w, p)))  # the words are split once
    met = docs.join(parts, "_sw_row").withColumn("_sw_piece", F.explode(F.element_at(bound, 1)))
    columns = [F.col("_sw_piece.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "_sw_row"]
    out = met.select(*columns, *[F.col(f"_sw_piece.{a}").alias(b) for a, b in zip(("shard", "place", "offset"), names, strict=True)])
    return out.repartition(names[0]).sortWithinPartitions(*names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = ("_sw_shard", "_sw_place", "_sw_offset")
    return mix(docs, names=names).withColumn("n_chars", F.length("text").cast("long")).drop(*names)
