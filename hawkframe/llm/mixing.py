"""Mixing sources to target weights over packed, fixed-length token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkframe.llm.common import WORD, copies, durable, running_sum, text_partitions
from hawkframe.llm.permute import quotient, with_permuted

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
SHARD_BLOCKS = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """One row per source: `_source`, `source_size` (words), `weight`, `target` (words).

    Sources in code-point order, null last, take the weights in turn. Targets share all words by weight;
    none exceeds `most` times its source's words, and what is cut off is shared by weight among the
    others. With sources in order of size over weight the cut ones come first, so one pass finds the
    level: the first source that its share does not fill.
    """
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("_source").asc_nulls_first())
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    fits = F.col("_level") * F.col("weight") <= cap
    sizes = sizes.withColumn("_level", level)
    # The level at the first source that is not filled holds for it and for all later ones.
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.withColumn("_level", F.first(F.when(fits, F.col("_level")), ignorenulls=True).over(everything))
    target = F.when(F.col("_level") * F.col("weight") < cap, F.col("_level") * F.col("weight")).otherwise(cap.cast("double"))
    return sizes.select("_source", "source_size", "weight", target.alias("target"))


def packed(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "size")) -> DataFrame:
    """Documents laid end to end in each source, in the order of `keys`: one row per document with `start`."""
    groups = durable(docs.groupBy("source", *keys).agg(F.count(F.lit(1)).alias("_n"))).withColumn("_all", F.col("size") * F.col("_n"))
    laid = running_sum(groups, list(keys), "_all", "_before", by=["source"])
    laid = copies(laid, "_n", "_i").withColumn("start", F.col("_before") + F.col("_i") * F.col("size"))
    return laid.select("source", *keys, "start")


def segments(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it touches; documents without words have none."""
    b = F.lit(block_words).cast("long")
    end = F.col("start") + F.col("size")
    cut = laid.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(quotient(F.col("start"), b), quotient(end - 1, b))))
    first = F.greatest(F.col("start"), F.col("block") * b)
    last = F.least(end, (F.col("block") + 1) * b)
    return cut.withColumn("offset", first - F.col("start")).withColumn("words", last - first)


def shard_draws(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """The draw of sources per output shard: one row per shard and source in it, with `shard`, `source`, `drawn` (slots of
    the shard that it gets), `first` (how many it gets in earlier shards), `_blocks` and `_nth` of the source.

    A source's blocks number ceil(words / block_words), its slots target / words times as many, rounded. All slots of all
    sources are dealt to places by one pseudorandom permutation, places are cut into shards of `shard_blocks`, and counted:
    the counts of a shard are a multinomial draw given that the totals hit the targets exactly.
    """
    b = F.lit(block_words).cast("long")
    plan = targets.where(F.col("source_size") > 0)
    plan = plan.withColumn("_blocks", quotient(F.col("source_size") + b - 1, b))
    plan = plan.withColumn("_slots", F.round(F.col("target") * F.col("_blocks") / F.col("source_size")).cast("long"))
    in_order = Window.orderBy(F.col("_source").asc_nulls_last())
    plan = plan.withColumn("_first", F.sum("_slots").over(in_order) - F.col("_slots")).withColumn("_nth", F.row_number().over(in_order).cast("long"))
    plan = plan.withColumn("_total", F.sum("_slots").over(Window.partitionBy()))
    chunk = F.lit(8192).cast("long")
    chunks = plan.where(F.col("_slots") > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1, chunk)))
    # By number, or the few rows would be merged into one task that computes all places.
    chunks = chunks.repartition(text_partitions(targets), "_nth", "_c")
    slots = chunks.withColumn("_j", F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + chunk, F.col("_slots")) - 1)))
    slots = with_permuted(slots, "_place", F.col("_first") + F.col("_j"), F.col("_total"), F.lit(seed).cast("long"))
    shard = quotient(F.col("_place"), F.lit(shard_blocks).cast("long")).alias("shard")
    drawn = slots.groupBy("_nth", shard, F.col("_source").alias("source"), "_blocks").agg(F.count(F.lit(1)).alias("drawn"))
    return running_sum(durable(drawn), ["shard"], "drawn", "first", by=["_nth"])


def mix_slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 11) -> DataFrame:
    """The mix: one row per output slot with `shard`, `slot`, `source`, `block` and `epoch`.

    Shards draw their sources' counts (`shard_draws`). The j-th slot of a source, counted over the shards in order, takes the
    block at place j mod blocks of a permutation of its blocks, another one for each epoch j div blocks: no block is
    used once more before all others have been. Inside a shard the slots are shuffled by a permutation of its own.
    """
    draws = shard_draws(targets, block_words, shard_blocks, seed)
    seed = F.lit(seed).cast("long")
    in_shard = Window.partitionBy("shard")
    draws = draws.withColumn("_ahead", F.sum("drawn").over(in_shard.orderBy("_nth")) - F.col("drawn")).withColumn("_filled", F.sum("drawn").over(in_shard))
    slots = draws.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1))).withColumn("_j", F.col("first") + F.col("_i"))
    slots = slots.withColumn("epoch", quotient(F.col("_j"), F.col("_blocks")))
    slots = with_permuted(slots, "block", F.col("_j") % F.col("_blocks"), F.col("_blocks"), seed + F.col("_nth") * 31 + F.col("epoch") * 7)
    slots = with_permuted(slots, "slot", F.col("_ahead") + F.col("_i"), F.col("_filled"), seed + F.col("shard") * 13)
    return slots.select("shard", "slot", "source", "block", "epoch")


def pieces_in_mix(laid: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """Pieces of the laid documents joined by source and block index with the slots that take them.

    A piece is words [offset, offset + words) of its document; `times` is how often the mix takes it, `first_shard` the
    first shard that does.
    """
    slots = mix_slots(targets, block_words, seed=seed)
    drawn = slots.groupBy(F.col("source").alias("_src"), F.col("block").alias("_block")).agg(F.count(F.lit(1)).alias("_times"), F.min("shard").alias("first_shard"))
    # Written, so that the planner need not derive what holds for the rounds of the permutations beyond this join.
    drawn = durable(drawn)
    pieces = segments(laid, block_words)
    hit = pieces["source"].eqNullSafe(drawn["_src"]) & (pieces["block"] == drawn["_block"])
    return pieces.join(drawn, hit, "left").withColumn("times", F.coalesce("_times", F.lit(0))).drop("_src", "_block", "_times")


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """Per document: doc_id, size, source_size, target, `taken`, the words that the mix takes of it, and
    `first_shard`, the first shard of the mix that holds some of them (null where nothing is taken).

    Null ids and sources are values; repeated rows are laid one after the other; documents without
    words are returned with taken 0; an empty table gives no rows. A source's slots are at most three times
    its blocks when its target is at most three times its words, so no document exceeds three times its size.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    laid = packed(sized)
    targets = durable(source_targets(laid, weights))
    row = ["doc_id", "source", "size", "start"]
    taken = pieces_in_mix(laid, targets, block_words, seed).groupBy(*row).agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"))
    empty = laid.where(F.col("size") == 0).select(*row, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    out = taken.unionByName(empty)
    out = out.join(targets, out["source"].eqNullSafe(targets["_source"]))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """The mix as documents with the columns of `docs`: for each time that words of a document are taken,
    one row whose text is those words in order, with the white space before each; n_chars follows the text.

    Documents of which nothing is taken, and those without words, leave. Rows are recognised by id, source, size and a hash
    of all their columns but maps; rows equal in these are laid and taken one by one. Nulls are values; columns of any name may
    ride along; an empty table gives no rows.
    """
    every = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    types = dict(docs.dtypes)
    hashed = F.xxhash64(*[col for c, col in every.items() if "map<" not in types[c]])
    keyed = docs.select("doc_id", "source", word_count().alias("size"), hashed.alias("_hash"), F.struct(*every.values()).alias("_row"))
    keys = ("doc_id", "size", "_hash")
    laid = packed(keyed.select("source", *keys), keys)
    pieces = pieces_in_mix(laid, durable(source_targets(laid, weights)), block_words, seed).where(F.col("times") > 0)
    parts = pieces.groupBy("source", *keys, "start").agg(F.array_sort(F.collect_list(F.struct("offset", "words", "times"))).alias("_parts"), F.max("times").alias("_most"))
    parts = parts.select(*[F.col(c).alias(f"_p_{c}") for c in ("source", *keys)], "_parts", "_most")
    texts = keyed.dropDuplicates(["source", *keys])
    same = texts["doc_id"].eqNullSafe(parts["_p_doc_id"]) & texts["source"].eqNullSafe(parts["_p_source"])
    same = same & (texts["size"] == parts["_p_size"]) & (texts["_hash"] == parts["_p__hash"])
    out = texts.join(parts, same).withColumn("_words", F.regexp_extract_all(F.col("_row")["text"], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)))
    out = out.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_most"))))
    pick = F.filter("_parts", lambda p: p["times"] >= F.col("_time"))
    runs = F.transform(pick, lambda p: F.array_join(F.slice(F.col("_words"), (p["offset"] + 1).cast("int"), p["words"].cast("int")), ""))
    out = out.withColumn("_text", F.array_join(runs, ""))
    made = {"text": F.col("_text")} | ({"n_chars": F.char_length("_text").cast(types["n_chars"])} if "n_chars" in types else {})
    return out.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
