"""Removal of lines that many documents share.

Lines are exploded, normalised (white space stripped at both ends, A-Z in lower case) and hashed; distinct documents are
counted per hash; lines of hashes found in too many documents go, except in the document with the largest id that
holds them; what is left is put together by position. Only hashes travel: the texts meet their verdicts once, in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkframe.llm.common import durable

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
BLANK = " \t\n\x0b\x0c\r"
# A hash that more than this share of all (line, document) pairs bear is hot: there are at most 1 / HOT_SHARE of them.
# No hash is hot with fewer pairs than HOT_ROWS.
HOT_SHARE = 1e-4
HOT_ROWS = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANK))
    # `lower` folds only A-Z in a text of one byte a character; the slower `translate` is for the others.
    plain = F.octet_length(bare) == F.char_length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(value: Column, name: str) -> list[Column]:
    """128 bits of `value` as two columns."""
    return [F.xxhash64(F.lit(seed), value).alias(f"{name}{i}") for i, seed in enumerate((1, 2))]


def _rows(docs: DataFrame) -> DataFrame:
    """`row` (all columns of the caller), `id`, and `lines`; a null or empty text is one empty line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), *_hashes(text, "t"), F.split(text, "\n").alias("lines"))


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """id, t0, t1 (hash of the whole text) and the positions of its lines that go.

    Rows that share a doc_id are one document. A null doc_id is one document too, and smaller than all others.
    """
    spread = _rows(docs).select("id", "t0", "t1", F.posexplode("lines").alias("pos", "line"))
    keyed = spread.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least_chars)
    lines = durable(keyed.select("id", "t0", "t1", "pos", *_hashes(F.col("key"), "h")))
    holders = lines.select("h0", "h1", "id").distinct()
    shared = holders.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    shared = durable(shared.where(F.col("n") >= least_documents))
    # A hash with a large share of all lines is looked up in a broadcast table, which holds at most 1 / HOT_SHARE rows,
    # so that no task of the join by hash gets more of one hash than that share.
    hot = F.col("n") > F.greatest(F.lit(HOT_ROWS), F.lit(HOT_SHARE) * lines.count())
    verdicts = shared.where(~hot).select("h0", "h1", "last", F.lit(True).alias("cold"))
    found = lines.join(F.broadcast(shared.where(hot).select("h0", "h1", F.col("last").alias("hot_last"))), ["h0", "h1"], "left")
    at_once = found.where("hot_last is not null and not (id <=> hot_last)").select("id", "t0", "t1", "pos")
    rest = found.where("hot_last is null").join(verdicts, ["h0", "h1"]).where("not (id <=> last)").select("id", "t0", "t1", "pos")
    return at_once.unionByName(rest).groupBy("id", "t0", "t1").agg(F.collect_set("pos").alias("gone"))


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """`row` (a struct of the caller's columns), `kept` (the text that is left), n_lines and n_dropped, a row per row of `docs`.

    A null text is one empty line, and so is its `kept`. Repeated rows get the same answer. Any further columns, whatever
    their names, come back inside `row`. An empty table gives no rows.
    """
    gone = dropped_lines(docs, least_chars, least_documents)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("t0").alias("gone_t0"), F.col("t1").alias("gone_t1"), "gone")
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("t0") == F.col("gone_t0")) & (F.col("t1") == F.col("gone_t1"))
    # The verdicts are the small side: the long texts are shuffled once and never sorted.
    met = _rows(docs).join(gone.hint("shuffle_hash"), same, "left")

    def left(part):
        every = F.sequence(F.lit(0), F.size(part["lines"]) - 1)
        return F.array_join(F.transform(F.array_except(every, part["gone"]), lambda i: part["lines"][i]), "\n")

    # One array of one struct, so that the lines are split once and not again for each position.
    parts = F.array(F.struct("lines", "gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.transform(parts, left)[0])
    n_dropped = F.coalesce(F.size("gone"), F.lit(0))
    return met.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.greatest(n_dropped, F.lit(0)).cast("long").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """`docs` with shared lines taken out of `text`; all columns stay, and a text that loses nothing stays as it is (null too)."""
    left = drop_lines(docs, least_chars, least_documents)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return left.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept_sha256 per row; nulls, repeats and further columns as in `drop_lines`."""
    left = drop_lines(docs)
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return left.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))
