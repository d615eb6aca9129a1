"""Benchmark decontamination: spaced-seed hashes meet in a join, overlaps are verified around hits.

A seed is a window of tokens of which a mask ignores some, so a changed word between the kept ones
does not hide a passage. Hashes of all windows of the texts join those of the benchmark items; a
hit fixes an alignment, along which the item's tokens are compared with the text's: an item is
found when the best stretch has at least ``least`` tokens (or the whole item, if shorter) and
``share`` of them agree. Only DataFrame functions run; windows are hashed inside generated code.

The benchmark side is broadcast if its seeds carry at most ``BROADCAST_WORDS`` words, some 50 MB;
otherwise hashes are shuffled, and only texts with hits come back.

Defined cases: null or empty texts and items match nothing, nor do items with fewer tokens than
the shortest mask; null ids are kept as they are; rows that share an id share a row of
``find_overlaps``, but ``drop_contaminated`` tells them apart by text; an empty table on either side
gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The masks; a token under 0 is ignored.
MASKS = ("1101100110111", "1110010111", "11110111")
#: Words of the items beside all seeds, of some 25 bytes each, up to which they are broadcast.
BROADCAST_WORDS = 2_000_000
#: Tokens that must be compared, and the share of them that must agree.
LEAST, SHARE = 20, 0.8
_TOKEN_GAP = "[^\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), _TOKEN_GAP, " ")), " ")


def _tokenised(rows: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, _words and the hash of each word."""
    return rows.select(*keep, tokens(F.col("text")).alias("_words")).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, at (from 0) and seed: a row per window and mask, null where the mask is too wide.

    The outer form of explode keeps the optimiser from tokenising once more to filter its input.
    """
    n, shortest = F.size("_hashes"), min(map(len, MASKS))
    at = F.explode_outer(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))).alias("at")
    windows = rows.select(*{*keep, "_hashes"}, at)
    hashed = [F.when(F.col("at") + len(m) <= n, F.xxhash64(F.lit(k), *(F.get("_hashes", F.col("at") + i) for i, c in enumerate(m) if c == "1"))) for k, m in enumerate(MASKS)]
    return windows.select(*keep, "at", F.explode(F.array(*hashed)).alias("seed"))


def _best(agree: Column, width: Column) -> Column:
    """Most agreements in a stretch of ``width`` tokens."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(agree) - width), lambda s: total(F.slice(agree, s + 1, width))))


def _verified(hits: DataFrame, least: int, share: float) -> DataFrame:
    """Hits (_id, _hash, item_id, _item, shift, _part) that hold: doc_id, _hash, item_id, n_agree, best.

    _part: the text's tokens beside the item's, from the larger of 0 and shift. Many hits share an
    alignment, which is compared once; only those few tokens are shuffled.
    """
    once = hits.groupBy("_id", "_hash", "item_id", F.xxhash64("_item").alias("_as"), "shift", F.xxhash64("_part").alias("_beside")).agg(F.first("_item").alias("_item"), F.first("_part").alias("_part"))
    lead = F.greatest(-F.col("shift"), F.lit(0))
    agree = F.transform("_item", lambda w, i: F.when((i >= lead) & (F.get("_part", F.greatest(i - lead, F.lit(0))) == w), 1).otherwise(0))
    width = F.least(F.lit(least), F.size("_item"))
    seen = once.withColumn("_agree", agree).select(F.col("_id").alias("doc_id"), "_hash", "item_id", width.alias("stretch"), F.aggregate("_agree", F.lit(0), lambda a, x: a + x).alias("n_agree"), _best(F.col("_agree"), width).alias("best"))
    return seen.where(F.col("best") >= F.ceil(F.lit(share) * F.col("stretch"))).select("doc_id", "_hash", "item_id", "n_agree", "best")


def _row_key(docs: DataFrame) -> list[Column]:
    """Columns that tell rows apart: id, hash of the text."""
    return [docs["doc_id"].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash")]


def _overlaps(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """A row per alignment that holds: doc_id, _hash (of the text), item_id, n_agree, best."""
    items = _tokenised(benchmark, F.col("item_id").cast("long").alias("item_id")).withColumnRenamed("_words", "_item")
    of_items = _seeds(items, ["item_id", "_item"]).withColumnRenamed("at", "item_at").where("seed IS NOT NULL")
    rows = _tokenised(docs, *_row_key(docs))
    shift = F.col("at") - F.col("item_at")
    part = F.slice("_words", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("_item")).alias("_part")
    if (of_items.agg(F.sum(F.size("_item"))).first()[0] or 0) <= BROADCAST_WORDS:
        met = _seeds(rows, ["_id", "_hash", "_words"]).join(F.broadcast(of_items), "seed").withColumn("shift", shift)
        hits = met.select("_id", "_hash", "item_id", "_item", "shift", part)
    else:
        met = _seeds(rows, ["_id", "_hash"]).join(of_items, "seed")
        met = met.select(F.col("_id").alias("_of"), F.col("_hash").alias("_as"), "item_id", "_item", shift.alias("shift")).distinct()
        back = rows.select("_id", "_hash", "_words")
        hits = met.join(back, met["_of"].eqNullSafe(back["_id"]) & (met["_as"] == back["_hash"])).select("_id", "_hash", "item_id", "_item", "shift", part)
    return _verified(hits, least, share)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """A row per document and item it overlaps: doc_id, item_id, n_agree (most tokens of the item
    that agree on one alignment), best (most in a stretch of ``least``)."""
    return _overlaps(docs, benchmark, least, share).groupBy("doc_id", "item_id").agg(F.max("n_agree").alias("n_agree"), F.max("best").alias("best"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``docs`` without those that overlap a benchmark item; rows of one id are told apart by text."""
    found = _overlaps(docs, benchmark, least, share).select(F.col("doc_id").alias("_found"), F.col("_hash").alias("_as")).distinct()
    doc_id, text_hash = _row_key(docs)
    return docs.join(found, doc_id.eqNullSafe(found["_found"]) & (text_hash == found["_as"]), "left_anti")
