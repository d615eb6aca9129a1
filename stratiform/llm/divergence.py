"""Source divergence audit: how far the term frequencies of a source lie from those of others of its language.

Plain relational work. Regular-expression matches are exploded and counted per language, source and
term; each language keeps the terms that enough of its documents have; its sources are crossed with
those terms, so that zeros are rows too; a self-join on language and term compares sources, a sum
adds their terms up and windows rank. Frequencies are smoothed and scaled to integers, so that
every number is exact.

Scale: counts are pre-aggregated before each shuffle. Groups meet terms under a salt of the term's
hash, so neither a language nor a source with most of the rows lands in one task. The dense table
has sources x kept terms rows a language and the self-join half of sources^2 x kept terms, added up
where they arise; the result has sources^2 rows by definition.

Defined cases: null text, language and source count as ''; a document is a row, repeated rows are
documents of their own, ids play no part; a language without kept terms has pairs of value 0; a
language of one source has no pairs; ties rank by the item's UTF-8 bytes; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: What lies between terms: all of ASCII but its letters. Splitting there gives the matches of its complement, many times
#: faster than regexp_extract_all, which copies what it matches in.
GAP = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Documents of a language that must have a term; ranks that the terms of a group keep.
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Parts into which the terms of a language are dealt.
SALTS = 64
#: Frequencies are in units of one by this.
SCALE = 1_000_000_000
#: A term of no letters stands in each language beside the kept ones; all sources agree on it.
_NEUTRAL = ""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that have it).

    A text's distinct terms precede all its terms in one array, so one pass counts both.
    """
    texts = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAP).alias("_terms"),
    )
    once = texts.withColumn("_once", F.array_distinct("_terms"))
    each = once.select("lang", "source", F.size("_once").alias("_k"), F.posexplode_outer(F.concat("_once", "_terms")).alias("_at", "term")).where("term <> ''")
    first = F.col("_at") < F.col("_k")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.when(first, 0).otherwise(1)).alias("n"), F.sum(F.when(first, 1).otherwise(0)).alias("d"))


def _frequency(n: Column, all_n: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (all_n + 2 * terms)), by decimals that hold any count."""
    return F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (all_n + 2 * terms).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _salted(groups: DataFrame) -> DataFrame:
    return groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int").alias("_salt")


def frequencies(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse): lang, term, source, p of every group and kept term; and lang, source, term, p, q
    of the terms that a group has, q being the language's. Both are written tables."""
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("_in", F.sum("d").over(by_term)).withColumn("total", F.sum("n").over(by_term))
    kept = scratch.materialise(counted.where(F.col("_in") >= least_documents).select("lang", "source", "term", "n", "total"), "divergence-counts")

    terms = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    languages = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_n"))
    of_groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(of_groups, ["lang", "source"], "left").join(languages, "lang", "left").na.fill(0, ["group_n", "terms", "lang_n"])
    groups = scratch.materialise(groups, "divergence-groups")

    vocabulary = terms.select("lang", "term").union(groups.select("lang", F.lit(_NEUTRAL).alias("term")).distinct())
    cells = vocabulary.select("lang", "term", _salt()).join(_salted(groups), ["lang", "_salt"])
    cells = cells.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    p = F.when(F.col("term") == _NEUTRAL, F.lit(1).cast("long")).otherwise(_frequency(F.col("n"), F.col("group_n"), F.col("terms")))
    dense = scratch.materialise(cells.select("lang", "term", "source", p.alias("p")), "divergence-dense")

    met = kept.select("lang", "source", "term", "n", "total", _salt()).join(_salted(groups), ["lang", "source", "_salt"])
    sparse = met.select("lang", "source", "term", _frequency(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"), _frequency(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"))
    return dense, sparse


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, q, value, rank.

    Part ``pair``: every other source of the language by falling distance, summed over the kept terms.
    Part ``term``: the ``top_terms`` terms that a source has more often than its language, by distance.
    """
    dense, sparse = frequencies(docs, least_documents)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    a, b = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p")), dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    sums = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(_distance(F.col("p"), F.col("q"))).alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_of"))
    pairs = both.select("lang", "_of.source", F.lit("pair").alias("part"), "_of.item", "value").withColumn("rank", F.row_number().over(ranked))

    above = sparse.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)
    return pairs.union(terms)
