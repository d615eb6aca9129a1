"""Spelling variant grouping: words one edit apart, found by a rare-first q-gram prefix filter.

Bigrams are ordered over all words by how often they occur, rarest first. An edit changes at most
two bigrams of a word, so of its three rarest at least one stands unchanged in a word one edit
away, and is among the three rarest there too; ties of one bigram go by position, lower first. Such
a bigram has the edit behind it or before it: either the words agree up to and with it, or from it
to the end. So words are joined on those two strings of their three rarest bigrams, which also
holds positions to one apart, and each pair is verified by its edit distance.

Each word's ``form`` is its commonest near word if that is common enough; ``root`` follows forms to
the last, by doubling steps, each written.

Scale: occurrences are counted map-side before their shuffle, so a frequent word is a row a task.
The table of bigrams has at most 90^2 rows (26 and 64 letters), the only thing that reaches the driver.
Three bigrams of two ends give at most six keys a word; a pair is emitted only for equal keys.

Defined cases: null text counts as '', null id as no digits; repeated rows count each; equal counts
go to the word that is smaller in code-point order; texts of any length are read whole; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .divergence import lower_ascii

#: What lies between runs of letters, after A-Z are lower-cased.
GAP = "[^a-z\\u00C0-\\u00FF]+"
#: Of how many runs one loses a letter.
EVERY = 199
#: Code points of a word and its occurrences, at least; how much commoner a form must be.
LETTERS, OCCURRENCES, COMMONER = 6, 5, 5
#: Bigrams of a word that are joined: the two that an edit may change, and one.
RAREST = 3


def words(docs: DataFrame, every: int = EVERY, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: runs of letters, one of ``every`` of which loses a letter by the hash of its id and run.

    Runs of under ``letters`` code points cannot grow, so they go before any is hashed.
    """
    runs = docs.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("_lead"),
        F.explode_outer(F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAP)).alias("_run"),
    ).where(F.length("_run") >= letters)
    hashed = runs.select("_run", F.crc32(F.concat("_lead", "_run")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    found = hashed.select(F.when(F.col("_h") % every == 0, shorter).otherwise(F.col("_run")).alias("word"))
    return found.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _bigram(word: Column, at: Column) -> Column:
    return F.substring(word, at, F.lit(2))


def _code(word: Column, at: Column) -> Column:
    """A number from 0 for a bigram: letters a-z are 0 to 25, U+00C0 to U+00FF are 26 to 89."""
    letter = lambda i: F.ascii(F.substring(word, i, F.lit(1)))
    place = lambda c: F.when(c >= 0xC0, c - 0xC0 + 26).otherwise(c - ord("a"))
    return place(letter(at)) * 90 + place(letter(at + 1))


def _places(vocabulary: DataFrame) -> Column:
    """Array of the place of each bigram's code in the order of frequency, as a constant of the plan."""
    positions = F.sequence(F.lit(1), F.length("word") - 1)
    codes = vocabulary.select(F.explode(F.transform(positions, lambda i: _code(F.col("word"), i))).alias("code"))
    rows = codes.groupBy("code").count().collect()  # at most 90^2
    places = [0] * (90 * 90)
    for place, r in enumerate(sorted(rows, key=lambda r: (r["count"], r.code))):
        places[r.code] = place
    return F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words (a < b) that one inserted, deleted or replaced code point tells apart."""
    places, word = _places(vocabulary), F.col("word")
    order = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.element_at(places, _code(word, i) + 1).alias("place"), i.alias("at")))
    rare = vocabulary.select("word", "n", F.explode(F.slice(F.array_sort(order), 1, RAREST)).alias("_g")).select("word", "n", F.col("_g.at").alias("_at"))
    up_to, onward = F.concat(F.lit("<"), F.substring(word, F.lit(1), F.col("_at") + 1)), F.concat(F.lit(">"), F.substring(word, F.col("_at"), F.length(word)))
    keys = rare.select("word", "n", F.explode(F.array(F.struct(up_to.alias("key"), F.col("_at").alias("at")), F.struct(onward.alias("key"), (F.length(word) - F.col("_at")).alias("at")))).alias("_k"))
    keys = scratch.materialise(keys.select("word", "n", "_k.key"), "spelling-keys")
    a, b = keys.select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), keys.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: pointers double until none moves. Counts rise by a factor at each form, so there is no cycle
    and the rounds are few."""
    at = scratch.materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = scratch.materialise(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        scratch.forget(at)
        at = moved.drop("_moved")
        at.scratch_path = moved.scratch_path
        if moved.where("_moved").isEmpty():
            return at


def variants(docs: DataFrame, every: int = EVERY, letters: int = LETTERS, occurrences: int = OCCURRENCES, commoner: int = COMMONER) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word."""
    vocabulary = scratch.materialise(words(docs, every, letters, occurrences), "spelling-words")
    pairs = near_pairs(vocabulary)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("m")))
    each = pairs.select(F.explode(ways).alias("_w")).select("_w.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("_best"))
    chosen = (-F.col("_best.m")) >= commoner * F.col("n")
    told = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("_best.near")).alias("form"), F.when(chosen, -F.col("_best.m")).alias("form_n")
    )
    told = scratch.materialise(told, "spelling-forms")
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
