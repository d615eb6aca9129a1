"""Text as Column expressions: keys, tokens, clipping, answers, rendering, hashes."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
BANK_TOKEN = r"[a-z0-9_\x{4e00}-\x{9fff}]+"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` where ``value`` is computed once a row, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.str.casefold()


def case_folded(text: Column) -> Column:
    """Full case folding of Unicode: ß is ss, ﬁ is fi, a final sigma is any sigma. ASCII takes the short way, and is not sent to Python."""
    ascii = F.octet_length(text) == F.length(text)
    return F.when(ascii, F.lower(text)).otherwise(_folded(F.when(~ascii, text)))


@functools.cache
def _simple_folds() -> tuple[str, str]:
    one = lambda c, *ways: next((x for w in ways if len(x := w(c)) == 1), c)
    # Fixed value: the dotted capital I, whose simple lower case no method of str gives.
    fold = lambda c: "i" if c == "\u0130" else one(one(c, str.upper, str.title), str.lower)
    changed = {c: f for c in map(chr, range(sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff" and (f := fold(c)) != c}
    return "".join(changed), "".join(changed.values())


def simple_folded(text: Column) -> Column:
    """Case folding that keeps each character one: what (?iu) of regular expressions takes as equal is equal under it."""
    return F.when(~text.rlike("[^\\x00-\\x7F]"), F.lower(text)).otherwise(F.translate(text, *_simple_folds()))


def text_key(text: Column) -> Column:
    """Key under which two texts count as the same: white space collapsed, case folded (which makes and changes no white space)."""
    return F.trim(F.regexp_replace(case_folded(text), r"\s+", " "))


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and single other characters."""
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(word_tokens(F.coalesce(text, F.lit("")))).cast("long")


def truncate_tokens(text: Column, most: int) -> Column:
    """The first ``most`` tokens joined by spaces, or the text itself if it has no more."""
    toks = word_tokens(text)
    return F.when(F.size(toks) > most, F.array_join(F.slice(toks, 1, most), " ")).otherwise(text)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def token_cost(text: Column, *counted: Column) -> Column:
    """The first positive count among ``counted``, else the estimate."""
    return F.coalesce(*(F.when(c > 0, c.cast("long")) for c in counted), token_estimate(text))


def clip_total(text: Column, most: int) -> Column:
    """Head and tail around a marker, ``most`` characters in all (20 at least)."""
    most = max(20, most)
    marker = F.concat(F.lit("\n...[truncated "), (F.length(text) - most).cast("string"), F.lit(" chars]...\n"))
    room = F.lit(most) - F.length(marker)
    head = F.floor(room / 2).cast("int")
    cut = F.concat(F.left(text, head), marker, F.right(text, room - head))
    return F.when(F.length(text) <= most, text).when(room <= 0, F.left(text, F.lit(most))).otherwise(cut)


def clip_ends(text: Column, most: int, head: int, tail: int) -> Column:
    """Fixed head and tail around a warning, for texts longer than ``most``."""
    gone = F.length(text) - (head + tail)
    note = F.concat(F.lit(f"\n\n[WARNING: Output truncated. Showing first {head} and last {tail} characters. "), gone.cast("string"), F.lit(" characters elided.]\n\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), note, F.right(text, F.lit(tail))))


def without_thinking(text: Column) -> Column:
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    return stripped(F.regexp_replace(cut, r"(?i)</?think(?:ing)?>", ""))


def answer(text: Column) -> Column:
    """The last tagged answer, or ''."""
    found = F.regexp_extract_all(without_thinking(text), F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), F.lit(1))
    return F.coalesce(F.trim(F.try_element_at(found, F.lit(-1))), F.lit(""))


def audit_answer(text: Column) -> Column:
    """The last tagged answer, else what follows FINAL_ANSWER, else the last line that is not blank."""
    plain = without_thinking(text)
    tagged = F.try_element_at(F.regexp_extract_all(plain, F.lit(r"(?is)<answer>\s*(.*?)\s*</answer>"), F.lit(1)), F.lit(-1))
    final = F.nullif(F.trim(F.regexp_extract(plain, r"(?im)FINAL_ANSWER\s*:\s*(.+?)\s*$", 1)), F.lit(""))
    lines = F.filter(F.transform(F.split(plain, "\n"), stripped), lambda x: x != "")
    return F.coalesce(F.trim(tagged), final, F.try_element_at(lines, F.lit(-1)), plain)


def normal_answer(text: Column) -> Column:
    """Lower case without commas, marks other than . - %, and unit words."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[!\"#$&'()*+,/:;<=>?@\[\\\]^_`{|}~]", "")
    bare = F.regexp_replace(bare, r"\b(million|millions|billion|billions|dollars|dollar|nominal)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def exact_match(predicted: Column, gold: Column) -> Column:
    return (normal_answer(predicted) == normal_answer(gold)).cast("double")


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of the bags of tokens; two empty answers agree, one empty answer does not."""
    toks = lambda c: F.filter(F.split(normal_answer(c), " "), lambda x: x != "")
    p, g = toks(predicted), toks(gold)
    times = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda a, w: a + F.least(times(p, w), times(g, w)))
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def numeric_like(term: Column) -> Column:
    return term.rlike("[0-9]") & ~term.rlike(r"\p{L}")


def forbidden_term(term: Column) -> Column:
    """The term as it is looked for, or null: at least four characters unless numeric, and not only marks."""
    t = simple_folded(F.trim(term))
    return F.when(((F.length(t) >= 4) | numeric_like(t)) & t.rlike(r"[\p{L}\p{N}]"), t)


def term_class(term: Column) -> Column:
    return F.when(numeric_like(term), "numeric_like").when(term.rlike("[0-9]"), "contains_digit").otherwise("text")


def short_id(prefix: str, text: Column, digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha1(text), F.lit(digits)))


def content_hash(name: Column, trigger: Column, content: Column) -> Column:
    """SHA-256 of the three fields as JSON with sorted keys and spaces after its marks."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.sha2(F.concat(F.lit('{"content": '), quoted(content), F.lit(', "name": '), quoted(name), F.lit(', "trigger": '), quoted(trigger), F.lit("}")), 256)


def node_text(name: Column, trigger: Column, content: Column) -> Column:
    """What a card is found by: its fields under their names."""
    return stripped(F.concat(*(x for k, c in (("name: ", name), ("\ntrigger: ", trigger), ("\ncontent: ", content)) for x in (F.lit(k), stripped(c)))))


def node_prompt(name: Column, trigger: Column, content: Column) -> Column:
    """How a card is shown to a model."""
    return stripped(F.concat(F.lit("### "), stripped(name), F.lit("\n\nTrigger: "), stripped(trigger), F.lit("\n\nGuidance:\n"), stripped(content)))


def month_number(name: Column) -> Column:
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    return F.array_position(F.array(*map(F.lit, months)), F.lower(name)).cast("int")
