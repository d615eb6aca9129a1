"""Replies and prompts: JSON in free text, checked shapes of what a synthesis returns, tokens of a model."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Wording of a template for one run, and for a group of runs; the order matters.
TEMPLATE_WORDING = {
    "single trajectory": "trajectory cluster",
    "Single trajectory": "Trajectory cluster",
    "one trajectory": "one trajectory cluster",
    "One trajectory": "One trajectory cluster",
    "the trajectory": "the trajectory cluster",
    "The trajectory": "The trajectory cluster",
    "this trajectory": "this trajectory cluster",
    "This trajectory": "This trajectory cluster",
    "agent trajectory": "agent trajectory cluster",
    "Agent trajectory": "Agent trajectory cluster",
}


# ---- JSON in replies ---------------------------------------------------------------------------


def without_think_blocks(text: Column) -> Column:
    """Without <think> blocks that are closed."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


_FENCE = re.compile(r"(?ms)^[^\S\n]*```[^\n]*\n(.*?)^[^\S\n]*```")
_MARK = re.compile(r'(\\*)([{}"])')


def _as_object(text: str) -> str | None:
    try:
        return text if isinstance(json.loads(text), dict) else None
    except (ValueError, RecursionError):
        return None


def _first_balanced(text: str) -> str | None:
    """The span from the first brace that is ever closed to the brace that closes it, each brace being read as if the text began
    there: quotes before it do not count, braces in strings after it do not either.

    One pass for all of them. Two readings that are both outside a string, or both inside, go on alike, so
    those of a kind share a stack, which has the first of the braces that close next on top.
    Where an escaped quote brings both kinds together, their stacks are merged from the top.
    """
    outside: list[int] = []
    inside: list[int] = []
    first = None
    for mark in _MARK.finditer(text):
        escaped, at = len(mark[1]) % 2 == 1, mark.start(2)
        if mark[2] == "{":
            outside.append(at)
        elif mark[2] == "}":
            if outside and (first is None or outside[-1] < first[0]):
                first = outside[-1], at + 1
            del outside[-1:]
        elif not escaped:
            outside, inside = inside, outside
        else:
            short, long = sorted((outside, inside), key=len)
            for i in range(1, len(short) + 1):
                long[-i] = min(long[-i], short[-i])
            outside, inside = [], long
    return first and text[slice(*first)]


def recovered(reply: str) -> str | None:
    """The first JSON object of a reply: the whole, a fenced block, then any balanced braces.

    The first balanced braces that are no JSON end the search without a result.
    """
    reply = reply.strip()
    some = [reply, *filter(None, map(str.strip, _FENCE.findall(reply)))]
    if found := next(filter(None, map(_as_object, some)), None):
        return found
    part = next(filter(None, map(_first_balanced, some)), None)
    return part and _as_object(part)


def strict(reply: str) -> str | None:
    """A reply that is one JSON object, bare or wholly fenced."""
    reply = reply.strip()
    fenced = re.fullmatch(r"(?s)```[^\n]*\n(.*)```", reply)
    return _as_object(reply) or (fenced and _as_object(fenced[1].strip()))


@F.pandas_udf(StringType())
def _recovered(replies: pd.Series) -> pd.Series:
    return replies.map(lambda r: None if r is None else recovered(r))


@F.pandas_udf(StringType())
def _strict(replies: pd.Series) -> pd.Series:
    return replies.map(lambda r: None if r is None else strict(r))


def json_object(reply: Column) -> Column:
    """JSON text of the object in a reply, or null. Spark's own parsers let text follow an object, so
    replies with a brace go through Python."""
    return _recovered(F.when(F.contains(reply, F.lit("{")), without_think_blocks(reply)))


def strict_json_object(reply: Column) -> Column:
    """JSON text of a reply that is one object, bare or wholly fenced, or null."""
    return _strict(F.when(F.contains(reply, F.lit("{")), without_think_blocks(reply)))


# ---- shapes ------------------------------------------------------------------------------------


def _objects(field: Column, what: str) -> Column:
    """Elements of a JSON array of objects as JSON texts; anything else fails."""
    some = F.from_json(field, "array<string>")
    fault = F.when(~F.startswith(F.ltrim(field), F.lit("[")), f"{what} must be a list").when(~F.forall(some, lambda x: F.startswith(F.ltrim(x), F.lit("{"))), f"every element of {what} must be an object")
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(some)


def _keys(payload: Column) -> Column:
    return F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))


def cards_payload(payload: Column) -> Column:
    """Cards of a synthesis: the list ``cards``, or the payload itself as the only card."""
    cards = F.get_json_object(payload, "$.cards")
    return F.when(cards.isNull(), F.array(payload)).otherwise(_objects(cards, "cards"))


def patch_payload(payload: Column) -> Column:
    """Struct (updates, new_cards) of an update; a payload with neither list is cards to add.

    A new card must not bring an id.
    """
    empty = F.array().cast("array<string>")
    keys = _keys(payload)
    listed = lambda k: F.when(F.array_contains(keys, k), _objects(F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit("null")), k)).otherwise(empty)
    legacy = ~F.array_contains(keys, "updates") & ~F.array_contains(keys, "new_cards")
    new = listed("new_cards")
    checked = F.when(F.exists(new, lambda c: F.array_contains(_keys(c), "item_id")), F.raise_error(F.lit("a new card must not bring an item_id")).cast("array<string>")).otherwise(new)
    return F.when(legacy, F.struct(empty.alias("updates"), cards_payload(payload).alias("new_cards"))).otherwise(F.struct(listed("updates").alias("updates"), checked.alias("new_cards")))


def updates_only(payload: Column) -> Column:
    """Updates above level 0: the payload has that list and nothing else."""
    other = F.array_remove(_keys(payload), "updates")
    fault = F.when(F.size(other) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(F.array_sort(other), ", "))).when(~F.array_contains(_keys(payload), "updates"), "the list of updates is missing")
    return F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(_objects(F.coalesce(F.get_json_object(payload, "$.updates"), F.lit("null")), "updates"))


# ---- prompts -----------------------------------------------------------------------------------


def for_groups(template: Column) -> Column:
    """A template's wording for one run rewritten for a group of runs."""
    for one, many in TEMPLATE_WORDING.items():
        template = F.replace(template, F.lit(one), F.lit(many))
    return template


def retrieval_query(instruction: Column, kind: Column) -> Column:
    """What a task is looked up by: instruction and type, nothing that tells where the answer goes."""
    said, typed = (T.stripped(F.coalesce(c, F.lit(""))) for c in (instruction, kind))
    return F.when(typed == "", said).otherwise(F.concat(F.when(said == "", "").otherwise(F.concat(said, F.lit("\n\n"))), F.lit("Task type: "), typed))


def card_text(name: Column, trigger: Column, content: Column) -> Column:
    """A card as Markdown, with headings for its trigger and its content."""
    part = lambda head, body: F.concat(F.lit(f"## {head}\n"), body)
    body = F.coalesce(F.nullif(T.stripped(content), F.lit("")), F.lit("No detailed reusable experience content was provided."))
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), name), F.when(trigger != "", part("Trigger", trigger)), part("Content", body)), F.lit("\n"))


# ---- tokens of a model -------------------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Texts of which tokens are held at once.
ENCODED_TEXTS = 256


def _ids(texts: pd.Series, path: str) -> Iterator[list[int]]:
    """Ids of each text, without what the tokenizer could tell of their places."""
    for lo in range(0, len(texts), ENCODED_TEXTS):
        for e in _tokenizer(path).encode_batch_fast(texts.iloc[lo : lo + ENCODED_TEXTS].fillna("").tolist(), add_special_tokens=False):
            yield e.ids


def model_token_count(text: Column, path: str) -> Column:
    """Tokens of a text by a tokenizer file that every executor can open."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in _ids(texts, path)], dtype="int64")

    return count(text)


def model_truncated(text: Column, most: int, path: str, strategy: str = "head") -> Column:
    """A text cut to ``most`` tokens at its head, its tail, or both ends; a shorter one as it is."""
    return model_cut(text, most, path, strategy)["cut"]


def model_cut(text: Column, most: int, path: str, strategy: str = "head") -> Column:
    """Struct (tokens, cut) of ``model_token_count`` and ``model_truncated``, for which a text is encoded once."""
    if strategy not in ("head", "tail", "head_tail"):
        raise ValueError(f"unknown way to truncate: {strategy}")

    @F.pandas_udf("tokens long, cut string")
    def cut(texts: pd.Series) -> pd.DataFrame:
        tok, out, counts = _tokenizer(path), [], []
        first = {"head": most, "tail": 0, "head_tail": most // 2}[strategy]
        for t, ids in zip(texts, _ids(texts, path)):
            n = len(ids)
            counts.append(n)
            out.append(t if n <= most else tok.decode(ids[:first] + ids[n - (most - first) :]))
        return pd.DataFrame({"tokens": pd.Series(counts, dtype="int64"), "cut": pd.Series(out, dtype=object)})

    return cut(text)


def prepared_for_embedding(text: Column, most: int, truncate: bool = True) -> Column:
    """Struct (text, token_count, truncated) of an input of at most ``most`` tokens, by Unicode tokens.

    Without ``truncate`` a longer one fails.
    """
    n = T.token_count(text)
    over = F.raise_error(F.concat(F.lit("an input has too many tokens: "), n.cast("string"))).cast("string")
    return F.struct(F.when(n <= most, text).otherwise(T.truncate_tokens(text, most) if truncate else over).alias("text"), n.alias("token_count"), (n > most).alias("truncated"))


def hashed_vector(text: Column, dims: int = 384) -> Column:
    """Length-one signed bag of alphanumeric words: four bytes of a word's BLAKE2b give its place, the
    parity of the fifth its sign. A text without words, or whose words cancel out, is the first axis."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for word in re.findall(r"[^\W_]+", t or ""):
                d = hashlib.blake2b("".join(map(str.lower, word)).encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % dims] += 1 - 2 * (d[4] & 1)
            n = np.linalg.norm(v)
            out.append(v / n if n > 1e-12 else np.eye(1, dims)[0])
        return pd.Series(out)

    return vectors(text)
