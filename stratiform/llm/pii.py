"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Everything is a Column expression. A kind is found by one regular expression; ``split`` gives the
text between matches and ``regexp_extract_all`` the matches, so running sums of their lengths are
the spans in code points. Both use the same matcher and agree on leftmost, non-overlapping matches.
The quantifiers are possessive where the next character cannot belong to the class, which changes
no match and keeps long runs linear.

Defined cases: null or empty text has no spans; a null id stays null; repeated rows give repeated
results; other columns, of whatever name, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches in a block when positions are summed; two levels keep the sums near linear.
_BLOCK = 256
#: Characters on either side of a match in which context words count.
CONTEXT_CHARS = 48


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    gate: cheap test that must hold before the pattern is tried. valid: checksum or range test on
    the match. context: words nearby that raise the score, against: words that lower it. A span is
    reported when ``prior`` plus adjustments reaches ``least``; base kinds always reach it.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base: bool = False
    prior: float = 0.5
    least: float = 0.5
    context: str = ""
    against: str = ""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card_valid(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def _mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN: first four characters last, letters as 10 to 35."""
    bare = F.upper(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (acc * 10 + (code - 48)) % 97).otherwise((acc * 100 + (code - 55)) % 97).cast("int")

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1)


def _ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(000|666|9[0-9]{2})|-00-|-0000$")


# The patterns, in order of their kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

BASE_KINDS = (
    Kind("email", EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), base=True, prior=0.9),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), base=True, prior=0.7, context="(?i)addr|host|server|client|login", against="(?i)version|release|section"),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card_valid, base=True, prior=0.7, context="(?i)card|visa|master|amex|credit|karte|tarjeta|carte", against="(?i)isbn|serial|order|tracking"),
    Kind("phone", PHONE, lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(9, 15), base=True, prior=0.7, context="(?i)tel|phone|call|mobil|fax|whatsapp"),
)
EXTRA_KINDS = (
    Kind("iban", IBAN, lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), _mod97, prior=0.8, context="(?i)iban|account|konto|bank|cuenta|compte"),
    Kind("ssn", SSN, lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), _ssn_valid, prior=0.35, context="(?i)ssn|social|security|tax", against="(?i)part|item|order|isbn|serial"),
    Kind("local_phone", LOCAL_PHONE, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), lambda m: F.lit(True), prior=0.35, context="(?i)tel|phone|call|mobil|fax|whatsapp", against="(?i)isbn|serial|order|invoice"),
)
KINDS = BASE_KINDS + EXTRA_KINDS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(lens: Column) -> Column:
    """Sum of the elements before each element, by blocks: about n * (_BLOCK + n / _BLOCK ** 2)."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def by_block(p: Column) -> Column:
        xs = p["xs"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda bs: F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i)))
        return _let(
            _let(blocks, before),
            lambda heads: F.transform(xs, lambda _, i: F.get(heads, F.floor(i / _BLOCK).cast("int")) + total(F.slice(xs, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))),
        )

    return _let(F.struct(lens.alias("xs")), by_block)


def _spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, kind, end, score, text) of one kind, failing matches left out."""
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double,match:string>>")

    def build(p: Column) -> Column:
        parts, found = p["parts"], p["found"]
        lens = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, m: (F.length(a) + F.length(m)).cast("long"))

        def span(m: Column, i: Column, starts: Column) -> Column:
            start = F.get(starts, i) + F.length(F.get(parts, i))
            around = F.concat_ws(" ", F.right(F.get(parts, i), F.lit(CONTEXT_CHARS)), F.left(F.get(parts, i + 1), F.lit(CONTEXT_CHARS)))
            score = F.lit(kind.prior)
            if kind.context:
                score = score + F.when(around.rlike(kind.context), 0.25).otherwise(0.0)
            if kind.against:
                score = score - F.when(around.rlike(kind.against), 0.25).otherwise(0.0)
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (start + F.length(m)).alias("end"), score.alias("score"), m.alias("match"))

        spans = _let(_prefix_sums(lens), lambda starts: F.transform(found, lambda m, i: span(m, i, starts)))
        keep = (lambda s: kind.valid(s["match"])) if kind.base else (lambda s: kind.valid(s["match"]) & (s["score"] >= kind.least))
        return F.when(F.size(found) == 0, none).otherwise(F.filter(spans, keep))

    pair = F.struct(F.split(text, kind.pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    return F.coalesce(F.when(kind.gate(text), _let(pair, build)), none)


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``out_col``: all spans of all kinds, by start and then in the order of ``kinds``; a column of
    that name gives way.

    Each span has start and end in code points (end exclusive), kind, score and the matched text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*(_spans_of(text, k, i) for i, k in enumerate(kinds))))
    return docs.withColumn(out_col, spans)


def _shown(found: Column, kind: Kind) -> Column:
    return F.transform(found, lambda m: F.when(kind.valid(m), F.lit(f"<{kind.name}>")).otherwise(m))


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE_KINDS) -> DataFrame:
    """Replace what the patterns of ``kinds`` find and their tests confirm by ``<kind>``; null stays null."""
    text = F.col(text_col)
    for k in kinds:
        parts, found = F.split(text, k.pattern, -1), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        shown = _shown(found, k)
        text = F.when(k.gate(text), F.array_join(F.flatten(F.zip_with(parts, shown, lambda a, m: F.array(a, F.coalesce(m, F.lit(""))))), "")).otherwise(text)
    return docs.withColumn(text_col, text)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, out_col: str = "pii") -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans as a string."""
    spans = F.col(out_col)
    of_base = F.filter(spans, lambda s: s["rank"] < len(BASE_KINDS))
    of_rank = lambda i: F.filter(spans, lambda s: s["rank"] == i)
    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined(spans).alias("spans"))
