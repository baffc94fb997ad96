"""Text functions as Column expressions: normalisation, tokens, sentences, stems, hashes and extraction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of the tokenizer, contractions without their apostrophe included.
STOP_WORDS = """
a about above after again against all am an and any are arent as at be because been before being below between both
but by can cant cannot could couldnt did didnt do does doesnt doing dont down during each few for from further had
hadnt has hasnt have havent having he hed hell hes her here heres hers herself him himself his how hows i id ill im
ive if in into is isnt it its itself lets me more most mustnt my myself no nor not of off on once only or other ought
our ours ourselves out over own same shan shant she shed shell shes should shouldnt so some such than that thats the
their theirs them themselves then there theres these they theyd theyll theyre theyve this those through to too under
until up very was wasnt we wed well were weve werent what whats when whens where wheres which while who whos whom why
whys with wont would wouldnt you youd youll youre youve your yours yourself yourselves
""".split()
#: White space, Unicode's included, for the inside of a character class (the same in Java and RE2).
SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: A sentence: what stands before terminators that end it at white space or the text's end. It begins where the one
#: before ended or after a terminator, so that a stretch without an end is read once only.
SENTENCE = rf"(?:\G|(?<=[.!?]))[^.!?]++[.!?]++(?:[{SPACE}]|\z)"
#: What may end a stem.
STEM_END = "(ings|ing|edly|ed|es|s)$"
#: Only texts with such characters change their ASCII part under NFC.
_COMPOSED = r"[\p{M}\x{37E}\x{1FEF}\x{212A}]"
FNV_START, FNV_PRIME = 2166136261, 16777619


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def composed(text: Column) -> Column:
    """NFC where it can matter for ASCII characters; the rest doesn't leave the JVM."""
    marked = F.when(text.rlike(_COMPOSED), text)
    return F.coalesce(F.when(marked.isNotNull(), _nfc(marked)), text)


def normalize_text(text: Column, nfc: bool = True) -> Column:
    """Printable ASCII only, lines and spaces squashed; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    text = composed(text) if nfc else text
    return squash(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", "\n"), r"[^\x20-\x7E\n]", ""))


def raw_tokens(text: Column) -> Column:
    """Lower-case pieces of letters, digits, ``_`` and ``-`` between white space."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^a-z0-9_\-{SPACE}]", "")
    return F.split(kept, f"[{SPACE}]+")


def tokenize(text: Column) -> Column:
    """Tokens of more than one character that are no stop words, in order."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def stem(token: Column) -> Column:
    """Tokens of more than four characters lose one common ending."""
    return F.when(F.length(token) > 4, F.regexp_replace(token, STEM_END, "")).otherwise(token)


def stems(text: Column) -> Column:
    return F.transform(tokenize(text), stem)


def sentences(text: Column) -> Column:
    """Sentences of the plain splitter, trimmed; what follows the last terminator is lost, a text without any is one.

    A sentence ends at terminators before white space and begins after the terminators before these, so that a decimal
    number loses what stands before its point. The white space belongs to it: a lone terminator right after it is none.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(text)), squash_ends), lambda s: s != "")


def squash_ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0))


def token_count(text: Column) -> Column:
    """Pieces between white space, as the ranking's document length has them (an empty text has one)."""
    return F.size(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"))


def fnv1a(text: Column) -> Column:
    """FNV-1a over characters, as a long below 2**32."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    mixed = lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(FNV_START).cast("long"), mixed)


def fnv_hex(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(fnv1a(text))), 8, "0")


def cache_key(*parts: Column) -> Column:
    """A key for a question and its settings."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def citations(answer: Column) -> Column:
    """The numbers in [1] and [Source 1], in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(?:Source\s*)?(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))


def marked_headings(text: Column) -> Column:
    """Plain numbered headings as third-level markdown headings."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    return F.regexp_replace(unix, r"(?m)^[ \t]*(\d+(?:\.\d+)+\.?[ \t]+[A-Z][^\n]{0,80})$", "### $1")


def duration(seconds: Column) -> Column:
    """A time for people: below a second, in seconds, minutes or hours."""
    return (
        F.when(seconds < 1, F.lit("<1s"))
        .when(seconds < 60, F.concat(F.round(seconds).cast("int").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.round(seconds / 60).cast("int").cast("string"), F.lit(" min")))
        .otherwise(F.format_string("%.1f h", seconds / 3600))
    )


def first_fact(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, null without any."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def replace_first(text: Column, old: str, new: str) -> Column:
    """``text`` with the first ``old`` replaced."""
    at = F.instr(text, F.lit(old)) if isinstance(old, str) else F.locate(old, text)
    cut = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))
    return F.when(at > 0, cut).otherwise(text)
