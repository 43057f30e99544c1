"""Tokenizers and text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CJK = "[一-鿿]"
CLAIM_TOKEN = "[一-鿿]|[A-Za-z][A-Za-z0-9_]+"
BENCH_TOKEN = "[一-鿿]|[A-Za-z][A-Za-z0-9_\\-]+"
BLANK = "[ \\t\\n\\x0B\\f\\r]"
#: Words without weight in bench tokens.
STOP_WORDS = tuple(
    """a an the is are was were be been being have has had do does did will would shall should can could may might must of in on at to for with
    by from as into through during before after above below between under and but or nor not so if then than too very just about each all both few
    more most other some such no only own same this that these those it its they them their he she we you i me my your his her our what which who
    whom how when where why""".split()
)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def blank_split(text: Column) -> Column:
    """White-space tokens, in order."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda t: t != "")


def folded_tokens(text: Column) -> Column:
    """Lower-cased white-space tokens: the first generation's search tokens."""
    return blank_split(F.lower(text))


def claim_tokens(text: Column) -> Column:
    """The set of lower-cased words of two characters or more and single CJK characters; numerals have none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CLAIM_TOKEN), F.lit(0)), F.lower))


def bench_tokens(text: Column) -> Column:
    """As claim_tokens, but words may hold hyphens and stop words are left out."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BENCH_TOKEN), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def token_estimate(text: Column) -> Column:
    """One for a CJK character, a quarter for any other."""
    others = F.length(F.regexp_replace(text, CJK, ""))
    return (F.length(text) - others + F.floor(others / 4)).cast("int")


def script_language(text: Column) -> Column:
    return F.when(text.rlike(CJK), "zh").otherwise("en")


def query_entities(text: Column, least: int = 2) -> Column:
    """Lower-cased white-space tokens of `least` characters or more: the entities of a query where no recogniser is given."""
    return F.filter(folded_tokens(text), lambda t: F.length(t) >= least)
