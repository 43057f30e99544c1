"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how far to trust each,
and a document is kept if its posterior probability of being good is at least one half.

A document's votes form a code in base 3, so all that the estimate needs of the corpus is how many documents have each
code: at most 3 ** len(RULES) counts, whatever the corpus. Documents that fail the base rules don't take part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, same_columns, with_struct, written

SYMBOLS = "#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, code int"
BAD, ABSTAIN, GOOD = 0, 1, 2
#: For each rule, the share up to which it votes good and the share from which it votes bad; between them it abstains.
RULES = {
    "symbols": (0.02, 0.1),  # of SYMBOLS, per word
    "repeats": (0.05, 0.15),  # words in repeated 5-word windows
    "echoes": (0.02, 0.1),  # words equal to the word before
    "dup_lines": (0.0, 0.3),  # lines equal to an earlier line
    "capitals": (0.15, 0.5),  # upper case among cased letters
    "shouts": (0.03, 0.15),  # ! and ?, per word
    "non_letters": (0.12, 0.3),  # characters in words that are neither letters nor digits
    "long_words": (0.02, 0.1),  # words of over 30 characters
    "bare": (0.05, 0.2),  # words without a letter or digit
    "near_echoes": (0.15, 0.3),  # words equal to one of the three before
}
#: Where the estimate starts: the probability of each vote for good and bad documents. A rule seldom finds fault with a
#: good document; most kinds of bad document offend against few rules.
START = {"good": (0.005, 0.095, 0.90), "bad": (0.15, 0.2, 0.65)}
START_BAD, ROUNDS, PRIOR_COUNT = 0.15, 60, 1.0


def _measures(text: str) -> tuple:
    data = text.encode()
    words = data.split()  # bytes.split() parts at space and \t to \r, and at nothing else
    n = len(words)
    blanks = len(data) - sum(map(len, words))
    chars = len(text) - blanks
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.strip(" \t\n\v\f\r"))
    dup_lines = sum(lines.values()) - len(lines)
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 5 - max(i, upto)
                    upto = i + 5
    failed = n < 10 or 100 * repeated > 20 * n
    if not n:
        return n, chars, symbols, dup_lines, repeated, failed, 0
    letters = sum(map(len, _LETTERS.findall(text)))
    upper = sum(map(len, _UPPER.findall(text)))
    shares = (
        symbols / n, repeated / n, sum(map(bytes.__eq__, words, words[1:])) / n, dup_lines / max(1, sum(lines.values())), upper / max(1, letters),
        (text.count("!") + text.count("?")) / n, 1 - sum(map(len, _ALNUM.findall(text))) / max(1, chars), sum(len(w) > 30 for w in words) / n,
        1 - len(_LETTERED.findall(text)) / n, sum(map(_among, words[3:], words[2:], words[1:], words)) / n,
    )
    code = 0
    for share, (good, bad) in zip(shares, RULES.values(), strict=True):
        code = code * 3 + (BAD if share >= bad else GOOD if share <= good else ABSTAIN)
    return n, chars, symbols, dup_lines, repeated, failed, code


_LETTERS = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]+")
_LETTERED = re.compile(r"(?:[^\x20\x09-\x0D\w]|_)*+[^\W_][^\x20\x09-\x0D]*+")


def _among(w: bytes, a: bytes, b: bytes, c: bytes) -> bool:
    return w == a or w == b or w == c


_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]+")


def with_measures(docs: DataFrame, text: str = "text", into: str = "__quality") -> DataFrame:
    """Measures and votes of each text as a struct. A null text counts as an empty one: no words, base_failed.

    Texts of any length are measured whole, and repeated rows each for itself.
    """
    return with_struct(docs, into, FIELDS, lambda: lambda texts: zip(*(_measures(t or "") for t in texts), strict=True), text)


def votes_of(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, v = divmod(code, 3)
        out.append(v)
    return out[::-1]


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """For each code, the probability that such a document is good, by expectation-maximisation over the counts.

    An abstention says nothing and drops out of the likelihood. Ties in floating point can't matter: the codes are
    visited in ascending order.
    """
    codes = sorted(counts)
    votes = [votes_of(c) for c in codes]
    p_bad = START_BAD
    rates = [[[START["good"][v] for v in range(3)] for _ in RULES], [[START["bad"][v] for v in range(3)] for _ in RULES]]
    good = [0.5] * len(codes)
    for _ in range(ROUNDS):
        for k, vs in enumerate(votes):
            a, b = math.log(1 - p_bad), math.log(p_bad)
            for r, v in enumerate(vs):
                if v != ABSTAIN:
                    a += math.log(rates[0][r][v] / (rates[0][r][BAD] + rates[0][r][GOOD]))
                    b += math.log(rates[1][r][v] / (rates[1][r][BAD] + rates[1][r][GOOD]))
            good[k] = 1 / (1 + math.exp(min(700.0, b - a)))
        total = sum(counts.values())
        bad_mass = sum(counts[c] * (1 - g) for c, g in zip(codes, good, strict=True))
        p_bad = min(0.5, max(1e-6, (bad_mass + PRIOR_COUNT * START_BAD) / (total + PRIOR_COUNT)))
        for cls in (0, 1):
            for r in range(len(RULES)):
                mass = [PRIOR_COUNT * START["good" if cls == 0 else "bad"][v] for v in range(3)]
                for c, g, vs in zip(codes, good, votes, strict=True):
                    mass[vs[r]] += counts[c] * (g if cls == 0 else 1 - g)
                rates[cls][r] = [m / sum(mass) for m in mass]
    return dict(zip(codes, good, strict=True))


def fit(measured: DataFrame, into: str = "__quality") -> dict[int, float]:
    """Posteriors for every code that occurs among documents that pass the base rules."""
    own = F.col(f"`{into}`")
    seen = measured.where(~own["base_failed"]).groupBy(own["code"].alias("code")).count().collect()
    return posteriors({r["code"]: r["count"] for r in seen}) if seen else {}


def with_verdict(measured: DataFrame, model: dict[int, float], into: str = "__quality", p_good: str = "p_good", kept: str = "kept") -> DataFrame:
    """measured with the posterior probability of being good (null for documents that fail the base rules) and the verdict.

    Posteriors meet documents by code in a join; there are 3 ** len(RULES) codes at most, which is what is broadcast.
    """
    table = measured.sparkSession.createDataFrame(list(model.items()), f"`code of {p_good}` int, `{p_good}` double")
    own = F.col(f"`{into}`")
    met = measured.join(F.broadcast(table), (own["code"] == F.col(f"`code of {p_good}`")) & ~own["base_failed"], "left").drop(f"code of {p_good}")
    return met.withColumn(kept, F.coalesce(F.col(f"`{p_good}`") >= 0.5, F.lit(False)))


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that fail the base rules or are held to be good with a posterior probability under one half.

    A null, empty or blank text has no words and goes. Texts of any length are measured whole; equal texts have equal
    verdicts, and repeated rows stay or go together; a probability of exactly one half stays. A table without rows gives none.
    Rows that pass the base rules are written with their measures, so that estimate and verdicts measure once.
    """
    into, p, kept = (free_name(docs, x) for x in ("quality measures", "quality p_good", "quality kept"))
    measured = written(with_measures(docs, text, into).where(~F.col(f"`{into}`")["base_failed"]), "quality")
    return same_columns(with_verdict(measured, fit(measured, into), into, p, kept).where(F.col(f"`{kept}`")), docs)
