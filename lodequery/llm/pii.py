"""Personal data: regular expressions propose spans, checksum validators confirm them, context words adjust the score.

Everything is a DataFrame expression, so a scan of the texts is one stage without shuffle or Python. Positions come from
cutting a text at its matches: Spark returns the pieces and the matches, and their lengths in code points add up to the
offsets. All work is linear in a text and its hits: spans are gathered by blocks, and what stands around one is cut from
pieces of bounded size. The patterns are written so that Java's matcher neither recurses per character nor rescans a run: quantified
groups are possessive, and a match starts only where a run starts or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, named

#: Context windows: so many code points before and after a span.
CONTEXT = 48
#: What a context word for a kind adds to a span's score, and what one against it takes away.
RAISE, LOWER = 0.2, 0.3
#: Hits that are gathered together, and code points in a piece of text.
BLOCK, PIECE = 256, 1024


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. base: kept whatever its score; else the score must reach MIN_SCORE.

    words, against: context that raises or lowers the score.
    """

    name: str
    needs: str
    pattern: str
    base: bool
    prior: float
    words: str
    against: str
    label: str


_L, _D = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: In the order in which spans that start together are listed.
KINDS = (
    Kind("email", "@", rf"(?:\G|(?<!{_L})){_L}++@{_D}++(?:\.{_D}++)++", True, 0.9, r"e-?mail|contact|mail|write|correo|courriel", r"example|no-?reply", "<EMAIL>"),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, r"\bip\b|host|server|address|login|adresse", r"version|release|section", "<IP>"),
    Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", True, 0.7, r"card|visa|credit|debit|payment|karte|tarjeta|carte", r"order|invoice|tracking|serial|isbn", "<CARD>"),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.7, r"phone|call|tel|mobile|fax|whatsapp|anruf", r"order|invoice|tracking|serial", "<PHONE>"),
    # Takes the first four characters only, so that candidates may overlap; the group is what follows at most.
    Kind("iban", "", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}", False, 0.75, r"iban|account|bank|konto|cuenta|compte", r"example|specimen|dummy|beispiel", "<IBAN>"),
    Kind("ssn", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.4, r"ssn|social security|tax id|taxpayer", r"order|invoice|part no|serial|example", "<SSN>"),
)
MIN_SCORE = 0.5
#: Lengths of IBANs by country. They only say which of several valid ends is taken; other countries' have the longest.
IBAN_LENGTHS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 "
    "HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 "
    "QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
).split())


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    """IBAN check: country and check digits moved to the end, letters as 10 to 35, the number modulo 97 is 1."""
    bare = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _iban(candidate: Column) -> Column:
    """The valid IBAN that the candidate starts with, or null: it may end before any space, and at the candidate's end."""
    words = F.split(candidate, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    valid = F.filter(starts, lambda m: F.replace(m, F.lit(" "), F.lit("")).rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & _mod97(m))
    usual = F.create_map(*(F.lit(x) for k, v in IBAN_LENGTHS.items() for x in (k, int(v))))
    exact = F.filter(valid, lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))) == F.try_element_at(usual, F.substring(m, 1, 2)))
    return F.coalesce(F.try_element_at(exact, F.lit(-1)), F.try_element_at(valid, F.lit(-1)))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return match.isNotNull()
    if kind == "ssn":  # areas 000, 666 and 900 up, group 00 and serial 0000 are never issued
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _folded(items: Column, state: dict[str, Column], out: Column, step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """The array of what step gives for each item (out: an empty array of its type), with state handed on from item to item.

    Items are taken BLOCK at a time, so that appending costs the same however many there are.
    """

    def one(acc: Column, item: Column) -> Column:
        now, more = step(acc, item)
        return F.struct(*(c.alias(k) for k, c in now.items()), F.concat(acc["out"], more).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), F.struct(*(acc[k].alias(k) for k in state), out.alias("out")), one)
        return _let(inner, lambda x: F.struct(*(x[k].alias(k) for k in state), F.concat(acc["all"], F.array(x["out"])).alias("all")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) + BLOCK - 1) / BLOCK).cast("int") - 1)
    whole = F.aggregate(blocks, F.struct(*(c.alias(k) for k, c in state.items()), F.slice(F.array(out), F.lit(1), F.lit(0)).alias("all")), block, lambda acc: F.flatten(acc["all"]))
    return F.when(F.size(items) > 0, whole).otherwise(out)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text in pieces; empty if end isn't greater."""
    first = F.floor(start / PIECE).cast("int")
    count = F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(pieces, first + 1, count), ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<kind,start,end,score>> of one kind. A text without the needed character isn't searched."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    inner = kind.name == "iban"

    def spans_of(pairs: Column, pieces: Column) -> Column:
        def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
            start = acc["at"] + x["gap"]
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            around = F.lower(F.concat(_cut(pieces, F.greatest(start - CONTEXT, F.lit(0)), start), F.lit(" "), _cut(pieces, end, end + CONTEXT)))
            score = _let(around, lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.prior) + F.when(a.rlike(kind.words), RAISE).otherwise(0.0) - F.when(a.rlike(kind.against), LOWER).otherwise(0.0))))
            keep = F.coalesce(_valid(kind.name, x["m"]), F.lit(False))
            if inner:
                keep = keep & (start >= acc["last"])
            spans = _let(score, lambda v: F.when(F.lit(kind.base) | (v >= MIN_SCORE), F.array(F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), v.alias("score")))).otherwise(empty))
            return _let_state(F.when(keep, spans).otherwise(empty), start + 4 if inner else end, end, acc)

        return _folded(pairs, {"at": F.lit(0), "last": F.lit(0)}, empty, step)

    def _let_state(spans: Column, at: Column, end: Column, acc: Column) -> tuple[dict[str, Column], Column]:
        last = F.when(F.size(spans) > 0, end).otherwise(acc["last"]) if inner else end
        return {"at": at, "last": last}, spans

    def of_matches(matches: Column) -> Column:
        cut = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
        found = F.transform(matches, _iban) if inner else matches
        pairs = F.zip_with(cut, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
        return F.when(F.size(matches) > 0, _let(pairs, lambda x: _let(_pieces(text), lambda y: spans_of(x, y)))).otherwise(empty)

    searched = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(int(inner))), of_matches)
    return F.when(F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]"), searched).otherwise(empty)


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii_spans") -> DataFrame:
    """Add array<struct<kind,start,end,score>>, by start, then kind as listed in KINDS. Null or empty text: no spans.

    start and end are code points, end exclusive. Kinds are searched separately, so spans of different kinds may overlap;
    those that start together are in the order of KINDS. Texts of any length are searched whole, and repeated rows each for
    itself. Other columns are kept whatever their names; a column named as `into` is replaced.
    """
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k.name), F.lit(i))))
    every = F.concat(*(_found(F.coalesce(F.col(f"`{text}`"), F.lit("")), k) for k in KINDS))
    keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
    in_order = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return docs.withColumn(into, in_order)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: counts of base spans, their digest, all spans, and spans with scores."""
    base = [k.name for k in KINDS if k.base]
    spans = with_spans(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "found").select("doc_id", "found")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return spans.select(
        "doc_id",
        *(F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_listed(own).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["score"], 2))), ",").alias("scored_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span by its kind's label; of overlapping spans the first label stands and the union is removed.

    Null texts stay null, texts without spans are unchanged.
    """
    label = F.create_map(*(x for k in KINDS for x in (F.lit(k.name), F.lit(k.label))))
    body, found = F.col(f"`{text}`"), free_name(docs, "spans")

    def cut(pieces: Column) -> Column:
        def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
            parts = F.when(s["start"] < acc["at"], F.array().cast("array<string>")).otherwise(F.array(_cut(pieces, acc["at"], s["start"]), label[s["kind"]]))
            return {"at": F.greatest(acc["at"], s["end"])}, parts

        parts = _folded(F.col(found), {"at": F.lit(0)}, F.array().cast("array<string>"), step)
        return F.concat(F.array_join(parts, ""), _cut(pieces, F.array_max(F.transform(found, lambda s: s["end"])), F.length(body)))

    replaced = F.when(body.isNull() | (F.size(found) == 0), body).otherwise(_let(_pieces(body), cut))
    spanned = with_spans(docs, text, found)
    return spanned.select(*(replaced.alias(c) if c == text else named(c) for c in docs.columns))
