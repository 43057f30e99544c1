"""What models return, as typed columns: missing or mistyped fields take defaults, items that don't fit are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLAIM = "struct<text:string,evidence_ids:array<string>,support:string>"


def now_iso() -> Column:
    """The present moment in UTC, as ISO 8601."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _kind(value: Column) -> Column:
    """The type of a variant as it is written in a schema; `VOID` for JSON's null, null for what isn't there."""
    return F.schema_of_variant(value)


def _text(value: Column, path: str, default: Column) -> Column:
    found = F.try_variant_get(value, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(value, path, "string")).otherwise(default)


def coerced_claims(value: Column) -> Column:
    """array<CLAIM> from a JSON text: of a list of objects and strings, or of an object, whose keys count as strings.

    An object needs a text; its evidence_ids default to none and its support to `supported`. A string is a claim without
    support. Everything else, and what doesn't parse, gives nothing.
    """
    variant = F.try_parse_json(value)
    none = F.array().cast(f"array<{CLAIM}>")
    claim = lambda text, ids, support: F.struct(text.alias("text"), ids.alias("evidence_ids"), support.alias("support")).cast(CLAIM)
    no_ids = F.array().cast("array<string>")

    def one(item: Column) -> Column:
        part = lambda path: F.try_variant_get(item, path, "variant")
        ids, support = part("$.evidence_ids"), part("$.support")
        fits = (_kind(part("$.text")) == "STRING") & (ids.isNull() | _kind(ids).isin("ARRAY<STRING>", "ARRAY<VOID>")) & (support.isNull() | (_kind(support) == "STRING"))
        made = claim(F.try_variant_get(item, "$.text", "string"), F.coalesce(F.try_variant_get(item, "$.evidence_ids", "array<string>"), no_ids), F.coalesce(F.try_variant_get(item, "$.support", "string"), F.lit("supported")))
        bare = claim(F.try_variant_get(item, "$", "string"), no_ids, F.lit("unsupported"))
        return F.when(_kind(item).startswith("OBJECT") & fits, made).when(_kind(item) == "STRING", bare)

    items = F.filter(F.transform(F.try_variant_get(variant, "$", "array<variant>"), one), lambda c: c.isNotNull())
    keys = F.transform(F.json_object_keys(value), lambda k: claim(k, no_ids, F.lit("unsupported")))
    return F.coalesce(F.when(_kind(variant).startswith("ARRAY"), items).when(_kind(variant).startswith("OBJECT"), keys), none)


def _list(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "array<string>"), F.array().cast("array<string>"))


def _flag(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "boolean"), F.lit(False))


def _number(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "double"), F.lit(0.0))


def analysis(text: Column, query: Column) -> Column:
    """intent, entities, keywords, complexity, requires_multi_hop, query_rewrite, original_query. The rewrite defaults to the query."""
    v = F.try_parse_json(text)
    rewrite = F.coalesce(F.nullif(_text(v, "$.query_rewrite", F.lit("")), F.lit("")), query)
    return F.struct(
        _text(v, "$.intent", F.lit("query")).alias("intent"), _list(v, "$.entities").alias("entities"), _list(v, "$.keywords").alias("keywords"), _text(v, "$.complexity", F.lit("medium")).alias("complexity"),
        _flag(v, "$.requires_multi_hop").alias("requires_multi_hop"), rewrite.alias("query_rewrite"), query.alias("original_query"),
    )


def reasoning(text: Column, no_answer: str) -> Column:
    """answer, reasoning_path, sources_used, confidence, limitations."""
    v = F.try_parse_json(text)
    return F.struct(
        _text(v, "$.answer", F.lit(no_answer)).alias("answer"), _list(v, "$.reasoning_path").alias("reasoning_path"), _list(v, "$.sources_used").alias("sources_used"),
        _number(v, "$.confidence").alias("confidence"), _text(v, "$.limitations", F.lit("")).alias("limitations"),
    )


def verification(text: Column) -> Column:
    """is_supported, hallucination_detected, confidence, issues, source_mapping (JSON)."""
    v = F.try_parse_json(text)
    mapping = F.coalesce(F.try_variant_get(v, "$.source_mapping", "string"), F.lit("{}"))
    return F.struct(_flag(v, "$.is_supported").alias("is_supported"), _flag(v, "$.hallucination_detected").alias("hallucination_detected"), _number(v, "$.confidence").alias("confidence"), _list(v, "$.issues").alias("issues"), mapping.alias("source_mapping"))
