"""What recognition and language services answer: JSON of several shapes, read as VARIANT."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MESSAGE = "$.choices[0].message"
_ARGUMENTS = f"{_MESSAGE}.tool_calls[0].function.arguments"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def tool_arguments(body: Column) -> Column:
    """The arguments of the first tool call as VARIANT; null on bad JSON."""
    v = F.try_parse_json(body)
    return F.try_parse_json(_get(v, _ARGUMENTS))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _texts(items: Column, names: tuple[str, ...], glue: str, blanks: bool = False) -> Column:
    """The first non-empty of some fields, or the string itself, of each item of an array of variants."""
    own = lambda x: F.coalesce(*[_filled(_get(x, f"$.{n}")) for n in names], F.when(F.schema_of_variant(x) == "STRING", _get(x, "$")), F.lit(""))
    found = F.transform(items, own)
    return F.array_join(found if blanks else F.filter(found, lambda t: t != ""), glue)


def extracted_text(body: Column) -> Column:
    """The text of an answer: tool arguments, their raw string, content, its parts, markdown, text, data; else empty."""
    v = F.try_parse_json(body)
    raw = _get(v, _ARGUMENTS)
    args = F.try_parse_json(raw)
    listed = F.coalesce(F.try_variant_get(args, "$", "array<variant>"), F.array(args))
    from_args = F.when(args.isNotNull(), _filled(_texts(listed, ("text", "markdown"), "\n\n"))).otherwise(_filled(raw))
    content = F.when(_kind(v, f"{_MESSAGE}.content") == "STRING", _filled(_get(v, f"{_MESSAGE}.content")))
    parts = _texts(F.try_variant_get(v, f"{_MESSAGE}.content", "array<variant>"), ("text",), "\n", blanks=True)
    plain = [F.when(_kind(v, f"$.{n}") == "STRING", _get(v, f"$.{n}")) for n in ("markdown", "text")]
    data = _texts(F.try_variant_get(v, "$.data", "array<variant>"), ("markdown", "text", "content"), "\n\n")
    return F.coalesce(from_args, content, parts, *plain, data, F.lit(""))


def page_blocks(answers: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """Blocks of each answer, nested once or twice: ``key, block_idx, type, xmin, ymin, xmax, ymax, text``.

    An answer without blocks gives one text block without a box, if it has any text.
    """
    v = tool_arguments(F.col(body))
    outer = F.try_variant_get(v, "$", "array<variant>")
    inner = F.try_variant_get(v, "$[0]", "array<variant>")
    found = F.filter(F.coalesce(inner, outer), lambda x: F.try_variant_get(x, "$.type", "string").isNotNull() | F.try_variant_get(x, "$.bbox", "variant").isNotNull())
    fallback = F.when(extracted_text(F.col(body)) != "", F.array(F.to_variant_object(F.struct(F.lit("Text").alias("type"), extracted_text(F.col(body)).alias("text")))))
    blocks = F.when(F.size(found) > 0, found).otherwise(fallback)
    box = [F.try_variant_get("b", f"$.bbox.{n}", "double").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")]
    return answers.select(*key, F.posexplode(blocks).alias("block_idx", "b")).select(*key, "block_idx", F.coalesce(F.try_variant_get("b", "$.type", "string"), F.lit("Text")).alias("type"), *box, F.coalesce(F.try_variant_get("b", "$.text", "string"), F.lit("")).alias("text"))


def model_names(body: Column, method: str | None = None) -> Column:
    """Distinct sorted names of a list of models; with ``method``, of those that offer it, without their prefix."""
    v = F.try_parse_json(body)
    if method is None:
        names = F.transform(F.try_variant_get(v, "$.data", "array<variant>"), lambda m: F.try_variant_get(m, "$.id", "string"))
    else:
        able = F.filter(F.try_variant_get(v, "$.models", "array<variant>"), lambda m: F.array_contains(F.try_variant_get(m, "$.supportedGenerationMethods", "array<string>"), method))
        names = F.transform(able, lambda m: F.regexp_replace(F.try_variant_get(m, "$.name", "string"), "^models/", ""))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")))


def can_retry(error: Column) -> Column:
    return F.coalesce(error.rlike(r"(?i)429|500|503|quota|rate|overload|unavailable|resource_exhausted"), F.lit(False))


def first_json(text: str):
    """The first balanced object in a text, fenced or not."""
    start = (text or "").find("{")
    if start < 0:
        raise ValueError("no JSON in the answer")
    return json.JSONDecoder().raw_decode(text[start:])[0]


def outer_json(text: str):
    """What stands from the first opening brace to the last closing one, read as JSON."""
    start, end = (text or "").find("{"), (text or "").rfind("}")
    if start < 0 or end <= start:
        raise ValueError("no JSON in the answer")
    return json.loads(text[start : end + 1])


#: Fixed address for endpoints that can't be read.
MODELS_URL = "https://integrate.api.nvidia.com/v1/models"


def models_url(endpoint: Column) -> Column:
    """Where a service lists its models, from the address where it answers; its query is dropped."""
    host = F.regexp_extract(endpoint, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(endpoint, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), r"/chat/completions/?$", "/models")
    return F.when(F.coalesce(host, F.lit("")) == "", MODELS_URL).otherwise(F.concat(host, F.when(path.endswith("/models"), path).otherwise("/v1/models")))


def matching_models(names: DataFrame, query: str, column: str = "name") -> DataFrame:
    """Names that hold a text, without regard to case; all of them if none does, which one aggregate tells."""
    hit = F.contains(F.lower(column), F.lit(query.strip().lower()))
    some = names.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_some"))
    return names.join(F.broadcast(some), hit | ~F.col("_some")).drop("_some")  # a single row


def reviewed_differences(answers: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, id, classification, explanation`` of proposed classes (``keys, id, classification, explanation``).

    Only for issues that were asked about, with a known class; explanations are cut at 240 characters.
    """
    known = answers.where(F.col("classification").isin("real_omission", "extraction_artifact", "uncertain"))
    cut = F.left(F.coalesce("explanation", F.lit("")), F.lit(240)).alias("explanation")
    return known.join(issues.select(*keys, "id").distinct(), [*keys, "id"], "left_semi").select(*keys, "id", "classification", cut)


def passage_choice(choice: Column, text: Column, canonical: Column) -> Column:
    """Struct of what an answer chose for a passage and the text that follows from it; null text where it proposes none.

    Unknown choices count as the canonical text.
    """
    picked = F.when(choice.isin("artifact", "canonical", "proposal"), choice).otherwise("canonical")
    chosen = F.when(picked == "proposal", F.coalesce(text, F.lit(""))).otherwise(canonical)
    return F.struct(picked.alias("choice"), F.when((picked == "artifact") | (F.trim(chosen) != ""), chosen).alias("text"))
