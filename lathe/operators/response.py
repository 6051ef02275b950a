"""Responses of a model: JSON extraction by five strategies in order, findings in one form, and what of them is valid."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import category_from_response, clamped, severity_from_response

#: What a response without context says, the fenced form, and the length of the summary that is kept of it.
EMPTY_CONTEXT, FENCED, SUMMARY = ("no code changes", "no context items"), r"(?is)```(?:json)?\s*\n(.*?)\n```", 500
#: Limits of a finding's lists and of a quote.
RELATED, EXAMPLES, QUOTE = 10, 3, 500
FINDING = "struct<title:string,message:string,description:string,severity:string,category:string,file_path:string,suggested_fix:string,confidence:string,hunk_id:string,line_in_hunk:string,line:string,line_hint:string,evidence:struct<context_item_id:string,snippet_line_range:array<int>,quote:string>,related_symbols:array<string>,code_examples:array<string>>"
REVIEW = f"struct<findings:array<{FINDING}>,summary:string,patterns:array<string>,recommendations:array<string>>"


def _valid(x: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(x).isNotNull(), x)


def _braces(x: Column) -> Column:
    """From the first opening to the last closing brace; null without both in that order."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def literal(raw: str | None) -> str | None:
    """A Python dict in source form as JSON."""
    try:
        found = ast.literal_eval(raw) if raw else None
        return json.dumps(found) if isinstance(found, dict) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def _literals(raw: pd.Series) -> pd.Series:
    return raw.map(literal)


def extracted(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """responses with body (JSON text; null if there is none) and strategy.

    In order: empty (nothing there), no_context (the response says that there
    is nothing to review, and is its own summary), direct, fenced, braces,
    literal (a Python dict), repaired (without trailing commas, or with double
    for single quotes where there are none), failed. All but the literals run
    in the JVM; Python only sees what the strategies before it couldn't read.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    rows = responses.withColumn("_text", text)
    says = F.lit(False)
    for words in EMPTY_CONTEXT:
        says = says | F.contains(F.lower("_text"), F.lit(words))
    summary = F.to_json(F.struct(F.array().cast("array<string>").alias("findings"), F.substring("_text", 1, SUMMARY).alias("summary")))
    inner = F.regexp_replace(F.nullif(F.regexp_extract("_text", FENCED, 1), F.lit("")), r"^\s+|\s+$", "")
    rows = rows.withColumn("_braces", _braces(F.col("_text"))).withColumn("_fenced", F.coalesce(_valid(inner), _valid(_braces(inner))))
    rows = rows.withColumn("_direct", _valid(F.col("_text"))).withColumn("_inside", _valid(F.col("_braces")))
    known = F.when(F.col("_text") == "", "empty").when(says, "no_context").when(F.col("_direct").isNotNull(), "direct").when(F.col("_fenced").isNotNull(), "fenced").when(F.col("_inside").isNotNull(), "braces")
    rows = rows.withColumn("_known", known)
    rows = rows.withColumn("_literal", F.pandas_udf(_literals, "string")(F.when(F.col("_known").isNull(), F.col("_braces"))))
    fewer = F.regexp_replace("_braces", r",\s*([}\]])", "$1")
    quoted = F.when(~F.contains("_braces", F.lit('"')) & F.contains("_braces", F.lit("'")), F.replace("_braces", F.lit("'"), F.lit('"')))
    rows = rows.withColumn("_repaired", F.coalesce(_valid(fewer), _valid(quoted)))
    strategy = F.coalesce("_known", F.when(F.col("_literal").isNotNull(), "literal").when(F.col("_repaired").isNotNull(), "repaired").otherwise("failed"))
    body = F.when(F.col("_known") == "no_context", summary).when(F.col("_known") == "empty", F.lit(None).cast("string"))
    body = body.when(F.col("_known") == "direct", F.col("_direct")).when(F.col("_known") == "fenced", F.col("_fenced")).when(F.col("_known") == "braces", F.col("_inside")).otherwise(F.coalesce("_literal", "_repaired"))
    return rows.withColumn("strategy", strategy).withColumn("body", body).drop("_text", "_braces", "_fenced", "_direct", "_inside", "_known", "_literal", "_repaired")


def findings_of(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of JSON bodies in one form, a row each with its place: aliases resolved, severities, categories and confidences normalised, lists cut."""
    rows = bodies.select(*keys, F.from_json("body", REVIEW).alias("review")).select(*keys, F.posexplode("review.findings").alias("place", "f"))
    quote = F.col("f.evidence.quote")
    evidence = F.when(F.col("f.evidence").isNotNull(), F.struct(F.col("f.evidence.context_item_id"), F.coalesce("f.evidence.snippet_line_range", F.array().cast("array<int>")).alias("snippet_line_range"), F.when(F.length(quote) > QUOTE, F.concat(F.substring(quote, 1, QUOTE - 3), F.lit("..."))).otherwise(quote).alias("quote")))
    return rows.select(
        *keys, F.col("place").cast("long").alias("place"), F.coalesce("f.title", F.lit("Untitled Finding")).alias("title"), F.coalesce(F.nullif("f.message", F.lit("")), "f.description", F.lit("")).alias("message"),
        severity_from_response(F.coalesce("f.severity", F.lit(""))).alias("severity"), category_from_response(F.coalesce("f.category", F.lit(""))).alias("category"), F.coalesce("f.file_path", F.lit("")).alias("file_path"),
        F.coalesce("f.suggested_fix", F.lit("")).alias("suggested_fix"), clamped(F.expr("try_cast(f.confidence AS DOUBLE)")).alias("confidence"), F.col("f.hunk_id").alias("hunk_id"),
        F.expr("try_cast(coalesce(f.line_in_hunk, f.line, f.line_hint) AS INT)").cast("long").alias("line_hint"), evidence.alias("evidence"), F.slice("f.related_symbols", 1, RELATED).alias("related_symbols"), F.slice("f.code_examples", 1, EXAMPLES).alias("code_examples"),
    )


def repairs(raw: Column | str) -> Column:
    return F.pandas_udf(_literals, "string")(raw)
