"""Scalar functions over text; all but nfkc are built from Spark's own."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""))


def tokens(x: Column) -> Column:
    """The simple analyser: lower case, letters and digits, no stemming and no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def code_tokens(x: Column) -> Column:
    """Names split where small letters meet capitals, at digits and at underscores."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{L})(\p{N})", "$1 $2")
    return tokens(spaced)


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("="))


def strict_date(x: Column) -> Column:
    """A date of the form YYYY-MM-DD, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date"))


def yaml_kind(x: Column) -> Column:
    """The core-schema kind of a plain scalar."""
    return (
        F.when(x.rlike(r"^(null|Null|NULL|~|)$"), "null")
        .when(x.rlike(r"^(true|True|TRUE|false|False|FALSE)$"), "bool")
        # The numbers of the YAML 1.2 core schema.
        .when(x.rlike(r"^[-+]?[0-9]+$|^0o[0-7]+$|^0x[0-9a-fA-F]+$"), "number")
        .when(x.rlike(r"^[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?$|^[-+]?(\.inf|\.Inf|\.INF)$|^(\.nan|\.NaN|\.NAN)$"), "number")
        .otherwise("string")
    )


def preview(summary: Column, body: Column, n: int) -> Column:
    """The summary, whole, if it has more than white space; else the body, beyond n characters cut at the last white space of their second half, with an ellipsis."""
    b = F.coalesce(body, F.lit(""))
    first, second = F.substring(b, 1, n // 2), F.substring(b, n // 2 + 1, n - n // 2)
    short = F.when(second.rlike(r"(?U)\s"), F.concat(first, F.regexp_extract(second, r"(?Us)^(.*)\s", 1))).otherwise(F.substring(b, 1, n))
    return F.when(F.coalesce(summary, F.lit("")).rlike(r"(?U)\S"), summary).when(F.length(b) <= n, b).otherwise(F.concat(short, F.lit("…")))
