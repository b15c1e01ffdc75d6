"""Scalar functions: keywords, references, tokens and budgets, derived confidence, vectors."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONFIDENCE_CEILING, CONFIDENCE_FLOOR, PRIORS

#: Fixed patterns of identifiers that a keyword search should match exactly.
KEYWORDS = (
    r"\b[A-Z]-\d{3}\b",
    r"\b(?:Ground|Internal|Power|Connector|High|Other)\w*(?:Failure|Error)\b",
    r"\b(?:Terra|Troniq|Pulsar|Supernova|Hypercharger|PKM|RTM?)\s*\d+\b",
    r"\b\d+\.\d+\.[\dx]+\b",
    r"\b(?:coastal|outdoor_exposed|outdoor_sheltered|indoor)\b",
)
#: Fixed patterns: a reference, and one to a checkpoint.
REF = r"^[a-z_]+:[A-Za-z0-9._-]+$"
CHECKPOINT_REF = r"^agent_reasoning:([0-9]+)$"


def extract_keywords(text: Column, patterns: tuple[str, ...] = KEYWORDS) -> Column:
    """The distinct identifiers in a text, sorted."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def count_tokens(text: Column) -> Column:
    """1.3 tokens for each word, rounded down."""
    words = F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.floor(words * F.lit(13) / F.lit(10)).cast("int")


def effective_budget(budget: Column) -> Column:
    """Nine tenths, rounded down."""
    return F.floor(budget * 9 / 10).cast("int")


def derive_confidence(provenance: Column, confirmations: Column, contradictions: Column) -> Column:
    """Mean of the Beta posterior, clamped, then rounded to 2 places (half up on exact decimals)."""
    priors = F.create_map(*[x for k, (a, b) in PRIORS.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))])
    prior = F.coalesce(F.try_element_at(priors, provenance), F.array(*map(F.lit, PRIORS["session"])))
    c = F.greatest(F.lit(0), F.coalesce(confirmations, F.lit(0)).cast("long"))
    k = F.greatest(F.lit(0), F.coalesce(contradictions, F.lit(0)).cast("long"))
    mean = (c + prior[0]).cast("decimal(18,0)") / (c + k + prior[0] + prior[1]).cast("decimal(18,0)")
    return F.round(F.least(F.lit(CONFIDENCE_CEILING).cast("decimal(20,10)"), F.greatest(F.lit(CONFIDENCE_FLOOR).cast("decimal(20,10)"), mean.cast("decimal(20,10)"))), 2).cast("decimal(3,2)")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where a vector is null or has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, F.lit(1.0) - dot(a, b) / n)


def similarity(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, 4)


def truncate(text: Column, n: int, marker: str = "") -> Column:
    """The first n characters; a longer text ends with the marker."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(marker))).otherwise(text)


def parse_flags(text: Column) -> Column:
    """The texts of a JSON list of texts; null where it is null or no such list."""
    return F.from_json(text, "array<string>")


def parse_breakdown(text: Column) -> Column:
    """feature -> value of a JSON object of numbers; an empty map where it is null or no such object."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.create_map().cast("map<string,double>"))


def json_row(*columns: str) -> Column:
    """A row as JSON: decimals as numbers, times in ISO form, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})


def adjudicated(text: Column) -> Column:
    """The audit list in a JSON text: entries with a ref; an empty list where it is null or no JSON list."""
    parsed = F.from_json(text, "array<struct<ref:string,outcome:string,at:string>>")
    return F.coalesce(F.filter(parsed, lambda x: x["ref"].isNotNull()), F.array().cast(parsed_type()))


def parsed_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField("ref", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("at", T.StringType())]))


_REF = re.compile(r"^[a-z_]+:[A-Za-z0-9._-]+\Z")
FLAT = "refs array<string>, recovered int, nested int, dropped int, unmatched array<string>"


def flatten_one(value: str | None) -> tuple[list[str], int, int, int, list[str]]:
    """References in a JSON text of any nesting, or in a bare text; lists and mappings as texts within it included.

    Returns the valid references in order of first occurrence; how many texts were read as a list or mapping; how many
    lists or mappings lay inside others as such; how many values were no reference; and those of them that looked like
    one (with a colon, or a bracketed text that isn't JSON). Null has nothing in it.
    """
    refs: dict[str, None] = {}
    count = {"recovered": 0, "nested": 0, "dropped": 0}
    unmatched: list[str] = []

    def visit(x: object, inside: bool, is_layer: bool = False) -> None:
        if isinstance(x, (list, dict)):
            count["nested"] += inside and not is_layer
            for y in x.values() if isinstance(x, dict) else x:
                visit(y, inside or not is_layer)
            return
        text = x.strip() if isinstance(x, str) else ""
        if _REF.match(text):
            refs[text] = None
        elif text[:1] in ("[", "{"):
            try:
                layer = json.loads(text)
            except ValueError:
                count["dropped"] += 1
                unmatched.append(x)
                return
            count["recovered"] += 1
            visit(layer, inside, is_layer=True)
        else:
            count["dropped"] += 1
            if ":" in text:
                unmatched.append(x)

    if value is not None:
        try:
            top = json.loads(value)
        except ValueError:
            top = [value]
        visit(top, False)
    return list(refs), count["recovered"], count["nested"], count["dropped"], unmatched


def flatten_refs(values: Column) -> Column:
    """flatten_one of a column, as a struct."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([flatten_one(v) for v in s], columns=["refs", "recovered", "nested", "dropped", "unmatched"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, FLAT)(values)
