"""The pluggable ports: tokenizers, embedding, fact extraction, discovery and data providers, dispatch executors.

A port is a plain callable over Columns or DataFrames in a registry; providers that fail are left out with a warning.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text

# The global predicates and their aliases.
PREDICATES = [
    ("predicate-has-price", "has_price", "Has price", "price"),
    ("predicate-available-in-location", "available_in_location", "Available in location", "empty"),
    ("predicate-has-requirement", "has_requirement", "Has requirement", "empty"),
    ("predicate-has-contraindication", "has_contraindication", "Has contraindication", "empty"),
    ("predicate-compatible-with", "compatible_with", "Compatible with", "empty"),
    ("predicate-mentions", "mentions", "Mentions", "empty"),
]
PREDICATE_ALIASES = [
    ("price", "predicate-has-price"), ("cost", "predicate-has-price"), ("available in", "predicate-available-in-location"),
    ("applies to", "predicate-available-in-location"), ("requires", "predicate-has-requirement"), ("eligible for", "predicate-has-requirement"),
    ("contraindication", "predicate-has-contraindication"), ("compatible with", "predicate-compatible-with"), ("mentions", "predicate-mentions"),
]


def seed_registry(spark: SparkSession) -> DataFrame:
    """Predicates with their aliases, as a small table."""
    p = spark.createDataFrame(PREDICATES, "predicate_id string, key string, label string, attribute_schema string")
    return p.join(spark.createDataFrame(PREDICATE_ALIASES, "alias string, predicate_id string"), "predicate_id", "left")


@dataclass
class Registry:
    """Named implementations with a version."""

    found: dict[str, tuple[str, Callable]] = field(default_factory=dict)

    def add(self, key: str, version: str, f: Callable) -> None:
        self.found[key] = (version, f)

    def get(self, key: str) -> Callable:
        return self.found[key][1]


TOKENIZERS = Registry()
TOKENIZERS.add("whitespace", "1", text.token_count)


def count_tokens(c: Column, tokenizer: str = "whitespace") -> Column:
    return TOKENIZERS.get(tokenizer)(c)


PRICE = re.compile(r"(?i)\b(price|cost|requires?)\b[^.\n]{0,40}?(\d+(?:\.\d+)?)")


def fact_extractor(extract: Callable[[str], list[tuple[str, str]]] | None = None):
    """A table function text -> (predicate_text, value): 0..n candidate facts of a chunk. The default finds amounts."""
    from pyspark.sql.functions import udtf

    find = extract or (lambda t: [(m[1].lower(), m[2]) for m in PRICE.finditer(t)])

    class Extract:
        def eval(self, chunk: str):
            yield from find(chunk or "")

    return udtf(Extract, returnType="predicate_text string, value string")


def collect_providers(providers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """The union of what the providers return, and a warning for each that fails."""
    out, warnings = None, []
    for name, provide in providers.items():
        try:
            df = provide().withColumn("provider_key", F.lit(name))
        except Exception as e:  # a provider may fail in any way; the others still count
            warnings.append(f"{name}: {type(e).__name__}")
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, warnings


def dispatch(commands: DataFrame, execute: Callable[[dict], str]) -> DataFrame:
    """commands with a receipt: executed and what execute returned, or failed and the reason it raised.

    The commands of a lost task are executed again, so execute must be idempotent.
    """
    def receipt(command: dict) -> tuple[str, str]:
        try:
            return "executed", execute(command)
        except Exception as e:  # an executor may fail in any way
            return "failed", str(e)

    def run(batches):
        for pdf in batches:
            got = [receipt(c) for c in pdf.to_dict("records")]
            yield pdf.assign(status=[s for s, _ in got], detail=[x for _, x in got])

    return commands.mapInPandas(run, T.StructType([*commands.schema.fields, T.StructField("status", T.StringType()), T.StructField("detail", T.StringType())]))
