"""Text normalisation and lexical scoring as Column expressions. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "(?U)\\s+"


def collapse(c: Column) -> Column:
    """White space runs become one space; no white space at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def token_count(c: Column) -> Column:
    """Number of white-space separated tokens; 0 for blank or null."""
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def normalize_chunk(c: Column) -> Column:
    return F.lower(collapse(c))


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def content_hash(*candidates: Column) -> Column:
    """SHA-256 of the first candidate that is not null."""
    return F.sha2(F.coalesce(*candidates), 256)


def normalize_entity(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(collapse(c)), "[._/]+", " "))


def normalize_keyword(c: Column) -> Column:
    """Trims first, then strips signs: a trailing sign leaves a trailing space."""
    kept = F.regexp_replace(F.lower(F.trim(c)), "[^\\p{L}\\p{N}\\s-]", " ")
    return F.regexp_replace(kept, SPACE, " ")


def normalize_concept(c: Column) -> Column:
    """Letters, digits, spaces and question marks, collapsed and trimmed last."""
    return collapse(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}\\s?]", " "))


def normalize_predicate(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "[_-]+", " "), SPACE, " "))


def stable_key(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.regexp_replace(normalize_concept(c), SPACE, "-"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(c: Column) -> Column:
    """Upper-cases the first character of each word and leaves the rest as it is."""
    return F.array_join(F.transform(F.split(collapse(c), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def query_terms(c: Column) -> Column:
    """Lower-cased terms in order, duplicates kept."""
    return F.filter(F.split(F.lower(collapse(c)), " "), lambda t: t != "")


def match_share(text: Column, terms: list[str]) -> Column:
    """Matched terms divided by terms; 0 for no terms. Substring match in the lower-cased text."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def any_contains(fields: list[Column], terms: list[str]) -> Column:
    """Whether any term occurs in any field (case-insensitive, no wildcards)."""
    found = F.lit(False)
    for f in fields:
        low = F.lower(F.coalesce(f, F.lit("")))
        for t in terms:
            found = found | low.contains(t.lower())
    return found


def has_word(c: Column, words: str) -> Column:
    """Whether one of the |-separated words (a regular expression) stands alone, with ASCII word boundaries."""
    return F.coalesce(c, F.lit("")).rlike(f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])")


def is_comparison(c: Column) -> Column:
    return has_word(c, "vs|versus|compare|comparison|alternative")


def ngrams(c: Column, longest: int = 6) -> Column:
    """Distinct word n-grams, 1..longest, shortest first."""
    words = query_terms(c)

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))

    by_n = [of(n) for n in range(1, longest + 1)]
    return F.array_distinct(F.concat(*by_n))


def geo_key(country: Column, region: Column, city: Column) -> Column:
    part = lambda c, f: F.when(F.trim(c) != "", f(F.trim(c)))
    joined = F.concat_ws(":", part(country, F.upper), part(region, F.upper), part(city, F.lower))
    return F.when(joined != "", joined)


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, "([\\\\%_])", "\\\\$1")


def natural_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined with NUL; null parts count as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def bounded_headers(headers: Column, entries: int = 100, characters: int = 2000) -> Column:
    """A map of headers with lower-case names and cut values, the first entries only; of names that differ in case the first stays."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  (f of a value that is computed once)
    cut = lambda v: F.substring(v, 1, characters)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def bounded(h: Column) -> Column:
        first = F.aggregate(F.arrays_zip(h["names"], h["values"]), none, lambda m, e: F.when(F.map_contains_key(m, e["names"]), m).otherwise(F.map_concat(m, F.create_map(e["names"], e["values"]))))
        alike = F.size(F.array_distinct(h["names"])) < F.size(h["names"])
        apart = F.map_from_arrays(F.slice(h["names"], 1, entries), F.transform(F.slice(h["values"], 1, entries), cut))
        return F.when(alike, F.transform_values(F.map_from_entries(F.slice(F.map_entries(first), 1, entries)), lambda _, v: cut(v))).otherwise(apart)

    return once(headers, lambda m: once(F.struct(F.transform(F.map_keys(m), F.lower).alias("names"), F.map_values(m).alias("values")), bounded))


def word_windows(c: Column, longest: int, overlap: int) -> Column:
    """Word windows of `longest`, stepping by max(1, longest - overlap), ending with the first that reaches the end."""
    step = max(1, longest - overlap)

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - longest) / F.lit(float(step))).cast("int"))
        windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, longest), " "))
        return F.when(F.size(words) > 0, windows).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(collapse(c), " "), lambda w: w != "")
    return F.get(F.transform(F.array(words), cut), F.lit(0))  # the words are found once, not again for each window
