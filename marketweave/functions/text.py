"""Text cleaning, normal forms, token counts and lexicon scores as column expressions.

Only entity decoding and NFKC have no Spark function; they share one Arrow-batched step in front of the expressions.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions import values as V

def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are costly and used more than once.

    The optimizer copies an expression into every filter and projection that uses it; it can't reach through a generator.
    """
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(row)).alias("_once")).select(*df.columns, *(F.col(f"_once.{n}").alias(n) for n in columns))


WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def _decode(series: pd.Series, label: str | None, footer: str | None) -> pd.Series:
    import html
    import unicodedata

    tag, url, hidden = re.compile(r"<[^>]+>"), re.compile(r"https?://\S+|www\.\S+"), re.compile("[\u200b-\u200f\u202a-\u202e\ufeff]")
    first = re.compile(label, re.IGNORECASE) if label else None
    last = re.compile(footer, re.IGNORECASE | re.DOTALL) if footer else None

    def one(text: str | None) -> str:
        if not isinstance(text, str):
            return ""
        if "&" in text:
            text = html.unescape(html.unescape(text))
        if first:
            text = first.sub("", text)
        if last:
            text = last.sub("", text)
        if "<" in text:
            text = tag.sub(" ", text)
        if "http" in text or "www." in text:
            text = url.sub(" ", text)
        return text if text.isascii() else unicodedata.normalize("NFKC", hidden.sub("", text))

    return series.map(one)


def decode(text: Column, label: str | None = None, footer: str | None = None) -> Column:
    """Entities decoded twice, tags and urls blanked, hidden marks dropped, NFKC; null gives an empty text.

    ``label`` is cut at the start and ``footer`` to the end, after decoding and before tags.
    """

    @F.pandas_udf("string")
    def batch(series: pd.Series) -> pd.Series:
        return _decode(series, label, footer)

    return batch(text)


def plain_signs(text: Column) -> Column:
    """Curly quotes, dashes and no-break spaces in their plain forms, an ellipsis as three dots."""
    return F.replace(F.translate(text, "".join(V.CURLY), "".join(V.CURLY.values())), F.lit("…"), F.lit("..."))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def cut_boilerplate(text: Column, patterns: tuple[str, ...]) -> Column:
    """Texts without the patterns' sentences; a text that holds none of their fixed words is not searched for them."""
    spaces = lambda p: p.replace(r"\s", r"[\s\x85\u2028\u2029]")  # noqa: E731  (what NFKC leaves besides ASCII white space)
    hinted = lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in V.BOILERPLATE_HINTS))
    cut = reduce(lambda t, p: F.regexp_replace(t, "(?i)" + spaces(p), " "), patterns, text)
    return F.when(F.element_at(F.transform(F.array(F.lower(text)), hinted), 1), cut).otherwise(text)


def clean_terms(text: Column) -> Column:
    """Cleaning for term weights; null and blank give an empty text."""
    return squeeze(cut_boilerplate(plain_signs(decode(text)), V.BOILERPLATE_TERMS))


def clean_transformer(text: Column) -> Column:
    """Cleaning for the transformer: fewer sentences go, a leading label and a trailing footer do."""
    decoded = decode(text, V.LEADING_LABEL, V.TRAILING_FOOTER)
    return squeeze(cut_boilerplate(plain_signs(decoded), V.BOILERPLATE_TRANSFORMER))


def normal_terms(text: Column, stopwords: tuple[str, ...] = V.STOPWORDS) -> Column:
    """Lower-case words with digits, % and $, joined by blanks; stop words and single signs are left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9%$][a-z0-9%$.]*"), F.lit(0))
    words = F.filter(F.transform(found, lambda w: F.btrim(w, F.lit("."))), lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    return F.array_join(words, " ")


def token_count(text: Column) -> Column:
    """Number of pieces between white space; 0 for an empty text, null for null."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")).cast("bigint") + F.when(text.isNotNull(), 0)


def chunks_needed(tokens: Column, longest: int = V.CHUNK_TOKENS, overlap: int = V.CHUNK_OVERLAP) -> Column:
    return F.when(tokens <= longest, F.lit(1)).otherwise(1 + F.ceil((tokens - longest) / (longest - overlap))).cast("bigint")


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", ""))


def join_parts(*parts: Column) -> Column:
    """Parts that are not empty, joined by full stop and blank."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ". ")


def transformer_text(title: Column, rest: Column) -> Column:
    return F.btrim(F.concat(F.rtrim(title, F.lit(". ")), F.lit(". "), rest), F.lit(". "))


def word_pattern(term: str) -> str:
    """Pattern for a term as a whole word in a lowered text."""
    return r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", term) + r"\b"


def matched_terms(text: Column, lexicon: dict[str, int] = V.LEXICON) -> Column:
    """Terms found as whole words, in the lexicon's order.

    The text is lowered once and searched for each term; only a term that occurs is matched against its (literal) pattern.
    """
    found = lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)) & low.rlike(word_pattern(t)), F.lit(t)) for t in lexicon)))
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(F.lower(text)), found), 1)).otherwise(F.array().cast("array<string>"))


def lexicon_score(terms: Column, lexicon: dict[str, int] = V.LEXICON) -> Column:
    """Sum of the weights of matched terms; a term inside another counts too."""
    heavy = F.array(*(F.lit(t) for t, w in lexicon.items() if w == 2))
    if set(lexicon.values()) <= {1, 2}:
        return (F.size(terms) + F.size(F.array_intersect(terms, heavy))).cast("bigint")
    weights = F.create_map(*(F.lit(x) for kv in lexicon.items() for x in kv))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + weights[t]).cast("bigint")


def has_negative(text: Column, phrases: tuple[str, ...] = V.NEGATIVE, whole_words: bool = True) -> Column:
    """Whether a rejecting phrase occurs, as whole words or anywhere; null for a null text."""

    def any_phrase(low: Column) -> Column:
        each = (F.contains(low, F.lit(p)) & low.rlike(word_pattern(p)) if whole_words else F.contains(low, F.lit(p)) for p in phrases)
        return reduce(lambda a, b: a | b, each)

    return F.element_at(F.transform(F.array(F.lower(text)), any_phrase), 1)


def keyword_groups(text: Column, groups: dict[str, tuple[str, ...]] = V.KEYWORD_GROUPS) -> Column:
    """Names of the groups of which a keyword occurs as whole words, letter case aside; none for a null text."""

    def named(low: Column) -> Column:
        hit = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) & low.rlike(word_pattern(w.lower())) for w in words))
        return F.array_compact(F.array(*(F.when(hit(words), F.lit(name)) for name, words in groups.items())))

    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(F.lower(text)), named), 1)).otherwise(F.array().cast("array<string>"))
