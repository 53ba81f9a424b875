"""Lexical features of domain names."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ENGLISH_PAIRS, PAIR_TOTAL


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    chars, n = characters(text), F.char_length(text).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    total = F.aggregate(F.array_sort(shares), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total).otherwise(0.0)


def grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, in order."""
    last = F.char_length(text) - (n - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def pair_logs() -> Column:
    rows = [x for pair, n in ENGLISH_PAIRS.items() for x in (F.lit(pair), F.lit(math.log2(n / PAIR_TOTAL)))]
    return F.create_map(*rows)


def ngram_score(text: Column) -> Column:
    """Mean log2 probability of letter pairs under English counts; 0 below two letters."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    rare, known = F.lit(math.log2(0.5 / PAIR_TOTAL)), pair_logs()
    logs = F.transform(grams(letters, 2), lambda p: F.coalesce(F.try_element_at(known, p), rare))
    n = F.char_length(letters) - 1
    return F.when(n >= 1, F.aggregate(logs, F.lit(0.0), lambda acc, x: acc + x) / n).otherwise(0.0)


def dns_lexical(query: Column, events: Column | None = None, domains: Column | None = None, longest: Column | None = None) -> dict[str, Column]:
    """Eleven features of a query name; flow counters default to one event, one domain and its length."""
    labels, n = F.split(query, r"\."), F.char_length(query)
    one = F.lit(1.0)
    return {
        "dns_query_length": n.cast("double"),
        "dns_entropy": char_entropy(labels[0]),
        "dns_digit_ratio": F.regexp_count(query, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
        "dns_label_count": F.size(labels).cast("double"),
        "dns_longest_label": F.array_max(F.transform(labels, F.char_length)).cast("double"),
        "dns_unique_bigram_count": F.size(F.array_distinct(grams(query, 2))).cast("double"),
        "dns_unique_trigram_count": F.size(F.array_distinct(grams(query, 3))).cast("double"),
        "dns_event_count": one if events is None else F.coalesce(events.cast("double"), one),
        "dns_unique_domain_count_per_flow": one if domains is None else F.coalesce(domains.cast("double"), one),
        "dns_max_query_length_per_flow": n.cast("double") if longest is None else F.coalesce(longest.cast("double"), n.cast("double")),
        "ngram_score": ngram_score(query),
    }
