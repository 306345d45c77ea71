"""Corrective rewrites: keep those that stay on topic, else split the question itself."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.text import casefold, let, rewrite_terms, strip

# FIXED VALUES: conjunctions and punctuation that separate the parts of a question
SPLIT_PATTERN = r"(?iuU)\s+(?:и|или|а также)\s+|[;,]"
EDGE_PUNCTUATION = r"^[ \t\r\n?.!]+|[ \t\r\n?.!]+$"
MAX_REWRITES = 2


def fallback_rewrites(query: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(F.regexp_replace(query, EDGE_PUNCTUATION, ""), SPLIT_PATTERN), strip),
        lambda p: F.size(rewrite_terms(p)) > 0,
    )
    return let(
        parts,
        lambda ps: F.when(F.size(ps) >= 2, F.slice(ps, 1, MAX_REWRITES)).otherwise(F.array(strip(query))),
    )


def filter_rewrites(query: Column, rewrites: Column) -> Column:
    """Non-blank, case-insensitively distinct rewrites sharing a term with the question."""

    def on_topic(terms: Column) -> Column:
        clean = F.filter(F.transform(rewrites, strip), lambda r: r != "")

        def pick(rs: Column) -> Column:
            keys = F.transform(rs, casefold)
            return let(
                keys,
                lambda ks: F.filter(
                    rs,
                    lambda r, i: (F.array_position(ks, casefold(r)) == i + 1)
                    & F.arrays_overlap(terms, rewrite_terms(r)),
                ),
            )

        return let(
            let(clean, pick),
            lambda v: F.when((F.size(terms) > 0) & (F.size(v) > 0), F.slice(v, 1, MAX_REWRITES)),
        )

    return F.coalesce(let(rewrite_terms(query), on_topic), fallback_rewrites(query))


def clean_rewrites(rewrites: Column, limit: int) -> Column:
    """Strip, drop blanks, distinct in order, cut to the contract's limit."""
    return F.slice(
        F.array_distinct(F.filter(F.transform(rewrites, strip), lambda r: r != "")), 1, limit
    )
