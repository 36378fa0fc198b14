"""Text cleaning, tokenising and per-row term statistics."""

from pyspark.sql import Column, functions as F

from newsflow.lexicons import STOP_WORDS

TAG = r"<[^>]*+>"
SYMBOL = r"[^\p{L}\p{N}\p{P}\p{Z}]"
WORD_GAP = r"[^\p{L}\p{N}]+"

EMPTY_RUNS = "array<struct<rank:int,term:string>>"


def _split_after_tags(c: Column) -> tuple[Column, Column]:
    """Text up to the last ``>``, which is all that can hold tags, and the rest.

    Without the split each ``<`` that is never closed would be searched to the end of
    the text: quadratic in a text full of them.
    """
    rest = F.substring_index(c, ">", -1)
    return F.substr(c, F.lit(1), F.length(c) - F.length(rest)), rest


def strip_tags(c: Column) -> Column:
    """Markup tags become a space; entities are left alone."""
    tagged, rest = _split_after_tags(c)
    return F.concat(F.regexp_replace(tagged, TAG, " "), rest)


def strip_symbols(c: Column) -> Column:
    """Everything but letters, numbers, punctuation and separators becomes a space."""
    return F.regexp_replace(c, SYMBOL, " ")


def strip_breaks(c: Column) -> Column:
    """Runs of CR, LF and TAB become one space."""
    return F.regexp_replace(c, r"[\r\n\t]+", " ")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """``collapse_space(strip_breaks(strip_symbols(strip_tags(lower(c)))))`` in two
    passes over the text: line breaks are symbols, and once symbols are spaces the only
    runs left to collapse are runs of spaces."""
    tagged, rest = _split_after_tags(F.lower(c))
    spaced = F.concat(F.regexp_replace(tagged, f"{TAG}|{SYMBOL}", " "), strip_symbols(rest))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def clean_link(c: Column) -> Column:
    """Links are lower-cased and collapsed but keep their symbols."""
    return collapse_space(F.lower(c))


def escape_text(c: Column) -> Column:
    """Double quotes to single quotes, line breaks to spaces; null to empty text."""
    return F.translate(F.coalesce(c, F.lit("")), '"\n\r', "'  ")


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters, INT."""
    return F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > 0))


def tokenize(c: Column, min_len: int) -> Column:
    """Alphanumeric runs of at least ``min_len`` (>= 1) characters that are not all
    ASCII digits, in text order, with repeats."""
    if min_len < 1:
        raise ValueError("min_len must be at least 1")
    return F.filter(
        F.split(c, WORD_GAP),
        lambda t: (F.length(t) >= min_len) & t.rlike("[^0-9]"),
    )


def drop_words(tokens: Column, words=STOP_WORDS) -> Column:
    """Tokens not in ``words``; a literal IN list becomes a hash set in the plan."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def lexicon_hits(tokens: Column, words) -> Column:
    """How many tokens are in ``words``, counting repeats, INT."""
    return F.size(F.filter(tokens, lambda t: t.isin(*words))) if words else F.lit(0)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a lambda variable is bound to
    a value, while a plain column could be re-evaluated at every mention."""
    return F.transform(F.array(value), body)[0]


def term_runs(tokens: Column) -> Column:
    """ARRAY<STRUCT<rank: INT, term: STRING>> with one entry per distinct token, rank
    being its negated count, so that ascending order is most frequent first.

    Sorts the tokens and measures the runs: O(n log n) per row with no shuffle, so it
    works the same on batch and streaming rows.
    """

    def runs(sorted_tokens: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(sorted_tokens) - 1),
            lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)),
        )
        both = F.struct(sorted_tokens.alias("terms"), starts.alias("starts"))
        measured = _let(
            both,
            lambda b: F.transform(
                b["starts"],
                lambda start, n: F.struct(
                    (start - F.coalesce(F.get(b["starts"], n + 1), F.size(b["terms"]))).alias(
                        "rank"
                    ),
                    F.get(b["terms"], start).alias("term"),
                ),
            ),
        )
        return F.when(F.size(sorted_tokens) > 0, measured).otherwise(
            F.array().cast(EMPTY_RUNS)
        )

    return _let(F.sort_array(tokens), runs)


def term_frequency(tokens: Column) -> Column:
    """MAP<STRING, INT> of token counts."""
    return F.map_from_entries(
        F.transform(term_runs(tokens), lambda e: F.struct(e["term"], -e["rank"]))
    )


def top_terms(tokens: Column, k: int = 8) -> Column:
    """The ``k`` most frequent tokens, ties in token order."""
    ranked = F.slice(F.sort_array(term_runs(tokens)), 1, k)
    return F.transform(ranked, lambda e: e["term"])


def join_text(title: Column, content: Column) -> Column:
    return F.concat_ws(" ", title, content)


def analysis_text(title: Column, content: Column) -> Column:
    """Text the sentiment lexicon is matched against."""
    return F.lower(F.trim(join_text(title, content)))
