"""Case-code helpers: canonical form, contamination flag, match record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoxa.functions.patterns import strip_ws

# FIXED VALUES: match statuses, their confidences, and the note texts.
STATUS_EXACT = "exact"
STATUS_FUZZY = "fuzzy_io_swap"
STATUS_AMBIGUOUS = "ambiguous_io_swap"
STATUS_UNKNOWN = "unknown"
CONF_EXACT, CONF_FUZZY, CONF_AMBIGUOUS, CONF_UNKNOWN = 1.0, 0.75, 0.3, 0.0
NOTE_EMPTY = "Empty or whitespace-only clientCaseNumber"
NOTE_UNREGISTERED = "clientCaseNumber is not registered"
NOTE_FUZZY = "Matched via I/1 or O/0 canonical mapping"
NOTE_AMBIGUOUS = "Multiple possible matches for canonical form"


def canonical_code(code: Column) -> Column:
    """Strip + upper; from 11 characters on, 'I'->'1' and 'O'->'0' at the
    1-based positions 4, 11, 12 and 13; shorter codes are returned as is."""
    c = F.upper(strip_ws(F.coalesce(code, F.lit(""))))
    swapped = F.concat(c.substr(1, 3), F.translate(c.substr(4, 1), "IO", "10"),
                       c.substr(5, 6), F.translate(c.substr(11, 3), "IO", "10"),
                       c.substr(F.lit(14), F.length(c)))
    return F.when(F.length(c) < 11, c).otherwise(swapped)


def contamination(code: Column) -> Column:
    """'none' / 'I_only' / 'O_only' / 'I_and_O' on the upper-cased code."""
    c = F.upper(F.coalesce(code, F.lit("")))
    has_i, has_o = c.contains("I"), c.contains("O")
    return (F.when(~has_i & ~has_o, "none").when(has_i & has_o, "I_and_O")
            .when(has_i, "I_only").otherwise("O_only"))


def match_record(original: Column, exact_hit: Column, candidates: Column,
                 n_rows: Column | None = None) -> Column:
    """Match decision for one stripped code.

    ``exact_hit``: the code itself is registered (case-sensitive).
    ``candidates``: registered codes sharing its canonical form, one for each
    registry row (NULL when none); ``n_rows``: registry rows behind them,
    defaults to the number of candidates. Returns struct(matchedCode,
    matchStatus, matchConfidence, contamination, candidates, notes).
    """
    n = F.coalesce(n_rows if n_rows is not None else F.size(candidates), F.lit(0))
    empty = F.array().cast("array<string>")
    first = F.get(candidates, 0)

    def rec(matched, status, conf, contam, cands, note):
        return F.struct(matched.cast("string").alias("matchedCode"),
                        F.lit(status).alias("matchStatus"),
                        F.lit(conf).cast("double").alias("matchConfidence"),
                        contam.alias("contamination"),
                        cands.alias("candidates"),
                        note.cast("string").alias("notes"))

    none = F.lit(None)
    return (F.when(original == "", rec(none, STATUS_UNKNOWN, CONF_UNKNOWN, F.lit("none"),
                                       empty, F.lit(NOTE_EMPTY)))
            .when(exact_hit, rec(original, STATUS_EXACT, CONF_EXACT, contamination(original),
                                 F.array(original), none))
            .when(n == 0, rec(none, STATUS_UNKNOWN, CONF_UNKNOWN, contamination(original),
                              empty, F.lit(NOTE_UNREGISTERED)))
            .when(n == 1, rec(first, STATUS_FUZZY, CONF_FUZZY, contamination(first),
                              candidates, F.lit(NOTE_FUZZY)))
            .otherwise(rec(none, STATUS_AMBIGUOUS, CONF_AMBIGUOUS, F.lit("none"),
                           candidates, F.lit(NOTE_AMBIGUOUS))))
