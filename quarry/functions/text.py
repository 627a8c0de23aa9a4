"""Text scalar functions (T1, T2): tokenising and stop words as JVM expressions.

Words are maximal runs of two or more letters, digits or underscores after
lower-casing, so accented words in any language stay whole.  The same pattern
runs unchanged in DuckDB, which is what the oracle SQL uses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word pattern: two or more Unicode letters / digits / underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Spark's default English stop-word list
# (``StopWordsRemover.loadDefaultStopWords("english")``), kept here so the
# DuckDB oracle can embed the same list.  A test checks it against Spark.
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd
she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's
how's let's ought that's there's what's when's where's who's why's would
""".split())


def tokens(col: Column | str, stop_words: tuple[str, ...] | None = ENGLISH_STOP_WORDS) -> Column:
    """array<string> of lower-cased words of ``col`` with stop words removed.

    A null text is treated as the empty string (no words).
    """
    c = F.col(col) if isinstance(col, str) else col
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD_PATTERN), 0)
    if stop_words:
        # filter, not array_except: repeated words must keep their counts
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return words


def stop_words_sql(stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> str:
    """SQL list literal of the stop words, for the oracle queries."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words) + "]"


def tokens_sql(expr: str, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> str:
    """DuckDB form of :func:`tokens`."""
    words = f"regexp_extract_all(lower(coalesce({expr}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    if not stop_words:
        return words
    return f"list_filter({words}, lambda w: NOT list_contains({stop_words_sql(stop_words)}, w))"
