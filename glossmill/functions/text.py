"""Text functions as Column expressions: words, sentences, n-grams and keyword counts.

White space is that of Unicode and the separators U+001C to U+001F; words are what lies between. Counts use
regexp_count, so that no array is built where none is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
NO_SPACE = r"(?U)[^\s\x1c-\x1f]+"
#: The technical terms that a realism profile counts, as whole words in any case.
TECH_TERMS = ("API", "SDK", "UI", "UX", "integration", "deployment", "scalability", "authentication")


def words(text: Column) -> Column:
    """The words of a text; none for a blank one."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NO_SPACE)).cast("long")


def unique_word_count(text: Column) -> Column:
    """Distinct lower-cased words, punctuation kept."""
    return F.size(F.array_distinct(words(F.lower(text)))).cast("long")


def sentence_count(text: Column) -> Column:
    """Full stops plus one; 1 for the empty text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) + 1).cast("long")


def words_per_sentence(text: Column) -> Column:
    """Mean words of the pieces between full stops that aren't blank; null if there are none."""
    pieces = F.regexp_count(text, F.lit(r"(?U)[^.\s\x1c-\x1f][^.]*"))
    return F.try_divide(F.regexp_count(text, F.lit(r"(?U)[^.\s\x1c-\x1f]+")).cast("double"), F.nullif(pieces, F.lit(0)).cast("double"))


def tech_term_count(text: Column, terms: Sequence[str] = TECH_TERMS) -> Column:
    return F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(terms)})\b")).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, as arrays; none if there are fewer words."""
    size = F.size(tokens)
    return F.when(
        size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(tokens, i, n))
    ).otherwise(F.array().cast("array<array<string>>"))


def contains_count(lowered: Column, keywords: Sequence[str], weight: int = 1) -> Column:
    """weight for each keyword that the text holds anywhere, inside words too, once each.

    A sum of CASEs stays in generated code, where a function over arrays would not.
    """
    total = F.lit(0)
    for k in keywords:
        total = total + F.when(F.contains(lowered, F.lit(k)), weight).otherwise(0)
    return total


def contained(lowered: Column, phrases: Sequence[str]) -> Column:
    """The phrases that the text holds, in the order of the list."""
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in phrases]))


def long_sentences(text: Column) -> Column:
    """Pieces between runs of . ! and ?, trimmed, of over 10 characters."""
    trimmed = F.transform(F.split(text, r"[.!?]+", -1), lambda s: F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.filter(trimmed, lambda s: F.length(s) > 10)


def exclamations(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))


def fixed(number: Column, places: int) -> Column:
    """A number with so many decimals, ties of its exact value going to the even digit (as C and Python print it)."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * places))


def clean_generated(text: Column) -> Column:
    """Trimmed; one pair of quotes around the whole goes, then the fence lines of a code block of over two lines."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    t = strip(text)
    quoted = (F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'")))
    t = F.when(quoted, strip(F.when(F.length(t) > 1, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.lit("")))).otherwise(t)
    lines = F.split(t, "\n", -1)
    fenced = F.startswith(t, F.lit("```")) & F.endswith(t, F.lit("```")) & (F.size(lines) > 2)
    return F.when(fenced, strip(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(t)


def wait_seconds(message: Column, attempt: Column) -> Column:
    """Seconds that a rate limit's message asks to wait, and half of one more; 2 to the attempt if it names none.

    Milliseconds are looked for first, wherever the message has `ms`.
    """
    after = F.regexp_extract(message, r"Please try again in ([\s\S]*)", 1)
    ms = F.replace(F.element_at(F.split(after, "ms", -1), 1), F.lit(","), F.lit("")).try_cast("double") / 1000 + 0.5
    seconds = F.element_at(F.split(after, r"s\.", -1), 1).try_cast("double") + 0.5
    named = F.when(
        F.contains(message, F.lit("Please try again in")),
        F.when(F.contains(message, F.lit("ms")), ms).when(F.contains(message, F.lit("s.")), seconds),
    )
    return F.coalesce(named, F.pow(F.lit(2.0), attempt))
