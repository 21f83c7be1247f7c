"""Text as column expressions: tokens, shingles, n-grams, sentences, syllables, readability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: What SQL's trim takes off: all space separators of Unicode, where Spark's trim takes the blank alone.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "of", "from", "as", "is", "are", "was",
    "were", "be", "been", "this", "that", "these", "those", "it", "he", "she", "they", "we", "you", "i", "your", "my", "their",
    "our", "its", "which", "who", "whom", "whose", "what", "where", "when", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can",
    "will", "just", "should", "have", "has", "had", "do", "does", "did", "get", "got", "make", "use", "used", "also", "about",
    "into", "then", "there", "would", "could", "here",
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Words of ASCII letters alone, in lower case."""
    return F.filter(words(F.lower(text)), lambda w: w.rlike("^[a-z]+$"))


def trimmed(x: Column) -> Column:
    """x without blanks at its ends, as SQL trims."""
    return F.btrim(x, F.lit(BLANKS))


def solid(x: Column) -> Column:
    """Whether ``trimmed`` leaves something of x."""
    return x.rlike(f"[^{BLANKS}]")


def normalised(text: Column) -> Column:
    """Lower case, trimmed, white space squeezed: the form in which exact copies are equal."""
    return trimmed(F.regexp_replace(F.lower(text), r"[ \t\r\n\f]+", " "))


def shingles(tokens: Column, k: int = 5) -> Column:
    """Distinct k-word shingles; fewer words give one shingle of all, no words none."""
    n = F.size(tokens)
    many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.array_distinct(F.when(n >= k, many).when(n > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>")))


def grams(tokens: Column, n: int) -> Column:
    """All n-grams in order, with repeats."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Split after . ! or ? at white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])[ \t\r\n\f]+"), lambda s: trimmed(s)), lambda s: s != "")


def syllables_a(word: Column) -> Column:
    """One for up to two letters; else runs of vowels after a final e is dropped, at least one."""
    runs = F.regexp_count(F.regexp_replace(F.lower(word), "e$", ""), F.lit("[aeiouy]+"))
    return F.when(F.length(word) <= 2, F.lit(1)).otherwise(F.greatest(F.lit(1), runs))


def syllables_b(word: Column) -> Column:
    """One for up to three letters; else runs of vowels, less one for a final e, at least one."""
    w = F.lower(word)
    runs = F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0)
    return F.when(F.length(word) <= 3, F.lit(1)).otherwise(F.greatest(F.lit(1), runs))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def rounded(x: Column, places: int) -> Column:
    """A double rounded half away from zero as SQL engines round: scaled in double precision first. F.round rounds the decimal text of x, which is below a tie where the scaled x is one."""
    return F.round(x * F.lit(10.0**places), 0) / F.lit(10.0**places)


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    raw = F.lit(206.835) - F.lit(1.015) * n_words / n_sentences - F.lit(84.6) * n_syllables / n_words
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)


def reading_grade(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return rounded(F.greatest(F.lit(0.0), F.lit(0.39) * n_words / n_sentences + F.lit(11.8) * n_syllables / n_words - F.lit(15.59)), 1)


def reading_level(ease: Column) -> Column:
    return F.when(ease >= 80, "easy").when(ease >= 60, "standard").when(ease >= 40, "difficult").when(ease >= 20, "very_difficult").otherwise("extremely_difficult")
