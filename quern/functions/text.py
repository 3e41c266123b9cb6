"""Tokens for full-text search and for embeddings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that full-text search leaves out.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "did do does doing down during each few for from further had has have having he her here hers herself him himself his how "
    "i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves "
    "out over own same she should so some such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why with you your yours yourself yourselves"
).split()

APART = r"[^\p{L}\p{Nd}]+"


def simple_lower(text: Column) -> Column:
    """Lower case letter by letter: neither a dotted capital I nor a final sigma is treated specially."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of two UTF-8 bytes or more, without stop words."""
    return F.filter(F.split(simple_lower(text), APART), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def clean(text: Column) -> Column:
    """Lower case, without blanks of any kind at the ends."""
    return F.regexp_replace(simple_lower(text), r"^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$", "")


def all_words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, APART), lambda w: w != "")
