"""Text functions: lexicon scores, grouped numbers, labels without accents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small lexicon over the invented languages of the test tables: word to score.
LEXICON = {"the": 0.1, "worthless": -1.0, "and": 0.05, "stupid": -1.0, "with": 0.2, "not": -0.3, "for": 0.1, "nicht": -0.3, "pas": -0.3, "no": -0.3}


def sentiment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hits, sentiment): tanh of the mean score of a text's lexicon words; texts without any give no row.

    Scores are looked up in a literal map, so no word leaves its row.
    """
    scores = F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv])
    found = F.filter(F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.try_element_at(scores, w)), lambda s: s.isNotNull())
    x = docs.select(key, found.alias("s")).where("size(s) > 0")
    return x.select(key, F.size("s").cast("long").alias("hits"), F.tanh(F.aggregate("s", F.lit(0.0), lambda a, v: a + v) / F.size("s")).alias("sentiment"))


def folded(x: Column) -> Column:
    """Upper case without the accents of Latin letters, white space made single."""
    plain = F.translate(F.upper(x), "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĐ", "AAAAAACEEEEIIIINOOOOOUUUUYD")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def amount(x: Column) -> Column:
    """A number whose thousands are grouped by one kind of mark, in parentheses or with a minus if negative; else null."""
    body = F.regexp_replace(x, r"[()\-\s]", "")
    sound = body.rlike(r"^\d{1,3}(\.\d{3})*$") | body.rlike(r"^\d{1,3}(,\d{3})*$") | body.rlike(r"^\d+$")
    value = F.regexp_replace(body, "[.,]", "").cast("decimal(38,0)")
    return F.when(sound, F.when(x.rlike(r"^\s*(\(.*\)|-)"), -value).otherwise(value))
