"""Lemmas by suffix rules and exceptions, both tables of the user's: for any language that inflects by endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "suffix string, ending string, least int"
EXCEPTIONS = "word string, lemma string"


def lemmas(words: DataFrame, rules: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(word, lemma) of distinct words (word).

    An exception's lemma comes first. Else the longest suffix with a rule that leaves `least` characters before it
    is replaced by the rule's ending; of several rules for it the first ending in order. A word without either is its own lemma.
    Rules meet words by suffix: each word asks for as many suffixes as the longest rule is long.
    """
    longest = rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    w = words.select("word").where("word IS NOT NULL").distinct()
    known = exceptions.groupBy("word").agg(F.min("lemma").alias("known"))
    sizes = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(max(longest, 1))))
    asked = w.where("length(word) > 0").select("word", F.explode(sizes).alias("size")).select("word", "size", F.right("word", F.col("size")).alias("suffix"))
    fits = asked.join(rules, "suffix").where(F.length("word") - F.col("size") >= F.col("least"))
    best = fits.groupBy("word").agg(F.min_by(F.struct("size", "ending"), F.struct(-F.col("size"), F.col("ending"))).alias("rule"))
    stem: Column = F.left("word", F.length("word") - F.col("rule.size"))
    joined = w.join(known, "word", "left").join(best, "word", "left")
    return joined.select("word", F.coalesce("known", F.concat(stem, F.col("rule.ending")), "word").alias("lemma"))
