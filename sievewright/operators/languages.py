"""Language posteriors by naive Bayes over character trigrams, and the test for English passages.

A model is a table: a row a trigram with its logarithm for each language. Learning counts words first and cuts each distinct word of a
language once. The most frequent words' sums are a second table, so that texts are exploded to words; only words beyond it are cut to
trigrams, joined to the model and summed up by key, all in the JVM. A model of up to BROADCAST_GRAMS rows is broadcast, a larger one
joined by a shuffle after trigrams are counted by key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a model that are broadcast at most (a few dozen bytes each).
BROADCAST_GRAMS = 1 << 20
#: Words at most whose sums are a table of their own, which is broadcast.
BROADCAST_WORDS = 1 << 17
#: Languages of a model at most.
LANGUAGES = 200
#: The English test's limits: alone, in a document of another language, and how far above that language (fixed values).
ENGLISH, ENGLISH_IN_OTHER, ABOVE_OTHER = 0.85, 0.90, 0.20


@dataclass(frozen=True)
class Model:
    """Languages in order of name, the logarithm of a trigram that none has seen, the table (gram, l0 and so on, one column a language)
    with how many rows it has, and the sums of frequent words (word, w0 and so on)."""

    languages: tuple[str, ...]
    unseen: tuple[float, ...]
    table: DataFrame
    rows: int
    words: DataFrame


def letters(text: Column) -> Column:
    """Lower-cased runs of letters between single spaces, with a space before and after; empty if there are none."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.length(plain) > 0, F.concat(F.lit(" "), plain, F.lit(" "))).otherwise("")


def trigrams(text: Column) -> Column:
    """All runs of three characters of the words of a text, each with a space before and after it."""
    return cut(letters(text))


def cut(spaced: Column) -> Column:
    return F.regexp_extract_all(spaced, F.lit("(?s)(?=(.[^ ].))"), F.lit(1))


def words(text: Column) -> Column:
    """The words of a text; its trigrams are those of each with a space before and after it."""
    return F.filter(F.split(letters(text), " "), lambda w: w != "")


def word_trigrams(word: Column) -> Column:
    return cut(F.concat(F.lit(" "), word, F.lit(" ")))


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a language; a count of one is added to each trigram of each language."""
    known = rows.where(F.col(lang).isNotNull() & ~F.col(lang).isin("", "unknown"))
    met = written(known.select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word")).groupBy("lang", "word").count(), "language-words")
    counts = met.select("lang", F.explode(word_trigrams(F.col("word"))).alias("gram"), "count").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    counts = written(counts, "language-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = tuple(sorted(totals))
    if not names:
        return Model((), (), counts.select("gram"), 0, met.select("word"))
    wide = counts.groupBy("gram").agg(*(F.sum(F.when(F.col("lang") == name, F.col("count"))).alias(f"c{i}") for i, name in enumerate(names)))
    n = counts.select("gram").distinct().count()
    log = lambda count, name: F.log((count + 1) / F.lit(float(totals[name] + n)))
    table = written(wide.select("gram", *(log(F.coalesce(F.col(f"c{i}"), F.lit(0)), name).alias(f"l{i}") for i, name in enumerate(names))), "language-model")
    unseen = tuple(math.log(1 / (totals[name] + n)) for name in names)
    counted = met.groupBy("word").agg(F.floor(4 * F.log2(F.sum("count"))).alias("level"))  # a quarter of a doubling each, so a few hundred
    least, held = math.inf, 0
    for r in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        held += r["count"]
        if held > BROADCAST_WORDS:
            break
        least = r["level"]
    frequent = counted.where(F.col("level") >= least)
    grams = frequent.select("word", F.explode(word_trigrams(F.col("word"))).alias("gram")).join(table, "gram", "left")
    sums = grams.groupBy("word").agg(*(F.sum(F.coalesce(F.col(f"l{i}"), F.lit(x))).alias(f"w{i}") for i, x in enumerate(unseen)))
    return Model(names, unseen, table, n, written(sums, "language-sums"))


def posteriors(rows: DataFrame, by: Sequence[str], model: Model, text: str = "text") -> DataFrame:
    """by, language and p: a map from each language to its probability, and the likeliest one, the first name of equal ones. Languages are
    equally likely before; so they are for a text without letters, null or empty. Rows that agree in `by` are one text."""
    if not model.languages:
        return rows.select(*by, F.lit(None).cast("string").alias("language"), F.lit(None).cast("map<string,double>").alias("p")).dropDuplicates(list(by))
    if model.rows <= BROADCAST_GRAMS:
        found = rows.select(*by, F.explode_outer(words(F.col(text))).alias("word")).join(F.broadcast(model.words), "word", "left")
        rest = F.when(F.col("w0").isNull() & F.col("word").isNotNull(), word_trigrams(F.col("word")))
        found = found.withColumn("gram", F.explode_outer(rest)).join(F.broadcast(model.table), "gram", "left").withColumn("n", F.lit(1))
    else:
        grams = rows.select(*by, F.explode_outer(trigrams(F.col(text))).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("n"))
        found = grams.join(model.table, "gram", "left").withColumns({f"w{i}": F.lit(None).cast("double") for i in range(len(model.languages))})
    value = lambda i: F.when(F.col("gram").isNull(), F.coalesce(F.col(f"w{i}"), F.lit(0.0))).otherwise(F.coalesce(F.col(f"l{i}"), F.lit(model.unseen[i])) * F.col("n"))
    sums = found.groupBy(*by).agg(*(F.sum(value(i)).alias(f"s{i}") for i in range(len(model.languages))))
    return softmax(sums, by, model.languages)


def softmax(sums: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    each = [F.col(f"s{i}") for i in range(len(names))]
    most = F.greatest(*each) if len(each) > 1 else each[0]
    parts = sums.withColumn("most", most).select(*by, *(F.exp(s - F.col("most")).alias(f"e{i}") for i, s in enumerate(each)))
    total = reduce(add, (F.col(f"e{i}") for i in range(len(names))))
    p = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.col(f"e{i}") / total)))
    best = reduce(lambda rest, i: F.when(F.col(f"e{i}") == 1.0, names[i]).otherwise(rest), reversed(range(len(names))), F.lit(None).cast("string"))
    return parts.select(*by, best.alias("language"), p.alias("p"))


def is_english(text: Column, p: Column, document: Column) -> Column:
    """Whether a passage counts as English: fewer than two ASCII letters; p(en) of 0.85 or more in an English document or one
    of unknown language; else 0.90 or more and 0.20 above the document's language."""
    en, other = F.coalesce(p["en"], F.lit(0.0)), F.coalesce(F.element_at(p, document), F.lit(0.0))
    few = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "")) < 2
    foreign = F.coalesce(document != "en", F.lit(False))
    return few | F.when(foreign, (en >= ENGLISH_IN_OTHER) & (en >= other + ABOVE_OTHER)).otherwise(en >= ENGLISH)
