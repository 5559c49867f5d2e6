"""What external models do, behind plain callables, each with a deterministic local default."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repair_json, tokens
from .shared import written

#: Function words by language for the vote (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that for with as are this be".split(),
    "fr": "le la les des et un une dans que qui pour avec est".split(),
    "de": "der die das und den von zu mit ist nicht ein eine".split(),
    "es": "el los las y que del en una por con para es".split(),
}


def detect_language(text: Column) -> Column:
    """The language with most function words among the first 200 words, the first of equal ones; null under 20 characters."""
    first = F.slice(tokens(F.lower(text)), 1, 200)
    count = lambda ws: F.size(F.filter(first, lambda w: w.isin(ws)))
    votes = F.array(*(F.struct(count(ws).alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, ws) in enumerate(STOP_WORDS.items())))
    best = F.array_max(votes)
    return F.when((F.length(text) >= 20) & (best["n"] > 0), best["lang"])


def hashed_embedding(text: str, dim: int = 64, n: int = 3) -> list[float]:
    """Counts of hashed character n-grams with hashed signs, of length one."""
    v = [0.0] * dim
    low = f" {text.lower()} "
    for i in range(max(0, len(low) - n + 1)):
        h = zlib.crc32(low[i : i + n].encode())
        v[h % dim] += 1.0 if h >> 31 else -1.0
    size = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / size for x in v]


def embed(df: DataFrame, text: str = "text", provider: Callable[[str], list[float]] = hashed_embedding) -> DataFrame:
    """df with embedding; the provider runs in Arrow batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.fillna("").map(provider)

    return df.withColumn("embedding", run(F.col(text)))


def translate(df: DataFrame, translator: Callable[[str, str], str] | None, supported: tuple[str, ...], columns: tuple[str, ...] = ("heading", "text")) -> DataFrame:
    """Texts in a supported language other than English by the translator (text, language); others are copied.
    decision: no_translation_needed_english, no_model_available or model_processing; a failure copies and fills error."""
    lang = F.coalesce(detect_language(F.col(columns[-1])), F.lit("en"))
    usable = list(supported) if translator else []
    decision = F.when(lang == "en", "no_translation_needed_english").when(lang.isin(usable) if usable else F.lit(False), "model_processing").otherwise("no_model_available")
    df = df.withColumn("language", lang).withColumn("decision", decision).withColumn("error", F.lit(None).cast("string"))
    if not translator:
        return df

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame.index[frame["decision"] == "model_processing"]:
                try:
                    for c in columns:
                        if frame.at[i, c]:
                            frame.at[i, c] = translator(frame.at[i, c], frame.at[i, "language"])
                except Exception as e:  # the text stays as it was
                    frame.at[i, "error"] = f"{type(e).__name__}: {e}"
            yield frame

    return df.mapInPandas(run, df.schema)


def render(template: str, **values: Column) -> Column:
    """A prompt with its {names} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return out


def no_model(prompt: str) -> str:
    return json.dumps({"PICOs": [], "Outcomes": ""})


def extract(contexts: DataFrame, template: str, schema: str, model: Callable[[str], str] = no_model) -> DataFrame:
    """The model's answer to each context (columns country, indication, context) as a struct, with error and raw_response for
    answers that are no JSON; a blank context is not sent."""
    prompts = contexts.withColumn("prompt", render(template, indication=F.col("indication"), context_block=F.col("context"), country=F.col("country")))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(model)

    asked = prompts.withColumn("raw_response", F.when(F.trim("context") != "", run("prompt")))
    parsed = F.from_json(repair_json(F.col("raw_response")), schema)
    bad = F.col("raw_response").isNotNull() & repair_json(F.col("raw_response")).isNull()
    return asked.withColumn("record", parsed).withColumn("error", F.when(bad, "the answer is no JSON")).drop("prompt")


def batched_prompts(rows: DataFrame, key: str, texts: tuple[str, ...], size: int, delimiter: str = "\n---\n") -> DataFrame:
    """Prompts of `size` consecutive rows each, in order of key: batch (from 0) and prompt; only the last batch is shorter. Rows are dealt by
    ranges of the key and written, so that their numbers hold; what is counted before each range is a row a range."""
    line = F.concat_ws("\n", F.concat(F.lit("id: "), F.col(key).cast("string")), *(F.concat(F.lit(f"{t}: "), F.col(t)) for t in texts))
    dealt = written(rows.select(F.col(key).alias("key"), line.alias("line")).repartitionByRange("key").withColumn("range", F.spark_partition_id()), "prompt-rows")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "line")) - 1
    numbered = dealt.withColumn("place", place).join(F.broadcast(sizes), "range").withColumn("n", F.col("place") + F.col("offset"))
    grouped = numbered.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    return grouped.select("batch", F.array_join(F.transform("l", lambda x: x["line"]), delimiter).alias("prompt"))
