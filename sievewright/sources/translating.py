"""Translation in pieces: long texts are cut, pieces are put into batches for the model, and what comes back is merged.

A task sorts the pieces of an Arrow batch by language and length and gives the model batches whose padded size, the longest piece times
their number, stays within a budget. The model is made once in each Python worker. A batch that fails is tried again piece by
piece; a piece that fails keeps its text and carries the error. Pieces are rows of their own, so that a long text spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sections import merge_overlaps, pack_sentences
from .shared import batches

#: texts and their language -> translations, one for each text.
Translator = Callable[[list[str], str], list[str]]

#: Tokens of a piece, at which one is full, at most, and of the sentences that it repeats; fewer go (see pack_sentences).
TARGET, MOST, OVERLAP, LEAST = 300, 380, 40, 40
#: Padded tokens of a batch for the model, and pieces that are sorted at once.
BATCH_TOKENS, SORTED = 8192, 4096

_MODELS: dict[str, Translator] = {}


def model_of(make: Callable[[], Translator]) -> Translator:
    """The model of this process, made at the first use."""
    name = f"{make.__module__}.{make.__qualname__}"
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def model_batches(pieces: Sequence[tuple[str, int]], budget: int) -> Iterator[list[int]]:
    """Places of pieces (language, tokens) in batches of one language, by length, within the budget; a longer piece is alone."""
    batch: list[int] = []
    for i in sorted(range(len(pieces)), key=lambda i: (*pieces[i], i)):
        language, tokens = pieces[i]
        if batch and (pieces[batch[0]][0] != language or tokens * (len(batch) + 1) > budget):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


def translated(model: Translator, texts: list[str], languages: list[str], tokens: list[int], budget: int) -> tuple[list[str], list[str | None]]:
    """Translations and errors of pieces, in their order."""
    out, errors = list(texts), [None] * len(texts)
    for batch in model_batches(list(zip(languages, tokens, strict=True)), budget):
        language = languages[batch[0]]
        try:
            done = model([texts[i] for i in batch], language)
            if len(done) != len(batch):
                raise ValueError(f"{len(done)} translations of {len(batch)} texts")
            for i, t in zip(batch, done, strict=True):
                out[i] = t.strip()
        except Exception:  # noqa: BLE001 - one bad piece must not take the others with it
            for i in batch:
                try:
                    (t,) = model([texts[i]], language)
                    out[i] = t.strip()
                except Exception as e:  # noqa: BLE001 - the piece stays as it was
                    errors[i] = f"{type(e).__name__}: {e}"
    return out, errors


def translate_pieces(df: DataFrame, by: Sequence[str], text: str, language: str, supported: Sequence[str], make: Callable[[], Translator], sizes: tuple[int, int, int, int] = (TARGET, MOST, OVERLAP, LEAST), budget: int = BATCH_TOKENS) -> DataFrame:
    """by, decision, n_pieces, translated and errors (an array) for each row; `by` tells rows apart. A text in a supported language other
    than English is translated; English ones, those of another or no language, and null or empty ones are copied. Pieces are
    merged where one ends with words that the next begins with."""
    plain = F.length(T.strip(F.coalesce(F.col(text), F.lit("")))) == 0
    lang = F.coalesce(F.col(language), F.lit("en"))
    decision = F.when(plain | (lang == "en"), "no_translation_needed_english").when(lang.isin(*supported), "model_processing").otherwise("no_model_available")
    rows = df.select(*by, F.col(text).alias("text"), lang.alias("language"), decision.alias("decision"))
    cut = pack_sentences(rows.where("decision = 'model_processing'"), "text", *sizes)
    pieces = cut.select(*by, "language", F.posexplode("pieces").alias("place", "piece")).withColumn("tokens", T.token_count(F.col("piece")))
    fields = pieces.schema

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(make)
        for part in parts:
            column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            texts, errors = translated(model, column["piece"].to_pylist(), column["language"].to_pylist(), column["tokens"].to_pylist(), budget)
            kept = [column[n] for n in by] + [column["place"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*by, "place", "piece", "error"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name in (*by, "place"))
    with batches(df.sparkSession, SORTED):
        done = pieces.mapInArrow(run, f"{types}, piece string, error string")
        merged = done.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "piece", "error"))).alias("ps"))
        merged = merged.select(*by, F.size("ps").alias("n_pieces"), merge_overlaps(F.transform("ps", lambda p: p["piece"])).alias("translated"), F.array_compact(F.transform("ps", lambda p: p["error"])).alias("errors"))
    out = rows.join(merged, list(by), "left")
    none = F.array().cast("array<string>")
    return out.select(*by, "decision", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"), F.coalesce("translated", "text").alias("translated"), F.coalesce("errors", none).alias("errors"))
