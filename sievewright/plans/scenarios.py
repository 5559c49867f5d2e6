"""Scenarios: parameters of a run, what of another run's results it can take over, and a pipeline over them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, retrieval, sections
from ..sources import providers


@dataclass(frozen=True)
class Chunking:
    least: int = 600
    most: int = 1500


@dataclass(frozen=True)
class Retrieval:
    submission: tuple[int, int] = (60, 15)
    guideline_population: tuple[int, int] = (50, 12)
    guideline_outcomes: tuple[int, int] = (60, 12)


@dataclass(frozen=True)
class Scenario:
    name: str
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    temperature: float = 0.1


# The scenarios in use (fixed values): repeats of the base, two temperatures, two result sizes, two chunk sizes.
SCENARIOS = {
    s.name: s
    for s in (
        *(Scenario(n) for n in ("base", "base_b", "base_c", "base_d", "base_e")),
        Scenario("sim1", temperature=0.01), Scenario("sim2", temperature=0.3),
        Scenario("sim3", retrieval=Retrieval((45, 10), (45, 10), (45, 10))), Scenario("sim4", retrieval=Retrieval((40, 8), (40, 8), (40, 8))),
        Scenario("sim5", Chunking(400, 1000)), Scenario("sim6", Chunking(800, 2000)),
    )
}


def stage_key(*parts: object) -> str:
    """The name under which a stage's table is kept: equal parameters, one table."""
    return hashlib.sha256(json.dumps([asdict(p) if hasattr(p, "__dataclass_fields__") else p for p in parts], sort_keys=True).encode()).hexdigest()[:16]


def needs(scenario: Scenario, base: Scenario) -> dict[str, bool]:
    """Which stages a scenario can't take over from the base run."""
    store = scenario.chunking != base.chunking
    found = store or scenario.retrieval != base.retrieval
    return {"vectorstore": store, "retrieval": found, "extraction": found or scenario.temperature != base.temperature}


def chunk(documents: DataFrame, chunking: Chunking, least: int = 100) -> DataFrame:
    """Sections cut to the greatest size, then short ones merged within their document."""
    cut = sections.split_oversize(documents, "text", chunking.most, "split_index")
    return sections.merge_small(cut, ["doc_id", "country", "source_type"], ["split_index"], "text", least, chunking.most)


def retrieve(store: DataFrame, query: str, source_type: str, ranking: retrieval.Ranking, k: int, final_k: int, embedder: Callable[[str], list[float]] = providers.hashed_embedding) -> DataFrame:
    """For every country at once: the k nearest chunks (store: chunk_id, country, source_type, heading, text, embedding),
    near-duplicates removed, scored, and where the ranking asks for it chosen by coverage. Columns add place."""
    return retrieve_near(store, F.array(*(F.lit(float(x)) for x in embedder(query))), source_type, ranking, k, final_k)


def retrieve_near(store: DataFrame, q: F.Column, source_type: str, ranking: retrieval.Ranking, k: int, final_k: int) -> DataFrame:
    """What retrieve does, for a vector."""
    near = store.where(F.col("source_type") == source_type)
    near = retrieval.top_k(near, retrieval.squared_l2(F.col("embedding"), q), k * ranking.overfetch, ["country"], "chunk_id")
    unique = retrieval.greedy_unique(near, ["country"], ["rank"], "chunk_id", k * ranking.overfetch).where("kept").select("country", "chunk_id")
    best = retrieval.rerank(near.join(unique, ["country", "chunk_id"]), ranking, ["country"], ["rank"], final_k)
    if not ranking.coverage:
        return best
    picked = retrieval.coverage_select(best.withColumn("terms", T.comparator_terms(F.col("text"))), ["country"], ["place"], "chunk_id", "terms", final_k, 2 * final_k)
    return best.drop("place").join(picked.select("country", "chunk_id", F.col("pick").alias("place")), ["country", "chunk_id"])


def contexts(found: DataFrame, indication: str, budget: int = 12_000) -> DataFrame:
    """One context for each country: the best passages within the token budget; if the first alone is too long, its beginning."""
    kept = sections.context_budget(found, ["country"], ["place"], "text", budget)
    joined = kept.groupBy("country").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("context"),
        F.count("*").alias("chunks_used"), F.sum("tokens").alias("context_tokens"),
    )
    first = found.where("place = 1").select("country", F.substring("text", 1, 3 * budget).alias("beginning"))
    out = first.join(joined, "country", "left")
    return out.select("country", F.lit(indication).alias("indication"), F.coalesce("context", "beginning").alias("context"), F.coalesce("chunks_used", F.lit(1)).alias("chunks_used"), "context_tokens")


def consolidate(records: DataFrame, keys: Sequence[str] = ("Population", "Intervention", "Comparator")) -> DataFrame:
    return evidence.consolidate(records, keys, {"Countries": "country", "Source_Types": "source_type"})
