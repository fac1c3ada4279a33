"""A session of searches over one index: hidden projects stay hidden, and searches are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import guards, retrieval
from ..operators.embedding import DailyQuotaExceeded, Embedder, RateLimited
from ..sources.settings import Settings, SettingsError, required_exclusions
from . import runs
from .index import Index


#: Results of one search that a client may ask for.
MOST_RESULTS = 20
#: What a client is told of each kind of failure, so that it knows whether trying again helps.
TAGS = (
    (runs.SessionCapReached, "SESSION_CAP"), (SettingsError, "CONFIG"), (retrieval.RetrievalError, "NOT_ANSWERABLE_AS_ASKED"),
    (DailyQuotaExceeded, "QUOTA_DAILY"), (RateLimited, "RATE_LIMITED"),
)


def tagged(problem: Exception) -> str:
    """A failure in one line, its kind first; a limit without a reason has a kind of its own."""
    if isinstance(problem, RateLimited) and problem.seconds is None:
        return f"RATE_LIMITED_UNEXPLAINED: {problem}"
    tag = next((name for kind, name in TAGS if isinstance(problem, kind)), "SERVICE_ERROR")
    wait = f" Try again in {problem.seconds:.0f} s." if isinstance(problem, RateLimited) else ""
    return f"{tag}: {problem}{wait}"


class Service:
    """Searches, chunks and projects as a client may see them.

    Which projects are hidden must be said, if only by an empty list, and each
    name must be one that the index holds or left out when it was built; a
    typing error would otherwise show what was to be hidden.
    """

    def __init__(self, index: Index, embedder: Embedder, settings: Settings):
        names = required_exclusions(settings.service_exclude_projects, "service_exclude_projects")
        meta, chunks = index.meta(), index.chunks()
        if meta is None or chunks is None:
            raise retrieval.RetrievalError("There is no index yet.")
        spark = chunks.sparkSession
        asked = spark.createDataFrame(list(enumerate(names, 1)), "position int, name string")
        left_out = spark.createDataFrame([(n,) for n in meta["excluded"]], "project string")
        states = guards.hidden(asked, chunks.select("project").distinct(), left_out).collect()
        if unknown := sorted(r["position"] for r in states if r["state"] == "unknown"):
            raise ValueError(f"hidden projects that no index knows, by position: {unknown}")
        self._hidden = sorted(r["project"] for r in states if r["state"] == "hidden")
        self._index, self._embedder, self._budget = index, embedder, runs.SearchBudget(settings.max_searches)

    def projects(self) -> list[str]:
        return [p for p in self._index.projects() if p not in self._hidden]

    def search(self, query: str, k: int = retrieval.SEARCH_K, project: str | None = None) -> DataFrame:
        """Results of one query; a hidden project cannot be named, and what is refused before embedding costs nothing."""
        if not query.strip():
            raise retrieval.RetrievalError("The query is empty.")
        if not 1 <= k <= MOST_RESULTS:
            raise retrieval.RetrievalError(f"k must be from 1 to {MOST_RESULTS}, not {k}.")
        if project is not None and not retrieval.resolve_projects([project], self.projects()):
            raise retrieval.RetrievalError(f"No project named {project!r}. Projects: {', '.join(self.projects())}.")
        self._budget.spend()
        return runs.search(self._index, self._embedder, query, k, project, self._hidden)

    def get(self, chunk_id: str):
        """A chunk by id; one of a hidden project is not found, as if it were not there."""
        row = self._index.found(chunk_id).where(~F.col("project").isin(self._hidden)).first()
        if row is None:
            raise KeyError(chunk_id)
        return row
