"""One entrance to semantic, keyword and hybrid search."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import vectors
from graphloom.operators.filters import metadata
from graphloom.operators.hybrid import merge


@dataclass(frozen=True)
class SearchRequest:
    query: str
    kind: str = "hybrid"
    top_k: int = 10
    threshold: float = 0.3
    filters: dict = field(default_factory=dict)
    filter_mode: str = "pre"


# Words of a query that ask for a kind of filter.
ASKS = {
    "name": ("function", "method", "def"), "file_path": ("file", "path", "module"), "hard": ("complex", "difficult", "hard"), "easy": ("simple", "easy", "basic"),
    "test": ("test", "testing"), "async": ("async", "await"), "decorator": ("decorator", "decorate"), "parent_class": ("class", "object", "instance"),
}


def inferred_filters(query: str) -> dict[str, str | float]:
    """Filters that a query's own words ask for: name, file_path, function_type, parent_class, min_complexity or max_complexity."""
    low, words, found = query.lower(), query.split(), {}
    asked = {kind: any(w in low for w in some) for kind, some in ASKS.items()}
    first = lambda good: next((w for w in words if good(w)), None)
    picks = {
        "name": lambda w: w.isidentifier() and w.lower() not in (*ASKS["name"], "class"),
        "file_path": lambda w: "/" in w or "." in w,
        "parent_class": lambda w: w[0].isupper() and w.isidentifier(),
    }
    for kind, good in picks.items():
        if asked[kind] and (word := first(good)):
            found[kind] = word
    if asked["hard"]:
        found["min_complexity"] = 5.0
    elif asked["easy"]:
        found["max_complexity"] = 3.0
    kind = next((k for k in ("test", "async", "decorator") if asked[k]), None)
    return found | ({"function_type": kind} if kind else {})


class Searcher:
    """Searches a table of id, content, filepath, language, embedding; embed turns a query into a vector.

    rerank: takes a query and the found rows and returns them with another score, for requests of kind `ai`; without it
    their order stays. sparse: the embeddings are of words, with no null or endless components, so that a query of few
    words is compared in its own components alone.
    """

    def __init__(self, table: DataFrame, embed=None, remembered: int = 100, rerank=None, sparse: bool = False) -> None:
        self.table, self.embed, self.remembered, self.rerank, self.sparse = table, embed, remembered, rerank, sparse
        self.cache: OrderedDict[SearchRequest, DataFrame] = OrderedDict()
        self.history: list[tuple[str, str]] = []

    def search(self, request: SearchRequest) -> DataFrame:
        """id, score, rnk, filepath, language, highlights of the best rows; the plan of an equal request is kept."""
        self.history = [*self.history, (request.query, request.kind)][-self.remembered :]
        key = repr(request)
        if key not in self.cache:
            self.cache[key] = self._plan(request)
            if len(self.cache) > self.remembered:
                self.cache.popitem(last=False)
        return self.cache[key]

    def by_example(self, code: str, top_k: int = 10, threshold: float = 0.0) -> DataFrame:
        """The rows most similar to a piece of code."""
        return self.search(SearchRequest(code, "semantic", top_k, threshold))

    def by_signature(self, name: str, parameters: list[str] | None = None, returns: str | None = None, top_k: int = 10) -> DataFrame:
        """The rows most similar to a function's name, parameters and return type in words."""
        parts = [f"function {name}", *([f"parameters: {', '.join(parameters)}"] if parameters else []), *([f"returns: {returns}"] if returns else [])]
        return self.search(SearchRequest(" ".join(parts), "semantic", top_k))

    def with_graph_hits(self, found: DataFrame, hits: DataFrame) -> DataFrame:
        """Found rows and those that only the graph knows (id, filepath, ...), which have score 0 and no embedding or highlights."""
        fresh = hits.join(found.select("id"), "id", "left_anti").withColumn("score", F.lit(0.0))
        return found.unionByName(fresh, allowMissingColumns=True)

    def _plan(self, request: SearchRequest) -> DataFrame:
        rows = self.table
        if request.filter_mode == "pre" and request.filters:
            rows = metadata(rows, 2**31 - 1, ["id"], "pre", **request.filters)
        semantic = request.kind in ("semantic", "hybrid", "ai") and self.embed is not None
        parts = []
        if semantic:
            asked = self.embed(request.query)
            few = self.sparse and sum(x != 0 for x in asked) <= 64
            found = vectors.top_k(rows.select(F.col("id").alias("vec_id"), "embedding"), asked, 2 * request.top_k, threshold=request.threshold, sparse=few)
            parts.append(found.select(F.col("vec_id").alias("id"), "score"))
        if request.kind != "semantic" or not semantic:
            score = T.keyword_score(request.query, F.lit(""), F.col("filepath"), F.col("content"), F.lit(""))
            parts.append(rows.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(2 * request.top_k))
        best = merge(parts[0], parts[1], ["id"], limit=request.top_k).select("id", F.col("combined_score").alias("score")) if len(parts) == 2 else parts[0]
        best = best.orderBy(F.desc("score"), "id").limit(request.top_k)
        out = best.join(self.table, "id")
        if request.kind == "ai" and self.rerank is not None:
            out = self.rerank(request.query, out)
        out = out.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("int"))
        if request.filter_mode == "post" and request.filters:
            out = metadata(out, request.top_k, ["rnk"], "post", **request.filters)
        return out.select("id", "score", "rnk", "filepath", "language", T.highlights(F.col("content"), request.query).alias("highlights"))

    @staticmethod
    def suggest(part: str, names: DataFrame, docs: DataFrame, history: DataFrame, limit: int = 10) -> DataFrame:
        """text: names, docstring words longer than the part, and past queries that hold it, shortest first.

        names: name; docs: docstring; history: query. Words lose the marks .,!?;: at their ends.
        """
        low = F.lit(part.lower())
        words = docs.select(F.explode(F.split(F.coalesce("docstring", F.lit("")), r"\s+")).alias("text")).select(F.regexp_replace("text", "^[.,!?;:]+|[.,!?;:]+$", "").alias("text"))
        words = words.filter(F.length("text") > len(part))
        every = names.select(F.col("name").alias("text")).unionByName(words).unionByName(history.select(F.col("query").alias("text")))
        return every.filter(F.contains(F.lower("text"), low)).distinct().orderBy(F.length("text"), "text").limit(limit)

    def suggestions(self, part: str, limit: int = 10) -> DataFrame:
        """Paths and words of the contents that hold a text, shortest first."""
        low = F.lit(part.lower())
        words = self.table.select(F.explode(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0))).alias("text")).unionByName(self.table.select(F.col("filepath").alias("text")))
        return words.filter(F.contains(F.lower("text"), low)).distinct().orderBy(F.length("text"), "text").limit(limit)
