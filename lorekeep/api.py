"""The read and write surface as a Python object over tables.

Each method takes a batch (a DataFrame of requests) and returns a DataFrame;
nothing but the optional legs of a search is executed until the caller acts on it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scores as S
from .functions import text as T
from .operators import batch, compress, dense, episodes, fusion, graph, lexical, lifecycle, positional, profiles, readiness, vector_index, writing
from .operators.kept_index import KeptIndex
from .operators.vector_index import VectorIndex
from .scratch import stored

log = logging.getLogger(__name__)


def leg(name: str, make: Callable[[], DataFrame | None]) -> DataFrame | None:
    """What an optional leg finds, stored; nothing if it is absent or fails."""
    try:
        made = make()
        return None if made is None else stored(made, name)
    except Exception as e:  # noqa: BLE001  a leg may be down; the others answer
        log.warning("%s leg left out: %s", name, e)
        return None


@dataclass(frozen=True)
class SearchOptions:
    """What a search may ask for; the defaults are the serving defaults."""

    limit: int = 5
    min_score: float = 0.0
    memory_types: tuple[str, ...] = ()
    projects: tuple[str, ...] = ()
    source_agents: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    include_historical: bool = False
    prefilter: bool = False
    compress: bool = True
    max_tokens: int = 2000
    default_project: str | None = None
    syntax: str = "plain"  # "web": phrases in quotes, minus, or; ranked with cover density

    def chosen_projects(self) -> tuple[str, ...]:
        """AX-2: a default project is a filter unless one is asked for."""
        return self.projects or ((self.default_project,) if self.default_project else ())


@dataclass
class Memory:
    """Tables of a memory: chunks (chunk_id, memory_id, revision_id, text,
    memory_type, project, source_agent, tags, entity_keys, source_file,
    occurred, updated, created, importance), revisions, documents, vectors,
    entities, aliases, claims, profiles, facts.  With a kept ``index`` of the
    chunks and a ``vector_index``, searches read those; else postings are made
    for each batch, and all vectors are compared."""

    chunks: DataFrame
    documents: DataFrame
    revisions: DataFrame
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    claims: DataFrame | None = None
    profiles: DataFrame | None = None
    facts: DataFrame | None = None
    reranker: Callable[[Column, Column], Column] | None = None
    allowed_agents: tuple[str, ...] = field(default_factory=tuple)
    index: KeptIndex | None = None
    vector_index: VectorIndex | None = None

    def visible(self, historical: bool = False) -> DataFrame:
        """FLT-1: (memory_id, revision_id) that a search may return."""
        r = self.revisions.select("memory_id", "revision_id", "state")
        if historical:
            return r.filter(lifecycle.historical(F.col("state"))).select("memory_id", "revision_id")
        d = self.documents.select("memory_id", "doc_status", "current_revision_id")
        both = r.join(d, "memory_id")
        return both.filter(lifecycle.visible(F.col("doc_status"), F.col("current_revision_id"), F.col("revision_id"), F.col("state"))).select("memory_id", "revision_id")

    def _expansion(self, queries: DataFrame) -> DataFrame | None:
        if self.claims is None or self.entities is None:
            return None
        names = queries.select("query_id", F.explode(T.query_entities(F.col("text"))).alias("n")).select("query_id", T.entity_key(F.col("n")).alias("name_key"))
        aliases = self.aliases if self.aliases is not None else self.entities.limit(0).select(F.col("entity_key").alias("alias_key"), "entity_key")
        return graph.expand(graph.resolve(names, self.entities, aliases), self.claims.filter(F.col("status").isin("explicit", "verified")))

    def _profile_boosts(self, queries: DataFrame) -> DataFrame | None:
        if self.profiles is None or self.facts is None:
            return None
        q = queries.select("query_id", T.entity_key(F.col("text")).alias("query_key"), F.transform(T.query_entities(F.col("text")), lambda x: T.entity_key(x)).alias("entity_keys"))
        return profiles.profile_boosts(q, self.profiles, self.facts, self.documents)

    def _lexical(self, queries: DataFrame, chunks: DataFrame, among: DataFrame | None, syntax: str, k: int) -> tuple[DataFrame, DataFrame | None]:
        """The k best chunks of the lexical leg, and all its matches (None if they are not made)."""
        if syntax == "web":
            if self.index is None:
                postings = positional.positions(chunks, queries=queries)
            else:
                postings = self.index.postings(queries.select(F.explode(T.lexemes(F.col("text"))).alias("lexeme")).distinct())
                postings = postings if among is None else postings.join(among, "chunk_id", "left_semi")
            matches = positional.web_search_matches(queries, postings)
        elif self.index is not None:
            return self.index.search(queries, k, among=among), None
        else:
            return batch.search(queries, chunks, k), None
        return lexical.top_k(matches, ["query_id"], lexical.lexical_order(), k), matches

    def _semantic(self, queries: DataFrame, among: DataFrame | None, chunks: DataFrame, k: int) -> DataFrame:
        """The k nearest vectors: from the index's lists, or exactly where only some chunks count."""
        asked = queries.select("query_id", "vec")
        if self.vector_index is not None and among is None:
            found = vector_index.search(asked, self.vector_index, k)
        else:
            vectors = self.vectors if self.vectors is not None else self.vector_index.rows(queries.sparkSession).select("vec_id", "vec")
            found = dense.dense_search(asked, vectors.join(chunks.select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi"), k)
        return found.select("query_id", F.lit("semantic").alias("source"), F.col("vec_id").alias("chunk_id"), "pos", "score")

    def search(self, queries: DataFrame, as_of: Column, options: SearchOptions = SearchOptions()) -> DataFrame:
        """RET-1 to RET-17.  queries: query_id, text and, for the dense leg, vec.

        RET-15: without vectors, claims or profiles the others answer.  So they
        do if one of these legs fails, when it is planned or when it runs: what
        a leg finds (k rows a query) is stored before the rest is planned.  A
        failing lexical leg is an error."""
        chunks = lexical.filtered(self.chunks, options.memory_types, options.chosen_projects(), options.source_agents, options.tags)
        if self.allowed_agents:  # AX-1
            chunks = chunks.filter(F.lower("source_agent").isin([a.lower() for a in self.allowed_agents]))
        seen = self.visible(options.include_historical)
        if options.prefilter:
            chunks = chunks.join(seen, ["memory_id", "revision_id"], "left_semi")
        some = any((options.memory_types, options.chosen_projects(), options.source_agents, options.tags, self.allowed_agents, options.prefilter))
        among = chunks.select("chunk_id") if some else None
        k = fusion.over_fetch(options.limit)
        top, matches = self._lexical(queries, chunks, among, options.syntax, k)
        lists = top.select("query_id", F.lit("lexical").alias("source"), "chunk_id", "pos", F.col("rank").alias("score"))
        if "vec" in queries.columns and (self.vectors is not None or self.vector_index is not None):
            found = leg("dense", lambda: self._semantic(queries, among, chunks, k))
            lists = lists if found is None else lists.unionByName(found)
        lists = stored(lists, "lists")
        fused = batch.beside(fusion.fuse(lists), chunks, "chunk_id")
        scored = fusion.base_scores(fusion.visible_only(fused, seen))
        expansion = leg("graph", lambda: self._expansion(queries))
        if expansion is None:
            scored = scored.withColumn("graph_boost", F.lit(None).cast("double"))
        else:
            keys = scored.select("query_id", "chunk_id", F.explode("entity_keys").alias("entity_key"))
            scored = scored.join(fusion.graph_boosts(keys, expansion), ["query_id", "chunk_id"], "left")
        boosts = leg("profile", lambda: self._profile_boosts(queries))
        if boosts is None:
            scored = scored.withColumn("profile_boost", F.lit(None).cast("double"))
        else:
            scored = scored.join(boosts, ["query_id", "memory_id"], "left")
        combined = fusion.combine(scored, as_of).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        if self.reranker:
            combined = combined.withColumn("rerank", self.reranker(F.col("query"), F.col("text")))
        else:
            combined = combined.withColumn("n_chars", F.length("text"))
            if matches is None and self.index is None:  # counted on the candidates' texts
                own = T.lexemes(F.col("query"))
                rr = S.heuristic_rerank(F.size(F.array_intersect(T.lexemes(F.col("text")), own)), F.size(own), F.col("n_chars"))
                combined = combined.withColumn("rerank", rr)
            else:
                combined = fusion.heuristic(combined, self.index.shared(lists, queries) if matches is None else matches)
        top = fusion.rerank(combined, F.col("rerank"), options.limit, options.min_score).withColumn("evidence_ids", F.array(F.concat_ws(":", F.col("memory_id").cast("string"), F.col("revision_id").cast("string"), F.col("chunk_id").cast("string"))))
        out = top.select("query_id", F.col("final_pos").alias("pos"), "chunk_id", "memory_id", "revision_id", "memory_type", "source_file", "text", "score", F.col("importance_out").alias("importance"), "entity_keys", "rank_sources", "evidence_ids")
        return compress.compress(out, options.max_tokens, lists=["entity_keys", "rank_sources", "evidence_ids"]) if options.compress else out

    def context(self, queries: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
        """RET-19."""
        return compress.context(self.search(queries, as_of, SearchOptions(limit=limit)))

    def summarize(self, queries: DataFrame, as_of: Column, model: Callable[[Column], Column] | None = None) -> DataFrame:
        """UX-6: a summary of each query's context: by a model's column function,
        which reads the first 4,000 characters (the limit of its prompt), or by
        the first and last sentence of the whole context."""
        c = self.context(queries, as_of)
        made = model(F.substring("context", 1, 4000)) if model else T.heuristic_summary(F.col("context"))
        return c.select("query_id", made.alias("summary"))

    def remember(self, incoming: DataFrame, notes: DataFrame) -> DataFrame:
        """RET-18."""
        return writing.write_decisions(incoming, notes)

    def procedures(self, tasks: DataFrame, notes: DataFrame, k: int = 4) -> DataFrame:
        return writing.procedures(tasks, notes, k)

    def entities_seen(self, mentions: DataFrame) -> DataFrame:
        return graph.evidenced(self.entities, mentions, self.claims, self.documents)

    def relations(self, edges: DataFrame, name: Column) -> DataFrame:
        return graph.relations(edges, name)

    def neighbourhood(self, seeds: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
        return graph.induced(graph.reached(seeds, edges, radius), edges)

    def profile(self, historical: bool = False) -> DataFrame:
        return profiles.profile_facts(self.profiles, self.facts, self.documents, historical)

    def status(self, jobs: DataFrame, outbox: DataFrame) -> DataFrame:
        return profiles.memory_status(self.documents, self.revisions, jobs, outbox)

    def quality(self, notes: DataFrame) -> DataFrame:
        return notes.select("path", episodes.quality(F.col("raw")).alias("q")).select("path", "q.*")

    def validate(self, parsed: DataFrame, kind: Column) -> DataFrame:
        return parsed.select("path", episodes.issues(F.col("raw"), F.col("error"), F.col("memory_id"), kind, F.col("body")).alias("issues"))

    def orphans(self, expected: DataFrame) -> DataFrame:
        return readiness.orphans(self.vectors.select(F.col("vec_id").alias("point_id")), expected)
