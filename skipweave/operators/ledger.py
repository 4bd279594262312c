"""The ledger: sessions, searches and hits, read and rewritten as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipweave.functions.text import contains_ascii


def create_session(sessions: DataFrame, session_id: str, name: str, notes: str = "", now=None) -> DataFrame:
    """sessions with one more; its times are `now`."""
    now = F.current_timestamp() if now is None else F.lit(now)
    row = {"session_id": F.lit(session_id), "name": F.lit(name), "notes": F.lit(notes), "created_at": now, "updated_at": now}
    one = sessions.sparkSession.range(1).select(*(row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sessions.schema))
    return sessions.unionByName(one)


def update_session(sessions: DataFrame, session_id, changes: dict, now=None) -> DataFrame:
    """sessions with the given columns of one changed, and its updated_at."""
    if not changes:
        raise ValueError("nothing to change")
    new = {k: F.lit(v) for k, v in changes.items()} | {"updated_at": F.current_timestamp() if now is None else F.lit(now)}
    this = F.col("session_id") == session_id
    return sessions.select(*(F.when(this, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in sessions.schema))


def save_search(searches: DataFrame, hits: DataFrame, search: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a search and its hits put behind."""
    return searches.unionByName(search, allowMissingColumns=True), hits.unionByName(found, allowMissingColumns=True)


def session_view(sessions: DataFrame, searches: DataFrame, session_id) -> DataFrame:
    """A session's searches, the newest first."""
    one = sessions.filter(F.col("session_id") == session_id).select("session_id", "name")
    return one.join(searches, "session_id").orderBy(F.desc("searched_at"), "search_id")


def session_list(sessions: DataFrame, searches: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of sessions, the last changed first, each with its number of searches. The page is cut before the join."""
    page = sessions.orderBy(F.desc("updated_at"), "session_id").offset(offset).limit(limit)
    counts = searches.join(F.broadcast(page.select("session_id")), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n_searches"))
    return page.join(counts, "session_id", "left").withColumn("n_searches", F.coalesce("n_searches", F.lit(0)))


def default_session(sessions: DataFrame, name: str = "__default__") -> DataFrame:
    return sessions.filter(F.col("name") == name).orderBy(F.desc("created_at"), "session_id").limit(1)


def search_detail(searches: DataFrame, hits: DataFrame, search_id) -> DataFrame:
    """A search's hits by skip, then in the order found."""
    one = searches.filter(F.col("search_id") == search_id).select("search_id", F.col("hit_count").alias("reported"))
    return hits.filter(F.col("search_id") == search_id).join(F.broadcast(one), "search_id").orderBy("skip_interval", "start_position", "hit_id")


def search_history(searches: DataFrame, term: str | None = None, stream_id: str | None = None, session_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Searches that fit all given filters, the newest first."""
    out = searches
    if term:
        out = out.filter(contains_ascii(F.col("term"), term))
    if stream_id:
        out = out.filter(F.col("stream_id") == stream_id)
    if session_id is not None:
        out = out.filter(F.col("session_id") == session_id)
    return out.orderBy(F.desc("searched_at"), "search_id").offset(offset).limit(limit)


def hits_for_term(hits: DataFrame, term: str, stream_id: str | None = None) -> DataFrame:
    out = hits.filter(F.col("term") == term)
    return (out.filter(F.col("stream_id") == stream_id) if stream_id else out).orderBy("start_position", "hit_id")


def searched_terms(searches: DataFrame) -> DataFrame:
    return searches.groupBy("term", "stream_id").agg(F.count("*").alias("times_searched"), F.sum("hit_count").alias("total_hits"))


def research_stats(sessions: DataFrame, searches: DataFrame, hits: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row of counts."""
    one = lambda df, **aggs: df.agg(*(e.alias(k) for k, e in aggs.items()))
    out = one(sessions, sessions=F.count("*"))
    parts = [one(searches, searches=F.count("*"), terms=F.count_distinct("term"), streams=F.count_distinct("stream_id")), one(hits, hits=F.count("*"))]
    if clusters is not None:
        parts.append(one(clusters, clusters=F.count("*")))
    for part in parts:
        out = out.join(F.broadcast(part), F.lit(True))
    return out


def top_terms(searches: DataFrame, n: int = 10) -> DataFrame:
    """The most searched terms; equal ones by name."""
    grouped = searches.groupBy("term").agg(F.count("*").alias("times_searched"), F.sum("hit_count").alias("total_hits"))
    return grouped.orderBy(F.desc("times_searched"), "term").limit(n)


def recent_sessions(sessions: DataFrame, n: int = 5, default: str = "__default__") -> DataFrame:
    return sessions.filter(F.col("name") != default).orderBy(F.desc("updated_at"), "session_id").limit(n)


def delete_session(session_id, sessions: DataFrame, searches: DataFrame, **others: DataFrame) -> dict[str, DataFrame]:
    """All tables without a session, its searches, and what hangs on either of them."""
    gone = sessions.filter(F.col("session_id") == session_id).select("session_id")
    lost = searches.join(F.broadcast(gone), "session_id", "left_semi").select("search_id")
    out = {"sessions": sessions.join(F.broadcast(gone), "session_id", "left_anti"), "searches": searches.join(F.broadcast(gone), "session_id", "left_anti")}
    for name, table in others.items():
        out[name] = table.join(lost, "search_id", "left_anti") if "search_id" in table.columns else table.join(F.broadcast(gone), "session_id", "left_anti")
    return out


def stats_for_search(stats: DataFrame, search_id) -> DataFrame:
    return stats.filter(F.col("search_id") == search_id).orderBy(F.desc("computed_at"))


def cluster_list(clusters: DataFrame, limit: int = 20) -> DataFrame:
    return clusters.orderBy(F.desc("discovered_at"), "cluster_id").limit(limit)


def _one_more(table: DataFrame, row: dict) -> DataFrame:
    """table with a row more; columns that aren't given are null. Values are kept as they are, zeros too."""
    one = table.sparkSession.range(1).select(*(F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema))
    return table.unionByName(one)


def save_cluster(clusters: DataFrame, cluster_id: str, session_id, region: dict, now=None) -> DataFrame:
    """clusters with a region more, of type mega_cluster where it names none."""
    return _one_more(clusters, {"type": "mega_cluster", **region, "cluster_id": cluster_id, "session_id": session_id, "discovered_at": now})


def save_statistics(stats: DataFrame, stat_id: str, search_id, analysis: dict, now=None) -> DataFrame:
    """stats with an analysis more; a p of 0 and 0 hits stay 0."""
    return _one_more(stats, {**analysis, "stat_id": stat_id, "search_id": search_id, "computed_at": now})


def ensure_default_session(sessions: DataFrame, session_id: str, now=None, name: str = "__default__") -> DataFrame:
    """sessions, with the default one made where there is none."""
    if default_session(sessions, name).take(1):
        return sessions
    return create_session(sessions, session_id, name, "Made for searches outside of a session", now)
