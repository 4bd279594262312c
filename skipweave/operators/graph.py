"""The knowledge graph: typed nodes, labelled edges, searches over them and their types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skipweave.functions.text import contains_ascii


def create_nodes(nodes: DataFrame, new: DataFrame, types: DataFrame) -> DataFrame:
    """nodes with the new ones whose type exists; importance 0 or none becomes 0.5."""
    fit = new.join(F.broadcast(types.select(F.col("type_name").alias("type"))), "type", "left_semi")
    importance = F.when(F.coalesce("importance", F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance"))
    return nodes.unionByName(fit.withColumn("importance", importance), allowMissingColumns=True)


def valid_types(nodes: DataFrame, types: DataFrame) -> DataFrame:
    return nodes.join(F.broadcast(types.select(F.col("type_name").alias("type"))), "type", "left_semi")


def delete_node(node_id, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without a node, its edges on either side and its vector."""
    return nodes.filter(F.col("id") != node_id), edges.filter((F.col("source_id") != node_id) & (F.col("target_id") != node_id)), embeddings.filter(F.col("node_id") != node_id)


def create_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with the new ones of which both ends exist."""
    source, target = nodes.select(F.col("id").alias("source_id")), nodes.select(F.col("id").alias("target_id"))
    return edges.unionByName(new.join(source, "source_id", "left_semi").join(target, "target_id", "left_semi").select(*edges.columns))


def delete_edge(edges: DataFrame, source_id, target_id, relationship: str | None = None) -> DataFrame:
    """edges without those between two nodes, of one relationship where it is given."""
    this = (F.col("source_id") == source_id) & (F.col("target_id") == target_id)
    return edges.filter(~(this & (F.col("relationship") == relationship if relationship else F.lit(True))))


def node_semantic(nodes: DataFrame, scored: DataFrame, types: list[str] | None = None, limit: int = 10, floor: float = 0.3) -> DataFrame:
    """The nodes whose vectors are most similar, at `floor` or above, with their similarity; scored has node_id and similarity. Types are asked for before the cut."""
    near = scored.filter(F.col("similarity") >= floor).select(F.col("node_id").alias("id"), "similarity")
    rows = (nodes.filter(F.col("type").isin(types)) if types else nodes).join(near, "id")
    return rows.orderBy(F.desc("similarity"), "id").limit(limit)


def approve_proposal(spark, folder: str, stamp: str, types: DataFrame, pending: DataFrame, migrations: DataFrame, type_name: str, now=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(types, pending, migrations) once a proposal is approved: the types are copied to folder/stamp first, and the change is a row of migrations."""
    from skipweave.sources.corpus import snapshot

    snapshot(spark, folder, stamp, types=types)
    waits = pending.filter((F.col("type_name") == type_name) & (F.col("status") == "pending"))
    row = {"type_name": F.col("type_name"), "action": F.lit("created"), "snapshot_path": F.lit(f"{folder}/{stamp}"), "created_at": F.lit(now)}
    logged = waits.select(*(row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in migrations.schema))
    types, pending = settle_proposal(types, pending, type_name, True)
    return types, pending, migrations.unionByName(logged)


def node_connections(edges: DataFrame, nodes: DataFrame, node_id) -> DataFrame:
    """Outgoing and incoming edges with the neighbour's type and summary."""
    near = nodes.select(F.col("id").alias("neighbour"), "type", "summary")
    out = edges.filter(F.col("source_id") == node_id).select(F.lit("out").alias("way"), "relationship", F.col("target_id").alias("neighbour"))
    into = edges.filter(F.col("target_id") == node_id).select(F.lit("in").alias("way"), "relationship", F.col("source_id").alias("neighbour"))
    return out.unionByName(into).join(near, "neighbour")


def node_list(nodes: DataFrame, type_: str | None = None, tags: list[str] | None = None, sort: str = "created_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    if type_:
        nodes = nodes.filter(F.col("type") == type_)
    if tags:
        nodes = nodes.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return nodes.orderBy(F.desc(sort) if descending else F.col(sort), "id").offset(offset).limit(limit)


def node_keyword(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    found = contains_ascii(F.col("summary"), query) | contains_ascii(F.col("detail"), query) | contains_ascii(F.col("context"), query)
    return nodes.filter(found).orderBy(F.desc("created_at"), "id").limit(limit)


def node_keyword_typed(nodes: DataFrame, query: str, type_: str, limit: int = 20) -> DataFrame:
    """Twice the limit is found first and the type asked of those, so fewer than the limit may come."""
    found = node_keyword(nodes, query, 2 * limit)
    return found.filter(F.col("type") == type_).orderBy(F.desc("created_at"), "id").limit(limit)


def hybrid_search(semantic: DataFrame, keyword: DataFrame, limit: int = 20) -> DataFrame:
    """id, similarity, match_type: what was found by vector first, then by keyword what is not among it."""
    rows = semantic.select("id", "similarity", F.lit("semantic").alias("match_type"), F.lit(0).alias("source"))
    rows = rows.unionByName(keyword.select("id", F.lit(0.0).alias("similarity"), F.lit("keyword").alias("match_type"), F.lit(1).alias("source")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("source"))).filter("rn = 1")
    return rows.orderBy("source", F.desc("similarity"), "id").limit(limit).select("id", "similarity", "match_type")


def edge_list(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends, the newest first when ordered by created_at."""
    source = nodes.select(F.col("id").alias("source_id"), F.col("type").alias("source_type"), F.col("summary").alias("source_summary"))
    target = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"), F.col("summary").alias("target_summary"))
    return edges.join(source, "source_id").join(target, "target_id")


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", "relationship")


def missing_embeddings(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    return nodes.join(embeddings.select(F.col("node_id").alias("id")), "id", "left_anti")


def type_list(types: DataFrame) -> DataFrame:
    return types.orderBy(F.desc("is_base_type"), "type_name")


def propose_types(pending: DataFrame, new: DataFrame, types: DataFrame) -> DataFrame:
    """pending with the proposals whose name is neither a type nor pending already."""
    names = types.select("type_name").unionByName(pending.filter("status = 'pending'").select("type_name"))
    return pending.unionByName(new.join(names, "type_name", "left_anti").dropDuplicates(["type_name"]).withColumn("status", F.lit("pending")).select(*pending.columns))


def settle_proposal(types: DataFrame, pending: DataFrame, type_name: str, approve: bool) -> tuple[DataFrame, DataFrame]:
    """(types, pending) once a proposal is approved or rejected."""
    this = (F.col("type_name") == type_name) & (F.col("status") == "pending")
    taken = pending.filter(this).select(*(F.lit(False).alias(c) if c == "is_base_type" else F.col(c) for c in types.columns if c in pending.columns or c == "is_base_type"))
    status = F.when(this, F.lit("approved" if approve else "rejected")).otherwise(F.col("status"))
    return (types.unionByName(taken, allowMissingColumns=True) if approve else types), pending.withColumn("status", status)


def pending_proposals(pending: DataFrame) -> DataFrame:
    return pending.filter("status = 'pending'").orderBy("type_name")


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def embedding_coverage(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """nodes, embedded and the rounded percentage."""
    n, e = nodes.agg(F.count("*").alias("nodes")), embeddings.agg(F.count("*").alias("embedded"))
    share = F.when(F.col("nodes") > 0, F.floor(100 * F.col("embedded") / F.col("nodes") + 0.5)).otherwise(0)
    return n.join(F.broadcast(e), F.lit(True)).select("nodes", "embedded", share.cast("long").alias("percent"))


def kg_status(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame, types: DataFrame) -> DataFrame:
    out = nodes.agg(F.count("*").alias("nodes"))
    for name, table in (("edges", edges), ("embeddings", embeddings), ("types", types)):
        out = out.join(F.broadcast(table.agg(F.count("*").alias(name))), F.lit(True))
    return out
