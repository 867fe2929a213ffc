"""A property graph of evidence as two tables, its access filter, and an order-free digest of a table.

nodes: node, node_type, classification (null: public), attrs (map of strings); edges: src, dst, relationship_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kpi import CLEARANCE
from .skew import join_hot

# Types of nodes by type of evidence (all others are EVIDENCE), and attributes that nobody may see, or few.
NODE_TYPES = {"KPI_MOVEMENT": "MOVEMENT", "DRIVER_CONTRIBUTION": "DRIVER", "SEGMENT_CONTRIBUTION": "SEGMENT"}
NEVER = ("customer_id", "customer_unique_id")
INTERNAL_ONLY = ("seller", "seller_id")
_PUBLIC = "PUBLIC_ANALYTICAL"
#: Rows of a digest's lowest groups (about), and hexadecimal digits that a step up takes away.
LEAF, DIGIT = 256, 1


def node_type(evidence_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in NODE_TYPES.items() for x in pair))[evidence_type], F.lit("EVIDENCE"))


def attributes(**values: Column) -> Column:
    """A map of the values that are not null."""
    given = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items())), lambda x: x["v"].isNotNull())
    return F.map_from_entries(given)


def nodes_of(evidence: DataFrame, attrs: Column) -> DataFrame:
    """One node for each evidence_id; of rows with one id the first by its values."""
    rows = evidence.select(F.col("evidence_id").alias("node"), node_type(F.col("evidence_type")).alias("node_type"), "classification", attrs.alias("attrs"))
    order = F.struct("node_type", "classification", F.array_sort(F.map_entries("attrs")))
    first = rows.groupBy("node").agg(F.min_by(F.struct("node_type", "classification", "attrs"), order).alias("n"))
    return first.select("node", "n.*")


def stripped(attrs: Column, clearance: str) -> Column:
    """attrs without what a clearance may not see: customers never, sellers from INTERNAL on."""
    gone = NEVER if CLEARANCE[clearance] >= CLEARANCE["INTERNAL"] else NEVER + INTERNAL_ONLY
    return F.map_filter(attrs, lambda k, _: ~k.isin(*gone))


def visible_nodes(nodes: DataFrame, clearance: str) -> DataFrame:
    """Nodes at or below a clearance with the attributes it may see; nodes without a classification are public."""
    allowed = [k for k, v in CLEARANCE.items() if v <= CLEARANCE[clearance]]
    shown = nodes.where(F.coalesce("classification", F.lit(_PUBLIC)).isin(*allowed))
    return shown.withColumn("attrs", stripped(F.col("attrs"), clearance))


def visible_edges(nodes: DataFrame, edges: DataFrame, clearance: str) -> DataFrame:
    """Edges both of whose ends a clearance may see. A node with a large part of all edges is no hot key of the join."""
    shown, names = visible_nodes(nodes, clearance).select("node"), edges.columns
    for end in ("src", "dst"):
        edges = join_hot(edges, shown.withColumnRenamed("node", end), [end], "left_semi")
    return edges.select(*names)


def counted(nodes: DataFrame, edges: DataFrame, clearance: str) -> DataFrame:
    """(clearance, kind, type, n) of what is left after the filter."""
    parts = visible_nodes(nodes, clearance).select(F.lit("node").alias("kind"), F.col("node_type").alias("type"))
    parts = parts.unionByName(visible_edges(nodes, edges, clearance).select(F.lit("edge").alias("kind"), F.col("relationship_type").alias("type")))
    return parts.groupBy("kind", "type").agg(F.count("*").alias("n")).select(F.lit(clearance).alias("clearance"), "kind", "type", "n")


def neighbours(edges: DataFrame, node: Column) -> DataFrame:
    """(neighbour, relationship_type, direction) of a node in both directions."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("neighbour"), "relationship_type", F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("neighbour"), "relationship_type", F.lit("in").alias("direction")))


def content_digest(rows: DataFrame, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """(items, digest): one SHA-256 over all rows that depends on their values alone, not on order or partitions.

    Rows are digested and grouped by the leading digits of their digests, as many as leave about leaf rows in a group; a
    group's digest is that of its sorted members. A step up groups the digests of sixteen groups, in the order of their
    digits, down to one. So a group stays small at any size, and no list of all rows is made anywhere. Repeated rows
    count; null and empty values differ. An empty table has the digest of nothing.
    """
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    each = rows.select(F.sha2(F.concat(*parts), 256).alias("digest"))
    items = rows.count()
    digits = 0
    while leaf * 16**digits < items:
        digits += DIGIT
    level = each.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    while digits:
        digits -= DIGIT
        members = F.array_sort(F.collect_list(F.struct("prefix", "digest")))["digest"]
        level = level.groupBy(F.substring("prefix", 1, digits).alias("up")).agg(F.sha2(F.array_join(members, ""), 256).alias("digest")).withColumnRenamed("up", "prefix")
    return level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest")).select(F.lit(items).cast("long").alias("items"), "digest")
