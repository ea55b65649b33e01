"""Lineage tables: nodes and edges of model manifests, and the events sent for each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.columns import parsed_once
from tickframe.operators.silver import dedup_latest

MANIFEST = (
    "nodes map<string, struct<resource_type:string, name:string, `schema`:string, "
    "description:string, depends_on:struct<nodes:array<string>>>>, "
    "sources map<string, struct<name:string, `schema`:string, description:string>>"
)

# Fixed values of exported lineage records.
EVENT_SCHEMA_URL = "https://openlineage.io/spec/1-0-5/OpenLineage.json#/$defs/RunEvent"
MODEL_EDGE = "dbt_model_dependency"
DEFAULT_TYPE = "table"


def _parsed(manifests: DataFrame, text: str) -> DataFrame:
    """One row per manifest: ``nodes`` and ``edges``, arrays of structs."""
    parsed = manifests.select(parsed_once(F.from_json(text, MANIFEST)))
    models = F.filter(F.map_entries("nodes"), lambda e: e["value"]["resource_type"] == "model")

    def node(kind: str, default_schema: str | None, description: str):
        def build(e: Column) -> Column:
            schema = e["value"]["schema"]
            schema = F.coalesce(schema, F.lit(default_schema)) if default_schema else schema
            return F.struct(
                e["key"].alias("id"), F.concat_ws(".", schema, e["value"]["name"]).alias("name"),
                F.lit(kind).alias("type"), F.lit("olap").alias("layer"),
                F.coalesce(e["value"]["description"], F.lit(description)).alias("description"),
            )

        return build

    def parents(m: Column) -> Column:
        return F.transform(m["value"]["depends_on"]["nodes"], lambda p: F.struct(
            p.alias("from_node"), m["key"].alias("to_node"), F.lit(MODEL_EDGE).alias("relationship")))

    none = F.array()
    made = F.transform(models, node("table", "gold", "model built in SQL"))
    raw = F.transform(F.map_entries("sources"), node("dbt_source", None, "raw table"))
    known = F.filter(F.transform(models, parents), lambda p: p.isNotNull())
    return parsed.select(
        F.filter(F.concat(F.coalesce(raw, none), F.coalesce(made, none)), lambda n: n["id"].isNotNull()).alias("nodes"),
        F.filter(F.flatten(F.coalesce(known, none)), lambda e: e["from_node"].isNotNull()).alias("edges"))


def manifest_lineage(manifests: DataFrame, text: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, type, layer, description) and parent edges of model manifests."""
    both = _parsed(manifests, text)
    # Outer generators: for inner ones Spark adds size checks that compute the input again.
    nodes, edges = (both.select(F.inline_outer(c)) for c in ("nodes", "edges"))
    return nodes.filter("id IS NOT NULL"), edges.filter("from_node IS NOT NULL")


def stored_lineage(manifests: DataFrame, path: str, text: str = "manifest") -> tuple[DataFrame, DataFrame]:
    """``manifest_lineage`` below ``path``: manifests are scanned and parsed once, for both tables."""
    both = _parsed(manifests, text)
    node, edge = (both.schema[c].dataType.elementType for c in ("nodes", "edges"))

    def entry(output: str, own: Column) -> Column:
        return F.struct(F.lit(output).alias("output"), (own if output == "nodes" else F.lit(None).cast(node)).alias("node"),
                        (own if output == "edges" else F.lit(None).cast(edge)).alias("edge"))

    tagged = both.select(F.inline_outer(F.concat(
        F.transform("nodes", lambda n: entry("nodes", n)), F.transform("edges", lambda e: entry("edges", e))))).filter("output IS NOT NULL")
    tagged.write.mode("overwrite").partitionBy("output").parquet(path)
    stored = manifests.sparkSession.read.schema(tagged.schema).parquet(path)
    return stored.filter("output = 'nodes'").select("node.*"), stored.filter("output = 'edges'").select("edge.*")


def lineage_graph(parts: list[tuple[DataFrame, DataFrame | None]]) -> tuple[DataFrame, DataFrame]:
    """Union of node and edge lists (None: no edges); one node per id (the last list wins), one edge per triple."""
    nodes = edges = None
    for rank, (n, e) in enumerate(parts):
        ranked = n.withColumn("_part", F.lit(rank))
        nodes = ranked if nodes is None else nodes.unionByName(ranked)
        edges = e if edges is None else edges if e is None else edges.unionByName(e)
    latest = dedup_latest(nodes, ["id"], ["_part"]).drop("_part")
    return latest, edges.dropDuplicates(["from_node", "to_node", "relationship"])


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the type of both ends; an unknown end counts as a table.

    Neither side is broadcast by hand: Spark does so when the nodes turn out small, and splits
    a hot end (skew join) when they are not.
    """
    types = nodes.select("id", "type")
    out = edges
    for end in ("from", "to"):
        named = types.select(F.col("id").alias(f"{end}_node"), F.col("type").alias(f"{end}_type"))
        out = out.join(named, f"{end}_node", "left").fillna({f"{end}_type": DEFAULT_TYPE})
    return out.select("from_node", "to_node", "relationship", "from_type", "to_type")


def lineage_events(
    resolved: DataFrame,
    namespace: str,
    event_time: Column | None = None,
    run_id: Column | None = None,
    producer: str = "tickframe",
) -> DataFrame:
    """One COMPLETE run event and one add-lineage request, both JSON, per edge."""
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    run = run_id if run_id is not None else F.uuid()
    ns = F.lit(namespace)

    def dataset(end: str) -> Column:
        return F.array(F.struct(ns.alias("namespace"), F.col(f"{end}_node").alias("name")))

    def entity(end: str) -> Column:
        return F.struct(F.col(f"{end}_node").alias("id"), F.col(f"{end}_type").alias("type"))

    job = F.struct(ns.alias("namespace"), F.concat("from_node", F.lit("_to_"), "to_node").alias("name"))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        (event_time if event_time is not None else when).alias("eventTime"),
        F.struct(run.alias("runId")).alias("run"), job.alias("job"),
        dataset("from").alias("inputs"), dataset("to").alias("outputs"),
        F.lit(producer).alias("producer"), F.lit(EVENT_SCHEMA_URL).alias("schemaURL"),
    )
    request = F.struct(
        F.struct(entity("from").alias("fromEntity"), entity("to").alias("toEntity")).alias("edge"),
        F.struct(F.concat(F.lit("Relationship: "), "relationship").alias("sqlQuery")).alias("lineageDetails"),
    )
    return resolved.select(
        "from_node", "to_node", "relationship",
        F.to_json(event).alias("run_event"), F.to_json(request).alias("lineage_request"),
    )


def export_lineage(nodes: DataFrame, edges: DataFrame, folder: str, namespace: str, compression: str = "gzip", **details) -> None:
    """Nodes, edges and events as JSON lines below ``folder``.

    Events are made from the written graph, so the manifests behind it are not parsed again. Their texts repeat most of each line,
    so the files are compressed (``compression``: a codec, or none). ``details`` are those of ``lineage_events``.
    """
    folder = folder.rstrip("/")
    stored = {}
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").json(f"{folder}/{name}", compression=compression)
        stored[name] = df.sparkSession.read.schema(df.schema).json(f"{folder}/{name}")
    events = lineage_events(resolve_edges(stored["edges"], stored["nodes"]), namespace, **details)
    events.write.mode("overwrite").json(f"{folder}/events", compression=compression)
