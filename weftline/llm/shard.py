"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

Shards are the leaves of a tree of regions and racks; a node's weight is the sum of its leaves'. A row descends from the root: at each level every
child of the node reached has an exponential draw -ln(u)/weight, u hashed from the row's key and the child's path, and the least draw is entered. So a child is
entered in proportion to its weight, and a row costs a draw for each child of the nodes on its way, not for each leaf.

Movement stays inside subtrees whose weights change. At a node where one child's weight grows, rows enter only that child; where it shrinks, rows
leave only it. Rows that stay in a changed subtree may move within it, and rows that enter it may reach any of its leaves. A new shard in a region of its
own (`grown`) changes no other node's weight, so it takes rows only into itself.

Law `key`: the key and the number of shards decide, nothing else. A null key is the text "null"; rows with equal keys share a shard.
A null text has size 1. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: int
    rack: int
    weight: float = 1.0


def topology(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Shards in order fill racks of `per_rack`, racks fill regions of `racks`."""
    return [Leaf(s, s // (racks * per_rack), s // per_rack) for s in range(shards)]


def grown(tree: list[Leaf]) -> list[Leaf]:
    """One more shard, in a region of its own."""
    return [*tree, Leaf(*(max(getattr(x, c) for x in tree) + 1 for c in ("shard", "region", "rack")))]


#: What a node's path is made of, from the root down.
LEVELS = ("region", "rack", "shard")


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u)/weight with u in (0, 1) from 52 bits of md5(key:path); paths are names from the root down."""
    digest = F.md5(F.concat(key, F.lit(":"), path).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _nodes(tree: list[Leaf]) -> list[dict[str, list[tuple[int, float]]]]:
    """For each level: the children of each node above it by its path, as (name, weight), in order of their names."""
    out = []
    for depth, level in enumerate(LEVELS):
        found: dict[str, dict[int, float]] = {}
        for x in tree:
            above = "/".join(str(getattr(x, c)) for c in LEVELS[:depth])
            children = found.setdefault(above, {})
            children[getattr(x, level)] = children.get(getattr(x, level), 0.0) + x.weight
        out.append({path: sorted(children.items()) for path, children in found.items()})
    return out


def _descended(df: DataFrame, tree: list[Leaf], out: str) -> DataFrame:
    """df with the shard reached from _key; ties go to the first child.

    A node's children stand at its place in constant arrays, so a row evaluates draws for the children of the nodes it enters alone.
    """
    df = df.withColumn("_path", F.lit("")).withColumn("_node", F.lit(1))
    for depth, nodes in enumerate(_nodes(tree)):
        # the children of all nodes of this level one after another; the next level's nodes stand in the same order
        most = max(len(c) for c in nodes.values())
        names = F.array(*(F.array(*(F.lit(str(c[i][0]) if i < len(c) else None) for i in range(most))) for c in nodes.values()))
        weights = F.array(*(F.array(*(F.lit(c[i][1] if i < len(c) else None).cast("double") for i in range(most))) for c in nodes.values()))
        place = {path: i + 1 for i, path in enumerate(_nodes(tree)[depth + 1])} if depth + 1 < len(LEVELS) else {}
        joined = lambda path, name: f"{path}/{name}" if path else str(name)
        after = F.array(*(F.array(*(F.lit(place.get(joined(path, c[i][0])) if i < len(c) else None).cast("int") for i in range(most))) for path, c in nodes.items()))
        prefix = F.col("_path") if not depth else F.concat("_path", F.lit("/"))
        draws = []
        for i in range(most):
            name, weight = F.element_at(F.element_at(names, F.col("_node")), i + 1), F.element_at(F.element_at(weights, F.col("_node")), i + 1)
            draws.append(F.when(weight.isNotNull(), F.struct(_draw(F.col("_key"), F.concat(prefix, name), weight).alias("draw"), F.lit(i + 1).alias("child"))))
        df = df.withColumn("_child", F.array_min(F.array(*draws))["child"])
        name = F.element_at(F.element_at(names, F.col("_node")), F.col("_child"))
        df = df.withColumns({"_path": F.concat(prefix, name), "_node": F.element_at(F.element_at(after, F.col("_node")), F.col("_child"))})
    return df.withColumn(out, F.substring_index("_path", "/", -1).cast("int")).drop("_path", "_node", "_child")


def place(df: DataFrame, key: Column, trees: dict[str, list[Leaf]]) -> DataFrame:
    """df with a column for each named tree: the shard that the row's key descends to. Leaves without weight take no rows."""
    df = df.withColumn("_key", F.coalesce(key.cast("string"), F.lit("null")))
    for name, tree in trees.items():
        df = _descended(df, [x for x in tree if x.weight > 0], name)
    return df.drop("_key")


def _range(rows: DataFrame, rows_per_bucket: int) -> Column:
    """A row's bucket of about that many rows (more in tables beyond 1,024 buckets), by ranges of doc_id; nulls come first. Rows with one id share a bucket."""
    n = min(1024, -(-rows.count() // rows_per_bucket))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("doc_id").cast("double"))), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int, rows_per_bucket: int = 50_000) -> DataFrame:
    """Every document's shard, its place there by doc_id, and its shard if there were one more."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = place(sized, F.col("doc_id"), {"shard": topology(shards), "grown_shard": grown(topology(shards))})
    # numbering reads the rows twice: the texts are left behind first
    rows = shared.cut(placed, "shard")
    return shared.gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", bucket=_range(rows, rows_per_bucket))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _oracle() -> str:
    """Descends level by level. Slots follow doc_id at every size. DuckDB has no crc32: its table is made by rule, eight steps of the reflected polynomial."""
    tree = topology(8)

    def enter(nodes: dict[str, float]) -> str:
        """The path of the child with the least draw."""
        draw = {p: f"-ln((CAST('0x' || substr(md5(k || ':{p}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {w}" for p, w in nodes.items()}
        best = f"least({', '.join(draw.values())})" if len(draw) > 1 else next(iter(draw.values()))
        return "CASE " + " ".join(f"WHEN {d} = {best} THEN '{p}'" for p, d in draw.items()) + " END"

    def level(tree: list[Leaf], depth: int, above: str) -> str:
        """For the node at the path in column `above`: the child entered."""
        paths: dict[str, dict[str, float]] = {}
        for x in tree:
            up, path = ("/".join(str(getattr(x, c)) for c in LEVELS[:n]) for n in (depth, depth + 1))
            paths.setdefault(up, {}).setdefault(path, 0.0)
            paths[up][path] += x.weight
        return "CASE " + " ".join(f"WHEN {above} = '{up}' THEN {enter(nodes)}" for up, nodes in paths.items()) + " END"

    step = "list_reduce(list_prepend(CAST(i AS BIGINT), range(0, 8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH t AS (SELECT list({step} ORDER BY i) AS tab FROM range(256) r(i)),
b AS (SELECT doc_id, coalesce(text, '') AS s, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
h AS (SELECT doc_id, k, hex(encode(s)) AS x FROM b),
c AS (SELECT doc_id, k, length(x) // 2 + 1 AS size,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, v: xor(a >> 8, tab[(xor(a, v) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),
r AS (SELECT *, {level(tree, 0, "''")} AS ra, {level(grown(tree), 0, "''")} AS rb FROM c),
s AS (SELECT *, {level(tree, 1, "ra")} AS sa, {level(grown(tree), 1, "rb")} AS sb FROM r),
l AS (SELECT *, {level(tree, 2, "sa")} AS la, {level(grown(tree), 2, "sb")} AS lb FROM s),
e AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32,
  CAST(split_part(la, '/', 3) AS INTEGER) AS shard, CAST(split_part(lb, '/', 3) AS INTEGER) AS grown_shard FROM l)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM e
"""


ORACLE_SQL = _oracle()
