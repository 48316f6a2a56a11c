"""A Merkle manifest of a dataset: one root for all rows, and for each row a proof that it belongs to that root.

Rows are the leaves of one tree a source, every ARITY consecutive nodes having one parent; the sources' roots, in order,
are the leaves of one more tree. Trees are built by *aligned builders*: a builder takes ARITY ** HEIGHT consecutive
leaves that begin at a multiple of that number, so that its nodes depend on no other builder, and appends each node
to its log when the node is complete: a leaf when it comes, a parent right after its last child. That is postorder, so
where a node stands in the log follows from the sizes of the subtrees before it (``position``), and a proof
is read from the log by position, without searching and without pointers. Builders' roots are the leaves of the
next round of builders, which is ARITY ** HEIGHT times smaller.

    leaves --sorted, numbered--> builders --roots--> builders ... --subroots--> builders --> root
    proofs come back the same way: what is above a builder's root is the same for all its leaves
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemill.llm.common import cut, shuffles, table

#: Children of a node, and levels that one builder adds: 729 leaves, 35 kB of log.
ARITY, HEIGHT = 3, 6
SPAN = ARITY**HEIGHT
#: Leaves of a task, about.
CELL = 20_000
SIZE = 32

LOG = "tree long, block long, size long, n long, at long, root binary, log binary"


def digest(*parts: Column) -> Column:
    """H of the parts, each `-` if null, else its length in bytes, a colon and its value."""
    return F.sha2(F.concat(*map(_field, parts)), 256)


def _field(part: Column) -> Column:
    value = part.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def parent(children: list[bytes]) -> bytes:
    """H of nodes, which enter as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def levels(n: int) -> int:
    """Levels above n leaves until one node remains."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def append_all(leaves: list[bytes], top: int) -> list[bytes]:
    """The log of a tree of ``top`` levels: every node when it is complete; runs still open at the end are closed bottom up."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def add(level: int, node: bytes) -> None:
        log.append(node)
        if level == top:
            return
        run = open_runs[level]
        run.append(node)
        if len(run) == ARITY:
            open_runs[level] = []
            add(level + 1, parent(run))

    for leaf in leaves:
        add(0, leaf)
    for level in range(top):
        if run := open_runs[level]:
            open_runs[level] = []
            add(level + 1, parent(run))
    return log


def position(level: int, index: int, n: int, top: int) -> int:
    """Where node ``index`` of a level stands in the log of a tree of n leaves and ``top`` levels.

    A full node closes with leaf m = (index + 1) * ARITY ** level: before that leaf stand all nodes that m - 1 leaves
    complete, then the leaf, then the levels up to this one. A node that is not full is closed after all full ones,
    as the levels from the lowest partial one upward.
    """
    m = (index + 1) * ARITY**level
    if m <= n:
        return _complete(m - 1, top) + level
    lowest = 0
    while n % ARITY ** (lowest + 1) == 0:
        lowest += 1
    return _complete(n, top) + level - lowest - 1


def _complete(n: int, top: int) -> int:
    """Full nodes of all levels that n leaves complete."""
    return sum(n // ARITY**k for k in range(top + 1))


def path(log: bytes, leaf: int, n: int, top: int) -> bytes:
    """A leaf's siblings, level by level: its place in the run, the run's length, the digests of the others."""
    out, index, width = [], leaf, n
    for level in range(top):
        first = index - index % ARITY
        run = range(first, min(first + ARITY, width))
        out.append(bytes((index - first, len(run))))
        for other in run:
            if other != index:
                at = SIZE * position(level, other, n, top)
                out.append(log[at : at + SIZE])
        index, width = index // ARITY, -(-width // ARITY)
    return b"".join(out)


def steps(way: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings) of each level of a path."""
    at = 0
    while at < len(way):
        place, count = way[at], way[at + 1]
        at += 2
        yield place, [way[k : k + SIZE] for k in range(at, at + SIZE * (count - 1), SIZE)]
        at += SIZE * (count - 1)


def proof(way: bytes) -> str:
    """H of all siblings on a path."""
    return hashlib.sha256(b"".join(s for _, own in steps(way) for s in own).hex().encode()).hexdigest()


def fold(leaf: bytes, way: bytes) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for place, own in steps(way):
        leaf = parent([*own[:place], leaf, *own[place:]])
    return leaf


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with ``__index``, their place in their tree by ``order`` (nulls first, text by its bytes), and ``__size``, the tree's rows.

    One sort by ranges; a tree that holds most rows is spread over as many ranges as any other rows, and rows that
    are equal in everything are told apart by where they stood in the table, which must be a written one.
    """
    spark = rows.sparkSession
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in (tree, *order, "__stood")]
    placed = rows.withColumn("__stood", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(shuffles(spark), *keys).sortWithinPartitions(*keys).drop("__stood")
    ordered = cut(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    runs = ordered.groupBy(F.col(f"`{tree}`").alias("__tree"), task.alias("__task")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = W.partitionBy("__tree").orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    placed_runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__size", F.sum("__n").over(W.partitionBy("__tree")))
    same = F.col(f"`{tree}`").eqNullSafe(F.col("__tree")) & (task == F.col("__task"))
    joined = ordered.join(placed_runs, same)
    return joined.withColumn("__index", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__tree", "__task", "__first", "__n", "__before")


def _cells(df: DataFrame, cells: int, block: Column) -> DataFrame:
    return df.withColumn("cell", F.pmod(F.xxhash64("tree", block), F.lit(cells)).cast("int"))


def _blocks(group: pa.Table) -> Iterator[tuple[int, int, int, list[dict]]]:
    """(tree, block, size, rows in order) of each builder in a task."""
    by: dict[tuple[int, int], list[dict]] = {}
    for row in group.to_pylist():
        by.setdefault((row["tree"], row["index"] // SPAN), []).append(row)
    for (tree, block), rows in by.items():
        rows.sort(key=lambda r: r["index"])
        if [r["index"] for r in rows] != list(range(block * SPAN, min(block * SPAN + SPAN, rows[0]["size"]))):
            raise RuntimeError("leaves are not numbered one after the other")
        yield tree, block, rows[0]["size"], rows


def _top(size: int) -> int:
    """Levels that the builders of a tree of so many leaves add: up to its root, or HEIGHT."""
    return levels(size) if size <= SPAN else HEIGHT


def build(nodes: DataFrame, cells: int) -> DataFrame:
    """(tree, block, size, n, at, root, log) of the builders of a round; ``at`` is where the log begins in that of its tree.

    nodes: (tree, index, size, digest).
    """

    def run(group: pa.Table) -> pa.Table:
        out: list[dict] = []
        for tree, block, size, rows in _blocks(group):
            log = append_all([r["digest"] for r in rows], _top(size))
            at = _complete(block * SPAN, 60)
            out.append({"tree": tree, "block": block, "size": size, "n": len(rows), "at": at, "root": log[-1], "log": b"".join(log)})
        return pa.Table.from_pylist(out, pa.schema([*[(c, pa.int64()) for c in ("tree", "block", "size", "n", "at")], ("root", pa.binary()), ("log", pa.binary())]))

    own = _cells(nodes.select("tree", "index", "size", "digest"), cells, F.floor(F.col("index") / SPAN))
    return own.groupBy("cell").applyInArrow(run, LOG)


def rounds(nodes: DataFrame, most: int, cells: int) -> list[DataFrame]:
    """The logs of all rounds, written, until every tree has one root; ``most`` is the size of the largest tree."""
    logs = [cut(build(nodes, cells))]
    while most > SPAN:
        most, cells = -(-most // SPAN), max(1, cells // SPAN)
        again = logs[-1].where(F.col("size") > SPAN)
        up = again.select("tree", F.col("block").alias("index"), F.ceil(F.col("size") / SPAN).cast("long").alias("size"), F.col("root").alias("digest"))
        logs.append(cut(build(up, cells)))
    return logs


def roots(logs: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree of these rounds."""
    ends = [log.where(F.col("size") <= SPAN).select("tree", "root") for log in logs]
    return ends[0] if len(ends) == 1 else ends[0].unionByName(roots(logs[1:]))


def descend(log: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, index, way) of the leaves of a round: siblings in their builder's log, then what is above the builder's root.

    above: (tree, block, way).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                top, first = _top(r["size"]), r["block"] * SPAN
                ways = [path(r["log"], i, r["n"], top) + r["way"] for i in range(r["n"])]
                yield pa.record_batch(
                    [pa.array([r["tree"]] * r["n"], pa.int64()), pa.array(range(first, first + r["n"]), pa.int64()), pa.array(ways, pa.binary())],
                    ["tree", "index", "way"],
                )

    joined = log.join(above, ["tree", "block"]).select("tree", "block", "size", "n", "log", "way")
    return joined.mapInArrow(run, "tree long, index long, way binary")


def ways_above(logs: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, block, way) for the builders of the first round; ends: (tree, way) of the trees' roots."""
    above = None
    for log in reversed(logs):
        done = log.where(F.col("size") <= SPAN).join(ends, "tree").select("tree", "block", "way")
        if above is None:
            above = done
        else:
            above = done.unionByName(descend(upper, above).select("tree", F.col("index").alias("block"), "way"))
        upper = log
    return above


def manifest(docs: DataFrame, source: str, key: str, leaf: Column, received: Column) -> DataFrame:
    """(source, key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``leaf`` is the digest of a row as it was when the manifest was made, ``received`` of the row as it is now; the folded
    root comes from the latter and the siblings of the former. Leaves of a source ascend by key, null first, and by
    leaf where keys are equal; repeated rows are leaves of their own. Null and empty values, texts of any length and
    columns that are not hashed need no care, as only digests go on. A tree of one leaf is that leaf; without
    siblings the proof is H of nothing. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    first = cut(docs.select(F.col(source).alias("source"), F.col(key).alias("key"), leaf.alias("leaf"), received.alias("received")))
    total = first.count()
    out = T.StructType([
        T.StructField(source, first.schema["source"].dataType), T.StructField(key, first.schema["key"].dataType),
        *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
        T.StructField("verified", T.BooleanType()),
    ])
    if not total:
        return spark.createDataFrame([], out)
    rows = numbered(first, "source", ["key", "leaf"])
    names = cut(rows.where("__index = 0").select(F.lit(0).alias("all"), "source"))
    trees = numbered(names, "all", ["source"]).select(F.col("source").alias("__source"), F.col("__index").alias("tree"), F.col("__size").alias("trees"))
    leaves = cut(
        rows.join(trees, rows["source"].eqNullSafe(F.col("__source")))
        .select("source", "key", F.unhex("leaf").alias("digest"), F.unhex("received").alias("received"), "tree", F.col("__index").alias("index"), F.col("__size").alias("size"))
    )
    most, n_trees = leaves.agg(F.max("size"), F.max("tree") + 1).first()
    cells = max(shuffles(spark), math.ceil(total / CELL))
    logs = rounds(leaves, most, cells)
    subroots = roots(logs)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(n_trees).cast("long").alias("size"), F.col("root").alias("digest"))
    top_logs = rounds(tops, n_trees, max(1, math.ceil(n_trees / CELL)))
    root = roots(top_logs).first()["root"]
    empty = spark.range(1).select(F.col("id").alias("tree"), F.lit(b"").alias("way"))
    ends = descend(top_logs[0], ways_above(top_logs, empty)).select(F.col("index").alias("tree"), "way")
    above = ways_above(logs, ends).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    segments = logs[0].join(above, ["tree", "block"]).select("tree", "block", "n", "log", "way", "subroot")
    names_out = out.names

    def run(group: pa.Table, logs_of: pa.Table) -> pa.Table:
        own = {(r["tree"], r["block"]): r for r in logs_of.to_pylist()}
        made: list[dict] = []
        for tree, block, size, rows in _blocks(group):
            segment = own[tree, block]
            for r in rows:
                way = path(segment["log"], r["index"] - block * SPAN, segment["n"], _top(size)) + segment["way"]
                folded = fold(r["received"], way)
                values = (r["source"], r["key"], r["digest"].hex(), segment["subroot"].hex(), root.hex(), proof(way), folded.hex(), folded == root)
                made.append(dict(zip(names_out, values)))
        kinds = [group.schema.field("source").type, group.schema.field("key").type, *[pa.string()] * 5, pa.bool_()]
        return pa.Table.from_pylist(made, pa.schema(list(zip(names_out, kinds))))

    left = _cells(leaves, cells, F.floor(F.col("index") / SPAN)).groupBy("cell")
    return left.cogroup(_cells(segments, cells, F.col("block")).groupBy("cell")).applyInArrow(run, out)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against texts that lost their line ends where the key's checksum is even."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    now = F.when(tampered, F.translate(text, "\n", "")).otherwise(text)
    found = manifest(docs, "source", "doc_id", digest(*fields, text), digest(*fields, now))
    return found.drop("source")


def _part(column: str) -> str:
    value = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf(*columns: str) -> str:
    return f"sha256({' || '.join(map(_part, columns))})"


_BYTES = "list_transform(range(1, 2 * length(CAST(doc_id AS VARCHAR)), 2), lambda i: CAST('0x' || substr(hex(encode(CAST(doc_id AS VARCHAR))), i, 2) AS BIGINT))"
#: CRC-32 of the decimal key, by the table ``t``.
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
#: Levels of the sources' trees and of the one above them by recursion; every leaf is folded with the runs on its way.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
docs AS (SELECT *, CASE WHEN {_CRC} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents, crc),
trees AS (SELECT source AS name, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
leaves AS MATERIALIZED (SELECT doc_id, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS idx, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
    {_leaf('doc_id', 'source', 'lang', 'n_chars', 'now')} AS received FROM docs JOIN trees ON source IS NOT DISTINCT FROM name),
lower_ AS (SELECT tree, 0 AS l, idx, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, l + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM lower_ WHERE n > 1 GROUP BY tree, l, idx // 3, n),
subs AS (SELECT tree, l AS top, h AS subroot FROM lower_ WHERE n = 1),
upper_ AS (SELECT 0 AS l, tree AS idx, (SELECT count(*) FROM trees) AS n, subroot AS h FROM subs
  UNION ALL SELECT l + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_ WHERE n > 1 GROUP BY l, idx // 3, n),
nodes AS MATERIALIZED (SELECT tree, l, idx, h FROM lower_ WHERE n > 1 UNION ALL SELECT s.tree, s.top + u.l, u.idx, u.h FROM upper_ u, subs s WHERE u.n > 1),
ways AS MATERIALIZED (SELECT doc_id, leaves.tree, l, CASE WHEN l < top THEN idx ELSE leaves.tree END // CAST(pow(3, CASE WHEN l < top THEN l ELSE l - top END) AS BIGINT) AS idx
  FROM leaves JOIN subs USING (tree) JOIN (SELECT DISTINCT tree, l FROM nodes) USING (tree)),
steps AS MATERIALIZED (SELECT doc_id, w.l, list(CASE WHEN k.idx = w.idx THEN NULL ELSE k.h END ORDER BY k.idx) AS hs FROM ways w JOIN nodes k ON k.tree = w.tree AND k.l = w.l AND k.idx // 3 = w.idx // 3 GROUP BY 1, 2),
fold AS (SELECT doc_id, 0 AS l, received AS x FROM leaves
  UNION ALL SELECT f.doc_id, f.l + 1, sha256(array_to_string(list_transform(s.hs, lambda h: coalesce(h, f.x)), '')) FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.l = f.l),
proofs AS (SELECT doc_id, string_agg(array_to_string(hs, ''), '' ORDER BY l) AS p FROM steps GROUP BY 1),
root_ AS (SELECT h AS root FROM upper_ WHERE n = 1)
SELECT leaves.doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, x AS folded_root, x = root AS verified
FROM leaves JOIN subs USING (tree) CROSS JOIN root_ LEFT JOIN proofs USING (doc_id) JOIN (SELECT doc_id, arg_max(x, l) AS x FROM fold GROUP BY 1) USING (doc_id)
"""
