"""Merkle manifest of a data set: a hash tree over each language's documents, a tree over the languages, and proofs.

A leaf is the hash of a document's fields. Nodes are numbered ``(tree, level, index)``; every two consecutive nodes of
a level have their hash as parent, a last node without partner is hashed alone. Documents lie in their tree by id, in runs
of ``2 ** LEVELS`` leaves, the leaf partitions:

1. Each partition hashes its own subtree; the roots of the partitions are the leaves of the next layer, which is
   partitioned in the same way, so a tree of any size takes a few jobs and no task holds more than one run.
2. Proofs are made by an octopus multiproof. A partition walks up from all of its leaves at once and notes the coordinates of the
   siblings that it can't derive, each once (``missing``). One join fetches them all. With these the partition derives
   the interior nodes that its leaves' paths share, once, and then expands the proof of each leaf from memory.
3. A proof is checked by folding leaf and siblings up to the root, with a document's original or altered leaf.

Nodes near a root are asked for by very many partitions; they are spread over ``SALTS`` keys. A language that holds all rows is only ever a
part of the keys that rows are dealt by.

Defined results: null fields are ``-``; a null language is a tree of its own and comes first; a null id comes first in its tree and is never
altered; rows of one id lie by their leaf's hash, equal rows in any order; an empty table has no rows and no root; of other
columns than ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` nothing is read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinvec.llm.registry import register, table
from twinvec.operators.ordering import row_number_global
from twinvec.session import checkpoint, discard

#: A leaf partition has two to the power of this many leaves; ways in which an often wanted node is dealt out.
LEVELS, SALTS = 10, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots.
TOP = "top"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def width(n: int, level: int) -> int:
    """Nodes at ``level`` of a tree of ``n`` leaves."""
    return -(-n >> level) if n else 0


def missing(positions, n: int) -> list[tuple[int, int]]:
    """``(level, index)`` of the fewest nodes that complete the proofs of the leaves at ``positions`` in a tree of ``n`` leaves."""
    here, out = set(positions), []
    for level in range(height(n)):
        out += sorted((level, i ^ 1) for i in here if i ^ 1 not in here and i ^ 1 < width(n, level))
        here = {i >> 1 for i in here}
    return out


def interiors(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str], levels: int | None = None) -> list[dict[int, str]]:
    """By level, the nodes on the paths of ``leaves`` and their siblings; each parent is hashed once."""
    rows = [dict(leaves)]
    for level in range(height(n) if levels is None else min(levels, height(n))):
        row = rows[-1]
        own = {i >> 1 for i in row}
        row.update({i: h for (at, i), h in fetched.items() if at == level})
        rows.append({i: digest(row[2 * i] + row.get(2 * i + 1, "")) for i in own})
    return rows


def path(rows: list[dict[int, str]], position: int, n: int) -> list[tuple[str | None, bool]]:
    """Sibling (None where there is none) and whether it stands on the left, level by level."""
    return [(rows[level].get(position >> level ^ 1), bool(position >> level & 1)) for level in range(height(n))]


def fold(leaf: str, steps: list[tuple[str | None, bool]], known: dict[str, str]) -> str:
    """The root that ``leaf`` and its siblings lead to; ``known`` keeps hashes that several leaves share."""
    for sibling, left in steps:
        both = leaf if sibling is None else sibling + leaf if left else leaf + sibling
        if both not in known:
            known[both] = digest(both)
        leaf = known[both]
    return leaf


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**other: Column) -> Column:
    return F.sha2(F.concat(*[field(other.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def place(docs: DataFrame) -> DataFrame:
    """``tree, n, pos, doc_id, leaf, other`` (the altered leaf, null where nothing is altered), stored."""
    d = docs.select(F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("lang"))).alias("tree"), "doc_id",
                    leaf_hash().alias("leaf"), F.when(tampered(), leaf_hash(n_chars=F.col("n_chars") + 1)).alias("other"))
    d = d.withColumn("r", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("r")]
    d = ranged = checkpoint(d.repartitionByRange(parts, "tree", *order).withColumn("part", F.spark_partition_id()))
    # A tree's rows in a range partition follow each other; the sizes of these pieces give the position of each.
    piece, before = Window.partitionBy("tree").orderBy("part"), Window.unboundedPreceding
    sizes = d.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c")).select(
        "tree", "part", F.coalesce(F.sum("c").over(piece.rowsBetween(before, -1)), F.lit(0)).alias("start"),
        F.sum("c").over(piece.rowsBetween(before, Window.unboundedFollowing)).alias("n"))
    d = d.withColumn("i", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1)
    out = checkpoint(d.join(sizes, ["tree", "part"]).select("tree", "n", (F.col("start") + F.col("i")).alias("pos"), "doc_id", "leaf", "other"))
    discard(ranged)
    return out


GROWN = "tree string, n long, kind string, part long, level int, index long, hash string"


def grow(layer: DataFrame, base: int, levels: int, keep_from: int) -> DataFrame:
    """One job on ``layer`` (``tree, n, index, hash``; ``n`` nodes at level ``base``): ``node`` rows of the subtrees from level ``keep_from``
    up, ``root`` rows of trees that end here and, on the first layer, ``need`` rows: what a partition can't derive itself."""
    def run(key, t):
        tree, part, n = key[0].as_py(), key[1].as_py(), t["n"][0].as_py()
        rows = interiors(dict(zip(t["index"].to_pylist(), t["hash"].to_pylist())), n, {}, levels)
        out = [("node", base + k, i, h) for k, row in enumerate(rows) if base + k >= keep_from and (k or not base) for i, h in row.items()]
        if n <= 1 << levels:
            out.append(("root", base + height(n), 0, rows[-1][0]))
        if not base:
            out += [("need", level, i, None) for level, i in missing(rows[0], n)] + [("part", 0, 0, None)]
        kind, level, index, hashes = zip(*out) if out else ((), (), (), ())
        return pa.table({"tree": pa.array([tree] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()), "kind": pa.array(kind, pa.string()),
                         "part": pa.array([part] * len(out), pa.int64()), "level": pa.array(level, pa.int32()),
                         "index": pa.array(index, pa.int64()), "hash": pa.array(hashes, pa.string())})
    part = F.shiftright("index", levels).alias("part")
    return layer.select("tree", "n", "index", "hash", part).groupBy("tree", "part").applyInArrow(run, GROWN)


def forest(leaves: DataFrame, levels: int, keep_from: int) -> DataFrame:
    """The ``GROWN`` rows of whole trees, stored layer by layer; ``leaves``: ``tree, n, index, hash``."""
    done, layer, base = [], leaves, 0
    while True:
        out = checkpoint(grow(layer, base, levels, keep_from))
        done.append(out)
        layer = out.where((F.col("n") > 1 << levels) & (F.col("kind") == "node") & (F.col("level") == base + levels)).select(
            "tree", F.ceil(F.col("n") / (1 << levels)).alias("n"), "index", "hash")
        if layer.isEmpty():
            return reduce(DataFrame.union, done)
        base += levels


def fetch(grown: DataFrame, levels: int) -> DataFrame:
    """``tree, part, level, index, hash``: every node that a leaf partition needs."""
    hot = F.col("level") >= levels + 8  # below that no node is wanted by more than 256 partitions
    need = grown.where("kind = 'need'").select("tree", "part", "level", "index", F.when(hot, F.pmod("part", F.lit(SALTS))).otherwise(0).alias("salt"))
    node = grown.where("kind = 'node'").select("tree", "level", "index", "hash", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))).alias("salt"))
    node = node.withColumn("salt", F.col("salt").cast("long"))
    return need.withColumn("salt", F.col("salt").cast("long")).join(node, ["tree", "level", "index", "salt"]).select("tree", "part", "level", "index", "hash")


def top_paths(roots: DataFrame, levels: int) -> DataFrame:
    """``tree, subroot, root, steps`` (``hash, left`` from the subroot up) for ``roots``: ``tree, hash``."""
    t = checkpoint(row_number_global(roots, [F.col("tree").asc()], "index", start=0))
    n = t.count()
    grown = forest(t.select(F.lit(TOP).alias("tree"), F.lit(n).cast("long").alias("n"), "index", "hash"), levels, 0)
    node = grown.where("kind = 'node'").select("level", "index", "hash")
    steps = t.select("tree", F.explode(F.sequence(F.lit(0), F.lit(max(0, height(n) - 1)))).alias("level"), F.col("index").alias("i")).select(
        "tree", "level", F.expr("shiftright(i, level)").alias("at"))
    steps = steps.select("tree", "level", (F.col("at") % 2 == 1).alias("left"), F.col("at").bitwiseXOR(F.lit(1)).alias("index"))
    steps = steps.join(node, ["level", "index"], "left").groupBy("tree").agg(
        F.array_sort(F.collect_list(F.struct("level", "hash", "left"))).alias("steps"))  # a row for each level of the top tree
    root = grown.where("kind = 'root'").first()  # one value
    out = t.select("tree", F.col("hash").alias("subroot"), F.lit(root and root["hash"]).cast("string").alias("root")).join(steps, "tree")
    return out.select("tree", "subroot", "root", F.when(F.lit(n > 1), F.col("steps")).otherwise(F.array().cast(
        "array<struct<level:int,hash:string,left:boolean>>")).alias("steps"))


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, hash of the proof, and the root folded from the altered or original leaf, of every document."""
    if levels < 1:
        raise ValueError("a leaf partition needs two leaves at least")
    placed = place(docs)
    grown = forest(placed.select("tree", "n", F.col("pos").alias("index"), F.col("leaf").alias("hash")), levels, levels)
    tops = top_paths(grown.where("kind = 'root'").select("tree", "hash"), levels)
    # What goes to a partition: one row with its language's way to the root, and a row for each node that it lacks.
    parts = grown.where("kind = 'part'").select("tree", "part", F.pmod("part", F.lit(SALTS)).alias("salt"))
    salted = tops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    heads = parts.join(salted, ["tree", "salt"]).select("tree", "part", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("index"),
                                                       F.lit(None).cast("string").alias("hash"), "subroot", "root", "steps")
    sent = fetch(grown, levels).select("*", *[F.lit(None).cast(dict(heads.dtypes)[c]).alias(c) for c in ("subroot", "root", "steps")])
    sent = sent.unionByName(heads)

    def prove(key, own, got):
        got = got.to_pylist()
        head = next(x for x in got if x["level"] < 0)
        n, at, leaves = own["n"][0].as_py(), own["pos"].to_pylist(), own["leaf"].to_pylist()
        rows = interiors(dict(zip(at, leaves)), n, {(x["level"], x["index"]): x["hash"] for x in got if x["level"] >= 0})
        above, known, out = [(s["hash"], s["left"]) for s in head["steps"]], {}, []
        for doc, p, leaf, other in zip(own["doc_id"].to_pylist(), at, leaves, own["other"].to_pylist()):
            steps = path(rows, p, n) + above
            found = fold(other or leaf, steps, known)
            out.append((doc, leaf, head["subroot"], head["root"], digest("".join(h for h, _ in steps if h)), found, found == head["root"]))
        names = [c.split()[0] for c in PROVED.split(", ")]
        kinds = [pa.int64()] + [pa.string()] * 5 + [pa.bool_()]
        return pa.table({c: pa.array([x[i] for x in out], k) for i, (c, k) in enumerate(zip(names, kinds))})
    mine = placed.withColumn("part", F.shiftright("pos", levels)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return mine.groupBy("tree", "part").cogroup(sent.groupBy("tree", "part")).applyInArrow(prove, PROVED)


def _sql() -> str:
    enc = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR END"
    leaf = lambda chars: "sha256(" + " || ".join(enc(chars if c == "n_chars" else c) for c in FIELDS) + ")"
    bits = ("list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: "
            "list_concat([ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))), "
            "lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) ELSE xor(c >> 1, (c & 1) * 3988292384) END)")
    grow = lambda name, start: (f"{name} AS ({start} UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) "  # noqa: E731
                                f"FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 2, n)")
    walk = lambda name, start, nodes: (
        f"{name} AS ({start} UNION ALL SELECT p.id, p.tree, p.level + 1, p.pos // 2, (p.n + 1) // 2, "
        "sha256(CASE WHEN s.h IS NULL THEN p.cur WHEN p.pos % 2 = 0 THEN p.cur || s.h ELSE s.h || p.cur END), p.proof || coalesce(s.h, '') "
        f"FROM {name} p LEFT JOIN {nodes} s ON s.tree = p.tree AND s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.n > 1)")
    return f"""WITH RECURSIVE l AS (SELECT doc_id, coalesce('v' || lang, 'n') AS tree, {leaf('n_chars')} AS leaf, {leaf('(n_chars + 1)')} AS other,
  xor({bits}, 4294967295) % 7 = 0 AS bad, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
{grow('node', 'SELECT tree, 0 AS level, pos, n, leaf AS h FROM l')},
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
{grow('tnode', "SELECT 'top' AS tree, 0 AS level, pos, n, h FROM sub")},
{walk('p', "SELECT doc_id AS id, tree, 0 AS level, pos, n, CASE WHEN bad THEN other ELSE leaf END AS cur, '' AS proof FROM l", 'node')},
{walk('q', "SELECT p.id, 'top' AS tree, 0 AS level, sub.pos, sub.n, p.cur, p.proof FROM p JOIN sub ON sub.tree = p.tree WHERE p.n = 1", 'tnode')}
SELECT l.doc_id, l.leaf, sub.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.cur AS folded_root, q.cur = r.h AS verified
FROM l JOIN sub ON sub.tree = l.tree JOIN q ON q.id = l.doc_id AND q.n = 1 CROSS JOIN (SELECT h FROM tnode WHERE n = 1) r"""


SQL = _sql()


@register("op13_merkle", SQL)
def op13_merkle(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))
