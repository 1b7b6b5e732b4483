"""Merkle manifest of a dataset: a tree of SHA-256 for each value of a column, and one tree over their roots.

The leaf of a row hashes its fields, each as its byte count, a colon and its UTF-8 text, or "-" if null. Rows of a tree
ascend by id; runs of ARITY nodes become the hash of their digests (as hex text) until one is left. A last run may hold
fewer nodes, even one. The roots, ordered by the column (null first, bytewise), likewise become the root.

Rows are sorted and numbered as a whole, so a tree of any size is dealt over tasks: WIDTH nodes in a row form a group,
the root of a group is a node of the next round, and a value that holds most rows only has more groups. On the way down
each group gets the siblings above it. Within a group every parent keeps a copy of its hash state before each child;
folding a replaced leaf resumes the state of its slot and hashes the replacement and the siblings to its right only.

Null ids come first and rows that agree in id go by their leaf, so repeated rows are leaves of their own. Empty texts
are "0:", texts of any length are hashed whole, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, cut, ranged, table

ARITY = 2
#: Nodes of a group, at most.
WIDTH = 4096
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A field in the hash of its row."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)).cast("binary"), 256)


def rounds(n: int, arity: int) -> int:
    """Rounds until n nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def grown(nodes: list[bytes], arity: int, most: int) -> tuple[list[list[bytes]], list[list[list]]]:
    """Levels of a subtree from its lowest nodes up, and for each parent the hash states before its children."""
    levels, states = [nodes], []
    for _ in range(most):
        parents, kept = [], []
        for i in range(0, len(levels[-1]), arity):
            h, own = hashlib.sha256(), []
            for child in levels[-1][i : i + arity]:
                own.append(h.copy())
                h.update(child)
            parents.append(h.hexdigest().encode())
            kept.append(own)
        levels.append(parents)
        states.append(kept)
    return levels, states


def steps(levels: list[list[bytes]], i: int, arity: int) -> list[str]:
    """For each level, the slot of node i's ancestor and its siblings: "slot:digests"."""
    out = []
    for level in levels[:-1]:
        lo = i - i % arity
        out.append(f"{i - lo}:" + b"".join(level[lo:i] + level[i + 1 : lo + arity]).decode())
        i //= arity
    return out


def resumed(above: list[str]) -> list[tuple]:
    """(state after the left siblings, right siblings, all siblings) of each step."""
    out = []
    for s in above:
        slot, _, digests = s.partition(":")
        left, right = digests[: HEX * int(slot)].encode(), digests[HEX * int(slot) :].encode()
        out.append((hashlib.sha256(left), right, left + right))
    return out


def _needed(n: int, arity: int, deep: int) -> int:
    return min(deep, rounds(n, arity))


def _deep(arity: int) -> int:
    return max(1, int(math.log(WIDTH, arity) + 1e-9))


def _grouped(nodes: DataFrame, arity: int, *more: str) -> DataFrame:
    """Nodes (tree, pos, n, digest and more) as groups (tree, g, n, nodes in order)."""
    g = F.floor(F.col("pos") / arity ** _deep(arity)).cast("long").alias("g")
    return nodes.groupBy("tree", g, "n").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *more))).alias("nodes"))


def _raised(nodes: DataFrame, arity: int) -> DataFrame:
    """The roots of groups as nodes of the next round; n counts the nodes of a tree."""
    deep = _deep(arity)

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            roots = [grown([x["digest"].encode() for x in r["nodes"]], arity, _needed(r["n"], arity, deep))[0][-1][0].decode() for r in rows]
            left = [-(-r["n"] // arity**deep) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["tree"] for r in rows], pa.string()), pa.array([r["g"] for r in rows], pa.int64()), pa.array(left, pa.int64()), pa.array(roots, pa.string())], ["tree", "pos", "n", "digest"])

    return _grouped(nodes, arity).mapInArrow(run, "tree string, pos long, n long, digest string")


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """rows (tree and what orders them, sorted as a whole with seq) with pos within their tree and n, its size."""
    part = F.shiftright("seq", 33).alias("part")
    counts = rows.groupBy("tree", part).agg(F.min("seq").alias("lo"), F.count("*").alias("c"))
    w = Window.partitionBy("tree")  # as many rows a tree as the sort had tasks
    before = F.sum("c").over(w.orderBy("part")) - F.col("c")
    offsets = cut(counts.select("tree", "part", (before - F.col("lo")).alias("shift"), F.sum("c").over(w).alias("n")), name)
    return rows.withColumn("part", part).join(offsets, ["tree", "part"]).withColumn("pos", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _levels(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Nodes of each round, up to the one that has one node a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        out.append(cut(_raised(out[-1], arity), "merkle-level"))
        most = -(-most // arity ** _deep(arity))
    return out


def _descended(nodes: DataFrame, above: DataFrame, arity: int) -> DataFrame:
    """(tree, pos, steps): siblings of each node and of all above it. above: those of the groups' roots."""
    deep = _deep(arity)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                levels, _ = grown([x["digest"].encode() for x in r["nodes"]], arity, _needed(r["n"], arity, deep))
                ways = [steps(levels, i, arity) + r["steps"] for i in range(len(r["nodes"]))]
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(ways), pa.string()), pa.array([x["pos"] for x in r["nodes"]], pa.int64()), pa.array(ways, pa.list_(pa.string()))], ["tree", "pos", "steps"])

    return _below(nodes, above, arity).mapInArrow(run, "tree string, pos long, steps array<string>")


def _below(nodes: DataFrame, above: DataFrame, arity: int, *more: str) -> DataFrame:
    return _grouped(nodes, arity, *more).join(above.withColumnRenamed("pos", "g"), ["tree", "g"])


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None, arity: int = ARITY, with_steps: bool = False) -> DataFrame:
    """A row for each row of docs: id, leaf, subroot (of its tree), root, proof_sha256, folded_root, verified; steps if asked for.

    changed has columns that replace fields where a row meets the condition; folded_root is the root that follows
    from the changed leaf and the siblings as they were, verified whether it is the root. proof_sha256 hashes the
    siblings of a leaf and of all above it, level by level, left to right; steps are these as "slot:digests".
    """
    changed = changed or {}
    own = leaf([docs[c] for c in fields])
    new = F.when(where, leaf([changed.get(c, docs[c]) for c in fields])).otherwise(own) if where is not None and changed else own
    tree = F.coalesce(F.concat(F.lit("1"), docs[tree_col].cast("string")), F.lit("0"))
    rows = docs.select(tree.alias("tree"), docs[id_col].alias("id"), own.alias("digest"), new.alias("new"))
    rows = ranged(rows, [F.col("tree"), F.asc_nulls_first("id"), F.col("digest"), F.col("new")], "merkle-leaves")
    leaves = _placed(rows, "merkle-offsets")
    trees = _levels(leaves, arity)
    subroots = cut(trees[-1].select("tree", F.col("digest")), "merkle-subroots")
    over = _placed(ranged(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), [F.col("key")], "merkle-trees"), "merkle-tree-offsets")
    tops = _levels(over, arity)
    first = tops[-1].select("digest").first()
    root = first[0] if first else ""
    none = F.expr("cast(array() as array<string>)")
    above = tops[-1].select("tree", "pos", none.alias("steps"))
    for nodes in reversed(tops[:-1]):
        above = cut(_descended(nodes, above, arity), "merkle-above")
    # A subroot is the only node of the last round of its tree.
    above = cut(over.select(F.col("key"), "pos", F.col("digest").alias("subroot")).join(above.drop("tree"), "pos").select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("pos"), "steps", "subroot"), "merkle-above")
    names = above.select("tree", "subroot")
    for nodes in reversed(trees[1:-1]):
        above = cut(_descended(nodes, above, arity), "merkle-above")
    deep, kind = _deep(arity), dict(leaves.dtypes)["id"]

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("nodes"))
            for k, r in enumerate(b.drop_columns(["nodes"]).to_pylist()):
                nodes = ids.slice(k, 1).flatten()
                at = [nodes.field(nodes.type.get_field_index(c)) for c in ("id", "digest", "new")]
                digests, news = ([x.encode() for x in a.to_pylist()] for a in at[1:])
                levels, states = grown(digests, arity, _needed(r["n"], arity, deep))
                upper = resumed(r["steps"])
                proofs, folded, ways = [], [], []
                for i, new in enumerate(news):
                    proof, x, j = hashlib.sha256(), new, i
                    for level, kept in zip(levels, states, strict=False):
                        lo = j - j % arity
                        h, right = kept[j // arity][j - lo].copy(), b"".join(level[j + 1 : lo + arity])
                        proof.update(b"".join(level[lo:j]) + right)
                        h.update(x + right)
                        x, j = h.hexdigest().encode(), j // arity
                    for state, right, both in upper:
                        h = state.copy()
                        h.update(x + right)
                        proof.update(both)
                        x = h.hexdigest().encode()
                    proofs.append(proof.hexdigest())
                    folded.append(x.decode())
                    ways.append(steps(levels, i, arity) + r["steps"] if with_steps else None)
                n = len(news)
                yield pa.RecordBatch.from_arrays([at[0], at[1], pa.array([r["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded]), pa.array(ways, pa.list_(pa.string()))], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "steps"])

    if len(trees) == 1:  # a tree is its leaf
        groups = leaves.withColumn("g", F.col("pos")).select("tree", "g", "n", F.array(F.struct("pos", "digest", "id", "new")).alias("nodes")).join(above.drop("pos"), "tree")
    else:
        groups = _below(leaves, above.select("tree", "pos", "steps"), arity, "id", "new").join(names, "tree")
    out = groups.select("n", "nodes", "steps", "subroot").mapInArrow(run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, steps array<string>")
    return out.withColumnRenamed("id", id_col) if with_steps else out.drop("steps").withColumnRenamed("id", id_col)


def folds(leaf_hex: str, way: list[str]) -> str:
    """The root that follows from a leaf and its steps."""
    x = leaf_hex.encode()
    for state, right, _ in resumed(way):
        state.update(x + right)
        x = state.hexdigest().encode()
    return x.decode()


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = (docs["n_chars"].cast("decimal(20,0)") + 1).cast("string")
    return manifest(docs, changed={"n_chars": more}, where=F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0)


def _field(c: str) -> str:
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


_LEAF = "sha256(" + " || ".join(map(_field, FIELDS)) + ")"
_TAMPERED = "sha256(" + " || ".join(_field("n_chars + 1" if c == "n_chars" else c) for c in FIELDS) + ")"
_UP = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

SQL = f"""
with recursive d as (
  select doc_id, coalesce('1' || lang, '0') as tree, {_LEAF} as leaf, case when {crc32_sql('cast(doc_id as varchar)')} % 7 = 0 then {_TAMPERED} else {_LEAF} end as new from documents),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from d),
t(tree, level, nodes) as (
  select tree, 0, list(leaf order by pos) from p group by tree
  union all select tree, level + 1, {_UP} from t where len(nodes) > 1),
s as (select tree, nodes[1] as subroot, row_number() over (order by tree) - 1 as rank from t where len(nodes) = 1),
u(level, nodes) as (
  select 0, list(subroot order by rank) from s having count(*) > 0
  union all select level + 1, {_UP} from u where len(nodes) > 1),
a as (
  select p.tree, p.pos, list({{'own': (p.pos >> t.level) & 1, 'sib': coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '')}} order by t.level) as way
  from p join t on t.tree = p.tree and len(t.nodes) > 1 group by p.tree, p.pos),
b as (
  select s.tree, list({{'own': (s.rank >> u.level) & 1, 'sib': coalesce(u.nodes[xor(s.rank >> u.level, 1) + 1], '')}} order by u.level) as way
  from s join u on len(u.nodes) > 1 group by s.tree),
x as (
  select p.doc_id, p.leaf, p.new, s.subroot, (select nodes[1] from u where len(nodes) = 1) as root,
         list_concat(coalesce(a.way, []), coalesce(b.way, [])) as way
  from p join s using (tree) left join a on a.tree = p.tree and a.pos = p.pos left join b on b.tree = p.tree),
f as (
  select *, list_reduce(list_prepend({{'own': 0::bigint, 'sib': new}}, way), lambda h, w: {{'own': 0::bigint, 'sib': sha256(case when w.own = 1 then w.sib || h.sib else h.sib || w.sib end)}}).sib as folded_root from x)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda w: w.sib), '')) as proof_sha256, folded_root, folded_root = root as verified from f
"""
