"""Merkle manifest of a table: a hash tree per group of rows, and a tree over the groups.

``build`` numbers the leaves of each tree, hashes every ``FANOUT`` consecutive nodes
into their parent until one is left (the subroot), does the same with the subroots,
and stores what was built as rows that link a node to its parent: the digests of its
siblings to the left and to the right, and the parent's place. ``climb`` is one
recursive query on these rows. The leaves of a run start together, for they have all
higher siblings in common; each presented leaf has a hash of its own on the way,
which is folded with the siblings of each level.

Near the root many climbers meet in few nodes. A link row is therefore repeated under
salts, one for every ``ROWS`` runs below it, so no key is tied to more than these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

FANOUT = 8
#: Runs that climb through one copy of a link row.
ROWS = 128
#: Name of the tree over the subroots; those of groups are empty (NULL) or start with a dot.
TOP = "^"
_PART_BITS = 33  # of monotonically_increasing_id


def leaf_digest(*fields: Column) -> Column:
    """Hash of the fields: `-` for NULL, else the length in UTF-8 bytes, `:`, the value."""
    as_text = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in as_text]).cast("binary"), 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def hash_of(*digests: Column) -> Column:
    """Hash of digests (or of several, one after the other), taken as lower-case hex text."""
    return F.unhex(F.sha2(hex_text(F.concat(*digests)).cast("binary"), 256))


def _joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))


def tree_name(group: Column) -> Column:
    """A name that is never NULL; names sort as groups do, NULL first."""
    return F.coalesce(F.concat(F.lit("."), group.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """Runs of leaves, links from nodes to parents, and the root (None without leaves) at its height."""

    runs: DataFrame
    links: DataFrame
    root: bytes | None
    height: int


def _numbered(rows: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """Add pos, the place of a row in its tree by ``order``, and n, the size of the tree.

    Rows are sorted by ranges, so a large tree is many tasks' work; the tree's rows in
    the parts before are summed up over one number per tree and part.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order)
    placed = materialize(sorted_rows.withColumn("id", F.monotonically_increasing_id()), purpose)
    part = F.shiftright("id", _PART_BITS).alias("part")
    counts = placed.groupBy("tree", part).agg(F.count("*").alias("own"), F.min("id").alias("begin"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "part", (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("begin")).alias("shift"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    return placed.withColumn("part", part).join(materialize(offsets, "offsets"), ["tree", "part"]).withColumn("pos", F.col("id") + F.col("shift")).drop("part", "id", "shift")


def _levels(nodes: DataFrame, height: int, fanout: int) -> list[tuple[int, DataFrame]]:
    """(height, parents) of each level above ``nodes`` (tree, pos, digest, weight, n), written.

    A parent also has ``kids``, the digests below it. Trees of one node have no parents.
    """
    largest = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    out = []
    while largest > 1:
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest", "weight")))
        run = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos"))
        level = run.agg(kids.alias("kids"), F.max("n").alias("n")).select(
            "tree", "pos", hash_of(_joined(F.col("kids.digest"))).alias("digest"), F.aggregate("kids.weight", F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"),
            F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("kids.digest").alias("kids"),
        )
        height += 1
        nodes = materialize(level, f"merkle-{height}")
        out.append((height, nodes))
        largest = -(-largest // fanout)
    return out


def _salts(weight: Column, rows: int) -> Column:
    return F.ceil(weight / rows).cast("long")


def _links(levels: list[tuple[int, DataFrame]], fanout: int, rows: int) -> list[DataFrame]:
    """From each node (tree, height, pos) to its parent, with the siblings on both sides."""
    out = []
    for height, parents in levels:
        kids = F.posexplode("kids").alias("j", "own")
        siblings = lambda first, n: _joined(F.slice("kids", first, n))
        out.append(
            parents.select("tree", "pos", "weight", "n", "digest", "kids", kids).select(
                "tree", F.lit(height - 1).alias("height"), (F.col("pos") * fanout + F.col("j")).alias("pos"), siblings(F.lit(1), F.col("j")).alias("before"), siblings(F.col("j") + 2, F.size("kids")).alias("after"),
                F.lit(True).alias("hashed"), F.col("tree").alias("parent_tree"), F.lit(height).alias("parent_height"), F.col("pos").alias("parent_pos"), _salts(F.col("weight"), rows).alias("parent_salts"), F.lit(None).cast("binary").alias("subroot"),
            )
        )
    return out


def build(leaves: DataFrame, fanout: int = FANOUT, rows: int = ROWS) -> Manifest:
    """The manifest of leaves (doc_id, tree, leaf, presented).

    A tree's leaves go by doc_id (NULL first), rows of one id by their digests. A lone leaf
    is its subroot itself, and a lone subroot the root. ``presented`` is the digest that
    is folded on the way up instead of the leaf's own; where NULL it is the leaf's.
    """
    given = leaves.select("doc_id", "tree", "leaf", F.coalesce("presented", "leaf").alias("presented"))
    placed = _numbered(materialize(given, "leaves"), ["doc_id", "leaf", "presented"], "leaves-in-order")
    members = F.sort_array(F.collect_list(F.struct("pos", "doc_id", "leaf", "presented")))
    grouped = placed.groupBy("tree", F.floor(F.col("pos") / fanout).alias("pos")).agg(members.alias("members"), F.max("n").alias("leaves"))
    hashed = grouped.withColumn("digest", F.when(F.col("leaves") == 1, F.col("members")[0]["leaf"]).otherwise(hash_of(_joined(F.col("members.leaf")))))

    def fold(m: Column) -> Column:
        """The run's hash with this member's presented digest in its place."""
        others = F.transform("members", lambda x: F.when(x["pos"] == m["pos"], x["presented"]).otherwise(x["leaf"]))
        return F.when(F.col("leaves") == 1, m["presented"]).when(m["presented"] == m["leaf"], F.col("digest")).otherwise(hash_of(_joined(others)))

    folds = hashed.withColumn("folds", F.transform("members", fold))
    runs = folds.select(
        F.monotonically_increasing_id().alias("run"), "tree", "pos", "digest", F.ceil(F.col("leaves") / fanout).cast("long").alias("n"), F.lit(1).cast("long").alias("weight"),
        F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"))).alias("members"),
        F.array_distinct("folds").alias("folded"), F.transform("folds", lambda f: F.array_position(F.array_distinct("folds"), f).cast("int")).alias("which"),
    )
    runs = materialize(runs, "runs")

    levels = _levels(runs.select("tree", "pos", "digest", "weight", "n"), 1, fanout)
    subroots = reduce(DataFrame.union, [t.where("n = 1").select("tree", "digest", "weight", F.lit(h).alias("own_height")) for h, t in [(1, runs), *levels]])
    ranked = materialize(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("own"), "digest", "weight", "own_height"), "subroots")
    ranked = materialize(_numbered(ranked, ["own"], "subroots-in-order"), "ranked-subroots")
    top = _levels(ranked.select("tree", "pos", "digest", "weight", "n"), 0, fanout)

    # A subroot is also a node of the tree above: it goes on there without a hash.
    none = F.lit(b"").cast("binary")
    across = ranked.select(
        F.col("own").alias("tree"), F.col("own_height").alias("height"), F.lit(0).cast("long").alias("pos"), none.alias("before"), none.alias("after"), F.lit(False).alias("hashed"),
        F.col("tree").alias("parent_tree"), F.lit(0).alias("parent_height"), F.col("pos").alias("parent_pos"), _salts(F.col("weight"), rows).alias("parent_salts"), F.col("digest").alias("subroot"),
    )
    links = reduce(DataFrame.union, [*_links(levels, fanout, rows), across, *_links(top, fanout, rows)])
    # A row for every salt of the node: as many as its own children's rows say.
    weights = [t.select("tree", F.lit(h).alias("height"), "pos", "weight") for h, t in [(1, runs), *levels, (0, ranked), *top]]
    salted = links.join(reduce(DataFrame.union, weights), ["tree", "height", "pos"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts(F.col("weight"), rows) - 1)))
    head = (top[-1][1] if top else ranked).where("n = 1").select("digest").first()
    return Manifest(runs, materialize(salted.drop("weight"), "links"), bytes(head["digest"]) if head else None, len(top))


def climb(manifest: Manifest) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof, folded_root, verified.

    Digests are binary; ``proof`` has those of all siblings from the leaf's run to the
    root, left to right. ``folded_root`` is what the presented leaf and the proof give,
    and ``verified`` says whether that is the root.
    """
    spark = manifest.runs.sparkSession
    reached = spark.sql(
        """
        WITH RECURSIVE climb AS (
          SELECT run, tree, 1 AS height, pos, CAST(1 AS BIGINT) AS salts, folded, CAST('' AS BINARY) AS proof, CAST(NULL AS BINARY) AS subroot FROM {runs}
          UNION ALL
          SELECT c.run, l.parent_tree, l.parent_height, l.parent_pos, l.parent_salts,
            IF(l.hashed, transform(c.folded, f -> unhex(sha2(CAST(lower(hex(concat(l.before, f, l.after))) AS BINARY), 256))), c.folded),
            concat(c.proof, l.before, l.after), coalesce(c.subroot, l.subroot)
          FROM climb c JOIN {links} l ON l.tree = c.tree AND l.height = c.height AND l.pos = c.pos AND l.salt = pmod(c.run, c.salts)
        )
        SELECT run, folded, proof, subroot FROM climb WHERE tree = {top} AND height = {height} LIMIT ALL
        """,
        runs=manifest.runs, links=manifest.links, top=TOP, height=manifest.height,
    )
    reached = materialize(reached, "climbed")
    root = F.lit(manifest.root).cast("binary")
    others = F.filter("members.leaf", lambda x, k: k != F.col("j"))
    member = F.posexplode(F.arrays_zip(F.col("members.doc_id").alias("doc_id"), F.col("members.leaf").alias("leaf"), F.col("which"))).alias("j", "m")
    rows = manifest.runs.select("run", "members", "which").join(reached, "run").select("members", "folded", "proof", "subroot", member)
    folded = F.element_at("folded", F.col("m")["which"])
    return rows.select(
        F.col("m")["doc_id"].alias("doc_id"), F.col("m")["leaf"].alias("leaf"), "subroot", root.alias("root"), F.concat(_joined(others), F.col("proof")).alias("proof"),
        folded.alias("folded_root"), (folded == root).alias("verified"),
    )


def manifest_rows(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_column: str = "lang", presented: dict[str, Column] | None = None, fanout: int = FANOUT, rows: int = ROWS) -> DataFrame:
    """Build the manifest of a table and check a version of it against the root.

    The first of ``fields`` is the id. ``presented`` has columns of ``docs`` to put in
    the place of fields in the version that is checked; without it that is the table
    itself. The result is ``climb``'s, a row for each row of ``docs``: rows that repeat
    an id are leaves of their own, NULLs in any field are told from empty values, NULL
    groups are a group, and texts are hashed whole. No rows give no rows; other
    columns are ignored.
    """
    altered = presented or {}
    leaf, shown = leaf_digest(*map(F.col, fields)), leaf_digest(*[altered.get(f, F.col(f)) for f in fields])
    leaves = docs.select(F.col(fields[0]).alias("doc_id"), tree_name(F.col(group_column)).alias("tree"), leaf.alias("leaf"), (shown if altered else leaf).alias("presented"))
    return climb(build(leaves, fanout, rows))
