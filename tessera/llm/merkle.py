"""A Merkle manifest of a dataset, built and verified by supersteps of messages along a tree.

Rows are the leaves. Those of one group (a source) form a tree in which every run of FAN neighbours has a parent; the
trees' tops, in the order of the groups, form another. In a superstep each node sends its digest to its parent; a parent
that has heard of all its children hashes them and is a node of the next one. Then the reverse: from the top down,
each parent sends every child the digests of its siblings with all that it got itself, until each leaf's neighbours
hold the path to the root, and a leaf can be verified with nothing else.

A node is (tree, index); a tree is named by the place of its first leaf in the whole order, so a node covers a stretch of
places, and nodes are dealt to partitions in turn by it: a large group is spread over all. A message upward is one digest;
the last ones downward go to the parents of leaves, who hold these, so a path is sent once for FAN leaves.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import quoted, stage

FAN = 16
#: Messages of one partition, about: fewer partitions deal the few nodes near a top.
MESSAGES = 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place: int, siblings: array<string>>>"
#: A level of a path: the node's place in its run, and the digests of the run's other nodes.
Step = tuple[int, list[bytes]]


def digest(parts: Sequence[bytes]) -> bytes:
    """SHA-256 of digests joined as lowercase hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256, as bytes, of the fields one after the other: - if null, else the number of bytes as UTF-8, a colon and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, fields)), 256))


def tampered(id_: str = "doc_id", text: str = "text") -> Column:
    """Whether the contract's tampering changes a row's text, and to what: A-Z lower-cased where 5 divides the CRC-32 of the id; else as it is."""
    hit = F.crc32(F.col(quoted(id_)).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(F.col(quoted(text)), string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col(quoted(text)))


def folded(own: bytes, path: Sequence[Step]) -> bytes:
    """The root that a leaf gives with the siblings of its path."""
    for place, siblings in path:
        own = digest([*siblings[:place], own, *siblings[place:]])
    return own


def parents(size: int, fan: int) -> int:
    return -(-size // fan)


def levels(size: int, fan: int) -> int:
    """Steps from a leaf to the top of its tree; a lone leaf is its own parent, without a hash."""
    n, size = 1, parents(size, fan)
    while size > 1:
        n, size = n + 1, parents(size, fan)
    return n


def placed(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """df staged in order, nulls first, with _place from 0, one after the other over all rows.

    Ranges of the order are sorted in a task each; the rows of each range are counted where they have been written.
    What the driver holds is one number for each range.
    """
    spark = df.sparkSession
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), label)
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r._part, r.n) for r in rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect())
    before = zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0))  # noqa: B905
    known = spark.createDataFrame(list(before), "_part long, _before long")
    return rows.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn("_place", F.col("_before") + at).drop("_part", "_before", "_at")


def _inbox(messages: RDD, parts: int, stretch: int) -> tuple[RDD, int, Callable]:
    """Messages ((tree, index), ...) dealt in turn by the stretch of places that the receiver covers."""
    deal = lambda key: key[0] // stretch + key[1]
    return messages.partitionBy(parts, deal), parts, deal


def children(key: tuple, heard: Iterable[tuple], fan: int) -> list[tuple]:
    """What a parent has heard, in order: (place, size, digest, held) of each child; all of them are there."""
    found = sorted(heard, key=lambda m: m[0])
    due = min(fan, found[0][1] - key[1] * fan)
    if [m[0] for m in found] != list(range(due)):
        raise RuntimeError(f"node {key} has heard of {len(found)} of {due} children")
    return found


def sent_up(node: tuple, fan: int) -> tuple:
    """The message of a node to its parent."""
    (tree, index), size, own, held = node
    return (tree, index // fan), (index % fan, size, own, held)


def completed(heard: tuple, fan: int) -> tuple:
    """A parent as a node of the next level. A tree of one leaf has that leaf as its top."""
    key, found = heard[0], children(*heard, fan)
    size = found[0][1]
    return key, parents(size, fan), found[0][2] if size == 1 else digest([m[2] for m in found]), None


def sent_down(heard: tuple, fan: int) -> Iterator[tuple]:
    """The messages of a parent to its children: (tree, index), (held, digest, path, what came along). What it got itself has -1 as its place."""
    key, messages = heard[0], list(heard[1])
    [(path, along)] = [m[1] for m in messages if m[0] < 0]
    found = children(key, (m for m in messages if m[0] >= 0), fan)
    own = [m[2] for m in found]
    for i, (_, size, _, held) in enumerate(found):
        step = [(i, own[:i] + own[i + 1 :])] if size > 1 else []
        yield (key[0], key[1] * fan + i), (held, own[i], step + path, along)


class Tree:
    """Supersteps over trees of one height at most. leaves: ((tree, index), size of the tree, digest, whatever is to be found again)."""

    def __init__(self, leaves: RDD, height: int, places: int, fan: int, most: int):
        self.fan, self.height, self.inboxes, self.tops = fan, height, [], []
        for level in range(1, height + 1):
            parts = max(1, min(most, places // fan ** (level - 1) // MESSAGES + 1))
            messages, _, deal = inbox = _inbox(leaves.map(lambda n: sent_up(n, fan)), parts, fan**level)
            self.inboxes.append(inbox)
            nodes = messages.groupByKey(parts, deal).map(lambda heard: completed(heard, fan))
            self.tops.append(nodes.filter(lambda n: n[1] == 1).map(lambda n, level=level: (n[0][0], n[2], level)))
            leaves = nodes.filter(lambda n: n[1] > 1)

    def subroots(self) -> RDD:
        """The top of each tree: tree, digest, level."""
        return self.tops[0].context.union(self.tops)

    def down(self, tops: RDD) -> RDD:
        """tops: (tree, (level, (path, what comes along))). To the leaves: (what is held, digest, path, what came along)."""
        fan, come = self.fan, None
        for level in range(self.height, 0, -1):
            messages, parts, deal = self.inboxes[level - 1]
            here = tops.filter(lambda t, level=level: t[1][0] == level).map(lambda t: ((t[0], 0), (-1, t[1][1])))
            come = here if come is None else here.union(come.map(lambda m: (m[0], (-1, m[1][2:]))))
            come = messages.union(come.partitionBy(parts, deal)).groupByKey(parts, deal).flatMap(lambda heard: sent_down(heard, fan))
        return come.map(lambda m: m[1])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, by: str = "source", id_: str = "doc_id", now: dict[str, Column] | None = None, fan: int = FAN, paths: bool = False) -> DataFrame:
    """A row for each of docs, in no order: the id, and

    * leaf, subroot, root, proof_sha256: its digest, that of its group's tree and of all, and that of its siblings from its
      own run upward, left to right, joined; lowercase hex;
    * folded_root, verified: the root that the row gives with these siblings as it is now, and whether it is the same. now has
      the fields that differ now, as expressions on docs; without it every row is verified as it was;
    * with paths, proof: for each level the row's place in its run and its siblings, which root_of() folds.

    Within a group rows are ordered by id, null first, then by digest; rows equal in every field are neighbours and have a
    leaf each. A null group is one like any other, the first. A group of one row has that row's leaf as its subroot, and
    with one group its subroot is the root; nobody's siblings are the hash of nothing. Null fields differ from empty
    ones. Texts may be of any length; they are read once, and only digests move. No rows give no rows. Other columns
    aren't looked at.
    """
    spark = docs.sparkSession
    col = lambda name: F.col(quoted(name))
    was = leaf([col(c) for c in fields])
    is_ = leaf([(now or {}).get(c, col(c)) for c in fields])
    changed = F.lit(False)
    for c, value in (now or {}).items():
        changed = changed | ~value.cast("string").eqNullSafe(col(c).cast("string"))
    rows = docs.select(col(id_).alias("_id"), col(by).cast("string").alias("_by"), was.alias("_leaf"), F.when(changed, is_).alias("_now"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    rows = placed(rows, ["_by", "_id", "_leaf", "_row"], "placed")
    groups = placed(rows.groupBy("_by").agg(F.min("_place").alias("_tree"), F.count("*").alias("_size")).withColumnRenamed("_by", "_g"), ["_tree"], "groups").withColumnRenamed("_place", "_nth")
    total = groups.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("rows"), F.max("_size").alias("largest"), F.count("*").alias("groups")).head()
    fields_out = f"{quoted(id_)} {docs.schema[id_].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if paths:
        fields_out += f", proof {PROOF}"
    if not total.rows:
        return spark.createDataFrame([], fields_out)
    known = rows.join(groups.select("_g", "_tree", "_size"), F.col("_by").eqNullSafe(F.col("_g")))
    leaves = known.select("_tree", (F.col("_place") - F.col("_tree")).alias("_index"), "_size", "_leaf", "_id", "_now").rdd
    leaves = leaves.map(lambda r: ((r[0], r[1]), r[2], bytes(r[3]), (r[4], r[5] and bytes(r[5]))))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total.rows // (5 * MESSAGES))
    trees = Tree(leaves, levels(total.largest, fan), total.rows, fan, most)
    # The tops' tree: its leaves are the tops in the order of the groups, and hold which tree they are the top of.
    nth = groups.select("_tree", "_nth").rdd.map(lambda r: (r[0], r[1]))
    tops = trees.subroots().map(lambda t: (t[0], t[1:])).join(nth, max(1, min(most, total.groups // MESSAGES + 1)))
    n = total.groups
    roots = Tree(tops.map(lambda t: ((0, t[1][1]), n, t[1][0][0], (t[0], t[1][0][1]))), levels(n, fan), n, fan, most)
    whole = roots.subroots().map(lambda t: (t[0], (t[2], ([], (t[1],)))))
    reached = roots.down(whole).map(lambda m: (m[0][0], (m[0][1], (m[2], (m[1], *m[3])))))

    def row(m: tuple) -> tuple:
        (i, current), own, path, (subroot, root) = m
        found = folded(own if current is None else current, path)
        proof = hashlib.sha256("".join(s.hex() for _, siblings in path for s in siblings).encode()).hexdigest()
        out = (i, own.hex(), subroot.hex(), root.hex(), proof, found.hex(), found == root)
        return (*out, [(place, [s.hex() for s in siblings]) for place, siblings in path]) if paths else out

    return spark.createDataFrame(trees.down(reached).map(row), fields_out, verifySchema=False)


def root_of(own: str, proof: Sequence[tuple[int, Sequence[str]]]) -> str:
    """The root that a leaf gives with its proof, as a manifest with paths has it: compare it with a root that is trusted."""
    return folded(bytes.fromhex(own), [(place, [bytes.fromhex(s) for s in siblings]) for place, siblings in proof]).hex()
