"""Prefix trie of conversations from a global sort.

Each conversation becomes one path: a 32-byte code a turn, so that paths in byte order have equal prefixes side by
side. Paths are sorted by range over all partitions, equal ones by conv_id, which also splits large groups of copies.
In each partition a sweep keeps a stack of open nodes: the longest common prefix with the next path says which nodes
close. What stays open at a partition's ends are the prefixes of its first and of its last path; these two spines are
a row a partition, and neighbours' spines are stitched in a tree of small groups: shared prefixes add up, the others
close. A conversation is one row of 40 bytes a turn; turns reach the sort without their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

CODE = 32
FAN_IN = 16
FAMILY = 20
NODE = "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends_open boolean"
_NODE = [c.split()[0] for c in NODE.split(", ")]
_NODE_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_()]
EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family."""
    return zlib.crc32(b"%d" % conv_id) % 4


def turns(conversations: DataFrame) -> DataFrame:
    """family, conv_id, turn, code, words: a row a turn, its text as a hash; rows without a conv_id are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    own = F.col("conv_id").cast("long")
    return conversations.filter("conv_id IS NOT NULL").select((own - own % FAMILY).alias("family"), own.alias("conv_id"), F.col("turn"), code.alias("code"), words.cast("long").alias("words"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, path, words of each conversation, rebuilt, from turns sorted by family and conv_id, the family's own first."""
    family, head, conv, codes, words = None, [], None, [], []
    out: list[tuple] = []

    def close() -> None:
        nonlocal head
        if conv is None:
            return
        if conv == family:
            head = list(zip(codes[:3], words[:3]))
        h = shared_turns(conv)
        path, count = [c for c, _ in head[:h]] + codes[h:], [w for _, w in head[:h]] + words[h:]
        out.append((conv, b"".join(path), np.array(count, np.int64).tobytes()))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["conv_id", "path", "words"])

    for batch in batches:
        code = batch.column("code")
        for i, (f, c, w) in enumerate(zip(batch.column("family").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("words").to_pylist())):
            if c != conv:
                close()
                if f != family:
                    family, head = f, []
                conv, codes, words = c, [], []
            codes.append(code[i].as_buffer().to_pybytes())
            words.append(w)
        if out:
            yield batch_of()
            out = []
    close()
    if out:
        yield batch_of()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words: every conversation with its family's first turns. One shuffle, by family; turns are then streamed in order."""
    rows = turns(conversations).repartition("family")
    first = (F.col("conv_id") != F.col("family")).cast("int")
    rows = rows.withColumn("first", first).sortWithinPartitions("family", "first", "conv_id", F.col("turn").asc_nulls_first(), "code")
    return rows.select("family", "conv_id", "code", "words").mapInArrow(_paths, "conv_id long, path binary, words binary")


def common_turns(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, in turns."""
    n = min(len(a), len(b)) // CODE
    if a[: n * CODE] == b[: n * CODE]:
        return n
    x, y = (np.frombuffer(v, np.uint8, n * CODE) for v in (a, b))
    return int(np.argmax(x != y)) // CODE


@dataclass
class Node:
    """An open node. ends: conv_ids that end here and may go on in a neighbouring partition, else their hash in digest."""

    key: bytes
    words: int
    conv_id: int
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    digest: str = EMPTY
    split: bool = False  # its ends are hashed afterwards, over all partitions

    def add(self, other: Node) -> None:
        """Counts of the same node, as met in a later partition."""
        self.conv_id = min(self.conv_id, other.conv_id)
        self.n += other.n
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        if self.digest == EMPTY:
            self.digest = other.digest
        self.split |= other.split

    def row(self, parent: bytes | None, depth: int) -> tuple:
        return self.key, parent, self.conv_id, depth, self.n, self.children, self.leaves, self.saved, None if self.split else self.digest, self.split


def close_child(parent: Node | None, node: Node, depth: int, out: list[tuple]) -> None:
    """Everything below node is known: write it and count it in its parent, whose key it is given."""
    node.leaves = node.leaves or 1
    node.saved += (node.n - 1) * node.words
    out.append(node.row(parent.key if parent else None, depth))
    if parent:
        parent.children += 1
        parent.leaves += node.leaves
        parent.saved += node.saved


def child_key(parent: bytes, code: bytes) -> bytes:
    """A name for a prefix that is the same in every partition."""
    return hashlib.sha256(parent + code).digest()[:16]


ROOT = b"\0" * 16


@dataclass
class Spine:
    """What is open of a run of neighbouring paths: prefixes of the first path, of the last, and of both (depth up to common)."""

    first: bytes
    last: bytes
    common: int
    left: list[Node] = field(default_factory=list)  # by depth, from 0 to the first path's length
    right: list[Node] = field(default_factory=list)  # by depth, from common + 1 to the last path's length

    def at_right(self, depth: int) -> Node:
        return self.left[depth] if depth <= self.common else self.right[depth - self.common - 1]


def stitch(a: Spine, b: Spine, out: list[tuple]) -> Spine:
    """The spine of a's paths followed by b's; nodes that can get no more members are written to out."""
    both = common_turns(a.last, b.first)
    for depth in range(len(a.last) // CODE, max(a.common, both), -1):  # a's right side beyond what b goes on with
        close_child(a.at_right(depth - 1), a.at_right(depth), depth, out)
    for depth in range(len(b.first) // CODE, max(b.common, both), -1):  # b's left side beyond what a began
        close_child(b.left[depth - 1], b.left[depth], depth, out)
    for depth in range(both + 1):
        a.at_right(depth).add(b.left[depth])
    for depth in range(both, max(a.common, b.common), -1):  # what they share, but neither end of the whole
        close_child(a.at_right(depth - 1), a.at_right(depth), depth, out)
    common, joined = min(a.common, both, b.common), min(both, b.common)
    # The right side of the whole: a's nodes, with b's counts, as far as b's last path shares them; below, b's own.
    right = [a.at_right(d) if d <= joined else b.at_right(d) for d in range(common + 1, len(b.last) // CODE + 1)]
    return Spine(a.first, b.last, common, a.left, right)


def finish(spine: Spine, out: list[tuple]) -> None:
    """Close what is open once no neighbours are left; the root comes last."""
    for depth in range(len(spine.last) // CODE, spine.common, -1):
        close_child(spine.at_right(depth - 1), spine.at_right(depth), depth, out)
    for depth in range(len(spine.first) // CODE, -1, -1):
        close_child(spine.left[depth - 1] if depth else None, spine.left[depth], depth, out)


def _ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(b",".join([b"%d" % i for i in ids])).hexdigest()


class Sweep:
    """The stack of a partition's sorted paths."""

    def __init__(self) -> None:
        self.first: bytes | None = None
        self.last = b""
        self.stack: list[Node] = []
        self.side: list[Node] = []  # the first path's nodes that left the stack, from the deepest
        self.common = 0  # depth down to which the stack holds prefixes of the first path
        self.ends: list[int] = []  # conv_ids of the path on top
        self.fragments: list[tuple[bytes, list[int]]] = []

    def _close_ends(self, last: bool = False) -> None:
        """The conversations that end at the top of the stack are all seen, unless a neighbour has some: those of the first and the last path."""
        if self.ends:
            top = self.stack[-1]
            if last or self.last == self.first:
                top.split = True
                self.fragments.append((top.key, self.ends))
            else:
                top.digest = _ends_hash(self.ends)
        self.ends = []

    def add(self, conv_id: int, path: bytes, words: np.ndarray, out: list[tuple]) -> None:
        n = len(path) // CODE
        if self.first is None:
            self.first, shared, self.common = path, -1, n
        else:
            shared = common_turns(self.last, path)
            if path != self.last:
                self._close_ends()
            while len(self.stack) - 1 > shared:
                depth = len(self.stack) - 1
                node = self.stack.pop()
                if depth <= self.common:
                    self.side.append(node)
                else:
                    close_child(self.stack[-1], node, depth, out)
            self.common = min(self.common, shared)
        for depth in range(shared + 1, n + 1):
            key = child_key(self.stack[-1].key, path[(depth - 1) * CODE : depth * CODE]) if depth else ROOT
            self.stack.append(Node(key, int(words[depth - 1]) if depth else 0, conv_id))
        for node in self.stack:
            node.n += 1
            node.conv_id = min(node.conv_id, conv_id)
        self.ends.append(conv_id)
        self.last = path

    def spine(self) -> Spine | None:
        if self.first is None:
            return None
        self._close_ends(last=True)
        return Spine(self.first, self.last, self.common, [*self.stack[: self.common + 1], *reversed(self.side)], self.stack[self.common + 1 :])


def _pack(nodes: list[Node]) -> tuple[bytes, bytes, list[str], list[bool]]:
    return b"".join([x.key for x in nodes]), np.array([(x.words, x.conv_id, x.n, x.children, x.leaves, x.saved) for x in nodes], np.int64).tobytes(), [x.digest for x in nodes], [x.split for x in nodes]


def _unpack(keys: bytes, numbers: bytes, digests, splits) -> list[Node]:
    table = np.frombuffer(numbers, np.int64).reshape(-1, 6).tolist()
    return [Node(keys[16 * i : 16 * i + 16], *row, digest=digests[i], split=bool(splits[i])) for i, row in enumerate(table)]


SIDE = ", ".join(f"{s}_keys binary, {s}_numbers binary, {s}_digests array<string>, {s}_splits array<boolean>" for s in ("left", "right"))
OPEN = f"part long, first binary, last binary, common int, {SIDE}"
_OPEN = [c.split()[0] for c in OPEN.split(", ")]
_OPEN_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.bool_())] * 2]
FRAGMENT = "ends_key binary, ends_at int, ends binary"
ROW = f"{NODE}, {OPEN}, {FRAGMENT}"
_FRAGMENT_KINDS = [pa.binary(), pa.int32(), pa.binary()]


def _open_row(part: int, s: Spine) -> tuple:
    return part, s.first, s.last, s.common, *_pack(s.left), *_pack(s.right)


def _spine_of(r) -> Spine:
    return Spine(r["first"], r["last"], int(r["common"]), *[_unpack(r[f"{s}_keys"], r[f"{s}_numbers"], r[f"{s}_digests"], r[f"{s}_splits"]) for s in ("left", "right")])


def _rows(nodes: list[tuple], opened: list[tuple], fragments: list[tuple]) -> pa.RecordBatch:
    a, b, c = len(_NODE_KINDS), len(_OPEN_KINDS), len(_FRAGMENT_KINDS)
    rows = [(*r, *[None] * (b + c)) for r in nodes] + [(*[None] * a, *r, *[None] * c) for r in opened] + [(*[None] * (a + b), *r) for r in fragments]
    kinds = [*_NODE_KINDS, *_OPEN_KINDS, *_FRAGMENT_KINDS]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], [f.split()[0] for f in ROW.split(", ")])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of closed nodes, of conv_ids whose hash spans partitions, and of the partition's spine."""
    from pyspark import TaskContext

    part, sweep = TaskContext.get().partitionId(), Sweep()
    for batch in batches:
        out: list[tuple] = []
        paths, words = batch.column("path"), batch.column("words")
        for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
            sweep.add(conv_id, paths[i].as_buffer().to_pybytes(), np.frombuffer(words[i].as_buffer(), np.int64), out)
            if len(out) > 20000:
                yield _rows(out, [], [])
                out = []
        yield _rows(out, [], [])
    spine = sweep.spine()
    if spine is not None:
        # The first path's group comes before the last one's.
        fragments = [(key, part, b",".join([b"%d" % c for c in ids])) for key, ids in sweep.fragments]
        yield _rows([], [_open_row(part, spine)], fragments)


def _stitch_group(last: bool):
    names = [*_NODE, *_OPEN]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        spine, part = None, int(pdf["part"].min())
        for _, r in pdf.sort_values("part").iterrows():
            spine = _spine_of(r) if spine is None else stitch(spine, _spine_of(r), out)
        if last:
            finish(spine, out)
        rows = [(*r, *[None] * len(_OPEN)) for r in out] + ([] if last else [(*[None] * len(_NODE), *_open_row(part, spine))])
        return pd.DataFrame(rows, columns=names, dtype=object)

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a key over its fragments, which come in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column(0), batch.column(1)):
            k = k.as_py()
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield _hashes(done)
    if key is not None:
        yield _hashes([(key, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 2
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["split_key", "split_sha256"])


def prefix_trie(conversations: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each distinct prefix of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns of equal number by a hash of role and text. A null role or text is
    empty; repeated rows are turns of their own; rows without a conv_id are left out, and other columns are not read. A
    conversation is there as soon as it has a row, even if no turn is left of it once it is rebuilt: it then ends at
    the root. An empty table gives no rows.
    """
    paths = rebuilt(conversations)
    order: list[Column] = [F.col("path"), F.col("conv_id")]
    swept = checkpoint(paths.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_sweep, ROW))
    nodes = swept.filter("key IS NOT NULL").select(*_NODE)
    opened = swept.filter("part IS NOT NULL").select(*_OPEN)
    left = opened.count()
    width = 1
    while left:
        width *= fan_in
        last = opened.filter(F.col("part") >= width).isEmpty()
        merged = opened.groupBy(F.floor(F.col("part") / width).alias("group")).applyInPandas(_stitch_group(last), f"{NODE}, {OPEN}")
        merged = checkpoint(merged)
        nodes = nodes.unionByName(merged.filter("key IS NOT NULL").select(*_NODE))
        opened = merged.filter("part IS NOT NULL").select(*_OPEN)
        left = 0 if last else opened.count()
    fragments = swept.filter("ends_key IS NOT NULL").select("ends_key", "ends_at", "ends")
    # The first and the last path of a partition may be the same; then there is one fragment.
    hashes = fragments.repartition("ends_key").sortWithinPartitions("ends_key", "ends_at").select("ends_key", "ends").mapInArrow(_hash_ends, "split_key binary, split_sha256 string")
    nodes = nodes.join(hashes, nodes.key == hashes.split_key, "left")
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, nodes.parent_key == parents.p, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("split_sha256", "ends_sha256").alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
