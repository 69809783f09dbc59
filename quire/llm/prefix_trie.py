"""The trie of all conversation prefixes, from padded turn-id matrices.

A turn is a 128-bit digest of its role and text; texts never move. A conversation is a sequence of
digests, cut in bands of ``band`` turns, so that a conversation of any length is many bounded rows.
Equal rows are one row with a count: copies cost nothing and cannot make a shard hot. The rows of a
band are dealt to shards by ranges of their digests. In a shard, digests become dense numbers in a
matrix that is padded and sorted column block by column block (``numpy.lexsort``); differences to
the row above, OR-accumulated along the columns, mark where a node starts, and ``reduceat`` sums the
rows of every node of every depth.

Only the nodes on the path of a shard's first or last row can have members in other shards. A shard
passes these two paths on, with what it knows of each of their nodes, as rows of the same form; they
are dealt to shards again, far fewer, until one shard holds them all. So no node is ever gathered in
one place. Bands are done from the deepest up: the totals below a prefix become numbers of the row
that ends with it. A prefix that only one conversation has needs no trie below.

The identity of a node is a 128-bit sum over its turns of a mix of digest and place, so prefixes of
any length are summed in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.prefix import running_sum
from quire.llm.text import mix
from quire.session import settle

BAND = 512
COLUMNS = 16
SHARD_BYTES = 32 << 20
ENDS_BITS = 8
SALTS = 16
NONE = np.iinfo(np.int64).max
SUMS = ("n", "kids", "leaves", "saved")
_NODE = "depth long, a long, b long, ua long, ub long, conv long, parent long, n long, kids long, leaves long, saved long"
_PATH = "pa long, pb long, key binary, sizes binary, held binary"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def coded_turns(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, pos, digest, size) of every turn: its 0-based place in its conversation and the UTF-8 bytes of its text.

    Turns are ordered by ``order``, null first, equal ones by digest. Null roles and texts are empty;
    rows without a conversation id are left out. Places come from one sort by range and the sizes of
    the stretches of each conversation, so a conversation may hold any share of the rows.
    """
    role, text = (F.coalesce(turns[f"`{c}`"].cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        turns[f"`{conv}`"].cast("long").alias("conv"), turns[f"`{order}`"].alias("at"),
        F.unhex(F.md5(whole.cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    ).where("conv is not null")
    by = ["conv", F.col("at").asc_nulls_first(), "digest"]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("at")
    rows = settle(rows.withColumn("id", F.monotonically_increasing_id()), "trie-turns")
    stretch = F.shiftright("id", 33).alias("stretch")
    runs = rows.groupBy("conv", stretch).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "stretch", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.withColumn("stretch", stretch).join(runs, ["conv", "stretch"]).select(
        "conv", (F.col("id") + F.col("shift")).alias("pos"), "digest", "size"
    )


def rebuilt(coded: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first of their ``group``, and the list of all of them (conv).

    Conversation c gets the first h turns of c - c % group, then its own behind its first h;
    h is crc32 of the decimal c, modulo ``heads``.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    lengths = coded.groupBy("conv").agg((F.max("pos") + 1).alias("n"))
    base = (F.col("conv") - F.col("conv") % group).alias("base")
    first = lengths.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = settle(
        lengths.select("conv", base, h).join(first, "base", "left")
        .select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")),
        "trie-plan",
    )
    opening = coded.where((F.col("conv") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv", "base")
    shared = plan.join(opening, "base").where("pos < h").select("conv", "pos", "digest", "size")
    own = coded.join(plan, "conv").where("pos >= h").select("conv", (F.expr("pos - h + taken")).alias("pos"), "digest", "size")
    return shared.unionByName(own), plan.select("conv")


def _mixed(high: np.ndarray, low: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit summands of turns for the identity of the nodes they end."""
    place = place.astype(np.uint64)
    return mix(mix(high + place * _GOLD) ^ low), mix(mix(low + place * _ODD) + high)


def _halves(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2) if len(data) else np.zeros((0, 2), np.uint64)
    return both[:, 0], both[:, 1]


def _packed(turns: DataFrame, convs: DataFrame, band: int) -> DataFrame:
    """(conv, seg, key, sizes, a, b): the digests of each band of each conversation, and their identity summands added up."""
    marks = convs.select("conv", F.lit(0).cast("long").alias("seg"), F.lit(None).cast("struct<pos: long, digest: binary, size: long>").alias("t"))
    cells = turns.select("conv", F.floor(F.col("pos") / band).alias("seg"), F.struct("pos", "digest", "size").alias("t")).unionByName(marks)
    rows = cells.groupBy("conv", "seg").agg(F.array_sort(F.collect_list("t")).alias("t"))  # at most ``band`` turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            turns = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            offsets = offsets - offsets[0]
            data = b"".join(turns.field("digest").to_pylist())
            sizes = turns.field("size").to_numpy(zero_copy_only=False).astype("<i8")
            parts = _mixed(*_halves(data), turns.field("pos").to_numpy(zero_copy_only=False))
            sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(p)])[offsets]).view(np.int64) for p in parts]
            pairs = list(zip(offsets.tolist(), offsets[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv"), batch.column("seg"),
                    pa.array([data[16 * x : 16 * y] for x, y in pairs], pa.binary()),
                    pa.array([sizes[x:y].tobytes() for x, y in pairs], pa.binary()), *map(pa.array, sums),
                ],
                ["conv", "seg", "key", "sizes", "a", "b"],
            )

    return rows.mapInArrow(run, "conv long, seg long, key binary, sizes binary, a long, b long")


def _signed(total: Column) -> Column:
    """A decimal sum of 64-bit summands as the long that wrapping addition gives."""
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    rest = F.pmod(total.cast("decimal(38,0)"), number(1 << 64))
    return F.when(rest >= number(1 << 63), rest - number(1 << 64)).otherwise(rest).cast("long")


def _placed(packed: DataFrame) -> tuple[DataFrame, int, bool]:
    """Adds (pa, pb), the identity of the prefix before a band, (ea, eb), that at its end, and ``more``.

    Also returned: the deepest band with a shared prefix before it, and whether there is more than one band.
    """
    late = settle(packed.where("seg > 0").groupBy("conv").agg(F.max("seg").alias("last")), "trie-long")
    alone = packed.join(late, "conv", "left_anti").select(
        "*", F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"), F.col("a").alias("ea"), F.col("b").alias("eb"), F.lit(False).alias("more")
    )
    if late.isEmpty():
        return alone, 0, False
    rows = packed.join(late, "conv")
    for s in ("a", "b"):
        rows = running_sum(rows, ["conv"], "seg", F.col(s).cast("decimal(28,0)"), f"s{s}")
    rows = settle(
        rows.select(
            *packed.columns, *[_signed(F.col(f"s{s}") - F.col(s)).alias(f"p{s}") for s in "ab"],
            *[_signed(F.col(f"s{s}")).alias(f"e{s}") for s in "ab"], (F.col("seg") < F.col("last")).alias("more"),
        ),
        "trie-bands",
    )
    shared = rows.where("seg > 0").groupBy("seg", "pa", "pb").agg(F.count("*").alias("n")).where("n > 1")
    return alone.unionByName(rows), shared.agg(F.max("seg")).first()[0] or 0, True


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Dense numbers of rows of columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class _Shard:
    """Rows (prefix identity, digests, sizes, held numbers of every cell) and the nodes they make. Cell 0 of a row is its prefix."""

    def __init__(self, table: pa.Table):
        pairs = np.column_stack([table.column(c).to_numpy() for c in ("pa", "pb")])
        keys = table.column("key").to_pylist()
        self.turns = np.fromiter((len(k) // 16 for k in keys), np.int64, len(keys))
        self.begin = np.cumsum(self.turns + 1) - (self.turns + 1)
        self.cells = int((self.turns + 1).sum())
        self.inner = np.ones(self.cells, bool)
        self.inner[self.begin] = False
        data = b"".join(keys)
        high, low = _halves(data)
        seg = int(table.column("seg")[0].as_py())
        place = np.arange(self.cells) - np.repeat(self.begin, self.turns + 1) - 1
        self.start = seg * table.column("band")[0].as_py()
        self.code = np.zeros(self.cells, np.int64)
        self.code[self.begin] = _codes(pairs[:, 0], pairs[:, 1])
        self.code[self.inner] = _codes(high, low)
        self.size = np.zeros(self.cells, np.int64)
        self.size[self.inner] = np.frombuffer(b"".join(table.column("sizes").to_pylist()), "<i8")
        self.id = []
        for prefix, part in zip(pairs.T, _mixed(high, low, place[self.inner] + self.start)):
            steps = np.zeros(self.cells, np.uint64)
            steps[self.inner] = part
            total = np.cumsum(steps)
            self.id.append((total + np.repeat(prefix.astype(np.int64).view(np.uint64) - total[self.begin], self.turns + 1)).view(np.int64))
        self.pairs, self.keys, self.table = pairs, keys, table
        held = np.frombuffer(b"".join(table.column("held").to_pylist()), "<i8").reshape(-1, 5)
        self.held = {name: held[:, k] for k, name in enumerate((*SUMS, "conv"))}
        by = list(zip(*pairs.T.tolist(), keys))
        self.first, self.last = by.index(min(by)), by.index(max(by))
        self._mark()

    def _mark(self) -> None:
        """Number the nodes: by depth, then in the order of the rows."""
        self.node = np.full(self.cells, -1, np.int64)
        cells, cuts, self.levels, count = [], [], [], 0
        rows, group = np.arange(len(self.turns)), np.zeros(len(self.turns), np.int64)
        width = int(self.turns.max()) + 1
        for left in range(0, width, COLUMNS):
            stay = self.turns[rows] + 1 > left
            rows, group = rows[stay], group[stay]
            padded = np.full((len(rows), COLUMNS), -1, np.int64)
            for k in range(COLUMNS):
                has = self.turns[rows] + 1 > left + k
                padded[has, k] = self.code[self.begin[rows[has]] + left + k]
            order = np.lexsort((*padded.T[::-1], group))
            rows, group, padded = rows[order], group[order], padded[order]
            changed = np.ones((len(rows), COLUMNS + 1), bool)
            changed[1:, 0] = group[1:] != group[:-1]
            changed[1:, 1:] = padded[1:] != padded[:-1]
            changed = np.logical_or.accumulate(changed, axis=1)[:, 1:]
            for k in range(min(COLUMNS, width - left)):
                has = np.flatnonzero(padded[:, k] >= 0)
                at = self.begin[rows[has]] + left + k
                starts = np.flatnonzero(changed[has, k])
                self.node[at] = count + np.cumsum(changed[has, k]) - 1
                self.levels.append((count, count + len(starts)))
                cells.append(at)
                cuts.append((starts, at[starts]))
                count += len(starts)
                group[has] = self.node[at]
        self.count, self.by_level = count, list(zip(cells, cuts))

    def totals(self, open_: np.ndarray) -> dict[str, np.ndarray]:
        """Numbers of every node; an open node holds what is not on the open paths."""
        out = {name: np.zeros(self.count, np.int64) for name in SUMS} | {"conv": np.full(self.count, NONE)}
        self.top = np.empty(self.count, np.int64)  # the first cell of a node
        for (low, high), (cells, (starts, tops)) in zip(self.levels, self.by_level):
            self.top[low:high] = tops
            for name in SUMS:
                out[name][low:high] = np.add.reduceat(self.held[name][cells], starts)
            out["conv"][low:high] = np.minimum.reduceat(self.held["conv"][cells], starts)
        self.parent = np.full(self.count, -1, np.int64)
        deep = self.levels[0][1]
        self.parent[deep:] = self.node[self.top[deep:] - 1]
        for low, high in self.levels[:0:-1]:
            own = np.arange(low, high)[~open_[low:high]]
            out["leaves"][own] += out["kids"][own] == 0
            out["saved"][own] += (out["n"][own] - 1) * self.size[self.top[own]]
            if len(own):
                above = self.parent[own]
                starts = np.flatnonzero(np.diff(above, prepend=-1))
                above = above[starts]
                for name in ("n", "leaves", "saved"):
                    out[name][above] += np.add.reduceat(out[name][own], starts)
                out["kids"][above] += np.diff(np.append(starts, len(own)))
                out["conv"][above] = np.minimum(out["conv"][above], np.minimum.reduceat(out["conv"][own], starts))
        roots = np.flatnonzero(~open_[:deep])
        out["leaves"][roots] += out["kids"][roots] == 0
        return out

    def solved(self, final: bool) -> pa.Table:
        """All complete nodes, and the two open paths unless this is the last shard."""
        open_ = np.zeros(self.count, bool)
        ways = [] if final else list(dict.fromkeys([self.first, self.last]))
        for r in ways:
            open_[self.node[self.begin[r] : self.begin[r] + self.turns[r] + 1]] = True
        out = self.totals(open_)
        done = np.flatnonzero(~open_)
        up = self.parent[done]
        known = (up >= self.levels[0][1]) if self.start else up >= 0
        known &= ~open_[up]
        depth = np.searchsorted([high for _, high in self.levels], done, side="right") + self.start
        at = self.top[done]
        above = np.where(up >= 0, at - 1, at)
        columns = [depth, self.id[0][at], self.id[1][at], self.id[0][above], self.id[1][above], out["conv"][done]]
        columns = [pa.array(c) for c in columns] + [pa.array(np.where(known, out["conv"][up], 0), mask=~known)]
        columns += [pa.array(out[name][done]) for name in SUMS]
        names = [x.split()[0] for x in _NODE.split(", ")]
        table = pa.table(dict(zip(names, columns)))
        seen, rows = set(), []
        for r in ways:
            nodes = self.node[self.begin[r] : self.begin[r] + self.turns[r] + 1]
            held = np.column_stack([out[name][nodes] for name in (*SUMS, "conv")])
            held[[int(x) in seen for x in nodes]] = (0, 0, 0, 0, NONE)
            seen.update(nodes.tolist())
            rows.append({"pa": int(self.pairs[r, 0]), "pb": int(self.pairs[r, 1]), "key": self.keys[r], "sizes": self.table.column("sizes")[r].as_py(), "held": held.astype("<i8").tobytes()})
        kinds = {"pa": pa.int64(), "pb": pa.int64(), "key": pa.binary(), "sizes": pa.binary(), "held": pa.binary()}
        paths = pa.table({n: pa.array([x[n] for x in rows], k) for n, k in kinds.items()})
        return pa.concat_tables([table, paths], promote_options="default")


def _solve(rows: DataFrame, final: bool) -> DataFrame:
    """One shard for each partition of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            names = [x.split()[0] for x in f"{_NODE}, {_PATH}".split(", ")]
            yield from _Shard(pa.Table.from_batches(held)).solved(final).select(names).combine_chunks().to_batches()

    return rows.mapInArrow(run, f"{_NODE}, {_PATH}")


def _band(rows: DataFrame, seg: int, band: int, shard_bytes: int) -> DataFrame:
    """(nodes..., level) of one band; ``rows``: (pa, pb, key, sizes, held)."""
    found, level = [], 0
    while True:
        weight = rows.agg(F.sum(sum(F.octet_length(c).cast("long") for c in ("key", "sizes", "held")))).first()[0] or 0
        shards = int(weight // shard_bytes) + 1
        rows = rows.withColumns({"seg": F.lit(seg), "band": F.lit(band)})
        dealt = rows.repartitionByRange(shards, "pa", "pb", "key") if shards > 1 else rows.repartition(1)
        out = settle(_solve(dealt, shards == 1), "trie-nodes")
        found.append(out.where("key is null").select(*[x.split()[0] for x in _NODE.split(", ")], F.lit(level).alias("level")))
        if shards == 1:
            return reduce(DataFrame.unionByName, found)
        # Paths are at most two of each shard; shards grow, so that every round has far fewer.
        rows, level, shard_bytes = settle(out.where("key is not null").select("pa", "pb", "key", "sizes", "held"), "trie-paths"), level + 1, max(shard_bytes, 4096 * band)


def _with_cells(rows: DataFrame) -> DataFrame:
    """``held`` as five numbers a cell: all is known of the last cell of a row, nothing of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.array([0, 0, 0, 0, NONE], "<i8").tobytes()
        for batch in batches:
            last = np.column_stack([batch.column(c).to_numpy() for c in (*SUMS, "conv")]).astype("<i8")
            held = [nothing * (len(k) // 16) + last[r].tobytes() for r, k in enumerate(batch.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("pa", "pb", "key", "sizes")], pa.array(held, pa.binary())], ["pa", "pb", "key", "sizes", "held"])

    return rows.mapInArrow(run, _PATH)


def _chains(rows: DataFrame, band: int) -> DataFrame:
    """Nodes of bands that a single conversation has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                high, low = _halves(r["key"])
                n, start = len(high), r["seg"] * band
                ids = [np.concatenate([[np.int64(r[f"p{s}"])], x.view(np.int64)]) for s, x in zip("ab", _mixed(high, low, np.arange(n) + start))]
                a, b = (np.cumsum(x.view(np.uint64)).view(np.int64) for x in ids)
                kids = np.ones(n, np.int64)
                kids[-1] = r["more"]
                conv = pa.array(np.full(n, r["conv"]))
                parent = pa.array(np.full(n, r["conv"]), mask=np.arange(n) == 0)
                columns = [pa.array(np.arange(1, n + 1) + start), *map(pa.array, (a[1:], b[1:], a[:-1], b[:-1])), conv, parent]
                columns += [pa.array(x) for x in (np.ones(n, np.int64), kids, np.ones(n, np.int64), np.zeros(n, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _NODE.split(", ")])

    return rows.select("conv", "seg", "pa", "pb", "key", "more").mapInArrow(run, _NODE)


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of every node that a conversation ends with: SHA-256 of the ids, ascending, comma-joined.

    The ids of a node are joined in blocks of a value range first; one pass hashes the blocks in
    order and holds one block, as SHA-256 cannot be computed in parts.
    """
    last = rows.where("not more").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "conv")
    sole = F.sha2(F.min("conv").cast("string").cast("binary"), 256)
    counted = settle(last.groupBy("a", "b").agg(F.count("*").alias("n"), sole.alias("ends_sha256")), "trie-ends")
    ones = counted.where("n = 1").drop("n")
    ids = F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids")
    many = last.join(counted.where("n > 1").select("a", "b"), ["a", "b"], "left_semi")
    # Dealt by block, or the planner would keep the ids of a node together from here on.
    blocks = many.withColumn("block", F.shiftright("conv", ENDS_BITS)).repartition("a", "b", "block").groupBy("a", "b", "block").agg(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != key:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), x)) for x in out], _ENDS)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), (*key, state.hexdigest())))], _ENDS)

    ordered = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "block").select("a", "b", "ids")
    return ones.unionByName(ordered.mapInArrow(run, "a long, b long, ends_sha256 string"))


_ENDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(turns: DataFrame, convs: DataFrame, band: int = BAND, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` has (conv, pos, digest, size), places from 0 without gaps; ``convs`` has every conv once,
    those without turns too. Nodes are the distinct sequences of first turns, from the root. No
    conversations give no nodes.
    """
    packed = settle(_packed(turns, convs, band), "trie-packed")
    rows, deepest, long = _placed(packed)
    ends = _ends(rows)
    zero = F.lit(0).cast("long")
    nodes, below = [], None
    if long:
        shared = settle(rows.groupBy("seg", "pa", "pb").agg(F.count("*").alias("n")).where("n > 1 or seg = 0").drop("n"), "trie-shared")
        nodes.append(_chains(rows.join(shared, ["seg", "pa", "pb"], "left_anti"), band).withColumn("level", F.lit(0)))
        rows = settle(rows.join(shared, ["seg", "pa", "pb"]), "trie-rows")
    for seg in range(deepest, -1, -1):
        # Of a row that ends with one conversation which goes on, the rest is a chain: one child and one leaf.
        same = rows.where(F.col("seg") == seg).groupBy("pa", "pb", "ea", "eb").agg(
            F.min("conv").alias("conv"), F.count("*").alias("n"), F.min("key").alias("key"), F.min("sizes").alias("sizes"),
            F.sum(F.col("more").cast("long")).alias("going"),
        )
        if below is not None:
            same = same.join(below, (F.col("ea") == F.col("a")) & (F.col("eb") == F.col("b")), "left")
        else:
            same = same.withColumns({c: F.lit(None).cast("long") for c in ("kids", "leaves", "saved")})
        one = F.when(F.col("going") > 0, F.lit(1)).otherwise(zero).cast("long")
        same = same.select(
            "pa", "pb", "key", "sizes", "n", F.coalesce("kids", one).alias("kids"), F.coalesce("leaves", one).alias("leaves"),
            F.coalesce("saved", zero).alias("saved"), "conv",
        )
        cells = settle(_with_cells(same), "trie-cells")
        if cells.isEmpty():
            break
        found = _band(cells, seg, band, shard_bytes)
        nodes.append(found if seg == 0 else found.where(F.col("depth") > seg * band))
        below = found.where(F.col("depth") == seg * band).select("a", "b", "kids", "leaves", "saved")
    if not nodes:
        return turns.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    nodes = reduce(DataFrame.unionByName, nodes)
    # The parents that were open in some shard, or lie in the band above, are few; their children may be very many.
    missing = F.col("parent").isNull() & (F.col("depth") > 0)
    tops = nodes.where((F.col("level") > 0) | (F.col("depth") % band == 0)).select(
        F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("conv").alias("found"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    )
    orphans = nodes.where(missing).withColumn("salt", F.pmod(F.col("a"), F.lit(SALTS)).cast("int"))
    adopted = orphans.join(tops, ["ua", "ub", "salt"]).withColumn("parent", F.col("found"))
    columns = [c for c in nodes.columns if c not in ("ua", "ub", "level")]
    nodes = nodes.where(~missing).select(*columns).unionByName(adopted.select(*columns))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends, ["a", "b"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def conversation_trie(docs: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", **how) -> DataFrame:
    """The prefix trie of conversations as they are."""
    coded = settle(coded_turns(docs, conv, order, role, text), "trie-coded")
    return prefix_trie(coded, coded.select("conv").distinct(), **how)
