"""Filling containers of fixed capacity with whole documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import Workspace

#: Tokens and rows that one packing task gets at most on average; a task keeps only ids and sizes in memory.
SHARD_TOKENS = 16_000_000
SHARD_ROWS = 60_000
#: Equally tight containers among which one without the item's source is looked for.
LOOK = 32


def fingerprint(text: Column) -> Column:
    """Texts that differ only in case, blanks and marks have one fingerprint; texts without letters or digits have none."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
    return F.when(plain != "", F.xxhash64(plain))


class Bins:
    """Open containers in the order of what is left in them.

    `level[r]` lists the containers with r tokens left; the bits of `levels` mark the levels that are in
    use, so the successor of a size is one shift. Each container carries a bitmap of the duplicate
    clusters, and one of the sources, that it holds: a container with a cluster of the item is never
    compatible, nor one with its source if the item is barred from it; of equally tight compatible
    containers one that doesn't hold the source yet is taken, so that sources mix.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level: dict[int, list[int]] = {}
        self.levels = 0
        self.held: list[int] = []
        self.sources: list[int] = []

    def successor(self, size: int) -> int:
        """The tightest level in use that holds `size`, or -1."""
        rest = self.levels >> size
        return size + (rest & -rest).bit_length() - 1 if rest else -1

    def put(self, b: int, left: int, size: int, bit: int, source: int) -> None:
        self.held[b] |= bit
        self.sources[b] |= source
        self._add(b, left - size)

    def _add(self, b: int, left: int) -> None:
        self.level.setdefault(left, []).append(b)
        self.levels |= 1 << left

    def take(self, left: int, place: int) -> int:
        bins = self.level[left]
        bins[place], bins[-1] = bins[-1], bins[place]
        b = bins.pop()
        if not bins:
            self.levels &= ~(1 << left)
            del self.level[left]
        return b

    def open(self) -> int:
        self.held.append(0)
        self.sources.append(0)
        return len(self.held) - 1

    def pick(self, bins: list[int], bit: int, source: int, barred: bool) -> int:
        """The place in `bins` of a compatible container, without the source if there is one among the last LOOK; -1 if none is compatible."""
        found = -1
        for place in range(len(bins) - 1, -1, -1):
            b = bins[place]
            if self.held[b] & bit or (barred and self.sources[b] & source):
                continue
            if not self.sources[b] & source:
                return place
            found = place if found < 0 else found
            if len(bins) - place >= LOOK:
                break
        return found

    def best(self, size: int, bit: int, source: int, barred: bool = False) -> int:
        """Puts one item into the tightest compatible container, a new one if none is compatible."""
        left = self.successor(size)
        while left >= 0:
            place = self.pick(self.level[left], bit, source, barred)
            if place >= 0:
                b = self.take(left, place)
                self.put(b, left, size, bit, source)
                return b
            left = self.successor(left + 1)
        b = self.open()
        self.put(b, self.capacity, size, bit, source)
        return b

    def spread(self, size: int, bit: int, sources: list[int]) -> list[int]:
        """Puts equal copies, one after the other, each into the tightest compatible container.

        A container that got a copy can't take another, so the search goes on where it stopped.
        """
        found: list[tuple[int, int]] = []
        left = self.successor(size)
        while left >= 0 and len(found) < len(sources):
            for b in reversed(self.level[left]):
                if not (self.held[b] & bit):
                    found.append((left, b))
                    if len(found) == len(sources):
                        break
            left = self.successor(left + 1)
        taken = {b for _, b in found}
        for left in {x for x, _ in found}:
            rest = [b for b in self.level[left] if b not in taken]
            if rest:
                self.level[left] = rest
            else:
                del self.level[left]
                self.levels &= ~(1 << left)
        found += [(self.capacity, self.open()) for _ in range(len(sources) - len(found))]
        for (left, b), s in zip(found, sources):
            self.put(b, left, size, bit, s)
        return [b for _, b in found]


def fill(items: pd.DataFrame, capacity: int, exclusive: frozenset = frozenset()) -> list[int]:
    """Container of each item (size, cluster, source), largest items first; copies of one cluster never share a container.

    Sources in `exclusive` don't share a container with themselves either.
    """
    sizes = items["size"].to_numpy()
    many = items["cluster"].value_counts()
    bits = {c: 1 << i for i, c in enumerate(sorted(many[many > 1].index))}
    names = {s: 1 << i for i, s in enumerate(sorted(items["source"].fillna("").unique()))}
    clusters, sources = items["cluster"].tolist(), items["source"].fillna("").tolist()
    order = sorted(range(len(items)), key=lambda i: (-sizes[i], clusters[i] if clusters[i] == clusters[i] and clusters[i] is not None else -(2**63), items.index[i]))
    bins, out, i = Bins(capacity), [0] * len(items), 0
    while i < len(order):
        k = order[i]
        bit = bits.get(clusters[k], 0)
        run = 1
        if bit and not exclusive:
            while i + run < len(order) and sizes[order[i + run]] == sizes[k] and clusters[order[i + run]] == clusters[k]:
                run += 1
        if run > 1:
            group = order[i : i + run]
            for g, b in zip(group, bins.spread(int(sizes[k]), bit, [names[sources[g]] for g in group])):
                out[g] = b
        else:
            out[k] = bins.best(int(sizes[k]), bit, names[sources[k]], sources[k] in exclusive)
        i += run
    return out


def pack(sized: DataFrame, key: str, size: str, cluster: str, source: str, containers: list[tuple[str, int]], exclusive: frozenset = frozenset(), shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(container_kind, container, key, piece, first_token, tokens): every document in a container of each kind.

    A document that alone exceeds the capacity is cut into pieces that fill whole containers and a
    remainder, which is packed like a document; no other document is split. Documents are dealt to shards
    by hash, and each shard is packed by conflict-constrained best fit, largest first (see `Bins`). A
    shard holds only ids and sizes and its number grows with the tokens and rows, so no task grows with
    the input, and the space lost at the seams is at most a container or two in a shard.

    Defined cases: a size that is null counts as 0 and such a document still gets its place; a null
    cluster conflicts with nothing; a null source is a source; ties go to the smaller id; repeated rows
    are separate items; an empty table gives an empty one; capacities must be positive.
    """
    spark = sized.sparkSession
    if any(c <= 0 for _, c in containers):
        raise ValueError("capacities must be positive")
    space = Workspace(spark, "packing")
    base, seen = space.keep(
        sized.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), F.col(cluster).cast("bigint").alias("cluster"), F.col(source).cast("string").alias("source")),
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
    )
    shards = int(max(1, -(-seen["tokens"] // shard_tokens), -(-seen["rows"] // shard_rows)))
    kinds = F.array(*[F.struct(F.lit(n).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for n, c in containers])
    each = base.select("key", "size", "cluster", "source", F.inline(kinds))
    over = F.col("size") > F.col("capacity")
    full = F.when(over, F.floor(F.col("size") / F.col("capacity"))).otherwise(0)
    each = each.withColumn("full", full.cast("bigint")).withColumn("rest", F.col("size") - F.col("full") * F.col("capacity"))
    whole = each.filter("full > 0").select("container_kind", "key", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("container_kind", F.concat_ws(":", "container_kind", "key", "piece").alias("container"), "key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    items = each.filter("full = 0 OR rest > 0").select("container_kind", "capacity", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "full", F.col("rest").alias("size"), "cluster", "source")
    kind = sized.schema[key].dataType.simpleString()

    def run(ident: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name, shard, capacity = ident
        frame = frame.sort_values("key", kind="stable").reset_index(drop=True)
        frame["cluster"] = frame["cluster"].astype("Int64").astype(object).where(frame["cluster"].notna(), None)
        where = fill(frame, int(capacity), exclusive)
        return pd.DataFrame({
            "container_kind": name, "container": [f"{name}:{shard}#{b}" for b in where], "key": frame["key"], "piece": frame["full"].astype("int32"),
            "first_token": frame["full"] * int(capacity), "tokens": frame["size"],
        })

    packed = items.groupBy("container_kind", "shard", "capacity").applyInPandas(run, f"container_kind string, container string, key {kind}, piece int, first_token bigint, tokens bigint")
    return whole.unionByName(packed).withColumnRenamed("key", key)
