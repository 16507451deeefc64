"""Attribute-value rows into one wide, typed row per entity, by positional stitching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.functions import values as V

KINDS = {"bool": "boolean", "int": "bigint", "float": "double", "enum": "string", "str": "string", "list": "array<string>"}
SLOTS = ("boolean", "bigint", "double", "string", "array<string>")
#: Ordinals that one partition owns.
RANGE = 1 << 40


@dataclass(frozen=True)
class Attribute:
    """A declared column of the wide table; `vocabulary` is used by kinds enum and list."""

    name: str
    kind: str
    vocabulary: tuple[str, ...] = field(default=())

    def parse(self, text: Column) -> Column:
        keys = V.label_keys(list(self.vocabulary))
        return {
            "bool": lambda: V.as_bool(text),
            "int": lambda: V.as_int(text),
            "float": lambda: V.as_float(text),
            "enum": lambda: V.as_label(text, keys),
            "list": lambda: V.as_label_list(text, keys) if keys else F.lit(None).cast("array<string>"),
            "str": lambda: F.nullif(V.squeeze(text), F.lit("")),
        }[self.kind]()


def declared(fields: DataFrame, task: str, version: int | None = None, limit: int = 20_000) -> list[Attribute]:
    """The attributes that a field table declares for a task. The schema of a table is small by nature; `limit` checks it."""
    rows = fields.filter(F.col("task") == task)
    if version is not None:
        rows = rows.filter(F.col("task_version") == version)
    found = rows.select("field", "kind", "vocabulary").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} declared fields")
    return sorted((Attribute(r.field, r.kind, tuple(r.vocabulary or ())) for r in found), key=lambda a: a.name)


def latest(facts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value with the greatest `order` per key; equal times are decided by the greater value, so the result is fixed."""
    return facts.groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias(value))


def _stitch(keys: list[str], attributes: list[Attribute], out_schema: pa.Schema):
    """Assembles columns by position from a partition that is sorted by entity.

    Partition p owns the global ordinals from p * RANGE on; its entities get them in their order. For every
    attribute an array over the range of ordinals at hand holds the row from which that entity's cell
    comes; the column is then taken from the typed source column in one step.
    """
    slot = [SLOTS.index(KINDS[a.kind]) for a in attributes]

    def assemble(table: pa.Table, first: int, ordinal: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        n, attr = len(starts), table.column("_a").to_numpy(zero_copy_only=False)
        rows = np.arange(len(attr))
        columns = [pa.array(np.arange(first, first + n)), *[table.column(k).combine_chunks().take(pa.array(starts)) for k in keys]]
        sources = [table.column(f"_v{i}").combine_chunks() for i in range(len(SLOTS))]
        for k, s in enumerate(slot):
            mine = attr == k
            position = np.full(n, -1, dtype=np.int64)
            position[ordinal[mine]] = rows[mine]
            columns.append(sources[s].take(pa.array(position, mask=position < 0)))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        first = TaskContext.get().partitionId() * RANGE
        for batch in batches:
            part = pa.Table.from_batches([batch])
            table = part if rest is None else pa.concat_tables([rest, part])
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, dtype=bool)
            change[0] = True
            for k in keys:
                codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            last = starts[-1]  # this entity may go on in the next batch
            rest = table.slice(last)
            if last:
                yield assemble(table.slice(0, last), first, (np.cumsum(change) - 1)[:last], starts[:-1])
                first += len(starts) - 1
        if rest is not None and rest.num_rows:
            yield assemble(rest, first, np.zeros(rest.num_rows, dtype=np.int64), np.zeros(1, dtype=np.int64))

    return run


def widen(facts: DataFrame, keys: list[str], attribute: str, value: str, order: str, attributes: list[Attribute], ordinal: str | None = None) -> DataFrame:
    """One row per entity with one typed column per declared attribute; with `ordinal`, also the entity's global ordinal under that name.

    Rows are sent to the partition of their entity once and sorted there; each partition then owns a
    range of global entity ordinals and writes every attribute as a typed column aligned to that range
    (see `_stitch`), so neither a pivot aggregate per attribute nor a second shuffle is needed.

    Defined cases: a null value counts as not written; of the writes for one cell the one with the
    greatest `order` decides, even if it can't be read (the cell is then null), and of equal ones the
    greater text; repeated rows change nothing. Attribute names that differ only in case, blanks or
    joining marks are one; names that aren't declared give no column, but their entity keeps its row,
    as does one whose values are all null. Null keys are ordinary keys. An empty input gives an empty
    table. Other columns of `facts` are ignored. A key may not have the name of an attribute.
    """
    clash = {k.lower() for k in keys} & {a.name.lower() for a in attributes}
    if clash:
        raise ValueError(f"keys that are also attributes: {sorted(clash)}")
    internal = [f"_k{i}" for i in range(len(keys))]
    index = {"".join(ch for ch in a.name.lower() if ch.isalnum()): i for i, a in enumerate(attributes)}
    number = F.try_element_at(F.create_map(*[F.lit(x) for p in index.items() for x in p]), V.name_key(F.col(attribute))) if index else F.lit(None).cast("int")
    written = facts.select(
        *[F.col(k).alias(i) for k, i in zip(keys, internal)],
        F.when(F.col(value).isNotNull(), F.coalesce(number, F.lit(-1))).otherwise(-1).cast("int").alias("_a"),
        F.col(order).alias("_o"),
        F.col(value).cast("string").alias("_v"),
    )
    cells = latest(written.repartition(*internal), [*internal, "_a"], "_o", "_v")
    # what is declared of an attribute is joined in (one row each), so an expression is as long as the kinds are many
    known = facts.sparkSession.createDataFrame([(i, a.kind, V.label_keys(list(a.vocabulary))) for i, a in enumerate(attributes)], "_a int, _kind string, _keys map<string,string>")
    v, kind = F.col("_v"), F.col("_kind")
    readers = {"bool": V.as_bool(v), "int": V.as_int(v), "float": V.as_float(v), "enum": V.as_label(v, F.col("_keys")), "list": F.when(F.size("_keys") > 0, V.as_label_list(v, F.col("_keys"))), "str": F.nullif(V.squeeze(v), F.lit(""))}
    typed = []
    for i, slot in enumerate(SLOTS):
        expression = F.lit(None).cast(slot)
        for k, reader in readers.items():
            if KINDS[k] == slot:
                expression = F.when(kind == k, reader.cast(slot)).otherwise(expression)
        typed.append(expression.alias(f"_v{i}"))
    rows = cells.join(F.broadcast(known), "_a", "left").sortWithinPartitions(*internal, "_a").select(*internal, "_a", *typed)
    schema = T.StructType(
        [T.StructField("_ordinal", T.LongType())]
        + [T.StructField(i, facts.schema[k].dataType) for k, i in zip(keys, internal)]
        + [T.StructField(a.name, T._parse_datatype_string(KINDS[a.kind])) for a in attributes]
    )
    wide = rows.mapInArrow(_stitch(internal, attributes, to_arrow_schema(schema)), schema)
    return wide.select(*([F.col("_ordinal").alias(ordinal)] if ordinal else []), *[F.col(i).alias(k) for k, i in zip(keys, internal)], *[F.col(f"`{a.name}`") for a in attributes])


def cells(wide: DataFrame, keys: list[str], attributes: list[Attribute]) -> DataFrame:
    """The non-null cells of a wide table as (keys, field, value) with every value written in one form."""
    text = {
        "bool": lambda c: c.cast("string"),
        "int": lambda c: c.cast("string"),
        "float": lambda c: F.format_string("%.4f", c),
        "enum": lambda c: c,
        "str": lambda c: c,
        "list": lambda c: F.array_join(c, "|"),
    }
    pairs = F.array(*[F.struct(F.lit(a.name).alias("field"), F.when(F.col(f"`{a.name}`").isNotNull(), text[a.kind](F.col(f"`{a.name}`"))).alias("value")) for a in attributes])
    return wide.select(*keys, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))
