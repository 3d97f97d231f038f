"""Attribute-value rows into one wide, typed row per entity.

Plan: (1) type and read every value with SQL expressions; (2) reduce to one cell per entity and attribute with a partial
(map-side) aggregation, so an entity that holds a third of all rows shrinks to at most one row per attribute before it
is moved; (3) hash-bucket the entities; (4) per bucket, dictionary-encode entity and attribute and scatter the values
into one numpy array per column, which become an Arrow table. Buckets are read in entity order and flushed in blocks of
whole entities, so the memory of a task depends on the block size and not on the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partloom.functions.numbers import QUALIFIERS, NUMBER, parse_number
from partloom.functions.text import attribute_key, compact_code, is_not_stated, trimmed
from partloom.functions.units import UNIT_TOKEN

# Words for true and false in English, German, French and Spanish, in lower case.
TRUE_WORDS = ["1", "yes", "y", "true", "ja", "j", "wahr", "oui", "o", "vrai", "sí", "si", "s", "verdadero", "cierto"]
FALSE_WORDS = ["0", "no", "n", "false", "nein", "falsch", "non", "faux", "falso"]

_Q = rf"(?:{QUALIFIERS}\.?\s*)*"
_STATED_NUMBER = rf"(?i)^{_Q}({NUMBER})\s*(?-i:{UNIT_TOKEN})?(?:[\s,]*{QUALIFIERS}\.?)*\s*$"

#: whole entities that are scattered at once
BLOCK_CELLS = 400_000


def read_number(text: Column) -> Column:
    """The number a text states as its whole content (qualifiers and a unit may stand beside it); else null."""
    token = F.regexp_extract(trimmed(text), _STATED_NUMBER, 1)
    return F.when(token != "", parse_number(token))


def read_bool(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t.isin(*TRUE_WORDS), F.lit(True)).when(t.isin(*FALSE_WORDS), F.lit(False))


def read_enum(text: Column, allowed: Column) -> Column:
    """The allowed value that equals the text apart from case, blanks and separators; else null."""
    code = compact_code(text)
    return F.get(F.filter(allowed, lambda a: compact_code(a) == code), F.lit(0))


def typed_cells(rows: DataFrame, entity: Column, scope: Column, attribute: Column, text: Column, order: list[Column], specs: DataFrame, number: Column | None = None) -> DataFrame:
    """One row per entity and attribute known in the entity's scope (its category).

    ``specs`` has ``scope, attribute, value_type, allowed`` (one row per scope and attribute, broadcast: its size is that
    of the schema). Result: ``entity, attribute, num, flag, txt`` (the slot of the attribute's type is filled) and
    ``unread`` (something non-blank is stated, but nothing readable). Of several readable values the last in ``order``
    wins, then the greatest. ``number`` is the expression to store for quantities (e.g. in canonical units) where it is
    not null; otherwise the number as it stands. Rows with a null entity, a blank text or an attribute unknown in the
    scope give no cell; repeated rows change nothing.
    """
    kind = F.col("value_type")
    given = (number if number is not None else F.lit(None)).cast("double")
    x = rows.select(entity.alias("entity"), scope.alias("scope"), attribute.alias("attribute"), trimmed(text).alias("_text"), given.alias("_given"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    x = x.where(F.col("entity").isNotNull() & (F.col("_text") != ""))
    x = x.join(F.broadcast(specs), ["scope", "attribute"])
    num = F.when(kind == "quantity", read_number(F.col("_text")))
    flag = F.when(kind == "bool", read_bool(F.col("_text")))
    txt = F.when(kind == "enum", read_enum(F.col("_text"), F.col("allowed"))).when((kind == "text") & ~is_not_stated(F.col("_text")), F.col("_text"))
    x = x.select("entity", "attribute", num.alias("_num"), "_given", flag.alias("flag"), txt.alias("txt"), *[f"_o{i}" for i in range(len(order))])
    readable = F.col("_num").isNotNull() | F.col("flag").isNotNull() | F.col("txt").isNotNull()
    x = x.withColumn("num", F.when(F.col("_num").isNotNull(), F.coalesce("_given", "_num")))
    rank = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("num"), F.col("flag"), F.col("txt"))
    cells = x.groupBy("entity", "attribute").agg(F.max(F.when(readable, rank)).alias("b"))
    return cells.select("entity", "attribute", F.col("b.num").alias("num"), F.col("b.flag").alias("flag"), F.col("b.txt").alias("txt"), F.col("b").isNull().alias("unread"))


class _Scatter:
    """Scatters the cells of whole entities into one array per column."""

    def __init__(self, columns: list[tuple[str, str]], schema: pa.Schema):
        self.columns, self.schema = columns, schema
        self.at = {name: j for j, (name, _) in enumerate(columns)}

    def table(self, t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ent = t["entity"].combine_chunks().dictionary_encode()
        row = ent.indices.to_numpy(zero_copy_only=False)
        names = t["attribute"].combine_chunks().dictionary_encode()
        code = np.array([self.at[v] for v in names.dictionary.to_pylist()], dtype=np.int64)
        col = code[names.indices.to_numpy(zero_copy_only=False)]
        n = len(ent.dictionary)
        unread = t["unread"].to_numpy(zero_copy_only=False).astype(bool)
        arrays = [ent.dictionary]
        source = {"double": ("num", np.float64), "boolean": ("flag", np.bool_), "string": ("txt", object)}
        for j, (_, kind) in enumerate(self.columns):
            slot, dtype = source[kind]
            mine = np.flatnonzero((col == j) & ~unread)
            null = np.ones(n, dtype=bool)
            values = np.full(n, None, dtype=object) if dtype is object else np.zeros(n, dtype=dtype)
            if len(mine):
                picked = t[slot].take(pa.array(mine))
                values[row[mine]] = picked.to_numpy(zero_copy_only=False) if dtype is object else picked.fill_null(0 if dtype is np.float64 else False).to_numpy(zero_copy_only=False)
                null[row[mine]] = picked.is_null().to_numpy(zero_copy_only=False) if picked.null_count else False
            arrays.append(pa.array(values, type={"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind], mask=null))
        bad = np.flatnonzero(unread)
        bad = bad[np.argsort(row[bad], kind="stable")]
        counts = np.bincount(row[bad], minlength=n) if len(bad) else np.zeros(n, dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        labels = names.dictionary.take(names.indices.take(pa.array(bad, type=pa.int64())))
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), labels.cast(pa.string())))
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def to_wide(cells: DataFrame, columns: list[tuple[str, str]], entity: str = "entity", buckets: int | None = None) -> DataFrame:
    """The cells of ``typed_cells`` as one row per entity.

    ``columns`` lists (attribute, ``double`` | ``boolean`` | ``string``), the schema of the result; it comes from the
    attribute specifications, never from the data. Result: ``entity``, one column per attribute (null where the entity
    has no readable value) and ``unread`` (array of the attributes that are stated but unreadable). An entity without any
    cell has no row; an empty input gives an empty table with the full schema.
    """
    kinds = {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    schema = T.StructType([T.StructField(entity, T.StringType()), *[T.StructField(c, kinds[k]) for c, k in columns], T.StructField("unread", T.ArrayType(T.StringType()))])
    arrow = pa.schema([pa.field(entity, pa.string()), *[pa.field(c, {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[k]) for c, k in columns], pa.field("unread", pa.list_(pa.string()))])
    block = BLOCK_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, held, size = _Scatter(columns, arrow), [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            size += b.num_rows
            if size < block:
                continue
            t = pa.Table.from_batches(held)
            # the last entity may go on in the next batch
            ent = t["entity"].combine_chunks()
            last = ent[len(ent) - 1].as_py()
            cut = pc.index(ent, pa.scalar(last, ent.type)).as_py()
            if cut > 0:
                yield scatter.table(t.slice(0, cut))
            held, size = t.slice(cut).to_batches(), len(ent) - cut
        if size:
            yield scatter.table(pa.Table.from_batches(held))

    parts = [buckets, F.col("entity")] if buckets else [F.col("entity")]
    ordered = cells.select("entity", "attribute", "num", "flag", "txt", "unread").repartition(*parts).sortWithinPartitions("entity")
    return ordered.mapInArrow(run, schema)


def wide_columns(specs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(attribute, value type of the specification) as (column, Spark type), in name order."""
    return sorted((a, {"quantity": "double", "bool": "boolean"}.get(t, "string")) for a, t in specs)


def scoped_specs(specs: DataFrame) -> DataFrame:
    """``attribute_specs`` as ``scope, attribute, value_type, allowed``, one row per category and key."""
    return specs.select(
        F.col("category_code").alias("scope"), attribute_key(F.col("canonical_key")).alias("attribute"), "value_type", F.col("allowed_values").alias("allowed")
    ).dropDuplicates(["scope", "attribute"])
