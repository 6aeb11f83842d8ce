"""From flat rows to nested entities: structs and arrays of structs, by one shuffle on the primary key.

Rows of a key are numbered within it by the query's sort keys and then all projected columns, as Spark has no row order of its own. Scalars come from the
first; each array path gathers an item from every row, drops items whose values are all null or empty, and keeps the first of equal ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.model import Entity
from ferrule.plans.compiler import Compiled, name_of

Tree = dict
#: Bytes of read tables for each task that nests rows, and the most tasks by that.
TASK_BYTES, TASKS = 8 << 20, 2000


def put(tree: Tree, path: str, value: Column) -> None:
    """Sets a dotted path; what stands in the way and isn't an object is replaced, and later values win."""
    parts = [p for p in path.split(".") if p]
    for p in parts[:-1]:
        if not isinstance(tree.get(p), dict):
            tree[p] = {}
        tree = tree[p]
    if parts:
        tree[parts[-1]] = value


def struct_of(tree: Tree) -> Column:
    return F.struct(*[(struct_of(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


def array_paths(entity: Entity) -> list[str]:
    """First segments of the paths of all fields that repeat, selected or not."""
    return list(dict.fromkeys((f.nest_path or k).split(".")[0] for k, f in entity.fields.items() if f.many))


def _under(path: str, array: str) -> bool:
    return path == array or path.startswith(array + ".")


def _values(compiled: Compiled) -> dict[str, Column]:
    """Each output's value by key, transformed. A transform gets the value and a function that gives any flat column by name."""
    out = {}
    for o in compiled.outputs.values():
        c = F.col(f"`{name_of(o.key, o.field)}`")
        out[o.key] = o.field.transform(c, lambda n: F.col(f"`{n}`")) if o.field.transform else c
    return out


def _empty(c: Column) -> Column:
    return c.isNull() | F.coalesce(c.cast("string") == "", F.lit(False))


def _tasks(flat: DataFrame) -> int:
    """How many tasks nest flat's rows, by the size of what they are read from. 0 leaves that to Spark: for small or unknown sizes it joins parts of the
    shuffle into as many as run at once; it would do so up to 64 MB of packed rows each, some 0.9 GB once unpacked, sorted and gathered."""
    leaves = flat._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    n = min(math.ceil(size / TASK_BYTES), TASKS) if size < 1 << 60 else 0
    return n if n > flat.sparkSession.sparkContext.defaultParallelism else 0


def nest(flat: DataFrame, entity: Entity, compiled: Compiled, ways: list[str]) -> DataFrame:
    """flat has the compiled outputs and, for each of ways (ASC or DESC), a sort key column _sort0, _sort1, ..."""
    arrays, primary = array_paths(entity), entity.primary()
    values = _values(compiled)
    tree: Tree = {}
    for o in compiled.outputs.values():
        if not any(_under(o.path, a) for a in arrays):
            put(tree, o.path, values[o.key])
    sorts = [F.col(f"_sort{i}").desc_nulls_last() if w == "DESC" else F.col(f"_sort{i}").asc_nulls_last() for i, w in enumerate(ways)]
    if not (arrays and primary):
        return flat.orderBy(*sorts).select(*[(struct_of(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()]) if sorts else flat.select(*[(struct_of(v) if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])

    pk = F.col(f"`{name_of(*primary)}`")
    ties = [F.col(f"`{name_of(o.key, o.field)}`").asc_nulls_last() for o in compiled.outputs.values()]
    tasks = _tasks(flat)
    kept = flat.filter(pk.isNotNull())
    rows = (kept.repartition(tasks, pk) if tasks else kept).withColumn("_pos", F.row_number().over(Window.partitionBy(pk).orderBy(*sorts, *ties)))
    first = struct_of({"doc": tree or {"_none": F.lit(None)}} | {f"_sort{i}": F.col(f"_sort{i}") for i in range(len(ways))})
    gathered = {}
    for a in arrays:
        item: Tree = {}
        mine = []
        for o in compiled.outputs.values():
            if _under(o.path, a):
                put(item, o.key if o.path == a else o.path[len(a) + 1 :], values[o.key])
                mine.append(values[o.key])
        if not item:
            gathered[a] = None
            continue
        blank = _empty(mine[0])
        for c in mine[1:]:
            blank = blank & _empty(c)
        gathered[a] = F.collect_list(F.when(~blank, F.struct("_pos", struct_of(item).alias("item"))))
    aggs = [F.min_by(first, "_pos").alias("_first")] + [c.alias(f"_list_{a}") for a, c in gathered.items() if c is not None]
    groups = rows.groupBy(pk.alias("_pk")).agg(*aggs)
    cols = {k: F.col(f"_first.doc.`{k}`") for k in tree}
    for a, c in gathered.items():
        # the order of a list's items is that of their rows; equal items keep the first
        cols[a] = F.array_distinct(F.transform(F.array_sort(F.col(f"`_list_{a}`")), lambda x: x["item"])) if c is not None else F.array().cast("array<string>")
    order = [F.col(f"_first._sort{i}").desc_nulls_last() if w == "DESC" else F.col(f"_first._sort{i}").asc_nulls_last() for i, w in enumerate(ways)]
    if order:
        groups = groups.orderBy(*order, "_pk")
    return groups.select(*[c.alias(k) for k, c in cols.items()])


def to_objects(df: DataFrame, entity: Entity) -> list[dict]:
    """Plain nested dicts, each through post_process; where that gives None the object stays."""
    out = []
    for row in df.collect():
        obj = row.asDict(recursive=True)
        done = entity.post_process(obj) if entity.post_process else None
        out.append(obj if done is None else done)
    return out
