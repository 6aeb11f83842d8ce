"""The fluent query builder."""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.functions.display import DisplayJoins
from ferrule.model import UNSET, Entity
from ferrule.operators.nesting import nest, to_objects
from ferrule.plans.compiler import Compiled, Compiler, Output, State, inlined, name_of, quote
from ferrule.plans.predicates import Where
from ferrule.sources.catalog import Catalog
from ferrule.sources.scratch import can_write, shared_folder

PLACE = "_place"
#: Rows that a walk over all pages fetches at once, a page at least.
WALK_ROWS = 100_000
#: Sorted rows up to offset + limit that one task may hold; for more, or an offset without a limit, the rows are written with their places.
ONE_TASK_ROWS = 100_000


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(x.dataType) for x in t.fields)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


class Placed:
    """A DataFrame's rows in its order, written once to the shared folder with their places. close() removes the folder."""

    def __init__(self, df: DataFrame, name: str, most: int | None = None):
        """most: the number of rows that count."""
        self.spark = df.sparkSession
        self.folder = shared_folder(self.spark, name)
        df.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(self.folder)
        self.placed = self.spark.read.parquet(self.folder)
        # places grow with the order; each partition's count on from its number times 2^33
        counts = self.placed.groupBy(F.shiftright(PLACE, 33).alias("p")).count().orderBy("p").collect()
        self.parts = [(r["p"], r["count"]) for r in counts]
        self.total = min([sum(n for _, n in self.parts), *([] if most is None else [most])])

    def _place(self, k: int) -> int:
        for p, n in self.parts:
            if k < n:
                return (p << 33) + k
            k -= n
        raise IndexError(k)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows low, low + 1, ..., high - 1 with their places, in no order of their own."""
        high = min(high, self.total)
        return self.placed.filter(F.col(PLACE).between(self._place(low), self._place(high - 1)) if low < high else F.lit(False))

    def number(self) -> Column:
        """A row's number from its place."""
        before, seen = [0] * (self.parts[-1][0] + 1 if self.parts else 1), 0
        for p, n in self.parts:
            before[p] = seen
            seen += n
        at = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.shiftright(PLACE, 33).cast("int") + 1)
        return at + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))

    def close(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Pages(Placed):
    """Flat rows by the page, in the order of the query's sorts, or else of all columns, so that pages don't overlap.

    The rows are sorted once and written with their places to the shared folder; a page reads the places that it has, so late pages cost no more than
    early ones. A walk over all pages fetches many at once; to_df() gives all rows with their pages' numbers without the driver."""

    def __init__(self, df: DataFrame, size: int, most: int | None = None):
        super().__init__(df, "pages", most)
        self.size = size
        self.page_count = math.ceil(self.total / size)

    def _pages(self, k: int, n: int) -> Iterator[list[Row]]:
        rows = self.between(k * self.size, (k + n) * self.size).orderBy(PLACE).drop(PLACE).collect()
        return (rows[i : i + self.size] for i in range(0, len(rows), self.size))

    def page(self, k: int) -> list[Row]:
        return next(self._pages(k, 1), []) if 0 <= k < self.page_count else []

    def __iter__(self) -> Iterator[list[Row]]:
        n = max(1, WALK_ROWS // self.size)
        for k in range(0, self.page_count, n):
            yield from self._pages(k, n)

    def to_df(self, page: str = "page", row: str = "row") -> DataFrame:
        """All rows, behind their page's number and their own, both from 0. It reads the folder, so close() comes after it has run."""
        columns = [F.col(f"`{c}`") for c in self.placed.columns if c != PLACE]
        numbered = self.between(0, self.total).withColumn(PLACE, self.number())
        return numbered.select(F.expr(f"{PLACE} div {self.size}").alias(page), F.col(PLACE).alias(row), *columns)


class Query:
    """Methods change the query and return it; to_df(), nested(), count() and the like run it."""

    def __init__(self, entity: Entity, catalog: Catalog):
        self.entity, self.catalog = entity, catalog
        self.displays = DisplayJoins(entity, catalog)
        self.compiler = Compiler(entity, catalog, self.displays)
        self.state = State()
        self._where = Where(lambda name, as_text: self.compiler.expression(self.entity.field(name), as_text))
        self.state.conditions = self._where.conditions

    # projection

    def select(self, *keys: str) -> Query:
        self.state.selected = (self.state.selected or set()) | set(keys)
        return self

    def select_all(self) -> Query:
        self.state.selected = None
        return self

    def distinct(self) -> Query:
        self.state.distinct = True
        return self

    # conditions

    def where(self, name: str, op: str, value=UNSET, use_text: bool = False) -> Query:
        self._where.where(name, op, value, use_text)
        return self

    def or_where(self, name: str, op: str, value=UNSET, use_text: bool = False) -> Query:
        self._where.or_where(name, op, value, use_text)
        return self

    def where_raw(self, sql: str, *args) -> Query:
        self._where.where_raw(sql, *args)
        return self

    def or_where_raw(self, sql: str, *args) -> Query:
        self._where.or_where_raw(sql, *args)
        return self

    def where_in(self, name: str, values=UNSET) -> Query:
        self._where.where_in(name, values)
        return self

    def where_not_in(self, name: str, values=UNSET) -> Query:
        self._where.where_not_in(name, values)
        return self

    def where_null(self, name: str) -> Query:
        self._where.where_null(name)
        return self

    def where_not_null(self, name: str) -> Query:
        self._where.where_not_null(name)
        return self

    def where_between(self, name: str, low=UNSET, high=UNSET) -> Query:
        self._where.where_between(name, low, high)
        return self

    def where_group(self, build: Callable[[Where], object]) -> Query:
        self._where.where_group(build)
        return self

    def or_where_group(self, build: Callable[[Where], object]) -> Query:
        self._where.or_where_group(build)
        return self

    # order and extent

    def order_by(self, name: str, way: str = "ASC") -> Query:
        self.entity.field(name)
        if way.upper() not in ("ASC", "DESC"):
            raise ValueError(f"Unknown sort direction '{way}'.")
        self.state.sorts.append((name, way.upper()))
        return self

    def order_by_asc(self, name: str) -> Query:
        return self.order_by(name, "ASC")

    def order_by_desc(self, name: str) -> Query:
        return self.order_by(name, "DESC")

    def limit(self, n: float) -> Query:
        self.state.limit = max(0, math.floor(n))
        return self

    def offset(self, n: float) -> Query:
        self.state.offset = max(0, math.floor(n))
        return self

    def page(self, number: float, size: float) -> Query:
        number, size = max(1, math.floor(number)), max(1, math.floor(size))
        return self.limit(size).offset((number - 1) * size)

    # compiling and running

    def compile(self) -> Compiled:
        return self.compiler.compile(self.state)

    def to_sql(self) -> str:
        c = self.compile()
        return inlined(c.sql, c.args)

    def _with_sorts(self, state: State) -> DataFrame:
        """The flat rows with sort keys as columns _sort0, _sort1, ..."""
        c = self.compiler.compile(state, hidden_sorts=True)
        flat = self.catalog.sql(c.sql, c.args)
        if state.distinct:
            flat = flat.withColumns({f"_sort{i}": flat[name_of(k, self.entity.field(k))] for i, (k, _) in enumerate(state.sorts)})
        return flat

    def _in_order(self, state: State, hidden_sorts: bool = False) -> DataFrame:
        """The flat rows in the order of the sorts and then of all columns, so that rows with equal sort keys needn't be one task's."""
        flat, hidden = self._with_sorts(state), [f"_sort{i}" for i in range(len(state.sorts))]
        sorts = [F.col(k).desc_nulls_last() if w == "DESC" else F.col(k).asc_nulls_last() for k, (_, w) in zip(hidden, state.sorts)]
        ties = [F.col(quote(x.name)).asc_nulls_last() for x in flat.schema if x.name not in hidden and _orderable(x.dataType)]
        return flat.orderBy(*sorts, *ties).drop(*([] if hidden_sorts else hidden))

    def _far(self) -> bool:
        """Whether one task would get too many rows by the limit and offset."""
        s = self.state
        far = s.offset > 0 if s.limit is None else bool(s.sorts) and s.limit > 0 and s.offset + s.limit > ONE_TASK_ROWS
        return far and can_write(self.catalog.spark)

    def _flat(self, hidden_sorts: bool = False) -> tuple[DataFrame, Placed | None]:
        """The flat rows, and what they read if they had to be written with their places."""
        if not self._far():
            c = self.compile()
            return self._with_sorts(self.state) if hidden_sorts else self.catalog.sql(c.sql, c.args), None
        s = copy.copy(self.state)
        s.limit, s.offset = None, 0
        rows = Placed(self._in_order(s, hidden_sorts) if s.sorts else self._with_sorts(s), "offset")
        df = rows.between(self.state.offset, rows.total if self.state.limit is None else self.state.offset + self.state.limit)
        return (df.orderBy(PLACE) if s.sorts else df).drop(PLACE), rows

    def _nested(self) -> tuple[DataFrame, Placed | None]:
        flat, written = self._flat(hidden_sorts=True)
        return nest(flat, self.entity, self.compiler.compile(self.state, hidden_sorts=True), [w for _, w in self.state.sorts]), written

    def to_df(self) -> DataFrame:
        """The flat rows. A limit counts joined rows, not entities. With an offset but no limit, or many rows up to a limit's end, the rows are sorted and
        written at once, and the result reads what was written."""
        return self._flat()[0]

    def nested(self) -> DataFrame:
        """Nested entities as structs and arrays."""
        return self._nested()[0]

    def map_rows(self, flat: DataFrame) -> DataFrame:
        """Rows of the caller's own as nested entities. Their columns are named as this entity's outputs (aliases or keys, in any case); fields without a
        column are left out."""
        have = {c.lower() for c in flat.columns}
        outputs = {name_of(k, f).lower(): Output(k, f.nest_path or k, f) for k, f in self.entity.fields.items() if name_of(k, f).lower() in have}
        return nest(flat, self.entity, Compiled("", [], outputs), [])

    def execute(self) -> tuple[list[Row], Compiled]:
        return self.rows(), self.compile()

    def rows(self) -> list[Row]:
        df, written = self._flat()
        try:
            return df.collect()
        finally:
            if written:
                written.close()

    def objects(self) -> list[dict]:
        df, written = self._nested()
        try:
            return to_objects(df, self.entity)
        finally:
            if written:
                written.close()

    def _one(self) -> Query:
        q = copy.copy(self)
        q.state = copy.copy(self.state)
        q.state.limit = 1
        return q

    def first_row(self) -> Row | None:
        got = self._one().rows()
        return got[0] if got else None

    def first(self) -> dict | None:
        """The first entity. Its arrays have one item at most, as the limit counts joined rows."""
        got = self._one().objects()
        return got[0] if got else None

    def count_df(self) -> DataFrame:
        """Joined rows that fit the conditions; selection, distinct, order and extent don't matter."""
        return self.catalog.sql(*self.compiler.scalar(self.state, "COUNT(*) AS `count`"))

    def count(self) -> int:
        return int(self.count_df().first()["count"])

    def exists_df(self) -> DataFrame:
        """One row, with a truth value."""
        sql, args = self.compiler.scalar(self.state, "1")
        return self.catalog.sql(sql + " LIMIT 1", args).agg((F.count(F.lit(1)) > 0).alias("exists"))

    def exists(self) -> bool:
        return bool(self.exists_df().first()["exists"])

    def pages(self, size: int = 1000) -> Pages:
        """With a limit, its rows and those of the offset before them: pages don't skip the offset."""
        whole = copy.copy(self)
        whole.state = copy.copy(self.state)
        if self.state.limit is not None:
            whole.state.limit += self.state.offset
        whole.state.offset, most = 0, whole.state.limit
        if whole._far():  # all rows are written then, and as many paged
            whole.state.limit = None
        return Pages(self._in_order(whole.state), size, most)


def query(entity: Entity, catalog: Catalog) -> Query:
    return Query(entity, catalog)


def run_query(entity: Entity, catalog: Catalog) -> list[dict]:
    return query(entity, catalog).objects()
