"""All pairs of entities, compared in tiles of matrices, so that no table of shared keys or of pairs is shuffled.

Entities are hashed to blocks, and a cell is a block of sources with a block of targets. What is shuffled are packed profiles,
once for each cell that needs them; a task compares the pairs of its cell tile by tile and passes on results only.
Every measure is a sum over shared keys: products of matrices, and sums of minima for weighted Jaccard similarities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a tile, its rows, and the keys that are looked at together: they bound the memory of a task, not what is compared.
TILE, TILE_ROWS, TILE_KEYS = 1 << 18, 256, 1024


def pack(entries: DataFrame, key: str, values: list[str], facts: dict[str, Column]) -> DataFrame:
    """``entity``, ``facts`` over all its rows, and ``key`` and ``values`` of its rows with a key, as arrays.

    ``entries`` has one row per ``entity`` and key.
    """
    cells = F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, *values))).alias("__c")
    return entries.groupBy("entity").agg(*[c.alias(n) for n, c in facts.items()], cells).select("entity", *facts, *[F.col(f"__c.{n}").alias(n) for n in (key, *values)])


def _blocks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def strips(packed: DataFrame, is_source: Column) -> DataFrame:
    """Cells of a part of the sources, each with all targets, which are all of ``packed``."""
    n = _blocks(packed)
    own = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.struct(c.alias("cell"), F.lit(1).alias("side")))
    at = F.when(is_source, F.concat(F.array(F.struct(own.alias("cell"), F.lit(0).alias("side"))), whole)).otherwise(whole)
    return packed.select(F.inline(at), *packed.columns).repartitionById(n, F.col("cell"))


def triangle(packed: DataFrame) -> DataFrame:
    """Cells of two blocks of ``packed``, so that each pair meets once (a block with itself in one cell, as both sides)."""
    n = max(1, round((2 * _blocks(packed)) ** 0.5))
    own = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int")
    cell = lambda i, j: F.floor(j * (j + 1) / 2).cast("int") + i
    first = F.transform(F.sequence(F.col("__b"), F.lit(n - 1)), lambda j: F.struct(cell(F.col("__b"), j).alias("cell"), F.lit(0).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("__b")), lambda i: F.struct(cell(i, F.col("__b")).alias("cell"), F.lit(1).alias("side")))
    return packed.withColumn("__b", own).select(F.inline(F.concat(first, second)), *packed.columns).repartitionById(n * (n + 1) // 2, F.col("cell"))


def run(cells: DataFrame, work: Callable[[Side, Side], Iterator], schema: str) -> DataFrame:
    """The rows of ``schema`` that ``work`` makes, as Arrow batches, of the two sides of each cell."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for cell in t["cell"].unique().to_pylist():
                held.setdefault(cell, []).append(t.filter(pa.compute.equal(t["cell"], cell)))
        for cell in list(held):
            t = pa.concat_tables(held.pop(cell))
            yield from work(*(Side(t.filter(pa.compute.equal(t["side"], s))) for s in (0, 1)))

    return cells.mapInArrow(task, schema)


def ahead(batches: Iterator) -> Iterator:
    """``batches``, of which the next is made while one is passed on and written: for results larger than the tables."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as one:
        after = one.submit(next, batches, None)
        while (now := after.result()) is not None:
            after = one.submit(next, batches, None)
            yield now


class Side:
    """The entities of one side of a cell, in the order of their names, with their facts and the keys they have."""

    def __init__(self, t) -> None:
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        names = t["entity"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))  # by code points, like Spark
        t = t.take(pa.array(order, pa.int64())).combine_chunks()
        self.table, self.names, self.size = t, np.array([names[i] for i in order], dtype=object), len(names)
        self._facts: dict = {}

    def fact(self, name: str):
        """A column of facts as numbers, nulls as NaN."""
        if name not in self._facts:
            self._facts[name] = self.table[name].to_numpy()
        return self._facts[name]

    def flat(self, name: str):
        """The values of all entities one after the other."""
        import pyarrow as pa

        return pa.concat_arrays([c.flatten() for c in self.table[name].chunks]) if self.size else pa.array([], self.table.schema.field(name).type.value_type)

    def starts(self, key: str):
        """Where the values of each entity begin, and where the last ones end."""
        import numpy as np
        import pyarrow as pa

        return np.concatenate([[0], np.cumsum(pa.compute.list_value_length(self.table[key]).to_numpy())]).astype(np.int64)


class Tiles:
    """Walks through the tiles of two sides; gives the matrices of their values over the keys that both have."""

    def __init__(self, a: Side, b: Side, key: str, values: list[str]) -> None:
        import numpy as np
        import pyarrow as pa

        self.a, self.b, self.values = a, b, values
        codes = pa.chunked_array([a.flat(key), b.flat(key)]).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        self.starts = [a.starts(key), b.starts(key)]
        n = self.starts[0][-1]
        self.codes = [codes[:n], codes[n:]]
        self.flat = [[x.flat(v).to_numpy(zero_copy_only=False) for v in values] for x in (a, b)]
        self.rows = [np.repeat(np.arange(x.size), np.diff(s)) for x, s in zip((a, b), self.starts, strict=True)]

    def bounds(self, rows: int = TILE_ROWS) -> Iterator[tuple[int, int, int, int]]:
        """The tiles: sources from, to, targets from, to; all targets of some sources before the next sources."""
        width = max(1, TILE // rows)
        for a in range(0, self.a.size, rows):
            for b in range(0, self.b.size, width):
                yield a, min(a + rows, self.a.size), b, min(b + width, self.b.size)

    def parts(self, tile: tuple[int, int, int, int]) -> Iterator[tuple[list, list]]:
        """Of a tile, for some of the common keys at a time: per side a matrix key x entity of ones where the entity has
        the key, and of each value, 0 elsewhere."""
        import numpy as np

        inside = [slice(s[lo], s[hi]) for s, lo, hi in zip(self.starts, tile[::2], tile[1::2], strict=True)]
        seen = [np.unique(c[i]) for c, i in zip(self.codes, inside, strict=True)]
        common = np.intersect1d(*seen, assume_unique=True)
        for k in range(0, len(common), TILE_KEYS):
            some = common[k : k + TILE_KEYS]
            both = []
            for s in (0, 1):
                c = self.codes[s][inside[s]]
                at = np.searchsorted(some, c)
                hit = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == c)
                at, row = at[hit], self.rows[s][inside[s]][hit] - tile[2 * s]
                made = [np.zeros((len(some), tile[2 * s + 1] - tile[2 * s])) for _ in range(1 + len(self.values))]
                for m, v in zip(made, [1.0, *[f[inside[s]][hit] for f in self.flat[s]]], strict=True):
                    m[at, row] = v
                both.append(made)
            yield both[0], both[1]


def least_sums(x, y, into) -> None:
    """Adds to ``into`` the sums over the keys of the smaller of two values; ``x`` and ``y`` are key x entity."""
    import numpy as np

    now = np.empty_like(into)
    for u, v in zip(x, y, strict=True):
        np.minimum(u[:, None], v[None, :], out=now)
        into += now


def nine(x):
    """``x`` in units of the ninth decimal, halves away from zero, as the engines round."""
    import numpy as np

    y = np.abs(x)
    y *= 1e9
    y += 0.5
    np.floor(y, out=y)
    return np.copysign(y, x, out=y)
