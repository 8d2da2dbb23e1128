"""Embedding near-dedup by a dual traversal of cover trees.

Vectors are scaled to length one, where a cosine of c is a distance of sqrt(2 - 2c).  The upper level of
the tree is spread over the cluster: each label has centres from a bounded sample, each vector lives at
its nearest centre, and it also visits the later centres whose covering radius it may reach into.  A
centre's residents and visitors then meet in chunks of bounded size.  There, cover trees of nested levels
with halving radii are traversed in pairs: a pair of nodes is dropped when their centres are further
apart than their covering radii and the threshold allow, and taken as a whole when all of it must be
linked; what is left is compared exactly.

Links are counted, not listed: a chunk returns each vector's number of links and a spanning forest.
Rows of one vector and label are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.llm import vectors as V
from boostloom.llm.shared import components, written

#: Vectors of a chunk, and of a centre as intended.
CHUNK = 1500
#: More than rounding can move a distance.
SLACK = 1e-6
#: A node of so few vectors is a leaf.
LEAF = 4


class Tree:
    """A cover tree over unit vectors: nodes with a centre, a covering radius and a span of the order."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        if len(x):
            self._grow(0, len(x), 0, 2.0)
        self.centers = x[np.array(self.center, int)] if len(x) else x
        self.radii = np.array(self.radius)

    def _add(self, a: int, b: int, center: int, radius: float) -> int:
        self.center.append(center)
        self.radius.append(radius)
        self.span.append((a, b))
        self.children.append(np.zeros(0, int))
        return len(self.center) - 1

    def _grow(self, a: int, b: int, center: int, reach: float) -> int:
        """The node of order[a:b], all within `reach` of its centre; its children's balls have half of that."""
        todo = [(self._add(a, b, center, 0.0), reach)]
        while todo:
            node, reach = todo.pop()
            a, b = self.span[node]
            mine = self.order[a:b].copy()
            d = distance(self.x[mine], self.x[self.center[node]])
            self.radius[node] = float(d.max())
            if b - a <= LEAF or self.radius[node] <= SLACK:
                continue
            while reach / 2 >= self.radius[node]:  # levels with one node only
                reach /= 2
            left, at, kids, center = mine, a, [], self.center[node]
            while len(left):
                d = distance(self.x[left], self.x[center])
                inside = d <= reach / 2
                n = int(inside.sum())
                self.order[at : at + n] = left[inside]
                kid = self._add(at, at + n, center, 0.0)
                kids.append(kid)
                if n > 1:
                    todo.append((kid, reach / 2))
                left, at = left[~inside], at + n
                center = int(left[0]) if len(left) else -1
            self.children[node] = np.array(kids)
        return 0


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Links:
    """Counts of links by position, and a forest over positions of both sides."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)
        self.root = np.arange(n)
        self.forest: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.forest.append((i, j))


def traverse(raw: np.ndarray, copies: np.ndarray, sides: tuple[np.ndarray, np.ndarray], threshold: float, itself: bool) -> Links:
    """Links between two sides (positions in `raw`), or within the first, by cosine >= threshold.

    raw are the vectors as given; a link counts the other node's copies.
    """
    norm = np.sqrt((raw * raw).sum(1))
    unit = raw / norm[:, None]
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    trees = [Tree(unit[s]) for s in (sides[:1] if itself else sides)]
    if itself:
        trees.append(trees[0])
    out = Links(len(raw))
    if not len(trees[0].center) or not len(trees[1].center):
        return out
    place = [sides[0], sides[0] if itself else sides[1]]
    a, b = trees

    def exact(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        cosine = (raw[p] @ raw[q].T) / (norm[p][:, None] * norm[q][None])
        near = cosine >= threshold
        if same:
            near = np.triu(near, 1)
        for i, j in zip(*np.nonzero(near), strict=True):
            link(p[i], q[j])

    def link(i: int, j: int) -> None:
        out.count[i] += copies[j]
        out.count[j] += copies[i]
        out.join(i, j)

    def members(t: int, node: int) -> np.ndarray:
        s, e = trees[t].span[node]
        return place[t][trees[t].order[s:e]]

    stack = [(0, 0)]
    while stack:
        m, n = stack.pop()
        same = itself and m == n
        ka = a.children[m] if len(a.children[m]) else np.array([m])
        kb = b.children[n] if len(b.children[n]) else np.array([n])
        if len(ka) == 1 and ka[0] == m and len(kb) == 1 and kb[0] == n:
            exact(members(0, m), members(1, n), same)
            continue
        d = distance(a.centers[ka], b.centers[kb])
        both = a.radii[ka][:, None] + b.radii[kb][None]
        near = d <= both + reach + SLACK
        if same:
            near = np.triu(near)
        whole = near & (d + both <= reach - SLACK)
        if same:
            whole &= ~np.eye(len(ka), dtype=bool)
        for i, j in zip(*np.nonzero(whole), strict=True):
            p, q = members(0, ka[i]), members(1, kb[j])
            out.count[p] += copies[q].sum()
            out.count[q] += copies[p].sum()
            for x in p:
                out.join(x, q[0])
            for y in q:
                out.join(p[0], y)
        stack.extend((int(ka[i]), int(kb[j])) for i, j in zip(*np.nonzero(near & ~whole), strict=True))
    return out


def _chunk(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(rows["vector"].to_numpy()).astype(float)
        ids, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        sides = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links = traverse(raw, rows["copies"].to_numpy(), sides, threshold, not len(sides[1])) if len(sides[0]) else Links(len(ids))
        counted = np.flatnonzero(links.count)
        a = [int(ids[i]) for i, _ in links.forest]
        b = [int(ids[j]) for _, j in links.forest]
        return pd.DataFrame({"a": [*ids[counted].tolist(), *a], "b": pd.array([*[None] * len(counted), *b], "Int64"), "n": [*links.count[counted].tolist(), *[0] * len(a)]})

    return run


def centres(sample: pd.DataFrame, sizes: dict[str, int], most: int) -> dict[str, np.ndarray]:
    """For each label one unit vector for each CHUNK of its nodes (at most `most` in all), each far from those before."""
    share = min(1.0, most / max(1, sum(-(-n // CHUNK) for n in sizes.values())))
    out = {}
    for label, rows in sample.groupby("label"):
        x = np.stack(rows["vector"].to_numpy()).astype(float)
        x /= np.sqrt((x * x).sum(1))[:, None]
        n = max(1, min(len(x), int(-(-sizes[label] // CHUNK) * share)))
        chosen, d = [0], distance(x, x[0])
        while len(chosen) < n:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, distance(x, x[chosen[-1]]))
        out[label] = x[chosen]
    return out


def _by_label(batch: pa.RecordBatch, of: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(label, rows, their unit vectors) for labels with centres; vectors of one label have one length."""
    labels = np.array(batch.column(1).to_pylist(), object)
    for label in sorted(set(labels) & of.keys()):
        mine = np.flatnonzero(labels == label)
        x = V.matrix(batch.column(2).take(pa.array(mine)))
        yield label, mine, x / np.sqrt((x * x).sum(1))[:, None]


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            home, d = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.nan)
            for label, mine, unit in _by_label(batch, of):
                far = distance(unit, of[label])
                home[mine], d[mine] = far.argmin(1), far.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(d, mask=np.isnan(d))], names=["node", "label", "vector", "copies", "home", "far"])

    return run


def _visits(shared, reach: float):
    """Each node at its home (side 0) and at later centres that it may reach into (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, radii = shared.value
        for batch in batches:
            n, home = batch.num_rows, batch.column(4).to_numpy()
            row, centre = [np.arange(n)], [home.astype(np.int64)]
            for label, mine, unit in _by_label(batch, of):
                near = distance(unit, of[label]) <= radii[label][None] + reach + SLACK
                i, j = np.nonzero(near & (np.arange(len(of[label]))[None] > home[mine][:, None]))
                row.append(mine[i])
                centre.append(j)
            row, centre = np.concatenate(row), np.concatenate(centre)
            side = np.r_[np.zeros(n, np.int32), np.ones(len(row) - n, np.int32)]
            part = batch.take(pa.array(row)).select([0, 1, 2, 3])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(centre, pa.int32()), pa.array(side)], names=["node", "label", "vector", "copies", "centre", "side"])

    return run


def near_dups(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", max_sample: int = 8192, max_centres: int = 2048) -> DataFrame:
    """Exact threshold links between vectors of one label: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and their cosine in double precision is
    at least `threshold` (over -1).  n_links counts the other vectors linked directly, component_id is the
    smallest id that links reach, and kept marks that id.  A row for each row of `vectors`.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; nor do vectors of different lengths.  Equal vectors of one label are linked, whatever their
    number.  Repeated rows (same id, vector and label) are one vector and get equal results; a null id
    links with nothing and its component is null.  Other columns are ignored; an empty table gives no rows.

    The sample for the centres is at most `max_sample` vectors of the `max_centres` largest labels that
    are more than a chunk, and these labels together have at most `max_centres` and one each: that
    bounds what is broadcast, not what is compared.  All other labels are one place each.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    labelled = vectors.filter(F.col(label_col).isNotNull())
    # vectors of different lengths never meet
    key = lambda v: F.concat_ws("/", F.col(label_col).cast("string"), F.size(v).cast("string"))
    named = labelled.withColumn("__label", key(F.col(vector_col)))
    rows = V.rows(named, id_col, vector_col, F.col("__label").alias("label"))
    nodes = rows.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select("node", "label", "vector", "copies"))
    large = nodes.groupBy("label").count().filter(F.col("count") > CHUNK).orderBy(F.desc("count"), "label").limit(max_centres)
    sizes = {r["label"]: r["count"] for r in large.collect()}  # at most max_centres rows
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(label_col).isNotNull() & V.usable(vector_col), F.col(vector_col).cast("array<double>")).alias("v"), key(F.col(vector_col)).alias("l"))
    names = spark.createDataFrame([(label,) for label in sizes], "of string")
    sample = nodes.join(F.broadcast(names), F.col("label") == F.col("of"), "left_semi").orderBy(F.xxhash64("node"), "node").limit(max_sample).toPandas()
    of = centres(sample, sizes, max_centres) if len(sample) else {}  # a label that the sample misses is one place
    homes = nodes.mapInArrow(_homes(spark.sparkContext.broadcast(of)), "node long, label string, vector array<double>, copies long, home int, far double")
    homes = written(homes)
    radii = {label: np.full(len(c), -np.inf) for label, c in of.items()}
    for r in homes.filter("far is not null").groupBy("label", "home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row for each centre
        radii[r["label"]][r["home"]] = r["far"]
    visits = homes.mapInArrow(_visits(spark.sparkContext.broadcast((of, radii)), reach), "node long, label string, vector array<double>, copies long, centre int, side int")
    visits = written(visits)
    place = ["label", "centre"]
    many = visits.groupBy(*place).agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("n0"), F.sum("side").alias("n1"))
    many = many.select(F.col("label").alias("m_label"), F.col("centre").alias("m_centre"), F.greatest(F.ceil(F.col("n0") / CHUNK), F.lit(1)).cast("int").alias("p0"), F.ceil(F.col("n1") / CHUNK).cast("int").alias("p1"))
    many = written(many)  # so that the join reads it by an exchange of its own, and a large place is split where it isn't broadcast
    chunked = visits.join(many, (F.col("label") == F.col("m_label")) & (F.col("centre") == F.col("m_centre")))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1")))
    chunked = chunked.withColumn("part", part.cast("int"))
    # residents meet each chunk of residents and of visitors, visitors each chunk of residents
    residents = F.transform(F.sequence(F.lit(0), F.col("p0") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), F.when(F.col("part") <= o, 0).otherwise(1).alias("s")))
    guests = F.when(F.col("p1") > 0, F.transform(F.sequence(F.lit(1), F.greatest("p1", F.lit(1))), lambda o: F.struct(F.col("part").alias("i"), (-o).alias("j"), F.lit(0).alias("s"))))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("p0") - 1), lambda o: F.struct(o.alias("i"), (-F.col("part") - 1).alias("j"), F.lit(1).alias("s")))
    none = F.array().cast("array<struct<i: int, j: int, s: int>>")
    meets = F.when(F.col("side") == 0, F.concat(residents, F.coalesce(guests, none))).otherwise(as_guest)
    met = chunked.withColumn("meet", F.explode(meets)).select(*place, F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), F.col("meet.s").alias("side"), "node", "vector", "copies")
    met = met.repartition(*place, "i", "j")  # not by place alone, as the join may have left it
    found = written(met.groupBy(*place, "i", "j").applyInPandas(_chunk(threshold), "a long, b long, n long"))
    labels = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("c_node")).agg(F.sum("n").alias("n"))
    of_node = nodes.join(counts, F.col("node") == F.col("c_node"), "left").join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
    of_node = of_node.select(F.col("label").alias("n_label"), F.col("vector").alias("n_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = out.join(of_node, F.col("vec_id").isNotNull() & (F.col("l") == F.col("n_label")) & (F.col("v") == F.col("n_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
