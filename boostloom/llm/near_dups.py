"""MinHash near-dedup: ProbMinHash signatures of weighted shingles, banding, and exact verification.

Similarity is the probability Jaccard of the shingles' weights w:
J_P = sum over common d of 1 / sum over d' of max(wA(d')/wA(d), wB(d')/wB(d)),
which for equal weights is the Jaccard similarity of the shingle sets.  A shingle that comes c times
weighs 1 + ln c, so that one line that is repeated all over doesn't make two texts alike.

1. Every text gets a signature.  Rows of one text are one node from then on, so that copies are never
   paired, however many there are.
2. Nodes that agree in all registers of a band share a bucket.  Each node is paired with the least node
   of each of its buckets; pairs that may reach the threshold by their signatures are verified on whole
   shingle counts, the best of each node first.
3. Nodes that verified pairs join are contracted.  In buckets that still hold several components, the nodes
   outside the bucket's largest component meet all others in blocks of bounded size, where pairs across
   components are estimated and verified; blocks return links, not candidates.  Pairs within a
   component can't change any class, so a bucket's work follows its nodes times those outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostloom.llm import words as W
from boostloom.llm.shared import components, small_batches, written

SLICE = 1 << 20
#: Nodes of a side of a block of pairs.
BLOCK = 384
#: Rows of a bucket that one task joins with what is known of the bucket.
SALT = 1024
#: Rows of a batch: what it holds is in memory several times over.
BATCH = 256
#: Standard errors under the threshold down to which an estimate leads to verification.
SLACK = 4.5


def shingles(words: W.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct runs of `width` words; a shorter text is one shingle."""
    hashes, at = W.windows(words, width)
    doc = words.doc[at]
    n = words.counts()
    for d in np.flatnonzero((n > 0) & (n < width)):
        a = np.searchsorted(words.doc, d)
        h = np.array([n[d]], np.uint64)
        for x in words.hash[a : a + n[d]]:
            h = W.mix(h * np.uint64(31) + x)
        hashes, doc = np.r_[hashes, h], np.r_[doc, d]
    by = np.lexsort((hashes, doc))
    hashes, doc = hashes[by], doc[by]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], hashes[new], np.diff(np.r_[new, len(doc)])


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def signatures(doc: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash: n_docs x registers elements, each drawn from a document by weight, alike for alike documents.

    An element arrives again and again, after exponential times of its weight's rate, each time at a
    random register, which keeps its earliest arrival.  An element stops at its first arrival after all
    of its document's registers are taken for good.  Documents without elements get zeros.
    """
    first = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, np.uint64)
    seed, element, owner = W.mix(hashes + np.uint64(0x5851F42D4C957F2D)), hashes, doc
    rate, time = weight.astype(float), np.zeros(len(doc))
    while len(owner):
        seed = W.mix(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        register = (W.mix(seed ^ np.uint64(0xDA942042E4DD58B5)) % np.uint64(registers)).astype(np.int64)
        place = owner * registers + register
        np.minimum.at(first, place, time)
        won = first[place] == time
        who[place[won]] = element[won]
        last = first.reshape(n_docs, registers).max(1)
        on = time < last[owner]
        seed, element, owner, rate, time = seed[on], element[on], owner[on], rate[on], time[on]
    return who.reshape(n_docs, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two (sorted distinct hashes, weights)."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    if a[1].max() == b[1].max() == 1:
        return len(in_a) / (len(a[0]) + len(b[0]) - len(in_a))
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every)), np.zeros(len(every))
    wa[np.searchsorted(every, a[0])], wb[np.searchsorted(every, b[0])] = a[1], b[1]
    common = (wa > 0) & (wb > 0)
    ratios = np.unique(wa[common] / wb[common])
    inverse = np.zeros(len(ratios))
    by_ratio = np.searchsorted(ratios, wa[common] / wb[common])
    for i, r in enumerate(ratios):  # sum of max(wa'/wa, wb'/wb) = sum of max(wa', wb' * wa/wb) / wa
        inverse[i] = np.maximum(wa, wb * r).sum()
    return float((wa[common] / inverse[by_ratio]).sum())


def _features(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                doc, h, count = shingles(W.scan(buffer, offsets, W.PLAIN), width)
                if not len(doc):
                    continue
                have, owner = np.unique(doc, return_inverse=True)
                who = signatures(owner, h, weights(count), len(have), bands * rows)
                keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(have), 1))
                for r in range(rows):
                    keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + who[:, r::rows])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                small = (who & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(have)), part.column(1).take(pa.array(have)), lists, pa.array([x.tobytes() for x in small], pa.binary())],
                    names=["id", "node", "bands", "sig"],
                )

    return run


def _agreeing(cut: float):
    """Pairs whose signatures agree in a share `cut` of registers, with the share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = [float((np.frombuffer(p.as_buffer(), "<u2") == np.frombuffer(q.as_buffer(), "<u2")).mean()) for p, q in zip(batch.column(3), batch.column(4), strict=True)]
            part = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share, pa.float64())], names=["node", "least", "size", "estimate"])
            yield part.filter(pa.array([x >= cut for x in share], pa.bool_()))

    return run


def _shingle_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buffer, offsets in W.slices(batch, "text", SLICE):
                doc, h, count = shingles(W.scan(buffer, offsets, W.PLAIN), width)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [W.pack_sorted(h[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                counts = [W.pack(count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], names=["node", "shingles", "counts"])

    return run


def _bag(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return W.unpack_sorted(shingles), weights(W.unpack(counts).astype(float))


def _verify_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, ca, sb, cb = batch.columns
            keep = [probability_jaccard(_bag(w.as_py(), x.as_py()), _bag(y.as_py(), z.as_py())) >= threshold for w, x, y, z in zip(sa, ca, sb, cb, strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


_BLOCK_ROWS = "bucket long, i int, j int, side int, major boolean, node long, component long, sig binary, bands array<long>"


def _sides(table: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    """The block's two sides: nodes outside the largest component (0), and nodes that they meet (1)."""
    out = []
    for side in (0, 1):
        x = table[table["side"] == side]
        if not len(x):
            return []
        out.append({"at": x.index.to_numpy(), "node": x["node"].to_numpy(), "component": x["component"].to_numpy(), "major": x["major"].to_numpy(bool), "sig": np.stack([np.frombuffer(v, "<u2") for v in x["sig"]]), "bands": np.stack(x["bands"].to_numpy())})
    return out


def _pairs(table: pd.DataFrame, cut: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers of pairs in different components that agree in a share `cut` of registers, by the row on the left.

    Of two nodes outside the largest component, the smaller stands on the left.  A pair that shares several
    buckets is taken in the first of its bands only.
    """
    sides = _sides(table)
    if not sides:
        return
    bucket, (left, right) = table["bucket"].iloc[0], sides
    for k in range(len(left["node"])):
        m = np.flatnonzero((right["component"] != left["component"][k]) & (right["major"] | (right["node"] > left["node"][k])))
        m = m[(right["sig"][m] == left["sig"][k]).mean(1) >= cut] if len(m) else m
        if len(m):
            same = right["bands"][m] == left["bands"][k]
            m = m[left["bands"][k][same.argmax(1)] == bucket]
        if len(m):
            yield left["at"][k], right["at"][m]


def _involved(cut: float):
    """The rows of a block that are in such a pair."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.reset_index(drop=True)
        hit = np.zeros(len(table), bool)
        for k, m in _pairs(table, cut):
            hit[k] = True
            hit[m] = True
        return table[hit]

    return run


def _verify_block(cut: float, threshold: float):
    """Links of a block between components; pairs whose components earlier links have joined can be left out."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.reset_index(drop=True)
        bags = [_bag(s, c) for s, c in zip(table["shingles"], table["counts"], strict=True)]
        component, node = table["component"].to_numpy(), table["node"].to_numpy()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for k, several in _pairs(table, cut):
            for m in several:
                a, b = find(component[k]), find(component[m])
                if a != b and probability_jaccard(bags[k], bags[m]) >= threshold:
                    root[a] = b
                    out.append((node[k], node[m]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


#: Parts of a bucket that meet its least node apart from each other: a bucket may hold a third of all nodes.
SPREAD = 64


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Adds the component of a node, itself if no link has it."""
    of = labels.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return rows.join(of, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")


def _classes(source: DataFrame, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """(n_node, component_id, classed) for each node, from (id, node, text)."""
    estimate_cut = threshold - SLACK * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    found = source.mapInArrow(_features(width, bands, rows), "id long, node long, bands array<long>, sig binary")
    one = Window.partitionBy("node").orderBy(F.col("id").asc_nulls_first())
    nodes = written(found.withColumn("rank", F.row_number().over(one)).filter("rank = 1").drop("rank"))

    member = nodes.select("node", F.explode("bands").alias("bucket")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)))
    parts = written(member.groupBy("bucket", "salt").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("size")))
    least = parts.groupBy("bucket").agg(F.min("least").alias("least"), F.sum("size").alias("size")).filter("size > 1")
    least = parts.select(F.col("bucket").alias("b"), "salt").join(least, F.col("b") == F.col("bucket")).select("bucket", "salt", "least", "size")
    bucketed = written(member.join(least, ["bucket", "salt"]).select("bucket", "node", "least", "size"))
    to_least = bucketed.filter("node <> least").groupBy("node", "least").agg(F.min("size").alias("size"))
    sig_a = nodes.select(F.col("node").alias("n_a"), F.col("sig").alias("sig_a"))
    sig_b = nodes.select(F.col("node").alias("n_b"), F.col("sig").alias("sig_b"))
    estimated = to_least.join(sig_a, F.col("node") == F.col("n_a")).join(sig_b, F.col("least") == F.col("n_b"))
    estimated = estimated.select("node", "least", "size", "sig_a", "sig_b")
    estimated = written(estimated.mapInArrow(_agreeing(estimate_cut), "node long, least long, size long, estimate double"))

    best = estimated.groupBy("node").agg(F.max_by("least", F.struct("estimate", "least")).alias("least"))
    # only texts that may be in a pair are needed again
    mid = bucketed.filter("size > 2").select("node").union(estimated.select("node")).union(estimated.select("least")).distinct()
    wanted = mid.join(nodes.select("node", "id"), "node").select(F.col("node").alias("w_node"), F.coalesce("id", F.lit(-(2**63))).alias("w_id"))
    texts = source.join(wanted, (F.col("node") == F.col("w_node")) & (F.coalesce("id", F.lit(-(2**63))) == F.col("w_id"))).select("node", "text")
    bags = written(texts.mapInArrow(_shingle_rows(width), "node long, shingles binary, counts binary"))

    links = _verified(best.select(F.col("node").alias("a"), F.col("least").alias("b")), bags, threshold)
    labels = components(links)
    rest = _labelled(_labelled(estimated.select("node", "least"), labels, "node", "ca"), labels, "least", "cb").filter("ca <> cb")
    links = written(links.union(_verified(rest.select(F.col("node").alias("a"), F.col("least").alias("b")), bags, threshold)))
    labels = components(links)

    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SALT)).cast("int")
    several = written(_labelled(bucketed.filter("size > 2").select("bucket", "node", "size"), labels, "node", "component").withColumn("salt", salt))
    by_component = several.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "component"))
    mixed = by_component.groupBy("bucket").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), largest.alias("largest")).filter("k > 1")
    mixed = mixed.select("bucket", F.col("largest.component").alias("of"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("largest.m")) / BLOCK).cast("int").alias("minor"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT).cast("int") - 1)).alias("salt"))
    rows_of = several.join(mixed, ["bucket", "salt"]).withColumn("major", F.col("component") == F.col("of"))
    group = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    columns = ["bucket", "i", "j", "side", "major", "node", "component"]
    left = rows_of.filter("not major").withColumn("i", group("minor")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    right = rows_of.withColumn("j", group("parts")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("minor") - 1))).withColumn("side", F.lit(1))
    placed = left.select(*columns).union(right.select(*columns))
    blocks = placed.join(nodes.select("node", "sig", "bands"), "node").select(*columns, "sig", "bands")
    involved = written(blocks.groupBy("bucket", "i", "j").applyInPandas(_involved(estimate_cut), _BLOCK_ROWS))
    full = involved.join(bags.dropDuplicates(["node"]), "node")
    links = written(links.union(full.groupBy("bucket", "i", "j").applyInPandas(_verify_block(estimate_cut, threshold), "a long, b long")))
    labels = components(links)

    classes = _labelled(nodes.select("node", "id"), labels, "node", "component")
    smallest = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first"))
    return classes.join(smallest, "component").select(F.col("node").alias("n_node"), F.col("first.id").alias("component_id"), F.lit(True).alias("classed"))


def near_dups(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 30, rows: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Classes of near duplicates: doc_id, component_id, kept, a row for each row of `docs`.

    Two texts are linked if the probability Jaccard of their runs of `width` words (U+0020 and
    U+0009..U+000D part words; a shorter text is one run; weights 1 + ln count) is at least `threshold`; classes are the
    connected components, component_id is the smallest doc_id in the class and `kept` marks its rows.
    All links between different texts that banding proposes are found or implied by others; a pair at a
    similarity s is proposed with probability 1 - (1 - s**rows)**bands (for 0.8 and the defaults, all
    but 7 in a million), and lost by its estimate with less than one in 100,000.

    Null and empty texts and texts without words are in no class but their own row's.  Rows of the same
    text are one class whatever their number; rows that repeat an id are judged by their texts, and both
    are kept if one is.  A null id counts as smaller than all others; its class has a null component_id.
    Other columns are ignored; an empty table gives no rows.  Texts are told apart by 64 bits of their
    MD5 digest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("node"), text.alias("text"))

    with small_batches(docs.sparkSession, BATCH):
        of_node = _classes(source, threshold, width, bands, rows)
    out = source.select("id", "node").join(of_node, F.col("node") == F.col("n_node"), "left")
    component_id = F.when(F.col("classed"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), component_id.alias("component_id"), component_id.eqNullSafe(F.col("id")).alias("kept"))


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    left = bags.select(F.col("node").alias("n_a"), F.col("shingles").alias("s_a"), F.col("counts").alias("c_a"))
    right = bags.select(F.col("node").alias("n_b"), F.col("shingles").alias("s_b"), F.col("counts").alias("c_b"))
    full = pairs.join(left, F.col("a") == F.col("n_a")).join(right, F.col("b") == F.col("n_b"))
    return written(full.select("a", "b", "s_a", "c_a", "s_b", "c_b").mapInArrow(_verify_pairs(threshold), "a long, b long"))
