"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Three steps, none of which gathers the corpus or one window's occurrences in a task:

1. `mapInArrow` hashes the windows of a slice of documents, keeps the earliest occurrence of each
   hash within the slice (the others are repeats already) and deals the hashes out by range, packed
   as sorted differences.  A passage that a third of all documents share leaves each slice once.
2. For each range, the earliest occurrence of every hash is found; all others are repeats.
3. The repeats of a document are merged into maximal removal intervals and cut from its text.

Windows are compared by a 64-bit mix of two 64-bit polynomials: among n windows, some two different
ones meet with a probability of about n * n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boostloom.llm import words as W

#: Bytes of text whose windows are compared before they are dealt out.
SLICE = 4 << 20
#: Stands for a null id: before all others.
NO_ID = -(2**63)
_LOW = np.uint64(2**63)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First elements and lengths of the runs of consecutive starts within a document; both are sorted."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
    return new, np.diff(np.r_[new, len(doc)])


def _keyed(doc: np.ndarray, start: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> pd.DataFrame:
    """A row for each document: its key, and its repeated windows as packed (first, number) pairs."""
    new, length = _runs(doc, start)
    owner, first = doc[new], start[new]
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cut, np.r_[cut[1:], len(owner)] if len(cut) else cut, strict=True):
        rows.append(np.stack([first[a:b], length[a:b]], 1).astype("<u4").tobytes())
    return pd.DataFrame({"id": ids[owner[cut]], "tag": tags[owner[cut]], "runs": rows})


def _first_windows(width: int, ranges: int):
    schema = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("local", pa.bool_())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pa.compute.sort_indices(batch.column(0), null_placement="at_start")
            batch = batch.take(order)
            for rows, buffer, offsets in W.slices(batch, "text", SLICE):
                words = W.scan(buffer, offsets, W.PLAIN)
                hashes, at = W.windows(words, width)
                if not len(hashes):
                    continue
                ids, tags = _ids(rows.column(0)), rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(words.counts(), out=begin[1:])
                # position grows with (id, start) but for rows that share an id
                rank = np.r_[0, np.cumsum(ids[1:] != ids[:-1])] if len(ids) else ids
                by = np.argsort(hashes, kind="stable")
                hashes, at = hashes[by], at[by]
                new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                shared = len(np.unique(ids)) < len(ids)
                if shared:  # the earliest is by (id, start)
                    key = rank[words.doc[at]].astype(np.int64) << 32 | (at - begin[words.doc[at]])
                    by = np.lexsort((at, key, hashes))
                    hashes, at, key = hashes[by], at[by], key[by]
                    least = np.repeat(key[new], np.diff(np.r_[new, len(key)]))
                    repeat = key > least
                    keep = np.zeros(len(at), bool)
                    keep[new] = True
                    keep |= ~repeat
                else:
                    keep = np.zeros(len(at), bool)
                    keep[new] = True
                    repeat = ~keep
                gone = np.sort(at[repeat])
                hashes, at = hashes[keep], at[keep]
                part = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cut = np.searchsorted(part, np.arange(ranges + 1))
                head = _head(ids, tags, begin)
                out = []
                for p in range(ranges):
                    a, b = cut[p], cut[p + 1]
                    if a < b:
                        out.append((p, join_blobs([*head, W.pack_sorted(hashes[a:b]), W.pack(at[a:b].astype(np.uint64))]), False))
                if len(gone):
                    doc = words.doc[gone]
                    rows_of = _keyed(doc, gone - begin[doc], ids, tags)
                    out.append((int(hashes[0] % np.uint64(ranges)), join_frame(rows_of), True))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=schema.field(i).type) for i in range(3)], schema=schema)

    return deal


def _head(ids: np.ndarray, tags: np.ndarray, begin: np.ndarray) -> list[bytes]:
    return [W.pack_sorted(ids.astype(np.int64).view(np.uint64) ^ _LOW), W.pack(tags.astype(np.uint64)), W.pack_sorted(begin.astype(np.uint64))]


def join_blobs(blobs: list[bytes]) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], dtype="<u4").tobytes() + b"".join(blobs)


def split_blobs(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sizes = np.frombuffer(blob, "<u4", n, 4)
    at = 4 * (n + 1) + np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    return [blob[at[i] : at[i + 1]] for i in range(n)]


def join_frame(rows: pd.DataFrame) -> bytes:
    return join_blobs([rows["id"].to_numpy(np.int64).tobytes(), rows["tag"].to_numpy(np.int64).tobytes(), *rows["runs"]])


def _split_frame(blob: bytes) -> pd.DataFrame:
    parts = split_blobs(blob)
    return pd.DataFrame({"id": np.frombuffer(parts[0], np.int64), "tag": np.frombuffer(parts[1], np.int64), "runs": parts[2:]})


def _repeats(table: pa.Table, buckets: int) -> pa.Table:
    """Windows of one range that aren't the earliest with their hash, packed by bucket of documents."""
    frames, heads, hashes, where, owner, ranks = [], [], [], [], [], []
    for blob, local in zip(table.column("blob").to_pylist(), table.column("local").to_pylist(), strict=True):
        if local:
            frames.append(_split_frame(blob))
            continue
        parts = split_blobs(blob)
        ids = (W.unpack_sorted(parts[0]) ^ _LOW).view(np.int64)
        begin = W.unpack_sorted(parts[2]).astype(np.int64)
        at = W.unpack(parts[4]).astype(np.int64)
        doc = np.searchsorted(begin, at, side="right") - 1
        heads.append((ids, W.unpack(parts[1]).astype(np.int64)))
        hashes.append(W.unpack_sorted(parts[3]))
        where.append(at - begin[doc])
        owner.append(doc)
    if hashes:
        base = np.r_[0, np.cumsum([len(x[0]) for x in heads])]
        ids, tags = np.concatenate([x[0] for x in heads]), np.concatenate([x[1] for x in heads])
        h, start = np.concatenate(hashes), np.concatenate(where).astype(np.int64)
        doc = np.concatenate([x + b for x, b in zip(owner, base, strict=False)])
        by = np.argsort(h)
        same = h[by]
        several = np.r_[False, same[1:] == same[:-1]]
        several[:-1] |= several[1:]
        by = by[several]  # windows that came once only are settled
        h, start, doc = h[by], start[by], doc[by]
        by = np.lexsort((start, ids[doc], h))
        h, start, doc = h[by], start[by], doc[by]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        first = np.repeat(new, np.diff(np.r_[new, len(h)]))
        repeat = (ids[doc] > ids[doc[first]]) | (start > start[first]) if len(h) else np.zeros(0, bool)
        doc, start = doc[repeat], start[repeat]
        by = np.lexsort((start, doc))
        frames.append(_keyed(doc[by], start[by], ids, tags))
    out = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"id": [], "tag": [], "runs": []})
    bucket = (W.mix(out["id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64) if len(out) else np.zeros(0, np.int64)
    by = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    rows = [(b, join_frame(out.iloc[by[cut[b] : cut[b + 1]]])) for b in range(buckets) if cut[b] < cut[b + 1]]
    return pa.table({"bucket": pa.array([x[0] for x in rows], pa.int32()), "blob": pa.array([x[1] for x in rows], pa.binary())})


def _gather(table: pa.Table) -> pa.Table:
    """One row for each document that has repeated windows, with all of them."""
    runs: dict[tuple[int, int], list[bytes]] = {}
    for blob in table.column("blob").to_pylist():
        rows = _split_frame(blob)
        for i, t, r in zip(rows["id"].tolist(), rows["tag"].tolist(), rows["runs"], strict=True):
            runs.setdefault((i, t), []).append(r)
    return pa.table(
        {
            "id": pa.array([k[0] for k in runs], pa.int64()),
            "tag": pa.array([k[1] for k in runs], pa.int64()),
            "runs": pa.array([b"".join(x) for x in runs.values()], pa.binary()),
        }
    )


def _cut(width: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).cast(pa.large_binary()), batch.column(0)
            all_runs = batch.column(2)
            counts, removed, digests, spans, kept_texts = [], [], [], [], []
            for text, runs in zip(texts, all_runs, strict=True):
                text, runs = text.as_py(), runs.as_py()
                words = text.split() if text is not None else []
                n, mine = len(words), []
                if runs:
                    found = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64)
                    mine = merged(found[:, 0], found[:, 0] + found[:, 1] + width - 1)
                    for a, b in reversed(mine):
                        del words[a:b]
                kept = b" ".join(words)
                counts.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    spans.append([{"begin": a, "end": b} for a, b in mine])
                    kept_texts.append(None if text is None else (kept.decode() if mine else text.decode()))
            columns = [ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept_texts, pa.string())]
                names += ["removed", "kept_text"]
            if batch.num_columns > 3:
                columns.append(batch.column(3))
                names.append("row")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals that cover the same words."""
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
    last = np.r_[new[1:] - 1, len(begin) - 1]
    return [(int(a), int(b)) for a, b in zip(begin[new], end[last], strict=True)]


def substring_dedup(docs: DataFrame, width: int = 20, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True, with_row: bool = False) -> DataFrame:
    """Cut every word that a window of `width` words covers whose sequence also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start; windows are judged on the input.
    Words are runs without U+0020 and U+0009..U+000D.  Returns a row for each row of `docs`: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, `with_text`, the
    removed intervals of word positions and kept_text (the text itself where nothing was removed), and,
    `with_row`, row, a struct of the row's own columns.

    Null and empty texts and texts under `width` words keep all they have (a null kept_text stays null).
    A null id counts as smaller than all others.  Rows that share an id are one place in the order: the
    same window at the same start in two of them removes nothing, so repeated rows get equal results.
    Columns other than the two named are ignored, whatever their names.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 2 * buckets
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[row] * with_row)
    tag = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))  # tells rows of one id apart
    rows = rows.withColumn("tag", tag.cast("long"))
    dealt = rows.select("id", "text", "tag").mapInArrow(_first_windows(width, ranges), "part int, blob binary, local boolean")
    found = dealt.groupBy("part").applyInArrow(lambda table: _repeats(table, buckets), "bucket int, blob binary")
    marks = found.groupBy("bucket").applyInArrow(_gather, "id long, tag long, runs binary")
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    marks = marks.select(F.col("id").alias("mark_key"), F.col("tag").alias("mark_tag"), "runs")
    joined = keyed.join(marks, (F.col("key") == F.col("mark_key")) & (F.col("tag") == F.col("mark_tag")), "left")
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string" + ", removed array<struct<begin: long, end: long>>, kept_text string" * with_text)
    if with_row:  # names of any characters
        schema = schema.add(rows.schema["row"])
    return joined.select("id", "text", "runs", *["row"] * with_row).mapInArrow(_cut(width, with_text), schema)
