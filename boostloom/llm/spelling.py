"""Spelling variants: words that differ by one code point, found by rolling hashes of their deletions.

1. Words are counted in Spark; those that come often enough are the vocabulary.
2. `mapInArrow` hashes each word without each of its code points by NumPy: the polynomial hash of the
   code points before, plus that of those after, moved by one place.  Two words that differ in one replaced code
   point share the hash of a deletion at the same place; a word with one more shares one with the whole other word.
3. Keys are dealt out by their first bits, sorted by NumPy, and those that only one word has are dropped.  Rows
   hold numbers only, so a very long word costs in proportion to its length.
4. What is left meets its strings; windows over (key, place, string without the code point) settle collisions
   of hashes and give each word its number of near words and the most frequent one.  Groups are small by nature: words that
   agree but for one code point at a given place are as many as there are letters, at most.
5. Forms are followed to their ends by pointer jumping; n at least doubles from a word to its form, so chains are short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boostloom.llm import words as W
from boostloom.llm.shared import written

#: Runs of these are words.
RUN = "[A-Za-z\u00c0-\u00ff]+"
#: Keys that are sorted in one piece, about.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What an entry stands for: a deletion that a replacement shares, a deletion that a whole word equals, a whole word.
REPLACED, CUT, WHOLE = 0, 1, 2


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 5, least_count: int = 3, typo: int | None = 97) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z in lower case, that come often enough.

    With `typo`, a run whose crc32 (of id, `:` and the run) it divides loses the code point number crc32 % length.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    runs = texts.select("i", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("run")).filter(F.char_length("run") >= least_length)
    ascii_only = F.octet_length("run") == F.char_length("run")
    runs = runs.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)))
    word = F.col("run")
    if typo is not None:
        h = F.crc32(F.concat("i", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        word = F.when(h % typo == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(word)
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, place, kind) of all entries of the words; place is -1 for whole words.

    A CUT entry stands for the first of several equal deletions (one from a run of equal code points).
    """
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    length = np.array([len(w) for w in words], np.int64)
    start = np.r_[0, np.cumsum(length)]
    owner = np.repeat(np.arange(len(words)), length)
    index = np.arange(len(code))
    ones = np.ones(len(code) + 2, np.uint64)
    ones[1:] = np.uint64(_BASE)
    power = np.cumprod(ones, dtype=np.uint64)
    ones[1:] = np.uint64(pow(_BASE, -1, 2**64))
    back = np.cumprod(ones, dtype=np.uint64)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[: len(code)], out=total[1:], dtype=np.uint64)
    first, end = start[owner], start[owner + 1]
    before = (total[index] - total[first]) * back[first]
    after = (total[end] - total[index + 1]) * back[first + 1]
    rest = before + after
    place = index - first
    whole = (total[start[1:]] - total[start[:-1]]) * back[start[:-1]]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    key = np.concatenate([W.mix(rest ^ ((place.astype(np.uint64) + np.uint64(1)) * _PLACE)), W.mix(rest[new]), W.mix(whole)])
    kind = np.repeat(np.array([REPLACED, CUT, WHOLE]), [len(rest), int(new.sum()), len(words)])
    return key, np.concatenate([owner, owner[new], np.arange(len(words))]), np.concatenate([place, place[new], np.full(len(words), -1)]), kind


_ENTRY = "radix int, key long, id long, place int, kind int"


def _entries(bits: int, at_once: int = 1 << 18):
    """Entries of (id, word) rows, with the key's first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in W.slices(batch, "word", at_once):
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                key, owner, place, kind = deletion_keys(rows.column(1).to_pylist())
                radix = (key >> np.uint64(64 - bits)).astype(np.int32)
                columns = [radix, key.view(np.int64), ids[owner], place.astype(np.int32), kind.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["radix", "key", "id", "place", "kind"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The entries of one radix whose key others have, too."""
    table = table.drop(["radix"])
    key = table.column("key").to_numpy()
    by = np.argsort(key, kind="stable")
    sorted_key = key[by]
    same = sorted_key[1:] == sorted_key[:-1]
    several = np.r_[False, same] | np.r_[same, False] if len(key) else np.zeros(0, bool)
    return table.take(pa.array(by[several]))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best, a struct of -n and the near word that comes most (ties: the smallest), for words that have some."""
    numbered = words.select(F.xxhash64("word").alias("id"), "word", "n")
    total = words.agg(F.sum(2 * F.char_length("word") + 1)).first()[0] or 0
    bits = max(6, math.ceil(math.log2(max(1.0, total / PIECE))))
    entries = numbered.select("id", "word").mapInArrow(_entries(bits), _ENTRY)
    shared = entries.groupBy("radix").applyInArrow(_shared, "key long, id long, place int, kind int")
    of = numbered.select(F.col("id").alias("word_id"), "word", "n")
    met = shared.join(of, F.col("id") == F.col("word_id"))
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.substr("word", F.lit(1), F.col("place")), F.substr("word", F.col("place") + 2)))
    met = met.select("key", F.when(F.col("kind") == REPLACED, F.col("place")).otherwise(-1).alias("place"), rest.alias("rest"), (F.col("kind") == WHOLE).alias("whole"), "word", "n", F.struct((-F.col("n")).alias("less"), F.col("word").alias("word")).alias("o"))
    group = Window.partitionBy("key", "place", "rest")
    ordered = group.orderBy("o").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    replaced = F.col("place") >= 0
    met = met.select(
        "*",
        F.count(F.lit(1)).over(ordered).alias("all"),
        F.sum(F.col("whole").cast("long")).over(ordered).alias("wholes"),
        F.first("o").over(ordered).alias("first"),
        F.nth_value("o", 2).over(ordered).alias("second"),
        F.min(F.when(F.col("whole"), F.col("o"))).over(ordered).alias("whole_one"),
        F.min(F.when(~F.col("whole"), F.col("o"))).over(ordered).alias("cut_one"),
    )
    near = F.when(replaced, F.col("all") - 1).when(F.col("whole"), F.col("all") - F.col("wholes")).otherwise(F.col("wholes"))
    best = F.when(replaced, F.when(F.col("first") == F.col("o"), F.col("second")).otherwise(F.col("first"))).when(F.col("whole"), F.col("cut_one")).otherwise(F.col("whole_one"))
    found = met.select("word", near.alias("near"), best.alias("best")).filter("near > 0")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """start, root: the end of the chain of forms from each word that has one; (word, form) are jumped over until all are at an end."""
    links = written(forms.select(F.col("word").alias("start"), F.col("form").alias("root")))
    while True:
        on = links.select(F.col("start").alias("on"), F.col("root").alias("to"))
        jumped = links.join(on, F.col("root") == F.col("on"), "left").select("start", F.coalesce("to", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        after = written(jumped)
        links = after.select("start", "root")
        if after.filter("moved").limit(1).count() == 0:
            return links


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = 5, least_count: int = 3, typo: int | None = None, factor: float = 2.0) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary (see word_counts()).

    Two words are near if they differ by one inserted, deleted or replaced code point.  A word's form is its near word
    that comes most (ties: the smallest in the order of code points), if that comes `factor` times as often or more (over 1,
    so that chains end); root is the end of the chain of forms, the word itself if it has none.  Null texts have no
    words, null ids count as empty, repeated rows count each time, other columns are ignored, whatever their
    names.  An empty table, or texts without frequent words, give no rows.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = written(word_counts(docs, text_col, id_col, least_length, least_count, typo))
    near = near_words(words).select(F.col("word").alias("near_word"), "n_near", "best")
    joined = words.join(near, F.col("word") == F.col("near_word"), "left")
    best_n = -F.col("best.less")
    enough = best_n >= factor * F.col("n")
    found = written(joined.select("word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, best_n).alias("form_n")))
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, F.col("word") == F.col("start"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
