"""Fill-in-middle: texts cut at two units and put together anew, as relations of units.

A unit is a run of A-Z and a-z or one other code point.  Units stand in blocks of `BLOCK`, which one
pattern matches, so the block of a unit follows from its ordinal.  The relational steps are:

1. `posexplode` of a text's blocks; a window's running sum says how many code points stand before each;
2. the two cuts of a document, as ordinals of units, are joined to the blocks that they fall in;
3. `posexplode` of those blocks' units, a window's running sum of their lengths, and the row of the
   wanted ordinal; the two offsets are aggregated by document;
4. `substring` of the text by the offsets.

A table with a row for every unit of every text would have some 15 times the bytes of the texts, all to
be sorted; with blocks it is a quarter of them.  Texts are dealt out once, by (id, hash of the text);
windows, joins and aggregates follow that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a block.
BLOCK = 64
UNIT = "[A-Za-z]+|[^A-Za-z]"
_BLOCKS = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"
#: Stand before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column) -> list[Column]:
    """Four numbers under 2**32 of each id: the first digits of the SHA-256 of `1:` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _blocks(texts: DataFrame) -> DataFrame:
    """key, at, block and `before`, the code points of the text that stand before it."""
    rows = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(_BLOCKS), F.lit(0))).alias("at", "block"))
    so_far = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.char_length("block")).over(so_far), F.lit(0)))


def _requests(texts: DataFrame) -> DataFrame:
    """key, n, which (1, 2) and the unit that the prefix (1) or the middle (2) ends with; 0: before all units."""
    counted = texts.select("key", F.regexp_extract_all("text", F.lit(_BLOCKS), F.lit(0)).alias("blocks"))
    last = F.regexp_count(F.element_at("blocks", -1), F.lit(UNIT))
    n = F.when(F.size("blocks") > 0, (F.size("blocks") - 1).cast("long") * BLOCK + last).otherwise(F.lit(0).cast("long"))
    counted = counted.select("key", n.alias("n"))
    one, two = (h % (F.col("n") + 1) for h in draws(F.col("key.doc_id"))[:2])
    ends = F.array(F.least(one, two), F.greatest(one, two))
    return counted.select("key", "n", F.posexplode(ends).alias("which", "ordinal")).withColumn("which", F.col("which") + 1)


def _offsets(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """key, n, and the code points that the prefix (a) and prefix and middle (b) have."""
    r, b = requests.alias("r"), blocks.alias("b")
    block = F.when(F.col("r.ordinal") > 0, F.floor((F.col("r.ordinal") - 1) / BLOCK))
    # bounds instead of an equality: the join keeps to the partitioning by key
    hit = r.join(b, (F.col("r.key") == F.col("b.key")) & (F.col("b.at") >= block) & (F.col("b.at") <= block), "left")
    units = hit.select("r.key", "n", "which", "ordinal", "before", F.posexplode_outer(F.regexp_extract_all("block", F.lit(UNIT), F.lit(0))).alias("pos", "unit"))
    so_far = Window.partitionBy("key", "which").orderBy("pos")
    summed = units.withColumn("chars", F.col("before") + F.sum(F.char_length("unit")).over(so_far))
    wanted = summed.filter((F.col("ordinal") == 0) | (F.col("pos") == (F.col("ordinal") - 1) % BLOCK))
    end = lambda k: F.coalesce(F.max(F.when(F.col("which") == k, F.col("chars"))), F.lit(0).cast("long"))
    return wanted.groupBy("key").agg(F.first("n").alias("n"), end(1).alias("a"), end(2).alias("b"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of; texts that hold a mark are plain, so each mark stands once."""
    p, s, m = marks
    between = lambda first, second: F.substring_index(F.substring_index(output, first, -1), second, 1)
    psm = F.concat(between(p, s), F.substring_index(output, m, -1), between(s, m))
    spm = F.concat(between(p, m), F.substring_index(output, m, -1), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), text and output, for each row of `docs`.

    Cuts follow from the id (see draws()) and n alone.  `plain` of 100 texts stay as they are, as do empty texts
    and those that hold a mark; `spm` of 100 others have the suffix first, the rest the prefix.  Null texts
    count as empty, null ids as an empty id.  Repeated rows get equal results; rows of one id with different texts
    are told apart by 64 bits of a hash.  Columns other than the two named are ignored, whatever their names.  An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))
    rows = docs.select(key.alias("key"), text.alias("text")).repartition("key")  # two columns: all readers of the exchange can share it
    texts = rows.dropDuplicates(["key"])
    offsets = _offsets(_requests(texts), _blocks(texts))
    joined = rows.join(offsets, "key")
    a, b, whole = F.col("a"), F.col("b"), F.col("text")
    part = [F.substr(whole, F.lit(1), a.cast("int")), F.substr(whole, (a + 1).cast("int"), (b - a).cast("int")), F.substr(whole, (b + 1).cast("int"))]
    _, _, third, fourth = draws(F.col("key.doc_id"))
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(whole, F.lit(mark))
    form = F.when((whole == "") | held | (third % 100 >= 100 - plain), "plain").when(fourth % 100 < spm, "spm").otherwise("psm")
    p, s, m = (F.lit(x) for x in marks)
    cut = joined.select("key.doc_id", "n", form.alias("form"), "a", "b", "text", *[x.alias(f"part{i}") for i, x in enumerate(part)])
    psm = F.concat(p, "part0", s, "part2", m, "part1")
    spm_ = F.concat(s, "part2", p, "part0", m, "part1")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    not_plain = F.col("form") != "plain"
    return cut.select("doc_id", "n", "form", F.when(not_plain, a).alias("prefix_chars"), F.when(not_plain, b - a).alias("middle_chars"), "text", output.alias("output"))
