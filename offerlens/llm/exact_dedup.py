"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

1. A text is cut after each sentence (without white space around it; or line; after ``LONG`` characters where none ends) whose hash is 0 modulo ``SENTENCES``. Where a
   chunk ends depends on that sentence alone, so equal stretches give equal chunks wherever they stand, but for the first. Chunks of
   more than ``MOST`` characters are cut further from their own beginning. A text's recipe is the ordered list of its chunks' digests.
2. The chunks are made distinct (digest and content, combined before the shuffle), which moves each distinct chunk
   once a task. A digest with two contents is no identifier; where that happens the content itself takes its place
   in the recipes, so that equal recipes always mean equal texts.
3. Only recipes (32 bytes a chunk) and ids are grouped and joined; long documents don't move again.

Defined results: a null text counts as empty; a null ``doc_id`` is smaller than any other, so it stays only if all ids of
its group are null; of rows that repeat with the largest id one stays; an empty table gives an empty result; extra
columns are ignored by ``groups`` and carried by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged, whole_text

SENTENCES, LONG, MOST = 8, 400, 8000
SENTENCE = rf"(?s).{{1,{LONG}}}?(?:\n|[.!?](?=\s)|\z)|.{{{LONG}}}"
PIECE = rf"(?s).{{1,{MOST}}}"
#: Marks chunk ends while the sentences are put together; a text that has it is cut into pieces of equal length instead.
MARK = "\x01"


def normalised(docs: DataFrame) -> Column:
    return ascii_lower(whole_text(docs))


def sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text."""
    ends = lambda s: F.pmod(F.xxhash64(F.btrim(s, F.lit(" \n"))), F.lit(SENTENCES)) == 0
    marked = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.when(ends(s), F.concat(s, F.lit(MARK))).otherwise(s))
    cut = F.filter(F.split(F.array_join(marked, ""), MARK, -1), lambda c: c != "")
    pieces = lambda c: F.regexp_extract_all(c, F.lit(PIECE), F.lit(0))
    short = F.flatten(F.transform(cut, lambda c: F.when(F.length(c) > MOST, pieces(c)).otherwise(F.array(c))))
    return F.when(F.contains(text, F.lit(MARK)), pieces(text)).otherwise(short)


def recipes(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row for each document: row (a number), doc_id, text_sha256 and recipe (binary, the ordered identifiers)."""
    text = docs.select(docs["doc_id"], normalised(docs).alias("_text"))
    cut = text.select("doc_id", "_text", chunks(F.col("_text")).alias("_chunks"))
    listed = cut.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.transform("_chunks", digest).alias("recipe"))
    listed = staged(listed.withColumn("row", F.monotonically_increasing_id()), "recipes")
    # explode() would filter by the number of chunks first, and cut every text once more for that
    listed_chunks = cut.select(F.explode_outer("_chunks").alias("chunk")).filter("chunk IS NOT NULL")
    contents = listed_chunks.select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    clashes = staged(contents.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        return listed
    # A digest that stands for two contents: the texts that have it get the contents themselves.
    own = cut.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.col("_chunks"))
    unclear = listed.select("row", F.explode("recipe").alias("digest")).join(clashes, "digest", "left_semi").select("row").distinct()
    named = listed.join(unclear.withColumn("_unclear", F.lit(True)), "row", "left")
    texts = own.groupBy("text_sha256").agg(F.first("_chunks").alias("_chunks"))
    full = named.filter("_unclear").join(texts, "text_sha256").select("doc_id", "text_sha256", F.transform("_chunks", lambda c: c.cast("binary")).alias("recipe"), "row")
    return named.filter("_unclear IS NULL").select("doc_id", "text_sha256", F.transform("recipe", lambda c: c.cast("binary")).alias("recipe"), "row").unionByName(full)


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every document's group: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, digest)
    first = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("_first"), F.count("*").alias("group_size"))
    joined = rows.join(staged(first, "recipe-groups"), "recipe")  # read from a table, so that Spark splits a recipe's rows if they are many
    return joined.select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_first.row") == F.col("row")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; of rows that repeat in id and text the first by their JSON."""
    decided = staged(groups(docs), "groups")
    goes = decided.filter("NOT kept")
    # of rows with one id and text all but one go: only those are grouped
    again = staged(goes.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "repeated")
    goes = goes.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].alias("doc_id"), F.sha2(normalised(docs), 256).alias("text_sha256"))
    same = lambda keys: rows["doc_id"].eqNullSafe(keys["_id"]) & (rows["text_sha256"] == keys["_sha"])
    if again.isEmpty():
        return rows.join(goes, same(goes), "left_anti").select("_row.*")
    others = rows.join(goes.unionByName(again), same(goes), "left_anti").select("_row")
    one = rows.join(again, same(again), "left_semi").groupBy("doc_id", "text_sha256").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return others.unionByName(one).select("_row.*")
