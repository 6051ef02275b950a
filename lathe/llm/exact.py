"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut into chunks behind places whose characters meet a
fixed condition, so equal passages give equal chunks wherever they stand, and
a text is the concatenation of its chunks. A chunk's identifier is its 64-bit
hash; its SHA-256 verifies it: should one identifier stand for two different
chunks, the documents with such a chunk are told apart by the SHA-256 of their
text as well. Texts are read and cut once; only identifiers and digests move.
Documents are compared by their ordered lists of identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Longest chunk in characters, where no condition is met.
LONGEST = 8192
#: A chunk ends at two characters of the first classes of one of these if one of the third follows: a space between words
#: (Latin or Cyrillic; about every 60th), inside codes, numbers and words (about every 500th character), in Han, Kana and Hangul.
ENDS = (
    (r"[a-fà-êа-е][n-zë-üн-я]\x20", r"[a-dа-г]"),
    (r"[AIQYgow4][BJRZhpx5]", r"[CKSaiqy6]"),
    (r"[一-仿怀-惿漀-濿琀-盿눀-닿ぬ-の][一-俿夀-寿攀-柿가-꿿ぁ-だ]", r"[一-忿攀-翿가-쿿ぁ-ん]"),
)
CHUNK = "(?s).{0,%d}?(?:%s)|.{1,%d}" % (LONGEST - 3, "|".join(f"{end}(?={after})" for end, after in ENDS), LONGEST)

#: Runs of white space that aren't a single space already.
UNEVEN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN, " ")


def chunks(text: Column) -> Column:
    """The ordered chunks of a normalised text; none if it is empty. Joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Equal documents, where runs of white space count as one space.

    Returns one row per row of docs: doc_id, keep_id (the smallest doc_id with
    an equal text), group_size, kept, text_sha256 (of the normalised text).
    A null text counts as empty; an empty text and one of white space only
    differ. If the smallest doc_id of a group occurs in several of its rows,
    all of these are kept. Null doc_ids come last: a group of these alone has
    a null keep_id and its rows are kept. Very long texts are many chunks; a
    stretch without a place to cut is cut every LONGEST characters. Other
    columns are ignored; empty tables give empty results. identifier makes a
    chunk's identifier, and the result doesn't depend on it.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    cut = text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunk"))
    recipes = cut.select("doc_id", "text_sha256", F.transform("chunk", lambda c: F.struct(identifier(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("parts"))
    recipes = saved(recipes, "recipes")

    digests = recipes.select(F.explode("parts").alias("part")).select("part.id", "part.digest")
    shared_ids = saved(digests.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("id"), "shared-ids")
    recipes = recipes.select("doc_id", "text_sha256", F.col("parts.id").alias("recipe"))
    if not shared_ids.isEmpty():
        doubtful = recipes.select("text_sha256", F.explode("recipe").alias("id")).join(shared_ids, "id", "left_semi").select("text_sha256").distinct()
        recipes = recipes.join(doubtful.withColumn("doubt", F.lit(True)), "text_sha256", "left").withColumn("tie", F.when(F.col("doubt"), F.col("text_sha256")).otherwise("")).drop("doubt")
    else:
        recipes = recipes.withColumn("tie", F.lit(""))
    recipes = recipes.withColumn("key", F.xxhash64("recipe"))

    keys = ["key", "recipe", "tie"]
    groups = recipes.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # The join goes by a short key with the list as its check; a hot group's rows are split by the adaptive join, as its other side is one row.
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "keep_id", "group_size")
    match = [F.col(k) == F.col(f"_{k}") for k in keys]
    out = recipes.join(groups, match)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
