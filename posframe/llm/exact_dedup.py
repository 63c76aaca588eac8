"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

Each text is cut where its own content says so, once a chunk has MIN_CHUNK characters: after a full stop or line end; in
texts without them after other punctuation or white space, or else after one of a few sampled letters and ideographs; at
MAX_CHUNK at the latest. The chunks are reduced to 128-bit identifiers, and these are *verified*: no two chunks of the
corpus that differ in length or SHA-256 may share one (otherwise the next seed is tried). No text moves for that. From then on a document is its recipe, the ordered list of identifiers, and only recipes are compared.

Defined results
---------------
* Null text is the empty text; its recipe is the empty list, so all such rows are one group.
* Null ids: such a row is grouped; it is kept only where its group has no row with an id.
* Repeated rows (same id, same text) share one decision in `groups`; `deduplicated` leaves one of them.
* Empty tables give empty results; other columns are neither read nor in the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, keep_rows, text_of

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: What a chunk ends with, the first that is found: sentence ends, other punctuation and spaces, sampled characters.
BOUNDARIES = (r"[.\n]", r"[\s\p{P}\p{S}]", r"[0-3AEIOUaeiou\u3041-\u3050\u4e00-\u52ff\uac00-\uafff]")


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Array of the text's chunks; their concatenation is the text."""
    later = [(least + most) // 2, (least + 3 * most) // 4, most]
    cuts = [rf".{{{least},{at - 1}}}?{mark}" for at, mark in zip(later, BOUNDARIES)]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join([*cuts, f".{{1,{most}}}"])), F.lit(0))


def _identifier(chunk: Column, seed: int) -> list[Column]:
    return [F.xxhash64(chunk), F.xxhash64(F.lit(seed), chunk)]


def verified_seed(docs: DataFrame, text: str = "text", tries: int = 8) -> int:
    """The first seed whose identifiers tell all different chunks of the corpus apart, by their lengths and SHA-256."""
    pieces = docs.select(F.explode(chunks(text_of(docs, text))).alias("chunk"))
    for seed in range(tries):
        first, second = _identifier(F.col("chunk"), seed)
        different = pieces.select(first.alias("a"), second.alias("b"), F.length("chunk").alias("length"), F.unhex(F.sha2("chunk", 256)).alias("digest")).distinct()
        shared_ids = different.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1")
        if shared_ids.agg(F.count("*")).first()[0] == 0:
            return seed
    raise ValueError("no seed tells the chunks apart")


def recipes(docs: DataFrame, seed: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, recipe, mark, text_sha256) for each row; mark is a hash of the text that tells rows of one id apart."""
    body = text_of(docs, text)
    parts = F.transform(chunks(body), lambda c: F.array(*_identifier(c, seed)))
    return docs.select(docs[id_col].alias("doc_id"), F.flatten(parts).alias("recipe"), F.xxhash64(body).alias("mark"), F.sha2(body.cast("binary"), 256).alias("text_sha256"))


def _decided(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document: doc_id, mark, keep_id, group_size, kept, text_sha256.

    Groups of copies are counted with partial sums before the shuffle; the way back joins the rows with a written table
    that has one row per group of two or more, so that adaptive execution splits the rows of a large group.
    """
    light = cut(recipes(docs, verified_seed(docs, text), id_col, text), "recipes")
    sizes = light.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    copied = cut(sizes.filter("group_size > 1"), "copied")
    out = light.join(copied, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "mark", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(docs, id_col, text).drop("mark")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: of equal texts the row with the largest id.

    A row stays or goes by its own text even where two texts share an id.
    """
    return keep_rows(docs, _decided(docs, id_col, text).select("doc_id", "mark", "kept"), id_col, text)
