"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text without white space is cut where its content says so, each chunk gets a
digest, and the ordered digests are the text's recipe. One pass over the distinct
chunks verifies that a digest stands for one content only (else the contents of that
digest get numbers of their own), so equal recipes mean equal texts. What is grouped
and joined afterwards are recipes, 32 bytes for about a thousand characters; long
texts move once, as distinct chunks, after map-side combining.

Defined results: null text counts as empty; empty texts are equal to one another;
rows repeated with the same id are separate rows of one group, of which one stays;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_groups, materialize, release_scratch, scratch_mark, text_or_empty

#: A chunk ends behind one of these marks, at the earliest after MIN_CHUNK characters, or else after MAX_CHUNK characters.
BOUNDARY = r"[.!?;:,|#*]"
MIN_CHUNK, MAX_CHUNK = 1024, 4096
#: Dropped rows (a file's name and a number each) up to which they are broadcast.
MOST_BROADCAST = 100_000


def normalized(text_col: str) -> Column:
    return F.translate(text_or_empty(text_col), SPACES, "")


def chunks(norm: Column, boundary: str, min_chunk: int, max_chunk: int) -> Column:
    pattern = rf"(?s).{{{min_chunk},{max_chunk - 1}}}?{boundary}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    payload: list[str] | None = None,
    boundary: str = BOUNDARY,
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    digest_bytes: int = 32,
    prefix: str = "",
) -> DataFrame:
    """Return id_col, the payload columns, keep_id, group_size, kept and text_sha256 for every row.

    payload: columns to carry along (for a filter that needs the rows themselves).
    prefix: put before the names of the made columns, where payload has columns of the same names.
    digest_bytes: bytes of SHA-256 kept as a chunk's identifier; small values are for
    tests of the verification.
    """

    def digest(c: Column) -> Column:
        return F.substring(F.unhex(F.sha2(c, 256)), 1, digest_bytes)

    payload = [c for c in payload or [] if c != id_col]
    carried = {f"_p{k}": F.col(c) for k, c in enumerate(payload)}
    norm = normalized(text_col)
    pieces = chunks(norm, boundary, min_chunk, max_chunk)
    facts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), *[c.alias(k) for k, c in carried.items()])
    facts = materialize(
        facts.select(
            F.monotonically_increasing_id().alias("_row"),
            "_id",
            F.char_length("_text").cast("long").alias("_chars"),
            F.sha2(normalized("_text"), 256).alias("text_sha256"),
            F.transform(chunks(normalized("_text"), boundary, min_chunk, max_chunk), digest).alias("_recipe"),
            *carried,
        ),
        "recipes",
        "zstd",
    )
    each = docs.select(F.explode(pieces).alias("_chunk")).select(digest(F.col("_chunk")).alias("_digest"), "_chunk").distinct()
    shared = each.groupBy("_digest").agg(F.count("*").alias("_n")).filter("_n > 1").select("_digest")
    shared = materialize(shared, "shared-digests")
    if not shared.isEmpty():
        facts = _split_shared(docs, facts, shared, digest, pieces, id_col, text_col, boundary, min_chunk, max_chunk)

    groups = facts.groupBy("_recipe").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("_keep"),
    )
    groups = materialize(groups.select("_recipe", "group_size", F.col("_keep.i").alias("keep_id"), F.col("_keep.r").alias("_keep_row")), "recipe-groups")
    n_rows = facts.count()
    joined = join_groups(facts, groups, ["_recipe"], "group_size", n_rows)
    return joined.select(
        F.col("_id").alias(id_col),
        *[F.col(k).alias(c) for k, c in zip(carried, payload, strict=True)],
        F.col("keep_id").alias(f"{prefix}keep_id"),
        F.col("group_size").alias(f"{prefix}group_size"),
        (F.col("_row") == F.col("_keep_row")).alias(f"{prefix}kept"),
        F.col("text_sha256").alias(f"{prefix}text_sha256"),
    )


def one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with docs' columns.

    Rows that are read from files are named by file and place in it, so what is written are the names of the dropped rows
    and no texts. Other rows have no lasting name and are written whole.
    """
    place = ["_made_file", "_made_place"]
    try:
        named = docs.select("*", *[F.col(c).alias(k) for k, c in zip(place, ("_metadata.file_path", "_metadata.row_index"), strict=True)])
    except AnalysisException:  # not read from files
        return exact_dedup(docs, text_col, id_col, payload=docs.columns, prefix="_made_").filter("_made_kept").select(*docs.columns)
    begin = scratch_mark()
    found = exact_dedup(named, text_col, id_col, payload=place, prefix="_made_")
    gone = materialize(found.filter("NOT _made_kept").select(*place), "dropped-copies")
    release_scratch(begin, keep=(gone,))
    return named.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, place, "left_anti").select(*docs.columns)


def _split_shared(docs, facts, shared, digest, pieces, id_col, text_col, boundary, min_chunk, max_chunk) -> DataFrame:
    """Give the contents that share a digest numbers of their own, and rewrite the recipes they occur in.

    With SHA-256 this never runs; it makes the identifiers verified instead of likely.
    Chunk texts are looked up by document digest (text_sha256), which is exact enough to
    find a text but not used to call two texts equal.
    """
    each = docs.select(F.explode(pieces).alias("_chunk")).select(digest(F.col("_chunk")).alias("_digest"), "_chunk").distinct()
    contents = each.join(shared, "_digest", "left_semi")
    numbered = contents.groupBy("_digest").agg(F.array_sort(F.collect_list("_chunk")).alias("_contents"))
    occurrences = docs.select(F.sha2(normalized(text_col), 256).alias("text_sha256"), pieces.alias("_pieces")).distinct()
    occurrences = occurrences.select("text_sha256", "_pieces", F.posexplode("_pieces").alias("_pos", "_chunk")).withColumn("_digest", digest(F.col("_chunk")))
    occurrences = occurrences.join(numbered, "_digest", "left").select(
        "text_sha256",
        F.struct("_pos", F.concat("_digest", F.coalesce(F.encode(F.concat(F.lit(":"), F.array_position("_contents", F.col("_chunk")).cast("string")), "utf-8"), F.lit(b""))).alias("d")).alias("_part"),
    )
    rebuilt = occurrences.groupBy("text_sha256").agg(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["d"]).alias("_new"))
    facts = facts.join(rebuilt, "text_sha256", "left")
    return materialize(facts.withColumn("_recipe", F.coalesce("_new", "_recipe")).drop("_new"), "recipes-verified")
