"""Exact deduplication by deterministic block naming (DataFrame functions only).

Each text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and get integer names;
then adjacent names are paired and the distinct pairs are sorted and named in turn, until each document is one
name. Two rows get the same (level, name) exactly if their bytes are equal: a name stands for one content at
each level, and the level fixes how often names were paired.

Rows meet their block's name through a 128-bit fingerprint, which spares a second shuffle of the contents.
That is exact too: the naming pass has compared the contents themselves and shows whether any two blocks share
a fingerprint; if so, other seeds are taken.

Scale: the contents are shuffled once, after a map-side distinct, so a group of copies that holds a third of
all rows moves as one block per task. Every later shuffle has a few integers a block, and each level halves
the rows. The joins read both sides from written tables, so adaptive execution can split a hot name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK_BYTES = 4096


def _blocks(text: str, block_bytes: int) -> Column:
    """The text's UTF-8 bytes in blocks; one empty block for an empty or null text."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    last = F.greatest(F.lit(0), F.expr(f"(octet_length(coalesce(`{text}`, '')) - 1) div {block_bytes}"))
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _prints(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("h1"), F.xxhash64(F.lit(~seed), block).alias("h2"))


def name_texts(docs: DataFrame, scratch: Scratch, text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Give each row its text's identity.

    Returns the columns of ``keep`` and row_id (unique), text_sha256, level and name. Null texts count as
    empty; repeated rows stay apart by row_id; columns that are not in ``keep`` are not read.
    """
    keep, before = keep or [], len(scratch.saved)
    # One struct holds the kept columns, so that their names cannot clash with ours.
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_"))
    seed = 1
    while True:
        rows = scratch.save(
            docs.select(
                F.monotonically_increasing_id().alias("row_id"),
                kept.alias("kept"),
                F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
                F.transform(_blocks(text, block_bytes), lambda b: _prints(b, seed)).alias("prints"),
            ),
            f"rows{seed}",
        )
        names = scratch.save(
            docs.select(F.explode(_blocks(text, block_bytes)).alias("block"))
            .distinct()
            .sortWithinPartitions("block")
            .select(_prints(F.col("block"), seed).alias("p"), F.monotonically_increasing_id().alias("name"))
            .select("p.h1", "p.h2", "name"),
            f"names{seed}",
        )
        if not names.groupBy("h1", "h2").count().filter("count > 1").head(1):
            break
        seed += 1
    most = rows.agg(F.max(F.size("prints"))).first()[0] or 0
    at = (
        rows.select("row_id", F.size("prints").alias("n"), F.posexplode("prints").alias("pos", "p"))
        .select("row_id", "n", "pos", "p.h1", "p.h2")
        .join(names, ["h1", "h2"])
        .select("row_id", "n", "pos", "name")
    )
    found, level = at.filter("n = 1").select("row_id", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        pairs = scratch.save(
            at.filter("n > 1")
            .groupBy("row_id", F.expr("(n + 1) div 2").alias("n"), F.expr("pos div 2").alias("pos"))
            .agg(F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("l"), F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("r")),
            f"pairs{level}",
        )
        names = scratch.save(pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").select("l", "r", F.monotonically_increasing_id().alias("name")), f"names_at{level}")
        at = pairs.join(names, ["l", "r"]).select("row_id", "n", "pos", "name")
        found = found.unionByName(at.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    out = rows.select("row_id", "kept", "text_sha256").join(found, "row_id")
    given = list(scratch.saved[:before])
    named = scratch.save(out.select("row_id", *[F.col(f"kept.`{c}`") for c in keep], "text_sha256", "level", "name"), "named")
    scratch.keep_only(*given, "named")
    return named


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (and row_id).

    Of equal texts the row with the largest doc_id stays; among rows that repeat that doc_id, one of them.
    Null ids sort below all others, so a null-id row stays only in a group without other ids (keep_id is null
    then). Null texts count as empty. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    named = name_texts(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), scratch, keep=["doc_id"], block_bytes=block_bytes)
    groups = scratch.save(
        named.groupBy("level", "name").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id"), F.col("row_id"))).alias("m"), F.count("*").alias("group_size")),
        "groups",
    ).select("level", "name", F.col("m.doc_id").alias("keep_id"), F.col("m.row_id").alias("keep_row"), "group_size")
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "row_id")


def keep_largest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, all their columns as they are."""
    scratch = Scratch(docs.sparkSession, "distinct")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")), "rows")
    source = rows.select("_row", F.col(f"_kept.`{doc_id}`").alias("doc_id"), F.col(f"_kept.`{text}`").alias("text"))
    named = name_texts(source, scratch, keep=["doc_id", "_row"])
    order = F.struct(F.col("doc_id").isNotNull().alias("k"), F.col("doc_id"), F.col("row_id"))
    stays = scratch.save(named.groupBy("level", "name").agg(F.max_by("_row", order).alias("_row")), "stays")
    scratch.keep_only("rows", "stays")
    # One strategy at every size: the kept rows grow with the input.
    return rows.join(stays.select("_row").hint("merge"), "_row", "left_semi").select("_kept.*")
