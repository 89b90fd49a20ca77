"""Exact deduplication by deterministic block naming.

Each text, with A-Z lower-cased, is cut into blocks of a fixed number of
characters. Equal blocks get one integer name, different blocks different names;
then adjacent pairs of names get names of their own, level by level, until every
document is left with a single name: its identity. Two documents share an identity
exactly if their texts are equal.

Names are given to sorted distinct values and stored before they are used, so a
lost executor cannot change them. Two shortcuts keep text off the network without
weakening that:

* A block whose 128-bit fingerprint occurs once in the corpus equals no other block,
  so its document equals no other; only blocks with repeated fingerprints are
  compared as text.
* Once the distinct texts behind the repeated fingerprints were seen to be one per
  fingerprint, the fingerprint stands for the text. Were two texts ever to share
  one, the fingerprints are drawn again with another salt.

Hot groups: names come from grouped distinct values, which are combined before the
shuffle; the join back is a plain equi-join whose large side Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satchel.llm.common import ascii_lower, materialise, spare_name

#: Characters in a block.
BLOCK_CHARS = 4096


def _blocks(text, block_chars: int):
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _prints(text, block_chars: int, salt: int):
    return F.transform(_blocks(text, block_chars), lambda b: F.struct(F.xxhash64(b).alias("h1"), F.xxhash64(F.lit(salt), b).alias("h2")))


def _name_blocks(norm: DataFrame, rows: DataFrame, block_chars: int, salt: int) -> DataFrame:
    """(h1, h2, name, texts): a name for each repeated fingerprint; texts is how many texts share it."""
    repeated = rows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    seen = norm.select(F.explode(F.arrays_zip(_blocks(F.col("__norm"), block_chars).alias("block"), _prints(F.col("__norm"), block_chars, salt).alias("print"))).alias("b"))
    #: Copies of a block are combined before the shuffle, so a block that a third of all rows hold reaches the join once a task.
    seen = seen.select("b.print.h1", "b.print.h2", "b.block").distinct().join(repeated, ["h1", "h2"], "left_semi")
    by_print = Window.partitionBy("h1", "h2")
    named = seen.select("h1", "h2", F.row_number().over(by_print.orderBy("block")).alias("i"), F.count(F.lit(1)).over(by_print).alias("texts"))
    return materialise(named.where("i = 1").select("h1", "h2", F.monotonically_increasing_id().alias("name"), "texts"), "block-names")


def block_identity(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per row of ``docs``: ``keep`` columns, row_id, text_sha256, level, name.

    (level, name) is the document's identity. level -1 marks a document with a block
    that occurs nowhere else; its name is its row_id.
    """
    norm = docs.select(*keep, ascii_lower(F.col(text_col)).alias("__norm"))
    for salt in range(1, 9):
        digests = materialise(
            norm.select(F.monotonically_increasing_id().alias("row_id"), *keep, F.sha2("__norm", 256).alias("text_sha256"), _prints(F.col("__norm"), block_chars, salt).alias("prints")),
            "digests",
        )
        rows = digests.select("row_id", F.size("prints").alias("blocks"), F.posexplode("prints").alias("pos", "print")).select("row_id", "blocks", "pos", "print.h1", "print.h2")
        names = _name_blocks(norm, rows, block_chars, salt)
        if not names.where("texts > 1").head(1):
            break
    else:
        raise RuntimeError("no salt gave fingerprints free of collisions")
    found = materialise(rows.join(names.drop("texts"), ["h1", "h2"]).select("row_id", "blocks", "pos", "name"), "named-blocks")
    #: Documents with every block repeated; the others are unique already.
    whole = found.groupBy("row_id", "blocks").count().where("count = blocks").select("row_id")
    level_of = F.when(F.col("blocks") == 1, 0)
    single = found.where("blocks = 1").select("row_id", level_of.alias("level"), "name")
    longer = found.where("blocks > 1")
    most = longer.agg(F.max("blocks")).head()[0] or 1
    done, level, width = [single], 0, most
    current = longer.join(whole, "row_id", "left_semi") if most > 1 else None
    while width > 1:
        level, width = level + 1, (width + 1) // 2
        last = (F.col("pos") % 2) == 1
        pairs = materialise(
            current.groupBy("row_id", F.floor(F.col("pos") / 2).alias("pos"), F.ceil(F.col("blocks") / 2).alias("blocks")).agg(
                F.max(F.when(~last, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(last, F.col("name"))), F.lit(-1)).alias("b")
            ),
            "pairs",
        )
        named = materialise(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")
        current = materialise(pairs.join(named, ["a", "b"]).select("row_id", "pos", "blocks", "name"), "named-pairs")
        done.append(current.where("blocks = 1").select("row_id", F.lit(level).alias("level"), "name"))
        current = current.where("blocks > 1")
    names = done[0]
    for x in done[1:]:
        names = names.unionByName(x)
    return digests.drop("prints").join(names, "row_id", "left").select(*keep, "row_id", "text_sha256", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("name", "row_id").alias("name"))


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Which row of each group of equal texts stays: the one with the largest doc_id.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. Among repeated rows
    with the same doc_id and text exactly one stays. A null doc_id stays only in a
    group without others. Of an empty table the result is empty. Other columns of
    ``docs``, whatever their names, are not read.
    """
    ids = materialise(block_identity(docs, block_chars=block_chars), "identities")
    shared = ids.where("level >= 0")
    best = materialise(shared.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_id")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    best = best.select("level", "name", "best.*", "group_size").withColumnsRenamed({"doc_id": "keep_id", "row_id": "keep_row"})
    alone = ids.where("level < 0").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    groups = shared.join(best, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
    return alone.unionByName(groups)


def drop_exact_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``exact_dedup``). Ids may be numbers or strings."""
    p = spare_name(docs)
    on = [f"{p}id", f"{p}no_id", f"{p}sha"]
    key = [F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias(on[0]), F.isnull("doc_id").alias(on[1])]
    kept = exact_dedup(docs, block_chars).where("kept").select(*key, F.col("text_sha256").alias(on[2]))
    rows = docs.select("*", *key, F.sha2(ascii_lower(F.col("text")), 256).alias(on[2]))
    #: Repeated rows agree in the key; dropDuplicates needs no shuffle after this join.
    return rows.join(kept, on, "left_semi").dropDuplicates(on).select(*docs.columns)
