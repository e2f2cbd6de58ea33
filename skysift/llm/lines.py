"""Lines that repeat across documents: dropped everywhere but in the first document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import fresh
from skysift.session import cut

SPACE = " \t\n\u000b\u000c\r"


def trimmed(line: Column) -> Column:
    """A line without white space at its ends. Only lines that need it are trimmed, which is slow."""
    blank = reduce(or_, [x for c in SPACE for x in (line.startswith(c), line.endswith(c))])
    return F.when(blank, F.trim(line, F.lit(SPACE))).otherwise(line)


def case_key(line: Column) -> Column:
    """Equal exactly for lines that are equal once A-Z are lower-cased, and quicker than translating A-Z.

    The line's bytes, each read as a Latin-1 character, are lower-cased. Besides A-Z that changes first bytes of two-byte characters into
    values that otherwise begin longer ones; as the number of bytes that follow tells the two apart, no two lines become equal by it.
    """
    return F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_documents: int = 2) -> DataFrame:
    """All columns of ``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are exploded with their positions, normalised and hashed (128 bits), once; the hashes are written down, and documents are
    counted per hash before anything but hashes is shuffled; positions of lines to drop come back to their document,
    which is put together again by position. A key of ``min_chars`` code points or more, found in
    ``min_documents`` documents or more, stays only in the document with the smallest id, there as often
    as it occurs.

    Null text counts as one empty line. Rows with a null id neither count nor lose lines. Rows that share
    an id count as one document, and each is put together from its own text. Where ``docs`` has a column
    named like a result already, the result gets a leading underscore.
    """
    whole, row = F.coalesce(F.col(text_col), F.lit("")), F.xxhash64(F.col(text_col))
    lines = cut(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), row.alias("_row"), F.posexplode(F.split(whole, "\n", -1)).alias("_pos", "_line"))
        .where(F.octet_length("_line") >= min_chars)
        .select("_id", "_row", "_pos", trimmed(F.col("_line")).alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select("_id", "_row", "_pos", F.unhex(F.md5(case_key(F.col("_line")).cast("binary"))).alias("_hash"))
    )
    # two documents or more have the key exactly if its first and last id differ, and both are kept up in the map-side sums
    counted = lines.groupBy("_hash").agg(F.min("_id").alias("_keeper"), *([F.max("_id").alias("_last")] if min_documents == 2 else [F.count_distinct("_id").alias("_n")]))
    # written down, so that both sides of the join are plain shuffles and Spark can split the rows of a very frequent line
    repeated = cut(counted.where("_keeper < _last" if min_documents == 2 else F.col("_n") >= min_documents).select("_hash", "_keeper"))
    dropped = lines.join(repeated, "_hash").where("_id <> _keeper").groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_dropped"))

    n_lines, n_dropped, kept = (fresh(docs, c) for c in ("n_lines", "n_dropped", "kept_text"))
    joined = docs.withColumns({"_id": F.col(id_col), "_row": row}).join(dropped, ["_id", "_row"], "left")
    split = F.split(whole, "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_dropped"))
    return joined.select(
        *(F.col(c) for c in docs.columns),
        (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n_lines),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col("_dropped").isNull(), whole).otherwise(F.array_join(F.transform(rest, lambda p: F.get(split, p)), "\n")).alias(kept),
    )
