"""Collapsing of records that differ only in letter case, white space, punctuation or the order of unordered parts.

Records are hashed bottom-up: leaves are normalised and digested, an unordered node digests the sorted digests of its children,
an ordered node digests them as they stand. Records with one root digest are compared in full before they count as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(text: Column) -> Column:
    """Letters and digits of a text without case; a sharp s equals SS, its capital form."""
    return F.replace(F.regexp_replace(F.lower(F.upper(text)), r"[^\p{L}\p{N}]+", ""), F.lit("ß"), F.lit("ss"))


def leaf(text: Column) -> Column:
    return F.md5(F.concat(F.lit("leaf\x00"), text))


def ordered_node(*children: Column) -> Column:
    return F.md5(F.concat(F.lit("list\x00"), *children))


def unordered_node(children: Column) -> Column:
    """Digest of a set of child digests; a child that occurs twice counts once."""
    return F.md5(F.concat(F.lit("set\x00"), F.array_join(F.sort_array(F.array_distinct(children)), "")))


def url_structure(url: Column) -> Column:
    """The normalised path and the set of normalised (name, value) parameters of a url; empty parameters don't count."""
    mark = F.instr(url, "?")
    path = normal(F.when(mark > 0, F.substring(url, F.lit(1), mark - 1)).otherwise(url))
    query = F.when(mark > 0, F.substring(url, mark + 1, F.length(url))).otherwise("")
    pair = lambda x: F.struct(
        normal(F.substring_index(x, "=", 1)).alias("name"),
        normal(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("value"),
    )
    params = F.filter(F.transform(F.split(query, "[&;]"), pair), lambda p: (p["name"] != "") | (p["value"] != ""))
    return F.struct(path.alias("path"), F.array_sort(F.array_distinct(params)).alias("params"))


def root_digest(title: Column, url: Column) -> Column:
    """Root of a record of a normalised title and a :func:`url_structure`; null if either is."""
    params = F.transform(url["params"], lambda p: ordered_node(leaf(p["name"]), leaf(p["value"])))
    return ordered_node(leaf(title), ordered_node(leaf(url["path"]), unordered_node(params)))


def with_root(df: DataFrame, title: str = "title", url: str = "url") -> DataFrame:
    """``df`` with ``_title``, ``_url`` (normal forms) and ``_root``; null title or url gives a null root."""
    out = df.withColumns({"_title": normal(F.col(title)), "_url": url_structure(F.col(url))})
    return out.withColumn("_root", root_digest(F.col("_title"), F.col("_url")))


def copy_groups(df: DataFrame, record_id: str = "seq", title: str = "title", url: str = "url") -> DataFrame:
    """One row per distinct record: ``_root``, normal forms, ``seq_first`` (smallest id) and ``copies`` (rows of the group).

    Rows without title or url are each their own record and are left out here. Partial aggregation collapses a group on
    each task before the shuffle, so a group of any size sends one row per task.
    """
    rooted = with_root(df.select(record_id, title, url), title, url).filter(F.col("_root").isNotNull())
    # grouping by the forms besides the digest is the full comparison: a clash of digests doesn't join records
    return rooted.groupBy("_root", "_title", "_url").agg(F.min(record_id).alias("seq_first"), F.count(F.lit(1)).alias("copies"))


def copy_pairs(df: DataFrame, record_id: str = "seq", title: str = "title", url: str = "url") -> DataFrame:
    """``seq_first``, ``seq_copy``: a row for each further record of a group, with the group's smallest id.

    Repeated ids give one row. An empty table gives none. Columns other than the three named are not read. The join back is
    an inner sort-merge join, whose hot partitions AQE splits.
    """
    rooted = with_root(df.select(record_id, title, url), title, url).filter(F.col("_root").isNotNull())
    groups = copy_groups(df, record_id, title, url).filter("copies > 1").select("_root", F.col("_title").alias("_t"), F.col("_url").alias("_u"), "seq_first")
    same = (F.col("_title") == F.col("_t")) & (F.col("_url") == F.col("_u"))
    pairs = rooted.join(groups, "_root").filter(same & (F.col(record_id) != F.col("seq_first")))
    return pairs.select("seq_first", F.col(record_id).alias("seq_copy"))


def collapse(df: DataFrame, record_id: str = "seq", title: str = "title", url: str = "url") -> DataFrame:
    """One record per group: its smallest id and ``copies``; records without title or url come out singly, with copies 1."""
    single = df.filter(F.col(title).isNull() | F.col(url).isNull()).select(F.col(record_id).alias("seq"), F.lit(1).cast("bigint").alias("copies"))
    return copy_groups(df, record_id, title, url).select(F.col("seq_first").alias("seq"), "copies").unionAll(single)
