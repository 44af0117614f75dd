"""Cutting of texts over a limit into overlapping pieces that end at natural boundaries.

One pattern does it: its alternatives, in order of boundary strength, each take up to the limit; the last takes any characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def piece_pattern(limit: int, overlap: int) -> str:
    """Pattern whose successive matches cover a text: the first takes up to ``limit`` characters, others leave the overlap free.

    A boundary in the last half of the span is better than an earlier one of a stronger class, so that a lone early boundary gives
    no crumbs; an earlier one is better than none, if the first piece is longer than the overlap then. Classes: end of text, blank line, line end, sentence end, clause end, white
    space, then any character (but not before a combining mark, where one can avoid it). Each look-back is as long as the span.
    """

    def span(most: int, least: int) -> str:
        half = most // 2
        closing = r"\"'”’»)\]"
        blank = rf"(?<=\n)(?<=\n\s{{0,{most}}}\n)(?!\s)"
        sentence = rf"(?!\s)(?<=[.!?…。！？{closing}]\s)(?<=[.!?…。！？][{closing}]{{0,{most}}}\s)"
        ends = (blank, r"(?<=\n)", sentence, r"(?<=[,;:–—]\s)(?!\s)", r"(?<=\s)(?!\s)")
        taken = [rf".{{1,{most}}}\z", *(rf".{{{half},{most}}}{e}" for e in ends), *(rf".{{{least},{half}}}{e}" for e in ends)]
        return "(?:" + "|".join([*taken, rf".{{{half},{most}}}(?!\p{{M}})", rf".{{1,{most}}}"]) + ")"

    return rf"(?s)\A{span(limit, overlap + 1)}|(?<!\A){span(limit - overlap, 1)}"


def split_text(df: DataFrame, item_id: str, text: str, limit: int = 3000, overlap: int = 200, only_over: bool = False) -> DataFrame:
    """Pieces of each text: item id, ``piece_no`` from 1, ``n_pieces``, ``start`` (0-based offset of the piece), ``piece``.

    Each piece has at most ``limit`` characters (Unicode code points); each after the first starts with the last ``overlap``
    characters of the one before. Texts within the limit come out as one piece, empty texts as one empty piece; with
    ``only_over`` they are left out. Null texts give no row. Other columns are not read.
    """
    if not 0 <= overlap < limit // 3:
        raise ValueError("the overlap must be less than a third of the limit")
    t = df.select(F.col(item_id), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    over = F.length("_text") > limit
    if only_over:
        t = t.filter(over)
    cuts = F.when(over, F.regexp_extract_all(F.col("_text"), F.lit(piece_pattern(limit, overlap)), F.lit(0))).otherwise(F.array("_text"))
    t = t.withColumn("_lengths", F.transform(cuts, lambda x: F.length(x)))
    # end offsets of the pieces, from their lengths
    ends = F.aggregate(
        F.col("_lengths"), F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )
    t = t.withColumn("_ends", ends)
    t = t.select(item_id, "_text", "_ends", F.size("_ends").alias("n_pieces"), F.posexplode("_ends").alias("_i", "_end"))
    start = F.when(F.col("_i") == 0, 0).otherwise(F.try_element_at("_ends", F.col("_i")) - overlap)
    t = t.withColumn("start", start)
    return t.select(
        item_id, (F.col("_i") + 1).cast("bigint").alias("piece_no"), F.col("n_pieces").cast("bigint").alias("n_pieces"),
        F.col("start").cast("bigint").alias("start"), F.substring(F.col("_text"), F.col("start") + 1, F.col("_end") - F.col("start")).alias("piece"),
    )
