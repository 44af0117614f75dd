"""One form for texts that look alike but differ in their characters.

Words that hold an unusual character are mapped to their look-alike; mapped values and the spellings that the corpus has of them
are grouped under the accent-sensitive Unicode collation; each class has one canonical member, its commonest spelling, which is
joined back into the texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.session import cut_lineage, small_side

# Ranges of wide and joined presentation forms of ordinary letters, digits and signs.
PRESENTATION = ((0xFF01, 0xFF60), (0xFFE0, 0xFFEE), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x1D400, 0x1D7FF))
# Combining accents.
ACCENTS = ((0x0300, 0x036F), (0x0483, 0x0487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F))
# Characters that show nothing; tab, line ends and spaces aside.
INVISIBLE = (
    (0x0000, 0x0008), (0x000E, 0x001B), (0x007F, 0x0084), (0x0086, 0x009F), (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
)
# Spaces other than the ordinary one.
SPACES = ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Ranges of alphabets besides Latin; scripts of syllables and ideographs are none.
ALPHABETS = (
    (0x0370, 0x10FF), (0x1200, 0x1CFF), (0x1F00, 0x1FFF), (0x2C80, 0x2DFF), (0xA4D0, 0xA6FF), (0xA800, 0xA95F), (0xA980, 0xABFF), (0xFB1D, 0xFB4F),
    (0x10280, 0x1BFFF),
)
# Letters of other alphabets and the Latin letters that they look like.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ё": "Ë", "Ї": "Ï", "Ԛ": "Q", "Ԝ": "W", "Һ": "H", "Ӏ": "I", "Ԁ": "D",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ү": "y", "ё": "ë",
    "ї": "ï", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "п": "n",
    "и": "u", "ь": "b", "З": "3", "з": "3", "Ь": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "β": "ß", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "σ": "o", "ς": "c", "ϲ": "c", "ϳ": "j", "ά": "á", "έ": "é", "ή": "ń", "ί": "í",
    "ό": "ó", "ύ": "ú", "ϊ": "ï", "ϋ": "ü",
    "Ս": "U", "Տ": "S", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j", "ք": "f",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮤ": "W",
    "Ꮪ": "S", "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮢ": "R", "Ꮥ": "S", "Ꮍ": "Y", "Ꮒ": "h", "Ꮟ": "b", "Ꮷ": "d", "Ᏼ": "B", "Ᏻ": "G",
    "ӏ": "l", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "գ": "q", "ռ": "n", "Լ": "L", "ჿ": "o", "ყ": "y",
}


def _java_class(*tables: tuple) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for t in tables for a, b in t)


#: All of the above and more, in two ranges that a pattern tests fast: what it doesn't match needs no closer look.
MAYBE_UNUSUAL = r"[\x00-\x08\x0E-\x1B\x7F-\x84\x86-\xA0\xAD\x{100}-\x{10FFFF}]"
UNUSUAL = _java_class(PRESENTATION, ACCENTS, INVISIBLE, SPACES, ALPHABETS)
ORDINARY_SPACE = r" \t\n\x0B\f\r\x{85}\x{2028}\x{2029}"
WORD = rf"[^{ORDINARY_SPACE}]+"
UNUSUAL_WORD = rf"(?<![^{ORDINARY_SPACE}])[^{ORDINARY_SPACE}{UNUSUAL}]*[{UNUSUAL}][^{ORDINARY_SPACE}]*"


def _within(table: tuple) -> set[int]:
    return {c for a, b in table for c in range(a, b + 1)}


def mixed(letters: str) -> bool:
    """Whether a run of letters has Latin ones and some of another alphabet."""
    other = [c.isalpha() and any(a <= ord(c) <= b for a, b in ALPHABETS) for c in letters]
    return any(other) and any(c.isalpha() and not o and unicodedata.name(c, "").startswith("LATIN") for c, o in zip(letters, other))


class LookAlikes:
    """Maps a word to what it looks like."""

    def __init__(self) -> None:
        self.presentation, self.accents, self.invisible = _within(PRESENTATION), _within(ACCENTS), _within(INVISIBLE)
        self.spaces, self.other = _within(SPACES), _within(ALPHABETS)

    def _run(self, letters: str) -> str:
        """A run of letters; letters of another alphabet among Latin ones become the Latin look-alikes."""
        other = [c for c in letters if ord(c) in self.other and c.isalpha()]
        if not other:
            return letters
        latin = sum(c.isalpha() and ord(c) not in self.other and unicodedata.name(c, "").startswith("LATIN") for c in letters)
        if not latin or (latin < len(other) and not all(c in LOOK_ALIKE for c in other)):
            return letters
        return "".join(LOOK_ALIKE.get(c, c) for c in letters)

    def __call__(self, word: str) -> str:
        out: list[str] = []
        for c in word:
            n = ord(c)
            if n in self.invisible:
                # a variation selector after a sign chooses its colour or shape and is part of it
                if 0xFE00 <= n <= 0xFE0F and out and unicodedata.category(out[-1][-1])[0] == "S":
                    out.append(c)
            elif n in self.spaces:
                out.append(" ")
            elif n in self.presentation:
                out.append(unicodedata.normalize("NFKC", c))
            elif n in self.accents and out and out[-1][-1].isalpha():
                whole = unicodedata.normalize("NFC", out[-1] + c)
                if len(whole) < len(out[-1]) + 1:
                    out[-1] = whole
                else:
                    out.append(c)
            else:
                out.append(c)
        text, done, run = "".join(out), [], []
        for c in text:
            if c.isalpha() or ord(c) in self.accents:
                run.append(c)
                continue
            if run:
                done.append(self._run("".join(run)))
                run = []
            done.append(c)
        if run:
            done.append(self._run("".join(run)))
        return "".join(done)


def mixed_word(word: Column) -> Column:
    """Whether a word has a run of letters that is :func:`mixed`."""

    @F.pandas_udf("boolean")
    def batch(words: pd.Series) -> pd.Series:
        runs = lambda w: "".join(c if c.isalpha() or any(a <= ord(c) <= b for a, b in ACCENTS) else " " for c in w).split(" ")
        return words.map(lambda w: any(map(mixed, runs(w))), na_action="ignore")

    return batch(word)


def look_alike(word: Column) -> Column:
    """:class:`LookAlikes` over a column of words."""

    @F.pandas_udf("string")
    def batch(words: pd.Series) -> pd.Series:
        mapper = LookAlikes()
        return words.map(mapper, na_action="ignore")

    return batch(word)


def unusual_words(df: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """Row id, ``field`` and ``word`` of each different word that holds an unusual character; null texts give nothing."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    texts = df.select(row_id, F.explode(parts).alias("_x")).select(row_id, "_x.field", "_x.text")
    texts = texts.filter(F.col("text").rlike(MAYBE_UNUSUAL) & F.col("text").rlike(f"[{UNUSUAL}]"))
    return texts.select(row_id, "field", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(UNUSUAL_WORD), F.lit(0)))).alias("word"))


def spellings(df: DataFrame, fields: tuple[str, ...], of: DataFrame) -> DataFrame:
    """``word``, ``n``: in how many texts each word of ``of`` stands as it is; partial counts leave a word one row per task."""
    parts = F.array(*(F.col(f) for f in fields))
    texts = df.select(F.explode(parts).alias("text")).filter(F.col("text").isNotNull())
    each = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
    return each.join(of, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def canonical_words(words: DataFrame, ordinary: DataFrame | None = None) -> DataFrame:
    """``word``, ``canonical``: words whose mapped values the collation holds equal have one canonical member.

    The members of a class are the mapped values and, with ``ordinary`` (``word``, ``n``), the spellings that the corpus has of
    them; canonical is the commonest, of these the shortest, of these the first in binary order, so it does not depend on the rows'
    order. Only what the mapping leaves as it is can be canonical. Counting different words first leaves a word of any frequency
    one row per task.
    """
    mapped = words.select("word").distinct().withColumn("_mapped", look_alike(F.col("word")))
    values = mapped.select(F.col("_mapped").alias("m"), F.lit(0).cast("bigint").alias("n"))
    if ordinary is not None:
        values = values.unionAll(ordinary.select(F.col("word").alias("m"), "n"))
    values = values.groupBy("m").agg(F.sum("n").alias("n")).withColumn("_class", F.collate("m", "UNICODE"))
    members = values.groupBy("_class").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("m").alias("l"), F.col("m").alias("m"))).alias("_best"))
    members = members.select("_class", F.col("_best.m").alias("canonical"))
    return mapped.withColumn("_class", F.collate("_mapped", "UNICODE")).join(members, "_class").select("word", "canonical")


def classes(df: DataFrame, fields: tuple[str, ...], words: DataFrame, max_broadcast_rows: int = 500_000) -> DataFrame:
    """:func:`canonical_words` of unusual words, over all spellings that the corpus has of what they are mapped to."""
    mapped, _ = small_side(words.select("word").distinct().select(look_alike(F.col("word")).alias("word")).distinct(), max_broadcast_rows)
    return cut_lineage(canonical_words(words, spellings(df, fields, mapped)))


def changed_words(df: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """Row id, ``field``, ``word``, ``canonical`` of each word that is not its class's canonical member."""
    # both sides of the join read the words; the texts are searched once
    words = cut_lineage(unusual_words(df, row_id, fields))
    return words.join(classes(df, fields, words).filter(F.col("word") != F.col("canonical")), "word")


def odd_words(df: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """As :func:`changed_words`, and also words of mixed alphabets for which no look-alike is known; these keep their form."""
    words = cut_lineage(unusual_words(df, row_id, fields))
    told = classes(df, fields, words).withColumn("_mixed", mixed_word(F.col("word")))
    return words.join(told.filter((F.col("word") != F.col("canonical")) | F.col("_mixed")).drop("_mixed"), "word")


def unify(df: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """Row id, ``field`` and ``text`` in one form, for every text that is not null.

    Empty texts stay empty. Ids must be unique. Texts without an unusual character pass by; only the others meet the words that
    change, in a shuffle of their own.
    """
    swaps = changed_words(df, row_id, fields).groupBy(row_id, "field").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("_swap"))
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    texts = df.select(row_id, F.explode(parts).alias("_x")).select(row_id, "_x.field", "_x.text").filter(F.col("text").isNotNull())
    unusual = F.col("text").rlike(MAYBE_UNUSUAL) & F.col("text").rlike(f"[{UNUSUAL}]")
    out = texts.filter(unusual).join(swaps, [row_id, "field"], "left")
    pieces = F.regexp_extract_all("text", F.lit(rf"[^{ORDINARY_SPACE}]+|[{ORDINARY_SPACE}]+"), F.lit(0))
    swapped = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.col("_swap"), p), p)), "")
    out = out.select(row_id, "field", F.when(F.col("_swap").isNull(), F.col("text")).otherwise(swapped).alias("text"))
    return texts.filter(~unusual).select(row_id, "field", "text").unionAll(out)
