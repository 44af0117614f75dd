"""Bodies that were never filled or hold what the fetcher got instead of the page.

Bodies are cut into units (lines, sentences, clauses of a notice). A few trusted seeds label some units as filler, notice or
placeholder; all others are reached through the components of a graph of units. Its edges are of two kinds: units that are
near-duplicates, and units that make up messages together, as the causes and hints that error pages attach to their headings.
Units get a SimHash of their words, by which equal ones count once. Blocks of its bits would lose short units that are 0.8
alike, so the tables are partitioned by a prefix of each unit's sorted five-word shingles, which two such units share whatever
their length; Hamming distance and Jaccard similarity of the shingles confirm what meets. Labels spread from the seeds round by
round until no component grows. Ids and numbers are masked before hashing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.unicode_forms import INVISIBLE, LOOK_ALIKE
from marketweave.session import cut_lineage, shared_table, small_side

#: Labels; LATIN is filler told by its vocabulary alone, which needs no near-duplicates: those are told the same way.
NOTICE, FILLER, PLACEHOLDER, LATIN = 1, 2, 3, 4
SHINGLE, MIN_SIMILARITY = 5, 0.8
#: A unit of n different shingles has the first n // PREFIX_OF + 1 in order as keys: at a similarity of 1 - 1 / PREFIX_OF two units share one.
PREFIX_OF = 5
#: Bits in which the SimHashes of units that share a key may differ before their texts are compared; unlike texts differ in about 32.
MAX_HAMMING = 24
#: Bits of the table that keys are looked up in.
TABLE_BITS = 22
#: Lower bits of a shingle's hash that keys leave out; a batch has at most as many units as these bits can number.
KEY_CUT = 20
#: A notice stands in place of an article if at most so many characters of other text, outlet's lines aside, are around it.
MAX_OTHER_CHARS = 250
#: A unit in so many different bodies of one source is an outlet's line.
STANDING_ARTICLES = 10
#: A unit belongs to messages if it stands beside labelled units in so many different bodies, in such a share of the bodies that
#: hold it, and such a share of these has no other text; units of fewer characters say too little.
MESSAGE_BODIES, MESSAGE_SHARE, SHORT_SHARE, LEAST_CHARS = 2, 0.15, 0.9, 4

# Notations of unfilled placeholders.
PLACEHOLDERS = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%[^%\n]+%>|[$#]\{[\w. ]+\}|\{[A-Za-z_][\w.]*\}|\[\[[\w. ]+\]\]"
    r"|<<[\w. ]+>>|@@\w+@@|__[A-Za-z]\w*?__|%[A-Z][A-Z0-9_]+%|\$[A-Z][A-Z0-9_]+\$|\*\|\w+\|\*"
    r"|\[(?:insert|your|enter|add)\s[^\[\]\n]+\]|\[[^\[\]\n]+\sTK\]",
    re.IGNORECASE,
)
PLACEHOLDER_CASE = re.compile(r"^(?:%[^%]*[a-z][^%]*%|\$[^$]*[a-z][^$]*\$)$")
# Words of the usual filler text.
FILLER_WORDS = frozenset((
    "lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "adipisicing", "elit", "sed", "do", "eiusmod", "tempor",
    "incididunt", "ut", "labore", "et", "dolore", "magna", "aliqua", "enim", "ad", "minim", "veniam", "quis", "nostrud",
    "exercitation", "ullamco", "laboris", "nisi", "aliquip", "ex", "ea", "commodo", "consequat", "duis", "aute", "irure", "in",
    "reprehenderit", "voluptate", "velit", "esse", "cillum", "eu", "fugiat", "nulla", "pariatur", "excepteur", "sint", "occaecat",
    "cupidatat", "non", "proident", "sunt", "culpa", "qui", "officia", "deserunt", "mollit", "anim", "id", "est", "laborum",
))
# Words that fill a place when they are said over and over.
SAY_NOTHING = frozenset(("tk", "asdf", "qwerty", "test", "text", "teks", "contoh", "texto", "ejemplo", "sample", "dummy", "placeholder", "copy", "blah"))
# The seeds of filler, on masked text; a short phrase said three times over is one too. Those that begin a unit are
# tried at its start only, apart from those that may stand anywhere.
FILLER_START = re.compile(
    r"(?:this is (?:only |just )?)?(?:a )?(?:placeholder|dummy|filler|sample|blind) ?(?:text|copy|content)\b"
    r"|(?:please )?(?:enter|insert|add|type) (?:your )?(?:text|title|copy|content)(?: here)?$"
)
FILLER_SEED = re.compile(r"\b(?:(?:dummy text|platzhalter|texto de relleno)|(?:text|content|copy) (?:goes here|to come))$")
# The seeds of notices, on masked text: a status, a failure, a wait, scripts that are wanted, a page that is missing.
NOTICE_START = re.compile(
    r"(?:http |error |fehler |kesalahan )+(?:[45]xx|9)\b|[45]xx (?:\w+ ){0,2}(?:not found|forbidden|unavailable|timeout|error)"
    r"|(?:internal server|fatal|database connection) error\b|uncaught exception\b|too many requests\b|(?:sorry )?something went wrong\b|(?:your session 9 has expired|access denied)\b"
    r"|(?:checking your (?:connection|browser)|loading (?:page|story) 9)\b"
    r"|(?:\w+ ){0,4}(?:javascript|scripts) (?:is|are) (?:required|disabled|turned off|blocked)\b|(?:please )?(?:enable|turn on|activate) (?:javascript|scripts)\b"
    r"|(?:sorry )?(?:this|the) (?:page|story|article|content|site)(?: \w+){0,5} (?:does not exist|could not be (?:loaded|found)|(?:is )?not available)\b|this (?:page|story) isn't available\b"
    r"|(?:this (?:site|page) (?:requires|needs) (?:javascript|scripts)|terjadi kesalahan pada server)\b"
    r"|(?:página|seite|halaman) (?:no|não|nicht|tidak) (?:encontrada|gefunden|ditemukan)\b"
    r"|(?:an|our|the) (?:\w+ )?(?:error|servers?) (?:has occurred|(?:is|are) (?:having|experiencing) (?:trouble|difficulties))\b"
)
NOTICE_SEED = re.compile(
    r"\b(?:your browser does not support (?:javascript|scripts|scripting)|(?:aktivieren sie|aktifkan|active) javascript"
    r"|you need to enable (?:javascript|scripts)|this site requires javascript|javascript is turned off in your browser|no script support found|your browser blocks active content|seite nicht gefunden fehler)\b"
    # these may also end a unit that begins with an outlet's line
    r"|\b(?:[45]xx (?:\w+ ){0,2}(?:forbidden|unavailable|timeout)|http [45]xx|loading (?:page|story) 9|(?:javascript|scripts) required)$"
)
# Words that make a unit worth the rules above; every text that the rules take holds one.
HINT = re.compile(
    r"^(?:[45]xx|error|fehler|kesalahan|http|javascript|scripts|page|story|article|content|site|página|seite|halaman|servers?|text|copy|platzhalter|relleno|title"
    r"|exception|requests|something|session|access|checking|loading|browser|script)$"
)
_EDGES = "\x00 .,;:!?\"'()[]<>…|-–—#*«»“”‘’/\\=_{}%$@^~`+&"
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_STATUS = re.compile(r"[45]\d\d$")
_FOLD = {c: None for a, b in INVISIBLE for c in range(a, b + 1) if c not in (9, 10, 13)}
_FOLD |= {ord(a): b for a, b in LOOK_ALIKE.items()}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0x3000: " "}
_FOLDED = frozenset(map(chr, _FOLD))


def fold(text: str) -> str:
    """``text.translate(_FOLD)``; few texts hold more than a few of these characters, and whole texts take long to translate."""
    if text.isascii():
        return text
    there = _FOLDED & set(text)
    if len(there) > 10:
        return text.translate(_FOLD)
    for c in there:  # in any order, as none is replaced by another
        text = text.replace(c, _FOLD[ord(c)] or "")
    return text


_BREAK, _SEPARATORS = "\x00", frozenset(("-", "–", "—", "|", "·", "\x00"))


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class _Ids(dict):
    """Numbers of words; one that isn't there yet is added."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: str) -> int:
        return self.add(word)


class Vocabulary:
    """Number, masked form, hash, marks and length of each different word that a worker meets."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids(self.add)
        self.masked: list[str] = []
        self.rows: list[tuple[int, bool, bool, int]] = []
        self.table = None

    def add(self, word: str) -> int:
        low = word.lower().strip(_EDGES)
        masked = (f"{low[0]}xx" if _STATUS.match(low) else "9") if any(c.isdigit() for c in low) else low
        ends = word in _SEPARATORS or word[-1] in ".!?…" or word.rstrip("\"')]”’»")[-1:] in (".", "!", "?", "…") or (word[-1] == ":" and len(word) > 1)
        self.masked.append(masked)
        self.rows.append((_hash(masked) if masked else 0, ends, masked in _LOREM_HINT or bool(HINT.match(masked)), len(word)))
        n = self.ids[word] = len(self.masked) - 1
        self.table = None
        return n

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if self.table is None:
            h, e, k, n = zip(*self.rows)
            self.table = np.array(h, np.uint64), np.array(e, bool), np.array(k, bool), np.array(n, np.int64)
        return self.table


_LOREM_HINT = frozenset("lorem ipsum consectetur adipiscing adipisicing eiusmod incididunt aliqua labore tempor magna amet dolore".split())


def said_over(words: list[str]) -> bool:
    """Whether a phrase of up to three words that say nothing stands three times in a row."""
    empty = [w in SAY_NOTHING or (len(w) > 2 and w == w[0] * len(w)) for w in words]
    for n in (1, 2, 3):
        same = 0
        for i in range(n, len(words)):
            same = same + 1 if empty[i] and words[i] == words[i - n] else 0
            if same >= 2 * n:
                return True
    return False


def label(masked: list[str]) -> int:
    """Trusted label of a unit of masked words, 0 if none."""
    words = [w for w in masked if w]
    known = sum(w in FILLER_WORDS for w in words)
    if len(words) >= 3 and known >= 0.8 * len(words) and any(w in _LOREM_HINT for w in words):
        return LATIN
    text = " ".join(words)
    if FILLER_START.match(text) or FILLER_SEED.search(text) or said_over(words):
        return FILLER
    return NOTICE if NOTICE_START.match(text) or NOTICE_SEED.search(text) else 0


def simhashes(features: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of feature hashes; ``start`` has the runs' offsets."""
    out = np.zeros(len(start), np.uint64)
    size = np.diff(np.append(start, len(features)))
    step, i = 100_000, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + step)))
        a, b = start[i], start[j] if j < len(start) else len(features)
        # eight bits are summed as the bytes of one number, over pieces so short that no byte overflows
        bits = np.unpackbits(features[a:b].view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        pieces = -(-size[i:j] // 255)
        first = np.cumsum(pieces) - pieces
        begin = np.repeat(start[i:j] - a, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        ones = np.add.reduceat(bits, begin, axis=0).view(np.uint8).astype(np.int32)
        if len(ones) > j - i:
            ones = np.add.reduceat(ones, first, axis=0)
        out[i:j] = np.packbits(ones * 2 > size[i:j, None], axis=1).view(np.uint64).ravel()
        i = j
    return out


class Units:
    """Units of a batch of texts, as parallel arrays; one pass over the words, the rest in numpy."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        v, words, sizes = vocabulary, [], []
        if len(v.ids) > 500_000:
            v.clear()
        for t in texts:
            t = fold(t)
            if "<" in t:
                t = _TAG.sub(" ", t)
            w = t.replace("\n", " \x00 ").replace("\r", " \x00 ").split()
            w.append(_BREAK)
            words += w
            sizes.append(len(w))
        sizes = np.array(sizes, np.int64)
        at = np.fromiter(map(v.ids.__getitem__, words), np.int64, len(words))
        hashes, ends, hint, length = (c[at] for c in v.columns())
        self.words, self.masked, self.at = words, v.masked, at
        length += 1
        stop = np.flatnonzero(ends) + 1  # each text ends with a break
        begin = np.concatenate([[0], stop[:-1]])
        text_end = np.cumsum(sizes)
        real = hashes != 0
        count = np.add.reduceat(real, begin, dtype=np.int64)
        some = count > 0
        self.begin, self.stop = begin[some], stop[some]
        self.text = np.searchsorted(text_end, self.begin, side="right")
        self.length = np.add.reduceat(length, begin)[some]
        over = np.zeros(len(at), bool)
        for k in (1, 2, 3):  # the same word k words on, twice
            n = max(0, len(at) - 2 * k)
            over[:n] |= (hashes[:n] == hashes[k:k + n]) & (hashes[:n] == hashes[2 * k:2 * k + n]) & real[:n]
        self.hint = np.add.reduceat(hint | over, begin, dtype=np.int64)[some] > 0
        # of all words of a text, masks applied, in any order
        self.digest = np.add.reduceat(hashes, text_end - sizes)
        # signs alone are no words
        solid, n = hashes[real], count[some]
        first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        self.hash = simhashes(solid, first) if len(solid) else np.zeros(0, np.uint64)
        self.solid, self.first, self.count = solid, first, n

    def prefixes(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of some units in one array, their number for each unit, and its number of different shingles."""
        if not len(of):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, count = self.first[of], self.count[of]
        each = np.maximum(1, count - SHINGLE + 1)
        unit = np.repeat(np.arange(len(each)), each)
        at = np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(len(unit))
        end, gram = (begin + count)[unit], np.zeros(len(unit), np.uint64)
        for k in range(SHINGLE):
            there = at + k < end
            word = self.solid[np.where(there, at + k, 0)]
            gram = (gram ^ np.where(there, word, np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
            gram ^= gram >> np.uint64(29)
        # units and the upper bits of their shingles in one number, which sorts faster than two
        bits = np.uint64(max(1, int(len(of)).bit_length()))
        both = np.sort((unit.astype(np.uint64) << (np.uint64(64) - bits)) | (gram >> bits))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        unit, gram = (both >> (np.uint64(64) - bits)).astype(np.int64), both << bits
        different = np.bincount(unit, minlength=len(each))
        keys = different // PREFIX_OF + 1
        rank = np.arange(len(unit)) - (np.cumsum(different) - different)[unit]
        chosen = rank < keys[unit]
        # the order must not depend on the number of units beside: the same upper bits for every batch
        return (gram[chosen] & ~np.uint64((1 << KEY_CUT) - 1)).view(np.int64), keys, different

    def label(self, i: int) -> int:
        return label([self.masked[j] for j in self.at[self.begin[i]:self.stop[i]]])

    def shingle_set(self, i: int) -> list[int]:
        """Hashes of the five-word shingles of a unit; a shorter unit is one shingle."""
        words = [w for w in (self.masked[j] for j in self.at[self.begin[i]:self.stop[i]]) if w]
        grams = {" ".join(words[k:k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
        return sorted(_hash(g) - (1 << 63) for g in grams)


def has_placeholder(text: str) -> str | None:
    """The first unfilled placeholder of a text."""
    # every notation has one of these; a search takes long
    if not any(x in text for x in ("{", "[", "<%", "<<", "@@", "__", "*|")) and text.count("%") < 2 and text.count("$") < 2:
        return None
    for m in PLACEHOLDERS.finditer(text):
        if not PLACEHOLDER_CASE.match(m[0]):
            return m[0]
    return None


_ROW = pa.schema([
    ("id", pa.int64()), ("h", pa.int64()), ("chars", pa.int32()), ("label", pa.int8()), ("s", pa.int64()), ("d", pa.int64()), ("n", pa.int32()),
    ("keys", pa.list_(pa.int64())),
])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary, told = Vocabulary(), set()
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.slice(i, 500)
            ids, source, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
            u = Units(vocabulary, texts)
            labels = np.zeros(len(u.hash), np.int8)
            for j in np.flatnonzero(u.hint).tolist():
                labels[j] = u.label(j)
            # one row of a hash that this worker meets carries its keys
            hashes, first = np.unique(u.hash, return_index=True)
            fresh = np.sort(np.array([j for j, h in zip(first.tolist(), hashes.tolist()) if h not in told], np.int64))
            told.update(u.hash[fresh].tolist())
            if len(told) > 1_000_000:
                told.clear()
            each, n, found = np.zeros(len(u.hash), np.int32), np.zeros(len(u.hash), np.int32), [np.zeros(0, np.int64)]
            for a in range(0, len(fresh), 1 << KEY_CUT):
                of = fresh[a:a + (1 << KEY_CUT) - 1]
                keys, each[of], n[of] = u.prefixes(of)
                found.append(keys)
            ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                ids[u.text], u.hash.view(np.int64), u.length.astype(np.int32), labels, source[u.text], u.digest[u.text].view(np.int64), n,
            )] + [keys], schema=_ROW)
            marks = [(k, p) for k, t in enumerate(texts) if (p := has_placeholder(t))]
            if marks:
                at, m = [k for k, _ in marks], len(marks)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    ids[at], np.array([_hash(p) for _, p in marks], np.uint64).view(np.int64), np.zeros(m, np.int32), np.full(m, PLACEHOLDER, np.int8),
                    source[at], u.digest[at].view(np.int64), np.zeros(m, np.int32),
                )] + [pa.array([[]] * m, pa.list_(pa.int64()))], schema=_ROW)


def text_units(df: DataFrame, row_id: str, text: str, source: str | None = None) -> DataFrame:
    """``id``, ``h``, ``chars``, ``label`` of each unit, ``s`` (its source) and ``d`` (a digest of its body), as a table in the shared folder.

    ``n`` (different shingles) and ``keys`` are set in one row at least of each ``h``.
    """
    src = F.xxhash64(F.col(source)) if source else F.lit(0).cast("bigint")
    texts = df.select(F.col(row_id).cast("bigint").alias("_id"), src.alias("_source"), F.col(text).alias("_text"))
    texts = texts.filter(F.col("_id").isNotNull() & F.col("_text").isNotNull())
    units = texts.mapInArrow(_unit_rows, "id bigint, h bigint, chars int, label tinyint, s bigint, d bigint, n int, keys array<bigint>")
    return shared_table(units, "units")


def _meeting(keyed: DataFrame, at: DataFrame) -> DataFrame:
    """``h``, ``n``, ``k`` and an ``id`` of the units that share a key with ``at``.

    What is sent out is a table of 4.2 million bits, as large at every size; it spares all other units the join.
    """
    shift = 64 - TABLE_BITS
    taken = np.zeros(1 << TABLE_BITS, bool)
    taken[at.select(F.shiftrightunsigned("k", shift).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)] = True
    shared = keyed.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            lists = batch.column(3)
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            found = np.flatnonzero(bits[(keys.view(np.uint64) >> np.uint64(shift)).astype(np.int64)])
            hits = batch.take(pa.array(row[found]))
            yield pa.RecordBatch.from_arrays([hits.column(0), hits.column(1), hits.column(2), pa.array(keys[found], pa.int64())], names=["h", "id", "n", "k"])

    met = keyed.select("h", "id", "n", "keys").mapInArrow(meet, "h bigint, id bigint, n int, k bigint")
    return met.groupBy("h", "n", "k").agg(F.min("id").alias("id"))


def _shingles(df: DataFrame, row_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``h`` and the shingle sets of its units in the articles ``id`` that ``wanted`` names."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary()
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i:i + 500]
                u, h = Units(vocabulary, part["_text"].tolist()), part["h"].to_numpy(np.int64)
                # a row's unit may be there more than once, in another order of its words
                at = np.flatnonzero(u.hash.view(np.int64) == h[u.text]).tolist()
                yield pd.DataFrame([(h[u.text[k]], u.shingle_set(k)) for k in at], columns=["h", "s"])

    texts = df.select(F.col(row_id).cast("bigint").alias("id"), F.col(text).alias("_text"))
    return texts.join(wanted.select("id", "h"), "id").select("h", "_text").mapInPandas(extract, "h bigint, s array<bigint>").distinct()


def _alike(df: DataFrame, row_id: str, text: str, units: DataFrame, standing: DataFrame, keyed: DataFrame, labelled: DataFrame, frontier: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``h``, ``label`` of units that aren't labelled yet and are near-duplicates of the frontier."""
    few, _ = small_side(frontier, max_broadcast_rows)
    theirs = keyed.join(few.select("h", F.col("label").alias("flabel")), "h").select(F.col("h").alias("fh"), "flabel", F.col("n").alias("fn"), "id", F.explode("keys").alias("k"))
    at, few_keys = small_side(theirs.groupBy("fh", "flabel", "fn", "k").agg(F.min("id").alias("fid")), max_broadcast_rows)
    # few keys meet all others where these are read; more are looked up in a table before both sides are shuffled
    near = keyed.select("h", "id", "n", F.explode("keys").alias("k")) if few_keys else _meeting(keyed, at)
    like = (F.col("n") * PREFIX_OF >= F.col("fn") * (PREFIX_OF - 1)) & (F.col("fn") * PREFIX_OF >= F.col("n") * (PREFIX_OF - 1))
    like = like & (F.bit_count(F.col("h").bitwiseXOR(F.col("fh"))) <= MAX_HAMMING)
    pairs = near.join(at, "k").filter((F.col("h") != F.col("fh")) & like)
    pairs = pairs.join(labelled.select("h"), "h", "left_anti").groupBy("h", "fh").agg(F.max("flabel").alias("label"), F.min("id").alias("id"), F.min("fid").alias("fid"))
    pairs = cut_lineage(pairs)
    if pairs.isEmpty():
        return pairs.select("h", "label")
    wanted, _ = small_side(pairs.select("id", "h").unionAll(pairs.select("fid", "fh")).distinct(), max_broadcast_rows)
    sets = cut_lineage(_shingles(df, row_id, text, wanted))
    both = pairs.select("h", "fh", "label").join(sets.select("h", F.col("s").alias("s1")), "h").join(sets.select(F.col("h").alias("fh"), F.col("s").alias("s2")), "fh")
    common = F.size(F.array_intersect("s1", "s2"))
    sure = both.filter(common >= MIN_SIMILARITY * (F.size("s1") + F.size("s2") - common))
    found = cut_lineage(sure.groupBy("h").agg(F.max("label").alias("label")))
    notices, _ = small_side(found.filter(F.col("label") == NOTICE).select("h"), max_broadcast_rows)
    if notices.isEmpty():
        return found
    # an outlet's line may be like a unit in which it runs into a notice
    return cut_lineage(found.filter(F.col("label") != NOTICE).unionAll(_messages(units, standing, labelled, notices, max_broadcast_rows)))


def standing_lines(units: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``h``, ``s`` of the units that are lines of the source ``s``: they are in many different bodies of it.

    Found once, as labels don't bear on them. Only units in as many rows are counted by body.
    """
    often = units.groupBy("h", "s").count().filter(F.col("count") >= STANDING_ARTICLES).select("h", "s")
    often, _ = small_side(often, max_broadcast_rows)
    holders = units.join(often, ["h", "s"], "left_semi").groupBy("h", "s").agg(F.count_distinct("d").alias("n"))
    standing, _ = small_side(holders.filter(F.col("n") >= STANDING_ARTICLES).select("h", "s"), max_broadcast_rows)
    return standing


def _other_text(units: DataFrame, standing: DataFrame, ids: DataFrame, labels: DataFrame) -> DataFrame:
    """``id``, ``h``, ``chars``, ``d`` of the units in the articles ``ids`` that are neither labelled nor lines of their source."""
    theirs = units.filter(F.col("chars") > 0).select("id", "h", "chars", "s", "d").join(ids, "id", "left_semi").join(labels.select("h"), "h", "left_anti")
    return theirs.join(standing, ["h", "s"], "left_anti").select("id", "h", "chars", "d")


def _messages(units: DataFrame, standing: DataFrame, labelled: DataFrame, maybe: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``h``, ``label`` of those units ``maybe`` of which nearly all bodies have no text but them, labelled units, standing lines and little else."""
    holders = cut_lineage(units.join(maybe, "h", "left_semi").select("id", "h", "d").distinct())
    ids, _ = small_side(holders.select("id").distinct(), max_broadcast_rows)
    other = cut_lineage(_other_text(units, standing, ids, labelled).groupBy("id", "h", "d").agg(F.sum("chars").alias("chars")))
    whole = other.groupBy("id").agg(F.sum("chars").alias("all"))
    # all bodies that hold the unit count, those too in which it is a line of the source
    each = holders.join(whole, "id", "left").join(other.select("id", "h", "chars"), ["id", "h"], "left")
    rest = F.coalesce(F.col("all"), F.lit(0)) - F.coalesce(F.col("chars"), F.lit(0))
    each = each.select("h", "d", (rest <= MAX_OTHER_CHARS).alias("short"))
    each = each.groupBy("h").agg(F.count_distinct("d").alias("n"), F.count_distinct(F.when(F.col("short"), F.col("d"))).alias("short"))
    return cut_lineage(each.filter(F.col("short") >= SHORT_SHARE * F.col("n")).select("h", F.lit(NOTICE).cast("tinyint").alias("label")))


def _together(units: DataFrame, standing: DataFrame, labelled: DataFrame, touched: DataFrame, known: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """``h``, ``label`` of units that make up messages with labelled ones: units in the articles ``touched``, which hold notices of the frontier.

    A unit counts by the bodies that hold it: enough of them hold a labelled notice (the articles ``known``), and nearly all are
    messages. Common lines are out by the first count, before any other text is read.
    """
    beside = units.filter(F.col("chars") >= LEAST_CHARS).join(touched, "id", "left_semi").select("h").distinct().join(labelled.select("h"), "h", "left_anti")
    beside, _ = small_side(beside, max_broadcast_rows)
    held = units.join(beside, "h", "left_semi").select("h", "id", "d").join(known.select("id", F.lit(True).alias("known")), "id", "left")
    counts = held.groupBy("h").agg(F.count_distinct("d").alias("n"), F.count_distinct(F.when(F.col("known"), F.col("d"))).alias("told"))
    maybe = counts.filter((F.col("told") >= MESSAGE_BODIES) & (F.col("told") >= MESSAGE_SHARE * F.col("n"))).select("h")
    maybe, few = small_side(maybe, max_broadcast_rows)
    if few and maybe.isEmpty():
        return maybe.select("h", F.lit(NOTICE).cast("tinyint").alias("label"))
    return _messages(units, standing, labelled, maybe, max_broadcast_rows)


def spread_labels(df: DataFrame, row_id: str, text: str, units: DataFrame, max_broadcast_rows: int = 500_000, standing: DataFrame | None = None) -> DataFrame:
    """``h``, ``label`` of all units in components that hold a trusted label (notice and filler; the others stand alone).

    Units of the same words, masks applied, have one hash and count as one text. Rounds go on until none adds a unit.
    """
    standing = standing_lines(units, max_broadcast_rows) if standing is None else standing
    keyed = units.filter(F.size("keys") > 0).filter(~F.col("label").isin(PLACEHOLDER, LATIN)).select("h", "id", "n", "keys")
    # with a broadcast hint: where these are left out, Spark moves that before the joins, onto all units
    labelled, _ = small_side(units.filter(F.col("label").isin(NOTICE, FILLER)).groupBy("h").agg(F.max("label").alias("label")), max_broadcast_rows)
    alike = beside = labelled
    known = None
    while True:
        if not alike.isEmpty():
            alike = _alike(df, row_id, text, units, standing, keyed, labelled, alike, max_broadcast_rows)
            labelled, _ = small_side(labelled.unionAll(alike), max_broadcast_rows)
            beside = beside.unionAll(alike)
            continue
        if beside.isEmpty():
            return labelled
        # every labelled notice was in the frontier of one round, so the articles that hold one are those touched so far
        fresh, _ = small_side(beside.filter(F.col("label") == NOTICE).select("h"), max_broadcast_rows)
        touched, _ = small_side(units.join(fresh, "h", "left_semi").select("id").distinct(), max_broadcast_rows)
        known = touched if known is None else small_side(known.unionAll(touched).distinct(), max_broadcast_rows)[0]
        alike = beside = _together(units, standing, labelled, touched, known, max_broadcast_rows)
        labelled, _ = small_side(labelled.unionAll(alike), max_broadcast_rows)


def residue_articles(df: DataFrame, row_id: str = "seq", text: str = "body", max_broadcast_rows: int = 500_000, source: str | None = None) -> DataFrame:
    """``seq``, ``kind`` (notice, filler, placeholder: the strongest) of articles that hold residue.

    A placeholder anywhere or a unit of filler is enough. A notice counts if the text beside notices and standing lines of
    outlets has at most ``MAX_OTHER_CHARS`` characters. Null and empty texts are no residue; repeated rows give one; other
    columns are not read, but for ``source``, within which standing lines are counted, over bodies that differ in their masked
    words; without it all articles are of one source. Ids must be bigint; rows without id give nothing. An empty table gives an empty result.
    """
    units = text_units(df, row_id, text, source)
    standing = standing_lines(units, max_broadcast_rows)
    labels, _ = small_side(spread_labels(df, row_id, text, units, max_broadcast_rows, standing), max_broadcast_rows)
    told = F.when(F.col("label") == LATIN, FILLER).otherwise(PLACEHOLDER)
    sure = units.filter(F.col("label").isin(PLACEHOLDER, LATIN)).select("id", told.alias("label"))
    hits = units.filter(~F.col("label").isin(PLACEHOLDER, LATIN)).join(labels.withColumnRenamed("label", "known"), "h")
    hits = sure.unionAll(hits.select("id", F.col("known").cast("int"))).groupBy("id").agg(F.max("label").alias("label"))
    hits = cut_lineage(hits)
    noticed, _ = small_side(hits.filter(F.col("label") == NOTICE).select("id"), max_broadcast_rows)
    other = _other_text(units, standing, noticed, labels).groupBy("id").agg(F.sum("chars").alias("other"))
    out = hits.join(other, "id", "left").filter((F.col("label") != NOTICE) | (F.coalesce(F.col("other"), F.lit(0)) <= MAX_OTHER_CHARS))
    names = F.when(F.col("label") == PLACEHOLDER, "placeholder").when(F.col("label") == FILLER, "filler").otherwise("notice")
    return out.select(F.col("id").alias(row_id), names.alias("kind"))
