"""Reading level of documents from n-gram surprisal.

Interpolated trigram models, one for each rated level, are trained on rated documents. A document's surprisal is distributed over its
words under each; mean and upper quantiles of the distributions, easier models against harder ones, rise with the level. Isotonic
regression maps them to the chance of being above each level, per language; the chances add up to the difficulty. Texts fall on two sides by their hash; each side is
scored with models trained on the other, so no text meets models that have learned it, and the regression sees the scores of
unrated texts. The fit is on all rated documents: executors count their words and n-grams and score them, the counts lie in the
shared folder, from where each worker reads the models, and the driver gets the vocabulary and the blocks of the regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.session import shared_folder, shared_table, small_side

LEVELS = 5
#: Most rated ids that are broadcast to meet the texts; more of them meet by a shuffle.
MAX_BROADCAST_ROWS = 500_000
#: Words whose n-grams a task counts at a time.
COUNTED_WORDS = 1_000_000
#: Weights of unigrams, bigrams and trigrams.
WEIGHTS = (0.3, 0.4, 0.3)
#: Weights of the mean and of the quantiles at 3/4 and 9/10 of a surprisal distribution (nats).
PROFILE = (1.0, 0.25, 0.25)
#: Weight of a model by how many levels it is away from the border between two levels.
NEARER = 0.5
#: A word in fewer rated documents is taken as rare; rare words are one word to the models.
MIN_WORD_DOCS = 4
#: A language with fewer rated documents is mapped by the regression over all languages.
MIN_LANGUAGE_DOCS = 60
#: A language of fewer rated documents is not told apart.
MIN_SEEN = 10
#: A side with fewer rated documents trains no model alone.
MIN_SIDE_DOCS = 20

#: A column for each border between two levels.
ABOVE = tuple(f"above_{k}" for k in range(1, LEVELS))
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares nondecreasing fit by pooling adjacent violators: both ends of each block, and its fitted y for each end.

    Between two blocks the map is a line, inside one it is flat, so a jump of the levels stays where the scores have their gap.
    """
    ux, at = np.unique(x, return_inverse=True)
    w = np.bincount(at).astype(float)
    v = np.bincount(at, weights=y) / w
    return ends(pooled(zip(ux, ux, v, w)))


def pooled(parts) -> list[list[float]]:
    """Blocks (start, end, mean, weight) of the fit over parts in order, which may be blocks of pieces of the data themselves."""
    blocks: list[list[float]] = []
    for part in parts:
        blocks.append(list(part))
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, end, b2, c2 = blocks.pop()
            start, _, b1, c1 = blocks[-1]
            blocks[-1] = [start, end, (b1 * c1 + b2 * c2) / (c1 + c2), c1 + c2]
    return blocks


def ends(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([e for b in blocks for e in b[:2]]), np.array([b[2] for b in blocks for _ in range(2)])


def has_digit(word: str) -> bool:
    return any(c.isdigit() for c in word)


class Codes(dict):
    """Number of each word: from 2 those of the vocabulary, 1 for words with digits, 0 for rare ones; these two are kept as they come."""

    def __init__(self, kept: list[str]):
        super().__init__((w, i + 2) for i, w in enumerate(kept))
        self.most = len(self) + 200_000

    def __missing__(self, word: str) -> int:
        code = int(word[0] <= "9" or has_digit(word))
        if len(self) < self.most:
            self[word] = code
        return code

    def encode(self, text: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, text), np.int64, len(text))


def ngrams(s: np.ndarray, n: int, v: int) -> np.ndarray:
    """A key for each run of ``n`` words."""
    if n == 1:
        return s
    return s[:-1] * v + s[1:] if n == 2 else (s[:-2] * v + s[1:-1]) * v + s[2:]


class LevelModel:
    """Interpolated n-gram models of all levels over one vocabulary, as sorted arrays."""

    def __init__(self, texts: list[list[str]], levels: np.ndarray, languages: list[str | None]):
        docs = Counter(w for t in texts for w in set(t))
        kept = sorted(w for w, n in docs.items() if n >= MIN_WORD_DOCS and not has_digit(w))
        codes, v = Codes(kept), len(kept) + 2
        seqs = [codes.encode(t) for t in texts]
        uni = np.zeros((v, LEVELS))
        for s, k in zip(seqs, levels):
            np.add.at(uni[:, k - 1], s, 1)
        counted = Counter(x for x in languages if x and x != "und")
        names = sorted(x for x, n in counted.items() if n >= MIN_SEEN)
        per = np.zeros((v, len(names)))
        for s, x in zip(seqs, languages):
            if x in names:
                np.add.at(per[:, names.index(x)], s, 1)
        self._set(kept, uni, *self._table(seqs, levels, lambda s: ngrams(s, 2, v)), *self._table(seqs, levels, lambda s: ngrams(s, 3, v)), names, per)

    @classmethod
    def of_counts(cls, kept: list[str], uni: np.ndarray, k2: np.ndarray, n2: np.ndarray, k3: np.ndarray, n3: np.ndarray, languages: list[str], per: np.ndarray) -> LevelModel:
        """The model of texts that were counted elsewhere; keys in order."""
        model = cls.__new__(cls)
        model._set(kept, uni, k2, n2, k3, n3, languages, per)
        return model

    def _set(self, kept, uni, k2, n2, k3, n3, languages, per) -> None:
        self.ids = {w: i + 2 for i, w in enumerate(kept)}  # 0 rare, 1 number
        self.encode = Codes(kept).encode
        v = self.size = len(kept) + 2
        self.k2, self.k3, self.languages = k2, k3, languages
        self.p1 = ((uni + 0.5) / (uni.sum(axis=0) + 0.5 * v)).astype(np.float32)
        c2 = uni[self.k2 // v]
        self.p2 = np.where(c2 > 0, n2 / np.maximum(c2, 1), np.nan).astype(np.float32)
        at = np.searchsorted(self.k2, self.k3 // v)
        c3 = np.where((self.k2[np.minimum(at, len(self.k2) - 1)] == self.k3 // v)[:, None], n2[np.minimum(at, len(self.k2) - 1)], 0) if len(self.k2) else np.zeros_like(n3)
        self.p3 = np.where(c3 > 0, np.minimum(n3 / np.maximum(c3, 1), 1), np.nan).astype(np.float32)
        self.seen1 = uni > 0
        self.n2 = n2 > 0
        self.log_lang = np.log((per + 0.5) / (per.sum(axis=0) + 0.5 * v))
        self.log_lang[:2] = 0

    @staticmethod
    def _table(seqs: list[np.ndarray], levels: np.ndarray, keys) -> tuple[np.ndarray, np.ndarray]:
        each = [keys(s) for s in seqs]
        all_ = np.concatenate(each) if each else np.zeros(0, np.int64)
        level = np.repeat(np.asarray(levels) - 1, [len(e) for e in each]) if each else np.zeros(0, np.int64)
        uniq, at = np.unique(all_, return_inverse=True)
        n = np.zeros((len(uniq), LEVELS))
        np.add.at(n, (at, level), 1)
        return uniq, n

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted key, -1 if absent."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def surprisals(self, s: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Nats of each word under each level's model; ``start`` has the documents' offsets in the words."""
        v, n = self.size, len(s)
        p1 = self.p1[s]
        order = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        prev, prev2 = np.roll(s, 1), np.roll(s, 2)
        two, three = order >= 1, order >= 2
        a2 = np.where(two, self._find(self.k2, prev * v + s), -1)
        context1 = self.seen1[prev] & two[:, None]
        p2 = np.where(context1, np.where((a2 >= 0)[:, None], np.nan_to_num(self.p2[np.maximum(a2, 0)] if len(self.k2) else p1), 0), p1)
        c2 = np.where(three, self._find(self.k2, prev2 * v + prev), -1)
        context2 = (self.n2[np.maximum(c2, 0)] & (c2 >= 0)[:, None]) if len(self.k2) else np.zeros_like(context1)
        a3 = np.where(three, self._find(self.k3, (prev2 * v + prev) * v + s), -1)
        p3 = np.where(context2, np.where((a3 >= 0)[:, None], np.nan_to_num(self.p3[np.maximum(a3, 0)] if len(self.k3) else p2), 0), p2)
        return -np.log(WEIGHTS[0] * p1 + WEIGHTS[1] * p2 + WEIGHTS[2] * p3)

    def score(self, texts: list[list[str]]) -> pd.DataFrame:
        """``language``, ``above_1`` to ``above_4`` (how much less a text surprises the models above a level than those up to it), mean and
        90 % quantile of the least surprisal; NaN for texts without words."""
        seqs = [self.encode(t) for t in texts]
        n = np.array([len(s) for s in seqs])
        out = pd.DataFrame({"language": [None] * len(texts), **dict.fromkeys(ABOVE, np.nan), "surprisal_mean": np.nan, "surprisal_p90": np.nan})
        some = np.flatnonzero(n)
        if not len(some):
            return out
        flat = np.concatenate([seqs[i] for i in some])
        start = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        h = self.surprisals(flat, start)
        mean = np.add.reduceat(h, start, axis=0) / n[some][:, None]
        profile = PROFILE[0] * mean
        for row, a, k in zip(profile, start.tolist(), n[some].tolist()):
            upper, top = k * 3 // 4, k * 9 // 10
            part = np.partition(h[a:a + k], (upper, top), axis=0)
            row += PROFILE[1] * part[upper] + PROFILE[2] * part[top]
        for k, name in enumerate(ABOVE, 1):
            easier, harder = NEARER ** np.arange(k)[::-1], NEARER ** np.arange(LEVELS - k)
            out.loc[some, name] = profile[:, :k] @ easier / easier.sum() - profile[:, k:] @ harder / harder.sum()
        best = h.min(axis=1)
        out.loc[some, "surprisal_mean"] = np.add.reduceat(best, start) / n[some]
        out.loc[some, "surprisal_p90"] = [np.partition(best[a:a + k], k * 9 // 10)[k * 9 // 10] for a, k in zip(start, n[some])]
        if self.languages:
            like = np.add.reduceat(self.log_lang[flat], start, axis=0)
            out["language"] = out["language"].astype(object)
            out.loc[some, "language"] = np.array(self.languages, object)[like.argmax(axis=1)]
        return out


#: Maps of a regression that had nothing to fit on.
EVEN = [(np.zeros(1), np.full(1, 0.5))] * len(ABOVE)


class LevelGrader:
    """Models by the side that they score, and the isotonic maps from scores to levels."""

    def __init__(self, texts: list[list[str]], levels: np.ndarray, languages: list[str | None], side: np.ndarray):
        whole = np.floor(levels + 0.5).astype(int)
        self.models = []
        for s in (0, 1):
            train = side != s
            if train.sum() < MIN_SIDE_DOCS:
                train = np.ones(len(texts), bool)
            self.models.append(LevelModel([t for t, m in zip(texts, train) if m], whole[train], [x for x, m in zip(languages, train) if m]))
        scored = self.score(texts, side).assign(y=levels).dropna(subset=[ABOVE[0]])
        self.maps: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {None: self._fit(scored)}
        for language, g in scored.groupby("language"):
            if len(g) >= MIN_LANGUAGE_DOCS:
                self.maps[language] = self._fit(g)

    @classmethod
    def of(cls, models: list[LevelModel], maps: dict) -> LevelGrader:
        grader = cls.__new__(cls)
        grader.models, grader.maps = models, maps
        return grader

    @staticmethod
    def _fit(scored: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each border the map from a text's value to its chance of being above; nothing to fit on gives even chances."""
        if scored.empty:
            return EVEN
        return [isotonic(scored[name].to_numpy(), np.clip(scored["y"].to_numpy() - k, 0, 1)) for k, name in enumerate(ABOVE, 1)]

    def score(self, texts: list[list[str]], side: np.ndarray) -> pd.DataFrame:
        parts = []
        for s, model in enumerate(self.models):
            at = np.flatnonzero(side == s)
            if len(at):
                parts.append(model.score([texts[i] for i in at]).set_index(at))
        return pd.concat(parts).sort_index() if parts else self.models[0].score([])

    def grade(self, scored: pd.DataFrame) -> np.ndarray:
        """Graded difficulty, a number from 1 to the highest level; NaN without score."""
        out = np.full(len(scored), np.nan)
        names = scored["language"].to_numpy(object)
        for language in set(names):
            at = names == language
            maps = self.maps.get(language, self.maps[None])
            out[at] = 1 + sum(np.interp(scored[name].to_numpy()[at], x, y) for name, (x, y) in zip(ABOVE, maps))
        out[scored[ABOVE[0]].isna().to_numpy()] = np.nan
        return out


def rated_texts(docs: DataFrame, labels: DataFrame, max_fit_docs: int | None, max_fit_chars: int | None) -> DataFrame:
    """``doc_id``, ``text``, ``lang``, ``level``, ``_side`` of the rated documents, each once, as a table in the shared folder.

    A document's rating is the mean of its ratings that are not null and within the levels. A caller's bounds are kept by a hash
    of the ids; without bounds all rated documents are there.
    """
    rated = labels.filter(F.col("level").between(1, LEVELS)).groupBy("doc_id").agg(F.avg("level").alias("level"))
    if max_fit_docs is not None:
        # a share of the rated ids by their hash, a little under the bound; only these meet the texts
        share = min(1.0, 0.95 * max_fit_docs / max(rated.count(), 1))
        rated = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(max_fit_docs)
    rated, _ = small_side(rated, MAX_BROADCAST_ROWS)
    few = docs.select("doc_id", "text", "lang").filter(F.length(F.trim("text")) > 0).join(rated, "doc_id")
    if max_fit_chars is not None:
        sizes = few.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))
        few = few.join(sizes.withColumn("upto", upto).filter(F.col("upto") <= max_fit_chars).select("doc_id"), "doc_id")
    return shared_table(few.dropDuplicates(["doc_id"]).withColumn("_side", side_of("text")), "rated")


class Stored:
    """Where the counts of both models lie, and what their keys mean: the words, the languages."""

    def __init__(self, path: str, kept: list[list[str]], languages: list[list[str]]):
        self.path, self.kept, self.languages = path, kept, languages

    def models(self) -> list[LevelModel]:
        """Read once by each worker; of a table on another file system than the machine's, pyarrow has to know that system."""
        if self.path not in _READ:
            import pyarrow.dataset as ds

            where = "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path
            counts = ds.dataset(where, format="parquet")
            _READ.clear()
            _READ[self.path] = [self._model(counts, m) for m in (0, 1)]
        return _READ[self.path]

    def _model(self, counts, m: int) -> LevelModel:
        import pyarrow.compute as pc

        def table(order: int) -> tuple[np.ndarray, np.ndarray]:
            rows = counts.to_table(columns=["key", *LEVEL_COLUMNS], filter=(pc.field("m") == m) & (pc.field("o") == order))
            key = rows["key"].to_numpy()
            at = np.argsort(key)
            return key[at], np.stack([rows[c].to_numpy()[at] for c in LEVEL_COLUMNS], axis=1).astype(float)

        v, names = len(self.kept[m]) + 2, self.languages[m]
        uni, per = np.zeros((v, LEVELS)), np.zeros((v, len(names)))
        k, n = table(1)
        uni[k] = n
        if names:
            k, n = table(0)
            per[k // len(names), k % len(names)] = n[:, 0]
        return LevelModel.of_counts(self.kept[m], uni, *table(2), *table(3), names, per)


_READ: dict[str, list[LevelModel]] = {}
LEVEL_COLUMNS = tuple(f"n{k}" for k in range(1, LEVELS + 1))


def _count(rated: DataFrame, trains: list[list[int]]) -> Stored:
    """Vocabulary and n-gram counts of both models; ``trains`` has the sides that each learns from. All counting is on executors."""

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [Counter(), Counter()]
            for t, side in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs[side].update(set(words(t)))
            for side, c in enumerate(docs):
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["side", "w", "n"])

    each = [F.sum(F.when(F.col("side").isin(sides), F.col("n")).otherwise(0)).alias(f"m{m}") for m, sides in enumerate(trains)]
    often = rated.select("text", "_side").mapInArrow(heard, "side int, w string, n bigint").groupBy("w").agg(*each)
    often = often.filter(F.greatest("m0", "m1") >= MIN_WORD_DOCS).toPandas()
    kept = [sorted(w for w in often["w"][often[f"m{m}"] >= MIN_WORD_DOCS] if not has_digit(w)) for m in (0, 1)]
    known = rated.filter((F.col("lang") != "und") & (F.col("lang") != "")).groupBy("lang")
    known = known.agg(*[F.count(F.when(F.col("_side").isin(sides), 1)).alias(f"m{m}") for m, sides in enumerate(trains)]).filter(F.greatest("m0", "m1") >= MIN_SEEN).toPandas()
    languages = [sorted(known["lang"][known[f"m{m}"] >= MIN_SEEN]) for m in (0, 1)]
    shared = rated.sparkSession.sparkContext.broadcast((kept, languages))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, languages = shared.value
        codes = [Codes(k) for k in kept]
        held: list[tuple[list[str], int, int, str | None]] = []
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            for m, code in enumerate(codes):
                v, at = len(kept[m]) + 2, {x: i for i, x in enumerate(languages[m])}
                seqs: dict[tuple[int, int], list[np.ndarray]] = {}
                for text, side, level, lang in held:
                    if side in trains[m]:
                        s = code.encode(text)
                        for n in (1, 2, 3):
                            seqs.setdefault((n, level), []).append(ngrams(s, n, v))
                        if lang in at:
                            seqs.setdefault((0, 0), []).append(s * len(at) + at[lang])
                for (order, level), keys in seqs.items():
                    key, n = np.unique(np.concatenate(keys), return_counts=True)
                    one = np.ones(len(key), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one * m, one * order, key, one * level, n.astype(np.int64))], names=["m", "o", "key", "level", "n"])

        for batch in batches:
            for text, side, level, lang in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append((words(text), side, int(np.floor(level + 0.5)) - 1, lang))
                size += len(held[-1][0])
                if size > COUNTED_WORDS:
                    yield from counts()
                    held.clear()
                    size = 0
        yield from counts()

    rows = rated.select("text", "_side", "level", "lang").mapInArrow(tally, "m int, o int, key bigint, level int, n bigint")
    sums = [F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(LEVEL_COLUMNS)]
    path = shared_folder(rated.sparkSession, "counts")
    rows.groupBy("m", "o", "key").agg(*sums).write.parquet(path)
    return Stored(path, kept, languages)


def _maps(rated: DataFrame, stored: Stored) -> dict[str | None, list[tuple[np.ndarray, np.ndarray]]]:
    """Isotonic maps over all rated documents. Executors score them and pool ranges of the scores; the driver pools their blocks."""
    shared = rated.sparkSession.sparkContext.broadcast(stored)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grader = LevelGrader.of(shared.value.models(), {})
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i:i + 200]
                scored = grader.score([words(t) for t in part["text"]], part["_side"].to_numpy(int)).assign(y=part["level"].to_numpy(float))
                yield scored[["language", *ABOVE, "y"]].dropna(subset=[ABOVE[0]])

    scores = ", ".join(f"{name} double" for name in ABOVE)
    scored = shared_table(rated.select("text", "_side", "level").mapInPandas(score, f"language string, {scores}, y double"), "scores")
    enough = [r.language for r in scored.groupBy("language").count().filter((F.col("count") >= MIN_LANGUAGE_DOCS) & F.col("language").isNotNull()).collect()]
    borders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("x"), F.least(F.greatest(F.col("y") - k, F.lit(0.0)), F.lit(1.0)).alias("y")) for k, name in enumerate(ABOVE, 1)]))
    over_all = scored.withColumn("language", F.lit(None).cast("string"))
    long = scored.filter(F.col("language").isin(enough)).unionAll(over_all).select("language", borders.alias("b")).select("language", "b.*")

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (language, k), g in pd.concat(list(batches) or [pd.DataFrame(columns=["language", "k", "x", "y"])]).groupby(["language", "k"], dropna=False):
            g = g.groupby("x", sort=True)["y"].agg(["mean", "size"])
            x = g.index.to_numpy(float)
            blocks = pd.DataFrame(pooled(zip(x, x, g["mean"], g["size"].astype(float))), columns=["start", "end", "mean", "weight"])
            yield blocks.assign(language=language if isinstance(language, str) else None, k=int(k))[["language", "k", "start", "end", "mean", "weight"]]

    # rows of one language, border and score are in one range
    blocks = long.repartitionByRange("language", "k", "x").mapInPandas(pool, "language string, k int, start double, end double, mean double, weight double")
    found: dict[tuple[str | None, int], list[tuple[float, ...]]] = {}
    for r in blocks.collect():
        found.setdefault((r.language, r.k), []).append((r.start, r.end, r["mean"], r.weight))
    maps = {x: [ends(pooled(sorted(found[x, k]))) for k in range(1, LEVELS)] for x in {x for x, _ in found}}
    return {None: EVEN} | maps


def _fitted(docs: DataFrame, labels: DataFrame, max_fit_docs: int | None, max_fit_chars: int | None) -> tuple[Stored, dict]:
    rated = rated_texts(docs, labels, max_fit_docs, max_fit_chars)
    sides = {r["_side"]: r["count"] for r in rated.groupBy("_side").count().collect()}
    if not sides:
        raise ValueError("no rated documents")
    stored = _count(rated, [[1 - s] if sides.get(1 - s, 0) >= MIN_SIDE_DOCS else [0, 1] for s in (0, 1)])
    return stored, _maps(rated, stored)


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int | None = None, max_fit_chars: int | None = None) -> LevelGrader:
    """Models and maps from all rated documents, or from as many documents and characters as a caller wants at most.

    Without any rated document there is nothing to fit: an error.
    """
    stored, maps = _fitted(docs, labels, max_fit_docs, max_fit_chars)
    return LevelGrader.of(stored.models(), maps)


def side_of(text: str):
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(2)), F.lit(0)).cast("int")


def reading_levels(docs: DataFrame, labels: DataFrame, max_fit_docs: int | None = None) -> DataFrame:
    """``doc_id``, ``language`` (found from the words), ``level int``, ``difficulty``, ``surprisal_mean``, ``surprisal_p90``.

    A row for each row of ``docs``; a null text or one without words has null values. The language column is not trusted beyond
    the fit. An empty table of documents gives no rows.
    """
    # ids travel as text: a null among numbers would make them inexact
    out_schema = "doc_id string, language string, level int, difficulty double, surprisal_mean double, surprisal_p90 double"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], out_schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shared = docs.sparkSession.sparkContext.broadcast(_fitted(docs, labels, max_fit_docs, None))

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stored, maps = shared.value
        model = LevelGrader.of(stored.models(), maps)
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.iloc[i:i + 200]
                texts = [words(t) if isinstance(t, str) else [] for t in part["text"]]
                scored = model.score(texts, part["_side"].to_numpy(int))
                difficulty = model.grade(scored)
                level = pd.Series(np.floor(difficulty + 0.5)).astype("Int32")
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "language": scored["language"].to_numpy(object), "level": level, "difficulty": difficulty,
                    "surprisal_mean": scored["surprisal_mean"].to_numpy(), "surprisal_p90": scored["surprisal_p90"].to_numpy(),
                }).astype({"language": object})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", side_of("text").alias("_side")).mapInPandas(grade, out_schema).withColumn("doc_id", F.col("doc_id").cast("bigint"))
