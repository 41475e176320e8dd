"""Language identification by words first, with a back-off to character n-grams.

A known word scores by its log frequency in each language. A word that no
language knows backs off to character n-grams of the word between two
boundary marks, the longest order first, and takes the first order of which
anything is known; each step down costs a fixed factor. Shorter orders always
know something of a language's letters, so few words stay without a score.
Words are runs of letters (Unicode category L) of the lower-cased text. Words
and n-grams are kept as sorted 64-bit hashes with the log frequencies of the
languages that have them, so that a batch of texts is scored by whole arrays.

Rows: null texts and texts without letters give `und` with score 0; so does any
text if nothing could be learned. Texts are read whole. A tie goes to the
language that sorts first. Repeated rows give repeated results; an empty table
gives no rows. Columns other than the text are never inputs of a prediction.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, table, written

#: The classifier is fitted on about this many labelled rows, chosen by a hash of the text.
SAMPLE_ROWS = 6000
#: Orders of the back-off, and the factor that each step down costs.
ORDERS, BACKOFF = (4, 3, 2, 1), 0.4
#: Words that are counted or scored together.
TOGETHER = 100_000

_ODD = np.random.default_rng(41).integers(1, 2**63, max(ORDERS) + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Word characters that are neither letters nor digits: other numbers, by rule.
_NUMBERS = {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")}
_NUMBER_SET = frozenset(map(chr, _NUMBERS))
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    if not text.isascii() and not _NUMBER_SET.isdisjoint(text):
        text = text.translate(_NUMBERS)
    return _RUNS(text)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, none of which is empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    powers = np.full(int(sizes.max()), _ODD[-1], np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return _mixed(np.add.reduceat(_mixed(_points("".join(words))) * powers[place], starts) + sizes.astype(np.uint64))


def gram_hashes(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the word) of all n-grams of the words between two boundary marks; of order 1 without the marks."""
    marks = ("^", "$") if order > 1 else ("", "")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2 * (order > 1)
    count = np.maximum(sizes - order + 1, 0)
    word = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(sizes) - sizes, count)
    points = _mixed(_points(marks[0] + (marks[1] + marks[0]).join(words) + marks[1]))
    h = np.zeros(len(at), np.uint64)
    for i in range(order):
        h += points[at + i] * _ODD[i]
    return _mixed(h), word


class Table:
    """Log frequencies of one order: for each known hash the languages that have it, and a floor for those that have not."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        order = np.lexsort((langs, keys))
        keys, self.langs, counts = keys[order], langs[order].astype(np.int16), counts[order]
        self.keys, first = np.unique(keys, return_index=True)
        self.first = np.append(first, len(keys)).astype(np.int64)
        totals = np.bincount(langs, counts[np.argsort(order)], n_langs) if len(langs) else np.zeros(n_langs)
        self.floor = np.log(0.5 / (totals + len(self.keys) + 1))
        self.values = np.log(counts / totals[self.langs])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are known, a row of scores by language for each of those)."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros((0, len(self.floor)))
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[place] == hashes
        place = place[known]
        size = self.first[place + 1] - self.first[place]
        row = np.repeat(np.arange(len(place)), size)
        item = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[place], size)
        out = np.tile(self.floor, (len(place), 1))
        out[row, self.langs[item]] = self.values[item]
        return known, out


class Model:
    """Scores drawn from counts of words (order 0) and n-grams by language, kept as sorted hashes."""

    def __init__(self, counts: dict[str, dict[int, dict[str, int]]]):
        """counts by language, order and gram."""
        rows = [(lang, o, int(_gram_hash(g, o)), n) for lang, orders in counts.items() for o, grams in orders.items() for g, n in grams.items()]
        self._build(sorted(counts), pd.DataFrame(rows, columns=["lang", "o", "g", "n"]))

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Model:
        """From columns lang, o (order), g (hash, as a signed long) and n (count)."""
        model = cls.__new__(cls)
        model._build(sorted(rows["lang"].unique()), rows.assign(g=rows["g"].to_numpy(np.int64).view(np.uint64)))
        return model

    def _build(self, langs: list[str], rows: pd.DataFrame) -> None:
        self.langs, place = langs, {x: i for i, x in enumerate(langs)}
        self.tables = {}
        for o in (0, *ORDERS):
            own = rows[rows["o"] == o]
            lang = own["lang"].map(place).to_numpy(np.int64)
            self.tables[o] = Table(own["g"].to_numpy(np.uint64), lang, own["n"].to_numpy(np.float64), len(langs))

    def words(self, words: list[str]) -> np.ndarray:
        """Log scores of distinct words by language; zeros where nothing at all is known."""
        out = np.zeros((len(words), len(self.langs)))
        known, scores = self.tables[0].find(word_hashes(words))
        out[known] = scores
        open_ = np.flatnonzero(~known)
        for step, order in enumerate(ORDERS, 1):
            if not len(open_):
                break
            hashes, word = gram_hashes([words[i] for i in open_], order)
            hit, scores = self.tables[order].find(hashes)
            total, count = np.zeros((len(open_), len(self.langs))), np.bincount(word[hit], minlength=len(open_))
            np.add.at(total, word[hit], scores)
            some = count > 0
            out[open_[some]] = step * math.log(BACKOFF) + total[some] / count[some, None]
            open_ = open_[~some]
        return out

    def word(self, word: str) -> tuple[float, ...]:
        return tuple(self.words([word])[0])

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_all([text])
        return langs[0], float(scores[0])

    def predict_all(self, texts) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text."""
        totals, seen = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        held, owners, size = [], [], 0

        def flush():
            codes, distinct = pd.factorize(np.array(list(chain.from_iterable(held)), object))
            scores = self.words(list(distinct))[codes]
            starts = np.cumsum([0, *map(len, held)])[:-1]
            np.add.at(totals, owners, np.add.reduceat(scores, starts))

        for i, text in enumerate(texts):
            words = words_of(text.lower()) if text and self.langs else []
            seen[i] = bool(words)
            for at in range(0, len(words), TOGETHER):
                held.append(words[at : at + TOGETHER])
                owners.append(i)
                size += len(held[-1])
                if size >= TOGETHER:
                    flush()
                    held, owners, size = [], [], 0
        if held:
            flush()
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = totals.argmax(1)
        top = totals[np.arange(len(texts)), best]
        share = 1 / np.exp(np.maximum(totals - top[:, None], -700.0)).sum(1)
        return [self.langs[b] if s else "und" for b, s in zip(best, seen)], np.where(seen, share, 0.0)


def _gram_hash(gram: str, order: int) -> np.uint64:
    """The hash of a word (order 0), or of an n-gram with its marks."""
    if order == 0:
        return word_hashes([gram])[0]
    h = (_mixed(_points(gram)) * _ODD[:order]).sum(dtype=np.uint64)
    return _mixed(np.array([h], np.uint64))[0]


def counted(words: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashes, counts) of words and their n-grams."""
    codes, distinct = pd.factorize(np.array(words, object))
    times = np.bincount(codes)
    found = [(0, word_hashes(list(distinct)), times)]
    for order in ORDERS:
        hashes, word = gram_hashes(list(distinct), order)
        keys, place = np.unique(hashes, return_inverse=True)
        found.append((order, keys, np.bincount(place, times[word], len(keys)).astype(np.int64)))
    return found


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits a model on about sample_rows rows that have a text and a language.

    The rows are those of the smallest hashes of the text, each text and label
    once, so the choice does not depend on partitions. The counts are summed by
    Spark; those of the sample, all of them, come to the driver: their number
    is bounded by the words of sample_rows texts.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("__t"), F.col(lang_col).alias("__l"))
    total = rows.select(F.xxhash64("__t"), "__l").distinct().count()  # as copies count once below
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("__t"), F.lit(1 << 20)) < F.lit(max(1, sample_rows * (1 << 20) // total)))
    rows = rows.distinct()  # copies count once, so that one text with a third of all rows cannot fill the sample
    python_ready(labelled.sparkSession)

    def tally(batches):
        for pdf in batches:
            for lang, own in pdf.groupby("__l"):
                held = []
                for text in own["__t"]:
                    held += words_of(text.lower())
                    while len(held) >= TOGETHER:
                        yield from frames(lang, held[:TOGETHER])
                        held = held[TOGETHER:]
                if held:
                    yield from frames(lang, held)

    def frames(lang, words):
        for order, hashes, n in counted(words):
            yield pd.DataFrame({"lang": lang, "o": np.int32(order), "g": hashes.view(np.int64), "n": n})

    summed = rows.mapInPandas(tally, "lang string, o int, g long, n long").groupBy("lang", "o", "g").agg(F.sum("n").alias("n"))
    return Model.of(written(summed, "language-counts").toArrow().to_pandas())  # as whole columns, not an object for each value


def predict(text: Column, model: Model, spark) -> Column:
    """struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the words of SAMPLE_ROWS texts

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict_all(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    python_ready(spark)
    return run.asNondeterministic()(text)  # else a filter on the result runs it twice


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is never held out nor learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of docs plus held_out, lang_pred and score, by a model learned from the rows not held out."""
    model = fit(learnable(docs, id_col), text_col, lang_col, sample_rows)
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    return docs.select(*own, held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), model, docs.sparkSession).alias("__p")).select(
        *own, "held_out", "__p.lang_pred", "__p.score"
    )


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
