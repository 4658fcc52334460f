"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of its words, in lower case and with marks for a word's start and end. N-grams
are hashed; the hashes of one order stand in one sorted array, beside it a column of log probabilities and one of
back-off weights for every language. A document goes to the language of the lowest cross-entropy a character. The
margin to the second best is calibrated by isotonic regression on documents outside the counts; a document whose chance
is low, or that is unlike every language, is marked as rejected.

The models count at most about ``docs_per_lang`` documents of each language, by hash; all texts are scored whole. Words
are scored once for each batch of new words, and remembered in bounded memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tephra.llm.calibrate import Curve, fit_curve
from tephra.llm.quality import held_out
from tephra.llm.shingles import mix64
from tephra.session import tidy, written

START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+").findall
_U = np.uint64
#: One odd factor for each place in a gram; unrelated, so that sums of small code points do not meet.
FACTORS = mix64(np.arange(1, 33, dtype=np.uint64)) | _U(1)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS((text or "").lower())


def codes(words: Iterable[str]) -> np.ndarray:
    """Code points of all words, each between its marks."""
    return np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")


def places(code: np.ndarray) -> np.ndarray:
    """Characters since the word's start mark, which has 0."""
    starts = np.flatnonzero(code == ord(START))
    return np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters up to each place; places with fewer before them hold rubbish."""
    total = np.full(len(code), n, np.uint64)
    wide = code.astype(np.uint64)
    for j in range(n):
        total[j:] += (wide[: len(code) - j] + _U(1)) * FACTORS[j]
    return mix64(total)


def count_grams(words: Counter, order: int) -> Counter:
    """Counts of the grams of length 1 to ``order`` that end in a letter or the end mark."""
    out: Counter = Counter()
    for word, times in words.items():
        marked = START + word + END
        for end in range(2, len(marked) + 1):
            for n in range(1, min(order, end) + 1):
                out[marked[end - n : end]] += times
    return out


def kneser_ney(counts: dict[str, int], order: int, letters: int) -> tuple[dict[str, float], dict[str, float]]:
    """(probability of the last character of each gram after the others, back-off weight of each context).

    The longest grams, and those from a word's start, are counted as they are; others by the characters seen before them.
    """
    used: dict[str, int] = {}
    for gram, times in counts.items():
        if len(gram) == order or gram[0] == START:
            used[gram] = times
    for gram in counts:
        if len(gram) > 1:
            tail = gram[1:]
            if tail[0] != START:
                used[tail] = used.get(tail, 0) + 1
    by_length: dict[int, list[str]] = {}
    for gram in used:
        by_length.setdefault(len(gram), []).append(gram)
    prob: dict[str, float] = {"": 1.0 / (letters + 1)}
    back: dict[str, float] = {}
    for n in range(1, order + 1):
        grams = by_length.get(n, [])
        ones, twos = sum(used[g] == 1 for g in grams), sum(used[g] == 2 for g in grams)
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g in grams:
            total[g[:-1]] += used[g]
            kinds[g[:-1]] += 1
        for context, sum_of in total.items():
            back[context] = discount * kinds[context] / sum_of
        for g in grams:
            prob[g] = max(used[g] - discount, 0) / total[g[:-1]] + back[g[:-1]] * prob_of(prob, back, g[1:])
    return prob, back


def prob_of(prob: dict[str, float], back: dict[str, float], gram: str) -> float:
    """Probability of a gram's last character, backing off until the gram is known."""
    weight = 1.0
    while gram not in prob:
        weight *= back.get(gram[:-1], 1.0)
        gram = gram[1:]
    return weight * prob[gram]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    order: int
    unseen: np.ndarray  # log probability of a letter no language knows
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]  # by order: sorted hashes, log probabilities (n, langs)
    contexts: tuple[tuple[np.ndarray, np.ndarray], ...]  # by length from 0: sorted hashes, log back-off weights
    curve: Curve | None = None
    worst: float = np.inf

    def word_scores(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability by language, characters predicted) of each word."""
        code = codes(words)
        place = places(code)
        score = np.zeros((len(code), len(self.langs)), np.float32)
        open_ = np.flatnonzero(place > 0)
        for n in range(self.order, 0, -1):
            ready = open_[place[open_] + 1 >= n]
            later = open_[place[open_] + 1 < n]
            known, value = self.grams[n - 1]
            at, hit = _find(known, gram_hashes(code, n)[ready])
            score[ready[hit]] += value[at[hit]]
            missed = ready[~hit]
            if len(missed):
                ctx, weight = self.contexts[n - 1]
                if n > 1:
                    at, hit = _find(ctx, gram_hashes(code, n - 1)[missed - 1])
                    score[missed[hit]] += weight[at[hit]]
                elif len(weight):
                    score[missed] += weight[0]
            open_ = np.concatenate([missed, later])
            if n > 1:
                open_.sort()
        score[open_] += self.unseen
        starts = np.flatnonzero(place == 0)
        return (np.add.reduceat(score, starts, axis=0) if len(starts) else score), np.diff(np.append(starts, len(code))) - 1


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether found) in a sorted array."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def build(counts: dict[str, dict[str, int]], order: int) -> Model:
    """A model from {language: {gram: count}}."""
    langs = tuple(sorted(counts))
    letters = len({g for c in counts.values() for g in c if len(g) == 1})
    fitted = [kneser_ney(counts[lang], order, letters) for lang in langs]
    grams, contexts = [], []
    for n in range(1, order + 1):
        union = sorted({g for prob, _ in fitted for g in prob if len(g) == n})
        value = np.array([[np.log(prob_of(prob, back, g)) for prob, back in fitted] for g in union], np.float32).reshape(-1 if langs else 0, len(langs))
        grams.append(_sorted(union, value, n))
        ctx = sorted({c for _, back in fitted for c in back if len(c) == n - 1})
        weight = np.array([[np.log(back.get(c, 1.0)) for _, back in fitted] for c in ctx], np.float32).reshape(-1 if langs else 0, len(langs))
        contexts.append(_sorted(ctx, weight, n - 1) if n > 1 else (np.zeros(0, np.uint64), weight))
    return Model(langs, order, np.array([np.log(1.0 / (letters + 1))] * len(langs), np.float32), tuple(grams), tuple(contexts))


def _sorted(grams: list[str], value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not grams:
        return np.zeros(0, np.uint64), value
    code = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4")
    hashes = gram_hashes(code, n)[n - 1 :: n]
    rank = np.argsort(hashes, kind="stable")
    return hashes[rank], value[rank]


class Scorer:
    """Cross-entropies of texts; remembers at most ``most`` words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs) + 1))

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats a character by language, characters) of each text; without letters 0 characters."""
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        for a in range(0, len(texts), 64):
            if len(self.place) > self.most:
                self.forget()
            place, ids, new = self.place, [], []
            for text in texts[a : a + 64]:
                words = words_of(text)
                fresh = [w for w in dict.fromkeys(words) if w not in place]
                for w in fresh:
                    place[w] = len(place)
                new += fresh
                ids.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
            if new:
                score, n = self.model.word_scores(new)
                self.rows = np.concatenate([self.rows, np.column_stack([score, n])])
            for i, at in enumerate(ids):
                if len(at):
                    out[a + i] = self.rows[at].sum(0)
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n


def margins(cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, how much worse the second best is, in nats a character)."""
    best = cross.argmin(1) if cross.shape[1] else np.zeros(len(cross), np.int64)
    if cross.shape[1] < 2:
        return best, np.full(len(cross), 1.0)
    two = np.partition(cross, 1, axis=1)
    return best, two[:, 1] - two[:, 0]


def fit(known: DataFrame, *, order: int = 5, docs_per_lang: int = 400, calibrate_share: int = 4) -> Model:
    """A model from (doc_id, text, lang); rows without a language are left out. No rows give a model without languages. Other columns are ignored."""
    spark = known.sparkSession
    known = known.select("doc_id", "text", "lang").where("lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language
    if not sizes:
        return build({}, order)
    share = spark.createDataFrame([(r["lang"], min(1.0, docs_per_lang / r["n"])) for r in sizes], "l string, p double")
    hashed = F.pmod(F.xxhash64(F.lit(41), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), F.col("lang") == F.col("l")).where(hashed < F.col("p")).select("doc_id", "text", "lang")
    sample = written(sample, "sample")
    aside = F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(calibrate_share)) == 0

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counted in words.items():
            found = count_grams(counted, order)
            if found:
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    counted = sample.where(~aside).mapInPandas(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()  # of the sample
    counts: dict[str, dict[str, int]] = {}
    for r in counted:
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = build(counts, order)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            cross, n = scorer(batch["text"].tolist())
            best, margin = margins(cross)
            right = [model.langs[b] == lang for b, lang in zip(best, batch["lang"], strict=True)]
            low = cross.min(1) if cross.shape[1] else n * 0.0
            yield pd.DataFrame({"margin": margin, "right": right, "low": low})[n > 0]

    judged = written(sample.where(aside).mapInPandas(judge, "margin double, right boolean, low double"), "judged")
    worst = judged.where("right").agg(F.max("low")).first()[0]
    curve = fit_curve(judged, F.col("margin"), F.col("right"), 0.0, 2.0)
    return Model(model.langs, order, model.unseen, model.grams, model.contexts, curve, 1.25 * worst if worst else np.inf)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", reject_below: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy) for every row.

    ``und`` with score 0 where a text is null or has no letter, or no language is known.
    """

    @tidy
    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, langs = Scorer(model), np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            cross, n = scorer(batch["text"].tolist())
            best, margin = margins(cross)
            some = (n > 0) & (len(model.langs) > 0)
            low = cross.min(1) if cross.shape[1] else np.zeros(len(cross))
            chance = model.curve(margin) if model.curve else np.full(len(cross), 0.5)
            chance = np.where(some, np.clip(chance * (1 - 1e-6) + 5e-7 * np.minimum(margin, 2), 0, 1), 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": langs[np.where(some, best, len(model.langs))], "score": chance, "rejected": ~some | (chance < reject_below) | (low > model.worst), "cross_entropy": np.where(some, low, np.nan)})

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tell, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")


def classify(docs: DataFrame, *, mod: int = 4, rest: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected, cross_entropy); languages of held-out documents are never read."""
    out = held_out(F.col("doc_id"), mod, rest)
    found = identify(docs, fit(docs.where(~out), **options))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
