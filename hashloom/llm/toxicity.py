"""Toxicity by class-conditional Kneser-Ney models.

Two models of how text is written, one of toxic and one of ordinary documents,
give words and the places where two words meet a log-likelihood under either
class. The models are of order ``ORDER`` over characters: of a word, its start
padded and a space after it, and of the grams that reach over a space into the
next word, so expressions of several words are learnt too. Each class has its
own counts at the highest order; what a class has not seen backs off to
Kneser-Ney continuation counts that both classes share, so a rare spelling costs
both alike unless one class knows it. A document's evidence is the difference of
the two log-likelihoods by length: over the whole text by character, in its worst
word by character, the number of words that outweigh the odds of the labels
twice over by the logarithm of length, and of the meetings of words, and of the
pairs that meet, the greatest and the logarithm of the mean likelihood ratio. A logistic fit on labelled rows that gave no counts
turns these into a probability. Every labelled row outside the held-out fold takes part, whatever their number.
"""

from __future__ import annotations

import itertools
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import drop, scratch, written_to
from hashloom.llm.labelled import among, fold_of, logistic_over, marked, sigmoid, tally
from hashloom.llm.tokenizing import forget_encoders, text_slices, tidy

ORDER = 5
DISCOUNT = 0.75
FOLDS, HELD_OUT = 5, 0
#: Of the labelled rows, this fold of a second hash fits the logistic; the others give counts.
CALIBRATE = 4
WORDS = 300_000
#: Slots for the ratios of meetings, of which each holds the last that fell to it.
MEETINGS = 1 << 19
#: So many distinct meetings of a task are counted before their grams are handed on.
HELD = 500_000
#: So many words or meetings become grams at a time, and so many distinct grams of such slices wait at least to be summed up.
SLICE, SUMMED = 40_000, 250_000
_WORD = re.compile(r"[^\W_]+")
_START = "\x02"
FEATURES = 8
_MIX = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = _START * (order - 1) + word + " "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def words_windows(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all grams of the words, a row each, and the number of grams of each word."""
    pad = _START * (order - 1)
    points = points_of(pad + (" " + pad).join(words) + " ")
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (order - 1), n)
    return points[at[:, None] + np.arange(order)], n


def rows_alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of at most six code points: a place of each distinct row, in order, and which of these each row is."""
    keys = []
    for low in range(0, rows.shape[1], 3):
        key = np.zeros(len(rows), dtype=np.uint64)
        for column in rows[:, low : low + 3].T:
            key = key << np.uint64(21) | column
        keys.append(key)
    if not keys or not len(rows):
        return np.zeros(min(1, len(rows)), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(rows), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def mixed(windows: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each row of code points."""
    key = np.full(len(windows), seed, dtype=np.uint64)
    for column in windows.T:
        key = (key + column) * np.uint64(_MIX)
        key ^= key >> np.uint64(29)
    return key


class Words(dict):
    """Numbers of words, given as they are met, and of what a meeting takes from either side of its space."""

    def __init__(self, order: int = ORDER):
        self.order, self.new, self.own = order, [], np.zeros(0)
        self.n, self.left, self.right = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.lefts, self.rights = {}, {}

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        i = self[word] = len(self)
        return i

    @property
    def now(self) -> dict[str, float]:
        """The ratio of each word."""
        return dict(zip(self, self.own.tolist(), strict=True))

    def numbers(self, cut: list[list[str]]) -> np.ndarray:
        """The numbers of all words of the texts, one after the other."""
        return np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))

    def placed(self) -> list[str]:
        """The words that are new, with their lengths and sides now known."""
        new, self.new = self.new, []
        if new:
            side, lefts, rights = self.order - 2, self.lefts, self.rights
            self.n = np.append(self.n, np.fromiter(map(len, new), dtype=np.int64, count=len(new)))
            self.left = np.append(self.left, [lefts.setdefault(w[-side:], len(lefts)) for w in new])
            self.right = np.append(self.right, [rights.setdefault(w[: side + 1], len(rights)) for w in new])
        return new

    def meetings(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points of all grams over the space of meetings, a row each, and of which meeting each is."""
        order = self.order
        used = [np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)]
        names = [list(self.lefts), list(self.rights)]
        sides = [points_of("".join([names[0][i].rjust(order - 2, "\0") for i in used[0][0].tolist()])).reshape(-1, order - 2), points_of("".join([names[1][i].ljust(order - 1, "\0") for i in used[1][0].tolist()])).reshape(-1, order - 1)]
        joint = np.hstack([sides[0][used[0][1]], np.full((len(left), 1), 32, dtype=np.uint32), sides[1][used[1][1]]])
        found = [(joint[:, i : i + order], np.flatnonzero((joint[:, i] != 0) & (joint[:, i + order - 1] != 0))) for i in range(order - 1)]
        return np.concatenate([x[at] for x, at in found]), np.concatenate([at for _, at in found])


def pairs_of(lengths: np.ndarray) -> np.ndarray:
    """The places, among the words of all texts, of those with a next one in their text."""
    inner = np.ones(int(lengths.sum()), dtype=bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    return np.flatnonzero(inner)


class Ratios:
    """Log-likelihood ratio, toxic over ordinary, of grams by 64 bits of them, and of contexts for grams that neither class has seen.

    Of a gram that no class has seen both have the same backed-off rest, so its ratio is that of its context.
    """

    def __init__(self, seed: int, tops: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], order: int = ORDER, odds: float = 2.0):
        #: Logarithm of ordinary over toxic labels: a word of a greater ratio makes its text toxic by itself.
        self.odds = max(odds, 0.1)
        self.seed, self.tops, self.contexts, self.order = seed, tops, contexts, order
        self.forget()

    def forget(self) -> None:
        self.memo, self._slots = Words(self.order), None

    def __getstate__(self):
        return {**self.__dict__, "memo": None, "_slots": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def of(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows))
        for columns, (keys, values) in ((windows[:, :-1], self.contexts), (windows, self.tops)):
            if len(keys):
                key = mixed(columns, self.seed)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                out = np.where(keys[at] == key, values[at], out)
        return out

    def learn(self, words) -> None:
        for w in words:
            self.memo[w]
        self._learn()

    def _learn(self) -> None:
        new = self.memo.placed()
        for low in range(0, len(new), 20_000):
            windows, n = words_windows(new[low : low + 20_000], self.order)
            self.memo.own = np.append(self.memo.own, np.add.reduceat(self.of(windows), np.cumsum(n) - n))

    def _met(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ratio of each meeting."""
        if self._slots is None:
            self._slots = np.full(MEETINGS, -1, dtype=np.int64), np.zeros(MEETINGS)
        names, values = self._slots
        key = left << 32 | right
        slot = (key.view(np.uint64) * np.uint64(_MIX) >> np.uint64(64 - MEETINGS.bit_length() + 1)).view(np.int64)
        out = values[slot]
        gone = np.flatnonzero(names[slot] != key)
        if len(gone):
            distinct, first, which = np.unique(key[gone], return_index=True, return_inverse=True)
            windows, of = self.memo.meetings(left[gone[first]], right[gone[first]])
            ratio = np.bincount(of, weights=self.of(windows), minlength=len(distinct))
            out[gone] = ratio[which]
            slots = slot[gone[first]]
            values[slots], names[slots] = ratio, distinct
            lost = names[slots] != distinct  # several fell to one slot: the one that is named there counts
            values[slots[~lost]] = ratio[~lost]
        return out

    def meetings(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text the log-likelihood ratios of the places where two of its words meet."""
        ids, lengths = self.memo.numbers(texts), np.array([len(t) for t in texts], dtype=np.int64)
        self._learn()
        at = pairs_of(lengths)
        met = self._met(self.memo.left[ids[at]], self.memo.right[ids[at + 1]])
        return np.split(met, np.cumsum(np.maximum(lengths - 1, 0))[:-1])

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: zeros for one without words."""
        out = np.zeros((len(texts), FEATURES))
        for low, high in text_slices(texts, 500_000):
            if len(self.memo) > WORDS:
                self.forget()
            cut = [words_of(t) for t in texts[low:high]]
            ids, lengths = self.memo.numbers(cut), np.array([len(c) for c in cut], dtype=np.int64)
            self._learn()
            if not len(ids):
                continue
            some = np.flatnonzero(lengths)
            held = lengths[some]
            starts = np.cumsum(held) - held
            own, n = self.memo.own[ids], self.memo.n[ids]
            worst = np.maximum.reduceat(np.where(own > self.odds, own / (n + 1), -np.inf), starts)
            rows = np.zeros((len(some), FEATURES))
            rows[:, 0] = np.add.reduceat(own, starts) / np.add.reduceat(n, starts)
            rows[:, 1] = np.where(worst > -np.inf, worst, np.maximum.reduceat(own, starts) / 20)
            rows[:, 2] = np.add.reduceat((own > 2 * self.odds).astype(np.int64), starts) / np.log(2.0 + held)
            at = pairs_of(held)
            if len(at):
                met = self._met(self.memo.left[ids[at]], self.memo.right[ids[at + 1]])
                pair = own[at + 1] + own[at] + met
                more = np.flatnonzero(held > 1)
                size = held[more] - 1
                starts = np.cumsum(size) - size
                rows[more, 3] = np.add.reduceat(met, starts) / size
                for values, top, mean in ((met, 4, 5), (pair, 6, 7)):
                    rows[more, top] = most = np.maximum.reduceat(values, starts)
                    rows[more, mean] = most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, size)), starts) / size)
            out[low + some] = rows
        return out


class KneserNey(Ratios):
    """Both models, from how often each class has each gram."""

    def __init__(self, counts: dict[str, tuple[int, int]], order: int = ORDER, discount: float = DISCOUNT, odds: float = 2.0):
        windows = points_of("".join(counts)).reshape(-1, order)
        seen = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
        super().__init__(*self.tables(windows, seen, discount), order, odds)

    def tables(self, windows: np.ndarray, seen: np.ndarray, discount: float) -> tuple:
        """What :class:`Ratios` takes, for distinct grams and their numbers in ordinary and toxic texts."""
        self.windows, self.seen = windows, seen
        # Shared: at each lower order, how many characters a gram has been seen to follow.
        levels, last = [], windows
        while last.shape[1] > 1:
            first, which = rows_alike(last[:, 1:])
            last = last[first, 1:]
            levels.append((last, which, np.bincount(which, minlength=len(last))))
        self.letters = max(1, len(last)) if len(windows) else 1
        below = np.full(1, 1.0 / (self.letters + 1))
        self.levels = []
        for k, (own, _, n) in enumerate(reversed(levels)):
            first, which = rows_alike(own[:, :-1])
            total, kinds = np.bincount(which, weights=n, minlength=len(first)), np.bincount(which, minlength=len(first))
            rest = below[levels[len(levels) - k][1]] if k else np.full(len(own), below[0])
            below = (np.maximum(n - discount, 0) + discount * kinds[which] * rest) / total[which]
            self.levels.append((own, below, own[first, :-1], discount * kinds / total))
        below = below[levels[0][1]] if levels else below
        first, which = rows_alike(windows[:, :-1])
        likely, back = [], []
        for c in (0, 1):
            total = np.bincount(which, weights=seen[:, c], minlength=len(first))
            kinds = np.bincount(which, weights=seen[:, c] > 0, minlength=len(first))
            back.append(np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0))
            likely.append(np.maximum(seen[:, c] - discount, 0) / np.maximum(total, 1)[which] + back[c][which] * below)
        self.likely, self.back, self.contexts_at = likely, back, first
        ratios = [np.log(x[1]) - np.log(x[0]) for x in (likely, back)]
        for seed in range(1, 100):  # no two of them by the same bits
            keys = [mixed(windows, seed), mixed(windows[first, :-1], seed)]
            if all(len(np.unique(k)) == len(k) for k in keys):
                break
        sort = [np.argsort(k) for k in keys]
        return seed, *((k[s], r[s]) for k, r, s in zip(keys, ratios, sort, strict=True))

    def ratios(self) -> Ratios:
        return Ratios(self.seed, self.tops, self.contexts, self.order, self.odds)

    def _named(self, rows: np.ndarray, values: np.ndarray) -> dict[str, float]:
        k, text = rows.shape[1], np.ascontiguousarray(rows).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return dict(zip([text[i : i + k] for i in range(0, len(text), k)] if k else [""] * len(rows), values.tolist(), strict=True))

    def shared(self, gram: str) -> float:
        if not gram:
            return 1.0 / (self.letters + 1)
        if not hasattr(self, "_low"):
            self._low, self._low_back = {}, {}
            for own, p, contexts, back in self.levels:
                self._low.update(self._named(own, p))
                self._low_back.update(self._named(contexts, back))
        p = self._low.get(gram)
        return self._low_back.get(gram[:-1], 1.0) * self.shared(gram[1:]) if p is None else p

    def likelihood(self, gram: str, c: int) -> float:
        """Probability of the gram's last character after the others in class ``c`` (1: toxic)."""
        if not hasattr(self, "_top"):
            self._top = [self._named(self.windows, x) for x in self.likely]
            self._back = [self._named(self.windows[self.contexts_at, :-1], x) for x in self.back]
        p = self._top[c].get(gram)
        return self._back[c].get(gram[:-1], 1.0) * self.shared(gram[1:]) if p is None else p


class Model:
    def __init__(self, kn: Ratios, mean, scale, weights, bias: float, table: pa.Table | None = None):
        self.kn, self.mean, self.scale, self.weights, self.bias = kn, mean, scale, weights, bias
        self._table = table

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    @property
    def counts(self) -> dict[str, tuple[int, int]]:
        """How many ordinary and toxic ones of each gram; where the model was made."""
        return dict(zip(self._table["gram"].to_pylist(), zip(self._table["o"].to_pylist(), self._table["t"].to_pylist(), strict=True), strict=True))

    def forget(self) -> None:
        """At a task's end: workers live on."""
        self.kn.forget()
        tidy()

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.kn.features(texts)
        return sigmoid((x - self.mean) / self.scale @ self.weights + self.bias)


class Tally(NamedTuple):
    """Distinct grams, a row of code points each, and how often ordinary and toxic texts have them."""

    windows: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, windows: np.ndarray, n: np.ndarray, c: int) -> Tally:
        first, which = rows_alike(windows)
        sums = np.zeros((len(first), 2), dtype=np.int64)
        sums[:, c] = np.bincount(which, weights=n, minlength=len(first))
        return cls(windows[first], sums)

    @classmethod
    def joint(cls, parts: list[Tally]) -> Tally:
        windows, n = np.concatenate([x.windows for x in parts]), np.concatenate([x.n for x in parts])
        first, which = rows_alike(windows)
        return cls(windows[first], np.stack([np.bincount(which, weights=n[:, c], minlength=len(first)).astype(np.int64) for c in (0, 1)], axis=1))


class Counts:
    """Grams of texts of either class, by the words and meetings that have them."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.clear()

    def clear(self) -> None:
        self.words, self.n, self.met, self.held = Words(self.order), [np.zeros(0, dtype=np.int64)] * 2, [[], []], 0

    def add(self, texts: list[str | None], y: int) -> None:
        cut = [words_of(t) for t in texts]
        ids = self.words.numbers(cut)
        self.words.placed()
        own = np.bincount(ids, minlength=len(self.words))
        own[: len(self.n[y])] += self.n[y]
        self.n[y] = own
        at = pairs_of(np.array([len(c) for c in cut], dtype=np.int64))
        self.met[y].append(np.unique(self.words.left[ids[at]] << 32 | self.words.right[ids[at + 1]], return_counts=True))
        self.held += len(self.met[y][-1][0])

    @property
    def full(self) -> bool:
        return self.held > HELD or 2 * len(self.words) > WORDS

    def _parts(self):
        """Grams of some words or meetings of a class at a time, a row each, how often each is there, and the class."""
        names = list(self.words)
        for c in (0, 1):
            at = np.flatnonzero(self.n[c])
            for low in range(0, len(at), SLICE):
                some = at[low : low + SLICE]
                own, many = words_windows([names[i] for i in some.tolist()], self.order)
                yield own, np.repeat(self.n[c][some], many), c
            if self.met[c]:
                keys, which = np.unique(np.concatenate([k for k, _ in self.met[c]]), return_inverse=True)
                met = np.bincount(which, weights=np.concatenate([m for _, m in self.met[c]]), minlength=len(keys)).astype(np.int64)
                del which
                self.met[c] = []
                for low in range(0, len(keys), SLICE):
                    some = keys[low : low + SLICE]
                    own, of = self.words.meetings(some >> 32, some & 0xFFFFFFFF)
                    yield own, met[low : low + SLICE][of], c

    def batch(self) -> pa.RecordBatch:
        """What has been counted, once; then anew. Grams are summed as they are made, so that only distinct ones are held."""
        held, more, k = Tally(np.zeros((0, self.order), dtype=np.uint32), np.zeros((0, 2), dtype=np.int64)), [], self.order
        for windows, n, c in self._parts():
            more.append(Tally.of(windows, n, c))
            if sum(len(x.windows) for x in more) > max(SUMMED, len(held.windows)):
                held, more = Tally.joint([held, *more]), []
        held = Tally.joint([held, *more])
        del more
        self.clear()
        text = np.ascontiguousarray(held.windows).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string()), *(pa.array(x.copy()) for x in held.n.T)], ["gram", "ordinary", "toxic"])


def _count(batches):
    forget_encoders()
    counts = Counts()
    for batch in batches:
        texts, marks = batch.column("text").to_pylist(), batch.column("y").to_pylist()
        for low, high in text_slices(texts, 1_000_000):
            for y in (0, 1):
                counts.add([t for t, m in zip(texts[low:high], marks[low:high], strict=True) if m == y], y)
            if counts.full:
                yield counts.batch()
    yield counts.batch()
    tidy()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from all labelled rows outside the held-out fold.

    With one class only, or no labelled row, every text gets the share of toxic rows (smoothed).
    """
    marks = marked(labels, label, FOLDS, HELD_OUT)
    n, toxic = tally(marks)
    odds = math.log((n - toxic + 1) / (toxic + 1))
    part = fold_of(F.concat(F.lit("c"), F.col("doc_id").cast("string")), FOLDS)
    counted = among(docs, marks, n, part != CALIBRATE).select("text", "y").mapInArrow(_count, "gram string, ordinary long, toxic long")
    table = counted.groupBy("gram").agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).orderBy("gram").toArrow()  # all kinds of grams: bounded by the alphabet, not by rows
    seen = np.stack([table[c].to_numpy() for c in ("o", "t")], axis=1).reshape(-1, 2)
    both = KneserNey({}, odds=odds)
    kn = Ratios(*both.tables(points_of("".join(table["gram"].to_pylist())).reshape(-1, ORDER), seen, DISCOUNT), odds=odds)
    del both
    names = [f"x{i}" for i in range(FEATURES)]

    def measure(batches):
        forget_encoders()
        for batch in batches:
            x = kn.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), *map(pa.array, x.T.copy())], ["y", *names])
        kn.forget()
        tidy()

    spark = docs.sparkSession
    path = scratch(spark, "toxicity-fit")
    try:
        rows = written_to(among(docs, marks, n, part == CALIBRATE).select("text", "y").mapInArrow(measure, "y int, " + ", ".join(f"{x} double" for x in names)), path)
        found = logistic_over(rows, names, ridge=0.1)
    finally:
        drop(spark, path)
    if found.positive in (0, found.n) or not len(seen):
        share = (found.positive + 1) / (found.n + 12)
        return Model(kn, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), math.log(share / (1 - share)), table)
    return Model(kn, found.mean, found.scale, found.weights, found.bias, table)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row: the text alone decides. Null and empty texts have no evidence and get the score of none."""

    def run(batches):
        forget_encoders()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])
        model.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``. Empty tables give no row or the smoothed share."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below one half by a model of ``train_docs``."""
    model = fit(train_docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        forget_encoders()
        for batch in batches:
            ok = model.score([None if t is None else str(t) for t in batch.column(at).to_pylist()]) < 0.5
            yield batch.filter(pa.array(ok))
        model.forget()

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
