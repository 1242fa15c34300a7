"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words, in lower case, with a mark before and after each word. Counts of the highest order and
of n-grams at a word's beginning are of occurrences; lower orders count the distinct characters before an n-gram. Every order interpolates an
absolute discount with the order below, down to an even distribution over all characters. The n-grams are kept as sorted arrays of 64-bit hashes, one
pair for each language and order: of n-grams with their discounted probabilities, and of contexts with their interpolation weights.

The predicted language has the lowest cross-entropy per character of the whole text; of equal ones the first by name. The score is calibrated: logistic
regression on the root of the whole text's margin between the two best languages, fitted on sample rows that the models did not
learn from. A text is rejected (column rejected) if its score is below `REJECT`, or if its cross-entropy lies above what texts of the language have.

Learning takes a bounded sample, `SAMPLE` rows in all, shared evenly among all languages that occur, at most `PER_LANGUAGE` and at least `LEAST` rows of each: those with the
smallest hashes of their ids; and of each text the window of `PIECE` characters that a hash of the id chooses among all of its windows. No language is left
out. Rows whose crc32(id) modulo `FOLDS` is `HELD` are held out.

Words are runs of letters, and each is put into lower case by itself, so that its letters do not depend on where a text is cut for reading. A word of any length is scored as
a whole: a long one in steps that carry the symbols before them.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null language or id is not learnt from; with one language only, it is predicted
for every text with letters, with score 1; with none, every text is `und`; repeated rows get the same prediction; rows with a null id are not held out;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixlake.llm.common import arrow_schema, bounded, fold
from fixlake.llm.quality import Logistic, window

FOLDS, HELD = 4, 2
ORDER = 5
PER_LANGUAGE, LEAST, SAMPLE = 400, 10, 20_000
PIECE = 10_000
REJECT = 0.5
#: Log-probabilities of words by language, and characters of words, that a task remembers; a full memory is emptied.
MEMORY = 2_000_000
#: Characters of a text that are searched for words at a time, and symbols that are scored at a time.
SEGMENT, STEP = 1 << 20, 1 << 18

#: Texts that are scored together.
GROUP = 512

_LETTERS, _OTHER = regex.compile(r"\p{L}+"), regex.compile(r"\P{L}")
_ASCII_LETTERS = re.compile(r"[A-Za-z]+")
#: Marks at the beginning and the end of a word, which no letter is.
_BEGIN, _END = "\x02", "\x03"
_BASE = np.uint64(0x100000001B3)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """A text in segments of about `size` characters that end between words."""
    at = 0
    while at < len(text):
        gap = _OTHER.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def runs(text: str, size: int = SEGMENT) -> Counter:
    """The runs of letters of a text, with their numbers."""
    pattern = _ASCII_LETTERS if text.isascii() else _LETTERS
    found: Counter = Counter()
    for part in segments(text, size):
        found.update(pattern.findall(part))
    return found


def word_counts(text: str, size: int = SEGMENT) -> Counter:
    """The words of a text in lower case, with their numbers."""
    lower: Counter = Counter()
    for word, n in runs(text, size).items():
        lower[word.lower()] += n
    return lower


class Grams:
    """The n-grams of words, as hashes: for each symbol of each word, that of the n symbols up to it. Symbols are given as parts of marked words: `of` tells
    which word a part belongs to, `first` where it begins in it, and `known` how many of its symbols only serve as the context of the others."""

    def __init__(self, parts: list[str], of: np.ndarray, first: np.ndarray, known: np.ndarray):
        self.symbols = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        starts = np.cumsum(sizes) - sizes
        inner = np.arange(len(self.symbols)) - np.repeat(starts, sizes)
        self.place = inner + np.repeat(first, sizes)
        self.word = np.repeat(of, sizes)
        self.scored = inner >= np.repeat(known, sizes)

    def hashes(self, n: int, shift: int = 0) -> np.ndarray:
        """At each symbol, the hash of the n symbols that end `shift` symbols before it; meaningless where a word has fewer."""
        out = np.full(len(self.symbols), np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1), dtype=np.uint64)
        for back in range(n - 1 + shift, shift - 1, -1):
            moved = np.zeros_like(self.symbols)
            moved[back:] = self.symbols[: max(0, len(self.symbols) - back)]
            out = (out ^ moved) * _BASE
            out ^= out >> np.uint64(31)
        return out


def grams_of(words: list[str], order: int, step: int = STEP) -> Iterator[Grams]:
    """The words' grams in steps of about `step` symbols, each symbol scored once, whatever the length of a word."""
    marked = [f"{_BEGIN}{w}{_END}" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    at = 0
    while at < len(words):
        # as many whole words as a step takes, or one that is longer, in parts with the symbols before them
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + step]), step, side="right")))
        if n > 1 or sizes[at] <= step:
            zero = np.zeros(n, dtype=np.int64)
            yield Grams(marked[at : at + n], np.arange(at, at + n), zero, zero + 1)
        else:
            for begin in range(1, int(sizes[at]), step):
                first = max(0, begin - order + 1)
                yield Grams([marked[at][first : begin + step]], np.array([at]), np.array([first]), np.array([begin - first]))
        at += n


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if len(keys) == 0:
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class KneserNey:
    def __init__(self, counts: Counter, alphabet: int, order: int = ORDER):
        self.order, self.alphabet = order, alphabet
        words = sorted(counts)
        # all at once: a sample's texts are windows of bounded size
        grams = next(grams_of(words, order, step=1 << 62), None) or Grams([], *[np.zeros(0, dtype=np.int64)] * 3)
        weight = np.array([counts[w] for w in words], dtype=np.float64)[grams.word] if words else np.zeros(0)
        #: For each order, n-grams' hashes and discounted probabilities, contexts' hashes and weights of the order below.
        self.tables = []
        for n in range(1, order + 1):
            at = np.flatnonzero(grams.place >= max(1, n - 1))  # the first mark is never predicted
            gram, context = grams.hashes(n)[at], grams.hashes(n - 1, 1)[at]
            keys, first, back = np.unique(gram, return_index=True, return_inverse=True)
            raw = np.bincount(back, weights=weight[at], minlength=len(keys))
            begins = grams.place[at][first] == n - 1
            if n < order:
                longer = np.flatnonzero(grams.place[at] >= n)
                _, once = np.unique(grams.hashes(n + 1)[at][longer], return_index=True)
                spread = np.bincount(back[longer][once], minlength=len(keys)).astype(np.float64)
                value = np.where(begins & (n > 1), raw, np.maximum(spread, 0))
                value = np.where(value == 0, np.minimum(raw, 1), value)
            else:
                value = raw
            one, two = (value == 1).sum(), (value == 2).sum()
            discount = one / (one + 2 * two) if one and two else 0.5
            contexts, of = np.unique(context[first], return_inverse=True)
            total = np.bincount(of, weights=value, minlength=len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            probability = np.maximum(value - discount, 0) / total[of]
            self.tables.append((keys, probability, contexts, discount * kinds / total))

    def log_probabilities(self, grams: Grams, words: int, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sum of the natural logarithms over the symbols of each word that these grams score."""
        p = np.full(len(grams.symbols), 1.0 / self.alphabet)
        for n, (keys, probability, contexts, weight) in enumerate(self.tables, 1):
            gram, context = hashes[n - 1]
            use = grams.place >= max(1, n - 1)
            found = _looked_up(keys, probability, gram[use], 0.0) + _looked_up(contexts, weight, context[use], 1.0) * p[use]
            p[use] = found
        return np.bincount(grams.word[grams.scored], weights=np.log(p[grams.scored]), minlength=words)


class Model:
    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.regression: Logistic | None = None
        self.limits: dict[str, float] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size = 0
        #: For each known run of letters, the log-probability of its word under each language, and the word's symbols.
        self.rows = np.zeros((0, len(self.names) + 1))

    def __getstate__(self) -> dict:
        return {"names": self.names, "models": self.models, "regression": self.regression, "limits": self.limits}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _learn(self, counters: list[Counter]) -> None:
        """Make sure that the log-probabilities of these runs of letters are known."""
        new = list(set().union(*counters).difference(self.place))
        if new and ((len(self.place) + len(new)) * len(self.names) > MEMORY or self.size > 8 * MEMORY):
            self._forget()
            new = list(set().union(*counters))
        self.size += sum(map(len, new))
        if not new:
            return
        lower = [w.lower() for w in new]
        words = sorted(set(lower))
        order, rows = max(m.order for m in self.models), np.zeros((len(words), len(self.models) + 1))
        rows[:, -1] = [len(w) + 1 for w in words]
        for grams in grams_of(words, order):
            hashes = [(grams.hashes(n), grams.hashes(n - 1, 1)) for n in range(1, order + 1)]
            a, b = int(grams.word[0]), int(grams.word[-1]) + 1
            grams.word = grams.word - a
            rows[a:b, :-1] += np.stack([m.log_probabilities(grams, b - a, hashes) for m in self.models], axis=1)
        at = dict(zip(words, range(len(words)), strict=True))
        self.rows = np.concatenate([self.rows, rows[[at[w] for w in lower]]])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray, int] | None]:
        """For each text, nats per symbol under each language, and the number of symbols; None without letters."""
        if not self.models:
            return [None] * len(texts)
        counters = [runs(t) if t else Counter() for t in texts]
        self._learn(counters)
        out: list[tuple[np.ndarray, int] | None] = []
        for counts in counters:
            if not counts:
                out.append(None)
                continue
            at = np.fromiter(map(self.place.__getitem__, counts), dtype=np.int64, count=len(counts))
            weight = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            *logs, symbols = weight @ self.rows[at]
            out.append((-np.array(logs) / symbols, int(symbols)))
        return out

    @staticmethod
    def margin(entropy: np.ndarray, symbols: int) -> list[float]:
        best = np.sort(entropy)[:2]
        return [float(np.sqrt((best[1] - best[0]) * symbols))]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out = []
        for found in self.entropies(texts):
            if found is None:
                out.append(("und", 0.0, True))
                continue
            entropy, symbols = found
            best = int(entropy.argmin())
            score = 1.0 if self.regression is None else self.regression(self.margin(entropy, symbols))
            out.append((self.names[best], score, bool(score < REJECT or entropy[best] > self.limits.get(self.names[best], np.inf))))
        return out

    def calibrate(self, rows: list[tuple[str, str]]) -> None:
        """Fit the score and the limits of cross-entropy on (language, text); short pieces of the texts count too, so that there are
        margins of all sizes."""
        pieces = []
        for lang, text in rows:
            words = text.split()
            pieces += [(lang, text, True), *((lang, " ".join(words[i : i + n]), False) for n in (1, 2, 4) for i in range(0, min(len(words), 24), 6))]
        x, y, seen = [], [], {}
        for (lang, _, whole), found in zip(pieces, self.entropies([p for _, p, _ in pieces]), strict=True):
            if found is None:
                continue
            right = self.names[int(found[0].argmin())] == lang
            if whole and right:
                seen.setdefault(lang, []).append(found[0].min())
            if len(self.names) > 1:
                x.append(self.margin(*found))
                y.append(right)
        self.limits = {lang: float(np.mean(v) + 6 * np.std(v) + 0.1) for lang, v in seen.items()}
        if x:
            # two invented cases keep the slope finite where all are right
            a, b = np.array([*x, [0.0], [0.0]]), np.array([*y, True, False], dtype=float)
            self.regression = Logistic(a, b, np.full(len(a), 1 / len(a)), ridge=1e-4)


def sample(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> list[tuple[str, str]]:
    """Bounded (language, window of text) rows, in the order of their ids' hashes."""
    key_ = F.col(key).cast("long")
    rows = docs.select(key_.alias("k"), F.col(lang).alias("l"), window(F.col(text), key_, PIECE, 19).alias("t"))
    rows = rows.where("k IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL").where(fold(F.col("k"), FOLDS) != HELD)
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()  # a row for each language
    if not sizes:
        return []
    share = min(per_language, max(LEAST, SAMPLE // len(sizes)))
    rows = rows.withColumn("h", F.xxhash64(F.lit(11), "k"))
    cut = docs.sparkSession.createDataFrame([(r["l"], min(1 << 30, int((1 << 30) * 2 * share / r["n"]) + 1)) for r in sizes], "l string, cut long")
    rows = rows.join(F.broadcast(cut), "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("cut"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "k", "t"))
    chosen = rows.withColumn("r", rank).where(F.col("r") <= share).select("l", "r", "t").collect()  # bounded by SAMPLE, or LEAST rows of each language
    return [(r["l"], r["t"]) for r in sorted(chosen, key=lambda r: (r["l"], r["r"]))]


def fit(rows: list[tuple[str, str]], order: int = ORDER) -> Model:
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    counts, rest = {}, []
    for lang, texts in by.items():
        kept = [t for i, t in enumerate(texts) if i % 5 != 4]
        rest += [(lang, t) for i, t in enumerate(texts) if i % 5 == 4]
        counts[lang] = sum((word_counts(t) for t in kept), Counter())
    counts = {lang: c for lang, c in counts.items() if c}
    alphabet = len({c for words in counts.values() for w in words for c in w}) + 2
    model = Model({lang: KneserNey(c, alphabet, order) for lang, c in counts.items()})
    model.calibrate(rest)
    return model


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    return fit(sample(docs, key, text, lang, per_language))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, rejected) of each row."""
    held = df.sparkSession.sparkContext.broadcast(model)
    schema = f"{key} long, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                found = held.value.predict(part.column(1).to_pylist())
                columns = [part.column(0), *(pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), list(fields)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    fields = arrow_schema(schema)
    found = df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)
    return found.select(key, F.coalesce(fold(F.col(key), FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
