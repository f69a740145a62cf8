"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
which a forward pass over the word gives; a text's is the product over its
words. The probabilities are learnt by expectation maximisation, where the
forward and backward sums give each piece's expected count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from linkloom.llm.words import slices

#: Training documents of each language at most, about; drawn by a hash of doc_id.
SAMPLE = 400
#: Languages learnt at most, those of most labelled rows: with SAMPLE, the bound of the rows learnt from.
MOST_LANGUAGES = 1000
ROUNDS = 2
CACHE = 150_000
LONGEST_PIECE = 10
#: Steps of the forward sums after which they are scaled: 1e-7 a letter stays far above the least double.
SCALE_EVERY = 12
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_STRICT = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters (categories L)."""
    out = _LETTERS.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, out)):
        # The quick pattern also takes numbers that aren't digits, such as fractions.
        out = [w for run in out for w in ([run] if run.isalpha() else _STRICT.findall(run))]
    return out


def is_training(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder 1 by 3; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def public_pieces(tiktoken_file: str, longest: int = LONGEST_PIECE) -> list[str]:
    """Pieces of letters of a byte-level rank file; a leading blank becomes the word mark."""
    import base64

    out = set()
    with open(tiktoken_file, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode("utf-8").lower()
            except (UnicodeDecodeError, IndexError):
                continue
            body = piece.removeprefix(" ")
            if body and len(body) <= longest and _LETTERS.fullmatch(body):
                out.add(("▁" if piece.startswith(" ") else "") + body)
    return sorted(out)


def learn(word_counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> dict:
    """Piece probabilities of each language from its word counts.

    Single characters are always pieces, so every word has a segmentation.
    """
    model: dict[str, dict[str, float]] = {}
    for lang, words in sorted(word_counts.items()):
        names = sorted({*pieces, *(c for w in words for c in "▁" + w)})
        index = Pieces({"langs": [lang], "table": {p: (1.0,) for p in names}, "floor": 0.0})
        used = index.expected(words, None)
        length = np.array([0, 0, *map(len, names)], dtype=np.float64)
        prob = used * length
        for _ in range(rounds):
            index.prob = (prob / max(prob.sum(), 1e-300))[:, None]
            prob = index.expected(words, index.prob[:, 0])
            prob = np.where((prob > 1e-4) | (length == 1), prob, 0.0)
        total = prob.sum() or 1.0
        model[lang] = {p: c / total for p, c in zip(names, prob[2:].tolist(), strict=True) if c > 0}
    langs = sorted(model)
    every = sorted(set().union(*(model[x].keys() for x in langs))) if langs else []
    # A little of each language's mass goes to the pieces of the others.
    small = 1e-7
    return {"langs": langs, "table": {p: tuple(model[x].get(p, 0.0) * 0.999 + small for x in langs) for p in every}, "floor": small}


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The model's pieces by length, as sorted hashes with rows of probabilities; forward and backward sums."""

    def __init__(self, model: dict):
        self.langs = len(model["langs"])
        names = sorted(model["table"])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: Row 0 is a piece that isn't there, row 1 an unknown character.
        self.prob = np.array([[0.0] * self.langs, [model["floor"]] * self.langs] + [model["table"][p] for p in names])
        for n in sorted({len(p) for p in names}):
            own = [k for k, p in enumerate(names) if len(p) == n]
            chars = np.array([[ord(c) for c in names[k]] for k in own], dtype=np.uint64)
            h = chars[:, 0]
            for j in range(1, n):
                h = h * _BASE + chars[:, j]
            order = np.argsort(h)
            self.by_length[n] = h[order], np.array(own)[order] + 2
        self.by_length.setdefault(1, (np.zeros(1, np.uint64), np.zeros(1, np.int64)))

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray], int]]:
        """Words of one length at a time: their places, the rows of their pieces by size and start, their letters with the mark."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            step = max(1, (1 << 15) // (n + 1))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                text = "".join(["▁" + words[k] for k in some.tolist()])
                chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(some), n + 1).astype(np.uint64)
                yield some, self._rows(chars), n + 1

    def _rows(self, chars: np.ndarray) -> dict[int, np.ndarray]:
        rows: dict[int, np.ndarray] = {}
        h = chars
        for size in range(1, min(chars.shape[1], max(self.by_length)) + 1):
            if size > 1:
                h = h[:, :-1] * _BASE + chars[:, size - 1 :]
            if size in self.by_length:
                keys, index = self.by_length[size]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                rows[size] = np.where(keys[k] == h, index[k], int(size == 1))
        return rows

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language: sums over all segmentations, whatever its length."""
        out = np.zeros((len(words), self.langs))
        for some, rows, n in self._groups(words):
            out[some] = self._forward(rows, n, len(some))
        return out

    def _forward(self, rows: dict[int, np.ndarray], n: int, w: int) -> np.ndarray:
        """Logarithms of the forward sums; those that later ones need are kept in a ring, and scaled."""
        ring = max(rows) + 1
        ahead = np.zeros((min(n + 1, ring), w, self.langs))
        ahead[0] = 1.0
        logs = np.zeros((w, self.langs))
        for e in range(1, n + 1):
            new = np.zeros((w, self.langs))
            for size, row in rows.items():
                if size <= e:
                    at = row[:, e - size]
                    hit = np.flatnonzero(at)
                    if len(hit) == w:
                        new += ahead[(e - size) % ring] * self.prob[at]
                    elif len(hit):
                        new[hit] += ahead[(e - size) % ring, hit] * self.prob[at[hit]]
            ahead[e % ring] = new
            if e % SCALE_EVERY == 0:
                logs += np.log(new)
                ahead /= new
        return logs + np.log(ahead[n % ring])

    def expected(self, words: dict[str, int], prob: np.ndarray | None) -> np.ndarray:
        """Expected count of each piece in weighted words by forward and backward sums; without probabilities, all its places."""
        out = np.zeros(len(self.prob))
        names, weights = list(words), np.array(list(words.values()), dtype=np.float64)
        for some, rows, n in self._groups(names):
            weight = weights[some]
            if prob is None:
                for row in rows.values():
                    out += np.bincount(row.ravel(), weights=np.repeat(weight, row.shape[1]), minlength=len(out))
                continue
            p = {size: np.where(row > 1, prob[row], 0.0) for size, row in rows.items()}
            w = len(some)
            # Sums of place e are scaled by grow[e]; a word whose letters are all known has none of zero.
            ahead, grow = np.zeros((n + 1, w)), np.zeros((n + 1, w))
            ahead[0] = 1.0
            for e in range(1, n + 1):
                for size, x in p.items():
                    if size <= e:
                        ahead[e] += ahead[e - size] * x[:, e - size] * np.exp(grow[e - size] - grow[e - 1])
                top = np.where(ahead[e] > 0, ahead[e], 1.0)
                ahead[e] /= top
                grow[e] = grow[e - 1] + np.log(top)
            back = np.zeros((n + 1, w))
            back[n] = 1.0
            # back is scaled by grow[n] - grow[e], so that products need no further factor.
            for s in range(n - 1, -1, -1):
                for size, x in p.items():
                    if s + size <= n:
                        back[s] += x[:, s] * back[s + size] * np.exp(grow[s] - grow[s + size])
            good = ahead[n] > 0
            for size, row in rows.items():
                s = np.arange(n - size + 1)
                share = ahead[s].T * p[size] * back[s + size].T * np.exp((grow[s] - grow[s + size]).T) * (weight * good)[:, None]
                out += np.bincount(row.ravel(), weights=share.ravel(), minlength=len(out))
        out[:2] = 0.0
        return out


def training_words(docs: DataFrame, sample: int = SAMPLE) -> dict[str, dict[str, int]]:
    """Word counts of each language in a sample of about `sample` labelled rows of each of MOST_LANGUAGES languages at most."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_training("doc_id"))
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["n"] for r in found.collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                per.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, c) for lang, counts in per.items() for w, c in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "c"])

    # Languages that aren't learnt have no share, and no row drawn.
    counted = labelled.where(drawn).select("text", "lang").mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    out: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for r in counted.select("lang", "word", "c").toLocalIterator():
        out[r["lang"]][r["word"]] = r["c"]
    return {lang: dict(sorted(w.items())) for lang, w in out.items()}


PREDICTED = "doc_id long, lang_pred string, score double"


def train(docs: DataFrame, pieces: list[str], sample: int = SAMPLE) -> dict:
    """The model of `learn` from the labelled rows that may be learnt from."""
    return learn(training_words(docs, sample), pieces)


class Scorer:
    """Scores texts with a model; distinct words are scored once while the cache holds them."""

    def __init__(self, model: dict):
        self.langs, self.pieces = model["langs"], Pieces(model)
        self.index: dict[str, int] = {}
        self.matrix = np.zeros((0, len(self.langs)))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior probability) of each text.

        The posterior is over all languages with equal priors; ties go to the
        first language by code point. Texts without letters give ('und', 0).
        """
        split = [words_of(t) if t else [] for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0) for _ in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        if len(self.index) > CACHE:
            # Words in use stay.
            kept = list(new & self.index.keys())
            self.matrix = self.matrix[[self.index[w] for w in kept]] if kept else self.matrix[:0]
            self.index = dict(zip(kept, range(len(kept)), strict=True))
        fresh = list(new - self.index.keys())
        if fresh:
            got = self.pieces.scores(fresh)
            self.index.update(zip(fresh, range(len(self.matrix), len(self.matrix) + len(fresh)), strict=True))
            self.matrix = np.concatenate([self.matrix, got])
        out, at = [], self.index.__getitem__
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.matrix[np.fromiter(map(at, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], 1.0 / sum(exp(max(-700.0, x - total[best])) for x in total.tolist())))
        return out


def predict(docs: DataFrame, model: dict, column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs. Nothing but the text is looked at.

    Null, empty and letterless texts give ('und', 0); very long texts and words
    are scored whole. Repeated rows give equal rows, null ids stay; ties go to
    the first language by code point. An empty table gives an empty result;
    other columns are ignored. Without a language learnt all are 'und'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, PREDICTED)


def accepted(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """docs without the rows whose text has no letter or whose language stays unclear."""
    index, schema = docs.columns.index("text"), docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = scorer.score(part.column(index).to_pylist())
                keep = [k for k, (lang, p) in enumerate(rows) if lang != UNKNOWN and p >= least]
                yield part.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(run, schema)
