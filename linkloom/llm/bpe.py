"""BPE by speculation and verification, for word-end vocabularies.

Greedy longest matches propose the tokens of every distinct word. A proposal
is right exactly if every two neighbours in it are the encoding of the text
they make together; these tests run on arrays of pair codes, and each distinct
pair is settled once. Words with a failing pair are merged by rank.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from linkloom.llm.words import slices

CACHE = 150_000
AT_ONCE = 8192
#: Characters that _LATIN tells apart, after normalising.
_COMMON = re.compile(r"[\x00-\u02af\u2010-\u2027\u20ac]*")
_STOP = "\n"
#: Fixed value: the word pattern of the vocabulary file that _LATIN stands for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The contract's word pattern for texts of _COMMON characters; letters come first as they are most.
_LATIN = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:[stmd]|re|ve|ll)|[^\t-\r \x85\xa00-9a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\xb2\xb3\xb9\xbc-\xbe]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Tokenizer:
    """One vocabulary file: normaliser, word pattern, merges, word ends."""

    def __init__(self, spec: str | bytes):
        conf = json.loads(spec)
        model = conf["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("unk_token"):
            raise ValueError("unsupported vocabulary")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.ranks = {m: n for n, m in enumerate(merges)}
        steps = conf["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self._latin = self.pattern.pattern == _PATTERN
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(self.letters)}
        self.token_text: dict[int, str] = {}
        self.names = {n: s for s, n in self.vocab.items()} | {n: s for s, n in self.special.items()}
        self._back = back
        # 255 is no byte of UTF-8; it parts words, and a token with a word end takes it in.
        self._table = {b: c for b, c in enumerate(self.letters)} | {255: _STOP}
        self.longest = ahocorasick.Automaton()
        sizes = [0] * (max(self.names) + 1)
        for name, n in self.vocab.items():
            ends = self.end and name.endswith(self.end) and name != self.end
            body = name[: -len(self.end)] + _STOP if ends else name
            sizes[n] = len(body)
            self.longest.add_word(body, n)
        self.longest.make_automaton()
        self.sizes = np.array(sizes)
        self.single: dict[int, bool] = {}
        self._spec = spec if isinstance(spec, str) else spec.decode("utf-8")
        self._library = None
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.pairs: dict[int, bool] = {}
        self.exact_words = self.proposed_words = 0

    def normal(self, text: str) -> str:
        """Canonical composition and lower case letter by letter; words hold no white space anyway."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # str.lower() looks at neighbours only for the capital sigma.
        return (text.replace("\u03a3", "\u03c3") if "\u03a3" in text else text).lower()

    def pieces(self, word: str) -> list[str]:
        """The word as byte letters, the last with the word end."""
        chars = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        chars[-1] += self.end
        return chars

    def merge(self, parts: list[str]) -> list[str]:
        """Exact merging: the pair of lowest rank first, leftmost first."""
        get, parts, none = self.ranks.get, list(parts), 1 << 60
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = get((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = get((parts[k], parts[k + 1]), none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """Exact merging with a heap and links, for words of many letters."""
        import heapq

        n, ranks = len(parts), self.ranks
        text, left, right = list(parts), list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := ranks.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k] if text[k] == a else -1
            if j < 0 or text[j] != b:
                continue
            text[k], text[j] = a + b, ""
            right[k] = right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for p, q in ((left[k], k), (k, right[k])):
                if p >= 0 and q >= 0 and (r := ranks.get((text[p], text[q]))) is not None:
                    heapq.heappush(heap, (r, p, text[p], text[q]))
        return [t for t in text if t]

    def exact(self, word: str) -> list[int]:
        parts = self.pieces(word)
        return [self.vocab[p] for p in (self.merge(parts) if len(parts) < 64 else self.merge_long(parts))]

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: tokens, the word of each, and whether a word was taken up wholly.

        A match that reaches the end of a word must carry the word end.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        letters = (b"\xff".join(raw) + b"\xff").decode("latin-1").translate(self._table)
        flat = np.fromiter(chain.from_iterable(self.longest.iter_long(letters)), np.int64).reshape(-1, 2)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        owner = np.searchsorted(np.cumsum(sizes), flat[:, 0], "right")
        taken = np.bincount(owner, weights=self.sizes[flat[:, 1]], minlength=len(raw)).astype(np.int64)
        return flat[:, 1], owner, taken == sizes

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code, whether its two tokens stand side by side in an encoding."""
        distinct, where = np.unique(codes, return_inverse=True)
        good = np.empty(len(distinct), dtype=bool)
        for n, code in enumerate(distinct.tolist()):
            ok = self.pairs.get(code)
            if ok is None:
                a, b = code >> 32, code & 0xFFFFFFFF
                ok = self.pairs[code] = self._settle(a, b)
            good[n] = ok
        return good[where]

    def _settle(self, a: int, b: int) -> bool:
        x, y = self.names[a], self.names[b]
        return self.merge(list(x) + self._letters(y)) == [x, y]

    def _letters(self, name: str) -> list[str]:
        if self.end and name.endswith(self.end) and len(name) > len(self.end):
            body = list(name[: -len(self.end)])
            return [*body[:-1], body[-1] + self.end]
        return list(name)

    def _sound(self, token: int) -> bool:
        """Whether a token is the encoding of its own text."""
        if token not in self.single:
            self.single[token] = self.merge(self._letters(self.names[token])) == [self.names[token]]
        return self.single[token]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words: propose, test all neighbours at once, mend failing words."""
        if not words:
            return []
        flat, owner, good = self.propose(words)
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            codes = (flat[:-1] << 32 | flat[1:])[inside]
            if len(codes):
                good[owner[1:][inside][~self.compatible(codes)]] = False
        counts = np.bincount(owner, minlength=len(words))
        ends = np.cumsum(counts)
        alone = np.flatnonzero(good & (counts == 1))
        good[alone] = np.fromiter(map(self._sound, flat[ends[alone] - 1].tolist()), bool, len(alone))
        self.proposed_words += len(words)
        self.exact_words += int(len(words) - good.sum())
        tokens, ends = flat.tolist(), ends.tolist()
        return [tokens[a:b] if ok else self.exact(w) for w, ok, a, b in zip(words, good.tolist(), [0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        """Words in order, with special tokens as themselves."""
        if self.split_special is None or "<|" not in text or not self.split_special.search(text):
            return self.plain_words(text)
        out = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self.plain_words(part)
        return out

    def plain_words(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Which rare characters are letters depends on a library's Unicode tables;
        texts with any past the Latin blocks are split by the tokenizers library.
        """
        if self._latin and (text.isascii() or _COMMON.fullmatch(normal := self.normal(text))):
            return _LATIN.findall(text.lower() if text.isascii() else normal)
        if self._library is None:
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self._spec)
        lib, back = self._library, self._back
        pieces = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(map(back.__getitem__, p)).decode("utf-8") for p, _ in pieces]

    def learn(self, texts_words: list[list[str]]) -> None:
        """Put the tokens of all words into the caches; full ones are cut to the words in use."""
        new: set[str] = set()
        for words in texts_words:
            new.update(words)
        if len(self.ids_of) > CACHE:
            # Words in use stay.
            kept = new & self.ids_of.keys()
            self.ids_of, self.text_of = ({w: old[w] for w in kept} for old in (self.ids_of, self.text_of))
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        fresh = list(new - self.ids_of.keys())
        plain = [w for w in fresh if w not in self.special]
        # Some thousand words at once fill the arrays well; more only take memory.
        for k in range(0, len(plain), AT_ONCE):
            part = plain[k : k + AT_ONCE]
            self._keep(zip(part, self.encode_words(part), strict=True))
        self._keep((w, [self.special[w]]) for w in fresh if w in self.special)

    def _keep(self, tokens: Iterable[tuple[str, list[int]]]) -> None:
        for w, ids in tokens:
            self.ids_of[w] = " ".join(map(str, ids))
            self.text_of[w] = self.decode(ids)

    def forget(self) -> None:
        """Empty the caches: workers outlive their tasks."""
        self.ids_of, self.text_of, self.pairs = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        """The tokens' names, one space between them: this vocabulary has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode_batch(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by a space, decoded text) for each text."""
        split = [self.split(t or "") for t in texts]
        self.learn(split)
        id_of, text_of, out = self.ids_of.__getitem__, self.text_of.__getitem__, []
        for words in split:
            ids = " ".join(map(id_of, words))
            out.append((ids.count(" ") + 1 if ids else 0, ids, " ".join(map(text_of, words))))
        return out


_loaded: dict[bytes, Tokenizer] = {}


def tokenizer(spec: bytes) -> Tokenizer:
    """The tokenizer of a vocabulary file's content; kept by the worker."""
    key = hashlib.sha256(spec).digest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(spec)
    return _loaded[key]


ENCODED = "doc_id long, n_tokens long, ids string, decoded string"


def encode(docs: DataFrame, vocabulary: str, column: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (joined by a space) and decoded text of each row of docs.

    `vocabulary` is a file of the driver, whose content (a few MB) is broadcast.
    Null and empty texts have no tokens and empty strings; very long texts are
    encoded whole. Every row is encoded by itself, so repeated rows and ties give
    equal rows and null ids stay. An empty table gives an empty result; other
    columns are ignored. With `digest` the last two columns are the SHA-256 of
    their UTF-8 form in lower-case hexadecimal digits.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    form = (lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()) if digest else str
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else ENCODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(shared.value)
        # A worker that was cut short may still hold words.
        tok.forget()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = tok.encode_batch(part.column(1).to_pylist())
                cols = [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([form(r[1]) for r in rows], pa.string()), pa.array([form(r[2]) for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"])
        tok.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(run, schema)
