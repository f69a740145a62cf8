"""Column expressions on text: passages, tokens, n-grams, stems, IDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

MOST_PASSAGES = 60
LEAST_CHARS = 25
PASSAGE_CHARS = 500
FIRST_NGRAMS = 40
RARE_SHARE = 0.15

#: Words that end a phrase.
STOP_WORDS = """the and for with you your are from that this how what why when about into out get can will have has was were been more all use using via per a an of to in on at by is it as or be but not they their them these those which who whom than then also may should could would do does best top guide tips need know new ways""".split()


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS, _RUN, _BREAK, _SENTENCE = re.compile(r"[ \t]+"), re.compile(f"{_SPACE}+"), re.compile(f"\n{_SPACE}*\n"), re.compile(f"(?<=[.!?]){_SPACE}+")


def pack(lengths: list[int], most: int) -> list[int]:
    """Where parts begin if sentences of these lengths are packed in order, each with a blank before it."""
    starts, filled = [0], 0
    for k, n in enumerate(lengths):
        if filled and filled + n > most:
            starts.append(k)
            filled = 0
        filled += n + 1
    return starts


def split_plain(text: str | None, most: int | None = MOST_PASSAGES) -> list[str]:
    """Passages of text without markup: blank lines part paragraphs, short ones go, long ones are packed by sentences; all of them if most is None."""
    out: list[str] = []
    for raw in _BREAK.split(_BLANKS.sub(" ", text or "").strip(" ")):
        para = _RUN.sub(" ", raw).strip(" ")
        if LEAST_CHARS <= len(para) <= PASSAGE_CHARS:
            out.append(para)
        elif len(para) > PASSAGE_CHARS:
            sentences = _SENTENCE.split(para)
            starts = pack([len(x) for x in sentences], PASSAGE_CHARS)
            out += [" ".join(sentences[a:b]).strip(" ") for a, b in zip(starts, [*starts[1:], len(sentences)], strict=True)]
        if most is not None and len(out) > most:
            break
    return [p for p in out if p][:most]


def _split(texts: pd.Series) -> pd.Series:
    return texts.map(split_plain)


#: Passages of a text column, in Arrow batches: packing sentences one by one is no work for array lambdas.
passages = F.pandas_udf(_split, ArrayType(StringType()))


def _split_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: split_plain(x, None))


#: All passages, however many: what links are prepared from.
all_passages = F.pandas_udf(_split_all, ArrayType(StringType()))


def idf_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, three characters at least."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 3)


def phrase_tokens(text: Column) -> Column:
    """Tokens where short ones and stop words are empty: boundaries that phrases don't cross."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.when((F.length(t) < 3) | F.array_contains(stop, t), F.lit("")).otherwise(t))


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams of neighbouring tokens without boundaries, in order.

    Arrays are zipped with their own tails: a lambda that reached into `tokens`
    would split the text again for every element.
    """
    out = tokens
    for k in range(2, n + 1):
        tail = F.slice(tokens, F.lit(k), F.greatest(F.size(tokens) - (k - 1), F.lit(0)))
        out = F.zip_with(out, tail, lambda a, b: F.when((a == "") | (F.coalesce(b, F.lit("")) == ""), "").otherwise(F.concat(a, F.lit(" "), b)))
    return F.filter(out, lambda g: g != "")


#: Words of lower-case text, as `phrase_tokens` has them.
_WORDS, _ASCII_WORDS = regex.compile(r"[\p{L}\p{N}]+"), re.compile(r"[a-z0-9]+")
_STOP = frozenset(STOP_WORDS)


def phrase_words(lower: str | None) -> Iterator[str]:
    """`phrase_tokens` of a text in lower case, one by one; what is before the first and after the last word is no boundary."""
    return ("" if len(w) < 3 or w in _STOP else w for w in (m[0] for m in _pattern(lower or "").finditer(lower or "")))


def _pattern(lower: str):
    return _ASCII_WORDS if lower.isascii() else _WORDS


def all_phrase_words(lower: str) -> list[str]:
    """`phrase_words` at once."""
    return ["" if len(w) < 3 or w in _STOP else w for w in _pattern(lower).findall(lower)]


def grams(words: Iterable[str], n: int) -> Iterator[str]:
    """`ngrams` of words that come one by one."""
    run: list[str] = []
    for w in words:
        run = [*run[-n + 1 :], w] if w else []
        if len(run) == n:
            yield " ".join(run)


def first_grams(words: Callable[[], Iterable[str]]) -> list[str]:
    """The first distinct two- and three-word phrases, two-word ones first; words are read only as far as needed."""
    found: dict[str, None] = {}
    for n in (2, 3):
        for g in grams(words(), n):
            found[g] = None
            if len(found) == FIRST_NGRAMS:
                return list(found)
    return list(found)


def _first_ngrams(lower: pd.Series) -> pd.Series:
    return lower.map(lambda x: None if x is None else first_grams(lambda: phrase_words(x)))


_first = F.pandas_udf(_first_ngrams, ArrayType(StringType()))


def first_ngrams(body: Column) -> Column:
    """The first distinct two- and three-word phrases of a body, two-word ones first."""
    return _first(F.lower(body))


def acronyms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b(\p{Lu}[\p{Lu}\p{Nd}]{1,5})\b"), F.lit(1)))


def stem(word: Column) -> Column:
    """The word without the first of the endings ings, ing, ies, es, s that leaves three letters."""
    out = word
    for end in ("s", "es", "ies", "ing", "ings"):
        out = F.when(word.endswith(end) & (F.length(word) > len(end) + 2), F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def idf(n: Column, df: Column) -> Column:
    return F.log((F.greatest(n, F.lit(1)) + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def floor(n: Column) -> Column:
    """The IDF of a token that RARE_SHARE of the posts hold."""
    n = F.greatest(n, F.lit(1))
    return F.log((n + 1) / (n * RARE_SHARE + 1)) + 1


def document_frequency(passages_df: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
    """(token, df) over posts, and one row n: posts that have a passage. One pass: n is the count of a token that every post has.

    A post's passages are joined first, so that tokens needn't be made distinct by a shuffle.
    """
    posts = passages_df.groupBy("post_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return _frequency(posts, ws)


def document_frequency_of(texts: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
    """The same from rows (post_id, passages), an array, one for each post: nothing is grouped by post."""
    # A filter on passages would have a second Python worker split the texts for it.
    return _frequency(texts.select("post_id", F.when(F.size("passages") > 0, F.array_join("passages", " ")).alias("text")), ws)


def _frequency(posts: DataFrame, ws) -> tuple[DataFrame, DataFrame]:
    tokens = posts.select(F.explode(F.array_union(F.array(F.lit("")), idf_tokens(F.col("text")))).alias("token"))
    counted = ws.cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    return counted.where("token <> ''"), counted.agg(F.coalesce(F.max(F.when(F.col("token") == "", F.col("df"))), F.lit(0)).cast("long").alias("n"))


def match_form(text: Column) -> Column:
    """Text for phrase tests: punctuation as tokens of its own, single spaces, padded."""
    spaced = F.regexp_replace(F.lower(collapsed(text)), r"[^\p{L}\p{N} ]", " | ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(spaced, " +", " ")), F.lit(" "))


def confidence(passage_score: Column, words: Column, spec: Column, floor_: Column, ai: Column | None = None) -> Column:
    """20 to 96 from relevance, anchor length and distinctiveness; averaged with a judge's."""
    lift = F.greatest(F.lit(0.0), F.least(F.lit(15.0), 4 * (spec - floor_)))
    own = F.greatest(F.lit(20.0), F.least(F.lit(96.0), F.round(0.6 * passage_score + 3 * F.greatest(words, F.lit(1)) + lift + 10)))
    return (own if ai is None else F.when(ai.isNull(), own).otherwise(F.round((own + ai) / 2))).cast("int")


def norm_path(path: Column) -> Column:
    decoded = F.try_url_decode(F.regexp_replace(path, r"\+", "%2B"))
    return F.lower(F.concat(F.lit("/"), F.trim(F.coalesce(decoded, path), F.lit("/"))))


def norm_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")
