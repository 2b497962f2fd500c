"""Reading level of each text: smoothed unigram language models per level, seeded by a formula."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import materialize, spread

#: Texts, in expectation, that the models are fitted on; chosen by a hash of the id.
SEED_TEXTS = 20_000
#: Words of the models' vocabulary at most, and how often a word must come in the seed texts.
VOCABULARY, LEAST_COUNT = 50_000, 3
#: Levels 1 (easy) to 5 (demanding).
LEVELS = 5
#: Demanding prose: at least so many words, words per sentence and letters per word.
WORDS, WORDS_PER_SENTENCE, LETTERS_PER_WORD = 30, 18.0, 5.5
#: Lower limits of the automated readability index for levels 2, 3 and 4.
ARI_LIMITS = (2.0, 6.0, 10.0)
#: Added to every count of a model.
SMOOTHING = 0.5
#: Words that one sentence's event weighs as much as; classes of sentence sizes, three to each doubling.
SENTENCE_WEIGHT, SIZE_CLASSES = 10, 21

_INDENTED = re.compile(r"^(?: {4}|\t)[^\n]*$", re.MULTILINE)
_BLOCK = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.DOTALL | re.IGNORECASE)
_INLINE = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"\]\([^()\s]*\)|(?:https?|ftp)://\S+|\bwww\.\S+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
# Runs of stops before a blank, a closing sign or the end, and blank lines; the set in front is what makes the search fast.
_STOP = re.compile(r"[.!?…\n](?:(?<=\n)\s*\n|(?<!\n)[.!?…]*(?=[\s\"'”’)\]]|\Z))")
_SIGNS = re.compile(r"['’\-]")


def prose(text: str) -> str:
    """The text without program code (blocks, indented or inline) and without links; other markup goes too."""
    tags = "<" in text
    if tags or "`" in text or "~~~" in text:
        text = _INLINE.sub(" ", _BLOCK.sub("\n\n", text))
    if "    " in text or "\t" in text:
        text = _INDENTED.sub("", text)
    if tags:
        text = _TAG.sub(" ", text)
    if "://" in text or "](" in text or "www." in text:
        text = _LINK.sub(" ", text)
    return html.unescape(text) if "&" in text else text


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of prose; sentences end at stops and blank lines."""
    return [w for w in (_WORD.findall(s) for s in _STOP.split(text)) if w]


def measures(text: str) -> tuple[int, int, int, list[str], list[int]]:
    """Words, sentences and letters of a text's prose, its words in lower case, and the words of each sentence."""
    found = sentences(prose(text))
    words = [w for s in found for w in s]
    letters = sum(map(len, words)) - sum(len(_SIGNS.findall(w)) for w in words if not w.isalpha())
    return len(words), len(found), letters, " ".join(words).lower().split(), [len(s) for s in found]


def demanding(words: int, sents: int, letters: int) -> bool:
    return words >= WORDS and words >= WORDS_PER_SENTENCE * sents and letters >= LETTERS_PER_WORD * words


def seed_level(words: int, sents: int, letters: int) -> int:
    """The level that the formula gives a text, to train on; 0 for texts too short to tell."""
    if words < WORDS:
        return 0
    if demanding(words, sents, letters):
        return LEVELS
    index = 4.71 * letters / words + 0.5 * words / sents - 21.43
    return 1 + sum(index >= x for x in ARI_LIMITS)


def _length_token(word: str) -> str:
    return f"<{min(len(word), 16)}>"


def _size_token(words: int) -> str:
    """The event of a sentence of so many words."""
    return f"<s{min(int(3 * math.log2(words)), SIZE_CLASSES - 1)}>"


def _seed_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: texts -> (level, token, n): words, sentence events, and '<text>' for the text itself."""
    for b in batches:
        counts: Counter = Counter()
        for text in b.column(0).to_pylist():
            if text:
                n, s, c, words, sizes = measures(text)
                if level := seed_level(n, s, c):
                    counts.update((level, w) for w in words)
                    counts.update((level, _size_token(k)) for k in sizes)
                    counts[level, "<text>"] += 1
        lv, tk = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(lv, pa.int32()), pa.array(tk, pa.string()), pa.array(counts.values(), pa.int64())], names=["level", "token", "n"])


class Models:
    """Per level the log probabilities of words and of sentence events, and those of the levels themselves."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        """rows: (level, token, n); '<text>' counts texts, '<sK>' sentences of size class K, '<k>' other words of k letters."""
        kinds = {f"<s{k}>" for k in range(SIZE_CLASSES)}, {t for _, t, _ in rows if t[:2] != "<s" and t != "<text>"} | {f"<{k}>" for k in range(1, 17)}
        self.index: dict[str, int] = {}
        parts = []
        for tokens in kinds:
            self.index |= {t: len(self.index) + i for i, t in enumerate(sorted(tokens))}
            parts.append(len(tokens))
        counts, texts = np.full((len(self.index), LEVELS), SMOOTHING), np.ones(LEVELS)
        for level, token, n in rows:
            if token == "<text>":
                texts[level - 1] += n
            else:
                counts[self.index[token], level - 1] += n
        self.log_p = np.vstack([np.log(c / c.sum(0)) for c in (counts[: parts[0]], counts[parts[0] :])])
        self.prior = np.log(texts / texts.sum())
        self.sizes = [self.index[_size_token(k)] for k in range(1, 1024)]  # all longer ones are of the last class
        self.lengths = [self.index[_length_token("x" * k)] for k in range(1, 17)]

    def posterior(self, words: list[str], sizes: list[int]) -> np.ndarray:
        """Log posterior of each level, up to a constant."""
        get, lengths = self.index.get, self.lengths
        said = [i if (i := get(w)) is not None else lengths[min(len(w), 16) - 1] for w in words]
        ends = [self.sizes[min(k, 1023) - 1] for k in sizes]
        return self.prior + self.log_p[said].sum(0) + SENTENCE_WEIGHT * self.log_p[ends].sum(0)


def fit(df: DataFrame, ident: Column, text: Column, *, seed_texts: int = SEED_TEXTS, vocabulary: int = VOCABULARY) -> Models:
    """Models from a sample of about `seed_texts` texts, labelled by the formula; the sample is the hash of the id.

    Words that are rare in the sample, or come after the `vocabulary` most frequent ones, count as their length, so
    the models hold at most `vocabulary` words whatever the corpus. Texts too short for the formula are no seeds.
    """
    src = df.select(ident.alias("id"), text.alias("text")).where("text is not null")
    share = min(1.0, seed_texts / max(1, df.count()))
    last = min(2**63 - 1, -(2**63) + int(share * 2**64))
    chosen = src.where(F.xxhash64("id") <= F.lit(last))
    counts = spread(chosen.select("text")).mapInArrow(_seed_counts, "level int, token string, n long")
    levels = range(1, LEVELS + 1)
    by_level = [F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in levels]
    per = materialize(counts.groupBy("token").agg(*by_level, F.sum("n").alias("all")), "word-counts")  # read twice
    own = F.col("token").startswith("<")
    length = F.concat(F.lit("<"), F.least(F.length("token"), F.lit(16)).cast("string"), F.lit(">"))
    frequent = per.where(~own & (F.col("all") >= LEAST_COUNT)).orderBy(F.col("all").desc(), "token").limit(vocabulary).withColumn("kept", F.lit(True))
    named = per.join(F.broadcast(frequent.select("token", "kept")), "token", "left").select(F.when(own | F.col("kept"), F.col("token")).otherwise(length).alias("token"), *[f"n{k}" for k in levels])
    rows = named.groupBy("token").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in levels]).collect()
    return Models([(k, r["token"], r[f"n{k}"]) for r in rows for k in levels if r[f"n{k}"]])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                n, s, c, words, sizes = measures(text) if text else (0, 0, 0, [], [])
                if n:
                    post = models.posterior(words, sizes)
                    best = int(post.argmax())
                    others = np.delete(post, LEVELS - 1).max()
                    out.append((best + 1, float((post[LEVELS - 1] - others) / n), n, s, c))
                else:
                    out.append((None, None, 0, 0, 0))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]], names=["id", "level", "margin", "n_words", "n_sentences", "n_letters"])

    return run


def reading_levels(df: DataFrame, ident: Column, text: Column, *, models: Models | None = None, **options) -> DataFrame:
    """(id, level, margin, n_words, n_sentences, n_letters) of each text's prose.

    level 1 to 5 is the one of highest posterior under the unigram models, null for texts without prose words
    (null, empty, code only). margin is the log posterior of level 5 less the best other one's, per word. Every
    text is read whole; the models (bounded, see `fit`) are all that travels. Repeated rows give a row each.
    """
    models = models or fit(df, ident, text, **options)
    shared = df.sparkSession.sparkContext.broadcast(models)
    src = spread(df.select(ident.cast("long").alias("id"), text.alias("text")))
    return src.mapInArrow(_score(shared), "id long, level int, margin double, n_words long, n_sentences long, n_letters long")


def is_demanding() -> Column:
    """Whether a row of `reading_levels` is demanding by the exact measures."""
    n = F.col("n_words")
    return (n >= WORDS) & (n >= F.col("n_sentences") * WORDS_PER_SENTENCE) & (F.col("n_letters") >= n * LETTERS_PER_WORD)

