"""Evaluation passages in a corpus: one Aho-Corasick automaton over normalised items, scanning each text once."""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import spread

#: Consecutive words of an item that make a passage.
PASSAGE_WORDS = 12
#: Letters of a key at most; a key is the begin of some words of an item, so the automaton has fewer nodes than the items have letters.
KEY_CHARS = 20
#: Characters of items in one automaton (about 30 bytes each in a Python worker). More items take a scan for each block of this size.
BLOCK_CHARS = 8_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.DOTALL)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_MARKUP = re.compile(f"(?P<tag>{_TAG.pattern})|(?P<target>{_TARGET.pattern})|(?P<entity>{_ENTITY.pattern})", re.DOTALL)
_OTHER = re.compile(r"[\W_]+")


def _plain(s: str) -> str:
    """Letters and digits as compared: compatibility forms, no invisible characters, no case."""
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKC", s) if unicodedata.category(c) not in ("Cf", "Mn"))
    return _OTHER.sub("", s.casefold())


def stream(text: str) -> str:
    """The text's letters and digits as a reader sees them, without anything between them."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _TARGET.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    return _plain(text)


def stream_offsets(text: str) -> tuple[list[int], list[bool]]:
    """For each character of `stream`: its place in the text, and whether a word begins there."""
    at: list[int] = []
    begins: list[bool] = []
    apart = True

    def visible(s: str, places: Iterator[int]) -> None:
        nonlocal apart
        for ch, k in zip(s, places, strict=False):
            if ch.isascii():
                got = ch.casefold() if ch.isalnum() else ""
            elif unicodedata.category(ch) in ("Cf", "Mn"):
                continue
            else:
                got = _plain(ch)
            if not got:
                apart = True
            for _ in got:
                at.append(k)
                begins.append(apart)
                apart = False

    end = 0
    for m in _MARKUP.finditer(text):
        visible(text[end : m.start()], iter(range(end, m.start())))
        end = m.end()
        if m["entity"]:
            s = html.unescape(m[0])
            visible(s, iter([m.start()] * len(s)))
        else:
            apart = True
    visible(text[end:], iter(range(end, len(text))))
    return at, begins


def item_words(text: str) -> list[str]:
    """The streams of an item's words, which stand between blanks; those without letters or digits are no words."""
    return [s for s in (stream(w) for w in _TARGET.sub(" ", _TAG.sub(" ", text)).split()) if s]


class Passages:
    """An automaton that finds where a text holds `words` consecutive words of an item.

    Its keys stand at every (words + 1) / 2 -th word of an item, as any passage of `words` words holds the whole
    stretch of one of them. What surrounds a key that was found is compared with its item, letter by letter.
    """

    def __init__(self, items: list[tuple[int, str]], words: int):
        import ahocorasick

        self.words, step = words, (words + 1) // 2
        self.idents: list[int] = []
        self.streams: list[str] = []
        self.starts: list[array] = []  # of each word in the stream, and the stream's end
        auto = ahocorasick.Automaton()
        for ident, text in items:
            found = item_words(text)
            if len(found) < words:
                continue
            upto = array("l", [0, *accumulate(map(len, found))])
            n = len(self.idents)
            self.idents.append(ident)
            self.streams.append("".join(found))
            self.starts.append(upto)
            for w in range(0, len(found) - step + 1, step):
                key = self.streams[n][upto[w] : min(upto[w + step], upto[w] + KEY_CHARS)]
                known = auto.get(key, None)
                if known is None:
                    auto.add_word(key, known := (len(key), array("l")))
                known[1].extend((n, w))
        auto.make_automaton()
        self.auto = auto if self.idents else None

    def runs(self, plain: str) -> list[tuple[int, int, int, int]]:
        """(item, text begin less item begin, first and end letter of the text that agree with the item around a key).

        Only runs that hold `words` words of the item; an item repeated in the text is a run of its own.
        """
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for end, (size, places) in self.auto.iter(plain):
            at = end - size + 1
            for n, w in zip(places[::2], places[1::2], strict=True):
                known = found.setdefault((n, at - self.starts[n][w]), [])
                if not known or known[-1][1] <= at:
                    known.append(self._extent(plain, self.streams[n], at, self.starts[n][w]))
        return [(n, shift, a, b) for (n, shift), of in found.items() for a, b in of if self._words_within(n, a - shift, b - shift)[1] >= self.words]

    @staticmethod
    def _extent(plain: str, item: str, at: int, i: int) -> tuple[int, int]:
        """How far the text agrees with the item around a place where they do."""
        a = 0
        while a < i and a < at and plain[at - a - 1] == item[i - a - 1]:
            a += 1
        b, most = 0, min(len(plain) - at, len(item) - i)
        while b < most:  # whole slices first
            step = min(64, most - b)
            if plain[at + b : at + b + step] == item[i + b : i + b + step]:
                b += step
            else:
                b += next(k for k in range(step) if plain[at + b + k] != item[i + b + k])
                break
        return at - a, at + b

    def _words_within(self, n: int, a: int, b: int) -> tuple[int, int]:
        """The first whole word of item n from letter a on, and how many end by letter b."""
        first = bisect_left(self.starts[n], a)
        return first, bisect_right(self.starts[n], b) - 1 - first

    def find(self, text: str) -> dict[int, list[list[int]]]:
        """Item -> the spans of the text, as [start, end, passages], that hold passages of it; overlapping ones joined."""
        plain = stream(text)
        runs = self.runs(plain)
        if not runs:
            return {}
        at, begins = stream_offsets(text)
        if len(at) != len(plain):  # a compatibility form across characters: take the text as it is normalised
            at, begins = stream_offsets(unicodedata.normalize("NFKC", text))
        begins.append(True)
        hits: dict[int, set[tuple[int, int]]] = {}
        for n, shift, a, b in runs:
            first, count = self._words_within(n, a - shift, b - shift)
            limits = [self.starts[n][w] + shift for w in range(first, first + count + 1)]
            for p, q in zip(limits, limits[self.words :], strict=False):
                if q <= len(at) and begins[p] and begins[q]:
                    hits.setdefault(self.idents[n], set()).add((p, q - 1))
        found: dict[int, list[list[int]]] = {}
        for ident, of in hits.items():
            spans = found[ident] = []
            for a, e in sorted(of):
                if spans and at[a] < spans[-1][1]:
                    spans[-1] = [spans[-1][0], max(spans[-1][1], at[e] + 1), spans[-1][2] + 1]
                else:
                    spans.append([at[a], at[e] + 1, 1])
        return found


_BUILT: dict[str, Passages] = {}


def _passages(key: str, items: list[tuple[int, str]], words: int) -> Passages:
    """The automaton of a block of items, built once in each Python worker, which holds one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Passages(items, words)
    return _BUILT[key]


def _scan(shared, key: str, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = None
        for b in batches:
            sought = sought or _passages(key, shared.value, words)
            if sought.auto is None:
                return
            docs: list[int] = []
            rows: list[tuple] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                if text:
                    for item, spans in sought.find(text).items():
                        for s in spans:
                            docs.append(k)
                            rows.append((item, *s))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(docs, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=["id", "item_id", "span_start", "span_end", "n_passages"]
            )

    return run


def leaked_spans(docs: DataFrame, ident: Column, text: Column, items: DataFrame, item: Column, item_texts: list[Column], *, words: int = PASSAGE_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where texts hold at least `words` consecutive words of an item: (id, item_id, span_start, span_end, n_passages).

    span_start and span_end are character offsets into the text as stored. Words are compared as a reader sees
    them: case, punctuation, line breaks, markup, link targets, quote and comment signs, entities, compatibility
    forms and invisible characters don't count; a passage must begin and end at word limits of the text.

    The items (questions and answers, the columns `item_texts`) form one automaton, and each text is scanned once
    by it; offsets are worked out only for texts that agree with `words` words of an item. Texts aren't shuffled
    unless they come in fewer partitions than there are cores. The items travel to the executors: up to
    `block_chars` characters of them (whose automaton has at most as many nodes) in one scan, more of them in
    blocks of about that size with a scan each.

    Null and empty texts, and items shorter than `words` words, give no row. Repeated rows of a text give rows
    each. Other columns aren't read, whatever their names.
    """
    if words < 1:
        raise ValueError("words must be at least 1")
    spark = docs.sparkSession
    asked = items.select(item.cast("long").alias("item_id"), *[t.cast("string").alias(f"t{i}") for i, t in enumerate(item_texts)])
    asked = asked.where("item_id is not null")
    sizes = asked.select(F.sum(sum((F.length(F.coalesce(F.col(c), F.lit(""))) for c in asked.columns[1:]), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-sizes // block_chars))
    src = spread(docs.select(ident.cast("long").alias("id"), text.alias("text")))
    out = None
    for k in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r[0], t) for r in part for t in r[1:] if t])
        got = src.mapInArrow(_scan(shared, uuid.uuid4().hex, words), "id long, item_id long, span_start long, span_end long, n_passages long")
        out = got if out is None else out.unionByName(got)
    return out


def leaks(docs: DataFrame, ident: Column, text: Column, items: DataFrame, item: Column, item_texts: list[Column], **options) -> DataFrame:
    """Each text with each item that it holds a passage of, once: (id, item_id); see `leaked_spans`."""
    return leaked_spans(docs, ident, text, items, item, item_texts, **options).select("id", "item_id").distinct()
