"""Filling containers of fixed capacity with texts: best-two-fit packing on token counts."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.session import materialize, spread

#: Folder of the public tokenizers' files, and the vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's text is cut before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed by one task at once. A shard wastes at most about one container.
SHARD_ITEMS = 50_000
#: Capacities that one call may ask for.
MOST_CAPACITIES = 1000
#: Characters given to the tokenizer at once where a text can be cut without changing its tokens; it takes _MOST at most.
_STRETCH, _MOST = 200_000, 500_000
#: Where no token spans: after a letter or digit and before white space, as PATTERN has it.
_APART = re.compile(r"(?<=[^\W_])(?=[ \n])")


@cache
def _encoder(key: str, ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _stretches(text: str) -> Iterator[str]:
    """A very long text in pieces of about _STRETCH characters that give the same tokens as the whole."""
    at = 0
    while len(text) - at > _STRETCH:
        m = _APART.search(text, at + _STRETCH)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _count(enc, text: str) -> int:
    if len(text) <= _MOST:
        return len(enc.encode_ordinary(text))
    import regex

    # One run without a place to cut, too long for the tokenizer's own pattern search: cut by the same pattern here.
    return sum(len(enc._core_bpe.encode_single_piece(m[0].encode())) for m in regex.finditer(PATTERN, text))


def count_tokens(enc, texts: list[str | None]) -> list[int]:
    """Tokens of each text; 0 for null and empty ones. Exact whatever the length."""
    return [sum(_count(enc, s) for s in _stretches(t)) if t else 0 for t in texts]


def encoder(tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer of a vocabulary file."""
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        return _encoder(vocabulary, f.read())


def _counts(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, shared.value)
        for b in batches:
            n = count_tokens(enc, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    return run


def token_counts(df: DataFrame, ident: Column, text: Column, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of each row; whole texts, whatever their length.

    The vocabulary (about 1 MB) is read by the driver only and travels to the executors.
    """
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    src = spread(df.select(ident.cast("long").alias("id"), text.alias("text")))
    return src.mapInArrow(_counts(vocabulary, shared), "id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (sizes 1 to capacity), and the number of containers.

    A container is filled greedily, with the largest unpacked item that fits, until none does. Then its smallest
    item may give way to two unpacked items that together are larger and still fit the gap that it leaves: of
    all such pairs the one that fits most tightly. The item given back is packed later.
    """
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable")[::-1]:
        stacks.setdefault(int(sizes[i]), []).append(int(i))
    have = 0  # bit s: an item of size s is unpacked
    for s in stacks:
        have |= 1 << s
    where = np.empty(len(sizes), "int64")
    bins = 0

    def take(s: int) -> int:
        nonlocal have
        i = stacks[s].pop()
        if not stacks[s]:
            have ^= 1 << s
        return i

    while have:
        room, inside = capacity, []
        while room and (fits := have & ((2 << room) - 1)):
            s = fits.bit_length() - 1
            inside.append((s, take(s)))
            room -= s
        if room and len(inside) > 1 and have:
            small = inside[-1][0]  # taken in falling order
            gap, best, pair = room + small, small, None
            a = (have & ((1 << gap) - 1)).bit_length() - 1
            while a > 0 and 2 * a > best:
                limit = min(a, gap - a)
                if limit == a and len(stacks[a]) < 2:
                    limit = a - 1
                b = (have & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 else 0
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap:
                        break
                a = (have & ((1 << a) - 1)).bit_length() - 1
            if pair:
                s, i = inside.pop()
                for p in pair:
                    inside.append((p, take(p)))
                stacks[s].append(i)
                have |= 1 << s
        for _, i in inside:
            where[i] = bins
        bins += 1
    return where, bins


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    capacity, room, shard = (k.as_py() for k in key)
    table = table.sort_by([("id", "ascending"), ("n_tokens", "ascending"), ("copy", "ascending")])  # the same packing whatever the order of arrival
    size = table["n_tokens"].to_numpy()
    full, left = size // room, size % room
    ends = np.flatnonzero((left > 0) | (size == 0))  # a row each for the rests, and for texts without tokens
    where = np.full(len(size), -1)
    some = np.flatnonzero(left)
    where[some], bins = best_two_fit(left[some], room)
    rows = np.r_[np.repeat(np.arange(len(size)), full), ends]
    piece = np.r_[np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[ends]]
    box = np.r_[bins + np.arange(full.sum()), where[ends]]
    n = np.r_[np.full(full.sum(), room), left[ends]]
    return pa.table(
        {
            "capacity_id": pa.array(np.full(len(rows), capacity), pa.int32()), "container_id": pa.array((shard << 32) + box, mask=box < 0),
            "id": table["id"].take(pa.array(rows)), "piece": pa.array(piece), "first_token": pa.array(piece * room), "n_tokens": pa.array(n),
        }
    )


def pack(counts: DataFrame, capacities: DataFrame, *, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Texts to containers of each capacity: (capacity_id, container_id, id, piece, first_token, n_tokens).

    `counts` (id, n_tokens), `capacities` (capacity_id, max_tokens). A text is cut only if it exceeds the
    capacity, into full containers and a rest (piece 0, 1, ... from first_token on). The items of a capacity
    are spread evenly over shards of about `shard_items`, by a hash of id, size and the how-manieth such row it is;
    each shard is packed by itself by `best_two_fit`, and a container holds items of one shard. Full pieces fill a
    container each. Container ids are unique within a capacity, and depend on the rows only, not on their splits.

    Texts without tokens (null, empty) need no room: one row with piece 0 and a null container. Repeated rows
    are items of their own. Capacities that are null or below 1 are errors; an empty table on either side gives
    an empty result.
    """
    if not 1 <= shard_items <= 1 << 19:
        raise ValueError("shard_items must be between 1 and 2^19")
    n = counts.count()
    asked = capacities.select(F.col("capacity_id").cast("int"), F.col("max_tokens").cast("long")).limit(MOST_CAPACITIES + 1).collect()
    if len(asked) > MOST_CAPACITIES:
        raise ValueError(f"at most {MOST_CAPACITIES} capacities at once")
    if any(m is None or m < 1 for _, m in asked):
        raise ValueError("every capacity must be at least 1")
    each_kind = "array<struct<capacity_id:int,max_tokens:bigint>>"
    caps = F.array(*[F.struct(F.lit(c).cast("int").alias("capacity_id"), F.lit(m).cast("long").alias("max_tokens")) for c, m in asked]).cast(each_kind)
    shards = max(1, -(-n // shard_items))
    # Repeated rows meet as one row and its number first, so an id that holds many rows is spread like any other.
    rows = counts.groupBy("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))
    items = rows.select("id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("*", F.pmod(F.xxhash64("id", "n_tokens", "copy"), F.lit(shards)).cast("long").alias("shard"))
    # Each text once per capacity: that is the result's size.
    each = items.select("id", "n_tokens", "copy", "shard", F.explode(caps).alias("c")).select("c.capacity_id", "c.max_tokens", "shard", "id", "n_tokens", "copy")
    return each.groupBy("capacity_id", "max_tokens", "shard").applyInArrow(_pack, "capacity_id int, container_id long, id long, piece long, first_token long, n_tokens long")


def pack_texts(df: DataFrame, ident: Column, text: Column, capacities: DataFrame, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, **options) -> DataFrame:
    """`pack` of the `token_counts` of texts; the counts are written once, to the shared folder."""
    counts = token_counts(df, ident, text, tokenizers=tokenizers, vocabulary=vocabulary)
    return pack(materialize(counts, "token-counts"), capacities, **options)
