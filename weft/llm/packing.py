"""Texts packed into containers of fixed capacity.

Shortest-pack-first on the histogram of lengths: lengths are placed longest first, each time into the packs that are
shortest so far and still have room, and what is kept is how many packs have which pattern of lengths. That needs the
histogram only, which the capacity bounds. The patterns are then joined back to the texts by their rank among those of
their length. Ranks come from counts per bucket, so a length that a third of all texts share is ranked in parts.
"""

from __future__ import annotations

import base64
import importlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.session import cut, spread

#: Where the public tokenizer's ranks lie, unless a caller gives another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text before merging: fixed value, the published pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from this length on go past the pattern, whose look-ahead runs out of stack in them. The pieces are
#: those of the pattern: all but the last character of a run that something follows.
LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{100000,}")
#: Buckets in which texts of one length are ranked.
BUCKETS = 64

_LOADED: dict = {}


def _encoding(path: str):
    if path not in _LOADED:
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(enc, text: str) -> int:
    """The number of tokens of a whole text."""
    n, at = 0, 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the number of tokens of the whole ``text``, 0 for null and blank texts.

    The strings of special tokens are ordinary text.
    """

    @F.pandas_udf("bigint")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for s in texts:
            yield s.map(lambda t: 0 if t is None or not t.strip() else token_count(enc, t)).astype("int64")

    return docs.withColumn(out, F.coalesce(tokens(F.col(text)), F.lit(0).cast("bigint")))


def pieces(sized: DataFrame, capacity: int, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``doc_id, piece_no, start, n``: each text whole, or cut into pieces of ``capacity`` if it is longer.

    Texts without tokens give none; ids are taken to be unique.
    """
    known = sized.select(F.col(id_col).alias("doc_id"), F.col(size).cast("bigint").alias("size")).where("size > 0")
    cuts = F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / capacity)), lambda i: F.struct(i.alias("piece_no"), (i * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - i * capacity).alias("n")))
    return known.select("doc_id", F.inline(cuts))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """``(count, pattern)`` of packs; a pattern is ``((length, times), ...)``.

    ``histogram`` gives the number of items per length, of 1 to ``capacity``. Lengths are placed longest first. The
    packs that take an item are those with the most room, all packs of one pattern at once.
    """
    open_packs: dict[int, list[list]] = {}  # room -> [count, pattern]
    done: list[tuple[int, tuple]] = []

    def keep(count: int, room: int, pattern: tuple) -> None:
        if room == 0:
            done.append((count, pattern))
        else:
            open_packs.setdefault(room, []).append([count, pattern])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room < length:
                # new packs: as many of this length as fit, so that equal items stay one pattern
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    keep(full, capacity - per * length, ((length, per),))
                if rest:
                    keep(1, capacity - rest * length, ((length, rest),))
                break
            count, pattern = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            took = min(count, left)
            if count > took:
                keep(count - took, room, pattern)
            last, times = pattern[-1]
            grown = (*pattern[:-1], (length, times + 1)) if last == length else (*pattern, (length, 1))
            keep(took, room - length, grown)
            left -= took
    return done + [(c, p) for packs in open_packs.values() for c, p in packs]


def ranked(items: DataFrame, by: list[str], unique: list[str], rank: str) -> DataFrame:
    """``items`` with a dense number from 0 within ``by``, in buckets of a hash of ``unique``."""
    bucketed = items.withColumn("__b", F.pmod(F.xxhash64(*unique), F.lit(BUCKETS)))
    counts = bucketed.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = bucketed.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*unique)) - 1)
    return local.join(offsets, [*by, "__b"]).withColumn(rank, F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def pack(sized: DataFrame, capacity: int, name: str, id_col: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """``pack_name, doc_id, piece_no, start_token, n_tokens, pack_id`` of every piece of every text with tokens.

    ``pack_id`` counts from 0. Whole pieces of ``capacity`` are packs of their own.
    """
    spark = sized.sparkSession
    items = pieces(sized, capacity, id_col, size)
    numbered = ranked(items, ["n"], ["doc_id", "piece_no"], "rank")
    histogram = {r["n"]: r["c"] for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``capacity`` rows
    slots, first, used = [], 0, dict.fromkeys(histogram, 0)
    for count, pattern in shortest_pack_first(histogram, capacity):
        for length, times in pattern:
            # ``count`` packs from ``first`` on take ``times`` items each, ranks from ``used`` on
            slots.append((length, used[length], used[length] + count * times, times, first))
            used[length] += count * times
        first += count
    plan = spark.createDataFrame(slots, "n bigint, lo bigint, hi bigint, times bigint, first bigint")
    # the slots of a length are disjoint ranges of ranks; a bucket of ranks turns the range join into an equality join
    width = F.lit(4096)
    plan = plan.withColumn("__q", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    met = numbered.withColumn("__q", F.floor(F.col("rank") / width)).join(plan, ["n", "__q"]).where("rank >= lo and rank < hi")
    return met.select(F.lit(name).alias("pack_name"), "doc_id", "piece_no", F.col("start").alias("start_token"), F.col("n").alias("n_tokens"), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("times"))).alias("pack_id"))


def pack_all(docs: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack`` for each row of ``sizes`` (``pack_name, capacity_tokens``), a small table of settings.

    Rows without a positive capacity and texts without an id are left out. Texts that come twice are packed twice.
    """
    sized = cut(count_tokens(spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))), "t", "n_tokens", tokenizer).select("doc_id", "n_tokens"))
    wanted = sizes.where("capacity_tokens > 0").select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").collect()
    out = docs.sparkSession.createDataFrame([], f"pack_name string, doc_id {dict(sized.dtypes)['doc_id']}, piece_no bigint, start_token bigint, n_tokens bigint, pack_id bigint")
    for r in wanted:
        out = out.unionByName(pack(sized, r["capacity_tokens"], r["pack_name"]))
    return out


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pack size: packs, pieces, tokens, the share of capacity that is filled, and the emptiest and fullest pack."""
    packs = packed.groupBy("pack_name", "pack_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    total = packs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_packs"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.min("tokens").alias("least_tokens"), F.max("tokens").alias("most_tokens"))
    return total.join(sizes.select("pack_name", "capacity_tokens").distinct(), "pack_name").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6))
