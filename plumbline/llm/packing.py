"""Best-fit packing of tokenised documents, certified by lower bounds and mended by exchanges between partitions.

A document is its tokens and an end token. One longer than ``LENGTH`` is cut so that only its first piece can be
shorter; pieces of full length are sequences of their own. The rest are dealt to groups of about ``GROUP`` pieces and
packed best-fit decreasing. Dual feasible functions give each group a lower bound of its sequences: a group that meets
the bound is certified and keeps all but its emptiest open sequence; a group with a gap keeps its full sequences only.
What is not kept is exchanged, that is dealt anew to fewer groups and packed again, until one group is left.

Defined cases: null and empty texts are one end token; rows that repeat a doc_id are packed each for itself; a null
doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, landed, map_arrow

LENGTH = 1024
END = 2
#: The vocabulary's only special token, which stands for one id wherever a text holds it.
SPECIAL = "<|endoftext|>"
GROUP = 2000
#: Rounds in which a group with a gap gives away all its open sequences; later it gives the emptiest only.
OPEN_ROUNDS = 2
#: Distinct words that a Python worker remembers the ids of.
REMEMBERED = 400_000

_encoders: dict[str, "_Ids"] = {}


class _Ids(dict):
    """The ids of a piece of text, as little-endian 32-bit bytes, found once for each piece."""

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = coding.encode_ordinary
        self.special = np.array([len(ranks)], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece), "<u4").tobytes()
        self[piece] = ids
        return ids


def token_bytes(text: str, ids: _Ids) -> bytes:
    """The ids of the text; ``SPECIAL`` has the id after the last one of the vocabulary, and ends what is before it."""
    return ids.special.join(_plain_bytes(part, ids) for part in text.split(SPECIAL))


def _plain_bytes(text: str, ids: _Ids) -> bytes:
    """The ids of a text without ``SPECIAL``. It is split before single spaces: there the vocabulary's pattern always begins a new match,
    unless white space meets white space, in which case the parts stay together."""
    parts = text.split(" ")
    pieces = [parts[0], *(" " + p for p in parts[1:])] if len(parts) > 1 else parts
    if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        joined: list[str] = []
        for i, p in enumerate(pieces):
            before, own = parts[i - 1] if i else "", parts[i]
            if joined and (not own or own[0].isspace() or not before or before[-1].isspace()):
                joined[-1] += p
            else:
                joined.append(p)
        pieces = joined
    return b"".join(map(ids.__getitem__, pieces))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, length: int, tokenizer: str | None) -> DataFrame:
    """docs (doc_id, text): one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Ids(tokenizer)
        ids = _encoders[tokenizer]
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if len(ids) > REMEMBERED:
                    ids.clear()
                data = token_bytes(text.as_py() or "", ids) + end
                count = len(data) // 4
                start, piece = 0, 0
                while start < count:
                    stop = start + ((count - start - 1) % length + 1 if not piece else length)
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                    start, piece = stop, piece + 1
            columns = zip(*rows) if rows else ([],) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs, cut, _PIECES)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """The best of two families of dual feasible functions: sequences that no packing can do without."""
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=length + 1)[: length + 1].astype(np.int64)
    value = np.arange(length + 1)
    best = -(-int(counts @ value) // length)
    # sizes above length - e count as whole, those below e as nothing
    upto = np.cumsum(counts)
    weight = np.cumsum(counts * value)
    e = np.arange(1, length // 2 + 1)
    large = upto[length] - upto[length - e]
    middle = weight[length - e] - weight[e - 1]
    best = max(best, int((large + -(-middle // length)).max()))
    # x / length is rounded down to k-ths, unless it is one
    for k in range(1, 51):
        scaled = value * (k + 1)
        exact = scaled % length == 0
        numerator = np.where(exact, value * k, scaled // length * length)  # in units of 1 / (k * length)
        best = max(best, -(-int(counts @ numerator) // (k * length)))
    return best


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: sequence and offset of each piece, and the fill of each sequence."""
    place = np.zeros(len(sizes), np.int64)
    offset = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: there is a sequence with room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, bin_ = length, len(fill)
            fill.append(0)
        place[i], offset[i] = bin_, fill[bin_]
        fill[bin_] += size
        left = room - size
        if left:
            open_by_room[left].append(bin_)
            rooms |= 1 << left
    return place, offset, np.array(fill, np.int64)


def pack(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, group: int = GROUP,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    ``tokenizer`` names the rank file of the vocabulary; by default the public byte-level one with 50,257 ids.
    """
    given = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    pieces = landed(tokenised(given, length, tokenizer).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == length).select(
        *pieces.columns, (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    pool, results, turn = pieces.filter(F.col("length") < length), [whole], 0
    while True:
        groups = -(-pool.count() // group)
        if not groups:
            break
        dealt = pool.withColumn("group", F.pmod(F.xxhash64("pid", F.lit(turn)), F.lit(groups)))
        packed = landed(dealt.groupBy("group").applyInPandas(
            _packer(turn, groups == 1, length), pieces.schema.simpleString()[7:-1].replace(":", " ")
            + ", sequence_id bigint, offset bigint, certified boolean, kept boolean"), "packed")
        results.append(packed.filter("kept").drop("kept"))
        if groups == 1:
            break
        pool, turn = packed.filter("not kept").select(*pieces.columns), turn + 1
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.drop("pid")


def _packer(turn: int, last: bool, length: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["group"].iloc[0])
        rows = rows.sort_values("pid", ignore_index=True)
        sizes = rows["length"].to_numpy()
        place, offset, fill = best_fit(sizes, length)
        certified = len(fill) == lower_bound(sizes, length)
        keep = fill == length
        if last:
            keep[:] = True
        elif certified or turn >= OPEN_ROUNDS:
            keep[:] = True
            emptiest = int(np.argmin(fill))
            keep[emptiest] = fill[emptiest] == length
        return rows.drop(columns="group").assign(
            sequence_id=(np.int64(turn) << 56) + (np.int64(number) << 20) + place, offset=offset, certified=certified, kept=keep[place])

    return work
