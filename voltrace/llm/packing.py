"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces are placed longest first, each into the open
bin with the least room that still holds it (best fit). If none does, a bin is opened,
and its size is the one of least cost per token: for each permitted length the
pieces that are still to come are laid into it on trial, and the cost of the length is
divided by the tokens it would hold. At the end every bin is downsized to the
smallest permitted length that holds its contents.

Lengths are token ids of the given vocabulary, with an end id behind each document. Documents longer
than the longest length are cut into pieces of that length; the last piece is
packed like any other. Rows are dealt by a hash of their number in the table, whatever their id, into groups of about
group_rows rows and group_bytes of text; each group is packed by itself in one task, so memory is bounded (by one group
and the longest text) and groups can be redone alone. Per group at most one bin of each length stays badly filled.

Defined results: null or empty texts are their end id alone and are
packed too; an empty table gives an empty result; repeated rows are packed as rows of their own; of pieces of
equal length the one that comes first in the table is placed first, of bins with equal room the one used last is filled;
ids may be of any type and keep their column name; other columns are not carried (join them by id).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .token_output import AT_ONCE, END_ID, coder

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length, in tokens.
OVERHEAD = 32


class _Left:
    """Lengths still to be packed, as sorted distinct lengths with counts."""

    def __init__(self, lengths: Sequence[int]):
        values, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
        self.keys, self.count = values.tolist(), dict(zip(values.tolist(), counts.tolist(), strict=True))

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            self.keys.pop(bisect_left(self.keys, n))

    def fill(self, room: int) -> int:
        """Tokens that laying the longest fitting pieces into room, one after the other, would use."""
        used, end = 0, len(self.keys)
        while room > 0:
            end = bisect_right(self.keys, room, 0, end)
            if not end:
                break
            n = self.keys[end - 1]
            k = min(room // n, self.count[n])
            used, room, end = used + k * n, room - k * n, end - 1
        return used


def pack(lengths: Sequence[int], capacities: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the final length of every bin; each piece must fit the longest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left = _Left(lengths)
    bin_of, offset, used, room = [0] * len(lengths), [0] * len(lengths), [], []
    rooms: list[int] = []  # distinct rooms of open bins, sorted
    open_: dict[int, list[int]] = {}

    def put(b: int) -> None:
        if room[b] > 0:
            if room[b] not in open_:
                insort(rooms, room[b])
                open_[room[b]] = []
            open_[room[b]].append(b)

    for i in order:
        n = lengths[i]
        left.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):
            b = open_[rooms[at]].pop()
            if not open_[rooms[at]]:
                del open_[rooms[at]]
                rooms.pop(at)
        else:
            fits = capacities[bisect_left(capacities, n) :]
            size = min(fits, key=lambda c: ((c + overhead) / (n + left.fill(c - n)), c))
            b = len(used)
            used.append(0)
            room.append(size)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        room[b] -= n
        put(b)
    return bin_of, offset, [capacities[bisect_left(capacities, u)] for u in used]


def _tokenized(tokenizer_path: str, end_id: int, kind: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = coder(tokenizer_path)
        for f in frames:
            texts, at = f["_text"].tolist(), 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < AT_ONCE):
                    size += len(texts[stop] or b"")
                    stop += 1
                ids, lengths = tok.encode(texts[at:stop], end_id)
                data, ends = memoryview(ids.astype(kind).tobytes()), np.cumsum(lengths) * int(kind[-1])
                part = f.iloc[at:stop].drop(columns="_text")
                part["_ids"] = [bytes(data[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield part
                at = stop

    return run


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    capacities: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    group_rows: int = 8192,
    group_bytes: int = 1 << 25,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id_col, piece, start, n_tokens, bin_group, bin, bin_offset, bin_length and ids, its token ids as little-endian unsigned numbers (of 2 bytes, or of 4 if the vocabulary is larger); see sequences()."""
    from tokenizers import Tokenizer

    small_batches(docs.sparkSession)
    kind = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    capacities, longest = tuple(sorted(capacities)), max(capacities)
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    groups = max(1, -(-size["rows"] // group_rows), -(-(size["bytes"] or 0) // group_bytes))
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    rows = rows.mapInPandas(_tokenized(tokenizer_path, end_id, kind), T.StructType([*rows.schema.fields[:2], T.StructField("_ids", T.BinaryType())]))
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row")
        n = frame["_ids"].map(len).to_numpy(np.int64) // int(kind[-1])
        parts = -(-n // longest)
        row = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = piece * longest
        length = np.minimum(n[row] - start, longest)
        bins, offsets, sizes = pack(length.tolist(), capacities, overhead)
        ids = frame["_ids"].tolist()
        return pd.DataFrame({
            id_col: frame["_id"].iloc[row].to_numpy(),
            "piece": piece.astype(np.int32),
            "start": start,
            "n_tokens": length,
            "bin_group": np.full(len(row), key[0], np.int64),
            "bin": np.asarray(bins, np.int32),
            "bin_offset": np.asarray(offsets, np.int64),
            "bin_length": np.asarray(sizes, np.int32)[np.asarray(bins, np.int64)] if len(row) else np.zeros(0, np.int32),
            "ids": [ids[r][a : a + k] for r, a, k in zip(row.tolist(), (start * int(kind[-1])).tolist(), (length * int(kind[-1])).tolist(), strict=True)],
        })

    made = T._parse_datatype_string("piece int, start long, n_tokens long, bin_group long, bin int, bin_offset long, bin_length int, ids binary")
    return rows.groupBy("bin_group").applyInPandas(pack_group, T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), *made.fields]))


def sequences(pieces: DataFrame, id_col: str = "doc_id", pad_id: int = 0) -> DataFrame:
    """The packed training sequences: bin_group, bin, ids filled up with pad_id to the length of the bin, n_tokens of them real, and the documents and first places of the pieces in it."""
    part = F.struct("bin_offset", F.col(id_col).alias("doc"), "ids")
    width = F.max(F.octet_length("ids") / F.col("n_tokens")).cast("int").alias("width")
    bins = pieces.groupBy("bin_group", "bin", "bin_length").agg(F.sum("n_tokens").alias("n_tokens"), width, F.sort_array(F.collect_list(part)).alias("parts"))  # a bin's pieces, bounded by its length
    pad = F.substring(F.unhex(F.lit(pad_id.to_bytes(4, "little").hex())), F.lit(1), F.col("width"))
    fill = F.unhex(F.repeat(F.hex(pad), (F.col("bin_length") - F.col("n_tokens")).cast("int")))
    ids = F.concat(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])), fill)
    return bins.select("bin_group", "bin", ids.alias("ids"), "n_tokens", F.col("parts.doc").alias("docs"), F.col("parts.bin_offset").alias("offsets"))
