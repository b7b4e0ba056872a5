"""Token ids of whole texts in Simple-8b files, in ascending document order, and reading them back.

Texts are range-partitioned and sorted by id, tokenized, and gathered into files of
about segment_ids ids; a document is never split. A file is one self-contained image (see simple8b), kept as one
row of a Parquet table because Spark's writers reach every store: its columns name the
place of the file in the order (part, seq), so the files are the table's rows.

Tokenizing works by chunks between ASCII spaces: the vocabulary drops white space and
never joins across it, and no ASCII space composes with a mark, so a chunk's ids do not depend on its neighbours, and frequent
chunks are looked up. Only the order's totals per part (one row per partition) are summed in one place.

Defined results: ids are whole numbers, other kinds are refused; null and empty texts give the end id alone; rows repeated with the
same id are documents of their own, side by side, in the order of a hash of their texts (so one id may fill several partitions); rows without an id come first, as id null, in the order; an empty
table gives an empty result; other columns are not written.
"""

from __future__ import annotations

import gc
import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, whole_ids
from .simple8b import read_image, write_image

END_ID = 1
SEGMENT_IDS = 1 << 20
#: Bounds of a worker's table of chunks; beyond them the half that is met most often is kept.
CACHE_CHUNKS, CACHE_IDS = 650_000, 5_000_000
#: Bytes of text that a worker encodes at once.
AT_ONCE = 1_500_000
#: ASCII marks that may trail a word.
MARKS = b".,;:!?|#*$%&\"()"
#: A control character that is no white space.
BETWEEN = b"\x1f"
NO_ID = -(1 << 63)

_CODERS: dict[str, ChunkCoder] = {}


class _Numbers(dict):
    """Numbers chunks in the order in which they are first met."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


def _ends_in_letter(core: str) -> bool:
    """The last character is, and stays when composed and lowered, a letter of Latin, Greek or Cyrillic (on which all versions of Unicode agree)."""
    return "\u00c0" <= core[-1] < "\u0500" and unicodedata.normalize("NFC", core).lower()[-1].isalpha() and core[-1].isalpha()


class ChunkCoder:
    """Encodes texts chunk by chunk with a table of the chunks met so far.

    ASCII letters are lowered first, as the vocabulary does anyway, but only in texts without combining
    marks: the vocabulary composes letters and marks before it lowers them, and some pairs compose in one case only. A run of
    punctuation behind a letter or digit is coded by itself, since the vocabulary parts words there; so most
    new chunks are known words with other punctuation.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.between,) = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.length, self.start, self.met = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.filled = np.zeros(4096, np.uint32), 0

    def _shrink(self) -> None:
        """Forget the chunks that are met seldom."""
        chunks, n = list(self.number), len(self.number)
        kept = np.sort(np.argsort(-self.met[:n], kind="stable")[: CACHE_CHUNKS // 2])
        at, length = self._places(kept)
        ids, met = self.ids[at], self.met[kept] // 2
        if len(ids) > CACHE_IDS * 3 // 4:
            self.clear()
            return
        self.number = _Numbers()
        self.number.update(zip([chunks[k] for k in kept.tolist()], range(len(kept)), strict=True))
        self.filled = 0
        self.met[:] = 0
        self.met[: len(kept)] = met
        self._store(np.arange(len(kept)), length, ids)

    def _learn(self) -> None:
        """Code the new chunks; the parts of one that is parted are chunks too, and so are looked up themselves."""
        number, new = self.number, self.number.new
        first, whole, parted = len(number) - len(new), [], []
        for k, chunk in enumerate(new):  # grows meanwhile
            core = chunk.rstrip(MARKS)
            if core and len(core) < len(chunk) and (core[-1:].isalnum() if core[-1] < 128 else _ends_in_letter(core.decode("utf-8", "surrogatepass"))):
                parted.append((first + k, number[core], number[chunk[len(core) :]]))
            else:
                whole.append(k)
        number.new = []
        while len(number) > len(self.length):
            self.length, self.start, self.met = (np.concatenate([x, x * 0]) for x in (self.length, self.start, self.met))
        coded = self._encode([new[k] for k in whole])
        self._store(np.array(whole, np.int64) + first, np.fromiter(map(len, coded), np.int64, len(coded)) // 4, np.frombuffer(b"".join(coded), np.uint32))
        if parted:
            rows = np.array(parted, np.int64)
            at, length = self._places(rows[:, 1:].ravel())
            self._store(rows[:, 0], length.reshape(-1, 2).sum(axis=1), self.ids[at])

    def _store(self, rows: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids * 0])
        self.length[rows], self.start[rows] = length, self.filled + np.cumsum(length) - length
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the ids of some chunks are, one chunk after the other; ids per chunk)."""
        length = self.length[rows]
        at = np.repeat(self.start[rows] - (np.cumsum(length) - length), length)
        return at + np.arange(len(at)), length

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        """Many chunks in one call, with a mark between them that the vocabulary keeps apart; chunks that hold the mark or a special token's name go alone."""
        alone = {k for k, c in enumerate(chunks) if BETWEEN in c or b"<|" in c}
        rest = [k for k in range(len(chunks)) if k not in alone]
        groups = [[k] for k in sorted(alone)] + [rest[i : i + 100] for i in range(0, len(rest), 100)]
        texts = [(b" " + BETWEEN + b" ").join(chunks[k] for k in g).decode("utf-8", "surrogatepass") for g in groups]
        out = [b""] * len(chunks)
        for g, coded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            data = array("I", coded.ids).tobytes()
            ends = [*([] if len(g) == 1 else [4 * i for i, x in enumerate(coded.ids) if x == self.between]), len(data)]
            begin = 0
            for k, end in zip(g, ends, strict=True):
                out[k] = data[begin:end]
                begin = end + 4
        return out

    def encode(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by end_id; ids per text)."""
        if len(self.number) > CACHE_CHUNKS or self.filled > CACHE_IDS:
            self._shrink()
        number, rows = self.number, []
        for text in texts:
            raw = text or b""
            # names of special tokens are matched before letters are lowered; 0xCC and 0xCD begin the marks that compose with ASCII letters
            if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
                raw = raw.lower()
            rows += map(number.__getitem__, raw.split())
            rows.append(-1)
        if number.new:
            self._learn()
        row = np.array(rows, np.int64)
        often = np.bincount(row + 1)[1:]
        self.met[: len(often)] += often
        end = np.flatnonzero(row < 0)
        row[end] = 0
        length = self.length[row]
        length[end] = 1
        stop = np.cumsum(length)
        at = np.repeat((self.start[row] - (stop - length)).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        marks = stop[end] - 1
        at[marks] = 0
        ids = self.ids[at]
        ids[marks] = end_id
        return ids, np.diff(marks, prepend=-1)


def coder(path: str) -> ChunkCoder:
    if path not in _CODERS:
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


FILES = "part int, seq int, part_start long, n_docs long, n_ids long, image binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the files of all documents, in ascending order of id, as the rows of a table at path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, lengths, names, held = [], [], [], 0

        def flush():
            nonlocal ids, lengths, names, held, seq, before
            image = write_image(np.array(names, np.int64), np.concatenate(lengths), np.concatenate(ids))
            row = (part, seq, before, len(names), held, image)
            seq, before = seq + 1, before + held
            ids, lengths, names, held = [], [], [], 0
            return pd.DataFrame([row], columns=["part", "seq", "part_start", "n_docs", "n_ids", "image"])

        tok = coder(tokenizer_path)
        gc.disable()  # the tables hold no cycles, and are walked in vain
        for f in frames:
            texts, doc_ids = f["_text"].tolist(), f["_id"].tolist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars < AT_ONCE):
                    chars += len(texts[stop] or b"")
                    stop += 1
                got, per_doc = tok.encode(texts[at:stop], end_id)
                ids.append(got)
                lengths.append(per_doc)
                names += doc_ids[at:stop]
                held += len(got)
                at = stop
                if held >= segment_ids:
                    yield flush()
        if names:
            yield flush()
        gc.enable()

    small_batches(docs.sparkSession)
    whole_ids(docs, id_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).cast("string").cast("binary").alias("_text"))
    order = ["_id", F.xxhash64("_text")]  # the hash splits rows of one id
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text").mapInPandas(run, FILES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and ids_crc32."""
    files = spark.read.schema(FILES).parquet(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, start, image in zip(f["part"], f["part_start"], f["image"], strict=True):
                doc_ids, lengths, ids = read_image(bytes(image))
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths).astype(np.int64)
                begins = ends - lengths.astype(np.int64)
                yield pd.DataFrame({
                    "part": np.full(len(doc_ids), part, np.int32),
                    "doc_id": doc_ids,
                    "in_part": begins + start,
                    "n_tokens": lengths.astype(np.int64),
                    "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)],
                })

    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    docs = files.select("part", "part_start", "image").mapInPandas(run, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    docs = docs.join(F.broadcast(before), "part")  # one row per partition of the writing job
    return docs.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
