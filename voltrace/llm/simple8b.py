"""Simple-8b coding of token ids in numpy, with per-block offsets.

A 64-bit word holds a selector in its top 4 bits and, below, as many ids of one width
as fit into 60 bits. A selector with a 60-bit width is the escape for ids that no
narrower one takes. Each block of BLOCK_IDS ids starts a new word, and its word
offset is stored, so any block can be decoded alone and all blocks at once.

A file image, little-endian throughout:
  magic "VS8B", version u32, block ids u32, reserved u32,
  number of ids u64, of documents u64, of blocks u64, of words u64,
  document ids i64[documents], ids per document u64[documents],
  word offset of each block u64[blocks + 1], words u64[words].
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION = b"VS8B", 1
HEADER = struct.Struct("<4sIIIQQQQ")
BLOCK_IDS = 1024
#: Ids per word and bits per id of each selector; the last is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS


def _too_narrow(ids: np.ndarray) -> np.ndarray:
    """Number of selectors too narrow for each id."""
    out = np.zeros(len(ids), np.uint8)
    for width in WIDTHS.tolist():
        out += ids >= np.uint64(1 << width)
    return out


_SMALL = _too_narrow(np.arange(1 << 16, dtype=np.uint64))


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    ids = ids.astype(np.uint64)
    if int(ids.max()) >= 1 << 60:
        raise ValueError("ids of 2**60 and more cannot be coded")
    narrow = _too_narrow(ids) if int(ids.max()) >= len(_SMALL) else _SMALL[ids.astype(np.int64)]
    left = np.minimum(block_ids - np.arange(n) % block_ids, n - np.arange(n)).astype(np.uint16 if block_ids < 1 << 16 else np.int64)  # ids to the end of the block
    choice, least, have = np.full(n, len(COUNTS) - 1, np.int8), narrow, 1
    for s in range(len(COUNTS) - 2, -1, -1):  # from few wide ids to many narrow ones
        count = int(COUNTS[s])
        if count > n:
            break
        for k in range(have, count):  # what the widest of the next ids needs
            least = np.maximum(least[:-1], narrow[k:])
        have = count
        fits = least <= s
        fits &= left[: len(least)] >= count
        np.copyto(choice[: len(least)], s, where=fits)
    takes = COUNTS[choice].astype(np.int32)
    # walk all blocks in step
    starts = np.arange(0, n, block_ids, dtype=np.int64)
    ends = np.minimum(starts + block_ids, n)
    pos, which, where, of = starts.copy(), np.arange(len(starts)), [], []
    while len(pos):
        where.append(pos)
        of.append(which)
        pos = pos + takes[pos]
        more = pos < ends[which]
        pos, which = pos[more], which[more]
    first, block = np.concatenate(where), np.concatenate(of)
    order = np.argsort(first, kind="stable")
    first, block = first[order], block[order]
    sel = choice[first].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():  # every word is full
        rows = np.flatnonzero(sel == s)
        part, acc = first[rows], np.zeros(len(rows), np.uint64)
        for k in range(int(COUNTS[s])):
            acc |= ids.take(part + k) << np.uint64(k * int(WIDTHS[s]))
        words[rows] |= acc
    offsets = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=len(starts)))]).astype(np.uint64)
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The n ids, as u32 if they fit, else u64; all words of one selector are unpacked together."""
    if not n:
        return np.zeros(0, np.uint32)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    blocks = len(offsets) - 1
    lengths = np.full(blocks, block_ids, np.int64)
    lengths[-1] = n - block_ids * (blocks - 1)
    ends = offsets[1:].astype(np.int64)
    total = np.add.reduceat(count, offsets[:-1].astype(np.int64))
    count = count.copy()
    count[ends - 1] -= total - lengths  # a block's last word may hold fewer
    start = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        width = int(WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        at, have, word = start[rows], count[rows], words[rows]
        for k in range(int(COUNTS[s])):
            on = have > k
            if not on.any():
                break
            out[at[on] + k] = (word[on] >> np.uint64(k * width)) & mask
    return out.astype(np.uint32) if not int(out.max()) >> 32 else out


def write_image(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    words, offsets = encode(ids, block_ids)
    head = HEADER.pack(MAGIC, VERSION, block_ids, 0, len(ids), len(doc_ids), len(offsets) - 1, len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids per document, ids)."""
    magic, version, block_ids, _, n_ids, n_docs, n_blocks, n_words = HEADER.unpack_from(image)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of this format")
    at = HEADER.size
    parts = []
    for dtype, n in (("<i8", n_docs), ("<u8", n_docs), ("<u8", n_blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(image, dtype, n, at))
        at += 8 * n
    if at != len(image):
        raise ValueError("the file is cut short or too long")
    doc_ids, lengths, offsets, words = parts
    return doc_ids, lengths, decode(words, offsets, n_ids, block_ids)
