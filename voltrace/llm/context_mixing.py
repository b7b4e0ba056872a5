"""Online logistic context mixing over the bits of words; pure numpy.

A text is a run of tokens. Frequent words, the end of a text and an escape are coded by
one Huffman code; a word without a code of its own follows the escape byte by byte, with a space behind it, by
another. Every bit of a code is a decision. Predictors look it up by a hash of a context and of the bits so
far: for words the language so far (the last frequent words), the word before and the two words before; inside
a spelled word its last bytes, all its bytes so far, and these with the word before. Contexts are known before the bit
and the codes are complete, so the probabilities of all texts add up to one at most.

Predictions are combined in the logistic domain by weights that a gate chooses: what kind of decision it is, and
how often and how unanimously its longer contexts were seen. Weights are learned online while a text is scored:
a text starts from the given weights, and after every turn (STEP decisions at first, more later) its own weights
move along the gradient of what these have cost. A last stage refines the mix adaptively by the frequencies that
this text has shown at each level so far. Scores of a text never depend on other texts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash

#: Slots of each predictor's table, as powers of two.
BITS = (20, 21, 22, 22)
PREDICTORS = len(BITS)
END, STOP = b"\n", b" "
#: Words that tell the language: so many of the most frequent ones.
TELLING = 512
STEP = 256
RATE = 0.03
GATES = 2 * 4 * 4
#: Errors below this move no weights.
HEED = 1 / 16
#: The last stage: levels of the mixed log-odds, their width, and the weight of what it starts from.
LEVELS, WIDTH, PRIOR = 34, 0.75, 24.0
BIAS, BIAS_INPUT = 0.4, 0.3

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_PLACES = np.random.default_rng(77).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_ONE = np.uint64(1)
_ODD32 = np.uint32(0x9E3779B1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def prefix_code(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bits) of a canonical Huffman code; at least two symbols."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent = [0] * (2 * n - 1)
    for new in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = new
        heapq.heappush(heap, (a + b, new))
    depth = [0] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    length, bits, code, was = np.array(depth[:n], np.int64), np.zeros(n, np.uint64), 0, 0
    for s in sorted(range(n), key=lambda s: (depth[s], s)):
        code <<= depth[s] - was
        bits[s], was = code, depth[s]
        code += 1
    return length, bits


@dataclass
class Vocabulary:
    """Words with codes of their own, and both codes in one table: words, end, escape, then the 256 bytes. nodes, bits: the decisions of all codes, one code after the other."""

    number: dict[bytes, int]
    length: np.ndarray
    start: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(words: list[bytes], counts: list[int], texts: int, escapes: int) -> Vocabulary:
        """words: most frequent first. texts, escapes: how often the end and the escape come."""
        n = len(words)
        one = prefix_code([*(int(c) + 1 for c in counts), texts + 1, escapes + 1])
        seen = np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256) + 1
        two = prefix_code(seen.tolist())
        length, code = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]])
        start = np.cumsum(length) - length
        k = (np.arange(int(length.sum())) - np.repeat(start, length)).astype(np.uint64)
        rest, code = np.repeat(length, length).astype(np.uint64) - k, np.repeat(code, length)
        nodes, bits = (_mix(((_ONE << k) | (code >> rest)) * _ODD[0]) >> np.uint64(32)).astype(np.uint32), ((code >> (rest - _ONE)) & _ONE).astype(np.int8)
        return Vocabulary({w: i for i, w in enumerate(words)} | {END: n}, length, start, nodes, bits)


@dataclass
class Stream:
    """The decisions of some texts, one after the other; what is known of each is looked up when it is needed, so that little memory is touched."""

    vocabulary: Vocabulary
    begin: np.ndarray  # first decision of each text, and the end
    symbol: np.ndarray  # of each decision
    shift: np.ndarray  # of each symbol: from a decision to its place in the vocabulary's nodes and bits
    spelled: np.ndarray  # of each symbol
    context: list[np.ndarray]  # of each symbol, by predictor


def _slots(context: np.ndarray, symbol: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = context.take(symbol)
    h += node
    h *= _ODD32
    h >>= np.uint32(32 - bits)
    return h


def stream(texts: list[list[bytes]], vocabulary: Vocabulary) -> Stream:
    """texts: words, each text with END behind them."""
    n_words = len(vocabulary.number) - 1
    escape = n_words + 1
    flat = list(chain.from_iterable(texts))
    ids = np.fromiter(map(vocabulary.number.get, flat, [escape] * len(flat)), np.int64, len(flat))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    place = np.arange(len(ids))
    rare = np.flatnonzero(ids == escape)
    words = [flat[i] for i in rare.tolist()]
    name = _mix((ids.astype(np.uint64) + _ONE) * _ODD[0])
    name[rare] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def back(x: np.ndarray, k: int) -> np.ndarray:
        """What x was k tokens before, 0 before the text."""
        out = np.zeros_like(x)
        out[k:] = x[:-k] if k < len(x) else 0
        out[place - k < first] = 0
        return out

    one, two = back(name, 1), back(name, 2)
    last = np.maximum.accumulate(np.where(ids < TELLING, place, -1))
    last = np.concatenate([[-1], last[:-1]])  # place of the last telling word before
    here = last >= first
    tongue = np.where(here, ids[last] + 1, 0).astype(np.uint64)
    by_word = [np.zeros(len(ids), np.uint64), _mix(tongue * _ODD[1] + _ONE), _mix(one * _ODD[2] + np.uint64(2)), _mix(_mix(one * _ODD[3] + np.uint64(3)) + two * _ODD[0])]

    # spelled words
    many = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(STOP.join([*words, b""]), np.uint8)
    byte = raw.astype(np.uint64)
    start = np.cumsum(many) - many
    at = np.arange(len(raw)) - np.repeat(start, many)
    so_far, upto = np.zeros(len(raw), np.uint64), []
    for k in range(1, 6):
        earlier = np.zeros(len(raw), np.uint64)
        earlier[k:] = byte[:-k] if k < len(raw) else 0
        earlier[at < k] = 0
        so_far = so_far | (earlier << np.uint64(8 * (k - 1)))
        upto.append(so_far)
    step = (byte + _ONE) * _PLACES[at % len(_PLACES)]
    prefix = np.cumsum(step, dtype=np.uint64) - step
    prefix -= np.repeat(prefix[start], many)
    lang = np.repeat(by_word[1][rare], many)
    by_byte = [_mix(upto[1] * _ODD[1] + np.uint64(5)), _mix(upto[2] * _ODD[2] + lang), _mix(upto[4] * _ODD[3] + np.uint64(6)), _mix(prefix * _ODD[5] + lang + np.uint64(7))]

    # all symbols in turn
    ahead = np.zeros(len(ids) + 1, np.int64)
    ahead[rare + 1] = many
    ahead = np.cumsum(ahead)
    where = place + ahead[:-1]
    total = len(ids) + len(raw)
    spelled = np.ones(total, bool)
    spelled[where] = False
    code = np.empty(total, np.int64)
    code[where], code[spelled] = ids, raw.astype(np.int64) + escape + 1
    context = []
    for a, b in zip(by_word, by_byte, strict=True):
        c = np.empty(total, np.uint32)
        c[where], c[spelled] = _mix(a) >> np.uint64(32), _mix(b) >> np.uint64(32)
        context.append(c)
    length = vocabulary.length[code]
    stop = np.cumsum(length)
    begin = np.concatenate([[0], stop])[np.concatenate([[0], ends + ahead[ends]])]
    return Stream(vocabulary, begin, np.repeat(np.arange(total, dtype=np.int32), length), vocabulary.start[code] - (stop - length), spelled.view(np.int8), context)


def empty_tables(bits: tuple[int, ...] = BITS) -> list[np.ndarray]:
    """Counts of zeros and ones of every slot."""
    return [np.zeros(2 << b, np.uint32) for b in bits]


def count(s: Stream, tables: list[np.ndarray], bits: tuple[int, ...] = BITS, part: int = 1 << 15) -> None:
    for a in range(0, len(s.symbol), part):  # small enough to stay in the cache
        symbol = s.symbol[a : a + part]
        at = s.shift.take(symbol) + np.arange(a, a + len(symbol))
        node, bit = s.vocabulary.nodes.take(at), s.vocabulary.bits.take(at)
        for i, b in enumerate(bits):
            slot = _slots(s.context[i], symbol, node, b).astype(np.int64)
            slot <<= 1
            slot += bit
            np.add.at(tables[i], slot, np.uint32(1))


#: Least count of each of the 256 levels that counts are kept as: exact below _FULL, then in steps of 9 percent.
_LEAST = np.unique(np.concatenate([np.arange(65), np.floor(64 * 1.09 ** np.arange(1, 192))])).astype(np.float64)[:256]
_FULL = 64
_LAST = float(_LEAST[-1])


def states(counts: np.ndarray) -> np.ndarray:
    """Two levels in 16 bits for every slot; counts beyond the last level are scaled down together."""
    pairs = counts.reshape(-1, 2).astype(np.float64)
    top = pairs.max(axis=1)
    if len(top) and top.max() > _LAST:
        pairs *= np.minimum(1.0, _LAST / np.maximum(top, 1.0))[:, None]
    level = np.searchsorted(_LEAST, pairs, side="right") - 1
    return (level[:, 0] * 256 + level[:, 1]).astype(np.uint16)


_N0, _N1 = np.divmod(np.arange(1 << 16), 256)
#: A state's neighbours without one zero and without one one; exact levels only.
_LESS = np.stack([np.arange(1 << 16), np.where((_N0 > 0) & (_N0 < _FULL), np.arange(1 << 16) - 256, np.arange(1 << 16)), np.where((_N1 > 0) & (_N1 < _FULL), np.arange(1 << 16) - 1, np.arange(1 << 16))])
_V0, _V1 = (_LEAST[np.minimum(n, len(_LEAST) - 1)] for n in (_N0, _N1))
#: Log-odds of a state: as it is, and without the zero or the one that a text itself has added.
STRETCH = np.log((_V1 + BIAS) / (_V0 + BIAS)).astype(np.float32)[_LESS].ravel()
#: 0: never seen; 1: both bits seen; 2, 3: one bit only, up to twice or more often.
SURE = np.where((_N0 > 0) & (_N1 > 0), 1, np.where(_N0 + _N1 == 0, 0, np.where(_N0 + _N1 <= 2, 2, 3))).astype(np.int8)[_LESS].ravel()


def first_weights() -> np.ndarray:
    """Of each predictor and a bias, by gate."""
    w = np.full((PREDICTORS + 1, GATES), 0.3)
    w[-1] = 0
    return w


def turns(size: int, step: int = STEP) -> list[tuple[int, int]]:
    """(first decision, number of decisions) of each turn of a text: at first `step`, later an eighth of what has gone before, so a long text takes few turns."""
    out, t = [], 0
    while t < size:
        out.append((t, max(step, t // 8)))
        t += out[-1][1]
    return out


def score(s: Stream, tables: list[np.ndarray], own: np.ndarray, start: np.ndarray, bits: tuple[int, ...] = BITS, rate: float = RATE, heed: float = HEED, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each text, weights at its end: texts x predictors x gates).

    tables: states. own: for each text, whether it is in the counts and is to be left out. Texts go on together, a turn of
    each at a time, with weights of their own; a longer turn moves them no further than a short one. Errors below heed move no weights.
    """
    n, size = len(s.begin) - 1, np.diff(s.begin)
    longest = np.argsort(-size, kind="stable")
    size, origin, own = size[longest], s.begin[:-1][longest], own[longest].astype(np.int64) << 16
    weights = np.repeat(start.astype(np.float32)[:, None, :], n, axis=1).reshape(len(start), -1)  # of a predictor: by text and gate
    ones = np.tile((PRIOR / (1 + np.exp(-(np.arange(LEVELS) - LEVELS // 2) * WIDTH))).astype(np.float32), 2 * n)
    seen = np.full(2 * n * LEVELS, PRIOR, np.float32)
    total = np.zeros(n)
    for t, step in turns(int(size[0]) if n else 0, step):
        texts = int(np.searchsorted(-size, -t, side="left"))  # that go on
        length = np.minimum(size[:texts] - t, step)
        stop = np.cumsum(length)
        d = np.repeat(origin[:texts] + t - (stop - length), length)
        d += np.arange(len(d))
        text, symbol = np.repeat(np.arange(texts), length), s.symbol.take(d)
        d += s.shift.take(symbol)
        node, y = s.vocabulary.nodes.take(d), s.vocabulary.bits.take(d)
        less = np.repeat(own[:texts], length)
        less *= y + np.int8(1)
        spelled = s.spelled.take(symbol)
        gate, x = spelled, []
        for i, b in enumerate(bits):
            state = less + tables[i].take(_slots(s.context[i], symbol, node, b))
            x.append(STRETCH.take(state))
            if i >= 2:
                gate = gate * np.int16(4) + SURE.take(state)
        at = text * GATES
        at += gate
        dot = weights[-1].take(at) * np.float32(BIAS_INPUT)
        for i in range(PREDICTORS):
            dot += weights[i].take(at) * x[i]
        np.clip(dot, -12, 12, out=dot)
        p = 1 / (1 + np.exp(-dot))
        cell = (text * 2 + spelled) * LEVELS
        dot *= np.float32(1 / WIDTH)
        dot += np.float32(LEVELS // 2 + 0.5)
        cell += dot.astype(np.int64)
        q = ones.take(cell) / seen.take(cell)
        q += p
        q *= np.float32(0.5)
        q -= 1 - y  # of the bit that came, but for the sign
        total[:texts] += np.add.reduceat(np.log10(np.clip(np.abs(q), 1e-6, 1 - 1e-6)), stop - length, dtype=np.float64)
        err = y - p
        some = np.flatnonzero(np.abs(err) > heed)
        err, at = err.take(some) * np.float32(rate * STEP / step), at.take(some)
        for i in range(PREDICTORS):
            weights[i, : texts * GATES] += np.bincount(at, err * x[i].take(some), texts * GATES)
        weights[-1, : texts * GATES] += np.bincount(at, err * np.float32(BIAS_INPUT), texts * GATES)
        both = np.bincount(cell, y * 65536.0 + 1.0, 2 * texts * LEVELS)  # ones and all in one number
        one = np.floor(both / 65536)
        ones[: len(one)] += one
        seen[: len(one)] += both - one * 65536
    logs, last = np.empty(n), np.empty((n, len(start), GATES), np.float32)
    logs[longest], last[longest] = total, weights.reshape(len(start), n, GATES).transpose(1, 0, 2)
    return logs, last
