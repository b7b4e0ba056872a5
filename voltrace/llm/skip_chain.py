"""A skip-chain conditional random field over the suspicious words of a text.

Nodes are the words with a digit or an at sign; all other words are fixed to the label
`none`, so a text without such words has no nodes. Neighbouring words are joined by
chain edges. Skip edges join each word with the first one of the same core, so that all repeats
are two edges apart at most, and with the next one of the same form (digits and letters alike, same first letters), wherever it
stands, unless a chain edge joins the two already. Labels come from loopy sum-product message passing over all edges of a batch
of texts at once, so evidence at one occurrence decides all of them together.

All weights, those of the edges too, are fitted by pseudo-likelihood to labels that the exact patterns and one rule for
secrets give. The rule knows words that announce a secret; the field does not. It learns from the words before a node as they are, and in
half of the training texts these are hidden, so that it also learns what can be told from a word itself and from its repeats. It thus labels secrets that
nothing announces, or a word that is not in the rule's list.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

from .pii_rules import ANY, KINDS, digits_of, luhn

LABELS = ("none", *KINDS)
N_LABELS = len(LABELS)
BUCKETS = 1 << 13
CHAIN, SAME, ALIKE = 0, 1, 2
#: Times that each batch of words is gone over.
PASSES = 60
#: Words that announce a secret (fixed values of the rule that labels training texts).
CUES = frozenset(["token", "key", "secret", "password", "passwd", "apikey", "api_key", "bearer"])

_SPACE = frozenset(" \t\n\x0b\x0c\r")
_WORD = re.compile(r"[^\x20\x09-\x0D]*")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9])?", re.S)
_SECRET = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/+-]{16,}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_MAIL = re.compile(r"[^@]+@[^@.]+(?:\.[^@.]+)+")


@dataclass
class Graph:
    """Nodes and edges of one text or, after joining, of many."""

    spans: list[tuple[int, int]] = field(default_factory=list)  # of the words' cores
    cores: list[str] = field(default_factory=list)
    cues: list[bool] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # left, right, kind


def _bucket(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) % BUCKETS


def shape(core: str) -> str:
    out = []
    for c in core:
        k = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before position at, without marks, and where it begins."""
    end = at
    while end > 0 and text[end - 1] in _SPACE:
        end -= 1
    begin = end
    while begin > 0 and text[begin - 1] not in _SPACE:
        begin -= 1
    return text[begin:end].lower().strip("\"'.,:;!?#*$%&|"), begin


def _plain(word: str) -> str:
    return shape(word) if any("0" <= c <= "9" for c in word) else word


def graph(text: str | None, hidden: bool = False) -> Graph:
    """hidden: the words before a node and the mark at its beginning give no features."""
    g, text = Graph(), text or ""
    m, last_end = ANY.search(text), -2
    seen_core: dict[str, int] = {}
    seen_shape: dict[str, int] = {}
    while m:
        begin = m.start()
        while begin > last_end and begin > 0 and text[begin - 1] not in _SPACE:
            begin -= 1
        end = _WORD.match(text, m.start()).end()
        core = _CORE.search(text, begin, end)
        if core:
            a, b = core.span()
            word = core.group()
            one, p = _before(text, begin)
            two, _ = _before(text, p)
            digits = digits_of(word)
            form = shape(word)
            n = len(g.spans)
            g.features.append([
                _bucket("bias"),
                _bucket("form", form),
                _bucket("length", min(len(word), 48) // 2),
                _bucket("digits", min(len(digits), 24)),
                _bucket("form+digits", form, min(len(digits), 24)),
                _bucket("hex", bool(_HEX.fullmatch(word)), min(len(word) // 8, 8)),
                _bucket("luhn", 12 <= len(digits) <= 19 and luhn(digits), form),
                _bucket("dotted", bool(_DOTTED.fullmatch(word))),
                _bucket("mail", bool(_MAIL.fullmatch(word))),
                _bucket("plus", word[:1]),
                *(_bucket(n, "" if hidden else x, hidden) for n, x in (("one", _plain(one)), ("two", _plain(two)), ("quoted", text[begin:a][-1:]))),
            ])
            g.spans.append((a, b))
            g.cores.append(word)
            g.cues.append(one in CUES or two in CUES)
            chained = n - 1 if n and text[last_end:begin].strip(" \t\n\x0b\x0c\r") == "" else None
            if chained is not None:
                g.edges.append((chained, n, CHAIN))
            if word in seen_core and seen_core[word] != chained:
                g.edges.append((seen_core[word], n, SAME))
            alike = f"{form}|{word[:4].lower()}|{len(word)}"
            if alike in seen_shape and seen_shape[alike] != chained and g.cores[seen_shape[alike]] != word:
                g.edges.append((seen_shape[alike], n, ALIKE))
            seen_core.setdefault(word, n)
            seen_shape[alike] = n
        last_end = end
        m = ANY.search(text, end) if end < len(text) else None
    return g


def weak_labels(g: Graph, spans: list[tuple[str, int, int]]) -> list[int]:
    """Labels from the exact patterns; a long mixed word after a cue is a secret, there and wherever else it stands in the text."""
    out, k = [], 0
    secret = LABELS.index("secret")
    announced = {w for w, cue in zip(g.cores, g.cues, strict=True) if cue and _SECRET.fullmatch(w)}
    spans = sorted(spans, key=lambda s: s[1])
    for (a, b), word in zip(g.spans, g.cores, strict=True):
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        j, label = k, 0
        while not label and j < len(spans) and spans[j][1] < b:
            label = LABELS.index(spans[j][0]) if a < spans[j][2] else 0
            j += 1
        out.append(secret if not label and word in announced else label)
    return out


@dataclass(frozen=True)
class Weights:
    unary: np.ndarray  # buckets x labels
    pair: np.ndarray  # kinds of edges x labels x labels

    #: Numbers in Learner.sums().
    SIZE = BUCKETS * (N_LABELS + 1) + 3 * (N_LABELS**2 + 1)

    @staticmethod
    def of(sums: np.ndarray) -> Weights:
        """The weights of some learners together, from the total of their sums()."""
        unary, times, pair, edges = np.split(sums, np.cumsum([BUCKETS * N_LABELS, BUCKETS, 3 * N_LABELS**2]))
        return Weights(unary.reshape(BUCKETS, N_LABELS) / np.maximum(times, 1)[:, None], pair.reshape(3, N_LABELS, N_LABELS) / np.maximum(edges, 1)[:, None, None])


class Learner:
    """Maximum pseudo-likelihood by AdaGrad, online: each node given its features and its neighbours' labels."""

    def __init__(self, rate: float = 0.3, l2: float = 1e-5):
        self.rate, self.l2 = rate, l2
        self.times, self.edges = np.zeros(BUCKETS), np.zeros(3)
        self.unary, self.pair = np.zeros((BUCKETS, N_LABELS)), np.zeros((3, N_LABELS, N_LABELS))
        self._gu, self._gp = np.full_like(self.unary, 1e-8), np.full_like(self.pair, 1e-8)

    def learn(self, features: np.ndarray, labels: np.ndarray, edges: np.ndarray, passes: int = PASSES) -> None:
        """One batch of nodes, gone over a few times. Its buckets alone are worked on."""
        n = len(labels)
        self.times += np.bincount(features.ravel(), minlength=BUCKETS)
        self.edges += np.bincount(edges[:, 2], minlength=3)
        used, local = np.unique(features, return_inverse=True)
        local = local.reshape(features.shape)
        left, right, kind = edges[:, 0], edges[:, 1], edges[:, 2]
        truth = np.zeros((n, N_LABELS))
        truth[np.arange(n), labels] = 1
        unary, gu = self.unary[used], self._gu[used]
        for _ in range(passes):
            score = unary[local].sum(axis=1)
            np.add.at(score, right, self.pair[kind, labels[left]])
            np.add.at(score, left, self.pair[kind, :, labels[right]])
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            delta = (truth - p / p.sum(axis=1, keepdims=True)) / n
            step_u = -self.l2 * unary
            for c in range(N_LABELS):
                step_u[:, c] += np.bincount(local.ravel(), np.repeat(delta[:, c], features.shape[1]), len(used))
            step_p = -self.l2 * self.pair
            np.add.at(step_p, (kind, labels[left]), delta[right])
            np.add.at(step_p.transpose(0, 2, 1), (kind, labels[right]), delta[left])
            gu += step_u**2
            self._gp += step_p**2
            unary += self.rate * step_u / np.sqrt(gu)
            self.pair += self.rate * step_p / np.sqrt(self._gp)
        self.unary[used], self._gu[used] = unary, gu

    def sums(self) -> np.ndarray:
        """Each weight times how often it has been learned from, and these times; to be added up over learners."""
        return np.concatenate([(self.unary * self.times[:, None]).ravel(), self.times, (self.pair * self.edges[:, None, None]).ravel(), self.edges])


def infer(w: Weights, features: np.ndarray, edges: np.ndarray, rounds: int = 10, damping: float = 0.5) -> np.ndarray:
    """Most likely label of every node after loopy message passing."""
    score = w.unary[features].sum(axis=1)
    if not len(edges):
        return score.argmax(axis=1)
    e = len(edges)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([w.pair[edges[:, 2]], w.pair[edges[:, 2]].transpose(0, 2, 1)])  # rows: label of src
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    msg = np.zeros((2 * e, N_LABELS))
    for _ in range(rounds):
        belief = score.copy()
        np.add.at(belief, dst, msg)
        x = (belief[src] - msg[back])[:, :, None] + pot
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        msg = damping * msg + (1 - damping) * new
    belief = score.copy()
    np.add.at(belief, dst, msg)
    return belief.argmax(axis=1)


def added_spans(g: Graph, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of labelled words that no base span touches; neighbours with one label are one span. What cannot be of its kind is left out."""
    out: list[list] = []
    joined = {(a, b) for a, b, k in g.edges if k == CHAIN}
    for i, label in enumerate(labels.tolist()):
        if label:
            kind, (a, b) = LABELS[label], g.spans[i]
            if out and out[-1][0] == kind and out[-1][3] == i - 1 and (i - 1, i) in joined and kind in ("phone", "card"):
                out[-1][2:4] = [b, i]
            else:
                out.append([kind, a, b, i, i])
    taken = sorted((a, b) for _, a, b in base)
    kept, k = [], 0
    for kind, a, b, i, first in out:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        digits = sum(len(digits_of(g.cores[j])) for j in range(first, i + 1))
        word = g.cores[i]
        if {"email": bool(_MAIL.fullmatch(word)), "ip": bool(_DOTTED.fullmatch(word)), "card": 12 <= digits <= 19, "phone": 9 <= digits <= 15, "secret": bool(_SECRET.fullmatch(word))}[kind]:
            kept.append((kind, a, b))
    return kept
