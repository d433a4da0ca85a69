"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on labelled spans: sentences with addresses and numbers, many in forms that no base pattern
takes (``bob at mail dot org``, ``10[.]0[.]0[.]1``, numbers that run together), and look-alikes, made from a seed.

Every character of every text is read in overlapping windows, in which the network gives it label scores; where windows overlap, a
character takes those of the window in which it lies furthest from an edge. One Viterbi path under the transitions is then found
over all scores of the text, as if it stood between two outside characters. Most of that path is known at once:
where no entity over a character can be worth more than none, the character is outside on the best path (``certain``), so the
search runs over the stretches between such characters and its result is the same.

Added spans overlap no base span and must be plausible for their kind (characters, number of digits, checksum); base spans stay.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim, strings

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE = 896, 848
HIDDEN, EMBED = 8, 8
#: Characters that are labelled at once, those of them that are told certain at once (a longer text alone), windows that the network takes at once, stretches searched at once.
BLOCK, PIECE, BATCH, LANES = 1 << 20, 1 << 13, 1024, 2048
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match never starts inside a run of digits, so the look-behinds only save work.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is all of its run before the sign; nothing is scanned twice."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base spans, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


#: How often letters come in the words of made sentences, summed up: twelve common ones, ten others, six beyond ASCII.
LETTERS = list(accumulate([3] * 12 + [1] * 16))

# Labels: 0 outside, 2k + 1 first character of kind k, 2k + 2 further ones.
LABELS = 9
_ALLOWED = np.zeros((LABELS, LABELS), bool)
_ALLOWED[:, [0, 1, 3, 5, 7]] = True
for _k in range(4):
    _ALLOWED[[2 * _k + 1, 2 * _k + 2], 2 * _k + 2] = True


def codes(text: str) -> np.ndarray:
    """A class for each code point: ASCII as itself, letters beyond it as 1, all else as 2."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, np.where(points < 0x2000, 1, 2)).astype(np.uint8)


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """One labelled sentence, with base forms, forms beyond them, spans that touch others, and look-alikes."""
    def pick(*options):
        return rng.choice(options)

    def word(low=2, high=14):
        return "".join(rng.choices("etaoinshrdlucmwfgypbvkéèüçñß", cum_weights=LETTERS, k=rng.randrange(low, high)))

    def plain(low=2, high=9):
        return "".join(rng.choices("etaoinshrdlucmbk", k=rng.randrange(low, high)))

    def digits(n):
        return "".join(rng.choices("0123456789", k=n))

    def card():
        body = digits(rng.randrange(13, 16) if rng.random() < 0.3 else 15)
        body = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return body if rng.random() < 0.35 else pick(" ", "-", " ", "-", ".", "/", "_").join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone():
        a, b, c = str(rng.randrange(200, 999)), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+49 {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b}{c}", f"({a}) {b} {c}", f"+{digits(2)}/{a}/{b}{c}")

    def email():
        user, host = plain() + pick("", "", ".", "_") + digits(rng.randrange(3)) + plain(1, 4), plain() + pick("", digits(1))
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", "."), (" AT ", " DOT "))
        return user + at + host + dot + pick("com", "org", "net", "example.com", "de", "fr")

    def address():
        return pick(".", ".", "[.]", " . ", "(.)").join(str(rng.randrange(256)) for _ in range(4))

    def other():
        return pick(
            lambda: digits(rng.randrange(1, 13)), lambda: f"{digits(2)}.{digits(1)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
            lambda: f"{digits(1)},{digits(3)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: f"{plain()} at {plain()}", lambda: f"{plain()} at {plain()}. {plain().title()}",
            lambda: f"{plain()}. {plain().title()} at {plain()}, {plain()} and", lambda: f"the dot on {plain()}", lambda: f"meet {plain()} at {digits(1)}", lambda: f'token = "{rng.randbytes(20).hex()}"',
            lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"({digits(4)})", lambda: f"{digits(3)}-{digits(3)}", lambda: f"{digits(1)}.{digits(2)}.{digits(4)}",
        )()

    made = [email, address, card, phone]
    text, spans = "", []
    # a third of the sentences are prose, in which personal data are rare
    dense = pick(0.35, 0.35, 0.03)
    for _ in range(rng.randrange(4, 12) if dense > 0.1 else 20):
        text += (word() if rng.random() < 0.67 else word().title()) + pick(" ", " ", " ", " ", ". ", ", ", "\n", "!! ", "### ")
        r = rng.random()
        if r < dense:
            for _ in range(2 if rng.random() < 0.2 else 1):
                k = rng.randrange(4)
                piece = made[k]()
                spans.append((len(text), len(text) + len(piece), k))
                text += piece + " "
            text = text[:-1] + pick(" ", " ", ". ", ", ", "\n", "!! ", "*** ", "$$$ ")
        elif r < dense + 0.2:
            text += other() + pick(" ", " ", ". ", "!! ")
    return text, spans


def squash(x: np.ndarray) -> np.ndarray:
    """The network's activation, linear between -1 and 1: one cheap operation where a hyperbolic tangent takes most of the time."""
    return np.clip(x, -1, 1)


def slope(x: np.ndarray) -> np.ndarray:
    """The derivative of ``squash``."""
    return (np.abs(x) < 1).astype(x.dtype)


class Tagger:
    """The network: embeddings, an LSTM each way (the second reads backwards), label scores, transitions. All arrays are float32.

    Gates are (1 + squash(0.4 x)) / 2. Transitions are kept within ``BOUND`` of 0, so that scores decide and not habits.
    """

    BOUND = 2.0

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        p = {"e": rng.normal(0, 0.3, (128, EMBED)), "w": rng.normal(0, 0.3, (2, EMBED, 4 * h)), "u": rng.normal(0, 0.2, (2, h, 4 * h)), "c": np.zeros((2, 4 * h))}
        p |= {"o": rng.normal(0, 0.2, (2, h, LABELS)), "b": np.zeros(LABELS), "t": np.where(_ALLOWED, 0.0, -1e4), "s": np.zeros(LABELS)}
        p["c"][:, h : 2 * h] = 1.0
        p["b"][0] = 1.0
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def _half() -> np.ndarray:
        return np.repeat(np.array([0.4, 1], np.float32), [3 * HIDDEN, HIDDEN])

    def scores(self, codes_: np.ndarray):
        """Label scores (batch, time, label), and what the gradients need. Arrays of both directions are in their own order of time."""
        h, p, half = HIDDEN, self.p, self._half()
        n, steps = codes_.shape
        x = p["e"][np.stack([codes_, codes_[:, ::-1]])]
        z = x @ p["w"][:, None] + p["c"][:, None, None]
        pre, cells, out = np.empty_like(z), np.zeros((steps + 1, 2, n, h), z.dtype), np.zeros((2, n, steps + 1, h), z.dtype)
        for s in range(steps):
            pre[:, :, s] = a = (z[:, :, s] + out[:, :, s] @ p["u"]) * half
            y = squash(a)
            gates = 0.5 + 0.5 * y[..., : 3 * h]
            cells[s + 1] = gates[..., h : 2 * h] * cells[s] + gates[..., :h] * y[..., 3 * h :]
            out[:, :, s + 1] = gates[..., 2 * h :] * squash(cells[s + 1])
        both = out[:, :, 1:] @ p["o"][:, None]
        return both[0] + both[1, :, ::-1] + p["b"], (x, pre, cells, out)

    def _back(self, du: np.ndarray, x: np.ndarray, pre: np.ndarray, cells: np.ndarray, out: np.ndarray) -> dict:
        """Gradients from those of the label scores."""
        h, p, half = HIDDEN, self.p, self._half()
        both = np.stack([du, du[:, ::-1]])
        grad = both @ p["o"][:, None].swapaxes(2, 3)
        dz = np.empty_like(pre)
        dh, dc = np.zeros_like(grad[:, :, 0]), np.zeros_like(grad[:, :, 0])
        for s in range(pre.shape[2] - 1, -1, -1):
            y, k, cell = squash(pre[:, :, s]), slope(pre[:, :, s]) * half, cells[s + 1]
            gates = 0.5 + 0.5 * y[..., : 3 * h]
            dh = dh + grad[:, :, s]
            dc = dc + dh * gates[..., 2 * h :] * slope(cell)
            da = np.concatenate([dc * y[..., 3 * h :] * 0.5, dc * cells[s] * 0.5, dh * squash(cell) * 0.5, dc * gates[..., :h]], 2) * k
            dz[:, :, s] = da
            dh, dc = da @ p["u"].swapaxes(1, 2), dc * gates[..., h : 2 * h]

        def flat(v):
            return v.reshape(2, -1, v.shape[-1])

        g = {"w": flat(x).swapaxes(1, 2) @ flat(dz), "u": flat(out[:, :, :-1]).swapaxes(1, 2) @ flat(dz), "c": flat(dz).sum(1)}
        g |= {"o": flat(out[:, :, 1:]).swapaxes(1, 2) @ flat(both), "b": du.sum((0, 1))}
        dx = dz @ p["w"][:, None].swapaxes(2, 3)
        g["x"] = dx[0] + dx[1, :, ::-1]
        return g

    def step(self, codes_: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the CRF and its gradients, by a forward and a backward pass of sums that are kept at 1 a step."""
        scores, tape = self.scores(codes_)
        n, steps, _ = scores.shape
        u, t = np.ascontiguousarray(scores.swapaxes(0, 1)).astype(np.float64), self.p["t"].astype(np.float64)
        top = u.max(2, keepdims=True)
        here, to = np.exp(u - top), np.exp(t)
        alpha, beta, size = np.empty(u.shape), np.ones(u.shape), np.empty((steps, n, 1))
        a = here[0] * np.exp(self.p["s"].astype(np.float64))
        for s in range(steps):
            if s:
                a = here[s] * (alpha[s - 1] @ to)
            size[s, :, 0] = a.sum(1)
            np.divide(a, size[s], out=alpha[s])
        here /= size
        for s in range(steps - 2, -1, -1):
            np.matmul(here[s + 1] * beta[s + 1], to.T, out=beta[s])
        total = np.log(size[..., 0]).sum(0) + top[..., 0].sum(0)
        one = np.eye(LABELS)[gold.T]
        du = ((alpha * beta - one) / n).swapaxes(0, 1)
        here *= beta  # a label's share given all that follows

        def pairs(before, after):
            return before[:-1].reshape(-1, LABELS).T @ after[1:].reshape(-1, LABELS)

        dt = to * pairs(alpha, here) - pairs(one, one)
        path = (u * one).sum((0, 2)) + t[gold[:, :-1], gold[:, 1:]].sum(1) + self.p["s"][gold[:, 0]]
        g = self._back(du.astype(self.p["o"].dtype), *tape)
        g |= {"t": dt / n * _ALLOWED, "s": du[:, 0].sum(0), "e": np.zeros_like(self.p["e"])}
        np.add.at(g["e"], codes_.ravel(), g.pop("x").reshape(-1, EMBED))
        return float((total - path).mean()), g

    def label_scores(self, codes_: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` of windows of given lengths, none longer than the one before: what each direction adds, (step, window, label).

        At each step only the windows that are as long take part; the second direction begins at each window's own end.
        """
        h, p, half = HIDDEN, self.p, self._half()

        def by_gate(v):
            return np.ascontiguousarray(np.moveaxis((v * half).reshape(*v.shape[:-1], 4, h), -2, 0))

        into = [by_gate(p["e"] @ p["w"][d] + p["c"][d]) for d in (0, 1)]  # (gate, code, feature)
        onto = by_gate(p["u"])
        n, steps = len(codes_), int(length[0])
        back = np.take_along_axis(codes_, np.maximum(length[:, None] - 1 - np.arange(steps), 0), 1)
        columns = [np.ascontiguousarray(c[:, :steps].T).astype(np.intp) for c in (codes_, back)]
        out = np.zeros((2, steps, n, h), np.float32)
        hidden, cell, small = (np.zeros((2, n, h), np.float32) for _ in range(3))
        a, z = np.empty((4, 2, n, h), np.float32), np.empty((4, n, h), np.float32)
        alive = np.searchsorted(-length, -np.arange(steps), "left").tolist()
        for s, k in enumerate(alive):
            if k < n:  # go on with fewer windows
                n = k
                hidden, cell, small = hidden[:, :k].copy(), cell[:, :k].copy(), small[:, :k].copy()
                a, z = np.empty((4, 2, k, h), np.float32), np.empty((4, k, h), np.float32)
            np.matmul(hidden, onto, out=a)
            for d in (0, 1):
                a[:, d] += into[d].take(columns[d][s, :k], 1, out=z, mode="clip")
            np.clip(a, -1, 1, out=a)
            gates = a[:3]
            gates += 1
            gates *= 0.5
            cell *= a[1]
            cell += np.multiply(a[0], a[3], out=small)
            np.clip(cell, -1, 1, out=hidden)
            hidden *= a[2]
            out[:, s, :k] = hidden
        return out[0] @ p["o"][0] + p["b"], out[1] @ p["o"][1]


def stretches(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of set flags; runs end where texts do."""
    head, tail = flags.copy(), flags.copy()
    head[1:] &= ~flags[:-1]
    tail[:-1] &= ~flags[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    head[edges] = flags[edges]
    tail[edges[1:] - 1] = flags[edges[1:] - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def window_scores(net: Tagger, codes_: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Label scores of every character of the stretches, from overlapping windows of each; rows of other characters are not set."""
    n = ends - starts
    count = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    of = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = starts[of] + number * STRIDE
    end = np.minimum(ends[of], start + WINDOW)
    edge = (WINDOW - STRIDE) // 2
    # a window's own part: its middle, and the outer parts only where no window lies on that side
    low = start + np.where(number == 0, 0, edge)
    high = np.where(number == count[of] - 1, end, start + WINDOW - edge)
    out = np.empty((len(codes_), LABELS), np.float32)
    padded = np.append(codes_, np.full(WINDOW, 32, codes_.dtype))
    order = np.argsort(start - end, kind="stable")  # the longest first
    for i in range(0, len(order), BATCH):
        some = order[i : i + BATCH]
        there, back = net.label_scores(padded[start[some, None] + np.arange(end[some[0]] - start[some[0]])], end[some] - start[some])
        for k, (a, b, c, d) in enumerate(zip(start[some].tolist(), low[some].tolist(), high[some].tolist(), end[some].tolist(), strict=True)):
            out[b:c] = there[b - a : c - a, k]
            out[b:c] += back[d - c : d - b, k][::-1]
    return out


def text_labels(net: Tagger, texts: list[str], offsets: np.ndarray) -> np.ndarray:
    """The labels of every character of the texts on the best path over each whole text."""
    scores = window_scores(net, codes("".join(texts)), offsets[:-1], offsets[1:])
    return best_path(scores, offsets, net.p["t"])


def certain(u: np.ndarray, offsets: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Characters that are outside on every best path.

    Making a whole entity of a path outside changes the scores of its characters and the transitions in it and at its ends. The
    most that any entity over a character can be worth, against outside, is the best beginning up to it and the best end from it
    on: running maxima over sums from the left. Where that is negative for all kinds, no best path has an entity there.
    """
    t = t.astype(np.float64)
    entry = [0, 1, 3, 5, 7]  # allowed after every label
    columns = np.ascontiguousarray(u.T).astype(np.float64)
    edges = offsets[:-1][np.diff(offsets) > 0]
    sure = np.ones(len(u), bool)
    for kind in range(4):
        first, further = 2 * kind + 1, 2 * kind + 2
        on = columns[further] - columns[0] + (max(t[first, further], t[further, further]) - t[0, 0])
        on[edges] = -1e4  # no entity goes on into another text
        total = np.cumsum(on)
        begin = columns[first] - columns[0] + max(t[p, first] - t[p, 0] for p in range(LABELS))
        worth = np.maximum.accumulate(begin - total)
        worth += np.maximum.accumulate(total[::-1])[::-1]
        worth += max(t[a, q] - t[0, q] for a in (first, further) for q in entry)
        sure &= worth < -1e-3
    return sure


def best_path(u: np.ndarray, offsets: np.ndarray, t: np.ndarray, skip: bool = True) -> np.ndarray:
    """The labels of the best path over each text (``offsets``: bounds of the texts), which stands between two outside characters."""
    labels = np.zeros(len(u), np.int8)
    loose = np.ones(len(u), bool)
    d = 0 if skip else len(offsets) - 1
    while d < len(offsets) - 1:  # some texts at a time, whose scores stay in the processor's cache
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + PIECE, "right")) - 1)
        a, b = int(offsets[d]), int(offsets[e])
        loose[a:b] = ~certain(u[a:b], offsets[d : e + 1] - a, t)
        d = e
    start, end = stretches(loose, offsets)
    length = end - start
    order = np.argsort(-length, kind="stable")
    for i in range(0, len(order), LANES):
        _search(u, start[order[i : i + LANES]], length[order[i : i + LANES]], t, labels)
    return labels


def _search(u: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray, labels: np.ndarray) -> None:
    """Put the best paths of stretches between outside characters, side by side from the longest to the shortest, into the labels."""
    entry = np.array([0, 1, 3, 5, 7])  # allowed after every label; further characters only after their kind
    into = t[:, entry, None]
    scores = [(u[start] + t[0]).T.copy()]
    for s in range(1, int(length[0])):
        k = int(np.searchsorted(-length, -s, "left"))  # stretches longer than s
        before, new = scores[-1][:, :k], np.empty((LABELS, k), u.dtype)
        value = before[0] + into[0]
        for p in range(1, LABELS):
            np.maximum(value, before[p] + into[p], out=value)
        new[entry] = value
        for first in (1, 3, 5, 7):
            np.maximum(before[first] + t[first, first + 1], before[first + 1] + t[first + 1, first + 1], out=new[first + 1])
        new += u[start[:k] + s].T
        new -= new.max(0)  # scores of long texts would lose their small digits
        scores.append(new)
    # from the end back: the label before is looked for only where the path goes
    at = np.zeros(len(start), np.intp)
    after = np.zeros(len(start), np.intp)
    for s in range(int(length[0]) - 1, -1, -1):
        k = int(np.searchsorted(-length, -s, "left"))
        at[:k] = (scores[s][:, :k] + t[:, after[:k]]).argmax(0)
        labels[start[:k] + s] = at[:k]
        after[:k] = at[:k]


@lru_cache(1)
def train(seed: int = 7, steps: int = 1200, batch: int = 32, crop: int = 96) -> Tagger:
    """Fit on labelled sentences made from the seed, by Adam. The same network wherever and however often it is run."""
    rng = random.Random(seed)
    net, m, v = Tagger(np.random.default_rng(seed)), {}, {}
    for step in range(1, steps + 1):
        x, y = np.zeros((batch, crop), np.int64) + 32, np.zeros((batch, crop), np.int64)
        for i in range(batch):
            text, spans = _example(rng)
            at = rng.randrange(max(1, len(text) - crop + 1))
            c = codes(text)[at : at + crop]
            x[i, : len(c)] = c
            for a, b, k in spans:
                a, b = max(a - at, 0), min(b - at, crop)
                if a < b:
                    y[i, a:b] = 2 * k + 2
                    y[i, a] = 2 * k + 1
        _, g = net.step(x, y)
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, d in g.items():
            d = np.clip(d, -5, 5)
            m[k] = 0.9 * m.get(k, 0) + 0.1 * d
            v[k] = 0.98 * v.get(k, 0) + 0.02 * d * d
            net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
        net.p["t"] = np.where(_ALLOWED, np.clip(net.p["t"], -Tagger.BOUND, Tagger.BOUND), -1e4).astype(np.float32)
    return net


def model_spans(texts: list[str], net: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in whole texts: maximal stretches of one entity on the best path of each text."""
    out: list[list[tuple[int, int, int]]] = []
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= BLOCK:
            size += len(texts[j])
            j += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[i:j]])]).astype(np.int64)
        y = text_labels(net, texts[i:j], offsets)
        heads = np.flatnonzero(y % 2 == 1)
        inside = (y > 0) & (y % 2 == 0)
        stops = np.flatnonzero(~np.append(inside, False))
        ends = stops[np.searchsorted(stops, heads + 1)]
        owners = np.searchsorted(offsets, heads, "right") - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(i, j)]
        for a, b, d in zip(heads.tolist(), ends.tolist(), owners.tolist(), strict=True):
            shift = int(offsets[d])
            found[d].append((a - shift, min(b, int(offsets[d + 1])) - shift, (int(y[a]) - 1) // 2))
        out += found
        i = j
    return out


_FORMS = [
    re.compile(p)
    for p in (
        r"[\w.%+-]+(?: ?@ ?[\w-]+(?:\.[\w-]+| ?[\[(]dot[\])] ?[\w-]+| dot [\w-]+)+| ?[\[(]at[\])] ?[\w-]+(?:\.[\w-]+| ?[\[(]dot[\])] ?[\w-]+)+| at [\w-]+(?: dot [\w-]+)+)",
        r"\d+(?:[.\[\]() ]+\d+){3}",
        r"\d(?:[ ./_-]?\d)+",
        r"[+(]?\d[\d ()./-]*\d",
    )
]
#: Digits that a span of each kind but email must hold to be added (least, most).
_SIZES = {1: (4, 12), 2: (14, 19), 3: (7, 15)}


def plausible(piece: str, kind: int) -> bool:
    """Whether a span that the network found can be of its kind: allowed characters, number of digits, byte values, checksum."""
    if not _FORMS[kind].fullmatch(piece.lower()):
        return False
    if kind == 0:
        return True
    digits = "".join(c for c in piece if "0" <= c <= "9")
    low, high = _SIZES[kind]
    if not low <= len(digits) <= high:
        return False
    if kind == 1:
        return all(int(p) < 256 for p in re.findall("[0-9]+", piece))
    return kind != 2 or luhn(digits)


def find_all(texts: list[str], net: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text. Added spans overlap no base span, are trimmed, and are plausible."""
    out = []
    for text, found in zip(texts, model_spans(texts, net), strict=True):
        base, added = base_spans(text), []
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        for a, b, k in found:
            while a < b and text[a] in " \n.,;:":
                a += 1
            while b > a and text[b - 1] in " \n.,;:":
                b -= 1
            before = bisect_left(starts, b)  # base spans that start before this one ends
            if a < b and not (before and reach[before - 1] > a) and plausible(text[a:b], k):
                added.append((a, b, k))
        out.append((base, added))
    return out


def _batches(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            yield part, strings(part.column(1))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base counts by kind, the digest of the base spans, and all spans (kind:start:end in code points).

    A null text is empty, without spans. Repeated rows give repeated results; null ids are kept; an empty table
    gives no rows; other columns are ignored. A text of any length is labelled whole, at about 60 bytes of memory a character.
    Of labels that score alike the first by number is taken.
    """
    net = docs.sparkSession.sparkContext.broadcast(train().p)  # a fixed size, about 30 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.__new__(Tagger)
        tagger.p = net.value
        for part, texts in _batches(batches):
            rows = []
            for base, added in find_all(texts, tagger):
                counts = [sum(k == kind for _, _, k in base) for kind in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return slim(docs, id_col, text_col).toDF("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in angle brackets; overlapping spans are one.

    Null texts stay null. The length column, if there is one, gets the new number of code points.
    """
    net = docs.sparkSession.sparkContext.broadcast(train().p)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger.__new__(Tagger)
        tagger.p = net.value
        for batch in batches:
            column = batch.column(at)
            texts = column.to_pylist()
            for i in range(0, len(texts), 1024):
                some = [x or "" for x in texts[i : i + 1024]]
                for j, (base, added) in enumerate(find_all(some, tagger)):
                    spans, text, end = sorted(base + added), some[j], 0
                    if not spans:
                        continue
                    out = []
                    for a, b, k in spans:
                        if a >= end:
                            out += [text[end:a], f"<{KINDS[k]}>"]
                        end = max(end, b)
                    texts[i + j] = "".join(out) + text[end:]
            arrays = batch.columns
            arrays[at] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if length_col in columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
