"""Personal data: fixed patterns, and a character-level tagger that adds to them.

The tagger is a bidirectional LSTM over characters with a CRF over BIO tags, both
trained in numpy on labelled spans that a seeded generator plants in made-up prose
(``python -m pagequarry.llm.pii`` trains it and writes ``tagger.npz`` beside this file).
A decoded span stands if the CRF's posterior for it reaches ``MIN_POSTERIOR``, if it
touches no base span, and if it holds what its kind needs whatever its shape
(``needs``): a card's check digit and a number of digits, four numbers below 256, an
at sign and a dot in one spelling or another.

Only stretches around marks are read, and a skipped one cannot hold a span that
``needs`` lets pass: numbers need four digits near each other, addresses an at and a dot
near each other. A stretch goes WINDOW characters beyond its marks. It is read in
overlapping windows whose emissions are averaged by the distance to the window's edge,
and one Viterbi pass decodes the joined stretch as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, bounded, id_type, keyed, map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STEP = 96, 48
HIDDEN = 28  # of each direction
SEED = 42
TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 24576, 10, 64, 0.008
MIN_POSTERIOR = 0.6
AT_ONCE = 1024  # windows decoded together
LONG = 96 * STEP  # characters of a stretch that is decoded by itself, in parts; a multiple of STEP, so windows stay the same
WEIGHTS = Path(__file__).with_name("tagger.npz")

_NAME_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a run of digits matches from its first one or not at all
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_AT = r"(?:@|(?<![A-Za-z])[aA][tT](?![A-Za-z]))"
_DOT = r"(?:\.(?=[\])]?[A-Za-z0-9])|(?<=\x20)\.(?=\x20)|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z]))"
FAR = 80  # characters between an at and its dot at most; labels of hosts have 63
_ADDRESS = re.compile(rf"{_AT}(?=(?s:.{{1,{FAR}}}?){_DOT})")
_DOTS = re.compile(_DOT)
_NUMBERS = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,4}(?:(?<=[^A-Za-z])[dD][oO][tT](?=[^A-Za-z])[^0-9A-Za-z]{0,4})?[0-9]){3,}")


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in linear time: from each at sign
    the host to the right, and to the left all signs of a name that no match before has used."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = text[free:at]
        name = len(left) - len(left.rstrip(_NAME_SIGNS))
        free = at + 1
        if name and (m := _HOST.match(text, at + 1)):
            out.append((at - name, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for k, d in enumerate(reversed(digits))) % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    runs = _DIGITS.findall(found)
    if kind == "ip":
        return all(len(r.lstrip("0")) <= 3 and int(r.lstrip("0") or 0) <= 255 for r in runs)
    digits = "".join(runs)
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that hold, by kind, then start."""
    out = [("email", a, b) for a, b in addresses(text)]
    for kind, pattern, sign in (("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
        if sign in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return out


# The tagger


def _codes(text: str) -> np.ndarray:
    """Characters as classes: printable ASCII, line ends, letters beyond ASCII, others."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((c >= 32) & (c < 127), c - 31, np.where(c == 10, 96, np.where(c > 127, 97, 98))).astype(np.int16)


CLASSES = 99  # 0 pads


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(xs: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """xs: classes (batch, time). Returns hidden states (time, batch, hidden) and what backpropagation needs."""
    n, t = xs.shape
    h, c, hs, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((t, n, HIDDEN), np.float32), []
    for k in range(t):
        z = wx[xs[:, k]] + h @ wh + b
        ifo, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        new = f * c + i * g
        tc = np.tanh(new)
        if keep:
            kept.append((i, f, o, g, c, tc, h))
        c, h = new, o * tc
        hs[k] = h
    return hs, kept


def _lstm_back(xs: np.ndarray, dhs: np.ndarray, wh: np.ndarray, kept: list, grads: list[np.ndarray]) -> None:
    gx, gh, gb = grads
    dzs = np.empty((len(kept), len(xs), 4 * HIDDEN), dhs.dtype)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for k in range(len(kept) - 1, -1, -1):
        i, f, o, g, c, tc, h = kept[k]
        dh = dh + dhs[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dzs[k] = dz
        gh += h.T @ dz
        gb += dz.sum(0)
        dh, dc = dz @ wh.T, dc * f
    gx += (xs.T.ravel()[:, None] == np.arange(CLASSES)).astype(dzs.dtype).T @ dzs.reshape(-1, 4 * HIDDEN)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Weights of the two directions (input, hidden, bias), the output layer and the CRF's transitions."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.p = [p for _ in range(2) for p in (draw(CLASSES, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32))]
        for b in (self.p[2], self.p[5]):
            b[HIDDEN : 2 * HIDDEN] = 1
        self.p += [draw(2 * HIDDEN, len(TAGS)), np.zeros(len(TAGS), np.float32), np.zeros((len(TAGS), len(TAGS)), np.float32)]
        self.allowed = np.array([[b[0] != "I" or a[1:] == b[1:] and a[0] in "BI" for b in TAGS] for a in TAGS])

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p[8], np.float32(-1e4))

    def emissions(self, xs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of each tag, (time, batch, tags)."""
        p = self.p
        ahead, kept = _lstm(xs, *p[:3], keep)
        back, kept_back = _lstm(xs[:, ::-1], *p[3:6], keep)
        both = np.concatenate([ahead, back[::-1]], 2)
        return both @ p[6] + p[7], (both, kept, kept_back)

    def gradients(self, xs: np.ndarray, ys: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of tag paths ys (batch, time) and its gradients."""
        e, (both, kept, kept_back) = self.emissions(xs, True)
        tr, (t, n, k) = self.transitions(), e.shape
        start = np.where([x[0] == "I" for x in TAGS], np.float32(-1e4), np.float32(0))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + start
        for s in range(1, t):
            alpha[s] = e[s] + _lse(alpha[s - 1][:, :, None] + tr, 1)
        for s in range(t - 2, -1, -1):
            beta[s] = _lse(tr + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de, dt, rows = np.exp(alpha + beta - z[None, :, None]), np.zeros_like(tr), np.arange(n)
        gold = (start[ys[:, 0]]).astype(np.float64)
        for s in range(t):
            de[s, rows, ys[:, s]] -= 1
            gold += e[s, rows, ys[:, s]]
            if s:
                dt += np.exp(alpha[s - 1][:, :, None] + tr + (e[s] + beta[s])[:, None, :] - z[:, None, None]).sum(0)
                np.add.at(dt, (ys[:, s - 1], ys[:, s]), -1)
                gold += tr[ys[:, s - 1], ys[:, s]]
        de, grads = de / n, [np.zeros_like(p) for p in self.p]
        grads[6] += np.einsum("tnh,tnk->hk", both, de)
        grads[7] += de.sum((0, 1))
        grads[8] += np.where(self.allowed, dt / n, 0)
        dh = de @ self.p[6].T
        _lstm_back(xs, dh[:, :, :HIDDEN], self.p[1], kept, grads[:3])
        _lstm_back(xs[:, ::-1], dh[::-1, :, HIDDEN:], self.p[4], kept_back, grads[3:6])
        return float((z - gold).mean()), grads

    def train(self, xs: np.ndarray, ys: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> list[float]:
        """Adam with clipped gradients and a falling rate; returns the loss of each step."""
        r, m, v, step, losses = np.random.default_rng(seed), [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0, []
        total = epochs * (len(xs) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(xs))
            for at in range(0, len(xs) - BATCH + 1, BATCH):
                loss, grads = self.gradients(xs[order[at : at + BATCH]], ys[order[at : at + BATCH]])
                norm, step = float(np.sqrt(sum((g * g).sum() for g in grads))), step + 1
                rate = RATE * (1 - 0.9 * step / total)
                for k, g in enumerate(grads):
                    g = g * min(1, 5 / max(norm, 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                losses.append(loss)
        return losses

    def decode_all(self, es: list[np.ndarray]) -> list[list[tuple[str, int, int]]]:
        """Spans of the best tag path for each array of emissions (time, tags)."""
        size = np.array([len(e) for e in es])
        n, t, k = len(es), int(size.max(initial=0)), len(TAGS)
        if not n or not t:
            return [[] for _ in es]
        tr, padded, back = self.transitions(), np.zeros((t, n, k), np.float32), np.empty((t, n, k), np.int8)
        for i, e in enumerate(es):
            padded[: len(e), i] = e
        score = padded[0] + _START
        for s in range(1, t):
            both = score[:, :, None] + tr
            open_ = s < size
            back[s] = np.where(open_[:, None], both.argmax(1), np.arange(k))
            score = np.where(open_[:, None], both.max(1) + padded[s], score)
        path = np.empty((t, n), np.int8)
        path[-1] = score.argmax(1)
        for s in range(t - 1, 0, -1):
            path[s - 1] = back[s][np.arange(n), path[s]]
        return [_spans(path[:m, i]) for i, m in enumerate(size.tolist())]

    def decode(self, e: np.ndarray) -> list[tuple[str, int, int]]:
        return self.decode_all([e])[0]

    def posterior(self, e: np.ndarray, kind: str, start: int, end: int) -> float:
        """The chance that just this span is tagged, of all tag paths for emissions (time, tags)."""
        tr, t, e = self.transitions().astype(float), len(e), e.astype(float)
        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[0] = e[0] + _START
        for s in range(1, t):
            alpha[s] = e[s] + _lse(alpha[s - 1][:, None] + tr, 0)
        for s in range(t - 2, end - 1, -1):
            beta[s] = _lse(tr + (e[s + 1] + beta[s + 1])[None, :], 1)
        b = TAGS.index(f"B-{kind}")
        i = b + 1
        inside = alpha[start, b] + sum(e[s, i] for s in range(start + 1, end)) + (tr[b, i] + (end - start - 2) * tr[i, i] if end > start + 1 else 0)
        rest = 0.0
        if end < t:
            after = tr[i if end > start + 1 else b] + e[end] + beta[end]
            rest = float(_lse(np.delete(after, i), 0))
        return float(np.exp(inside + rest - _lse(alpha[-1], 0)))


_START = np.array([-1e4 if x[0] == "I" else 0 for x in TAGS], np.float32)


def _spans(path: np.ndarray) -> list[tuple[str, int, int]]:
    out = []
    for at in np.flatnonzero([TAGS[x][0] == "B" for x in path]) if path.any() else []:
        end = at + 1
        while end < len(path) and path[end] == path[at] + 1:
            end += 1
        out.append((TAGS[path[at]][2:], int(at), int(end)))
    return out


# Training data


# Words that stand in names, hosts and running text, so that made-up ones are not all the tagger knows.
_NAMES = "john jane doe smith anna maria peter paul laura thomas info contact sales support office admin press jobs team hello".split()
_HOSTS = "mail web example company university host server site gmail yahoo outlook post shop school news online institute bank city".split()
_PROSE = (
    "the of and to in is you that it he was for on are as with his they at be this from have or by one had not but what all were when we there can an your which "
    "their if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who "
    "now people my made over did down only way find use may long little very after words called just where most know please write read look today here again"
).split()


def _word(r: random.Random, low: int = 2, high: int = 9) -> str:
    if r.random() < 0.3 and low == 2:
        return r.choice(_NAMES if high == 9 else _HOSTS)
    return "".join(r.choice("aeioustnrldmchpbgkfvwz") for _ in range(r.randrange(low, high)))


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> str:
    name = _word(r) + r.choice(["", "", ".", "_", "-"]) + r.choice([_word(r), _number(r, 2), _word(r) + _number(r, 1)])
    labels = [_word(r, 2, 14) + r.choice(["", "", "", "-" + _word(r), _number(r, 1)]) for _ in range(r.choice([1, 1, 1, 2, 2]))] + [r.choice("com org net de fr es edu gov io uk info eu ch at".split())]
    a, b = r.choice([("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"), (" (", ") "), (" [", "] "), (" {", "} "), ("( ", " )")])
    said = r.choice([str.lower, str.lower, str.upper, str.capitalize])
    at, dot = r.choice([("@", "."), (" @ ", "."), (" @ ", " . "), ("[@]", "[.]"), (a + said("at") + b, a + said("dot") + b), (a + said("at") + b, a + said("dot") + b), (a + said("at") + b, "."), (f" {said('at')} ", f" {said('dot')} "), (f" {said('at')} ", f" {said('dot')} "), (f"_{said('at')}_", f"_{said('dot')}_"), ("@", f" {said('dot')} ")])
    first = labels[0] + "".join(dot + x for x in labels[1:])
    return r.choice([str, str, str, str.capitalize])(name) + at + first


def _ip(r: random.Random) -> str:
    return r.choice([".", ".", ".", "[.]", "(.)", " . ", "[dot]", " dot ", " (dot) ", "(dot)"]).join(str(r.randrange(256)) for _ in range(4))


def _card(r: random.Random) -> str:
    sizes = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (16,), (4, 4, 4, 4, 3), (4, 6, 6)])
    d = _number(r, sum(sizes) - 1)
    d, out = next(d + c for c in "0123456789" if luhn(d + c)), []
    for n in sizes:
        out.append(d[:n])
        d = d[n:]
    return r.choice(["", " ", "-", ".", "_", "/", " - ", "  "]).join(out)


def _phone(r: random.Random) -> str:
    a, b, c, cc = (_number(r, n) for n in (3, 3, 4, 2))
    area = "0" + r.choice("123456789") + _number(r, r.randrange(1, 4))
    return r.choice([
        f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc} {a} {b}{c}", f"00{cc} {a} {b}{c}", f"00{cc} {a} {b} {c}", f"+1-{a}-{b}-{c}",
        f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"{area} {b}{c}", f"{area}/{b}{c}", f"{area}-{b}{c}", f"0{r.randrange(1, 8)} " + " ".join(_number(r, 2) for _ in range(4)), f"0{r.randrange(1, 8)}." + ".".join(_number(r, 2) for _ in range(4)), f"({area}) {b} {c}",
    ])


def _lookalike(r: random.Random) -> str:
    """What is no personal data, though it has digits or the words at and dot."""
    hexa, n = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40, 64]))), lambda k: _number(r, k)
    year, month, day = r.randrange(1800, 2100), f"{r.randrange(1, 13):02}", f"{r.randrange(1, 29):02}"
    return r.choice([
        n(r.randrange(1, 8)), n(r.randrange(8, 24)), f"{year}", f"{year}-{year + r.randrange(90)}", f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}{month}{day}", f"{year}-{month}-{day}T{day}:{n(2)}:{n(2)}Z", f"{day}:{n(2)}", f"{day}:{n(2)}:{n(2)}.{n(3)}",
        f"version {r.randrange(9)}.{r.randrange(30)}", f"{r.randrange(9)}.{r.randrange(30)}.{r.randrange(99)}", f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(9)}-rc{r.randrange(9)}", f"({year}) {n(3)}", hexa, f'"{hexa}"', f"{hexa[:8]}-{n(4)}-4{n(3)}-a{n(3)}-{hexa[:8]}{n(4)}", f"AKIA{hexa.upper()[:16]}",
        f"{n(2)}.{n(3)},{n(2)}", f"{n(1)},{n(3)},{n(3)}", f"{n(2)} {n(3)} {n(3)}", f"{n(1)}.{n(3)}.{n(3)}", f"$ {n(3)}.{n(2)}", f"{n(2)} %", f"{n(2)}.{n(4)}, {n(2)}.{n(4)}", f"-{n(2)}.{n(6)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"ISBN {n(10)}", f"#{n(6)}", f"No. {n(5)}-{n(2)}", f"id={n(9)}", f"{n(2)} + {n(2)} = {n(3)}", f"{n(3)} x {n(3)}", f"pp. {n(3)}-{n(3)}", f"{n(1)}.{n(1)}.{n(1)}.", f"1 2 3 4 5 6 7 8 9", f"{n(2)} {n(2)} {n(2)}", f"{n(4)} {n(4)}", f"{n(5)}-{n(4)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(10)}", f"{n(13)}",
        " at ", f"at {n(2)}.{n(2)}", f"at {_word(r)} {_word(r)}", f"at www.{_word(r)}.com", f"at {_word(r)}.org", f"{_word(r)} at the dot", f"at {_word(r)} the dot {_word(r)}", f"a dot at {_word(r)}", f"polka dot {_word(r)}", f"at home.{_word(r)}", f"http://{_word(r)}.{_word(r)}.com/{_word(r)}?{n(4)}={n(3)}", f"www.{_word(r)}.de", f"{_word(r)}.{_word(r)}", f"@{_word(r)}", f"{_word(r)} @ {n(2)}.{n(2)}", f"{_word(r)}@{_word(r)}",
    ])


def _planted(r: random.Random) -> tuple[str, str | None]:
    """A made-up item of personal data with its kind, or a look-alike with None."""
    pick = r.randrange(20)
    if pick < 5:
        return _email(r), "email"
    if pick < 7:
        return _ip(r), "ip"
    if pick < 9:
        return _card(r), "card"
    return (_phone(r), "phone") if pick < 12 else (_lookalike(r), None)


_SYLLABLES = "the er ing on re tion an ou ly es en ich sch ver de la que é è ción os ado ß ü at dot th st men ab or".split()


def made_up(r: random.Random, size: int) -> tuple[str, list[tuple[str, int, int]]]:
    """Made-up prose of at least so many characters, and its labelled spans."""
    text, spans, noise, shouts, english, rate = "", [], r.random() < 0.1, r.random() < 0.06, r.random() < 0.4, r.choice([0.06, 0.15, 0.3])
    while len(text) < size:
        if r.random() < rate:
            item, kind = _planted(r)
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item
        else:
            word = r.choice(_PROSE) if english else "".join(r.choice(_SYLLABLES) for _ in range(r.randrange(1, 4)))
            text += r.choice([word, word, word, word, word.capitalize(), r.choice("mail call tel phone card ip from to write server token key or and see".split())])
            text = text.upper() if shouts and not spans else text
        text += r.choice(["$$$ ", "&&& ", "### ", "%%% ", "!! ", "*** "]) if noise else r.choice([" "] * 14 + [", ", ", ", ". ", ".\n", "\n", "; ", ": ", '" ', " | ", " (", ") ", " = "])
    return text, spans


def labelled_windows(n: int = TRAIN_WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags, (n, WINDOW), cut at random from made-up prose with labelled spans."""
    r = random.Random(seed)
    xs, ys = np.zeros((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int16)
    for row in range(n):
        text, spans = made_up(r, WINDOW + 60)
        tags = np.zeros(len(text), np.int16)
        for kind, s, e in spans:
            tags[s:e] = TAGS.index(f"I-{kind}")
            tags[s] -= 1
        at = r.randrange(len(text) - WINDOW)
        cut = tags[at : at + WINDOW].copy()
        if cut[0] and TAGS[cut[0]][0] == "I":
            cut[0] -= 1  # a span that begins before the window begins with it here
        xs[row], ys[row] = _codes(text[at : at + WINDOW]), cut
    return xs, ys


def train_and_save(path: Path = WEIGHTS, windows: int = TRAIN_WINDOWS, epochs: int = EPOCHS) -> Tagger:
    tagger = Tagger()
    tagger.train(*labelled_windows(windows), epochs=epochs)
    np.savez_compressed(path, *[p.astype(np.float16) for p in tagger.p])
    return trained.__wrapped__(path)


@functools.lru_cache(1)
def trained(path: Path = WEIGHTS) -> Tagger:
    """The tagger with the weights of train_and_save(), which no corpus changes."""
    tagger = Tagger()
    with np.load(path) as held:
        tagger.p = [held[f"arr_{k}"].astype(np.float32) for k in range(len(tagger.p))]
    return tagger


# Windows


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of the text around marks, joined where they meet."""
    marks = [(m.start(), m.end()) for m in _NUMBERS.finditer(text)]
    low = "@" in text or "at" in text.lower()
    for m in _ADDRESS.finditer(text) if low else ():
        end = m.end()
        while d := _DOTS.search(text, end + 1, end + 1 + FAR):  # all of its dots belong to the address
            end = d.end()
        marks.append((m.start(), end))
    out: list[tuple[int, int]] = []
    for a, b in sorted(marks):
        start, end = max(0, a - WINDOW), min(len(text), b + WINDOW)
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _weights() -> np.ndarray:
    return (np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1).astype(np.float32)


def _windows(codes: np.ndarray) -> np.ndarray:
    n = 1 + max(0, -(-(len(codes) - WINDOW) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.int16)
    padded[: len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def _merged(e: np.ndarray, size: int) -> np.ndarray:
    """Emissions of a stretch from those of its windows (time, windows, tags)."""
    w, n = _weights(), e.shape[1]
    total, weight = np.zeros(((n - 1) * STEP + WINDOW, len(TAGS)), np.float32), np.zeros((n - 1) * STEP + WINDOW, np.float32)
    for k in range(n):
        total[k * STEP : k * STEP + WINDOW] += e[:, k] * w[:, None]
        weight[k * STEP : k * STEP + WINDOW] += w
    return (total / weight[:, None])[:size]


def _long(tagger: Tagger, codes: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans of a long stretch: parts of it are decoded with LONG / 4 more on either side, and each span is
    taken from the part that it begins in, so memory is bounded whatever the length."""
    out, more = [], LONG // 4
    for at in range(0, len(codes), LONG // 2):
        begin, end = max(0, at - more), min(len(codes), at + LONG // 2 + more)
        part = codes[begin:end]
        e = _merged(tagger.emissions(_windows(part))[0], len(part))
        out += [(k, begin + s, begin + f) for k, s, f in tagger.decode(e) if at <= begin + s < at + LONG // 2]
    return out


def tag(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger decodes in each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # text, start, classes, windows
    count = 0

    def flush() -> None:
        nonlocal count
        if not held:
            return
        unique, back = np.unique(np.concatenate([w for *_, w in held]), axis=0, return_inverse=True)
        e = np.concatenate([tagger.emissions(unique[a : a + AT_ONCE])[0] for a in range(0, len(unique), AT_ONCE)], 1)
        row, merged, back = 0, [], back.ravel()
        for _, _, codes, w in held:
            merged.append(_merged(e[:, back[row : row + len(w)]], len(codes)))
            row += len(w)
        for (which, start, _, _), found in zip(held, tagger.decode_all(merged)):
            out[which] += [(kind, start + s, start + f) for kind, s, f in found]
        held.clear()
        count = 0

    for which, text in enumerate(texts):
        for start, end in stretches(text):
            codes = _codes(text[start:end])
            if len(codes) > LONG:
                out[which] += [(kind, start + s, start + f) for kind, s, f in _long(tagger, codes)]
                continue
            held.append((which, start, codes, _windows(codes)))
            count += len(held[-1][3])
            if count >= AT_ONCE:
                flush()
    flush()
    return out


def needs(kind: str, found: str) -> bool:
    """Whether the text of a span holds what its kind cannot do without, in any shape."""
    if kind == "email":
        return bool(_ADDRESS.search(found))
    runs = _DIGITS.findall(found)
    if not _NUMBERS.search(found):
        return False
    if kind == "ip":
        return len(runs) == 4 and _holds("ip", found)
    digits = "".join(runs)
    return 7 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def added_spans(tagger: Tagger, text: str, found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Of the decoded spans those that touch no base span, hold what they need, and are likely enough."""
    out, free = [], apart(taken)
    for kind, s, e in found:
        if not free(s, e) or not needs(kind, text[s:e]):
            continue
        begin = max(0, s - WINDOW)
        part = _codes(text[begin : e + WINDOW])
        if tagger.posterior(_merged(tagger.emissions(_windows(part))[0], len(part)), kind, s - begin, e - begin) >= MIN_POSTERIOR:
            out.append((kind, s, e))
    return out


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """For each text the base spans, and these with the tagger's, both by kind, then start."""
    out = []
    for text, found in zip(texts, tag(tagger, texts)):
        base = base_spans(text)
        added = added_spans(tagger, text, found, [(s, e) for _, s, e in base]) if found else []
        out.append((base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), *x[1:])) if added else base))
    return out


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end_; code points, end exclusive) of every row.

    Null and empty texts have no spans; repeated rows and null ids stay as they are, each
    with its result; very long texts are read in full, in parts of bounded size; an empty
    table gives no rows. Of base spans of two kinds that overlap both are kept.
    """
    tagger = trained()

    def run(batch):
        both = all_spans(tagger, texts_of(batch.column(1)))
        dicts = [[[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in part] for part in zip(*both)]
        return {"doc_id": batch.column(0), "base": dicts[0], "spans": dicts[1]}

    span = "array<struct<kind: string, start: int, end: int>>"
    return map_batches(keyed(docs, id_col, text_col), run, f"doc_id {id_type(docs, id_col)}, base {span}, spans {span}")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of every row; odd rows are as in find()."""
    found = find(docs)
    told_ = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(told_(F.col("base")), 256).alias("base_sha256"), told_(F.col("spans")).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of the first of them in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with spans masked in its text column; all other columns, and null texts, stay.
    Repeated rows and null ids are rows like any other; an empty table stays empty; very long texts are read
    in full, in parts of bounded size; columns of any name are carried along."""
    tagger, schema = trained(), docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            old = batch.column(at).to_pylist()
            texts = ["" if t is None else t for t in old]
            new = [t if t is None else mask(t, spans) for t, (_, spans) in zip(old, all_spans(tagger, texts))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return bounded(docs).mapInArrow(run, schema)


if __name__ == "__main__":
    train_and_save()
