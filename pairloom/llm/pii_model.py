"""Character tagger for personal information: bidirectional LSTM with CRF transitions, in numpy.

Each character is two symbols, its letter without case and accents (all digits are one) and its class. The LSTM reads
windows in both directions, a linear layer scores the tags, the CRF scores their order. Training is maximum likelihood
with Adam; gradients are written out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

TYPES = ("email", "phone", "idnum", "street", "person")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
K = len(TAGS)

#: Plain symbols; other characters share a symbol by their kind.
SYMBOLS = " abcdefghijklmnopqrstuvwxyz0@.,-+_()[]/#'\":;!?$%&*=<>|~\n"
_KINDS = ("pad", "letter", "mark", "sign", "space", "picture")
N_SYMBOLS = len(SYMBOLS) + len(_KINDS)
N_CLASSES = 6

WEIGHTS = Path(__file__).with_name("pii_weights.npz")


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol and class of every code point of the basic plane."""
    symbol, kind = np.zeros(65_536, np.uint8), np.zeros(65_536, np.uint8)
    place = {c: i + len(_KINDS) for i, c in enumerate(SYMBOLS)}
    for code in range(65_536):
        char = chr(code)
        category = unicodedata.category(char)
        base = unicodedata.normalize("NFKD", char)[:1].lower() if category != "Cs" else ""
        if category == "Nd":
            base = "0"
        elif category == "Pd":
            base = "-"
        elif category == "Zs":
            base = " "
        if base in place:
            symbol[code] = place[base]
        else:
            symbol[code] = 1 if category[0] == "L" else 2 if category[0] == "M" or category == "Cf" else 5 if category[0] in "SC" else 3
        kind[code] = 1 if category == "Lu" or category == "Lt" else 2 if category[0] == "L" else 3 if category[0] == "N" else 4 if category[0] in "ZC" else 5
    return symbol, kind


def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and classes of a text, one each per code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol, kind = tables()
    low = np.minimum(points, 65_535)
    return np.where(points > 65_535, 5, symbol[low]).astype(np.uint8), np.where(points > 65_535, 5, kind[low]).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """The network; ``p`` holds its parameters by name."""

    def __init__(self, hidden: int = 40, symbols: int = 20, classes: int = 6, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        d, h = symbols + classes, hidden
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"symbols": scale(N_SYMBOLS, symbols) * 2, "classes": scale(N_CLASSES, classes) * 2, "out": scale(2 * h, K), "bias": np.zeros(K, np.float32), "order": np.zeros((K, K), np.float32), "first": np.zeros(K, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": scale(d, 4 * h), f"h{side}": scale(h, 4 * h), f"c{side}": np.zeros(4 * h, np.float32)}
            self.p[f"c{side}"][h : 2 * h] = 1

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Tagger:
        with np.load(path) as stored:
            values = {k: stored[k].astype(np.float32) for k in stored.files}
        made = cls(values["hf"].shape[0])
        made.p = values
        return made

    def save(self, path: Path = WEIGHTS) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _inputs(self, side: str) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol and each class adds to the gates: the input layer as two tables."""
        d = self.p["symbols"].shape[1]
        x = self.p[f"x{side}"]
        return self.p["symbols"] @ x[:d], self.p["classes"] @ x[d:] + self.p[f"c{side}"]

    def scores(self, symbols: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Tag scores [T, B, K] of windows given as [T, B]; runs forward only."""
        t, b = symbols.shape
        h = self.hidden
        out = np.zeros((t, b, K), np.float32) + self.p["bias"]
        for side, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            by_symbol, by_class = self._inputs(side)
            w, top = self.p[f"h{side}"], self.p["out"][:h] if side == "f" else self.p["out"][h:]
            state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
            for i in steps:
                gates = by_symbol[symbols[i]]
                gates += by_class[classes[i]]
                gates += state @ w
                act = gates[:, : 3 * h]
                np.negative(act, out=act)
                np.exp(act, out=act)
                act += 1
                np.reciprocal(act, out=act)
                new = np.tanh(gates[:, 3 * h :])
                cell *= gates[:, h : 2 * h]
                new *= gates[:, :h]
                cell += new
                state = np.tanh(cell)
                state *= gates[:, 2 * h : 3 * h]
                out[i] += state @ top
        return out

    def _run(self, side: str, symbols: np.ndarray, classes: np.ndarray) -> dict[str, np.ndarray]:
        t, b = symbols.shape
        h = self.hidden
        by_symbol, by_class = self._inputs(side)
        w = self.p[f"h{side}"]
        keep = {k: np.zeros((t, b, h), np.float32) for k in ("i", "f", "o", "g", "c", "h")}
        state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            gates = by_symbol[symbols[i]] + by_class[classes[i]] + state @ w
            s = _sigmoid(gates[:, : 3 * h])
            keep["i"][i], keep["f"][i], keep["o"][i] = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            keep["g"][i] = np.tanh(gates[:, 3 * h :])
            cell = keep["f"][i] * cell + keep["i"][i] * keep["g"][i]
            state = keep["o"][i] * np.tanh(cell)
            keep["c"][i], keep["h"][i] = cell, state
        return keep

    def _back(self, side: str, keep: dict[str, np.ndarray], d_states: np.ndarray, symbols: np.ndarray, classes: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        t, b, h = keep["h"].shape
        w = self.p[f"h{side}"]
        d_gates = np.zeros((t, b, 4 * h), np.float32)
        d_state, d_cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        order = range(t - 1, -1, -1) if side == "f" else range(t)
        step = 1 if side == "f" else -1
        for i in order:
            d_state = d_state + d_states[i]
            before = i - step
            inside = 0 <= before < t
            c_before = keep["c"][before] if inside else np.zeros((b, h), np.float32)
            tanh = np.tanh(keep["c"][i])
            d_cell = d_cell + d_state * keep["o"][i] * (1 - tanh**2)
            d = d_gates[i]
            d[:, :h] = d_cell * keep["g"][i] * keep["i"][i] * (1 - keep["i"][i])
            d[:, h : 2 * h] = d_cell * c_before * keep["f"][i] * (1 - keep["f"][i])
            d[:, 2 * h : 3 * h] = d_state * tanh * keep["o"][i] * (1 - keep["o"][i])
            d[:, 3 * h :] = d_cell * keep["i"][i] * (1 - keep["g"][i] ** 2)
            if inside:
                grads[f"h{side}"] += keep["h"][before].T @ d
            d_state = d @ w.T
            d_cell = d_cell * keep["f"][i]
        flat, s, c = d_gates.reshape(-1, 4 * h), symbols.ravel(), classes.ravel()
        by_symbol, by_class = np.zeros((N_SYMBOLS, 4 * h), np.float32), np.zeros((N_CLASSES, 4 * h), np.float32)
        np.add.at(by_symbol, s, flat)
        np.add.at(by_class, c, flat)
        n = self.p["symbols"].shape[1]
        x = self.p[f"x{side}"]
        grads[f"x{side}"][:n] += self.p["symbols"].T @ by_symbol
        grads[f"x{side}"][n:] += self.p["classes"].T @ by_class
        grads["symbols"] += by_symbol @ x[:n].T
        grads["classes"] += by_class @ x[n:].T
        grads[f"c{side}"] += by_class.sum(0)

    def loss(self, symbols: np.ndarray, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradients."""
        t, b = symbols.shape
        h = self.hidden
        keep = {side: self._run(side, symbols, classes) for side in "fb"}
        both = np.concatenate((keep["f"]["h"], keep["b"]["h"]), 2)
        score = both @ self.p["out"] + self.p["bias"]
        order, first = self.p["order"], self.p["first"]

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

        alpha, beta = np.zeros((t, b, K), np.float32), np.zeros((t, b, K), np.float32)
        alpha[0] = score[0] + first
        for i in range(1, t):
            alpha[i] = score[i] + log_sum(alpha[i - 1][:, :, None] + order, 1)
        for i in range(t - 2, -1, -1):
            beta[i] = log_sum(order + (score[i + 1] + beta[i + 1])[:, None, :], 2)
        whole = log_sum(alpha[-1], 1)
        here = np.exp(alpha + beta - whole[None, :, None])
        rows = np.arange(b)
        path = first[tags[0]] + sum(score[i, rows, tags[i]] for i in range(t)) + sum(order[tags[i - 1], tags[i]] for i in range(1, t))
        d_score = here
        np.subtract.at(d_score, (np.arange(t)[:, None], rows[None, :], tags), 1)
        d_score /= b
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["first"] = d_score[0].sum(0)
        moved = np.zeros((K, K))
        for i in range(1, t):
            moved += np.exp(alpha[i - 1][:, :, None] + order + (score[i] + beta[i] - whole[:, None])[:, None, :]).sum(0)
        np.subtract.at(moved, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        grads["order"] = (moved / b).astype(np.float32)
        grads["out"] = both.reshape(-1, 2 * h).T @ d_score.reshape(-1, K)
        grads["bias"] = d_score.sum((0, 1))
        d_both = d_score @ self.p["out"].T
        self._back("f", keep["f"], d_both[:, :, :h], symbols, classes, grads)
        self._back("b", keep["b"], d_both[:, :, h:], symbols, classes, grads)
        return float((whole - path).mean()), grads


class Adam:
    """Adam with gradient clipping."""

    def __init__(self, model: Tagger, rate: float = 0.003) -> None:
        self.rate, self.step_no = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def step(self, model: Tagger, grads: dict[str, np.ndarray]) -> None:
        self.step_no += 1
        norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
        clip = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * clip
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g**2 - self.v[k])
            model.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.step_no)) / (np.sqrt(self.v[k] / (1 - 0.999**self.step_no)) + 1e-8)).astype(np.float32)


def allowed() -> np.ndarray:
    """Which tag may follow which: an inner tag only after a tag of its own type."""
    ok = np.ones((K, K), bool)
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = [x != "O" and x[2:] == tag[2:] for x in TAGS]
    return ok


def best_paths(score: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Best tags [B, T] of scores [B, T, K] that stand between outside tags, with the forbidden orders left out."""
    b, t, _ = score.shape
    order = np.where(allowed(), order, -1e9).astype(np.float32)
    score = np.ascontiguousarray(score.transpose(1, 2, 0))  # texts last, so that every step runs along them
    best = np.empty((t, K, b), np.float32)
    best[0] = score[0] + order[0][:, None]
    total = np.empty((K, K, b), np.float32)
    for i in range(1, t):
        np.add(best[i - 1][:, None, :], order[:, :, None], out=total)
        np.max(total, axis=0, out=best[i])
        best[i] += score[i]
    out = np.zeros((b, t), int)
    out[:, -1] = (best[-1] + order[:, 0][:, None]).argmax(0)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = (best[i - 1] + order[:, out[:, i]]).argmax(0)
    return out


#: Window lengths; text longer than the last is read in windows of it that overlap by twice the margin.
WINDOWS, MARGIN, BATCH = (64, 128, 192, 256), 48, 512

#: Characters whose paths are sought side by side, and whose scores are held at once.
PATH_CELLS, TEXT_CELLS = 400_000, 400_000

#: A text longer than the first is read in pieces of it that overlap by the second.
LONGEST, OVERLAP = 200_000, 2_000

#: A search for spans ends where outside leads by ``CLEAR`` nats beside all that the tags' order can add, for twice
#: ``EDGE`` characters.
CLEAR, EDGE = 0.3, 16


def open_stretches(scores: list[np.ndarray], order: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the stretches of scores [T, K] that have to be searched; all else is outside.

    Of the stretches between clear ones those are dropped in which no span can pay: a span begins with a tag B, so its
    gain over outside is at most that of the best B and of all positions at which an inner tag gains.
    """
    sizes = [len(x) for x in scores]
    if not sum(sizes):
        return []
    every = np.concatenate(scores)
    text = np.repeat(np.arange(len(scores)), sizes)
    first = np.cumsum([0, *sizes])
    outside = order[0, 0]
    inner = float(np.where(allowed()[:, 2::2], order[:, 2::2], -np.inf).max() - outside)
    ends = max(0.0, float(order[:, 1::2].max() - outside) + max(0.0, float(order[:, 0].max() - outside)))
    opens, goes_on = every[:, 1::2].max(1) - every[:, 0] + ends, every[:, 2::2].max(1) - every[:, 0] + inner
    live = np.flatnonzero((goes_on > -CLEAR) | (opens > 0))
    if not len(live):
        return []
    apart = np.flatnonzero((np.diff(live) > 2 * EDGE) | (np.diff(text[live]) > 0))
    a, z = live[np.r_[0, apart + 1]], live[np.r_[apart, len(live) - 1]]
    a, z = np.maximum(a - EDGE, first[text[a]]), np.minimum(z + EDGE + 1, first[text[a] + 1])
    cuts = np.ravel(np.column_stack((a, z)))
    padded = lambda x: np.append(x, 0.0)
    gain = np.add.reduceat(padded(np.maximum(goes_on, 0)), cuts)[::2] + np.maximum.reduceat(padded(opens), cuts)[::2]
    a, z = a[gain > 0], z[gain > 0]
    k = text[a]
    return list(zip(k.tolist(), (a - first[k]).tolist(), (z - first[k]).tolist(), strict=True))


def _scored(model: Tagger, coded: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Scores [T, K] of every text; each position takes those of the window in which it lies farthest from an edge."""
    jobs: dict[int, list[tuple[int, int, int, int]]] = {w: [] for w in WINDOWS}
    for k, (s, _) in enumerate(coded):
        n = len(s)
        if n == 0:
            continue
        size = next((w for w in WINDOWS if w >= n), WINDOWS[-1])
        if n <= size:
            jobs[size].append((k, 0, 0, n))
            continue
        core, at = size - 2 * MARGIN, 0
        while at < n:  # (text, window start, first and last position taken)
            start = max(0, min(at - MARGIN, n - size))
            end = n if start + size >= n else min(n, start + size - MARGIN)
            jobs[size].append((k, start, at, end))
            at = end if end > at else at + core
    scores = [np.zeros((len(s), K), np.float32) for s, _ in coded]
    for size, windows in jobs.items():
        for low in range(0, len(windows), BATCH):
            part = windows[low : low + BATCH]
            symbols, classes = np.zeros((size, len(part)), np.uint8), np.zeros((size, len(part)), np.uint8)
            for j, (k, start, _, _) in enumerate(part):
                s, c = coded[k]
                piece = s[start : start + size]
                symbols[: len(piece), j], classes[: len(piece), j] = piece, c[start : start + size]
            found = model.scores(symbols, classes)
            for j, (k, start, a, z) in enumerate(part):
                scores[k][a:z] = found[a - start : z - start, j]
    return scores


def _tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of texts that are tagged side by side."""
    scores = _scored(model, [codes(t) for t in texts])
    order = model.p["order"]
    stretches = open_stretches(scores, order)
    pieces, where = [scores[k][a:z] for k, a, z in stretches], [(k, a) for k, a, _ in stretches]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    todo = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
    opens = np.array([x[0] == "B" for x in TAGS])
    while todo:  # stretches of like length side by side; what is filled up is outside
        longest = len(pieces[todo[-1]])
        n = max(1, min(len(todo), PATH_CELLS // longest))
        while n > 1 and len(pieces[todo[-n]]) < 0.7 * longest:
            n -= 1
        part, todo = todo[-n:], todo[:-n]
        table = np.zeros((n, longest, K), np.float32)
        table[:, :, 0] = 100
        for j, k in enumerate(part):
            table[j, : len(pieces[k])] = pieces[k]
        tags = best_paths(table, order)
        for j, at in zip(*np.nonzero(opens[tags]), strict=True):
            kind, end = TAGS[tags[j, at]][2:], at + 1
            while end < longest and tags[j, end] == tags[j, at] + 1:
                end += 1
            k, shift = where[part[j]]
            out[k].append((kind, int(at) + shift, int(end) + shift))
    return [sorted(x, key=lambda s: s[1]) for x in out]


def tag_texts(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans (type, start, end) of every text, in code points.

    Windows overlap and one best path is found for the whole text. Texts are taken together by their characters, and
    very long ones in overlapping pieces, so that memory does not grow with the length of texts or batches.
    """
    pieces: list[tuple[int, int, str]] = []
    for k, text in enumerate(texts):
        step = LONGEST - OVERLAP
        pieces += [(k, at, text[at : at + LONGEST]) for at in range(0, max(1, len(text) - OVERLAP), step)] if len(text) > LONGEST else [(k, 0, text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    low = 0
    while low < len(pieces):
        high, held = low, 0
        while high < len(pieces) and (high == low or held + len(pieces[high][2]) <= TEXT_CELLS):
            held += len(pieces[high][2])
            high += 1
        part = pieces[low:high]
        for (k, at, piece), spans in zip(part, _tagged(model, [p for _, _, p in part]), strict=True):
            first = OVERLAP // 2 if at else 0
            last = len(piece) - OVERLAP // 2 if at + len(piece) < len(texts[k]) else len(piece)
            out[k] += [(kind, a + at, z + at) for kind, a, z in spans if first <= a < last]
        low = high
    return out
