"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from riskloom.llm.pii_rules import KINDS, Span

HIDDEN = 12
TAGS = 1 + 2 * len(KINDS)  # 0 outside; 1 + 2k begins kind k, 2 + 2k goes on with it
FORBIDDEN = -1e4
WIDTH, STRIDE = 512, 448  # pieces of up to WIDTH - STRIDE characters lie whole in some window
F32 = np.float32


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, int]:
    """A class for each code point: letters without case, all digits one, signs, blanks, line breaks, the rest."""
    names: dict[str, int] = {}

    def of(code: int) -> str:
        if 0xD800 <= code < 0xE000:
            return "other"
        char = unicodedata.normalize("NFKC", chr(code)).lower()[:1]
        if not char or not char.isprintable():
            return "line" if chr(code) in "\n\r" else "other"
        if char.isdecimal():
            return "digit"
        if char.isascii():
            return char
        return "letter" if char.isalpha() else "blank" if char.isspace() else "other"

    table = np.fromiter((names.setdefault(of(code), len(names)) for code in range(0x10000)), np.uint8, 0x10000)
    return table, len(names)


def encode(text: str) -> np.ndarray:
    """The class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _classes()[0][np.minimum(codes, 0xFFFF)]


def legal() -> np.ndarray:
    """Scores of forbidden transitions (a kind can only go on after itself), 0 elsewhere."""
    t = np.zeros((TAGS, TAGS), F32)
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = FORBIDDEN
        t[1 + 2 * k, 2 + 2 * k] = t[2 + 2 * k, 2 + 2 * k] = 0
    return t


def _gate(x: np.ndarray) -> np.ndarray:
    """How far a gate is open: the sigmoid's tangent, held within 0 and 1, which costs no exponential."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    """Between -1 and 1, without an exponential; its slope is (1 - |result|) squared."""
    return x / (1 + np.abs(x))


def _slope(gate: np.ndarray) -> np.ndarray:
    return ((gate > 0) & (gate < 1)).astype(gate.dtype) * F32(0.25)


def initial(hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; ``in_*`` hold the product of character embedding and input weights, gates i, f, o, g."""
    draw, classes = np.random.default_rng(seed), _classes()[1]
    p = {}
    for side in ("fore", "back"):
        p[f"in_{side}"] = draw.normal(scale=0.3, size=(classes, 4 * hidden))
        p[f"in_{side}"][:, hidden : 2 * hidden] += 1  # remember at first
        p[f"step_{side}"] = draw.normal(scale=hidden**-0.5, size=(hidden, 4 * hidden))
        p[f"out_{side}"] = draw.normal(scale=0.1, size=(hidden, TAGS))
    p["bias"], p["moves"] = np.zeros(TAGS), np.zeros((TAGS, TAGS))
    p["bias"][0] = 1
    return {k: v.astype(F32) for k, v in p.items()}


def _run(x: np.ndarray, table: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (time, batch, hidden) of one direction, and what its gradient needs."""
    n = len(step)
    h = np.zeros((x.shape[1], n), table.dtype)
    c, out, kept = h, np.empty((*x.shape, n), table.dtype), []
    for t in range(len(x)):
        z = table[x[t]] + h @ step
        gates, g = _gate(z[:, : 3 * n]), _squash(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        before, c = c, f * c + i * g
        tc = _squash(c)
        kept.append((h, before, i, f, o, g, tc))
        h = out[t] = o * tc
    return out, kept


def _back(x, kept, step, d_out, classes) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the step weights of one direction."""
    all_dz = np.empty((*x.shape, step.shape[1]), step.dtype)
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t in reversed(range(len(x))):
        _, before, i, f, o, g, tc = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - np.abs(tc)) ** 2
        dz = np.hstack([dc * g * _slope(i), dc * before * _slope(f), dh * tc * _slope(o), dc * i * (1 - np.abs(g)) ** 2])
        all_dz[t], dh, dc = dz, dz @ step.T, dc * f
    flat = all_dz.reshape(-1, step.shape[1])
    states = np.concatenate([k[0] for k in kept])
    return np.eye(classes, dtype=step.dtype)[x.ravel()].T @ flat, states.T @ flat


def loss(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tags ``y`` (time, batch) and its gradient.

    Sums over all paths run forward and backward in probabilities, scaled at each step.
    """
    time, batch = x.shape
    moves = p["moves"] + legal().astype(p["moves"].dtype)
    fore, kept_fore = _run(x, p["in_fore"], p["step_fore"])
    back, kept_back = _run(x[::-1], p["in_back"], p["step_back"])
    back = back[::-1]
    e = fore @ p["out_fore"] + back @ p["out_back"] + p["bias"]
    top = e.max(axis=2, keepdims=True)
    here, ways = np.exp(np.maximum(e - top, -40)), np.exp(moves)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((time, batch, 1), e.dtype)
    for t in range(time):
        alpha[t] = here[t] * (alpha[t - 1] @ ways if t else np.exp(legal_start(e.dtype)))
        scale[t] = alpha[t].sum(axis=1, keepdims=True)
        alpha[t] /= scale[t]
    for t in reversed(range(time - 1)):
        beta[t] = (here[t + 1] * beta[t + 1] / scale[t + 1]) @ ways.T
    at, steps = np.arange(batch), np.arange(time)[:, None]
    de = alpha * beta
    de[steps, at, y] -= 1
    de /= batch
    onward = (here * beta / scale)[1:].reshape(-1, TAGS)
    d_moves = ways * (alpha[:-1].reshape(-1, TAGS).T @ onward)
    np.subtract.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), 1)
    z = np.log(scale).sum() + top.sum()
    gold = e[steps, at, y].sum() + moves[y[:-1], y[1:]].sum()
    flat = de.reshape(-1, TAGS)
    g = {"moves": d_moves / batch, "bias": flat.sum(axis=0)}
    g["out_fore"] = fore.reshape(time * batch, -1).T @ flat
    g["out_back"] = back.reshape(time * batch, -1).T @ flat
    classes = len(p["in_fore"])
    g["in_fore"], g["step_fore"] = _back(x, kept_fore, p["step_fore"], de @ p["out_fore"].T, classes)
    g["in_back"], g["step_back"] = _back(x[::-1], kept_back, p["step_back"], (de @ p["out_back"].T)[::-1], classes)
    return float(z - gold) / batch, g


def legal_start(kind=F32) -> np.ndarray:
    """Scores for the first tag of a text: nothing can go on there."""
    return np.array([FORBIDDEN if tag and tag % 2 == 0 else 0 for tag in range(TAGS)], kind)


def fit(
    x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 18, batch: int = 256, rate: float = 0.04, seed: int = 0
) -> dict[str, np.ndarray]:
    """Weights for windows ``x`` and their tags ``y`` (both window, time), by Adam with a falling rate."""
    p, draw = initial(hidden, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    rounds, n = epochs * -(-len(x) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for start in range(0, len(x), batch):
            some = order[start : start + batch]
            _, g = loss(p, x[some].T, y[some].T)
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            n += 1
            now = rate * (1 - (n - 1) / rounds) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
            for k in p:
                v = g[k] * min(1.0, 5 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] = (p[k] - now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(F32)
    return p


def _half(x, lengths, table, step, out, e, order) -> None:
    """Add one direction's part of the tag scores to ``e`` (time, tag, window); states are (unit, window) arrays."""
    n = step.shape[1]
    h, c = (np.zeros((n, x.shape[1]), F32) for _ in range(2))
    full = bool((lengths == len(x)).all())
    gates, work = np.empty((4 * n, x.shape[1]), F32), np.empty((4 * n, x.shape[1]), F32)
    size = np.empty((n, x.shape[1]), F32)
    for t in order:
        np.take(table, x[t], axis=1, out=gates, mode="clip")
        gates += np.matmul(step, h, out=work)
        # the weights hold the gates' factor and half already
        np.clip(gates[: 3 * n], 0, 1, out=gates[: 3 * n])
        new = gates[3 * n :]
        np.abs(new, out=size)
        size += 1
        new /= size
        new *= gates[:n]
        c *= gates[n : 2 * n]
        c += new
        np.abs(c, out=size)
        size += 1
        np.divide(c, size, out=h)
        h *= gates[2 * n : 3 * n]
        if not full:  # behind the end of a text nothing is remembered
            there = t < lengths
            h *= there
            c *= there
        e[t] += np.matmul(out, h, out=work[: len(out)])


class Tagger:
    """Trained weights, ready to score many windows at once."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.bias = weights["bias"].astype(F32)
        self.moves = (weights["moves"] + legal()).astype(F32)
        self.sides = []
        for side in ("fore", "back"):
            n = len(weights[f"step_{side}"])
            factor, half = (np.r_[np.full(3 * n, a), np.full(n, b)] for a, b in ((0.25, 1.0), (0.5, 0.0)))
            table = np.ascontiguousarray((weights[f"in_{side}"] * factor + half).T, F32)
            step = np.ascontiguousarray((weights[f"step_{side}"] * factor).T, F32)
            self.sides.append((table, step, np.ascontiguousarray(weights[f"out_{side}"].T, F32)))
    def scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (time, tag, window) of the tags of windows ``x`` (time, window) of the given lengths."""
        e = np.empty((len(x), TAGS, x.shape[1]), F32)
        e[:] = self.bias[:, None]
        for (table, step, out), order in zip(self.sides, (range(len(x)), reversed(range(len(x))))):
            _half(x, lengths, table, step, out, e, order)
        return e

    def busy(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Windows whose best path may leave the outside tag.

        For each kind, ``gain`` is the most that a piece of that kind ending here can win over staying outside, with the
        best transitions there are. If no piece wins anything, no path does.
        """
        stay = self.moves[0, 0]
        enter = (self.moves[:, 1::2].max(axis=0) - stay)[:, None]
        go_on = np.array([max(self.moves[1 + 2 * k, 2 + 2 * k], self.moves[2 + 2 * k, 2 + 2 * k]) for k in range(len(KINDS))])
        go_on = (go_on - stay)[:, None]
        leave = max(0.0, float(self.moves[1:, 0].max() - stay))
        gain, most = np.full((len(KINDS), e.shape[2]), FORBIDDEN, F32), np.full(e.shape[2], FORBIDDEN, F32)
        for t in range(len(e)):
            gain = np.maximum(e[t, 1::2] + enter, gain + e[t, 2::2] + go_on) - e[t, 0]
            now = gain.max(axis=0)
            most = np.maximum(most, np.where(t < lengths, now, FORBIDDEN))
        return np.nonzero(most + leave >= 0)[0]

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """The best tags (time) for the scores (time, tag) of one window."""
        total, came = e[0] + legal_start(), []
        for t in range(1, len(e)):
            ways = total[:, None] + self.moves
            came.append(ways.argmax(axis=0))
            total = ways.max(axis=0) + e[t]
        tag = int(total.argmax())
        path = [tag]
        for back in reversed(came):
            tag = int(back[tag])
            path.append(tag)
        return np.array(path[::-1])

    def window_spans(self, e: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Kind, start, end of the pieces on the best path of one window, and how far they beat the outside tag."""
        path, found, t = self.best_path(e), [], 0
        while t < len(path):
            if path[t] == 0:
                t += 1
                continue
            kind, end = (path[t] - 1) // 2, t + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            found.append((int(kind), t, end, float((e[np.arange(t, end), path[t:end]] - e[t:end, 0]).sum())))
            t = end
        return found


def windows(length: int) -> list[tuple[int, int]]:
    """Start and end of the overlapping windows of a text."""
    starts = range(0, max(length - WIDTH + STRIDE, 1), STRIDE) if length > WIDTH else [0]
    return [(a, min(a + WIDTH, length)) for a in starts] if length else []


def tag(tagger: Tagger, texts: Sequence[str], chunk: int = 8192, batch: int = 1024) -> list[list[tuple[int, int, int, float]]]:
    """The pieces found in each whole text, from windows that overlap; each with its score.

    Windows of all texts are gathered ``chunk`` at a time and scored in batches of similar length, so memory does not
    depend on the texts' length. A piece that a window cuts at an inner edge is left to the window that holds it
    whole, if it is that short.
    """
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, int, np.ndarray]] = []

    def score(some: list) -> None:
        lengths = np.array([len(w[3]) for w in some])
        x = np.zeros((lengths.max(), len(some)), np.intp)
        for j, w in enumerate(some):
            x[: len(w[3]), j] = w[3]
        e = tagger.scores(x, lengths)
        for j in tagger.busy(e, lengths):
            i, start, size, _ = some[j]
            for kind, a, z, score in tagger.window_spans(e[: lengths[j], :, j]):
                cut = (a == 0 and start > 0) or (z == lengths[j] and start + z < size)
                if not cut or z - a > WIDTH - STRIDE:
                    found[i].append((kind, start + a, start + z, score))

    def flush() -> None:
        held.sort(key=lambda w: len(w[3]))
        for start in range(0, len(held), batch):
            score(held[start : start + batch])
        held.clear()

    for i, text in enumerate(texts):
        codes = encode(text)
        for a, z in windows(len(codes)):
            held.append((i, a, len(codes), codes[a:z]))
            if len(held) == chunk:
                flush()
    if held:
        flush()
    return found


def reconcile(found: list[tuple[int, int, int, float]], fixed: Sequence[Span] = ()) -> list[Span]:
    """The pieces without overlap that have the highest total score, none of which touches a fixed one.

    The choice is over the whole text: weighted interval scheduling, ties to the piece that ends first.
    """
    pieces = sorted({(z, a, kind): 0 for kind, a, z, _ in found})
    score = {}
    for kind, a, z, s in found:
        score[z, a, kind] = max(score.get((z, a, kind), -np.inf), s)
    taken = sorted((a, z) for _, a, z in fixed)
    edges, reach = [a for a, _ in taken], []
    for _, z in taken:
        reach.append(max(z, reach[-1] if reach else z))
    pieces = [p for p in pieces if score[p] > 0 and not _touches(p[1], p[0], edges, reach)]
    ends = [p[0] for p in pieces]
    best, link = [0.0], []
    for n, (z, a, kind) in enumerate(pieces):
        before = int(np.searchsorted(ends[:n], a, "right"))
        with_it = best[before] + score[z, a, kind]
        link.append(before if with_it > best[-1] else -1)
        best.append(max(best[-1], with_it))
    chosen, n = [], len(pieces)
    while n:
        if link[n - 1] < 0:
            n -= 1
        else:
            z, a, kind = pieces[n - 1]
            chosen.append((kind, a, z))
            n = link[n - 1]
    return chosen[::-1]


def _touches(a: int, z: int, starts: list[int], reach: list[int]) -> bool:
    """Whether [a, z) meets one of the fixed pieces (their sorted starts, and how far any up to there reaches)."""
    n = int(np.searchsorted(starts, z, "left"))
    return n > 0 and reach[n - 1] > a


