"""A gated recurrent language model in numpy: truncated backpropagation through time, class-factored softmax.

Codes: 0 ends a text, codes below ``HEAD`` are frequent words, others are all remaining words told apart by a bucket.
Outputs: a class first (blocks of ``BLOCK`` codes, and one class for all remaining words), then the word in its block.
"""

from __future__ import annotations

import numpy as np

HEAD, BLOCK, BUCKETS, HIDDEN = 2048, 64, 256, 16
UPDATES = 200
CLASSES = HEAD // BLOCK + 1
SHAPES = {"gate": (HEAD + BUCKETS, 3 * HIDDEN), "loop": (HIDDEN, 3 * HIDDEN), "klass": (HIDDEN, CLASSES), "klass_bias": (CLASSES,),
          "word": (HEAD, HIDDEN), "word_bias": (HEAD,)}


def start(counts: np.ndarray | None = None, rest: float = 0.0, seed: int = 1) -> dict[str, np.ndarray]:
    """First parameters; ``counts`` of codes below HEAD and the count of all others set the biases, so that the model starts as a unigram one."""
    rng = np.random.default_rng(seed)
    scale = {"gate": 0.1, "loop": 0.3, "klass": 0.1, "word": 0.1}
    p = {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}
    if counts is not None:
        full = np.zeros(HEAD)
        full[:len(counts)] = counts
        p["word_bias"] = np.log(full + 0.5).astype(np.float32)
        p["klass_bias"] = np.log(np.append(full.reshape(-1, BLOCK).sum(axis=1), rest) + 0.5).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(p: dict[str, np.ndarray], h: np.ndarray, codes: np.ndarray) -> tuple:
    """State after reading ``codes`` (one for each row), with what the way back needs."""
    g, a = p["gate"][codes], h @ p["loop"]
    zr = _sigmoid(g[:, :2 * HIDDEN] + a[:, :2 * HIDDEN])
    z, r, inner = zr[:, :HIDDEN], zr[:, HIDDEN:], a[:, 2 * HIDDEN:]
    n = np.tanh(g[:, 2 * HIDDEN:] + r * inner)
    return n + z * (h - n), (h, z, r, inner, n)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def _blocks(codes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(class, positions) of frequent words, by class."""
    klass = np.minimum(codes // BLOCK, CLASSES - 1)
    order = np.argsort(klass, kind="stable")
    cuts = np.searchsorted(klass[order], np.arange(CLASSES))
    return [(c, order[cuts[c]:cuts[c + 1]]) for c in range(CLASSES - 1) if cuts[c + 1] > cuts[c]]


def log_probs(p: dict[str, np.ndarray], states: np.ndarray, codes: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple:
    """Natural log-probability of each code in its state (of the class alone for the remaining words); with ``grads``, also the gradient on the states."""
    rows, klass = np.arange(len(codes)), np.minimum(codes // BLOCK, CLASSES - 1)
    q = _softmax(states @ p["klass"] + p["klass_bias"])
    out = np.log(q[rows, klass] + 1e-30)
    back = None
    if grads is not None:
        q[rows, klass] -= 1
        grads["klass"] += states.T @ q
        grads["klass_bias"] += q.sum(axis=0)
        back = q @ p["klass"].T
    for c, at in _blocks(codes):
        rows_c, s, w = slice(c * BLOCK, (c + 1) * BLOCK), states[at], codes[at] - c * BLOCK
        q = _softmax(s @ p["word"][rows_c].T + p["word_bias"][rows_c])
        k = np.arange(len(at))
        out[at] += np.log(q[k, w] + 1e-30)
        if grads is not None:
            q[k, w] -= 1
            grads["word"][rows_c] += q.T @ s
            grads["word_bias"][rows_c] += q.sum(axis=0)
            back[at] += q @ p["word"][rows_c]
    return out, back


class Trainer:
    """Adam over windows of ``window`` steps; the state, not its history, is carried from window to window."""

    def __init__(self, params: dict[str, np.ndarray], window: int = 16, rate: float = 0.01):
        self.p, self.window, self.rate, self.t = {k: v.copy() for k, v in params.items()}, window, rate, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))

    def streams(self, codes: np.ndarray, width: int) -> None:
        """Learn from texts laid end to end, cut into streams that step together; state is cleared after an end.

        There are at most ``width`` streams, and so few that some ``UPDATES`` updates come about.
        """
        width = max(1, min(width, len(codes) // (UPDATES * self.window)))
        n = len(codes) // width
        grid = codes[:n * width].reshape(width, n).T
        h = np.zeros((width, HIDDEN), np.float32)
        for a in range(0, n, self.window):
            h = self._learn(grid[a:a + self.window], h)
        rest, h = codes[n * width:, None], np.zeros((1, HIDDEN), np.float32)
        for a in range(0, len(rest), self.window):
            h = self._learn(rest[a:a + self.window], h)

    def _learn(self, codes: np.ndarray, h: np.ndarray) -> np.ndarray:
        t, width = codes.shape
        states, notes = [], []
        for c in codes:
            states.append(h)
            h, note = step(self.p, h, c)
            notes.append(note)
            h = h * (c != 0)[:, None]
        grads = {k: np.zeros_like(x) for k, x in self.p.items()}
        _, back = log_probs(self.p, np.concatenate(states), codes.reshape(-1), grads)
        back = back.reshape(t, width, HIDDEN)
        gates = np.empty((t, width, 3 * HIDDEN), np.float32)
        dh = np.zeros((width, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            dh = dh * (codes[i] != 0)[:, None]
            old, z, r, inner, n = notes[i]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (old - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], axis=1)
            gates[i] = np.concatenate([dz, dr, dn], axis=1)
            grads["loop"] += old.T @ da
            dh = dh * z + da @ self.p["loop"].T + back[i]
        flat_codes = codes.reshape(-1)
        order = np.argsort(flat_codes, kind="stable")
        seen, first = np.unique(flat_codes[order], return_index=True)
        grads["gate"][seen] = np.add.reduceat(gates.reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        self._adam(grads, 1 / (t * width))
        return h

    def _adam(self, grads: dict[str, np.ndarray], scale: float) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g *= scale
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            self.p[k] -= (fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def score(p: dict[str, np.ndarray], texts: list[np.ndarray], window: int = 32) -> np.ndarray:
    """Sum of log10-probabilities of each whole text; texts step together from the longest on, states carried across windows."""
    sizes = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    total, longest = np.zeros(len(texts)), int(sizes.max(initial=0))
    if not longest:
        return total
    codes = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begin = np.cumsum(sizes[order]) - sizes[order]
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    h = np.zeros((len(texts), HIDDEN), np.float32)
    for a in range(0, longest, window):
        states, seen, rows = [], [], []
        for t in range(a, min(a + window, longest)):
            n = active[t]
            c = codes[begin[:n] + t]
            states.append(h[:n])
            seen.append(c)
            rows.append(np.arange(n))
            h, _ = step(p, h[:n], c)
        logs, _ = log_probs(p, np.concatenate(states), np.concatenate(seen))
        total += np.bincount(np.concatenate(rows), weights=logs, minlength=len(texts))
    out = np.zeros(len(texts))
    out[order] = total / np.log(10)
    return out
