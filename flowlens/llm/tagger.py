"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Classes of characters: digits are alike, letters come in three kinds, these signs stand for themselves.
SIGNS = "@.+-()_%:/=,;'\"#*&<>[]"
PAD, DIGIT, SMALL, CAPITAL, LETTER, BLANK, BREAK, OTHER = range(8)
CLASSES = 8 + len(SIGNS)


def _table() -> np.ndarray:
    table = np.full(128, OTHER, np.uint8)
    table[ord("0") : ord("9") + 1] = DIGIT
    table[ord("a") : ord("z") + 1] = SMALL
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[ord(" ")] = BLANK
    table[[9, 10, 11, 12, 13]] = BREAK
    for k, sign in enumerate(SIGNS):
        table[ord(sign)] = 8 + k
    return table


TABLE = _table()


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, TABLE[np.minimum(codes, 127)], np.uint8(LETTER))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Tags windows of class ids (window x position; PAD only at the end)."""

    tags: int
    hidden: int = 12
    seed: int = 3
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.p:
            return
        r, h = np.random.default_rng(self.seed), self.hidden
        self.p = {
            "x": r.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "e": r.normal(0, 0.3, (2 * h, self.tags)), "b": np.zeros(self.tags),
            "t": np.zeros((self.tags, self.tags)), "s": np.zeros(self.tags),
        }
        self.p["x"][:, :, h : 2 * h] += 1  # remember by default
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (position, direction, window, hidden); the second direction reads backwards."""
        n, length, h = *x.shape, self.hidden
        both = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, steps = np.empty((length, 2, n, h), np.float32), []
        direction = np.arange(2)[:, None]
        for t in range(length):
            ids = both[:, :, t]
            z = self.p["x"][direction, ids] + state @ self.p["h"]
            gates, new = sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            there = (ids != PAD)[..., None]
            before = (state, cell)
            cell = np.where(there, gates[..., h : 2 * h] * cell + gates[..., :h] * new, 0)
            bent = np.tanh(cell)
            state = np.where(there, gates[..., 2 * h :] * bent, 0)
            out[t] = state
            if keep:
                steps.append((ids, gates, new, bent, there, *before))
        return out, steps

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (window, position, tag)."""
        out, _ = self._states(x, keep=False)
        return self._emit(out)

    def _emit(self, out: np.ndarray) -> np.ndarray:
        h = self.hidden
        forward, backward = out[:, 0], out[::-1, 1]
        return (forward @ self.p["e"][:h] + backward @ self.p["e"][h:] + self.p["b"]).transpose(1, 0, 2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window by the CRF; PAD gets tag 0."""
        e = self.emissions(x)
        n, length, k = e.shape
        best, back = self.p["s"] + e[:, 0], np.zeros((length, n, k), np.int8)
        real = x != PAD
        for t in range(1, length):
            to = best[:, :, None] + self.p["t"]
            back[t] = to.argmax(1)
            new = to.max(1) + e[:, t]
            best = np.where(real[:, t, None], new, best)
            back[t][~real[:, t]] = np.arange(k)
        path = np.zeros((n, length), np.int8)
        path[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[t][rows, path[:, t]]
        return np.where(real, path, 0)

    def _crf(self, e: np.ndarray, y: np.ndarray, real: np.ndarray):
        """Loss, and its slopes by emissions, transitions and starts."""
        n, length, k = e.shape
        t_, s = self.p["t"], self.p["s"]

        def total(a, axis):
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        alpha, beta = np.empty((length, n, k), np.float32), np.zeros((length, n, k), np.float32)
        alpha[0] = s + e[:, 0]
        for t in range(1, length):
            alpha[t] = np.where(real[:, t, None], total(alpha[t - 1][:, :, None] + t_, 1) + e[:, t], alpha[t - 1])
        for t in range(length - 2, -1, -1):
            after = total(t_ + (e[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(real[:, t + 1, None], after, 0)
        z = total(alpha[-1], 1)
        rows = np.arange(n)
        slope_e = np.exp(alpha + beta - z[:, None]).transpose(1, 0, 2) * real[:, :, None]
        slope_t, slope_s, gold = np.zeros((k, k), np.float32), slope_e[:, 0].sum(0), s[y[:, 0]] + e[rows, 0, y[:, 0]]
        slope_s = slope_s - np.bincount(y[:, 0], minlength=k)
        slope_e[rows, 0, y[:, 0]] -= 1
        for t in range(1, length):
            m = real[:, t]
            pair = alpha[t - 1][:, :, None] + t_ + (e[:, t] + beta[t])[:, None, :] - z[:, None, None]
            slope_t += np.exp(pair[m]).sum(0)
            np.subtract.at(slope_t, (y[m, t - 1], y[m, t]), 1)
            gold = gold + np.where(m, t_[y[:, t - 1], y[:, t]] + e[rows, t, y[:, t]], 0)
            slope_e[rows[m], t, y[m, t]] -= 1
        return float((z - gold).mean()), slope_e / n, slope_t / n, slope_s / n

    def slopes(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of windows with tags ``y``, and the slope of each parameter."""
        h, length = self.hidden, x.shape[1]
        out, steps = self._states(x, keep=True)
        loss, de, dt, ds = self._crf(self._emit(out), y, x != PAD)
        forward, backward = out[:, 0], out[::-1, 1]
        d = de.transpose(1, 0, 2)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["t"], g["s"], g["b"] = dt, ds, d.sum((0, 1))
        g["e"] = np.concatenate([np.einsum("tnh,tnk->hk", forward, d), np.einsum("tnh,tnk->hk", backward, d)])
        d_out = np.stack([d @ self.p["e"][:h].T, (d @ self.p["e"][h:].T)[::-1]], 1)
        d_state, d_cell = np.zeros_like(out[0]), np.zeros_like(out[0])
        back = self.p["h"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            ids, gates, new, bent, there, state, cell = steps[t]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            up = (d_out[t] + d_state) * there
            d_cell = (d_cell + up * o * (1 - bent * bent)) * there
            dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * cell * f * (1 - f), up * bent * o * (1 - o), d_cell * i * (1 - new * new)], -1)
            for k in range(2):
                np.add.at(g["x"][k], ids[k], dz[k])
            g["h"] += state.transpose(0, 2, 1) @ dz
            d_state, d_cell = dz @ back, d_cell * f
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam over all windows, ``rounds`` times; returns the mean loss of each round."""
        r, step, losses = np.random.default_rng(self.seed), 0, []
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for turn in range(rounds):
            order, seen = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                used = max(1, int((x[pick] != PAD).sum(1).max()))
                loss, g = self.slopes(x[pick, :used], y[pick, :used])
                seen.append(loss)
                step += 1
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / max(size, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                    self.p[k] = (self.p[k] - rate * (1 - turn / rounds) * move).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses
