"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Tags are O and, per kind, B (first character) and I (further ones).  Emissions are a linear map of both directions' states;
transitions that no labelling can hold (I of a kind not after B or I of that kind) are barred.  Training maximises the
likelihood of labelled windows with Adam; gradients go through the CRF by forward and backward sums and through the LSTM
by time.
"""

from __future__ import annotations

import numpy as np

BARRED = -1e4
N_CHARS = 131  # ASCII, other letters, other characters, padding
PAD = 130


def char_ids(text: str) -> np.ndarray:
    return np.array([o if o < 128 else 128 if c.isalpha() else 129 for c in text for o in (ord(c),)], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsumexp(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, kinds: list[str], hidden: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 1 + 2 * len(kinds)
        h, k = hidden, self.tags
        self.p = {
            "in": rng.normal(0, 0.3, (2, N_CHARS, 4 * h)),
            "rec": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
            "out": rng.normal(0, 0.3, (2 * h, k)),
            "bias": np.zeros(k),
            "step": np.zeros((k, k)),
        }
        self.p["in"][:, :, h : 2 * h] += 1.0  # forget gates start open
        self.allowed = np.ones((k, k), bool)
        self.start = np.ones(k, bool)
        for i in range(2, k, 2):
            self.allowed[:, i] = False
            self.allowed[[i - 1, i], i] = True
            self.start[i] = False

    # -- forward -------------------------------------------------------------------------------------------------------

    def _lstm(self, ids, keep=False):
        """States of both directions: [time, 2, batch, hidden]; direction 1 reads from the end."""
        p, h = self.p, self.hidden
        n, t = ids.shape
        both = np.stack((ids, ids[:, ::-1]))
        gates_in = np.stack([p["in"][d][both[d]] for d in (0, 1)])  # 2, n, t, 4h
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        states, saved = [], []
        for i in range(t):
            a = gates_in[:, :, i] + state @ p["rec"]
            gates = _sigmoid(a[..., : 3 * h])
            fresh = np.tanh(a[..., 3 * h :])
            before = cell
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * fresh
            squashed = np.tanh(cell)
            if keep:
                saved.append((gates, fresh, before, squashed, state))
            state = gates[..., 2 * h :] * squashed
            states.append(state)
        return np.stack(states), both, saved

    def emissions(self, ids):
        """[batch, time, tags]."""
        states, _, _ = self._lstm(ids)
        features = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)
        return (features @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def steps(self):
        return np.where(self.allowed, self.p["step"], BARRED)

    def decode(self, emissions):
        """The best tags of one stretch of any length: [time, tags] to [time]."""
        steps = self.steps()
        score = emissions[0] + np.where(self.start, 0, BARRED)
        back = []
        for e in emissions[1:]:
            ways = score[:, None] + steps
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + e
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    # -- training ------------------------------------------------------------------------------------------------------

    def _loss(self, ids, tags):
        p, h = self.p, self.hidden
        states, both, saved = self._lstm(ids, keep=True)
        features = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)  # t, n, 2h
        emit = features @ p["out"] + p["bias"]
        t, n, k = emit.shape
        steps, start = self.steps(), np.where(self.start, 0, BARRED)
        ahead = [emit[0] + start]
        for i in range(1, t):
            ahead.append(_logsumexp(ahead[-1][:, :, None] + steps, 1) + emit[i])
        behind = [np.zeros((n, k))]
        for i in range(t - 1, 0, -1):
            behind.append(_logsumexp(steps + (emit[i] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        z = _logsumexp(ahead[-1], 1)
        rows, gold = np.arange(n), tags.T
        d_emit = np.exp(np.stack(ahead) + np.stack(behind) - z[None, :, None])
        d_step = np.zeros((k, k))
        score = np.zeros(n)
        for i in range(t):
            d_emit[i, rows, gold[i]] -= 1
            score += emit[i, rows, gold[i]]
            if i:
                pair = ahead[i - 1][:, :, None] + steps + (emit[i] + behind[i])[:, None, :] - z[:, None, None]
                d_step += np.exp(pair).sum(axis=0)
                np.subtract.at(d_step, (gold[i - 1], gold[i]), 1)
                score += steps[gold[i - 1], gold[i]]
        grad = {"out": np.einsum("tnf,tnk->fk", features, d_emit), "bias": d_emit.sum(axis=(0, 1))}
        grad["step"] = np.where(self.allowed, d_step, 0)
        d_features = d_emit @ p["out"].T
        d_states = np.stack((d_features[..., :h], d_features[::-1, :, h:]), axis=1)  # t, 2, n, h
        grad["rec"], grad["in"] = np.zeros_like(p["rec"]), np.zeros_like(p["in"])
        d_next, d_cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        for i in range(t - 1, -1, -1):
            gates, fresh, before, squashed, state = saved[i]
            g_in, g_forget, g_out = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            d_h = d_states[i] + d_next
            d_cell = d_cell + d_h * g_out * (1 - squashed**2)
            d_a = np.concatenate(
                (
                    d_cell * fresh * g_in * (1 - g_in),
                    d_cell * before * g_forget * (1 - g_forget),
                    d_h * squashed * g_out * (1 - g_out),
                    d_cell * g_in * (1 - fresh**2),
                ),
                axis=-1,
            )
            grad["rec"] += state.transpose(0, 2, 1) @ d_a
            for d in (0, 1):
                np.add.at(grad["in"][d], both[d][:, i], d_a[d])
            d_next = d_a @ p["rec"].transpose(0, 2, 1)
            d_cell = d_cell * g_forget
        return float((z - score).mean()), {name: g / n for name, g in grad.items()}

    def fit(self, ids, tags, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 1) -> list[float]:
        """ids, tags: [windows, time].  Returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, n = [], 0
        for _ in range(epochs):
            order, seen = rng.permutation(len(ids)), []
            for low in range(0, len(ids), batch):
                pick = order[low : low + batch]
                loss, grad = self._loss(ids[pick], tags[pick])
                size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                n += 1
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g**2 - second[name])
                    move = (first[name] / (1 - 0.9**n)) / (np.sqrt(second[name] / (1 - 0.99**n)) + 1e-8)
                    self.p[name] -= rate * move
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses
