"""A bidirectional LSTM over characters with a CRF on top, in numpy.

Small enough to be trained in seconds on the driver and shipped with a task.
"""

from __future__ import annotations

import numpy as np

#: Characters with a number of their own; the others go by kind.
OWN = "@.+-_%()[]{}<>/\\:;,=#|\"' \n"
DIGIT, LOWER, UPPER, OTHER, PAD = range(len(OWN), len(OWN) + 5)
SYMBOLS = PAD + 1
EMBEDDED, HIDDEN = 10, 16


def numbers(text: str) -> np.ndarray:
    """The number of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.full(len(points), OTHER, np.int64)
    found[(points >= 48) & (points <= 57)] = DIGIT
    found[(points >= 97) & (points <= 122)] = LOWER
    found[(points >= 65) & (points <= 90)] = UPPER
    for i, c in enumerate(OWN):
        found[points == ord(c)] = i
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Weights by name, in ``w``; all rows of a batch have the same length."""

    def __init__(self, tags: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.tags = tags
        self.w = {"embed": rng.normal(0, 0.5, (SYMBOLS, EMBEDDED))}
        for side in "fb":
            self.w[f"in_{side}"] = normal(EMBEDDED, 4 * HIDDEN)
            self.w[f"re_{side}"] = normal(HIDDEN, 4 * HIDDEN)
            self.w[f"bias_{side}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.w |= {
            "out": normal(2 * HIDDEN, tags),
            "out_bias": np.zeros(tags),
            "move": np.zeros((tags, tags)),
            "start": np.zeros(tags),
        }

    def _run(self, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of a direction, (length, rows, HIDDEN), in reading order."""
        length, rows, _ = x.shape
        h = c = np.zeros((rows, HIDDEN))
        out = np.empty((length, rows, HIDDEN))
        given = x @ self.w[f"in_{side}"] + self.w[f"bias_{side}"]
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = given[t] + h @ self.w[f"re_{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = out[t] = o * squashed
            if keep is not None:
                keep.append((t, i, f, o, g, before, was, squashed))
        return out

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """Scores of tags, (length, rows, tags), for numbers (rows, length)."""
        x = self.w["embed"][chars.T]
        both = np.concatenate([self._run("f", x), self._run("b", x)], axis=2)
        return both @ self.w["out"] + self.w["out_bias"]

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (rows, length), and the margin of each over the next best tag there."""
        return self._best(self.emissions(chars))

    def best(self, scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same for scores (length, tags) of rows of any lengths."""
        padded = np.full((max(map(len, scores)), len(scores), self.tags), -1e9)
        padded[:, :, 0] = 0
        for row, own in enumerate(scores):
            padded[: len(own), row] = own
        return self._best(padded)

    def _best(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, rows, _ = scores.shape
        best, back = self.w["start"] + scores[0], []
        for t in range(1, length):
            through = best[:, :, None] + self.w["move"]
            back.append(through.argmax(axis=1).astype(np.int8))
            best = through.max(axis=1) + scores[t]
        path = np.empty((rows, length), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(length - 2, -1, -1):
            path[:, t] = back[t][np.arange(rows), path[:, t + 1]]
        ordered = np.sort(scores, axis=2)
        margin = (ordered[:, :, -1] - ordered[:, :, -2]).T
        agrees = scores.argmax(axis=2).T == path
        return path, np.where(agrees, margin, -margin)

    def loss_and_slopes(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags of rows, and its gradient."""
        w, (rows, length) = self.w, chars.shape
        x, kept = w["embed"][chars.T], {"f": [], "b": []}
        both = np.concatenate([self._run(s, x, kept[s]) for s in "fb"], axis=2)
        scores = both @ w["out"] + w["out_bias"]
        slopes = {k: np.zeros_like(v) for k, v in w.items()}
        at = np.arange(rows)

        ahead = [w["start"] + scores[0]]
        for t in range(1, length):
            ahead.append(_logsum(ahead[-1][:, :, None] + w["move"], 1) + scores[t])
        behind = [np.zeros_like(ahead[0])]
        for t in range(length - 1, 0, -1):
            behind.append(_logsum(w["move"] + (scores[t] + behind[-1])[:, None, :], 2))
        behind.reverse()
        total = _logsum(ahead[-1], 1)
        gold = w["start"][tags[:, 0]] + scores[0][at, tags[:, 0]]
        d_scores = np.empty_like(scores)
        for t in range(length):
            share = np.exp(ahead[t] + behind[t] - total[:, None])
            share[at, tags[:, t]] -= 1
            d_scores[t] = share / rows
            if t == 0:
                slopes["start"] += share.sum(axis=0) / rows
            else:
                gold += w["move"][tags[:, t - 1], tags[:, t]] + scores[t][at, tags[:, t]]
                pair = np.exp(
                    ahead[t - 1][:, :, None]
                    + w["move"]
                    + (scores[t] + behind[t])[:, None, :]
                    - total[:, None, None]
                )
                slopes["move"] += pair.sum(axis=0) / rows
                np.add.at(slopes["move"], (tags[:, t - 1], tags[:, t]), -1 / rows)

        slopes["out"] += np.einsum("trh,trk->hk", both, d_scores)
        slopes["out_bias"] += d_scores.sum(axis=(0, 1))
        d_both = d_scores @ w["out"].T
        d_x = np.zeros_like(x)
        for side, d_out in zip("fb", np.split(d_both, 2, axis=2), strict=True):
            d_h = d_c = np.zeros((rows, HIDDEN))
            for t, i, f, o, g, before, was, squashed in reversed(kept[side]):
                d_h = d_h + d_out[t]
                d_c = d_c + d_h * o * (1 - squashed**2)
                d_z = np.concatenate(
                    [
                        d_c * g * i * (1 - i),
                        d_c * before * f * (1 - f),
                        d_h * squashed * o * (1 - o),
                        d_c * i * (1 - g**2),
                    ],
                    axis=1,
                )
                slopes[f"in_{side}"] += x[t].T @ d_z
                slopes[f"re_{side}"] += was.T @ d_z
                slopes[f"bias_{side}"] += d_z.sum(axis=0)
                d_x[t] += d_z @ w[f"in_{side}"].T
                d_h, d_c = d_z @ w[f"re_{side}"].T, d_c * f
        np.add.at(slopes["embed"], chars.T, d_x)
        return float((total - gold).mean()), slopes


def train(
    chars: np.ndarray, tags: np.ndarray, n_tags: int, steps: int, rows: int = 48, seed: int = 0
) -> Tagger:
    """A tagger fitted to labelled rows by Adam; the same for the same rows."""
    model, rng = Tagger(n_tags, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(chars), min(rows, len(chars)))
        _, slopes = model.loss_and_slopes(chars[chosen], tags[chosen])
        size = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
        rate, clip = 0.02 * (1 - 0.9 * step / steps), min(1.0, 5.0 / (size + 1e-9))
        for k, g in slopes.items():
            g = g * clip
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g**2
            model.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return model
