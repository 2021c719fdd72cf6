"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Words of the vocabulary are ids 0.. in order of frequency, in classes that hold CLASS_WORDS of the
commonest and more of the rarer ones; every other word is the id UNKNOWN, a class of its own. The
chance of a word is that of its class times that within its class. Texts are packed end to end into lanes that run side by side; the state goes on
from window to window until the text ends and is zero at the start of each text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Words of a class; where more words than CLASS_GROWTH times that come before it, their number over CLASS_GROWTH.
CLASS_WORDS, CLASS_GROWTH = 128, 32
#: Steps of a window: the truncation length in training, and the block of the softmax in scoring.
WINDOW = 24
#: Tokens that training takes of a text at a stretch.
SPAN = 20 * WINDOW
HIDDEN, EMBEDDED = 32, 24
#: Rows whose chances are worked out at a time, and rows of weights that take a step at a time.
BLOCK_ROWS = 1024
ONES = np.ones(1 << 16, np.float32)
#: Share of the recurrent model in the mixture with the smoothed word frequencies.
SHARE = 0.95


@dataclass
class Gru:
    """Weights by name; `base` holds the vocabulary's smoothed frequencies."""

    base: np.ndarray
    weights: dict[str, np.ndarray]

    @cached_property
    def edges(self) -> np.ndarray:
        """First word of each class, and the number of words."""
        return class_edges(len(self.base))

    @cached_property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.classes, dtype=np.int32), np.diff(self.edges))

    @cached_property
    def ranked(self) -> np.ndarray:
        """Class of each id, the unknown word's too, in the smallest numbers, which sort fastest."""
        return np.append(self.class_of, self.classes).astype(np.uint16 if self.classes < 1 << 16 else np.int32)

    @property
    def classes(self) -> int:
        return len(self.edges) - 1

    @property
    def unknown(self) -> int:
        return len(self.base)

    @property
    def start(self) -> int:
        return len(self.base) + 1

    @classmethod
    def initial(cls, base: np.ndarray, seed: int = 1) -> Gru:
        """Small random recurrent weights; output weights zero, so that the frequencies are what it says at first."""
        rng = np.random.default_rng(seed)
        n, edges = len(base), class_edges(len(base))
        words = np.maximum(base, 1e-30)
        by_class = np.array([words[a:b].sum() for a, b in zip(edges, edges[1:], strict=False)])
        rest = max(1e-12, 1 - base.sum())
        weights = {
            "embed": rng.normal(0, 0.1, (n + 2, EMBEDDED)),
            "inward": rng.normal(0, EMBEDDED**-0.5, (EMBEDDED, 3 * HIDDEN)),
            "gate_bias": np.zeros(3 * HIDDEN),
            "across": rng.normal(0, 0.5 * HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
            "class_out": np.zeros((HIDDEN, len(by_class) + 1)),
            "class_bias": np.log(np.append(by_class, rest)),
            "word_out": np.zeros((n, HIDDEN)),
            "word_bias": np.log(words / np.repeat(by_class, np.diff(edges))),
        }
        return cls(base.astype(np.float64), {k: v.astype(np.float32) for k, v in weights.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def with_flat(self, values: np.ndarray) -> Gru:
        out, at = {}, 0
        for name, w in self.weights.items():
            out[name] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return Gru(self.base, out)


def class_edges(n: int) -> np.ndarray:
    edges = [0]
    while edges[-1] < n:
        edges.append(min(n, edges[-1] + max(CLASS_WORDS, edges[-1] // CLASS_GROWTH)))
    return np.array(edges)


@dataclass
class Lanes:
    """Texts end to end in lanes, the longest lane first, and the lanes one after another: lane k is edges[k] to edges[k + 1].

    owner: the text of each token; starts: true at a text's first. Nothing is padded, so that one long text costs its own tokens only.
    """

    targets: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    edges: np.ndarray

    def __len__(self) -> int:
        return len(self.edges) - 1


def lanes(texts: list[np.ndarray], most: int, order: np.ndarray | None = None) -> Lanes:
    """The longest texts go first, or those that `order` names first, each to the shortest lane so far."""
    sizes = np.array([len(t) for t in texts])
    count = max(1, min(most, len(texts)))
    heap, where = [(0, k) for k in range(count)], [[] for _ in range(count)]
    for i in np.argsort(-sizes, kind="stable") if order is None else order:
        used, k = heapq.heappop(heap)
        where[k].append(i)
        heapq.heappush(heap, (used + int(sizes[i]), k))
    by_size = sorted(heap, reverse=True)  # the longest lane first, so that those still going are the first ones
    placed = np.concatenate([where[k] for _, k in by_size]).astype(np.int64)
    starts = np.zeros(int(sizes.sum()), bool)
    starts[np.cumsum(sizes[placed]) - sizes[placed]] = True
    edges = np.cumsum([0, *(used for used, _ in by_size)])
    return Lanes(np.concatenate([texts[i] for i in placed]), np.repeat(placed.astype(np.int32), sizes[placed]), starts, edges)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def windows(model: Gru, packed: Lanes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each window, steps by lanes still going: targets (-1 beyond a lane's end), places in `packed`, starts and input ids: the word before, or the mark of a start."""
    sizes = np.diff(packed.edges)
    for at in range(0, int(sizes[0]), WINDOW):
        going = int(np.searchsorted(-sizes, -at))  # lanes with more than `at` tokens
        steps = np.arange(at, min(at + WINDOW, int(sizes[0])))[:, None]
        beyond = steps >= sizes[:going]
        places = np.where(beyond, 0, packed.edges[:going] + steps)
        starts = packed.starts[places] & ~beyond
        inputs = np.where(starts | beyond, model.start, packed.targets[places - 1]).astype(np.int32)
        yield np.where(beyond, -1, packed.targets[places].astype(np.int32)), places, starts, inputs


def by_class(model: Gru, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
    """An order of the ids by class, the unknown ones last; the classes in it; and words and places of each class that has ids."""
    of = model.ranked[ids]
    order = np.argsort(of, kind="stable")
    of = of[order]
    cuts = np.searchsorted(of, np.arange(model.classes + 1))
    found = [(slice(int(model.edges[c]), int(model.edges[c + 1])), slice(int(cuts[c]), int(cuts[c + 1]))) for c in np.flatnonzero(np.diff(cuts))]
    return order, of, found


def exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of x in place, and the sums of its rows; of rows less their greatest, where some are far above what log chances reach."""
    if x.max(initial=0) > 30:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    sums = x @ ONES[: x.shape[1]] if x.shape[1] <= len(ONES) else x.sum(axis=1)
    return x, np.maximum(sums, np.float32(1e-30), out=sums)


def blocks(rows: slice) -> Iterator[slice]:
    """The rows in parts of BLOCK_ROWS, whose products stay in the processor's cache."""
    for at in range(rows.start, rows.stop, BLOCK_ROWS):
        yield slice(at, min(at + BLOCK_ROWS, rows.stop))


def softmax_error(x: np.ndarray, targets: np.ndarray, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Two factors of the softmax over the last axis less one at each row's target, times scale: x in place, and a number for each row.

    The second is left to the narrow matrices that the first meets.
    """
    x, sums = exponentials(x)
    x[np.arange(len(x)), targets] -= sums
    return x, np.divide(scale, sums, out=sums)


def score(model: Gru, texts: list[np.ndarray], most_lanes: int = 1024) -> np.ndarray:
    """Log10 probability of each text (ids, the end included); of an unknown word, relative to its own frequency.

    The word's chance is SHARE times the model's and 1 - SHARE times its smoothed frequency; unknown
    words share the model's chance of their class by their frequencies.
    """
    out = np.zeros(len(texts))
    if not texts:
        return out
    w, n = model.weights, len(model.base)
    table = w["embed"] @ w["inward"] + w["gate_bias"]
    across, cut = w["across"], 2 * HIDDEN
    rest = max(1e-12, 1 - model.base.sum())
    class_out, word_out = np.vstack([w["class_out"], w["class_bias"]]), np.column_stack([w["word_out"], w["word_bias"]])
    packed = lanes(texts, most_lanes)
    state = np.zeros((len(packed), HIDDEN), np.float32)
    for targets, places, starts, inputs in windows(model, packed):
        state = state[: inputs.shape[1]]
        states = np.ones((len(inputs), len(state), HIDDEN + 1), np.float32)  # and a one, that meets the biases
        for t in range(len(inputs)):
            if starts[t].any():
                state[starts[t]] = 0
            x, inner = table.take(inputs[t], axis=0), state @ across
            gates = x[:, :cut]
            gates += inner[:, :cut]
            sigmoid(gates)
            fresh = inner[:, cut:]
            fresh *= gates[:, :HIDDEN]
            fresh += x[:, cut:]
            np.tanh(fresh, out=fresh)
            state -= fresh
            state *= gates[:, HIDDEN:]
            state += fresh
            states[t, :, :HIDDEN] = state
        there = targets.ravel()
        live = np.flatnonzero(there >= 0)
        order, of, found = by_class(model, there[live])
        live = live[order]
        ids, hidden = there[live], states.reshape(-1, HIDDEN + 1)[live]
        p = np.empty(len(ids), np.float32)
        for rows in blocks(slice(0, len(ids))):
            chance, sums = exponentials(hidden[rows] @ class_out)
            p[rows] = chance[np.arange(len(chance)), of[rows]] / sums
        p = p.astype(np.float64)
        for block, all_rows in found:
            out_of = word_out[block].T
            for rows in blocks(all_rows):
                within, sums = exponentials(hidden[rows] @ out_of)
                p[rows] *= within[np.arange(len(within)), ids[rows] - block.start] / sums
        p *= SHARE
        known = int(np.searchsorted(of, model.classes))
        p[:known] += (1 - SHARE) * model.base[ids[:known]]
        p[known:] = p[known:] / rest + (1 - SHARE)
        out += np.bincount(packed.owner[places.ravel()[live]], np.log10(p), len(texts))
    return out


class Trainer:
    """Steps of truncated backpropagation with per-weight rates (Adagrad)."""

    def __init__(self, model: Gru, rate: float = 0.2, floor: float = 1e-4):
        self.model, self.rate = model, rate
        self.squares = {k: np.full(v.shape, floor, np.float32) for k, v in model.weights.items()}
        self.word_slopes = {k: np.zeros_like(model.weights[k]) for k in ("word_out", "word_bias")}
        self.room = np.empty(0, np.float32)
        self.tokens, self.width = 0, 1

    def descend(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        squares = self.squares[name][rows]
        root = gradient * gradient
        squares += root
        if not isinstance(rows, slice):
            self.squares[name][rows] = squares
        np.sqrt(squares, out=root)
        gradient *= np.float32(self.rate)
        gradient /= root
        self.model.weights[name][rows] -= gradient

    def run(self, texts: list[np.ndarray], most_lanes: int = 48, seed: int = 1) -> None:
        """One pass over the texts, cut into spans and mixed, so that no text has the last word."""
        spans = [t[at : at + SPAN] for t in texts for at in range(0, len(t), SPAN)]
        if not spans:
            return
        packed = lanes(spans, most_lanes, np.random.default_rng(seed).permutation(len(spans)))
        self.width = len(packed)
        state = np.zeros((self.width, HIDDEN), np.float32)
        for targets, _, starts, inputs in windows(self.model, packed):
            state = self.step(targets, inputs, starts, state[: inputs.shape[1]])

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a @ b in memory that the next product takes again."""
        size = len(a) * b.shape[1]
        if len(self.room) < size:
            self.room = np.empty(size, np.float32)
        return np.matmul(a, b, out=self.room[:size].reshape(len(a), -1))

    def step(self, targets: np.ndarray, inputs: np.ndarray, reset: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One update from one window; the state after it."""
        model, w, cut = self.model, self.model.weights, 2 * HIDDEN
        steps, count = inputs.shape
        embedded = w["embed"][inputs]
        x = (embedded.reshape(-1, EMBEDDED) @ w["inward"] + w["gate_bias"]).reshape(steps, count, -1)
        before, gates, inner, fresh = (np.empty((steps, count, k), np.float32) for k in (HIDDEN, cut, HIDDEN, HIDDEN))
        states = np.empty((steps, count, HIDDEN), np.float32)
        for t in range(steps):
            before[t] = state
            if reset[t].any():
                before[t][reset[t]] = 0
            over = before[t] @ w["across"]
            inner[t] = over[:, cut:]
            gates[t] = sigmoid(x[t, :, :cut] + over[:, :cut])
            fresh[t] = np.tanh(x[t, :, cut:] + gates[t, :, :HIDDEN] * inner[t])
            state = fresh[t] + gates[t, :, HIDDEN:] * (before[t] - fresh[t])
            states[t] = state
        there = targets.ravel()
        live = np.flatnonzero(there >= 0)
        if not len(live):
            return state
        self.tokens += len(live)
        scale = np.float32(1 / (WINDOW * self.width))  # thinly filled windows weigh less
        order, of, found = by_class(model, there[live])
        live = live[order]
        ids, hidden = there[live], states.reshape(-1, HIDDEN)[live]
        error = self.product(hidden, w["class_out"])
        error += w["class_bias"]
        error, share = softmax_error(error, of, scale)
        pull = error @ w["class_out"].T
        pull *= share[:, None]
        updates = [("class_out", (hidden * share[:, None]).T @ error, slice(None)), ("class_bias", share @ error, slice(None))]
        words, bias, slopes, bias_slopes = w["word_out"], w["word_bias"], *self.word_slopes.values()
        stepped: list[slice] = []
        for block, rows in found:
            own, weights = hidden[rows], words[block]
            error = self.product(own, weights.T)
            error += bias[block]
            error, share = softmax_error(error, ids[rows] - block.start, scale)
            back = error @ weights
            back *= share[:, None]
            pull[rows] += back
            np.matmul(error.T, own * share[:, None], out=slopes[block])
            np.matmul(share, error, out=bias_slopes[block])
            # Classes side by side take their step together.
            if stepped and stepped[-1].stop == block.start and block.stop - stepped[-1].start <= BLOCK_ROWS:
                stepped[-1] = slice(stepped[-1].start, block.stop)
            else:
                stepped.append(block)
        updates += [(name, slope[part], part) for part in stepped for name, slope in self.word_slopes.items()]
        outer = np.zeros((steps * count, HIDDEN), np.float32)
        outer[live] = pull
        outer = outer.reshape(steps, count, HIDDEN)
        r, z = gates[..., :HIDDEN], gates[..., HIDDEN:]
        by_fresh, by_z, by_r = (1 - z) * (1 - fresh * fresh), (before - fresh) * z * (1 - z), inner * r * (1 - r)
        d_x, d_over, carry = np.empty_like(x), np.empty_like(x), np.zeros((count, HIDDEN), np.float32)
        back = np.ascontiguousarray(w["across"].T)
        for t in range(steps - 1, -1, -1):
            d = outer[t] + carry
            d_fresh = np.multiply(d, by_fresh[t], out=d_x[t, :, cut:])
            over = d_over[t]
            np.multiply(d_fresh, by_r[t], out=over[:, :HIDDEN])
            np.multiply(d, by_z[t], out=over[:, HIDDEN:cut])
            np.multiply(d_fresh, r[t], out=over[:, cut:])
            carry = over @ back
            d *= z[t]
            carry += d
            carry[reset[t]] = 0
        d_x[..., :cut] = d_over[..., :cut]
        d_across = before.reshape(-1, HIDDEN).T @ d_over.reshape(steps * count, -1)
        d_x = d_x.reshape(steps * count, -1)
        given = inputs.ravel().astype(np.uint16 if model.start < 1 << 16 else np.int32)  # the smallest numbers sort fastest
        order = np.argsort(given, kind="stable")
        given = given[order]
        firsts = np.flatnonzero(np.append(True, given[1:] != given[:-1]))
        seen = given[firsts]
        d_embed = np.add.reduceat((d_x @ w["inward"].T)[order], firsts, axis=0)
        updates += [("across", d_across, slice(None)), ("inward", embedded.reshape(-1, EMBEDDED).T @ d_x, slice(None)), ("gate_bias", d_x.sum(axis=0), slice(None)), ("embed", d_embed, seen)]
        for name, gradient, rows in updates:
            self.descend(name, gradient, rows)
        return state
