"""A gated recurrent network over word ids with a class-factored softmax, in numpy.

Texts run in lanes, many side by side; a lane holds whole texts one after another and its state starts at zero with each.
Lanes that are through are left out. Inside a window the lanes come last, so each part of the gates is one block of memory.
Gradients stop at the border of a window, states do not. Output words are cut in the order of their ids into classes of
equal size. Biases start at the log shares of the words' weights, so an untrained network is the unigram model. States carry
a last column of ones, so the last row of the class and word layers is the bias.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN = 32
CLASS_WORDS = 64
RATE = 0.1  # of the Adagrad steps
FLOOR = 1e-8  # of the sums of squares
NOTHING = -60.0  # log share of places that no word fills
BLOCK = 1_024  # rows whose logits are worked on at a time
TILE = 16  # rows of slopes added up by one product
LARGE = 60  # a logit whose exponential leaves little room for sums


@dataclass
class Network:
    """``given``: gate inputs of each word id; ``loop``: state to gates; then the class and word layers."""

    given: np.ndarray
    loop: np.ndarray
    to_class: np.ndarray
    to_word: np.ndarray

    NAMES = ("given", "loop", "to_class", "to_word")

    @staticmethod
    def untrained(weights: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> Network:
        """For words of the given weights."""
        rng = np.random.default_rng(seed)
        size = len(weights)
        classes = max(1, -(-size // CLASS_WORDS))
        padded = np.zeros(classes * CLASS_WORDS)
        padded[:size] = weights
        by_class = padded.reshape(classes, CLASS_WORDS)
        mass = by_class.sum(axis=1)
        to_class = np.zeros((hidden + 1, classes), dtype=np.float32)
        to_word = np.zeros((classes, hidden + 1, CLASS_WORDS), dtype=np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            to_class[-1] = np.nan_to_num(np.maximum(np.log(mass / mass.sum()), NOTHING), nan=0)
            to_word[:, -1] = np.nan_to_num(np.maximum(np.log(by_class / mass[:, None]), NOTHING), nan=0)
        scale = 1 / np.sqrt(hidden)
        return Network(
            (rng.standard_normal((size + 1, 3 * hidden)) * scale).astype(np.float32),
            (rng.standard_normal((hidden, 3 * hidden)) * scale).astype(np.float32), to_class, to_word,
        )

    @property
    def start(self) -> int:
        """The id given at the start of a text, next to those of the words."""
        return len(self.given) - 1

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Network:
        """A network of this shape with a copy of the parameters of ``flat``."""
        parts, at = [], 0
        for n in self.NAMES:
            own = getattr(self, n)
            parts.append(flat[at : at + own.size].reshape(own.shape).astype(np.float32))
            at += own.size
        return Network(*parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes(texts: list[np.ndarray], width: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts packed into ``width`` lanes of about equal length: inputs, targets, owner (-1: nothing) and first-word flags, all (steps, lanes)."""
    width = max(1, min(width, len(texts)))
    loads, place = np.zeros(width, dtype=np.int64), []
    for i in np.argsort([-len(t) for t in texts], kind="stable"):
        lane = int(loads.argmin())
        place.append((int(i), lane, int(loads[lane])))
        loads[lane] += len(texts[i])
    steps = int(loads.max(initial=0))
    given = np.full((steps, width), start, dtype=np.int32)
    wanted = np.zeros((steps, width), dtype=np.int32)
    owner = np.full((steps, width), -1, dtype=np.int32)
    first = np.zeros((steps, width), dtype=bool)
    for i, lane, at in place:
        ids = texts[i]
        end = at + len(ids)
        given[at + 1 : end, lane] = ids[:-1]
        wanted[at:end, lane] = ids
        owner[at:end, lane] = i
        first[at, lane] = True
    return given, wanted, owner, first


class Room:
    """Arrays that windows use again: pages are asked of the system once, not for each window."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of the shape, of whatever content; it is lent until the name is asked for again."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, dtype=self.kind)
        return self.held[name][:size].reshape(shape)


def _forward(net: Network, given: np.ndarray, first: np.ndarray, state: np.ndarray, room: Room, keep: bool) -> tuple[np.ndarray, tuple]:
    """States after each step of a window and, if asked for, what the backward pass needs of each step.

    ``state`` and all that is returned has the lanes last, so the parts of the gates are blocks of memory.
    """
    hidden = net.loop.shape[0]
    steps, width = given.shape
    states = room("states", steps, hidden + 1, width)
    states[:, hidden] = 1
    fresh, turn, rows = first.any(axis=1), np.ascontiguousarray(net.loop.T), room("rows", width, 3 * hidden)
    from_word = rows.T
    before, both, new, turned = (room(n, steps if keep else 1, k * hidden, width) for n, k in (("before", 1), ("both", 2), ("new", 1), ("turned", 3)))
    for t in range(steps):
        at = t if keep else 0
        if keep or fresh[t]:
            before[at] = state
            state = before[at]
        if fresh[t]:
            state[:, first[t]] = 0
        # Ids are those of the network's words; "clip" only spares the copy that "raise" makes.
        net.given.take(given[t], axis=0, out=rows, mode="clip")
        by_state, gates, own, after = turned[at], both[at], new[at], states[t, :hidden]
        np.matmul(turn, state, out=by_state)
        np.add(by_state[: 2 * hidden], from_word[: 2 * hidden], out=gates)
        _sigmoid(gates)
        np.multiply(gates[hidden:], by_state[2 * hidden :], out=own)
        own += from_word[2 * hidden :]
        np.tanh(own, out=own)
        np.subtract(state, own, out=after)
        after *= gates[:hidden]
        after += own
        state = after
    return states, (before, both, new, turned)


def _by_word(states: np.ndarray, real: np.ndarray) -> np.ndarray:
    """One row for each word of a window's states."""
    rows = states.transpose(0, 2, 1)
    return rows.reshape(-1, rows.shape[2]) if real.all() else rows[real]


def _exp_sums(logits: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
    """Sums of the exponentials of each row, which take the place of the logits, and by what large rows were shifted first."""
    shift = 0
    if logits.max(initial=0) > LARGE:
        top = np.maximum(logits.max(axis=1, keepdims=True), 0)
        logits -= top
        shift = top[:, 0]
    np.exp(logits, out=logits)
    return logits @ ones[: logits.shape[1]], shift


def _log_shares(logits: np.ndarray, wanted: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the share of the wanted place of each row, whose logits are used up."""
    mine = logits[np.arange(len(logits)), wanted].astype(np.float64)
    sums, shift = _exp_sums(logits, ones)
    return mine - (np.log(sums) + shift)


def _spans(net: Network, wanted: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The order of the rows by class, and the classes that occur with their spans."""
    classes = (wanted // CLASS_WORDS).astype(np.uint16 if len(net.to_word) < 65_536 else np.int64)  # short ones are sorted by radix
    order = np.argsort(classes, kind="stable")
    edges = np.searchsorted(classes[order], np.arange(len(net.to_word) + 1)).tolist()
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


def _ones(net: Network) -> np.ndarray:
    """To add up the rows of any layer's logits."""
    return np.ones(max(CLASS_WORDS, net.to_class.shape[1]), dtype=net.to_class.dtype)


def _blocks(span: slice) -> list[slice]:
    """A span of rows cut into blocks whose logits stay in a core's cache."""
    return [slice(a, min(a + BLOCK, span.stop)) for a in range(span.start, span.stop, BLOCK)]


def log_probabilities(net: Network, states: np.ndarray, wanted: np.ndarray, room: Room) -> np.ndarray:
    """Natural log probability of each wanted id given its state."""
    order, spans = _spans(net, wanted)
    states, wanted, found = states.take(order, axis=0), wanted[order], np.empty(len(wanted))
    classes, places, ones = wanted // CLASS_WORDS, wanted % CLASS_WORDS, _ones(net)
    for block in _blocks(slice(0, len(wanted))):
        logits = np.matmul(states[block], net.to_class, out=room("logits", block.stop - block.start, net.to_class.shape[1]))
        found[block] = _log_shares(logits, classes[block], ones)
    for c, span in spans:
        for block in _blocks(span):
            logits = np.matmul(states[block], net.to_word[c], out=room("logits", block.stop - block.start, CLASS_WORDS))
            found[block] += _log_shares(logits, places[block], ones)
    total = np.empty(len(wanted))
    total[order] = found
    return total


def score(net: Network, texts: list[np.ndarray], width: int = 256, window: int = 64) -> np.ndarray:
    """Natural log probability of each whole text; the state goes on from window to window."""
    # No more lanes than last as long as the longest text, which takes its steps anyhow.
    width = min(width, -(-sum(map(len, texts)) // max(map(len, texts), default=1)))
    given, wanted, owner, first = lanes(texts, width, net.start)
    total, room = np.zeros(len(texts)), Room(net.loop.dtype)
    state = np.zeros((net.loop.shape[0], given.shape[1]), dtype=net.loop.dtype)
    # Lanes end at different steps; those that are through are left out of later windows, which are longer instead.
    used, at = (owner >= 0).sum(axis=0), 0
    while at < len(given):
        live = np.flatnonzero(used > at)
        rows = slice(at, at + max(window, width * window // len(live)))
        states = _forward(net, given[rows][:, live], first[rows][:, live], state[:, live], room, False)[0]
        state[:, live] = states[-1, :-1]
        mine = owner[rows][:, live]
        real = mine >= 0
        p = log_probabilities(net, _by_word(states, real), wanted[rows][:, live][real], room)
        total += np.bincount(mine[real], weights=p, minlength=len(texts))
        at = rows.stop
    return total


def _softmax_slope(logits: np.ndarray, wanted: np.ndarray, count: int, ones: np.ndarray) -> np.ndarray:
    """The slope of the mean loss by the logits, in their place."""
    sums = _exp_sums(logits, ones)[0]
    logits *= (1 / count / sums).astype(logits.dtype)[:, None]
    logits[np.arange(len(logits)), wanted] -= 1 / count
    return logits


def added(rows: np.ndarray, ids: np.ndarray, room: Room) -> np.ndarray:
    """Sums of the rows of each of the sorted ids, by products of small tiles; zeros fill the last tile.

    ``reduceat`` runs down each column for itself, and a sum for each id is one call for each.
    """
    new = np.diff(ids, prepend=-1) != 0
    nth, at = np.cumsum(new) - 1, np.arange(len(ids))
    place = nth - nth[::TILE].repeat(TILE)[: len(ids)]
    tiles = len(rows) // TILE
    which, parts = room("which", tiles, TILE, TILE), room("parts", tiles, TILE, rows.shape[1])
    which[:] = 0
    which[at // TILE, place, at % TILE] = 1
    np.matmul(which, rows.reshape(tiles, TILE, -1), out=parts)
    starts = at[new]
    sums = parts.reshape(-1, rows.shape[1]).take(starts // TILE * TILE + place[starts], axis=0)
    # An id that goes on into further tiles is the first one there.
    further = np.flatnonzero(~new[::TILE])
    whose = nth[further * TILE]
    edges = np.flatnonzero(np.diff(whose, prepend=-1, append=-1)).tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        sums[whose[a]] += parts[further[a] : further[b - 1] + 1, 0].sum(axis=0)
    return sums


class Trainer:
    """Adagrad over truncated backpropagation; a word's row of inputs or outputs shares one sum of squares."""

    # The axis whose gradients share a sum.
    SHARED = {"given": 1, "to_word": 1}

    def __init__(self, net: Network, seen: np.ndarray | None = None):
        """``seen``: the sums of squares that an earlier trainer ended with, as ``sums`` gives them."""
        self.net, self.seen, at = net, {}, 0
        for n in Network.NAMES:
            shape = list(getattr(net, n).shape)
            if n in self.SHARED:
                shape[self.SHARED[n]] = 1
            size = int(np.prod(shape))
            own = np.full(size, FLOOR, dtype=np.float32) if seen is None else seen[at : at + size].astype(np.float32)
            self.seen[n], at = own.reshape(shape), at + size
        self.room = Room(net.loop.dtype)

    def sums(self) -> np.ndarray:
        return np.concatenate([self.seen[n].ravel() for n in Network.NAMES])

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        own, seen = getattr(self.net, name), self.seen[name]
        square = gradient**2
        if name in self.SHARED:
            square = square.mean(axis=self.SHARED[name], keepdims=True)
        if rows is None:
            seen += square
            own -= gradient * (RATE / np.sqrt(seen))
        else:
            now = seen[rows] + square
            seen[rows] = now
            gradient *= RATE / np.sqrt(now)
            own[rows] -= gradient

    def train(self, texts: list[np.ndarray], width: int = 256, window: int = 32, piece: int = 1_024) -> None:
        """One pass over the texts; those of more than ``piece`` words are cut, so that lanes end together."""
        net = self.net
        texts = [t[at : at + piece] for t in texts for at in range(0, len(t), piece)]
        given, wanted, owner, first = lanes(texts, width, net.start)
        state = np.zeros((given.shape[1], net.loop.shape[0]), dtype=np.float32)
        real = owner >= 0
        used = real.sum(axis=0)
        for at in range(0, len(given), window):
            rows, live = slice(at, at + window), np.flatnonzero(used > at)
            own = (x[rows][:, live] for x in (given, wanted, real, first))
            state[live] = self._window(*own, state[live], given[rows].size)

    def _window(self, given, wanted, real, first, state, count: int | None = None) -> np.ndarray:
        """``count``: words of a window whose lanes all go on."""
        net, room, hidden = self.net, self.room, self.net.loop.shape[0]
        steps, width = given.shape
        states, (before, both, new, turned) = _forward(net, given, first, np.ascontiguousarray(state.T), room, True)
        last = states[-1, :hidden].T.copy()
        h, y = _by_word(states, real), wanted[real]
        count = count or wanted.size  # also where lanes have ended: fewer words, a smaller step
        dh, grad_class, grad_word, used = self._outputs(h, y, count)
        if len(h) < wanted.size:
            own, dh = dh, room("spread", wanted.size, hidden + 1)
            dh[:] = 0
            dh[real.ravel()] = own
        dh = dh.reshape(steps, width, hidden + 1)
        # Only the flow from step to step is a loop; the slopes of a step are made there, while they are at hand.
        own, flow, passed = room("own", 3 * hidden, width), room("flow", hidden, width), room("passed", hidden, width)
        by_z, by_r, by_new = own[:hidden], own[hidden : 2 * hidden], own[2 * hidden :]
        odd = room("odd", 3 * hidden, width + 16)[:, :width]
        slopes = room("slopes", steps, width, 3 * hidden)
        grad_loop, part, fresh = np.zeros_like(net.loop), np.empty_like(net.loop), first.any(axis=1)
        flow[:] = 0
        for t in range(steps - 1, -1, -1):
            flow += dh[t, :, :hidden].T
            z, r, old, now = both[t, :hidden], both[t, hidden:], before[t], new[t]
            # What the state keeps: flow * z; then by_z = flow * (old - now) * z * (1 - z), and flow * (1 - z) goes on to the new value.
            np.multiply(flow, z, out=passed)
            np.subtract(old, now, out=by_z)
            by_z *= passed
            np.subtract(1, z, out=z)
            by_z *= z
            flow *= z
            # by_new = flow * (1 - now**2)
            np.multiply(now, now, out=by_new)
            np.subtract(1, by_new, out=by_new)
            by_new *= flow
            # by_r = by_new * turned * r * (1 - r)
            np.subtract(1, r, out=by_r)
            by_r *= r
            by_r *= turned[t, 2 * hidden :]
            by_r *= by_new
            # By way of rows of an odd length: those of a power of two fall on each other in the cache.
            odd[:] = own
            slopes[t] = odd.T
            # The state's part of the new value passes through r.
            by_new *= r
            grad_loop += np.matmul(old, own.T, out=part)
            np.matmul(net.loop, own, out=flow)
            flow += passed
            if fresh[t]:
                flow[:, first[t]] = 0
        self._step("to_class", grad_class)
        self._step("to_word", grad_word, used)
        self._step("loop", grad_loop)
        self._step("given", *self._inputs(given.ravel(), slopes.reshape(-1, 3 * hidden)))
        return last

    def _outputs(self, h: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Slopes by the states, the class layer and the word layers of the classes that occur, which come last."""
        net, room, size, ones = self.net, self.room, self.net.loop.shape[0] + 1, _ones(self.net)
        order, spans = _spans(net, y)
        h, y, dh = h.take(order, axis=0, out=room("sorted", len(h), size), mode="clip"), y[order], room("by_state", len(h), size)
        classes, places, used = y // CLASS_WORDS, y % CLASS_WORDS, np.array([c for c, _ in spans], dtype=np.int64)
        grad_class, part = np.zeros_like(net.to_class), np.empty_like(net.to_class)
        for block in _blocks(slice(0, len(h))):
            d = np.matmul(h[block], net.to_class, out=room("logits", block.stop - block.start, net.to_class.shape[1]))
            _softmax_slope(d, classes[block], count, ones)
            np.matmul(d, net.to_class.T, out=dh[block])
            grad_class += np.matmul(h[block].T, d, out=part)
        grad_word, part, inner = np.zeros((len(used), size, CLASS_WORDS), dtype=h.dtype), np.empty((size, CLASS_WORDS), dtype=h.dtype), room("inner", BLOCK, size)
        for n, (c, span) in enumerate(spans):
            for block in _blocks(span):
                d = np.matmul(h[block], net.to_word[c], out=room("logits", block.stop - block.start, CLASS_WORDS))
                _softmax_slope(d, places[block], count, ones)
                grad_word[n] += np.matmul(h[block].T, d, out=part)
                dh[block] += np.matmul(d, net.to_word[c].T, out=inner[: len(d)])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return dh.take(back, axis=0, out=room("by_word", len(h), size), mode="clip"), grad_class, grad_word, used

    def _inputs(self, ids: np.ndarray, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes by the rows of the words given, and the words."""
        order = np.argsort(ids.astype(np.uint16) if len(self.net.given) < 65_536 else ids, kind="stable")
        ids, whole = ids[order], -(-len(ids) // TILE) * TILE
        rows = self.room("taken", whole, slopes.shape[1])
        slopes.take(order, axis=0, out=rows[: len(ids)], mode="clip")
        rows[len(ids) :] = 0
        return added(rows, ids, self.room), ids[np.flatnonzero(np.diff(ids, prepend=-1))]
