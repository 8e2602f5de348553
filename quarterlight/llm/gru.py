"""A gated recurrent language model in numpy with a class-factored output softmax. Used inside tasks."""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a class of the head, which has a softmax of its own.
WIDTH = 64
#: Rows whose logits are worked on at once.
BLOCK = 512
#: Parameters, in the order in which they are packed.
NAMES = ("x", "u", "wc", "bc", "ww", "bw")


class Ranks(dict):
    """Ranks of words; those that aren't known have the rank after the last."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.n = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.n


class Vocabulary:
    """Ranks of the commonest words, their classes and counts.

    The first words, in classes of WIDTH, have probabilities that depend on the
    state; classes of the others, one for each of a few ranges of rank, share
    their probability among their words by count. All further words, known or
    not, are the last class. Rank 0 is the end of a document.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, rare: int, head: int, ranges: int):
        self.rank, self.words = Ranks(words), pa.array(words, pa.binary())
        self.counts = counts.astype(float)
        self.n = len(words)
        self.head = min(head, self.n)
        self.head_classes = -(-self.head // WIDTH)
        rest = self.n - self.head
        cuts = self.head + np.unique(np.geomspace(1, rest + 1, ranges + 1).astype(int) - 1) if rest else np.array([self.head])
        self.rare_class = self.head_classes + len(cuts) - 1
        self.classes = self.rare_class + 1
        self.cls = np.empty(self.n + 1, np.int64)
        self.cls[: self.head] = np.arange(self.head) // WIDTH
        self.cls[self.head : self.n] = self.head_classes + np.searchsorted(cuts, np.arange(self.head, self.n), "right") - 1
        self.cls[self.n] = self.rare_class
        #: What a token is to the state: itself in the head, else its class.
        self.seen_as = np.where(np.arange(self.n + 1) < self.head, np.arange(self.n + 1), self.head + self.cls - self.head_classes)
        self.inputs = self.head + self.classes - self.head_classes
        mass = np.bincount(self.cls, np.append(self.counts, rare), self.classes)
        self.mass = mass
        #: Log probability inside a class that doesn't depend on the state; 0 in the head and for the rare class.
        self.fixed = np.zeros(self.n + 1)
        self.fixed[self.head : self.n] = np.log(self.counts[self.head :] / mass[self.cls[self.head : self.n]])

    def encode(self, words: list[bytes]) -> np.ndarray:
        """Ranks of the words and the end; n for words of the last class."""
        return np.fromiter(chain(map(self.rank.__getitem__, words), (0,)), np.int32, len(words) + 1)

    def encode_together(self, words: pa.Array, times: np.ndarray) -> np.ndarray:
        """As encode, for the words of many documents one after the other, of which each has so many."""
        ends = np.cumsum(times + 1)
        out, inside = np.zeros(len(words) + len(times), np.int32), np.ones(len(words) + len(times), bool)
        inside[ends - 1] = False
        out[inside] = pc.fill_null(pc.index_in(words, value_set=self.words), self.n).to_numpy()
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(vocabulary: Vocabulary, hidden: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters of a model that gives each token its unigram probability."""
    rng, v = np.random.default_rng(seed), vocabulary
    scale = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    bw = np.full((v.head_classes, WIDTH), -1e9, np.float32)
    bw.reshape(-1)[: v.head] = np.log(v.counts[: v.head] / v.mass[v.cls[: v.head]])
    return {
        "x": scale(v.inputs, 3 * hidden) * 5, "u": scale(hidden, 3 * hidden) * 2,
        "wc": scale(hidden, v.classes) * 0.1, "bc": np.log((v.mass + 0.5) / (v.mass.sum() + 0.5 * v.classes)).astype(np.float32),
        "ww": scale(v.head_classes, hidden, WIDTH) * 0.1, "bw": bw,
    }


def pack(params: dict[str, np.ndarray]) -> bytes:
    return b"".join(params[k].astype("<f4").tobytes() for k in NAMES)


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _step(p: dict, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    n = h.shape[1]
    hu = h @ p["u"]
    rz = _sigmoid(gates[:, : 2 * n] + hu[:, : 2 * n])
    r, z = rz[:, :n], rz[:, n:]
    c = np.tanh(gates[:, 2 * n :] + r * hu[:, 2 * n :])
    return c + z * (h - c), r, z, c, hu[:, 2 * n :]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _class_order(cls: np.ndarray, head_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the head's tokens, class by class, and where each class begins and ends among them."""
    order = np.argsort(cls.astype(np.min_scalar_type(cls.max(initial=0))), kind="stable")  # short numbers are sorted by digits
    edges = np.searchsorted(cls[order], np.arange(head_classes + 1))
    return order[: edges[-1]], edges


def log_probabilities(p: dict, v: Vocabulary, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each target; that of the last class for its words."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = _log_probabilities(p, v, states, targets, False)
    return out if np.isfinite(out).all() else _log_probabilities(p, v, states, targets, True)


def _log_probabilities(p: dict, v: Vocabulary, states: np.ndarray, targets: np.ndarray, shift: bool) -> np.ndarray:
    """shift: takes each row's largest logit off first, which only logits beyond float32's exp need (biases are near log probabilities)."""
    buffer = np.empty(min(BLOCK, len(targets)) * max(v.classes, WIDTH), np.float32)

    def picked(states: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        many = np.exp(b)  # factors of the exponentials, so that biases needn't be added to each row
        for low in range(0, len(at), BLOCK):
            rows = slice(low, min(low + BLOCK, len(at)))
            size = rows.stop - low
            flat = buffer[: size * len(b)]
            logits = np.matmul(states[rows], w, out=flat.reshape(size, len(b)))
            if shift:
                out[rows] += _log_softmax(logits + b)[np.arange(size), at[rows]]
                continue
            own = flat.take(np.arange(0, len(flat), len(b)) + at[rows]) + b[at[rows]]
            np.exp(logits, out=logits)
            out[rows] += own - np.log(logits @ many)

    cls = v.cls[targets]
    out = v.fixed[targets]
    picked(states, p["wc"], p["bc"], cls, out)
    order, edges = _class_order(cls, v.head_classes)
    own, words, inside = states.take(order, axis=0), targets[order], np.zeros(len(order))
    for k in np.flatnonzero(np.diff(edges)):
        part = slice(edges[k], edges[k + 1])
        picked(own[part], p["ww"][k], p["bw"][k], words[part] - k * WIDTH, inside[part])
    out[order] += inside
    return out


def _apart(x: np.ndarray) -> np.ndarray:
    """The gates' parts of x, side by side in its rows, as arrays of their own; those of the first two with the sign that their sigmoid's exp takes."""
    out = np.ascontiguousarray(np.moveaxis(x.reshape(len(x), 3, -1), 1, 0))
    np.negative(out[:2], out=out[:2])
    return out


def _together(x: np.ndarray) -> np.ndarray:
    """Undoes _apart."""
    out = x.copy()
    np.negative(out[:2], out=out[:2])
    return np.moveaxis(out, 0, 1).reshape(x.shape[1], -1)


def _advance(u: np.ndarray, gates: np.ndarray, h: np.ndarray) -> np.ndarray:
    """As _step, for the state alone."""
    return _next(_apart(u), _apart(gates), h, np.empty_like(h))


def _next(u: np.ndarray, gates: np.ndarray, h: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The state after h, written to out; u and gates as _apart gives them, so that all that a step works on is without gaps."""
    hu = np.matmul(h, u)
    rz, c = hu[:2], hu[2]
    rz += gates[:2]
    np.exp(rz, out=rz)  # inf where the gate is shut
    rz += 1
    np.reciprocal(rz, out=rz)
    c *= rz[0]
    c += gates[2]
    np.tanh(c, out=c)
    np.subtract(h, c, out=out)
    out *= rz[1]
    out += c
    return out


def score(p: dict, v: Vocabulary, docs: list[np.ndarray], width: int = 512, window: int = 32) -> np.ndarray:
    """Natural log of each whole document's probability. Documents run side by side, each from an empty state that is carried over windows."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lengths = np.array([len(d) for d in docs])
    lanes = int(min(width, len(docs), max(1, -(-lengths.sum() // lengths.max()))))
    load = [(0, i) for i in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for d in np.argsort(-lengths, kind="stable"):
        n, lane = heapq.heappop(load)
        held[lane].append(d)
        heapq.heappush(load, (n + int(lengths[d]), lane))
    held.sort(key=lambda x: -lengths[x].sum())
    lane_length = np.array([lengths[x].sum() for x in held])
    steps = int(lane_length[0])
    target = np.zeros((steps + 1, lanes), np.int32)  # row 0 is the end before the first document
    for lane, x in enumerate(held):
        target[1 : lane_length[lane] + 1, lane] = np.concatenate([docs[d] for d in x])
    logs = np.zeros((steps, lanes), np.float32)
    live = np.searchsorted(-lane_length, -np.arange(steps), "left")
    h = np.zeros((lanes, p["u"].shape[0]), np.float32)
    u, by_gate = _apart(p["u"]), _apart(p["x"])
    for at in range(0, steps, window):
        upto, most = min(at + window, steps), int(live[at])
        inputs = target[at:upto, :most]
        gates = by_gate.take(v.seen_as[inputs], axis=1)
        bounds = np.append(0, np.cumsum(live[at:upto]))
        states = np.empty((bounds[-1], h.shape[1]), np.float32)
        for t in range(at, upto):
            n = int(live[t])
            h = h[:n]
            ended = np.flatnonzero(inputs[t - at, :n] == 0)
            if len(ended):  # after an end a document begins with an empty state
                h = h.copy()
                h[ended] = 0
            with np.errstate(over="ignore"):
                h = _next(u, gates[:, t - at, :n], h, states[bounds[t - at] : bounds[t - at + 1]])
        marks = np.concatenate([target[t + 1, : live[t]] for t in range(at, upto)])
        found = log_probabilities(p, v, states, marks)
        for t in range(at, upto):
            logs[t, : live[t]] = found[bounds[t - at] : bounds[t - at + 1]]
    for lane, x in enumerate(held):
        ends = np.cumsum(lengths[x])
        total[x] = np.add.reduceat(logs[: lane_length[lane], lane].astype(float), np.concatenate([[0], ends[:-1]]))
    return total


def _class_errors(states: np.ndarray, w: np.ndarray, many: np.ndarray, back: np.ndarray, at: np.ndarray, weight: np.ndarray, d_states: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients under softmaxes of states @ w + b with targets at `at`, rows weighted: those of w and b short of the factor `many`; that of the states is written to d_states.

    many is exp(b) and back (w * many).T: biases are factors of the exponentials
    and weights are put on the states' side, so the logits, BLOCK rows at a time
    in buffer, are gone through as seldom as can be.
    """
    d_w, d_b = np.zeros_like(w), np.zeros_like(many)
    for low in range(0, len(at), BLOCK):
        own, chosen = states[low : low + BLOCK], at[low : low + BLOCK]
        flat = buffer[: len(own) * len(many)]
        out = np.matmul(own, w, out=flat.reshape(len(own), len(many)))
        np.exp(out, out=out)
        total = out @ many
        flat[np.arange(0, len(flat), len(many)) + chosen] -= total / many[chosen]
        each = weight[low : low + BLOCK] / total
        d = np.matmul(out, back, out=d_states[low : low + BLOCK])
        d *= each[:, None]
        d_w += (own * each[:, None]).T @ out
        d_b += each @ out
    return d_w, d_b


def _shifted_class_errors(states: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray, weight: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradients of _class_errors with the factor, for logits of any size."""
    out = np.exp(_log_softmax(states @ w + b))
    out[np.arange(len(at)), at] -= 1
    out *= weight[:, None]
    np.matmul(out, w.T, out=d_states)
    return states.T @ out, out.sum(axis=0)


def _errors(p: dict, v: Vocabulary, states: np.ndarray, targets: np.ndarray, cls: np.ndarray, weight: np.ndarray, buffer: np.ndarray, shift: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the softmaxes' parameters and of the states, for targets of the classes cls; rows are weighted.

    shift: takes each row's largest logit off first, which only logits beyond float32's exp need.
    """
    grads, d_states = {"ww": np.zeros_like(p["ww"]), "bw": np.zeros_like(p["bw"])}, np.empty_like(states)
    order, edges = _class_order(cls, v.head_classes)
    own, words, own_weight, d_own = states.take(order, axis=0), targets[order] - cls[order] * WIDTH, weight[order], np.empty((len(order), states.shape[1]), np.float32)
    parts = [(k, slice(edges[k], edges[k + 1])) for k in np.flatnonzero(np.diff(edges))]
    if shift:
        grads["wc"], grads["bc"] = _shifted_class_errors(states, p["wc"], p["bc"], cls, weight, d_states)
        for k, part in parts:
            grads["ww"][k], grads["bw"][k] = _shifted_class_errors(own[part], p["ww"][k], p["bw"][k], words[part], own_weight[part], d_own[part])
    else:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            many, many_own = np.exp(p["bc"]), np.exp(p["bw"])
            back, back_own = (np.ascontiguousarray(np.swapaxes(w, -1, -2)) for w in (p["wc"] * many, p["ww"] * many_own[:, None]))
            grads["wc"], grads["bc"] = _class_errors(states, p["wc"], many, back, cls, weight, d_states, buffer)
            for k, part in parts:
                grads["ww"][k], grads["bw"][k] = _class_errors(own[part], p["ww"][k], many_own[k], back_own[k], words[part], own_weight[part], d_own[part], buffer)
            for name, factor in (("wc", many), ("bc", many), ("ww", many_own[:, None]), ("bw", many_own)):
                grads[name] *= factor
    inside = np.zeros_like(d_states)
    inside[order] = d_own
    d_states += inside
    if not shift and not all(np.isfinite(x).all() for x in (d_states, *grads.values())):
        return _errors(p, v, states, targets, cls, weight, buffer, True)
    return grads, d_states


def train(p: dict, v: Vocabulary, ids: np.ndarray, lanes: int = 512, window: int = 16, rate: float = 0.2, squares: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """One pass of truncated backpropagation through time over all ids (documents with their ends, one after the other), by Adagrad.

    As many lanes run side by side as give a few hundred steps or more, `lanes`
    at most; what fills the last of them up isn't learned from. squares, a dict
    that may be empty, carries Adagrad's sums on from call to call.
    """
    p = {k: x.copy() for k, x in p.items()}
    lanes = max(1, min(lanes, len(ids) // (128 * window)))
    steps = -(-len(ids) // lanes)
    target = np.append(ids, np.zeros(steps * lanes - len(ids), ids.dtype)).reshape(lanes, steps).T
    filled = (np.arange(steps * lanes) >= len(ids)).reshape(lanes, steps).T
    squares = {} if squares is None else squares
    for k, x in p.items():
        squares.setdefault(k, np.full_like(x, 1e-6))
    n, rate, inputs_seen = p["u"].shape[0], np.float32(rate), v.seen_as.astype(np.min_scalar_type(v.inputs))
    by_gate, u = _apart(p["x"]), _apart(p["u"])
    kept = p | {"x": by_gate, "u": u}
    kept_squares = squares | {k: np.abs(_apart(squares[k])) for k in ("x", "u")}
    h, before = np.zeros((lanes, n), np.float32), np.zeros(lanes, ids.dtype)
    carried, hu_c, states = (np.empty((window, lanes, n), np.float32) for _ in range(3))
    buffer = np.empty(BLOCK * max(v.classes, WIDTH), np.float32)
    hu, d_gates = np.empty((2, lanes, n), np.float32), np.empty((3, lanes, n), np.float32)
    for at in range(0, steps, window):
        y = np.ascontiguousarray(target[at : at + window])
        length, flat = len(y), y.reshape(-1)
        if length < window:
            carried, hu_c, states = carried[:length], hu_c[:length], states[:length]
        none = np.flatnonzero(filled[at : at + window].reshape(-1))
        if len(none) == len(flat):
            break
        inputs = np.concatenate([before[None], y[:-1]])
        before = y[-1]
        seen, ended = inputs_seen[inputs].reshape(-1), [np.flatnonzero(x == 0) for x in inputs]
        gates = by_gate.take(seen, axis=1).reshape(3, length, lanes, n)
        with np.errstate(over="ignore"):
            for t in range(length):
                rz, c = gates[:2, t], gates[2, t]
                carried[t] = h
                carried[t, ended[t]] = 0
                np.matmul(carried[t], u[:2], out=hu)
                np.matmul(carried[t], u[2], out=hu_c[t])
                rz += hu
                np.exp(rz, out=rz)
                rz += 1
                np.reciprocal(rz, out=rz)
                np.multiply(rz[0], hu_c[t], out=hu[0])
                c += hu[0]
                np.tanh(c, out=c)
                h = states[t]
                np.subtract(carried[t], c, out=h)
                h *= rz[1]
                h += c
        h = h.copy()
        weight = np.full(len(flat), 1 / (len(flat) - len(none)), np.float32)
        all_states, cls = states.reshape(-1, n), v.cls[flat]
        if len(none):
            weight[none], cls[none] = 0, v.rare_class
        grads, d_states = _errors(p, v, all_states, flat, cls, weight, buffer)
        d_states = d_states.reshape(length, lanes, n)
        r, z, cs = gates
        shut = 1 - z
        of_z = carried - cs
        of_z *= z
        of_z *= shut
        np.negative(of_z, out=of_z)  # of the part with the sign that _apart gives it, as of_r
        of_c = cs * cs
        np.subtract(1, of_c, out=of_c)
        of_c *= shut
        of_r = r - 1
        of_r *= r
        of_r *= hu_c
        # of what comes in by the word, and of what comes in by the state
        d_by_gate, u_back = np.empty((3, length, lanes, n), np.float32), np.ascontiguousarray(u.transpose(0, 2, 1))
        d_h = np.zeros((lanes, n), np.float32)
        for t in reversed(range(length)):
            d_h += d_states[t]
            d_r, d_z, d_c = d_by_gate[:, t]
            np.multiply(d_h, of_c[t], out=d_c)
            np.multiply(d_c, of_r[t], out=d_r)
            np.multiply(d_h, of_z[t], out=d_z)
            np.matmul(d_by_gate[:2, t], u_back[:2], out=d_gates[:2])
            np.multiply(d_c, r[t], out=hu_c[t])
            np.matmul(hu_c[t], u_back[2], out=d_gates[2])
            d_h *= z[t]
            for d in d_gates:
                d_h += d
            d_h[ended[t]] = 0
        back = carried.transpose(0, 2, 1)
        grads["u"] = np.stack([np.matmul(back, x).sum(axis=0) for x in (d_by_gate[0], d_by_gate[1], hu_c)])
        by, times = np.argsort(seen, kind="stable"), np.bincount(seen)
        which = np.flatnonzero(times)
        grads["x"] = np.zeros_like(by_gate)
        grads["x"][:, which] = np.add.reduceat(d_by_gate.reshape(3, -1, n).take(by, axis=1), np.cumsum(times[which]) - times[which], axis=1)
        norm = np.sqrt(sum(float(g.reshape(-1) @ g.reshape(-1)) for g in grads.values()))
        shrink = np.float32(min(1.0, 1.0 / (norm + 1e-12)))
        for k, g in grads.items():
            g *= shrink
            kept_squares[k] += g * g
            kept[k] -= rate * g / np.sqrt(kept_squares[k])
    p["x"], p["u"] = _together(by_gate), _together(u)
    squares["x"], squares["u"] = (np.abs(_together(kept_squares[k])) for k in ("x", "u"))
    return p
