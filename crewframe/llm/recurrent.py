"""A gated recurrent network over word classes, in numpy: forward, truncated backpropagation, updates."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

#: hidden units
HIDDEN = 32
#: classes that words without a place of their own fall into
TAILS = 32
#: words of a class at most
CLASS_WORDS = 128
#: logits as far apart as this get one shift before they are raised; float32 holds their powers
SPREAD = 60
#: rows of an id that are added up for all ids at once
AT_ONCE = 16
#: words of the texts that are packed into lanes at once
PACKED = 1 << 22


@dataclass
class Vocabulary:
    """``counts`` of the words with places 0, 1, ..., most frequent first, then of the TAILS classes of the other words.

    Words with places are cut into classes of about equal sums of the square root of their share, as frequent words
    deserve small classes; ``edges`` are the places where classes begin, and the end.
    """

    counts: np.ndarray
    tails: np.ndarray

    def __post_init__(self):
        root = np.sqrt(np.maximum(self.counts, 1e-9))
        wanted = max(1, round(np.sqrt(len(root))))
        label = np.minimum((np.cumsum(root) - root) / max(root.sum(), 1e-9) * wanted, wanted - 1).astype(int)
        edges = [0]
        for place in range(1, len(root)):
            if label[place] != label[place - 1] or place - edges[-1] == CLASS_WORDS:
                edges.append(place)
        self.edges = np.array([*edges, len(root)] if len(root) else [0])
        self.n_head = len(self.edges) - 1
        self.class_of = np.concatenate(
            [np.repeat(np.arange(self.n_head), np.diff(self.edges)), self.n_head + np.arange(TAILS)]
        ).astype(np.int64)

    @property
    def start(self) -> int:
        """The input before the first word."""
        return len(self.counts) + TAILS


def first_weights(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram distribution, with random inputs and recurrence."""
    draw = np.random.default_rng(seed)
    classes = np.array([vocabulary.counts[a:b].sum() for a, b in zip(vocabulary.edges, vocabulary.edges[1:], strict=False)])
    n_classes = vocabulary.n_head + TAILS
    shares = np.concatenate([classes, vocabulary.tails]) + 0.5
    return {
        "x": draw.normal(0, 0.3, (vocabulary.start + 1, 3 * HIDDEN)).astype(np.float32),
        "h": draw.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "c": np.zeros((HIDDEN, n_classes), np.float32),
        "cb": np.log(shares / shares.sum()).astype(np.float32),
        "u": np.zeros((len(vocabulary.counts), HIDDEN), np.float32),
        "ub": np.log(vocabulary.counts + 0.5).astype(np.float32),
    }


class Room:
    """Arrays that are used again from window to window, as touching new memory costs more than the arithmetic on it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], like: np.ndarray) -> np.ndarray:
        """An array of any content, valid until the next of its ``name``."""
        size = math.prod(shape)
        held = self.held.get(name)
        if held is None or held.size < size or held.dtype != like.dtype:
            held = self.held[name] = np.empty(size, like.dtype)
        return held[:size].reshape(shape)


def _gates(rows: np.ndarray) -> np.ndarray:
    """A view of rows of three gates, of any shape before them, that has the gates first."""
    return np.moveaxis(rows.reshape(*rows.shape[:-1], 3, HIDDEN), -2, 0)


def _walk(
    x: np.ndarray, h3: np.ndarray, h: np.ndarray, room: Room, fresh: np.ndarray | None = None, steps: int | None = None
) -> tuple:
    """States of rows over a window, the one before it first; twice the gates z and r with half the third of ``h`` times the weights; n.

    ``x`` is what the inputs add to the gates (half of it for z and r), as (gate, step, row, unit), and ``h3`` the recurrent weights as
    (gate, unit, unit).  Rows marked in ``fresh`` (step, row) forget their state before that step.
    Gates and n are of the last ``steps`` at least, all without a number: what no way back needs is overwritten while it is in the cache.
    """
    steps = steps or x.shape[1]
    states = room("states", (x.shape[1] + 1, *x.shape[2:]), x)
    states[0] = h
    back, n = room("back", (3, steps, *x.shape[2:]), x), room("n", (steps, *x.shape[2:]), x)
    # a sigmoid is half of one more than the tanh of half its input
    h3 = h3 * h3.dtype.type(0.5)
    begun = fresh.any(axis=1) if fresh is not None else np.zeros(x.shape[1], bool)
    for t in range(x.shape[1]):
        before, gates, new, after = states[t], back[:, t % steps], n[t % steps], states[t + 1]
        if begun[t]:
            before = np.where(fresh[t][:, None], before.dtype.type(0), before)
        np.matmul(before, h3, out=gates)
        zr = gates[:2]
        zr += x[:2, t]
        np.tanh(zr, out=zr)
        zr += 1
        np.multiply(gates[1], gates[2], out=new)
        new += x[2, t]
        np.tanh(new, out=new)
        np.subtract(before, new, out=after)
        after *= gates[0]
        after *= 0.5
        after += new
    return states, back, n


def step(w: dict[str, np.ndarray], ids: np.ndarray, h: np.ndarray) -> tuple:
    """The state after one more input of each row, and the gates."""
    x = _gates(w["x"][ids[None]])
    x[:2] *= 0.5
    states, back, n = _walk(x, np.ascontiguousarray(_gates(w["h"])), h, Room())
    return states[1], (back[0, 0] / 2, back[1, 0] / 2, n[0], back[2, 0] * 2)


def log_probs(vocabulary: Vocabulary, w: dict, states: np.ndarray, targets: np.ndarray, grads: dict | None = None, room: Room | None = None):
    """Log probability (natural) of each target after its state: class, then word within the class.

    With ``grads``, puts the gradient of the negative sum into it and returns the states' gradient as well.

    The logits of all classes' words, and of the classes, are blocks (choice, target) of one flat array.
    """
    room = room or Room()
    order = np.argsort(vocabulary.class_of[targets].astype(np.int16), kind="stable")
    # side by side by class, so that a class is a slice, with a one for the bias
    words = targets.take(order)
    classes = vocabulary.class_of[words]
    laid = room("laid", (len(words), HIDDEN + 1), states)
    laid[:, :HIDDEN] = states.take(order, axis=0, out=room("sorted", states.shape, states), mode="clip")
    laid[:, HIDDEN] = 1
    by_class, by_word = np.column_stack([w["c"].T, w["cb"]]), np.column_stack([w["u"], w["ub"]])
    # the words that have others in their class: by class its first word, its words, its targets, where these begin
    sizes = np.append(np.diff(vocabulary.edges), np.zeros(TAILS, int))
    keep = np.flatnonzero(sizes[classes] > 1)
    bounds = np.searchsorted(classes[keep], np.arange(len(sizes) + 1))
    times = np.diff(bounds)
    begin = np.cumsum(sizes * times) - sizes * times + len(by_class) * len(words)
    flat = room("logits", (len(by_class) * len(words) + int((sizes * times).sum()),), states)
    top = flat[: len(by_class) * len(words)].reshape(len(by_class), len(words))
    inner = laid.take(keep, axis=0, out=room("inner", (len(keep), HIDDEN + 1), states), mode="clip")
    blocks = [
        (slice(vocabulary.edges[c], vocabulary.edges[c + 1]), slice(bounds[c], bounds[c + 1]),
         flat[begin[c] : begin[c] + sizes[c] * times[c]].reshape(sizes[c], times[c]))
        for c in np.flatnonzero(times)
    ]
    np.matmul(by_class, laid.T, out=top)
    for of, part, block in blocks:
        np.matmul(by_word[of], inner[part].T, out=block)
    most = flat.max(initial=-np.inf)
    if most - flat.min(initial=np.inf) < SPREAD:
        flat -= most
    else:
        for block in [top, *(block for _, _, block in blocks)]:
            block -= block.max(axis=0)
    at = classes[keep]
    within = begin[at] + (words[keep] - vocabulary.edges[at]) * times[at] + np.arange(len(keep)) - bounds[at]
    place = np.concatenate([classes * len(words) + np.arange(len(words)), within])
    own = flat.take(place)
    np.exp(flat, out=flat)
    total = np.empty_like(own)
    ones = np.ones(max(len(by_class), CLASS_WORDS), states.dtype)
    np.matmul(ones[: len(by_class)], top, out=total[: len(words)])
    in_total = total[len(words) :]
    for _, part, block in blocks:
        np.matmul(ones[: len(block)], block, out=in_total[part])
    logs = own - np.log(total)
    out = logs[: len(words)].copy()
    out[keep] += logs[len(words) :]
    found = np.empty_like(out)
    found[order] = out
    if grads is None:
        return found
    # powers less the total at the target are the gradient times the total, by which the states are divided instead
    flat[place] -= total
    share, in_share = np.split(1 / total[:, None], [len(words)])
    laid *= share
    d_class = top @ laid
    d_laid = np.matmul(top.T, by_class[:, :HIDDEN], out=room("d_laid", (len(words), HIDDEN), states))
    d_laid *= share
    inner *= in_share
    d_word, d_inner = room("d_word", by_word.shape, states), room("d_inner", (len(keep), HIDDEN), states)
    d_word.fill(0)
    for of, part, block in blocks:
        np.matmul(block, inner[part], out=d_word[of])
        np.matmul(block.T, by_word[of, :HIDDEN], out=d_inner[part])
    d_inner *= in_share
    d_laid[keep] += d_inner
    grads |= {"c": d_class[:, :HIDDEN].T, "cb": d_class[:, HIDDEN], "u": d_word[:, :HIDDEN], "ub": d_word[:, HIDDEN]}
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return found, d_laid.take(back, axis=0, out=room("d_states", d_laid.shape, d_laid), mode="clip")


def _sums_by_id(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``ids``, and the sums of their ``rows`` (gate, row, unit) as one row of all gates."""
    counts = np.bincount(ids)
    met = np.flatnonzero(counts)
    order = np.argsort(ids.astype(np.uint16) if len(counts) < 1 << 16 else ids, kind="stable")
    often = np.argsort(-counts[met], kind="stable")
    first = (np.cumsum(counts[met]) - counts[met])[often]
    met = met[often]
    n = counts[met]
    # the first few of each id all at once, what is left of the frequent ids one id after the other
    sums = rows.take(order[first], axis=1)
    for k in range(1, min(AT_ONCE, int(n[0]))):
        more = int((n > k).sum())
        sums[:, :more] += rows.take(order[first[:more] + k], axis=1)
    for i in range(int((n > AT_ONCE).sum())):
        more = rows.take(order[first[i] + AT_ONCE : first[i] + n[i]], axis=1)
        sums[:, i] += np.ones(more.shape[1], more.dtype) @ more
    return met, np.moveaxis(sums, 0, 1).reshape(len(met), -1)


def _gradients(vocabulary: Vocabulary, w: dict, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, room: Room):
    """What :func:`backpropagate` returns, with the ids that were met before the gradients, which hold only their rows of ``x``."""
    grads: dict[str, np.ndarray] = {}
    h3 = np.ascontiguousarray(_gates(w["h"]))
    turned = np.ascontiguousarray(inputs.T)
    x = w["x"].take(turned, axis=0, out=room("x", (*turned.shape, 3 * HIDDEN), h), mode="clip")
    x[..., : 2 * HIDDEN] *= 0.5
    states, back, n = _walk(_gates(x), h3, h, room)
    back *= np.array([0.5, 0.5, 2], back.dtype)[:, None, None, None]
    before, (z, r, third) = states[:-1], back
    wanted = targets.T.ravel()
    flat = states[1:].reshape(-1, HIDDEN)
    real = np.flatnonzero(wanted >= 0)
    if len(real) == len(wanted):
        out, d_states = log_probs(vocabulary, w, flat, wanted, grads, room)
    else:
        out, d_real = log_probs(vocabulary, w, flat.take(real, axis=0), wanted.take(real), grads, room)
        d_states = np.zeros_like(flat)
        d_states[real] = d_real
    d = d_states.reshape(n.shape)
    # each gate's gradient is the state's times what is known before the way back
    kept = np.subtract(1, z, out=room("kept", n.shape, n))
    d_new = np.multiply(n, n, out=room("d_new", n.shape, n))
    np.subtract(1, d_new, out=d_new)
    d_new *= kept
    slope = room("slope", back.shape, back)
    np.subtract(before, n, out=slope[0])
    slope[0] *= z
    slope[0] *= kept
    np.multiply(d_new, r, out=slope[2])
    np.subtract(1, r, out=slope[1])
    slope[1] *= third
    slope[1] *= slope[2]
    h3_turned = np.ascontiguousarray(h3.transpose(0, 2, 1))
    d_next, through = np.zeros_like(h), np.empty((3, *h.shape), h.dtype)
    for t in reversed(range(inputs.shape[1])):
        d[t] += d_next
        slope[:, t] *= d[t]
        np.matmul(slope[:, t], h3_turned, out=through)
        np.multiply(d[t], z[t], out=d_next)
        for gate in through:
            d_next += gate
    came = before.reshape(-1, HIDDEN).T
    grads["h"] = np.concatenate([came @ gate.reshape(-1, HIDDEN) for gate in slope], axis=1)
    np.multiply(d, d_new, out=slope[2])
    ids, grads["x"] = _sums_by_id(slope.reshape(3, -1, HIDDEN), turned.ravel())
    return -float(out.sum()), len(real), ids, grads, states[-1]


def backpropagate(vocabulary: Vocabulary, w: dict, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray):
    """One window: (loss, tokens, gradients, state after it).

    ``inputs`` and ``targets`` are (rows, window); a target of -1 is no word.  The state ``h`` that comes in is taken as
    given, which is where the backpropagation is cut off.
    """
    loss, n, ids, grads, h = _gradients(vocabulary, w, inputs, targets, h, Room())
    whole = np.zeros_like(w["x"])
    whole[ids] = grads["x"]
    return loss, n, grads | {"x": whole}, h


class Trainer:
    """Adagrad over windows of rows of word places; the state is carried from window to window of a row."""

    def __init__(self, vocabulary: Vocabulary, weights: dict[str, np.ndarray], window: int = 16, rate: float = 0.1):
        self.vocabulary, self.window, self.rate = vocabulary, window, rate
        self.weights = {k: v.copy() for k, v in weights.items()}
        self.squares = {k: np.full_like(v, 1e-2) for k, v in weights.items()}
        self.tokens, self.loss, self.room = 0, 0.0, Room()

    def learn(self, rows: list[np.ndarray]) -> None:
        """Rows of places; the first of each is the input before its first word.  A row that has ended is left out."""
        rows = sorted(rows, key=len, reverse=True)
        lengths = np.array([len(row) for row in rows])
        table = np.full((len(rows), lengths[0]), -1, np.int64)
        for i, row in enumerate(rows):
            table[i, : len(row)] = row
        h = np.zeros((len(rows), HIDDEN), np.float32)
        for at in range(0, int(lengths[0]) - 1, self.window):
            live = int((lengths - 1 > at).sum())
            inputs = np.maximum(table[:live, at : min(at + self.window, int(lengths[0]) - 1)], 0)
            targets = table[:live, at + 1 : at + 1 + inputs.shape[1]]
            loss, n, ids, grads, h = _gradients(self.vocabulary, self.weights, inputs, targets, h[:live], self.room)
            self.loss, self.tokens = self.loss + loss, self.tokens + n
            self.update(grads, ids, targets, 1.0 / live)

    def update(self, grads: dict[str, np.ndarray], ids: np.ndarray, targets: np.ndarray, scale: float) -> None:
        """Only rows that the window touched (of ``x`` the ``ids``): the gradient of the others is zero, which moves nothing."""
        met = np.zeros(self.vocabulary.n_head + TAILS, bool)
        met[self.vocabulary.class_of[targets[targets >= 0]]] = True
        met = met[self.vocabulary.class_of[: len(self.vocabulary.counts)]]
        # a slice is quicker than most rows by number
        words = np.flatnonzero(met) if met.sum() * 2 < len(met) else slice(None)
        rows = {"x": ids, "u": words, "ub": words}
        grads = {k: g[words] if k in ("u", "ub") else g for k, g in grads.items()}
        powers = {k: g * g for k, g in grads.items()}
        norm = scale * math.sqrt(sum(float(p.sum()) for p in powers.values()))
        scale *= min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            at = rows.get(k, slice(None))
            squares = powers[k]
            squares *= np.float32(scale * scale)
            squares += self.squares[k][at]
            self.squares[k][at] = squares
            np.sqrt(squares, out=squares)
            np.divide(g, squares, out=squares)
            squares *= np.float32(self.rate * scale)
            self.weights[k][at] -= squares


def _lanes(texts: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets (-1: none) and text numbers, each (step, lane): texts one after the other in lanes of about equal length."""
    sizes = [len(text) - 1 for text in texts]
    wide = min(rows, max(1, -(-sum(sizes) // max(1, max(sizes)))))
    filled = [(0, lane) for lane in range(wide)]
    places = []
    for size in sizes:  # longest first, each into the lane that ends first
        at, lane = heapq.heappop(filled)
        places.append((lane, at))
        heapq.heappush(filled, (at + size, lane))
    shape = (wide, max(at for at, _ in filled))
    inputs, targets, owner = np.zeros(shape, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
    for i, (text, size, (lane, at)) in enumerate(zip(texts, sizes, places, strict=True)):
        inputs[lane, at : at + size], targets[lane, at : at + size], owner[lane, at : at + size] = text[:-1], text[1:], i
    return tuple(np.ascontiguousarray(table.T) for table in (inputs, targets, owner))


def log_likelihoods(vocabulary: Vocabulary, w: dict, texts: list[np.ndarray], rows: int = 1024, window: int = 8) -> np.ndarray:
    """Natural log probability of whole texts (rows of places, each begun by the start).

    Texts go side by side in lanes, and in a lane one after the other; the state is carried across windows to the end of each
    text, however long, and forgotten at the next start.  Memory is bounded by ``rows`` x ``window`` states, and by
    PACKED words or one text.
    """
    total = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    x, h3 = (np.ascontiguousarray(_gates(w[k])) for k in "xh")
    x[:2] *= 0.5
    room = Room()
    first = 0
    while first < len(order):
        last, held = first + 1, len(texts[order[first]])
        while last < len(order) and held + len(texts[order[last]]) <= PACKED:
            held += len(texts[order[last]])
            last += 1
        group = order[first:last]
        first = last
        inputs, targets, owner = _lanes([texts[i] for i in group], rows)
        wide = inputs.shape[1]
        steps = max(1, rows * window // wide)
        h = np.zeros((wide, HIDDEN), x.dtype)
        sums = np.zeros(len(group))
        for at in range(0, len(inputs), steps):
            ids, wanted = inputs[at : at + steps], targets[at : at + steps].ravel()
            added = x.take(ids, axis=1, out=room("x", (3, *ids.shape, HIDDEN), x), mode="clip")
            states, _, _ = _walk(added, h3, h, room, ids == vocabulary.start, steps=1)
            h = states[-1]
            real = np.flatnonzero(wanted >= 0)
            flat = states[1:].reshape(-1, HIDDEN)
            flat = flat if len(real) == len(flat) else flat.take(real, axis=0)
            out = log_probs(vocabulary, w, flat, wanted.take(real), room=room)
            sums += np.bincount(owner[at : at + steps].ravel()[real], out, len(group))
        total[group] = sums
    return total
