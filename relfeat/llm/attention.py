"""A causal self-attention model over subword ids, in numpy.

One attention layer reads a window of ids; a hidden layer on what it sees gives the next id's probability by a two-level softmax
over the ids themselves: classes of ids of like frequency, then the ids of a class. In the last class stand buckets of rare ids,
which part their bucket's probability by frequency; ids that no training text has share one bucket. Long texts are scored in overlapping windows: each id once, with CONTEXT ids or more before it (or the text's
start), many windows at a time under one causal mask.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Ids in a window, and those of them that the previous window has scored already.
WINDOW, CONTEXT = 32, 6
#: Widths of the embeddings and of the hidden layer.
WIDTH, HIDDEN = 16, 32
#: Windows of a training step, and of a scoring step.
BATCH, _SCORED = 32, 512
#: Windows that the attention looks at together, and rows at least that the softmax takes together: what stays near a core.
_LOOKED, _ROWS = 128, 2048
#: Adam's rates of forgetting, and its step.
_FORGET, _FORGET_SQUARES, RATE = 0.9, 0.99, 0.02
_MASK = np.tri(WINDOW, dtype=np.float32)
#: Exponents stay below this.
_LIMIT = np.float32(60)
_SCALE = np.float32(1 / math.sqrt(WIDTH))


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _sum_rows(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows summed by their number in at."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(at.astype(np.uint16) if n <= 1 << 16 else at, kind="stable")  # short ones are sorted by digits
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out[at[first]] = np.add.reduceat(rows.take(order, 0), first, 0)
    return out


@dataclass
class AttentionModel:
    """place: where each id stands by frequency, rare ones in buckets; share: an id's log share of its place. Classes are `size`
    places in a row, the last class has the buckets."""

    place: np.ndarray
    share: np.ndarray
    size: int
    classes: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def over(cls, counts: np.ndarray, seed: int = 5) -> AttentionModel:
        """Untrained, for ids that come so often: it gives each id its frequency. The last id ends a text."""
        seen = int((counts > 0).sum())
        # As many classes as places in one, for ids that are common; rare ones are so many that they come seldom all told.
        size = max(2, math.ceil(seen**0.45))
        common = min(seen, size * size)
        classes = -(-common // size) + 1
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        # Buckets grow by a constant factor in ranks; unseen ids have the last.
        spread = np.log1p(np.maximum(rank - common, 0)) / math.log(max(2, seen - common + 1))
        bucket = np.minimum((spread * (size - 1)).astype(np.int64), size - 2)
        bucket[counts == 0] = size - 1
        place = np.where(rank < common, rank, (classes - 1) * size + bucket)
        often = np.bincount(place, np.maximum(counts, 1e-3 * (counts == 0)), classes * size)
        share = np.log(np.maximum(counts, 1e-3)) - np.log(often[place])
        often = often.reshape(classes, size)
        rng = np.random.default_rng(seed)
        draw = lambda n, *shape: (rng.standard_normal((n, *shape)) / math.sqrt(n)).astype(np.float32)
        few = lambda *shape: (0.3 * rng.standard_normal(shape)).astype(np.float32)
        weights = {"last": few(classes * size + 1, WIDTH), "before": few(classes * size + 1, WIDTH), "position": few(WINDOW, WIDTH) / 3}
        weights |= {name: draw(WIDTH, WIDTH) for name in ("query", "key", "value")} | {"hidden": draw(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32)}
        # Places that no id has are out of reach.
        weights |= {"class": np.zeros((HIDDEN, classes), np.float32), "class_bias": np.log(np.maximum(often.sum(1), 1e-12)).astype(np.float32)}
        weights |= {"member": np.zeros((classes, HIDDEN, size), np.float32), "member_bias": np.log(np.maximum(often, 1e-17)).astype(np.float32)}
        return cls(place, share, size, classes, weights)

    @property
    def outside(self) -> int:
        """What stands for places before a text."""
        return self.classes * self.size

    def gather(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts laid end to end, each place's last id, the one before, and the id that follows: as places."""
        following = self.place[ids]
        starts = np.cumsum(sizes) - sizes
        out = []
        back = following
        for n in (1, 2):
            back = np.concatenate(([self.outside], back[:-1])) if len(back) else back
            for i in range(n):
                at = starts[sizes > i] + i
                back[at] = self.outside
            out.append(back)
            back = back.copy()
        return out[0], out[1], following

    def _inward(self) -> np.ndarray:
        """What gives queries (scaled), keys and values from what stands at a place, beside which is a nought."""
        w = self.weights
        out = np.zeros((WIDTH + 1, 3 * WIDTH), w["key"].dtype)
        np.concatenate((w["query"] * _SCALE, w["key"], w["value"]), 1, out=out[:WIDTH])
        return out

    def look(self, last: np.ndarray, before: np.ndarray, low: int = 0, kept: list | None = None) -> np.ndarray:
        """The hidden layer at the places from low of each window, and a column of ones. kept: gets what a step back needs."""
        w = self.weights
        n, many = last.shape
        kind, inward = w["hidden"].dtype, self._inward()
        wide = lambda part: np.concatenate((part, np.zeros((len(part), 1), kind)), 1)
        tables = wide(w["last"]), wide(w["before"]), wide(w["position"])
        outward = np.zeros((WIDTH + 1, HIDDEN + 1), kind)
        outward[:WIDTH, :HIDDEN], outward[WIDTH, :HIDDEN], outward[WIDTH, HIDDEN] = w["hidden"], w["shift"], 1
        h = np.empty((n, many - low, HIDDEN + 1), kind)
        for i in range(0, n, _LOOKED):
            x = tables[0].take(last[i : i + _LOOKED], 0)
            x += tables[1].take(before[i : i + _LOOKED], 0)
            x += tables[2]
            # Queries, keys, values, and a one, of which a row of a sees the row's sum.
            qkv = np.empty((*x.shape[:2], 3 * WIDTH + 1), kind)
            np.matmul(_flat(x), inward, out=_flat(qkv)[:, :-1])
            qkv[..., -1] = 1
            a = qkv[:, low:, :WIDTH] @ qkv[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1)
            # Scores beyond the limit, which training doesn't reach, count as it, so that exponentials need no shift.
            if a.max() > _LIMIT:
                np.minimum(a, _LIMIT, out=a)
            np.exp(a, out=a)
            a *= _MASK[low:]
            seen = a @ qkv[..., 2 * WIDTH :]
            total = seen[..., WIDTH:] + np.float32(1e-30)
            seen /= total
            y = seen + x[:, low:]
            np.matmul(_flat(y), outward, out=_flat(h[i : i + _LOOKED]))
            if kept is not None:
                kept.append((x, qkv, a, seen, total, y))
        h = _flat(h)
        return np.maximum(h, 0, out=h)

    def heads(self) -> np.ndarray:
        """For each class, what gives the classes and its own members from the hidden layer and a one."""
        w = self.weights
        out = np.empty((self.classes, HIDDEN + 1, self.classes + self.size), w["class"].dtype)
        out[:, :HIDDEN, : self.classes], out[:, HIDDEN, : self.classes] = w["class"], w["class_bias"]
        out[:, :HIDDEN, self.classes :], out[:, HIDDEN, self.classes :] = w["member"], w["member_bias"]
        return out

    def _by_class(self, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, list]]]:
        """An order by class, the classes and members in that order, and parts of it of some thousand rows: each part's span, and the
        classes in it with theirs from its start."""
        group, member = np.divmod(following.astype(np.int32), np.int32(self.size))
        order = np.argsort(group.astype(np.int16), kind="stable")
        many = np.bincount(group, minlength=self.classes).tolist()
        parts, low, at, spans = [], 0, 0, []
        for c, n in enumerate(many):
            if n:
                spans.append((c, at - low, at - low + n))
                at += n
                if at - low >= _ROWS:
                    parts.append((low, at, spans))
                    low, spans = at, []
        if spans:
            parts.append((low, at, spans))
        return order, group[order], member[order], parts

    def _shares(self, h: np.ndarray, heads: np.ndarray, group: np.ndarray, member: np.ndarray, spans: list) -> tuple[np.ndarray, ...]:
        """Of rows by class: exponentials for the classes and for the own class's members, their sums, where the chosen ones stand
        in them, and the log probabilities."""
        z = np.empty((len(h), heads.shape[2]), h.dtype)
        for c, i, j in spans:
            np.matmul(h[i:j], heads[c], out=z[i:j])
        if z.max() > _LIMIT:
            np.minimum(z, _LIMIT, out=z)
        at = np.arange(0, z.size, z.shape[1])
        at = at + group, at + (member + self.classes)
        own = z.ravel().take(at[0])
        own += z.ravel().take(at[1])
        np.exp(z, out=z)
        ones = np.ones(z.shape[1], z.dtype)
        total = z[:, : self.classes] @ ones[: self.classes], z[:, self.classes :] @ ones[self.classes :]
        own -= np.log(total[0] * total[1])
        return z, total, at, own

    def log_p(self, h: np.ndarray, rows: np.ndarray, following: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The natural log probability of the places that follow some rows of the hidden layer."""
        order, group, member, parts = self._by_class(following)
        rows, out = rows[order], np.empty(len(rows))
        for i, j, spans in parts:
            out[order[i:j]] = self._shares(h.take(rows[i:j], 0), heads, group[i:j], member[i:j], spans)[3]
        return out

    def gradients(self, last: np.ndarray, before: np.ndarray, following: np.ndarray, alive: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the following ids where alive, and its gradients."""
        w, kept = self.weights, []
        h = self.look(last, before, kept=kept)
        order, group, member, parts = self._by_class(following.ravel())
        share = (alive.ravel()[order] / max(1, int(alive.sum()))).astype(h.dtype)
        heads = self.heads()
        back = np.ascontiguousarray(heads.transpose(0, 2, 1))
        g_heads, dh, loss = np.zeros_like(heads), np.empty_like(h), 0.0
        for low, high, spans in parts:
            own, weight = h.take(order[low:high], 0), share[low:high]
            z, total, at, gain = self._shares(own, heads, group[low:high], member[low:high], spans)
            loss -= float(gain @ weight)
            z[:, : self.classes] *= (weight / total[0])[:, None]
            z[:, self.classes :] *= (weight / total[1])[:, None]
            flat = z.reshape(-1)
            for chosen in at:
                flat[chosen] -= weight
            own_dh = dh[low:high]
            for c, i, j in spans:
                np.matmul(own[i:j].T, z[i:j], out=g_heads[c])
                np.matmul(z[i:j], back[c], out=own_dh[i:j])
            own_dh *= own > 0
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        dh = dh.take(place, 0)
        of_class = g_heads[:, :, : self.classes].sum(0)
        g = {"class": of_class[:HIDDEN], "class_bias": of_class[HIDDEN], "member": g_heads[:, :HIDDEN, self.classes :], "member_bias": g_heads[:, HIDDEN, self.classes :]}
        inward, hidden = self._inward(), np.zeros((HIDDEN + 1, WIDTH + 1), h.dtype)
        hidden[:HIDDEN, :WIDTH] = w["hidden"].T
        dx, g_in, g_out = np.empty((*last.shape, WIDTH + 1), h.dtype), 0, 0
        for n, (x, qkv, a, seen, total, y) in enumerate(kept):
            own_dh = dh[n * _LOOKED * WINDOW : (n + 1) * _LOOKED * WINDOW]
            g_out = g_out + _flat(y).T @ own_dh
            dy = (own_dh @ hidden).reshape(x.shape)
            # Against the ones stands what keeps a row's sum.
            dy[..., WIDTH] = -np.einsum("nij,nij->ni", dy, seen)
            ds = dy / total
            d = np.empty((*x.shape[:2], 3 * WIDTH), h.dtype)
            np.matmul(a.transpose(0, 2, 1), ds[..., :WIDTH], out=d[..., 2 * WIDTH :])
            a *= ds @ qkv[..., 2 * WIDTH :].transpose(0, 2, 1)
            np.matmul(a, qkv[..., WIDTH : 2 * WIDTH], out=d[..., :WIDTH])
            np.matmul(a.transpose(0, 2, 1), qkv[..., :WIDTH], out=d[..., WIDTH : 2 * WIDTH])
            g_in = g_in + _flat(x).T @ _flat(d)
            np.add(dy, (_flat(d) @ inward.T).reshape(x.shape), out=dx[n * _LOOKED : (n + 1) * _LOOKED])
        g |= {"query": g_in[:WIDTH, :WIDTH] * _SCALE, "key": g_in[:WIDTH, WIDTH : 2 * WIDTH], "value": g_in[:WIDTH, 2 * WIDTH :], "hidden": g_out[:WIDTH, :HIDDEN], "shift": g_out[WIDTH, :HIDDEN]}
        g["position"] = dx.sum(0)[:, :WIDTH]
        g["last"], g["before"] = (_sum_rows(_flat(dx), at.ravel(), len(w["last"]))[:, :WIDTH] for at in (last, before))
        return loss, g

    def fit(self, last: np.ndarray, before: np.ndarray, following: np.ndarray, alive: np.ndarray, start: float = 1.0, end: float = 0.0, epochs: int = 1, seed: int = 6) -> AttentionModel:
        """Adam over the windows, BATCH at a time, in an order of its own; the step falls from start to end times RATE."""
        rng = np.random.default_rng(seed)
        adam = Adam(self)
        steps = [part for _ in range(epochs) for part in np.array_split(rng.permutation(len(last)), max(1, -(-len(last) // BATCH))) if len(part)]
        for t, some in enumerate(steps, 1):
            adam.step(last[some], before[some], following[some], alive[some], start + (end - start) * t / (len(steps) + 1))
        return self

    def scores(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The natural log probability of every id of texts laid end to end, each with its end."""
        out = np.zeros(len(ids))
        if not len(ids):
            return out
        last, before, following = self.gather(ids, sizes)
        ends = np.cumsum(sizes)
        more = np.maximum(-(-(sizes - WINDOW) // (WINDOW - CONTEXT)), 0)  # windows after a text's first
        owner = np.repeat(np.arange(len(sizes)), more)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        full, heads = np.flatnonzero(sizes), self.heads()
        for low, whose, starts in ((0, full, (ends - sizes)[full]), (CONTEXT, owner, (ends - sizes)[owner] + nth * (WINDOW - CONTEXT))):
            for i in range(0, len(starts), _SCORED):
                at = starts[i : i + _SCORED, None] + np.arange(WINDOW)
                alive = at < ends[whose[i : i + _SCORED]][:, None]
                at = np.minimum(at, len(ids) - 1)
                h = self.look(last[at], before[at], low)
                rows = np.flatnonzero(alive[:, low:])
                at = at[:, low:].ravel()[rows]
                out[at] = self.log_p(h, rows, following[at], heads)
        return out + self.share[ids]

    def pack(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def unpack(self, flat: np.ndarray) -> AttentionModel:
        """The same model with other weights."""
        ends = np.cumsum([self.weights[k].size for k in sorted(self.weights)])
        parts = np.split(flat.astype(np.float32), ends[:-1])
        weights = {k: p.reshape(self.weights[k].shape) for k, p in zip(sorted(self.weights), parts, strict=True)}
        return AttentionModel(self.place, self.share, self.size, self.classes, weights)


class Adam:
    """Trains a model, some windows after others."""

    def __init__(self, model: AttentionModel) -> None:
        self.model, self.t = model, 0
        self.means, self.squares = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))

    def step(self, last: np.ndarray, before: np.ndarray, following: np.ndarray, alive: np.ndarray, size: float) -> None:
        """One step, of size times RATE; the first ones are smaller."""
        self.t += 1
        _, g = self.model.gradients(last, before, following, alive)
        pace = RATE * min(1.0, self.t / 20) * size / (1 - _FORGET**self.t)
        for k, v in g.items():
            m, s = self.means[k], self.squares[k]
            m *= _FORGET
            m += (1 - _FORGET) * v
            s *= _FORGET_SQUARES
            v = v * v
            v *= 1 - _FORGET_SQUARES
            s += v
            np.multiply(s, 1 / (1 - _FORGET_SQUARES**self.t), out=v)
            np.sqrt(v, out=v)
            v += 1e-8
            np.divide(m, v, out=v)
            v *= pace
            self.model.weights[k] -= v
