"""NumPy forms of the transformer's parts, for the inside of Arrow batches. Leading axes are free."""

from __future__ import annotations

import numpy as np


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w.T


def embedding(ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[ids]


def truncated_normal(shape: tuple[int, ...], std: float = 1.0, cut: float = 2.0, seed: int = 0) -> np.ndarray:
    """Normal values, drawn again where they lie beyond ``cut``."""
    rng = np.random.default_rng(seed)
    out = rng.normal(0, std, shape)
    while (far := np.abs(out) > cut).any():
        out[far] = rng.normal(0, std, int(far.sum()))
    return out


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def swiglu(x: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    return linear(silu(linear(x, w1)) * linear(x, w3), w2)


def rmsnorm(x: np.ndarray, gain: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + eps) * gain


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def cross_entropy(logits: np.ndarray, targets: np.ndarray) -> float:
    top = logits.max(-1, keepdims=True)
    log_total = np.log(np.exp(logits - top).sum(-1)) + top[..., 0]
    return float((log_total - np.take_along_axis(logits, targets[..., None], -1)[..., 0]).mean())


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """``mask`` is True where a key may be seen; a query that may see no key gives zeros."""
    scores = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is None:
        return softmax(scores) @ v
    mask = np.broadcast_to(mask, scores.shape)
    return np.where(mask, softmax(np.where(mask, scores, np.finfo(scores.dtype).min)), 0.0) @ v


def rope(x: np.ndarray, positions: np.ndarray, theta: float = 10000.0) -> np.ndarray:
    d = x.shape[-1]
    angle = positions[..., None] / theta ** (np.arange(0, d, 2) / d)
    even, odd = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[..., 1::2] = even * np.sin(angle) + odd * np.cos(angle)
    return out


def multihead(x: np.ndarray, wq: np.ndarray, wk: np.ndarray, wv: np.ndarray, wo: np.ndarray, heads: int, positions: np.ndarray | None = None, theta: float = 10000.0) -> np.ndarray:
    """Causal self-attention over (..., sequence, d); with positions, queries and keys are rotated within each head."""
    n = x.shape[-2]
    parts = lambda y: np.swapaxes(y.reshape(*y.shape[:-1], heads, -1), -2, -3)
    q, k, v = (parts(linear(x, w)) for w in (wq, wk, wv))
    if positions is not None:
        q, k = rope(q, positions, theta), rope(k, positions, theta)
    y = attention(q, k, v, np.tril(np.ones((n, n), bool)))
    return linear(np.swapaxes(y, -2, -3).reshape(*x.shape[:-1], -1), wo)


def block(x: np.ndarray, w: dict[str, np.ndarray], heads: int, theta: float = 10000.0) -> np.ndarray:
    """Pre-norm transformer block: attention, then SwiGLU, each added to its input."""
    positions = np.arange(x.shape[-2])
    x = x + multihead(rmsnorm(x, w["ln1.weight"]), *(w[f"attn.{k}_proj.weight"] for k in ("q", "k", "v", "output")), heads, positions, theta)
    return x + swiglu(rmsnorm(x, w["ln2.weight"]), w["ffn.w1.weight"], w["ffn.w2.weight"], w["ffn.w3.weight"])


def language_model(ids: np.ndarray, w: dict[str, np.ndarray], layers: int, heads: int, theta: float = 10000.0) -> np.ndarray:
    """Logits (..., sequence, vocabulary); a sequence may be shorter than the context."""
    x = embedding(ids, w["token_embeddings.weight"])
    for i in range(layers):
        own = f"layers.{i}."
        x = block(x, {k[len(own) :]: v for k, v in w.items() if k.startswith(own)}, heads, theta)
    return linear(rmsnorm(x, w["ln_final.weight"]), w["lm_head.weight"])


#: Keys (rows, heads, size, places) and values (rows, heads, places, size) of each layer.
Known = list[tuple[np.ndarray, np.ndarray]]


class LanguageModel:
    """``language_model`` over many sequences of a length, for each place its best token, that logit and the loss against a target.

    What the first layer projects depends on token and place alone and is looked up; projections of one input are one product;
    gates and logits are held for few places at a time, so that they stay in the processor's cache.
    """

    def __init__(self, w: dict[str, np.ndarray], layers: int, heads: int, theta: float = 10000.0):
        w = {k: np.asarray(v, np.float64) for k, v in w.items()}
        self.embedding, self.heads, self.theta = w["token_embeddings.weight"], heads, theta
        self.head = np.ascontiguousarray((w["lm_head.weight"] * w["ln_final.weight"]).T)
        # a place's normed vector is no longer than the root of its width, which bounds each logit, and each score of a layer
        self.small = np.sqrt(len(self.head) * (self.head**2).sum(0).max()) < SAFE
        self.layers: list[tuple[bool, list[np.ndarray]]] = []
        self.firsts: dict[int, np.ndarray] = {}
        self.turns: dict[tuple[int, int], np.ndarray] = {}
        self.seen: dict[tuple[int, int], np.ndarray] = {}
        self.each = np.repeat(np.eye(heads), self.embedding.shape[1] // heads, 1)
        for i in range(layers):
            of = lambda k, own=f"layers.{i}.": w[f"{own}{k}.weight"]
            size = len(of("attn.q_proj")) // heads
            qkv = np.concatenate([of("attn.q_proj") / np.sqrt(size), of("attn.k_proj"), of("attn.v_proj")]) * of("ln1")
            q, k, _ = (np.linalg.norm(x, 2, (1, 2)) for x in qkv.reshape(3, heads, size, -1))
            # the first gate is projected with its sign turned, as its exponential takes it
            parts = (qkv, of("attn.output_proj"), -of("ffn.w1") * of("ln2"), of("ffn.w3") * of("ln2"), -of("ffn.w2"))
            self.layers.append((bool(qkv.shape[1] * (q * k).max() < SAFE), [np.ascontiguousarray(x.T) for x in parts]))

    @staticmethod
    def _norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        length = np.einsum("ij,ij->i", x, x)
        length /= x.shape[-1]
        length += eps
        return x * (1 / np.sqrt(length))[:, None]

    def _rotate(self, p: np.ndarray, begin: int) -> np.ndarray:
        """Rotates, in place, queries and keys of what a layer projects (..., n, 3 d): pairs as complex numbers."""
        n, d = p.shape[-2], p.shape[-1] // 3
        if (begin, n) not in self.turns:
            angle = (begin + np.arange(n)[:, None]) / self.theta ** (np.arange(0, d // self.heads, 2) / (d // self.heads))
            self.turns[begin, n] = np.tile(np.exp(1j * angle), 2 * self.heads)
        p.view(np.complex128)[..., :d] *= self.turns[begin, n]
        return p

    def _attention(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, small: bool) -> np.ndarray:
        """(rows * n, d) of queries (rows, heads, n, size) at the last n of all places, keys (rows, heads, size, places) and values (rows, heads, places, size)."""
        (rows, _, n, size), places = q.shape, k.shape[-1]
        if (n, places) not in self.seen:
            self.seen[n, places] = np.tril(np.ones((n, places)), places - n)
        seen, scores = self.seen[n, places], q @ k
        if not small:
            scores += np.where(seen, 0.0, -np.inf)
            scores -= scores.max(-1, keepdims=True)
        np.exp(scores, out=scores)
        scores *= seen
        total = 1 / (scores.reshape(-1, places) @ np.ones(places))
        out = np.empty((rows, n, self.heads, size))
        np.matmul(scores, v, out=out.swapaxes(1, 2))
        out = out.reshape(rows * n, -1)
        out *= total.reshape(rows, self.heads, n).swapaxes(1, 2).reshape(rows * n, self.heads) @ self.each
        return out

    def _first(self, n: int) -> np.ndarray:
        """What the first layer's attention takes, of every token at every place."""
        if n not in self.firsts:
            p = self._norm(self.embedding) @ self.layers[0][1][0]
            every = np.repeat(p[:, None], n, 1)
            self.firsts = {n: self._rotate(every, 0).swapaxes(0, 1).reshape(n * len(p), -1)}
        return self.firsts[n]

    def hidden(self, ids: np.ndarray, n: int | None = None, before: Known | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, Known]:
        """(rows * places, d) of ids (rows, places), before the head, and each layer's keys and values.

        With ``before``, keys and values of earlier places, a row goes on from the row ``of`` in them. There are ``n`` places at most in all.
        """
        rows, places = ids.shape
        begin = before[0][0].shape[3] if before else 0
        x, known = self.embedding[ids.ravel()], []
        for k, (small, (qkv, out, minus, gate, back)) in enumerate(self.layers):
            if k == 0:
                p = self._first(n or places)[ids + np.arange(begin, begin + places) * len(self.embedding)]
            else:
                p = self._rotate((self._norm(x) @ qkv).reshape(rows, places, -1), begin)
            parts = p.reshape(rows, places, 3, self.heads, -1)
            keys, values = parts[:, :, 1].transpose(0, 2, 3, 1), parts[:, :, 2].swapaxes(1, 2)
            if before:
                keys, values = (np.concatenate([old[of], new], axis) for old, new, axis in zip(before[k], (keys, values), (3, 2), strict=True))
            else:
                keys, values = np.ascontiguousarray(keys), np.ascontiguousarray(values)
            known.append((keys, values))
            x += self._attention(parts[:, :, 0].swapaxes(1, 2), keys, values, small) @ out
            normed = self._norm(x)
            for i in range(0, len(x), LOGIT_PLACES):
                y = normed[i : i + LOGIT_PLACES]
                a, b = y @ minus, y @ gate
                b *= a
                np.exp(a, out=a)
                a += 1
                b /= a
                x[i : i + LOGIT_PLACES] += b @ back
        return self._norm(x), known

    def _logits(self, x: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best, its logit, the targets' logits, logarithm of the sum of exponentials) of each row of ``hidden``."""
        best, top, own, total = np.empty(len(x), np.int32), np.empty(len(x)), np.empty(len(x)), np.empty(len(x))
        ones = np.ones(self.head.shape[1])
        y = np.empty((LOGIT_PLACES, self.head.shape[1]))
        for i in range(0, len(x), LOGIT_PLACES):
            j = min(len(x), i + LOGIT_PLACES)
            some, place = y[: j - i], np.arange(j - i)
            np.matmul(x[i:j], self.head, out=some)
            best[i:j] = some.argmax(-1)
            top[i:j] = some[place, best[i:j]]
            own[i:j] = some[place, targets[i:j]]
            if not self.small:
                some -= top[i:j, None]
            np.exp(some, out=some)
            total[i:j] = some @ ones
        return best, top, own, np.log(total) + (0.0 if self.small else top)

    def __call__(self, ids: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, its logit, loss) of each place of ids (rows, n); targets has any shape of as many places."""
        best, top, own, total = self._logits(self.hidden(ids)[0], targets.ravel())
        return best, top, total - own

    def tiles(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a call gives, each (rows, n), for ids (rows, n) whose next tokens are ``after`` (rows).

        A place depends on the row up to it alone. So rows are sorted, and what some begin with is computed once: up to each of CUTS, and whole.
        """
        rows, n = ids.shape
        cuts = [*(c for c in CUTS if c < n), n]
        order = sorted_rows(ids, len(self.embedding))
        best, top, loss = np.empty((rows, n), np.int32), np.empty((rows, n)), np.empty((rows, n))
        ids, after = ids[order], after[order]
        differs = ids[1:] != ids[:-1]
        same = np.append(0, np.where(differs.any(1), differs.argmax(1), n))  # places that a row shares with the one before it
        at = np.append(np.flatnonzero(same < n)[::TILES], rows)
        for i, j in zip(at[:-1], at[1:], strict=True):
            some, shared = ids[i:j], same[i:j].copy()
            shared[0] = 0
            parts, begin, known, where = [], 0, None, None
            for cut in cuts:
                fresh = shared < cut
                first, of = np.flatnonzero(fresh), np.cumsum(fresh) - 1
                begins = some[first, begin:cut]
                x, known = self.hidden(begins, n, known, None if where is None else where[first])
                b, t, own, total = (y.reshape(len(first), -1) for y in self._logits(x, np.append(begins[:, 1:], begins[:, :1], 1).ravel()))
                # rows that begin alike may go on otherwise: the last place's target is each row's own
                target = some[:, cut] if cut < n else after[i:j]
                lost = (total - own)[of]
                lost[:, -1] = total[of, -1] - np.einsum("ij,ji->i", x.reshape(*begins.shape, -1)[of, -1], self.head[:, target])
                parts.append((b[of], t[of], lost))
                begin, where = cut, of
            for out, own in zip((best, top, loss), zip(*parts, strict=True), strict=True):
                out[order[i:j]] = np.concatenate(own, 1)
        return best, top, loss


def sorted_rows(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """An order of rows of ids in which those that begin alike stand together; as many ids as fit are one number."""
    bits = max(1, (vocabulary - 1).bit_length())
    per, keys = 63 // bits, []
    for i in range(0, ids.shape[1], per):
        key = np.zeros(len(ids), np.int64)
        for col in ids[:, i : i + per].T:
            key <<= bits
            key |= col
        keys.append(key)
    return np.lexsort(keys[::-1])


#: Places whose gates or logits are held at a time; exponents up to which softmax needs no shift.
LOGIT_PLACES, SAFE = 256, 300.0
#: Lengths up to which a beginning that rows share is computed once; different rows that go through a model together.
CUTS, TILES = (4, 6), 160


def random_weights(vocabulary: int, d: int, layers: int, d_ff: int, seed: int = 0) -> dict[str, np.ndarray]:
    shapes = {"token_embeddings.weight": (vocabulary, d), "ln_final.weight": (d,), "lm_head.weight": (vocabulary, d)}
    for i in range(layers):
        shapes |= {f"layers.{i}.attn.{k}_proj.weight": (d, d) for k in ("q", "k", "v", "output")}
        shapes |= {f"layers.{i}.ffn.w1.weight": (d_ff, d), f"layers.{i}.ffn.w2.weight": (d, d_ff), f"layers.{i}.ffn.w3.weight": (d_ff, d)}
        shapes |= {f"layers.{i}.ln{k}.weight": (d,) for k in (1, 2)}
    return {n: np.ones(s) if len(s) == 1 else truncated_normal(s, 0.2, 0.6, seed + k) for k, (n, s) in enumerate(shapes.items())}
