"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The forward pass is batched over windows of about equal length, features
first, so that each time step is one matrix product and a few passes over
contiguous rows for hundreds of windows.  Decoding is exact: the best path
leaves O only where some span of a kind could score more than O does, which
running sums of the scores bound from above, so that Viterbi runs on those
stretches alone.  Training (:func:`fit`) is plain back-propagation through time
with Adam.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 40
EMBED = 24
#: By how much a bound may be off for the rounding of running sums.
SLACK = 0.05
#: Windows that end are left out in blocks of so many.
STEP = 8


class Tagger:
    """Weights and decoding.  ``tags`` are O, then B and I of each kind."""

    def __init__(self, chars: str, kinds: tuple[str, ...], weights: dict[str, np.ndarray] | None = None, seed: int = 17):
        self.chars, self.kinds = chars, tuple(kinds)
        self.tags = ["O"] + [f"{x}-{k}" for k in self.kinds for x in "BI"]
        self.classes = len(chars) + 6
        self.table = np.zeros(0x110000, np.int32)
        self._classes()
        self.w = weights if weights is not None else self._fresh(np.random.default_rng(seed))
        self.hidden = len(self.w["Uf"])
        self.allowed = np.array([[self._follows(a, b) for b in self.tags] for a in self.tags])

    def _follows(self, a: str, b: str) -> bool:
        return b[0] != "I" or a[2:] == b[2:] and a != "O"

    def _classes(self) -> None:
        """Character classes: 0 padding, 1 other, 2 digits of any script, 3 white space, 4 capital, 5 small letter not listed."""
        t = self.table
        t[:] = 1
        for c in range(0x250):
            ch = chr(c)
            t[c] = 3 if ch.isspace() else 4 if ch.isupper() else 5 if ch.islower() else 1
        for a in (0x30, 0x660, 0x6F0, 0xFF10):
            t[a : a + 10] = 2
        t[0x2000:0x2010] = t[0x3000] = t[0x202F] = 3
        for i, ch in enumerate(self.chars):
            t[ord(ch)] = 6 + i

    def ids(self, text: str, flags: np.ndarray) -> np.ndarray:
        """Input index of each code point; ``flags`` is 1 within a listed given name."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.table[code] * 2 + flags

    def _fresh(self, r: np.random.Generator) -> dict[str, np.ndarray]:
        k, h = len(self.tags), HIDDEN
        w = {"E": r.normal(0, 0.3, (self.classes * 2, EMBED))}
        for d in "fb":
            w["W" + d] = r.normal(0, EMBED**-0.5, (EMBED, 4 * h))
            w["U" + d] = r.normal(0, h**-0.5, (h, 4 * h))
            w["b" + d] = np.zeros(4 * h)
            w["b" + d][h : 2 * h] = 1
        w["V"] = r.normal(0, (2 * h) ** -0.5, (2 * h, k))
        w["c"] = np.zeros(k)
        w["T"] = np.zeros((k, k))
        w["s"] = np.zeros(k)
        return {x: v.astype(np.float32) for x, v in w.items()}

    def prepare(self) -> None:
        """Folds input weights, biases and the halving of the gates' arguments into one matrix a direction."""
        h, w = self.hidden, self.w
        scale = np.ones(4 * h, np.float32)
        scale[: 3 * h] = 0.5
        self.P = {d: (w["E"] @ w["W" + d] + w["b" + d]) * scale for d in "fb"}
        self.S = {d: np.ascontiguousarray(w["U" + d] * scale) for d in "fb"}
        self.M = {d: np.ascontiguousarray((np.vstack([w["U" + d] / 2, w["W" + d], w["b" + d][None]]) * scale).T.astype(np.float32)) for d in "fb"}
        self.table_t = np.ascontiguousarray(w["E"].T)
        self.V = [np.ascontiguousarray(w["V"][:h].T / 2), np.ascontiguousarray(w["V"][h:].T / 2)]
        self.trans = np.where(self.allowed, w["T"], -1e4).astype(np.float32)
        self.start = np.where([t[0] != "I" for t in self.tags], w["s"], -1e4).astype(np.float32)
        # what beginning, continuing and ending a span of each kind adds at most, against O in its place
        T, first = self.trans, np.array([k for k, t in enumerate(self.tags) if t[0] == "B"])
        self.enter = np.maximum((T[:, first] - T[:, :1]).max(0), self.start[first] - self.start[0])
        self.inner = np.maximum(T[first, first + 1], T[first + 1, first + 1]) - T[0, 0]
        after = [0, *first]
        self.leave = np.maximum(np.maximum(T[first][:, after], T[first + 1][:, after]) - T[0, after], 0).max(1)

    def _run(self, X: np.ndarray, d: str, keep: bool = False):
        T, B = X.shape
        h = self.hidden
        H = np.empty((T, B, h), np.float32)
        Cs, G = (np.empty((T, B, h), np.float32), np.empty((T, B, 4 * h), np.float32)) if keep else (None, None)
        hh, c = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
        real = X >= 2
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            z = self.P[d][X[t]]
            z += hh @ self.S[d]
            np.tanh(z, out=z)
            s = z[:, : 3 * h]
            s *= 0.5
            s += 0.5
            c = z[:, h : 2 * h] * c + z[:, :h] * z[:, 3 * h :]
            hh = z[:, 2 * h : 3 * h] * np.tanh(c)
            if not real[t].all():  # padding keeps the state at zero, so that both directions start at the text's ends
                m = real[t][:, None]
                hh, c = hh * m, c * m
            H[t] = hh
            if keep:
                Cs[t], G[t] = c, z
        return (H, Cs, G) if keep else H

    def _emit(self, X: np.ndarray, n: np.ndarray, d: str, out: np.ndarray) -> None:
        """Adds one direction's scores to ``out`` (T, tags, B).

        Windows have falling lengths ``n``, so that those that reach a step are
        the first ones; only these are computed, in whole blocks of STEP.
        """
        T, B = X.shape
        h, table, M, V = self.hidden, self.table_t, self.M[d], self.V["fb".index(d)]
        space = [np.zeros(r * B, np.float32) for r in (M.shape[1], len(M), h, h, h, len(V))]
        there = np.searchsorted(-n, -np.arange(T), "left")  # windows longer than t
        wide = 0
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            k = there[t]
            if (w := min(B, -(-k // STEP) * STEP)) != wide:
                old = (x[:h, : min(w, wide)].copy(), c[:, : min(w, wide)].copy()) if wide else None
                x, z, c, t1, t2, y = (q[: len(q) // B * w].reshape(-1, w) for q in space)
                x[:h], x[-1], c[:] = 0, 1, 0
                if old:
                    x[:h, : old[0].shape[1]], c[:, : old[1].shape[1]] = old
                i, f, o, u = (z[q * h : (q + 1) * h] for q in range(4))
                gates, state, given, wide = z[: 3 * h], x[:h], x[h:-1], w
            np.take(table, X[t, :w], axis=1, out=given, mode="clip")
            np.matmul(M, x, out=z)
            np.tanh(z, out=z)
            gates += 1
            np.multiply(f, c, out=t1)
            i *= u
            t1 += i
            np.multiply(t1, 0.5, out=c)
            np.tanh(c, out=t2)
            np.multiply(o, t2, out=state)  # twice the state
            if k < w and d == "b":  # padding, at the end, keeps the state at zero
                c[:, k:] = 0
                state[:, k:] = 0
            np.matmul(V, state, out=y)
            out[t, :, :w] += y

    def _scores(self, X: np.ndarray, n: np.ndarray) -> np.ndarray:
        E = np.empty((X.shape[0], len(self.tags), X.shape[1]), np.float32)
        E[:] = self.w["c"][:, None]
        for d in "fb":
            self._emit(X, n, d, E)
        return E

    def scores(self, X: np.ndarray) -> np.ndarray:
        """(T, tags, B) of X (T, B); padding is at the end."""
        n = (X >= 2).sum(0)
        order = np.argsort(-n, kind="stable")
        E = np.empty((X.shape[0], len(self.tags), X.shape[1]), np.float32)
        E[:, :, order] = self._scores(np.ascontiguousarray(X[:, order]), n[order])
        return E

    def _hot(self, E: np.ndarray) -> np.ndarray:
        """Whether each character, (T, B), is in a stretch that as a span of some kind could score as much as O does.

        Each span of the best path can, for else O in its place would score more.
        """
        T, B = len(E), E.shape[2]
        begin, go_on = E[:, 1::2] - E[:, :1], E[:, 2::2] - E[:, :1]
        begin += (self.enter + self.leave)[:, None]
        go_on += self.inner[:, None]
        for t in range(1, T):  # the best span so far that holds the character
            np.maximum(begin[t], begin[t - 1] + go_on[t], out=begin[t])
        rest = np.zeros(begin.shape[1:], np.float32)  # the best continuation
        hot = np.empty((T, B), bool)
        for t in range(T - 1, -1, -1):
            begin[t] += rest
            np.greater_equal(begin[t].max(0), -SLACK, out=hot[t])
            rest += go_on[t]
            np.maximum(rest, 0, out=rest)
        return hot

    def decode(self, X: np.ndarray) -> np.ndarray:
        """Best tag sequence, (T, B); padding is at the end and tagged 0."""
        T, B = X.shape
        n = (X >= 2).sum(0)
        order = np.argsort(-n, kind="stable")
        X, n = np.ascontiguousarray(X[:, order]), n[order]
        E, real = self._scores(X, n), X >= 2
        hot = self._hot(E) & real
        flat = np.zeros((B, T + 2), np.int8)
        flat[:, 1:-1] = hot.T
        edge = np.diff(flat.reshape(-1))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        j = a // (T + 2)
        a, b = a - j * (T + 2), b - j * (T + 2)
        by_length, tags = np.argsort(a - b, kind="stable"), np.zeros((T, B), np.int8)
        for k in range(0, len(by_length), 512):
            some = by_length[k : k + 512]
            self._viterbi(E, a[some], b[some], j[some], n, tags)
        out = np.empty_like(tags)
        out[:, order] = tags
        return out

    def _viterbi(self, E: np.ndarray, a: np.ndarray, b: np.ndarray, j: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
        """Best tags of the stretches [a, b) of windows ``j``, O on either side of them; in falling lengths."""
        T, K, B = E.shape
        length, trans, flat = b - a, self.trans[:, :, None], E.reshape(-1)
        L = int(length[0])
        there = np.searchsorted(-length, -np.arange(L + 1), "left")  # stretches longer than t
        at = a * (K * B) + j + (np.arange(K) * B)[:, None]
        v = np.empty((L, K, len(a)), np.float32)
        v[0] = np.where(a == 0, self.start[:, None], self.trans[0][:, None]) + flat[at]
        for t in range(1, L):
            k = there[t]
            x = v[t - 1, :, None, :k] + trans
            np.add(x.max(0), flat[at[:, :k] + t * (K * B)], out=v[t, :, :k])
        leave = np.where(b == n[j], 0, self.trans[:, :1])
        tag = np.zeros(len(a), np.int64)
        for t in range(L - 1, -1, -1):
            k, new = there[t + 1], slice(there[t + 1], there[t])  # those that go on, and those that end here
            if k:
                tag[:k] = (v[t, :, :k] + self.trans[:, tag[:k]]).argmax(0)
            tag[new] = (v[t, :, new] + leave[:, new]).argmax(0)
            out[a[: there[t]] + t, j[: there[t]]] = tag[: there[t]]

    # -- training -----------------------------------------------------------

    def _grads(self, X: np.ndarray, Y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch and its gradients."""
        self.prepare()
        T, B = X.shape
        h, K = self.hidden, len(self.tags)
        runs = {d: self._run(X, d, keep=True) for d in "fb"}
        HH = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        E = HH @ self.w["V"] + self.w["c"]
        real = X >= 2
        # forward-backward
        A = np.empty((T, B, K), np.float32)
        A[0] = self.start + E[0]
        for t in range(1, T):
            x = A[t - 1][:, :, None] + self.trans
            m = x.max(1)
            n = m + np.log(np.exp(x - m[:, None]).sum(1)) + E[t]
            A[t] = np.where(real[t][:, None], n, A[t - 1])
        m = A[-1].max(1, keepdims=True)
        Z = (m + np.log(np.exp(A[-1] - m).sum(1, keepdims=True)))[:, 0]
        Bt = np.zeros((B, K), np.float32)
        dE, dT = np.zeros_like(E), np.zeros((K, K), np.float32)
        for t in range(T - 1, -1, -1):
            r = real[t][:, None]
            dE[t] = np.exp(np.minimum(A[t] + Bt - Z[:, None], 0)) * r
            if t:
                y = (E[t] + Bt)[:, None, :] + self.trans
                dT += (np.exp(np.minimum(A[t - 1][:, :, None] + y - Z[:, None, None], 0)) * r[:, :, None]).sum(0)
                mx = y.max(2)
                Bt = np.where(r, mx + np.log(np.exp(y - mx[:, :, None]).sum(2)), Bt)
        ds = dE[0].sum(0)
        gold = self.start[Y[0]] + E[0][np.arange(B), Y[0]]
        np.subtract.at(ds, Y[0], 1)
        for t in range(T):
            r = real[t]
            if t:
                gold = gold + np.where(r, self.trans[Y[t - 1], Y[t]] + E[t][np.arange(B), Y[t]], 0)
                np.subtract.at(dT, (Y[t - 1][r], Y[t][r]), 1)
            dE[t][np.nonzero(r)[0], Y[t][r]] -= 1
        loss = float((Z - gold).sum())
        g = {"V": HH.reshape(-1, 2 * h).T @ dE.reshape(-1, K), "c": dE.sum((0, 1)), "T": dT * self.allowed, "s": ds}
        dHH = dE @ self.w["V"].T
        gE = np.zeros_like(self.w["E"])
        scale = np.ones(4 * h, np.float32)
        scale[: 3 * h] = 0.5
        for n, d in enumerate("fb"):
            H, C, G = runs[d]
            dH = dHH[:, :, n * h : (n + 1) * h]
            dZ = np.empty((T, B, 4 * h), np.float32)
            dh, dc = np.zeros((B, h), np.float32), np.zeros((B, h), np.float32)
            order = range(T - 1, -1, -1) if d == "f" else range(T)
            step = -1 if d == "f" else 1
            U = self.w["U" + d]
            for t in order:
                p = t + step
                cp = C[p] if 0 <= p < T else 0
                i, f, o, u = (G[t][:, k * h : (k + 1) * h] for k in range(4))
                m = real[t][:, None]
                dh, dc = (dh + dH[t]) * m, dc * m
                tc = np.tanh(C[t])
                dc = dc + dh * o * (1 - tc * tc)
                z = dZ[t]
                z[:, :h] = dc * u * i * (1 - i)
                z[:, h : 2 * h] = dc * cp * f * (1 - f)
                z[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
                z[:, 3 * h :] = dc * i * (1 - u * u)
                dc = dc * f
                dh = z @ U.T
            Hp = np.zeros_like(H)
            if d == "f":
                Hp[1:] = H[:-1]
            else:
                Hp[:-1] = H[1:]
            flat = dZ.reshape(-1, 4 * h)
            g["U" + d] = Hp.reshape(-1, h).T @ flat
            g["b" + d] = flat.sum(0)
            P = np.zeros((self.classes * 2, 4 * h), np.float32)
            np.add.at(P, X.reshape(-1), flat)
            g["W" + d] = self.w["E"].T @ P
            gE += P @ self.w["W" + d].T
        g["E"] = gE
        return loss / B, {k: v / B for k, v in g.items()}


def batches(rows: list[tuple[np.ndarray, np.ndarray]], size: int, rng: np.random.Generator):
    """Shuffled batches of windows of about one length, padded at the end."""
    order = sorted(rng.permutation(len(rows)), key=lambda i: len(rows[i][0]) // 16)
    cut = [order[i : i + size] for i in range(0, len(order), size)]
    for k in rng.permutation(len(cut)):
        T = max(len(rows[i][0]) for i in cut[k])
        X, Y = np.zeros((T, len(cut[k])), np.int32), np.zeros((T, len(cut[k])), np.int8)
        for j, i in enumerate(cut[k]):
            x, y = rows[i]
            X[: len(x), j], Y[: len(y), j] = x, y
        yield X, Y


def fit(tagger: Tagger, rows, epochs: int, size: int = 64, rate: float = 4e-3, seed: int = 17, log=print) -> Tagger:
    """Adam over ``rows`` of (input indexes, tags); the rate falls linearly, and the weights of the epoch of least loss stay."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    s = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    total, n = epochs * -(-len(rows) // size), 0
    best, least, usual = tagger.w, np.inf, 0.0
    for epoch in range(epochs):
        losses = []
        for X, Y in batches(rows() if callable(rows) else rows, size, rng):
            loss, g = tagger._grads(X, Y)
            n += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            usual = norm if n == 1 else 0.98 * usual + 0.02 * min(norm, 3 * usual)
            clip, lr = min(1.0, 2 * usual / max(norm, 1e-9)), rate * max(0.02, 1 - n / total)
            for k, v in g.items():
                v = v * clip  # before the moments, or one odd batch moves everything
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.998 * s[k] + 0.002 * v * v
                tagger.w[k] = (tagger.w[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.998**n)) + 1e-5)).astype(np.float32)
            losses.append(loss)
        log(f"epoch {epoch + 1}: loss {np.mean(losses):.4f}")
        if np.mean(losses) < least:
            best, least = dict(tagger.w), np.mean(losses)
    tagger.w = best
    tagger.prepare()
    return tagger
