"""A skip-chain conditional random field over tokens.

Labels of neighbouring tokens are tied by transitions; tokens of one document that repeat each other are
or resemble each other are tied by skip edges whose potentials, one for each kind of edge and entity type, are learnt. A chain is solved exactly by forward-backward; the skip edges pass
messages between chains (loopy message passing), a few rounds of both give the marginals. Chains are batched and padded, so
that a step is one matrix product for all chains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Kinds of skip edge: a token repeated, a token that resembles an earlier one.
REPEATED, SIMILAR, SKIP_KINDS = 0, 1, 2

class Crf:
    """Weights of features (n_features x labels), of transitions, and of the skip edges (kinds of edge x entity types)."""

    def __init__(self, labels: Sequence[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, skip: np.ndarray | None = None):
        self.labels, self.index, self.weights, self.transitions = list(labels), index, weights, transitions
        names = sorted({x[2:] if x != "O" else "" for x in labels})
        self.types = np.array([names.index(x[2:] if x != "O" else "") for x in labels])
        self.by_type = np.zeros((len(self.labels), len(names)), np.float32)
        self.by_type[np.arange(len(self.labels)), self.types] = 1
        self.skip = np.zeros((SKIP_KINDS, len(names)), np.float32) if skip is None else np.asarray(skip, np.float32)
        self.inside = np.flatnonzero([x[0] == "I" for x in self.labels])

    def unary(self, feats: list[list[str]]) -> np.ndarray:
        """Scores (tokens x labels); unknown features count nothing."""
        get = self.index.get
        ids = [[k for k in map(get, f) if k is not None] for f in feats]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((k for x in ids for k in x), np.int64, int(n.sum()))
        out = np.zeros((len(feats), len(self.labels)), np.float32)
        some = n > 0
        if len(flat):
            out[some] = np.add.reduceat(self.weights[flat], (np.cumsum(n) - n)[some], axis=0)
        return out

    def marginals(self, unary: np.ndarray, lengths: np.ndarray, skips: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Marginals (tokens x labels) of chains that lie one after the other; skips: (token, token, kind of edge)."""
        starts = np.cumsum(lengths) - lengths
        unary = unary.copy()
        unary[starts[:, None], self.inside[None, :]] = -30  # no chain begins inside an entity
        m = chain_marginals(unary, lengths, self.transitions)[0]
        if len(skips):  # only chains with an edge change
            chain = np.repeat(np.arange(len(lengths)), lengths)
            tied = np.zeros(len(lengths), bool)
            tied[chain[skips[:, :2].ravel()]] = True
            at = np.flatnonzero(tied[chain])
            new = np.full(len(chain), -1)
            new[at] = np.arange(len(at))
            own = np.column_stack([new[skips[:, 0]], new[skips[:, 1]], skips[:, 2]])
            m[at] = self._loopy(unary[at], lengths[tied], own, m[at], rounds)[0]
        return m

    def _loopy(self, unary: np.ndarray, lengths: np.ndarray, skips: np.ndarray, m: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Marginals after so many rounds of messages along the skip edges, and each edge's expected agreement by type."""
        a, b, kind = (np.concatenate([skips[:, i], skips[:, j]]) for i, j in ((0, 1), (1, 0), (2, 2)))
        back = np.concatenate([np.arange(len(skips)) + len(skips), np.arange(len(skips))])
        gain = np.exp(self.skip)[kind] - 1
        messages = np.zeros((len(a), len(self.labels)), np.float32)  # log, from a to b
        for r in range(rounds + 1):
            cavity = m[a] * np.exp(-messages[back])
            cavity /= np.maximum(cavity.sum(axis=1, keepdims=True), 1e-30)
            types = cavity @ self.by_type
            if r == rounds:
                break
            messages = np.log1p(np.maximum((types * gain)[:, self.types], -0.999999))
            pushed = unary.copy()
            np.add.at(pushed, b, messages)
            m = chain_marginals(pushed, lengths, self.transitions)[0]
        both = types[: len(skips)] * types[len(skips) :]
        z = 1 + (both * gain[: len(skips)]).sum(axis=1, keepdims=True)
        return m, both * (gain[: len(skips)] + 1) / np.maximum(z, 1e-12)

    def fit_skips(self, unary: np.ndarray, lengths: np.ndarray, skips: np.ndarray, gold: np.ndarray, steps: int = 25, rate: float = 0.5, prior: float = 0.02) -> None:
        """Fit the potentials of the skip edges to labelled chains by gradient steps on the likelihood that loopy messages approximate.

        The gradient of a potential is the observed less the expected number of agreements of that type; it has a Gaussian prior.
        """
        if not len(skips):
            return
        starts = np.cumsum(lengths) - lengths
        unary = unary.copy()
        unary[starts[:, None], self.inside[None, :]] = -30
        first = chain_marginals(unary, lengths, self.transitions)[0]
        same = self.types[gold[skips[:, 0]]] == self.types[gold[skips[:, 1]]]
        seen = np.zeros_like(self.skip)
        np.add.at(seen, (skips[same, 2], self.types[gold[skips[same, 0]]]), 1)
        n = np.maximum(np.bincount(skips[:, 2], minlength=len(self.skip)), 1)[:, None]
        speed = np.full(self.skip.shape, 1e-4, np.float32)
        for _ in range(steps):
            expected = self._loopy(unary, lengths, skips, first, 2)[1]
            total = np.zeros_like(self.skip)
            np.add.at(total, skips[:, 2], expected)
            grad = (seen - total) / n - prior / np.sqrt(n) * self.skip
            speed += grad * grad
            self.skip = np.clip(self.skip + rate * grad / np.sqrt(speed), -1, 6).astype(np.float32)


def chain_marginals(unary: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Marginals of all tokens, expected transition counts (pairs) and the sum of log partition functions."""
    n_labels = unary.shape[1]
    out = np.zeros_like(unary)
    starts = np.cumsum(lengths) - lengths
    trans = np.exp(transitions).astype(np.float32)
    expected = np.zeros((n_labels, n_labels), np.float64) if pairs else None
    log_z = 0.0
    order = np.argsort(lengths, kind="stable")
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        n = lengths[part]
        steps = int(n.max()) if len(n) else 0
        pos = starts[part][:, None] + np.arange(steps)[None, :]
        real = np.arange(steps)[None, :] < n[:, None]
        u = np.where(real[:, :, None], unary[np.where(real, pos, 0)], 0)
        top = u.max(axis=2, keepdims=True)
        psi = np.exp(u - top)
        alpha = np.empty_like(psi)
        scale = np.ones((len(part), steps), np.float32)
        alpha[:, 0] = psi[:, 0]
        for t in range(steps):
            if t:
                alpha[:, t] = (alpha[:, t - 1] @ trans) * psi[:, t]
            scale[:, t] = np.maximum(alpha[:, t].sum(axis=1), 1e-30)
            alpha[:, t] /= scale[:, t, None]
        beta = np.ones_like(psi)
        for t in range(steps - 2, -1, -1):
            nxt = (psi[:, t + 1] * beta[:, t + 1]) @ trans.T / scale[:, t + 1, None]
            beta[:, t] = np.where(real[:, t + 1, None], nxt, 1)
        m = alpha * beta
        m /= np.maximum(m.sum(axis=2, keepdims=True), 1e-30)
        out[pos[real]] = m[real]
        if pairs:
            for t in range(1, steps):
                on = real[:, t]
                joint = alpha[on, t - 1][:, :, None] * trans[None] * (psi[on, t] * beta[on, t])[:, None, :] / scale[on, t][:, None, None]
                expected += joint.sum(axis=0)
            log_z += float((np.log(scale) * real).sum() + (top[:, :, 0] * real).sum())
    return out, expected, log_z


def train(sequences: list[tuple[list[list[str]], list[str]]], labels: Sequence[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, least: int = 3, batch: int = 256, seed: int = 7) -> Crf:
    """Fit feature and transition weights to labelled chains by maximum likelihood (Adagrad over shuffled batches)."""
    count: dict[str, int] = {}
    for feats, _ in sequences:
        for f in feats:
            for x in f:
                count[x] = count.get(x, 0) + 1
    index = {x: k for k, x in enumerate(sorted(x for x, n in count.items() if n >= least))}
    number = {x: k for k, x in enumerate(labels)}
    n_labels = len(labels)
    weights = np.zeros((len(index), n_labels), np.float32)
    transitions = np.zeros((n_labels, n_labels), np.float32)
    never = np.zeros((n_labels, n_labels), bool)
    for i, x in enumerate(labels):
        for j, y in enumerate(labels):
            never[i, j] = y[0] == "I" and x[2:] != y[2:]
    transitions[never] = -30
    g_w, g_t = np.full(weights.shape, 1e-2, np.float32), np.full(transitions.shape, 1e-2, np.float32)
    data = []
    for feats, ys in sequences:
        ids = [np.array([index[x] for x in f if x in index], np.int64) for f in feats]
        data.append((ids, np.array([number[y] for y in ys])))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            some = [data[k] for k in order[at : at + batch]]
            ids = [x for seq, _ in some for x in seq]
            gold = np.concatenate([y for _, y in some])
            lengths = np.array([len(y) for _, y in some])
            n = np.array([len(x) for x in ids])
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), n)
            unary = np.zeros((len(ids), n_labels), np.float32)
            np.add.at(unary, owner, weights[flat])
            starts = np.cumsum(lengths) - lengths
            unary_first = unary.copy()
            inside = np.array([x[0] == "I" for x in labels])
            first = starts[:, None], np.flatnonzero(inside)[None, :]
            unary_first[first] = -30  # a chain can't begin inside an entity
            m, joint, _ = chain_marginals(unary_first, lengths, transitions, pairs=True)
            d = -m
            d[np.arange(len(gold)), gold] += 1
            grad = np.zeros_like(weights)
            np.add.at(grad, flat, d[owner])
            grad = grad / len(some) - decay * weights
            g_w += grad * grad
            weights += rate * grad / np.sqrt(g_w)
            inner = np.ones(len(gold), bool)
            inner[starts] = False
            seen = np.zeros_like(transitions)
            np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
            grad_t = (seen - joint).astype(np.float32) / len(some) - decay * transitions
            grad_t[never] = 0
            g_t += grad_t * grad_t
            transitions += rate * grad_t / np.sqrt(g_t)
    return Crf(labels, index, weights, transitions)
