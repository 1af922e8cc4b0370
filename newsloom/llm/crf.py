"""Linear-chain conditional random fields with two labels: fitting, marginals and Viterbi, over many chains at once."""

from __future__ import annotations

import numpy as np


#: Elements of a chain that are taken one after the other; longer chains are cut into segments whose maps are composed.
STEP = 512


def _sweep(u: np.ndarray, per: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Forward values of chains laid end to end: all segments of STEP elements in lockstep, entered through the composed maps of those before."""
    n_seg = -(-per // STEP)
    chain = np.repeat(np.arange(len(per)), n_seg)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    begin = (np.cumsum(per) - per)[chain] + nth * STEP
    size = np.minimum(per[chain] - nth * STEP, STEP)
    order = np.argsort(-size, kind="stable")
    first, longest = begin[order], int(size.max(initial=0))
    alive = np.searchsorted(-size[order], -np.arange(1, longest + 1), "right")
    # a chain's first element is entered from both labels alike and without a transition
    enter = np.where((nth == 0)[:, None, None], 0.0, trans[None])[order]
    entry = np.full((len(chain), 2), -np.log(2))
    if int(nth.max(initial=0)):
        maps = enter + u[first][:, None, :]
        for t in range(1, longest):
            m = maps[: alive[t]]
            maps[: alive[t]] = np.logaddexp(m[:, :, :1] + trans[0], m[:, :, 1:] + trans[1]) + u[first[: alive[t]] + t][:, None, :]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        maps = maps[back]
        for k in range(1, int(nth.max()) + 1):
            s = np.flatnonzero(nth == k)
            entry[s] = np.logaddexp(entry[s - 1][:, :1] + maps[s - 1, 0], entry[s - 1][:, 1:] + maps[s - 1, 1])
    now = entry[order]
    out = np.zeros_like(u)
    for t in range(longest):
        m = alive[t]
        tr = enter[:m] if t == 0 else trans[None]
        now = np.logaddexp(now[:m, :1] + tr[:, 0], now[:m, 1:] + tr[:, 1]) + u[first[:m] + t]
        out[first[:m] + t] = now
    return out


def marginals(unary: np.ndarray, per: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """unary: score of good minus bad for each line; trans: 2 x 2. P(good) of each line, expected transitions, log Z.

    Forward and backward passes run over all texts at once; a text of very many lines is cut into segments (_sweep).
    """
    begin = np.cumsum(per) - per
    u = np.zeros((len(unary), 2))
    u[:, 1] = unary
    alpha = _sweep(u, per, trans)
    beta = _sweep(u[::-1], per[::-1], trans.T)[::-1] - u
    last = begin + per - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z = np.repeat(log_z, per)
    p = np.exp(alpha + beta - z[:, None])
    expected = np.zeros((2, 2))
    if len(unary) > 1:
        inner = np.ones(len(unary), bool)
        inner[begin] = False
        i = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.exp(alpha[i - 1, a] + trans[a, b] + u[i, b] + beta[i, b] - z[i]).sum()
    return p[:, 1], expected, float(log_z.sum())


def fit_field(x: np.ndarray, per: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, steps: int = 120, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and transitions: Adam on the penalised conditional log-likelihood. weight: of each text.

    x: indices of the features that are on, a row for each element of a chain; the last of the width features stays at 0.
    """
    w, trans = np.zeros(width), np.zeros((2, 2))
    begin = np.cumsum(per) - per
    inner = np.ones(len(y), bool)
    inner[begin] = False
    i = np.flatnonzero(inner)
    lw = np.repeat(weight, per)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1], y[i]), 1)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, steps + 1):
        p, expected, _ = marginals(w[x].sum(1), per, trans)
        g = np.bincount(x.ravel(), np.repeat((y - p) * lw, x.shape[1]), len(w)) - penalty * w
        gt = (seen - expected) - penalty * trans
        g = np.concatenate([g, gt.ravel()]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w += step[:-4]
        trans += step[-4:].reshape(2, 2)
        w[-1] = 0
    return w, trans


def viterbi(unary: np.ndarray, per: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest labels, 0 or 1, of each element; ties go to 0."""
    begin = np.cumsum(per) - per
    order = np.argsort(-per, kind="stable")
    longest = int(per.max(initial=0))
    alive = np.searchsorted(-per[order], -np.arange(1, longest + 1), "right")
    best = np.zeros((len(unary), 2))
    back = np.zeros((len(unary), 2), np.int8)
    best[:, 1] = unary
    firsts = begin[order]
    for t in range(1, longest):
        i = firsts[: alive[t]] + t
        via = best[i - 1][:, :, None] + trans[None]
        back[i] = via.argmax(1)
        best[i] += via.max(1)
    out = np.zeros(len(unary), np.int8)
    has = per > 0
    last = (begin + per - 1)[has]
    out[last] = best[last].argmax(1)
    for t in range(longest - 2, -1, -1):
        i = firsts[: alive[t + 1]] + t
        out[i] = back[i + 1, out[i + 1]]
    return out
