"""Gaussian hidden-Markov regimes for many sequences and models at once.

A sequence is stored as chunks of consecutive rows.  Everything that runs along a
sequence is done in three steps, so that no task ever holds a whole sequence:

1. each chunk is summarised by a k x k matrix: how it takes a state before the chunk
   to a state at its end (summed over paths, or for the best path);
2. the matrices of a sequence, one per chunk, are multiplied in order, which gives
   what enters and leaves every chunk; many of them are grouped into a tree first;
3. each chunk is worked through again between its true boundaries.

The results are those of the recursions over the whole sequence.  Fitting repeats the
steps: the chunks send sufficient statistics, Spark sums them per model, and the new
parameters are written to the shared folder.  All models advance in the same jobs and
leave when they have converged.

Models have an axis of their own everywhere: a chunk comes to a task once, with the
parameters of all models of its sequence.  Sequences of at most WHOLE chunks are fitted in
batches of models (`_fit_together`): all models of a batch take their steps at the same
time, and no step is a job.  The numbers are those of the steps above.

A model that breaks down (a covariance that is not positive definite, a likelihood that is
not a number) starts again from its first parameters on the next rung of KINDS.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import entropy
from .blocks import attach, day_bucket, stage, stored, with_position

CHUNK = 1024
#: A sequence of at most so many chunks is fitted in a batch; longer ones take the steps above in jobs.
WHOLE = 64
#: Rows of a batch, counted once for each model.
TOGETHER = 1 << 16
#: Models whose time need not be folded.
MANY = 48
#: Chunk matrices of a task that multiplies them along their sequences, and of a group that becomes one matrix.
MATRICES, FAN = 512, 256
TINY = 1e-250
#: Kinds of covariances in the order they are tried, and the least variance of the later ones.
KINDS = ("full", "diag", "wide")
FLOORS = (0.0, 1e-2, 0.1)


# -- numerics on stacks of equally long chunks ------------------------------
# x: (c, n, d) rows; start: (c, k); trans: (c, k, k); means: (c, k, d);
# covars: (c, k, d, d); first: (c,) whether a chunk begins its sequence.

def log_density(x, means, covars):
    inv = np.linalg.inv(np.linalg.cholesky(covars))
    half_det = np.log(np.diagonal(inv, axis1=-2, axis2=-1)).sum(-1)
    out = np.empty(x.shape[:2] + (means.shape[1],))
    for s in range(means.shape[1]):
        z = (x - means[:, None, s]) @ inv[:, s].transpose(0, 2, 1)
        out[:, :, s] = -0.5 * (z * z).sum(-1) + half_det[:, None, s]
    return out - 0.5 * x.shape[2] * np.log(2 * np.pi)


def scaled(logb):
    top = logb.max(-1, keepdims=True)
    return np.maximum(np.exp(logb - top), TINY), top[..., 0]


def entering(start, trans, first):
    """Matrix into the first row of a chunk; a new sequence starts from `start`."""
    return np.where(first[:, None, None], start[:, None, :], trans)


def sum_transfer(logb, start, trans, first):
    """log of the k x k matrix of path weights through each chunk."""
    b, top = scaled(logb)
    m = entering(start, trans, first) * b[:, 0, None, :]
    scale = np.zeros(m.shape[:2])
    for t in range(b.shape[1]):
        if t:
            m = (m @ trans) * b[:, t, None, :]
        total = np.maximum(m.sum(-1, keepdims=True), TINY)
        m = m / total
        scale += np.log(total[..., 0])
    return np.log(np.maximum(m, 1e-300)) + scale[..., None] + top.sum(-1)[:, None, None]


def best_transfer(logb, start, trans, first):
    """log of the best path weight through each chunk."""
    la = np.log(np.maximum(trans, 1e-300))
    m = np.log(np.maximum(entering(start, trans, first), 1e-300)) + logb[:, 0, None, :]
    for t in range(1, logb.shape[1]):
        m = (m[:, :, :, None] + la[:, None]).max(2) + logb[:, t, None, :]
    return m


def forward_backward(logb, start, trans, first, into, out):
    """State probabilities, summed transition counts, filtered probabilities, log likelihood."""
    b, top = scaled(logb)
    c, n, k = b.shape
    alpha, norm = np.empty((c, n, k)), np.empty((c, n))
    begin = entering(start, trans, first)
    a = (into[:, None, :] @ begin)[:, 0] * b[:, 0]
    for t in range(n):
        if t:
            a = (a[:, None, :] @ trans)[:, 0] * b[:, t]
        norm[:, t] = np.maximum(a.sum(-1), TINY)
        a = a / norm[:, t, None]
        alpha[:, t] = a
    beta = np.empty((c, n, k))
    v = out / out.max(-1, keepdims=True)
    beta[:, n - 1] = v
    for t in range(n - 1, 0, -1):
        v = (trans @ (b[:, t] * v)[:, :, None])[:, :, 0]
        v = v / v.max(-1, keepdims=True)
        beta[:, t - 1] = v
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(-1, keepdims=True), TINY)
    before = np.concatenate([into[:, None], alpha[:, :-1]], 1)
    after = b * beta
    pair = before[..., :, None] * trans[:, None] * after[..., None, :]
    pair /= np.maximum(pair.sum((-1, -2), keepdims=True), TINY)
    pair[first, 0] = 0.0
    return gamma, pair.sum(1), alpha, (np.log(norm) + top).sum(1)


def best_path(logb, start, trans, first, entry, last):
    """Best states of each chunk between a fixed state before it and a fixed last state."""
    la = np.log(np.maximum(trans, 1e-300))
    c, n, k = logb.shape
    rows = np.arange(c)
    v = np.log(np.maximum(entering(start, trans, first)[rows, entry], 1e-300)) + logb[:, 0]
    back = np.zeros((c, n, k), dtype=np.int32)
    for t in range(1, n):
        cand = v[:, :, None] + la
        back[:, t] = cand.argmax(1)
        v = cand.max(1) + logb[:, t]
    path = np.empty((c, n), dtype=np.int32)
    path[:, n - 1] = last
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[rows, t, path[:, t]]
    return path


# -- rows <-> stacks --------------------------------------------------------

def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each chunk and model, from chunks with lists of models; the values of a chunk are shared."""
    lists = [c for c in pdf.columns if c not in ("seq", "blk", "x")]
    at = np.repeat(np.arange(len(pdf)), pdf["model_id"].map(len))
    out = pdf[["seq", "blk", "x"]].iloc[at].reset_index(drop=True)
    return out.assign(**{c: [v for row in pdf[c] for v in row] for c in lists})


def _stacks(pdf: pd.DataFrame, k: int, d: int):
    """Groups of chunks of equal length, with their parameters, as arrays."""
    pdf = _spread(pdf)
    for n, rows in pdf.groupby(pdf["x"].map(len)):
        x = np.stack(rows["x"].to_list()).reshape(len(rows), n // d, d)
        arr = {name: np.stack(rows[name].to_list()).reshape((len(rows),) + shape) for name, shape in
               (("start", (k,)), ("trans", (k, k)), ("means", (k, d)), ("covars", (k, d, d)))}
        logb = log_density(x, arr["means"], arr["covars"])
        yield rows, x, logb, arr["start"], arr["trans"], (rows["blk"] == 0).to_numpy()


def _logsum(v, axis):
    top = v.max(axis, keepdims=True)
    return np.log(np.exp(v - top).sum(axis)) + top.squeeze(axis)


def _transfers(k: int, d: int, best: bool):
    def run(batches):
        for pdf in batches:
            for rows, _, logb, start, trans, first in _stacks(pdf, k, d):
                out = rows[["model_id", "seq", "blk"]].copy()
                out["total"] = list(sum_transfer(logb, start, trans, first).reshape(len(rows), -1))
                out["best"] = (list(best_transfer(logb, start, trans, first).reshape(len(rows), -1)) if best
                               else [None] * len(rows))
                yield out
    return run


def _boundaries(k: int, best: bool):
    """What enters and leaves each chunk of a run of chunks, from the matrices in order.

    Of a group inside a sequence `g_in`, `g_out`, `g_entry` and `g_last` say what enters and leaves the group.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        m = np.stack(pdf["total"].to_list()).reshape(-1, k, k)
        n, inside = len(m), "g_in" in pdf.columns
        into, out = np.empty((n, k)), np.empty((n, k))
        v = np.log(np.maximum(pdf["g_in"].iloc[0], 1e-300)) if inside else np.full(k, -np.log(k))
        for j in range(n):
            into[j] = v - _logsum(v, 0)
            v = _logsum(into[j][:, None] + m[j], 0)
        w = np.log(np.maximum(pdf["g_out"].iloc[0], 1e-300)) if inside else np.zeros(k)
        for j in range(n - 1, -1, -1):
            out[j] = w - w.max()
            w = _logsum(m[j] + out[j][None, :], 1)
        entry, last = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        if best:
            m = np.stack(pdf["best"].to_list()).reshape(-1, k, k)
            reach, choice = np.zeros(k), np.empty((n, k), dtype=np.int32)
            if inside:
                reach = np.where(np.arange(k) == pdf["g_entry"].iloc[0], 0.0, -np.inf)
            for j in range(n):
                cand = reach[:, None] + m[j]
                choice[j] = cand.argmax(0)
                reach = cand.max(0)
            s = int(pdf["g_last"].iloc[0]) if inside else int(reach.argmax())
            for j in range(n - 1, -1, -1):
                last[j] = s
                entry[j] = s = int(choice[j][s])
        return pdf[["model_id", "seq", "blk"]].assign(
            a_in=list(np.exp(into)), b_out=list(np.exp(out)), entry=entry, last=last)
    return run


def _composed(k: int, best: bool):
    """One matrix for a group of chunks in order: summed over paths, and for the best path."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        out = pdf[["model_id", "seq"]].iloc[:1].assign(blk=pdf["grp"].iloc[0])
        for name, join in (("total", _logsum), ("best", lambda x, axis: x.max(axis))):
            if name == "best" and not best:
                out[name] = [None]
                continue
            whole = None
            for m in pdf[name]:
                m = np.reshape(m, (k, k))
                whole = m if whole is None else join(whole[:, :, None] + m[None], 1)
            out[name] = [whole.ravel()]
        return out
    return run


def _statistics(k: int, d: int):
    """Sufficient statistics, summed per model inside each batch of chunks."""
    def run(batches):
        for pdf in batches:
            for rows, x, logb, start, trans, first in _stacks(pdf, k, d):
                into, out = np.stack(rows["a_in"].to_list()), np.stack(rows["b_out"].to_list())
                gamma, pairs, _, ll = forward_backward(logb, start, trans, first, into, out)
                g0 = gamma[:, 0] * first[:, None]
                gx = np.einsum("cnk,cnd->ckd", gamma, x)
                gxx = np.einsum("cnk,cnd,cne->ckde", gamma, x, x, optimize=True)
                c = len(rows)
                flat = np.concatenate([ll[:, None], g0, gamma.sum(1), gx.reshape(c, -1), gxx.reshape(c, -1),
                                       pairs.reshape(c, -1)], 1)
                ids, of = np.unique(rows["model_id"].to_numpy(str), return_inverse=True)
                sums = np.zeros((len(ids), flat.shape[1]))       # what is not a number must stay so
                np.add.at(sums, of, flat)
                yield pd.DataFrame({"model_id": ids.astype(object), "stats": list(sums)})
    return run


def _new_parameters(k: int, d: int, min_covar: float, tol: float):
    def run(batches):
        for pdf in batches:
            model = _arrays(pdf, k, d)
            first = _arrays(pdf[["kind", "first"]].assign(**_cut(pdf["first"], k, d)), k, d)
            _maximise_all(model, first, np.stack(pdf["stats"].to_list()), min_covar, tol)
            yield _rows(pdf, model)
    return run


MOVING = ("start", "trans", "means", "covars")


def _cut(flat, k: int, d: int) -> dict:
    """Lists of the four parameter arrays from lists of all their numbers."""
    cuts = np.cumsum([k, k * k, k * d])
    parts = [np.split(np.asarray(v), cuts) for v in flat]
    return {name: [p[i] for p in parts] for i, name in enumerate(MOVING)}


def _arrays(pdf: pd.DataFrame, k: int, d: int) -> dict:
    """The models of a frame as arrays with a model axis."""
    shapes = dict(start=(k,), trans=(k, k), means=(k, d), covars=(k, d, d))
    out = {name: np.stack([np.asarray(v, float) for v in pdf[name]]).reshape((len(pdf),) + shapes[name]) for name in MOVING}
    out["kind"] = np.array([KINDS.index(x) for x in pdf["kind"]])
    for name, kind in (("loglik", float), ("done", bool), ("iters", np.int64)):
        if name in pdf.columns:
            out[name] = pdf[name].to_numpy(kind)
    return out


def _rows(pdf: pd.DataFrame, model: dict) -> pd.DataFrame:
    m = len(pdf)
    return pdf.assign(**{name: list(model[name].reshape(m, -1)) for name in MOVING}, kind=[KINDS[x] for x in model["kind"]],
                      loglik=model["loglik"], done=model["done"], iters=model["iters"])[PARAMETERS]


def _maximise_all(model: dict, first: dict, stats, min_covar: float, tol: float) -> None:
    """New parameters of all models, in place, from their sufficient statistics; a broken model starts again."""
    m, k = model["start"].shape
    d = model["means"].shape[2]
    ll, g0, g, gx, gxx, pairs = np.split(stats, np.cumsum([1, k, k, k * d, k * d * d]), axis=1)
    ll, gx, gxx, pairs = ll[:, 0], gx.reshape(m, k, d), gxx.reshape(m, k, d, d), pairs.reshape(m, k, k)
    seen = g > 1e-8                        # a state nobody visits keeps its place
    weight = np.where(seen, g, 1.0)
    means = gx / weight[..., None]
    covars = gxx / weight[..., None, None] - means[..., :, None] * means[..., None, :]
    floor = np.maximum(min_covar, np.array(FLOORS))[model["kind"]]
    covars = (covars + covars.swapaxes(-1, -2)) / 2 + floor[:, None, None, None] * np.eye(d)
    diagonal = np.maximum(np.diagonal(covars, axis1=-2, axis2=-1), floor[:, None, None])
    covars = np.where((model["kind"] > 0)[:, None, None, None], diagonal[..., None] * np.eye(d), covars)
    means = np.where(seen[..., None], means, model["means"])
    covars = np.where(seen[..., None, None], covars, model["covars"])
    moved = pairs.sum(-1, keepdims=True)
    trans = np.where(moved > 1e-12, pairs / np.maximum(moved, 1e-12), model["trans"])
    start = g0 / np.maximum(g0.sum(-1, keepdims=True), 1e-300)
    broken = ~(np.isfinite(ll) & np.isfinite(means).all((1, 2)) & _each_positive(covars))
    done = np.abs(ll - model["loglik"]) < tol
    for name, new in zip(MOVING, (start, trans, means, covars)):
        model[name][~broken] = new[~broken]
    model["loglik"] = np.where(broken, model["loglik"], ll)
    model["done"], model["iters"] = done & ~broken, model["iters"] + 1
    # The last rung ends where it is; others go back to the start.
    model["done"] |= broken & (model["kind"] == len(KINDS) - 1)
    again = broken & (model["kind"] < len(KINDS) - 1)
    if again.any():
        model["kind"] = np.where(again, model["kind"] + 1, model["kind"])
        for name in MOVING:
            model[name][again] = first[name][again]
        model["covars"][again] = diagonal_from(first["covars"][again], np.maximum(min_covar, np.array(FLOORS))[model["kind"][again]])
        model["loglik"] = np.where(again, -np.inf, model["loglik"])
        model["iters"] = np.where(again, 0, model["iters"])


def diagonal_from(covars, floor):
    d = covars.shape[-1]
    return np.maximum(np.diagonal(covars, axis1=-2, axis2=-1), np.asarray(floor)[..., None, None])[..., None] * np.eye(d)


def _maximise(row, k, d, min_covar, tol):
    """One model given as a row with its statistics; without `first` a broken one goes on from where it is."""
    frame = pd.DataFrame([row])
    model = _arrays(frame, k, d)
    first = {**model, **{n: model[n].copy() for n in MOVING}}
    if "first" in row:
        first = _arrays(frame[["kind"]].assign(**_cut(frame["first"], k, d)), k, d)
    _maximise_all(model, first, np.asarray(row["stats"])[None], min_covar, tol)
    row.update({n: model[n][0].ravel() for n in ("start", "trans", "means")}, covars=model["covars"][0].ravel(),
               kind=KINDS[model["kind"][0]], loglik=float(model["loglik"][0]), done=bool(model["done"][0]), iters=int(model["iters"][0]))
    return row


def _each_positive(covars):
    try:
        np.linalg.cholesky(covars)
        return np.ones(len(covars), bool)
    except np.linalg.LinAlgError:
        return np.array([_positive(c) for c in covars])


# -- many models of whole sequences at the same time -------------------------

def _products(x):
    """What densities and statistics are linear in: products of two values, values, one."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([x[:, i] * x[:, j], x, np.ones((len(x), 1))], 1)


def _density_weights(means, covars):
    """Columns, one for each state, that turn `_products` into log densities."""
    d = means.shape[-1]
    precision = np.linalg.inv(covars)
    precision = (precision + precision.swapaxes(-1, -2)) / 2
    i, j = np.triu_indices(d)
    towards = (precision @ means[..., None])[..., 0]
    constant = -0.5 * ((means * towards).sum(-1) + np.linalg.slogdet(covars)[1] + d * np.log(2 * np.pi))
    both = -0.5 * precision[..., i, j] * np.where(i == j, 1.0, 2.0)
    return np.concatenate([both, towards, constant[..., None]], -1)


def _log_densities(products, members, lengths, model):
    """(time, models, states) log densities, and how many models are longer than t.

    Models are ordered by length, longest first, so that those still running at t come first.
    `products` and `members` list the sequences: their values and the places of their models.
    """
    m, k = model["start"].shape
    top_t = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(top_t), "left")
    logb = np.zeros((top_t, m, k))
    weights = _density_weights(model["means"], model["covars"])
    for values, at in zip(products, members):
        logb[:len(values), at] = (values @ weights[at].reshape(-1, weights.shape[-1]).T).reshape(len(values), len(at), k)
    return logb, active


def _smooth(logb, lengths, model):
    """Filtered and smoothed probabilities, what follows each row, and the log likelihoods.

    Time is folded into pieces that are worked through side by side, as chunks are: the product of each piece, the
    vectors between pieces, then all pieces between theirs.  Rows behind a sequence's end have density 1, which changes
    no vector that comes before them.
    """
    top_t, m, k = logb.shape
    # With many models each step of time is work enough; with few the pieces are.
    n = top_t if m >= MANY else max(8, math.isqrt(top_t))
    c = -(-top_t // n)
    top = logb.max(-1)
    b = np.ones((c * n, m, k))
    b[:top_t] = np.maximum(np.exp(logb - top[..., None]), TINY)
    b = np.ascontiguousarray(b.reshape(c, n, m, k).swapaxes(0, 1))
    trans, start = model["trans"], model["start"]

    through = trans * b[0][:, :, None, :]
    through[0] = np.eye(k) * b[0, 0][:, None, :]
    scale = np.zeros((c, m, k))
    for t in range(n if c > 1 else 0):
        if t:
            through = np.matmul(through, trans) * b[t][:, :, None, :]
        total = np.maximum(through.sum(-1), TINY)
        through /= total[..., None]
        scale += np.log(total)
    into, out = np.empty((c, m, k)), np.ones((c, m, k))
    into[0] = v = start
    for j in range(c if c > 1 else 0):
        into[j] = v
        x = np.log(np.maximum(v, 1e-300)) + scale[j]
        v = np.matmul(np.exp(x - x.max(-1, keepdims=True))[:, None, :], through[j])[:, 0]
        v = v / v.sum(-1, keepdims=True)
    v = np.ones((m, k))
    for j in range(c - 1, -1 if c > 1 else 0, -1):
        out[j] = v
        x = scale[j] + np.log(np.maximum(np.matmul(through[j], v[..., None])[..., 0], 1e-300))
        v = np.exp(x - x.max(-1, keepdims=True))

    alpha, norm = np.empty((n, c, m, k)), np.empty((n, c, m))
    a = np.matmul(into[:, :, None, :], trans)[:, :, 0] * b[0]
    a[0] = start * b[0, 0]
    for t in range(n):
        if t:
            a = np.matmul(a[:, :, None, :], trans)[:, :, 0] * b[t]
        norm[t] = np.maximum(a.sum(-1), TINY)
        a = a / norm[t][..., None]
        alpha[t] = a
    gamma, after, v = np.empty((n, c, m, k)), np.empty((n, c, m, k)), out
    for t in range(n - 1, -1, -1):
        both = alpha[t] * v
        gamma[t] = both / np.maximum(both.sum(-1), TINY)[..., None]
        w = b[t] * v
        u = np.matmul(trans, w[..., None])[..., 0]
        total = np.maximum(((alpha[t - 1] if t else into) * u).sum(-1), TINY)
        after[t] = w / total[..., None]
        v = u / np.maximum(u.max(-1), TINY)[..., None]
    alpha, gamma, after = (x.swapaxes(0, 1).reshape(c * n, m, k)[:top_t] for x in (alpha, gamma, after))
    norm = norm.swapaxes(0, 1).reshape(c * n, m)[:top_t]
    running = np.arange(top_t)[:, None] < lengths[None, :]
    after = after * running[..., None]
    after[0] = 0.0
    return alpha, gamma, after, ((np.log(norm) + top) * running).sum(0)


def _best_paths(logb, active, model):
    """(time, models) most likely states."""
    top_t, m, k = logb.shape
    la = np.log(np.maximum(model["trans"], 1e-300))
    v = np.log(np.maximum(model["start"], 1e-300)) + logb[0]
    back = np.zeros((top_t, m, k), np.int8)
    for t in range(1, top_t):
        n = active[t]
        cand = v[:n, :, None] + la[:n]
        back[t, :n] = cand.argmax(1)
        v[:n] = cand.max(1) + logb[t, :n]
    path, s, at = np.zeros((top_t, m), np.int32), v.argmax(1), np.arange(m)
    for t in range(top_t - 1, -1, -1):
        n = active[t]
        path[t, :n] = s[:n]
        s[:n] = back[t, at[:n], s[:n]]
    return path


def _expect(products, members, lengths, model, d: int):
    """Sufficient statistics of all models, ordered as in `_log_densities`."""
    m, k = model["start"].shape
    logb, _ = _log_densities(products, members, lengths, model)
    alpha, gamma, after, ll = _smooth(logb, lengths, model)
    pairs = model["trans"] * np.matmul(alpha[:-1].transpose(1, 2, 0), after[1:].transpose(1, 0, 2))
    i, j = np.triu_indices(d)
    q = len(i)
    out = np.empty((m, 1 + 2 * k + k * d + k * d * d + k * k))
    out[:, 0] = ll
    out[:, 1:1 + k] = gamma[0]
    out[:, 1 + 2 * k + k * d + k * d * d:] = pairs.reshape(m, -1)
    for values, at in zip(products, members):
        sums = (gamma[:len(values), at].reshape(len(values), -1).T @ values).reshape(len(at), k, -1)
        square = np.empty((len(at), k, d, d))
        square[..., i, j] = square[..., j, i] = sums[..., :q]
        out[at, 1 + k:1 + 2 * k] = sums[..., -1]
        out[at, 1 + 2 * k:1 + 2 * k + k * d] = sums[..., q:-1].reshape(len(at), -1)
        out[at, 1 + 2 * k + k * d:1 + 2 * k + k * d + k * d * d] = square.reshape(len(at), -1)
    return out


def _whole_sequences(chunks: pd.DataFrame, params: pd.DataFrame, d: int):
    """The sequences of a batch by name, its models longest first, and their lengths."""
    chunks = chunks.sort_values(["seq", "blk"])
    x = {seq: np.concatenate(rows.to_list()).reshape(-1, d) for seq, rows in chunks.groupby("seq")["x"]}
    length = params["seq"].map(lambda s: len(x[s])).to_numpy()
    order = np.argsort(-length, kind="stable")
    return x, params.iloc[order].reset_index(drop=True), length[order]


def _decode_together(k: int, d: int, path_only: bool):
    """Decoding of a batch: chunks of its sequences, each once, and its models."""
    def run(chunks: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        x, params, lengths = _whole_sequences(chunks, params, d)
        seqs = params["seq"].to_numpy()
        members = [np.flatnonzero(seqs == s) for s in x]
        model = _arrays(params.assign(kind=KINDS[0]), k, d)
        logb, active = _log_densities([_products(v) for v in x.values()], members, lengths, model)
        path = _best_paths(logb, active, model)
        alpha, gamma = (None, None) if path_only else _smooth(logb, lengths, model)[:2]
        blocks = {seq: np.cumsum([0, *[len(v) // d for v in rows.sort_values("blk")["x"]]]) for seq, rows in chunks.groupby("seq")}
        out = []
        for i, (model_id, seq) in enumerate(zip(params["model_id"], seqs)):
            for blk, (low, high) in enumerate(zip(blocks[seq], blocks[seq][1:])):
                row = {"model_id": model_id, "seq": seq, "blk": blk, "state": path[low:high, i]}
                if not path_only:
                    row |= {"smoothed": list(gamma[low:high, i]), "filtered": list(alpha[low:high, i])}
                out.append(row)
        return pd.DataFrame(out)
    return run


def _fit_together(k: int, d: int, min_covar: float, tol: float, max_iter: int):
    """All steps of a batch: chunks of its sequences, each once, and starting parameters of its models."""
    def run(chunks: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        x, params, lengths = _whole_sequences(chunks, params, d)
        values, seqs = {seq: _products(v) for seq, v in x.items()}, params["seq"].to_numpy()
        model = _arrays(params, k, d)
        first = {name: model[name].copy() for name in MOVING}
        while True:
            live = np.flatnonzero(~model["done"] & (model["iters"] < max_iter))
            if not len(live):
                return _rows(params, model)
            names = dict.fromkeys(seqs[live])
            members = [np.flatnonzero(seqs[live] == s) for s in names]
            now = {name: v[live] for name, v in model.items()}
            stats = _expect([values[s] for s in names], members, lengths[live], now, d)
            _maximise_all(now, {name: first[name][live] for name in MOVING}, stats, min_covar, tol)
            for name, v in now.items():
                model[name][live] = v
    return run


def _positive(covars) -> bool:
    try:
        np.linalg.cholesky(covars)
        return True
    except np.linalg.LinAlgError:
        return False


PARAMETERS = ["model_id", "seq", "seed", "start", "trans", "means", "covars", "kind", "loglik", "done", "iters"]
PARAMETER_SCHEMA = ("model_id string, seq string, seed bigint, start array<double>, trans array<double>, "
                    "means array<double>, covars array<double>, kind string, loglik double, done boolean, iters int")
PACKED = ("model_id", "start", "trans", "means", "covars")
KEY_SCHEMA = "model_id string, seq string, blk bigint"


# -- Spark side -------------------------------------------------------------

def sequence_key(keys):
    return F.to_json(F.struct(*keys))


def chunk_rows(df: DataFrame, features, keys=("series_id",), rows_per_day: int = 288, size: int | None = None) -> DataFrame:
    """Chunks of each sequence: the keys, seq (their text), blk, and the rows' values as flat arrays.

    Rows need `ts`, and may carry `own` (false for rows that only warm up) and `pos`, their place in the sequence;
    without it they are numbered here.  With `pos` an `idx` of the rows, which may be another, stays beside their times.
    """
    own = F.col("own") if "own" in df.columns else F.lit(True)
    values = F.array(*[F.col(c).cast("double") for c in features])
    keys, size, more = list(keys), size or CHUNK, ["idx"] if {"pos", "idx"} <= set(df.columns) else []
    rows = df.select(*keys, sequence_key(keys).alias("seq"), "ts", own.alias("own"), values.alias("v"),
                     *[c for c in ("pos", "idx") if "pos" in df.columns and c in df.columns])
    if "pos" not in df.columns:
        if getattr(df, "_staged", False):
            rows = stored(rows)
        rows = with_position(stage(rows, "sequence"), ["seq"], ["ts"], day_bucket(rows_per_day), "pos")
    packed = rows.groupBy(*keys, "seq", F.expr(f"pos div {size}").alias("blk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ts", "own", *more, "v"))).alias("r"))
    return stage(packed.select(*keys, "seq", "blk", *[F.col(f"r.{c}").alias(c) for c in ("ts", "own", *more)],
                               F.flatten("r.v").alias("x")), "chunks")


def mix32(x):
    """A bijection of 32-bit numbers, in whole numbers below 2^63 so that SQL can repeat it."""
    x = np.asarray(x, np.int64) & 0xFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & 0xFFFFFFFF
    return x ^ (x >> 16)


def sampled_rows(chunks: DataFrame, models: DataFrame, k: int, d: int) -> DataFrame:
    """(model_id, place 1 to k, v) of the k rows of its sequence with the least hashes of a model's seed and the second.

    `models` has model_id, seq and seed.  Each chunk is read once for all models of its sequence and sends the k least of
    each, so what is ranked grows with chunks and models, not with rows and models.
    """
    who = models.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("model_id", "seed"))).alias("m"))
    who = who.select("seq", F.col("m.model_id").alias("model_id"), F.col("m.seed").alias("seed"))

    def draw(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                us = pd.to_datetime(np.asarray(r["ts"])).to_numpy("datetime64[us]").astype(np.int64)
                x, second = np.asarray(r["x"]).reshape(-1, d), mix32(us // 1_000_000)
                for model, seed in zip(r["model_id"], r["seed"]):
                    h = mix32(second ^ mix32(int(seed)))
                    least = np.lexsort((us, h))[:k] if len(h) <= 4 * k else np.argpartition(h, k)[:k + 1]
                    least = least[np.lexsort((us[least], h[least]))][:k]
                    out += [(model, int(h[i]), int(us[i]), x[i]) for i in least]
            yield pd.DataFrame(out, columns=["model_id", "h", "us", "v"])

    drawn = attach(chunks.select("seq", "blk", "ts", "x"), who, ["seq"], salt_on=["blk"]).mapInPandas(
        draw, "model_id string, h bigint, us bigint, v array<double>")
    w = Window.partitionBy("model_id").orderBy("h", "us")
    return drawn.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("model_id", "place", "v")


def random_init(chunks: DataFrame, features, models: DataFrame, k: int, min_covar: float = 1e-3,
                keys=("series_id",)) -> DataFrame:
    """Starting parameters: random start and transition rows, k sampled rows as means,
    the covariance of all rows for every state.

    `models` has the keys, `model_id` and `seed`; `chunks` comes from `chunk_rows`.
    """
    d = len(features)
    who = models.select(sequence_key(keys).alias("seq"), "model_id", F.col("seed").cast("long").alias("seed"))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def moments(batches):
        for pdf in batches:
            yield pd.DataFrame({"seq": pdf["seq"], "sums": [_products(np.asarray(v).reshape(-1, d)).sum(0) for v in pdf["x"]]})

    sums = chunks.select("seq", "x").mapInPandas(moments, "seq string, sums array<double>").select("seq", F.posexplode("sums").alias("pos", "val"))
    sums = sums.groupBy("seq", "pos").agg(F.sum("val").alias("val")).groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("pos", "val")))["val"].alias("s"))
    n, p = F.col("s")[len(pairs) + d], len(pairs)
    spread = [(F.col("s")[at] - F.col("s")[p + i] * F.col("s")[p + j] / n) / F.greatest(n - 1, F.lit(1.0)) for at, (i, j) in enumerate(pairs)]
    cov = sums.select("seq", F.array(*spread).alias("cov"))
    means = sampled_rows(chunks, who, k, d).groupBy("model_id").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("place", "v")))["v"]).alias("means"))
    base = who.join(cov, "seq").join(means, "model_id")

    def make(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                rng = np.random.default_rng(int(r["seed"]))
                start, trans = rng.random(k), rng.random((k, k))
                full = np.zeros((d, d))
                for (i, j), v in zip(pairs, r["cov"]):
                    full[i, j] = full[j, i] = v
                full += min_covar * np.eye(d)
                kind = "full" if _positive(full) else "diag"
                if kind == "diag":
                    full = np.diag(np.maximum(np.diag(full), 1e-2))
                out.append(dict(
                    model_id=r["model_id"], seq=r["seq"], seed=r["seed"], start=start / start.sum(),
                    trans=(trans / trans.sum(1, keepdims=True)).ravel(),
                    means=np.resize(np.asarray(r["means"]), k * d), covars=np.tile(full.ravel(), k), kind=kind,
                    loglik=float("-inf"), done=False, iters=0))
            yield pd.DataFrame(out, columns=PARAMETERS)

    return base.mapInPandas(make, PARAMETER_SCHEMA)


def _packed(rows: DataFrame, by, columns) -> DataFrame:
    """The models of a sequence or chunk as parallel lists."""
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_m"))
    return lists.select(*by, *[F.col(f"_m.{c}").alias(c) for c in columns])


def _with_parameters(chunks: DataFrame, params: DataFrame) -> DataFrame:
    return attach(chunks.select("seq", "blk", "x"), _packed(params, ["seq"], PACKED), ["seq"], salt_on=["blk"])


def _bounded_work(chunks: DataFrame, params: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chunks with parameters and boundaries; the two small tables meet first, so the
    rows of the sequences move at most once."""
    small = bounds.join(params.select(*PACKED), "model_id")
    return chunks.select("seq", "blk", "x").join(
        _packed(small, ["seq", "blk"], [*PACKED, "a_in", "b_out", "entry", "last"]), ["seq", "blk"])


def _bucketed(rows: DataFrame, by, each, schema: str, matrices: int) -> DataFrame:
    """`each` on the rows of every group; small groups share a task, about MATRICES matrices in each."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(max(1, -(-matrices // MATRICES))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([each(group) for _, group in pdf.groupby(list(by), sort=False)])

    return rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, schema)


def _boundary_table(work: DataFrame, k: int, d: int, best: bool) -> DataFrame:
    """What enters and leaves every chunk of every model."""
    matrix = KEY_SCHEMA + ", total array<double>, best array<double>"
    facts = work.agg(F.sum(F.size("model_id")), F.max("blk")).first()
    moved = work.mapInPandas(_transfers(k, d, best), matrix)
    return _boundaries_of(moved, k, best, facts[0] or 0, facts[1] or 0)


def _boundaries_of(moved: DataFrame, k: int, best: bool, matrices: int, last_blk: int) -> DataFrame:
    """A tree over the chunks: groups of FAN matrices become one, and so on until a group is left; then down again.

    So no task has more than FAN matrices of a sequence, however long it is.
    """
    schema = KEY_SCHEMA + ", a_in array<double>, b_out array<double>, entry int, last int"
    if last_blk < FAN:
        return _bucketed(moved, ["model_id", "seq"], _boundaries(k, best), schema, matrices)
    by = ["model_id", "seq", "grp"]
    moved = stage(moved, "matrices").withColumn("grp", F.expr(f"blk div {FAN}"))
    groups = stage(_bucketed(moved, by, _composed(k, best), KEY_SCHEMA + ", total array<double>, best array<double>", matrices), "groups")
    above = _boundaries_of(stored(groups), k, best, -(-matrices // FAN), last_blk // FAN)
    given = above.select("model_id", "seq", F.col("blk").alias("grp"), F.col("a_in").alias("g_in"), F.col("b_out").alias("g_out"),
                         F.col("entry").alias("g_entry"), F.col("last").alias("g_last"))
    return _bucketed(moved.join(given, by), by, _boundaries(k, best), schema, matrices)


def _batches(params: DataFrame, lengths: DataFrame):
    """`params` with `batch`, models of similar length together, about TOGETHER rows in all; and partitions for the batches.

    There are more partitions than batches, so that few share one and tasks are taken up as others end.
    """
    sized = params.join(lengths, "seq").withColumn("_class", F.floor(F.log2("_rows") * 2))
    totals = sized.groupBy("_class").agg(F.sum("_rows").alias("n")).collect()          # a row for each factor of 1.4
    parts = {int(r["_class"]): max(1, -(-r["n"] // TOGETHER)) for r in totals}
    known = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.lit(None).cast("map<bigint,bigint>")
    part = F.pmod(F.xxhash64("model_id"), F.coalesce(F.try_element_at(known, F.col("_class")), F.lit(1)))
    return sized.withColumn("batch", F.concat_ws("|", "_class", part)).drop("_class", "_rows"), max(8, 4 * sum(parts.values()))


def _in_batches(chunks: DataFrame, models: DataFrame, partitions: int, run, schema: str) -> DataFrame:
    """`run` over the models of each batch and the chunks of their sequences, each chunk once."""
    where = models.select("seq", "batch").distinct().select("seq", F.col("batch").alias("batch"))
    beside = chunks.select("seq", "blk", "x").join(where, "seq")
    return beside.repartition(partitions, "batch").groupBy("batch").cogroup(
        models.repartition(partitions, "batch").groupBy("batch")).applyInPandas(run, schema)


def fit_gaussian_hmm(df: DataFrame, features, models: DataFrame, k: int, cfg: RunConfig = RunConfig(),
                     keys=("series_id",), rows_per_day: int = 288, max_iter: int | None = None,
                     init: DataFrame | None = None) -> DataFrame:
    """Baum-Welch for all models together; one row of parameters per model.

    `df` holds the rows to fit on (scaled, no NULLs).  `models` as in `random_init`; instead
    `init` may give the starting parameters themselves, in the form of the result.
    Full covariances; a model that breaks down starts again with diagonal ones, see KINDS.
    """
    features, d = list(features), len(features)
    chunks = chunk_rows(df, features, keys, rows_per_day)
    limit = max_iter or cfg.max_iter
    lengths = stage(chunks.groupBy("seq").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("x") / d).cast("long").alias("_rows")), "lengths")
    starts = init if init is not None else random_init(chunks, features, models, k, cfg.min_covar, keys)
    starts = stage(starts, "starts")
    params, partitions = _batches(starts, lengths.select("seq", "_rows"))
    params = stored(params)
    long_ = stored(lengths.filter(F.col("_n") > WHOLE).select("seq"))
    brief = params.join(long_, "seq", "left_anti")
    finished = stage(_in_batches(chunks, brief, partitions, _fit_together(k, d, cfg.min_covar, cfg.tol, limit), PARAMETER_SCHEMA), "params")
    if long_.isEmpty():
        return finished
    chunks = stored(chunks.join(long_, "seq", "left_semi"))
    params = stored(params.join(long_, "seq", "left_semi").select(*PARAMETERS))
    first = stage(params.select("model_id", F.concat(*MOVING).alias("first")), "first")
    for _ in range(limit * len(KINDS)):
        work = _with_parameters(chunks, params)
        bounds = _boundary_table(work, k, d, best=False)
        stats = _bounded_work(chunks, params, bounds).mapInPandas(
            _statistics(k, d), "model_id string, stats array<double>")
        parts = stats.select("model_id", F.posexplode("stats").alias("pos", "val"))
        # One number per model and position: as many rows as the model has parameters.
        summed = parts.groupBy("model_id", "pos").agg(F.sum("val").alias("val")).groupBy("model_id").agg(
            F.array_sort(F.collect_list(F.struct("pos", "val")))["val"].alias("stats"))
        step = params.join(summed, "model_id").join(first, "model_id").mapInPandas(
            _new_parameters(k, d, cfg.min_covar, cfg.tol), PARAMETER_SCHEMA)
        step = stage(step, "params")
        over = F.col("done") | (F.col("iters") >= limit)
        finished = finished.unionByName(step.filter(over))
        params = stored(step.filter(~over))
        if params.isEmpty():
            break
    return stored(finished)


def best_models(params: DataFrame, models: DataFrame, group) -> DataFrame:
    """The model with the highest log likelihood of each group (several inits)."""
    ll = F.when(F.isnan("loglik"), float("-inf")).otherwise(F.col("loglik"))
    named = params.join(models.select("model_id", *group), "model_id")
    best = named.groupBy(*group).agg(F.max_by("model_id", ll).alias("model_id"))
    return params.join(best.select("model_id"), "model_id", "left_semi")


def align_states(params: DataFrame, k: int, d: int) -> DataFrame:
    """Renumber the states of each model by mean variance, smallest first."""
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf[PARAMETERS].to_dict("records"):
                cov = np.asarray(r["covars"]).reshape(k, d, d)
                order = np.argsort(np.trace(cov, axis1=1, axis2=2), kind="stable")
                r.update(start=np.asarray(r["start"])[order],
                         trans=np.asarray(r["trans"]).reshape(k, k)[order][:, order].ravel(),
                         means=np.asarray(r["means"]).reshape(k, d)[order].ravel(), covars=cov[order].ravel())
                out.append(r)
            yield pd.DataFrame(out, columns=PARAMETERS)
    return params.mapInPandas(run, PARAMETER_SCHEMA)


def segments(df: DataFrame, trade_start: DataFrame | None, warmup, keys=("series_id",)) -> DataFrame:
    """Rows split into history and trade part; `seg` 0 or 1, `own` false for warm-up rows.

    The trade part starts `warmup` rows early so that its decoding does not start cold;
    those copies are not reported.  `trade_start` has the keys and `trade_start`;
    `warmup` is a number or a column.  `pos` is a row's place in its part, from `idx`, its place in all.
    """
    if trade_start is None:
        return df.withColumns({"seg": F.lit(0), "own": F.lit(True)})
    keys = list(keys)
    df = attach(df, trade_start.select(*keys, "trade_start"), keys, "left")
    trade = F.coalesce(F.col("ts") >= F.col("trade_start"), F.lit(False))
    df = stage(df.withColumn("_trade", trade), "segments")
    first = df.filter("_trade").groupBy(*keys).agg(F.min("idx").alias("_first"))
    df = attach(df, first, keys, "left")
    warm = ~F.col("_trade") & (F.col("idx") >= F.col("_first") - warmup)
    segs = F.array_compact(F.array(F.when(~F.col("_trade"), F.lit(0)),
                                   F.when(F.col("_trade") | F.coalesce(warm, F.lit(False)), F.lit(1))))
    out = df.withColumn("seg", F.explode(segs))
    begin = F.when(F.col("seg") == 1, F.greatest(F.col("_first") - warmup, F.lit(0))).otherwise(F.lit(0))
    out = out.withColumns({"own": F.col("_trade") == (F.col("seg") == 1), "pos": F.col("idx") - begin})
    return out.drop("_trade", "_first", "trade_start")


def decode(df: DataFrame, features, params: DataFrame, k: int, keys=("series_id",), rows_per_day: int = 288,
           state: str = "state", path_only: bool = False) -> DataFrame:
    """Most likely state path, smoothed and filtered state probabilities per row and model.

    `df` comes from `segments`; each segment is a sequence of its own.  Returns the keys,
    ts, model_id, the state, `smoothed` and `filtered` (arrays of k); with `path_only`
    without the probabilities.  Where the segments have places (`pos`), `idx` comes along.
    """
    features, d, keys = list(features), len(features), list(keys)
    chunks = chunk_rows(df, features, [*keys, "seg"], rows_per_day)
    base = chunks.withColumn("whole", sequence_key(keys))
    params = params.select(F.col("seq").alias("whole"), "model_id", "start", "trans", "means", "covars")
    lengths = base.groupBy("seq", "whole").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("x") / d).cast("long").alias("_rows"))
    lengths = stage(lengths, "lengths")
    output = KEY_SCHEMA + ", state array<int>" + ("" if path_only else ", smoothed array<array<double>>, filtered array<array<double>>")

    short = lengths.filter(F.col("_n") <= WHOLE)
    pairs, partitions = _batches(params.join(short.select("seq", "whole"), "whole").drop("whole"), short.select("seq", "_rows"))
    done = _in_batches(chunks, pairs, partitions, _decode_together(k, d, path_only), output)
    long_ = stored(lengths.filter(F.col("_n") > WHOLE).select("seq"))
    if not long_.isEmpty():
        done = done.unionByName(_decode_long(base.join(long_, "seq", "left_semi"), params, k, d, path_only, output))
    each = ["state"] if path_only else ["state", "smoothed", "filtered"]
    named = done.join(chunks.drop("x"), ["seq", "blk"])
    more = ["idx"] if "idx" in chunks.columns else []
    rows = named.select(*keys, "seg", "model_id", F.explode(F.arrays_zip("ts", "own", *more, *each)).alias("r"))
    return rows.filter("r.own").select(
        *keys, F.col("r.ts").alias("ts"), "model_id", F.col("r.state").alias(state),
        *[F.col(f"r.{c}").alias(c) for c in (*each[1:], *more)], "seg")


def _decode_long(base: DataFrame, params: DataFrame, k: int, d: int, path_only: bool, output: str) -> DataFrame:
    """Decoding in chunks between their boundaries, for sequences of any length."""
    small = _packed(params, ["whole"], PACKED)
    work = attach(base.select("seq", "blk", "x", "whole"), small, ["whole"], salt_on=["blk"]).drop("whole")
    bounds = stage(_boundary_table(work, k, d, best=True), "bounds")

    def run(batches):
        for pdf in batches:
            for rows, _, logb, start, trans, first in _stacks(pdf, k, d):
                path = best_path(logb, start, trans, first, rows["entry"].to_numpy(), rows["last"].to_numpy())
                res = rows[["model_id", "seq", "blk"]].copy()
                res["state"] = list(path)
                if not path_only:
                    into, out = np.stack(rows["a_in"].to_list()), np.stack(rows["b_out"].to_list())
                    gamma, _, alpha, _ = forward_backward(logb, start, trans, first, into, out)
                    res["smoothed"] = [list(g) for g in gamma]
                    res["filtered"] = [list(a) for a in alpha]
                yield res

    return _bounded_work(base, params, bounds).mapInPandas(run, output)


def posterior_metrics(df: DataFrame, k: int, posterior: str = "smoothed") -> DataFrame:
    """posterior_maxp, posterior_entropy, stability_score, mixed_signals."""
    df = df.withColumns({"posterior_maxp": F.array_max(posterior), "posterior_entropy": entropy(posterior)})
    return recompute_scores(df, k)


def recompute_scores(df: DataFrame, k: int) -> DataFrame:
    """stability and mixed signals from an entropy column."""
    score = 1.0 - F.col("posterior_entropy") / F.log(F.lit(float(k)))
    return df.withColumn("stability_score", score).withColumn("mixed_signals", 1.0 - F.col("stability_score"))
