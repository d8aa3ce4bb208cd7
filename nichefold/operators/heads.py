"""Relevance heads on frozen features, out of fold: ridge from Gram sums, logistic, MLP and open-vocabulary heads by descent.

Nothing is refused for its size.  Ridge sums outer products in row batches on the cluster, band by band; wide ones a fold at a time, so that a worker holds
one matrix of features by features, and each fold is solved in a task of its own.  The other heads train in one task a fold while its rows fit a worker
(WORKER_NUMBERS) and its steps are few operations (WORKER_WORK); beyond that the same steps run with gradients summed over the cluster, a job a step, in which a task
holds some of the rows and works on them for all folds.  Both give one result, whatever the partitioning: units are dropped by hashes of item, step and unit, so one
draw serves all folds.  The driver holds parameters, never rows.

Rows are (item_id, fold, x array<double>, y array<double>) and may have ``skip``, an array of folds that a row isn't learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichefold.functions.arrays import matrix
from nichefold.functions.exprs import LEAP, MULT, MULT2, PRIME, id_number, stable_hash, stable_hashes
from nichefold.functions.workers import ship
from nichefold.sources.stage import stage

#: Numbers of training features that one task holds, and operations of all steps of a fold that it does, where there are rows for more tasks than folds.
WORKER_NUMBERS, WORKER_WORK = 200_000_000, 5e12
#: Numbers of features that a task of a shared step holds at most, of one block of its rows, and rows that make another task worth its gradients.
TASK_NUMBERS, BLOCK_NUMBERS, TASK_ROWS = 16_000_000, 2_000_000, 8192
#: Numbers of all folds' Gram matrices that a task sums before rows are dealt by fold, and of one band of a matrix.
GRAM_NUMBERS, BAND_NUMBERS = 8_000_000, 64_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Features up to which logistic heads end with Newton's steps.
NARROW = 256
#: Rows whose draws are worked out at a time.
DRAWN = 128
#: Rows that one task takes a step over at a time, so few that what is worked out of them stays in a core's cache; as many as features, up to so many, where those are more.
TOGETHER, WIDE_TOGETHER = 256, 2048


def fold_list(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select("fold").distinct().collect())  # a row a fold


def _width(rows: DataFrame, column: str) -> int:
    return rows.agg(F.max(F.size(column))).first()[0] or 0


# ---- ridge ----


def _gram_bands(rows: DataFrame, width: int, folds: list[int]) -> DataFrame:
    """(fold, band, sums): by fold, rows of the sum of outer products of (1, x, y), as bytes of doubles.  rows: fold, v."""
    high = max(1, BAND_NUMBERS // width)
    if len(folds) * width * width > GRAM_NUMBERS:
        # One fold a task, in chunks of at least as many rows as a matrix has.
        n = rows.count()
        chunks = max(1, n // (len(folds) * max(width, 4096)))
        at = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")) - 1
        rows = rows.repartitionById(len(folds) * chunks, (at * chunks + F.pmod(F.xxhash64("v"), F.lit(chunks))).cast("int"))

    def partial(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(0).to_numpy(zero_copy_only=False)
            v = np.hstack([np.ones((b.num_rows, 1)), matrix(b.column(1), width - 1)])
            for f in np.unique(of):
                part = v[of == f]
                if int(f) not in sums:
                    sums[int(f)] = np.zeros((width, width))
                sums[int(f)] += part.T @ part
        for f, m in sums.items():
            for at in range(0, width, high):
                yield pa.record_batch([pa.array([f], pa.int32()), pa.array([at // high], pa.int32()), pa.array([m[at : at + high].tobytes()])], names=["fold", "band", "sums"])

    kind = "fold int, band int, sums binary"
    return add_up(rows.select(F.col("fold").cast("int"), "v").mapInArrow(partial, kind), ["fold", "band"], kind)


def add_up(parts: DataFrame, by: list[str], kind: str, then: tuple[str, ...] = (), tasks: tuple[int, ...] = ()) -> DataFrame:
    """Sums of equally long blocks of doubles by two int columns, in a stream over sorted rows; then: columns that fix the order of what is added."""

    def run(batches):
        import pyarrow as pa

        now, total = None, None
        emit = lambda: pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()])], names=[*by, "sums"])
        for b in batches:
            for a, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                part = np.frombuffer(s.as_buffer(), dtype=np.float64)
                if (a, c) == now:
                    total += part
                    continue
                if now is not None:
                    yield emit()
                now, total = (a, c), part.copy()
        if now is not None:
            yield emit()

    return parts.repartition(*tasks, *by).sortWithinPartitions(*by, *then).select(*by, "sums").mapInArrow(run, kind)


def ridge_models(rows: DataFrame, n_targets: int, dim: int, folds: list[int], alpha: float, intercept: bool, skip_empty: bool) -> DataFrame:
    """(fold, part, sums): the weights of each fold's model, learned from the other folds, in pieces; the intercepts are the last row of the matrix."""
    width = 1 + dim + n_targets
    high = max(1, BAND_NUMBERS // width)
    bands = stage(_gram_bands(rows.select("fold", F.concat("x", "y").alias("v")), width, folds), "gram")
    others = F.explode(F.array(*[F.struct(F.lit(i).alias("task"), F.lit(f).alias("of")) for i, f in enumerate(folds)])).alias("o")
    sent = bands.select("fold", "band", "sums", others).filter("fold <> o.of").select(F.col("o.task").alias("task"), F.col("o.of").alias("of"), "band", "sums")

    def solve(batches):
        import pyarrow as pa

        g, fold = np.zeros((width, width)), None
        for b in batches:
            for f, band, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                fold = f
                part = np.frombuffer(s.as_buffer(), dtype=np.float64).reshape(-1, width)
                g[band * high : band * high + len(part)] += part
        if fold is None:
            return
        n, sx, sy = g[0, 0], g[0, 1 : 1 + dim].copy(), g[0, 1 + dim :].copy()
        xx, xy = g[1 : 1 + dim, 1 : 1 + dim], g[1 : 1 + dim, 1 + dim :].copy()
        if intercept and n:
            for i in range(dim):  # row by row, so that no second matrix is made
                xx[i] -= sx[i] * sx / n
            xy -= np.outer(sx, sy) / n
        xx[np.arange(dim), np.arange(dim)] += alpha
        w = np.linalg.solve(xx, xy)
        c = (sy - sx @ w) / n if intercept and n else np.zeros(n_targets)
        if skip_empty:
            w[:, sy <= 0], c[sy <= 0] = 0, 0
        full = np.vstack([w, c])
        step = max(1, BAND_NUMBERS // max(1, n_targets))
        for at in range(0, len(full), step):
            yield pa.record_batch([pa.array([fold], pa.int32()), pa.array([at // step], pa.int32()), pa.array([full[at : at + step].tobytes()])], names=["fold", "part", "sums"])

    return sent.repartitionById(len(folds), F.col("task")).select("of", "band", "sums").mapInArrow(solve, "fold int, part int, sums binary")


def ridge_oof(rows: DataFrame, n_targets: int, alpha: float = 1.0, intercept: bool = True, skip_empty: bool = True) -> DataFrame:
    """(item_id, target, score): out-of-fold ridge predictions of all targets at once.

    intercept: an unpenalised one, by centring on the training rows.  skip_empty: a target without a positive in training scores 0.
    Models (folds by features by targets) are broadcast to score rows where they lie.
    """
    ship(rows.sparkSession)
    dim, folds = _width(rows, "x"), fold_list(rows)
    id_type = dict(rows.dtypes)["item_id"]
    kind = f"item_id {id_type}, target int, score double"
    if not folds:
        return rows.sparkSession.createDataFrame([], kind)
    found: dict[int, list[bytes]] = {}
    for f, s in pairs_of(ridge_models(rows, n_targets, dim, folds, alpha, intercept, skip_empty)):
        found.setdefault(f, []).append(s)
    models = {f: np.frombuffer(b"".join(s), dtype=np.float64).reshape(dim + 1, n_targets) for f, s in found.items()}
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(1).to_numpy(zero_copy_only=False)
            x = matrix(b.column(2), dim)
            out = np.zeros((b.num_rows, n_targets))
            for f in np.unique(of):
                if int(f) in shared.value:  # a single fold has nothing to learn from
                    m = shared.value[int(f)]
                    out[of == f] = x[of == f] @ m[:-1] + m[-1]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n_targets)))
            yield pa.record_batch([ids, pa.array(np.tile(np.arange(n_targets, dtype=np.int32), b.num_rows)), pa.array(out.ravel())], names=["item_id", "target", "score"])

    return rows.select("item_id", "fold", "x").mapInArrow(predict, kind)


def pairs_of(parts: DataFrame) -> list[tuple[int, bytes]]:
    """First and third columns of parts, a few rows, by the first two."""
    t = parts.toArrow()
    found = sorted(zip(*[c.to_pylist() for c in t.columns], strict=True))
    return [(a, c) for a, _, c in found]


# ---- heads by descent ----


def pos_weight(n: float, pos: np.ndarray) -> np.ndarray:
    return np.clip((n - pos) / (pos + 1e-6), 1.0, 1000.0)


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


Steps = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def lbfgs(start: np.ndarray, rounds: int = 200, history: int = 10, small: float = 1e-9) -> Steps:
    """Yields points, is sent (loss, gradient) of them, and returns where a convex loss is least."""
    x = start
    loss, grad = yield x
    s_, y_ = [], []
    for _ in range(rounds):
        if np.abs(grad).max(initial=0) < small:
            break
        d, kept = -grad, []
        for s, y in zip(reversed(s_), reversed(y_), strict=True):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        d = d * ((s_[-1] @ y_[-1]) / (y_[-1] @ y_[-1]) if s_ else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12)))
        for (s, y), a in zip(zip(s_, y_, strict=True), reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step, low, high = grad @ d, 1.0, 0.0, np.inf
        for _ in range(30):  # a step that lowers the loss enough and flattens the slope
            new_loss, new_grad = yield x + step * d
            if new_loss > loss + 1e-4 * step * slope + 1e-15 * abs(loss):
                high = step
            elif new_grad @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if new_loss > loss:
            break
        s, y = step * d, new_grad - grad
        x, loss, grad = x + s, new_loss, new_grad
        if s @ y > 1e-16 * (y @ y):
            s_, y_ = [*s_, s][-history:], [*y_, y][-history:]
    return x


def adam(start: np.ndarray, epochs: int, lr: float) -> Steps:
    x, first, second = start, np.zeros_like(start), np.zeros_like(start)
    for t in range(1, epochs + 1):
        _, grad = yield x
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        x = x - lr * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return x


class Logistic:
    """Joint logits of all queries: weighted cross-entropy, mean over rows and queries, plus decay * (|w|^2 + |b|^2)."""

    def __init__(self, d: int, q: int, decay: float = 1e-3, rounds: int = 200, **_):
        self.d, self.q, self.decay, self.rounds = d, q, decay, rounds

    def parts(self, theta):
        w = theta.reshape(self.d + 1, self.q)
        return w[:-1], w[-1]

    def steps(self) -> Steps:
        return lbfgs(np.zeros((self.d + 1) * self.q), self.rounds)

    def work(self, n: int) -> float:
        """Operations of all steps over n rows, about."""
        return 4.0 * n * (self.d + 1) * self.q * self.rounds

    def sums(self, theta, x, y, n, pw, rng):
        """Loss and gradient of these rows' share of the mean over n rows."""
        w, b = self.parts(theta)
        m = x @ w + b
        weight = np.where(y > 0, pw, 1.0) / (n * self.q)
        loss = float((weight * (np.logaddexp(0, m) - y * m)).sum())
        g = weight * (_sigmoid(m) - y)
        return loss, np.vstack([x.T @ g, g.sum(axis=0)]).ravel()

    def penalty(self, theta):
        return self.decay * float(theta @ theta), 2 * self.decay * theta

    def curvature(self, theta, x, y, n, pw):
        """These rows' share of each query's second derivatives and gradient: q x (d + 1) x (d + 2) numbers."""
        z = np.hstack([x, np.ones((len(x), 1))])
        beta = theta.reshape(self.d + 1, self.q)
        out = np.empty((self.q, self.d + 1, self.d + 2))
        for j in range(self.q):
            weight = np.where(y[:, j] > 0, pw[j], 1.0) / (n * self.q)
            p = _sigmoid(z @ beta[:, j])
            out[j, :, :-1] = (z * (weight * p * (1 - p))[:, None]).T @ z
            out[j, :, -1] = z.T @ (weight * (p - y[:, j]))
        return out.ravel()

    def newton(self, theta, sums):
        """A step of Newton's by what ``curvature`` adds up to."""
        beta = theta.reshape(self.d + 1, self.q).copy()
        for j, m in enumerate(sums.reshape(self.q, self.d + 1, self.d + 2)):
            beta[:, j] -= np.linalg.solve(m[:, :-1] + 2 * self.decay * np.eye(self.d + 1), m[:, -1] + 2 * self.decay * beta[:, j])
        return beta.ravel()

    def newton_rounds(self) -> int:
        """Steps from about the minimum, which descent finds to half the digits, where features are so few that they cost little."""
        return 4 if self.d <= NARROW else 0

    def scores(self, theta, x):
        w, b = self.parts(theta)
        return x @ w + b


class Mlp:
    """One hidden layer for all queries jointly: ReLU, dropout, Adam on full batches."""

    def __init__(self, d: int, q: int, seed: int = 0, hidden: int = 256, epochs: int = 400, lr: float = 0.05, decay: float = 1e-3, dropout: float = 0.1, **_):
        self.d, self.q, self.hidden, self.epochs, self.lr, self.decay, self.dropout, self.seed = d, q, hidden, epochs, lr, decay, dropout, seed

    def parts(self, theta):
        cut = np.cumsum([self.d * self.hidden, self.hidden, self.hidden * self.q])
        a, b, c, e = np.split(theta, cut)
        return a.reshape(self.d, self.hidden), b, c.reshape(self.hidden, self.q), e

    def steps(self) -> Steps:
        rng = np.random.default_rng(self.seed)
        sizes = [(self.d * self.hidden, self.d), (self.hidden, self.d), (self.hidden * self.q, self.hidden), (self.q, self.hidden)]
        return adam(np.concatenate([rng.uniform(-(max(1, fan) ** -0.5), max(1, fan) ** -0.5, k) for k, fan in sizes]), self.epochs, self.lr)

    def work(self, n: int) -> float:
        return 6.0 * n * self.hidden * (self.d + self.q) * self.epochs

    def sums(self, theta, x, y, n, pw, rng):
        w1, b1, w2, b2 = self.parts(theta)
        h = x @ w1
        h += b1
        np.maximum(h, 0, out=h)
        h *= _kept(rng, h.shape, self.dropout)
        scaled = w2 / (1 - self.dropout)  # the fewer numbers of the two that may be scaled
        p = _sigmoid(h @ scaled + b2)
        g = (p * (1 - y + pw * y) - pw * y) / (n * self.q)
        back = g @ scaled.T
        back *= h > 0
        return 0.0, np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (h.T @ g).ravel() / (1 - self.dropout), g.sum(axis=0)])

    def penalty(self, theta):
        return 0.0, self.decay * theta

    def newton_rounds(self) -> int:
        return 0

    def scores(self, theta, x):
        w1, b1, w2, b2 = self.parts(theta)
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2


class OpenVocab:
    """A linear map of features into text space by cosine loss; y holds a row's text vector, the scores are cosines with the queries' vectors."""

    def __init__(self, d: int, q: int, seed: int = 0, epochs: int = 400, lr: float = 0.05, decay: float = 1e-3, vectors: np.ndarray | None = None, **_):
        self.d, self.q, self.seed, self.epochs, self.lr, self.decay = d, q, seed, epochs, lr, decay
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-8)

    def steps(self) -> Steps:
        s = max(1, self.d) ** -0.5
        return adam(np.random.default_rng(self.seed).uniform(-s, s, (self.d + 1) * self.q), self.epochs, self.lr)

    def work(self, n: int) -> float:
        return 4.0 * n * (self.d + 1) * self.q * self.epochs

    def sums(self, theta, x, y, n, pw, rng):
        w = theta.reshape(self.d + 1, self.q)
        p = x @ w[:-1] + w[-1]
        size = np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
        u = p / size
        g = -(y - u * (u * y).sum(axis=1, keepdims=True)) / size / n
        return 0.0, np.vstack([x.T @ g, g.sum(axis=0)]).ravel()

    def penalty(self, theta):
        return 0.0, self.decay * theta

    def newton_rounds(self) -> int:
        return 0

    def scores(self, theta, x):
        w = theta.reshape(self.d + 1, self.q)
        p = x @ w[:-1] + w[-1]
        return p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6) @ self.vectors.T


HEADS: dict[str, Callable] = {"logistic": Logistic, "mlp": Mlp, "openvocab": OpenVocab}


class Draws:
    """Random numbers that depend on a row's key, the step and the place in the row alone, so that any task, and SQL, draws the same."""

    def __init__(self, keys: np.ndarray, step: int):
        self.rows = stable_hashes(keys + (step + 1) * LEAP)
        self.known: dict[tuple[int, float], np.ndarray] = {}

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        return (stable_hashes(self.rows[:, None] + np.arange(shape[1], dtype=np.int64) * LEAP) + 0.5) / PRIME

    def kept(self, shape: tuple[int, int], rate: float) -> np.ndarray:
        """random(shape) >= rate, worked out once, some rows at a time, without divisions.

        A hash of row + place is c + d + e * b modulo 2^31 - 1, of which c and e are the row's and b and d the place's.  With e in two pieces this is a matrix product of whole
        numbers below 2^48, which doubles hold.  Half of one is added, so that what is left of the modulus is at least 2^-32 of it away from 0 and from the rate, and its
        error is below 2^-34.
        """
        width = shape[1]
        if (width, rate) in self.known:
            return self.known[width, rate]
        least = max(0, math.floor(rate * PRIME) - 2)
        while least < PRIME and (least + 0.5) / PRIME < rate:
            least += 1
        row, place = self.rows % PRIME, (np.arange(width, dtype=np.int64) * LEAP + 1) % PRIME
        a, b = row * MULT % PRIME, place * MULT % PRIME
        c, d, e = (a * a % PRIME + row) * MULT2 % PRIME, (b * b % PRIME + place) * MULT2 % PRIME, a * (2 * MULT2) % PRIME
        left = np.stack([e >> 16, e & 65535, c, np.ones_like(c)], axis=1).astype(np.float64)
        right = np.stack([(b << 16) % PRIME, b, np.ones_like(b), d + 0.5])
        out = np.empty((len(row), width), dtype=bool)
        for at in range(0, len(row), DRAWN):
            v = left[at : at + DRAWN] @ right
            v *= 1 / PRIME
            v -= np.floor(v)
            out[at : at + DRAWN] = v >= least / PRIME
        self.known[width, rate] = out
        return out

    def of(self, at: np.ndarray) -> Draws:
        """Those of some of the rows, which share what is worked out here."""
        return _Some(self, at)


class _Some(Draws):
    def __init__(self, whole: Draws, at: np.ndarray):
        self.rows, self.whole, self.at = whole.rows[at], whole, at

    def kept(self, shape: tuple[int, int], rate: float) -> np.ndarray:
        return self.whole.kept((len(self.whole.rows), shape[1]), rate)[self.at]


def _kept(rng, shape: tuple[int, int], rate: float) -> np.ndarray:
    return rng.kept(shape, rate) if hasattr(rng, "kept") else rng.random(shape) >= rate


def fit(model, x: np.ndarray, y: np.ndarray, seed: int = 0, keys: np.ndarray | None = None) -> np.ndarray:
    """Parameters of a model from rows at hand, of which x is standardised already; keys: of the rows, for random draws."""
    steps, t, n = model.steps(), 0, max(1, len(x))
    keys = stable_hashes(np.arange(len(x), dtype=np.int64), seed) if keys is None else keys
    pw = pos_weight(len(x), y.sum(axis=0))
    try:
        theta = next(steps)
        while True:
            loss, grad = _banded(*x.shape, lambda at, theta=theta, t=t: model.sums(theta, x[at], y[at], n, pw, Draws(keys[at], t)))
            more, pull = model.penalty(theta)
            theta, t = steps.send((loss + more, grad + pull)), t + 1
    except StopIteration as e:
        theta = e.value
    for _ in range(model.newton_rounds() if len(x) else 0):
        theta = model.newton(theta, _banded(*x.shape, lambda at, theta=theta: (0.0, model.curvature(theta, x[at], y[at], n, pw)))[1])
    return theta


def _together(d: int) -> int:
    return max(TOGETHER, min(d, WIDE_TOGETHER))


def _banded(n: int, d: int, make: Callable) -> tuple[float, np.ndarray]:
    """Sums of make(slice), a number and an array, over n rows of d features, some at a time, so that what is worked out a row stays small."""
    high = _together(d)
    loss, grad = make(slice(0, high))
    for at in range(high, n, high):
        more, part = make(slice(at, at + high))
        loss, grad = loss + more, grad + part
    return loss, grad


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training rows scaled in place by mean and sample deviation plus 1e-6, which are returned."""
    mu = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    x -= mu
    sd = (np.sqrt(np.einsum("ij,ij->j", x, x) / (len(x) - 1)) if len(x) > 1 else np.zeros(x.shape[1])) + 1e-6
    x /= sd
    return mu, sd


def _learned_from(fold: int):
    """Whether a row is learned from when a fold is tested."""
    return (F.col("fold") != fold) & ~F.array_contains("skip", F.lit(fold))


def _with_skip(rows: DataFrame, seed: int) -> DataFrame:
    """rows with ``skip``, and ``key``, by which random numbers are drawn for them."""
    rows = rows if "skip" in rows.columns else rows.withColumn("skip", F.array().cast("array<int>"))
    return rows.withColumn("key", stable_hash(id_number(rows, "item_id"), seed))


def _dealt(rows: DataFrame, folds: list[int]) -> DataFrame:
    """A row for each fold that a row is learned from or tested in (task, test, item_id, x, y, key): a partition a fold, training rows first."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("task"), F.lit(f).alias("g")) for i, f in enumerate(folds)])).alias("o")
    all_ = rows.select("item_id", "fold", "x", "y", "skip", "key", each).withColumn("test", (F.col("fold") == F.col("o.g")).cast("int"))
    used = all_.filter((F.col("test") == 1) | ~F.array_contains("skip", F.col("o.g"))).select(F.col("o.task").alias("task"), "test", "item_id", "x", "y", "key")
    return used.repartitionById(len(folds), F.col("task")).sortWithinPartitions("task", "test", "item_id")


def head_oof(rows: DataFrame, names: list[str], head: str = "logistic", seed: int = 0, folds: list[int] | None = None, **options) -> DataFrame:
    """(query_id, item_id, score): held-out scores of each fold, pooled without calibration.

    names: of the scores, in order.  folds: those to test, by default all.
    """
    if head not in HEADS:
        raise ValueError(f"unknown head {head}")
    rows = _with_skip(rows, seed)
    folds = fold_list(rows) if folds is None else folds
    d, q = _width(rows, "x"), _width(rows, "y")
    kind = f"query_id string, item_id {dict(rows.dtypes)['item_id']}, score double"
    if not folds:
        return rows.sparkSession.createDataFrame([], kind)
    ship(rows.sparkSession)
    n, *learned = rows.agg(F.count("*"), *[F.count_if(_learned_from(f)) for f in folds]).first()
    sizes = dict(zip(folds, learned, strict=True))
    make = lambda: HEADS[head](d, q, seed=seed, **options)
    most = max(learned)
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, n // TASK_ROWS)
    if most * d > WORKER_NUMBERS or make().work(most) > WORKER_WORK and tasks > len(folds):
        return _score(rows, names, _fit_on_cluster(rows, make, folds, sizes, d, q, max(1, tasks, math.ceil(n * d / TASK_NUMBERS))), make, d, kind)
    counts = [sizes[f] for f in folds]

    def run(batches):
        import pyarrow as pa

        x = y = keys = theta = model = mu = sd = None
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            task, test = b.column(0)[0].as_py(), b.column(1).to_numpy(zero_copy_only=False)
            if x is None:
                x, y, keys = np.empty((counts[task], d)), np.empty((counts[task], q)), np.empty(counts[task], dtype=np.int64)
            k = int(np.searchsorted(test, 1))
            x[at : at + k], y[at : at + k], keys[at : at + k] = matrix(b.column(3)[:k], d), matrix(b.column(4)[:k], q), b.column(5)[:k].to_numpy(zero_copy_only=False)
            at += k
            if k == b.num_rows:
                continue
            if theta is None:
                mu, sd = standardise(x)
                model = make()
                theta = fit(model, x, y, seed, keys)
            s = model.scores(theta, (matrix(b.column(3)[k:], d) - mu) / sd)
            ids = b.column(2)[k:]
            for j, name in enumerate(names):
                yield pa.record_batch([pa.array([name] * len(ids)), ids, pa.array(s[:, j].copy())], names=["query_id", "item_id", "score"])

    return _dealt(rows, folds).mapInArrow(run, kind)


def _blocks(rows: DataFrame, folds: list[int], d: int, tasks: int) -> DataFrame:
    """(n, x, y, keys, used): rows of a task, packed as bytes, and of each row and fold whether it is learned from."""
    high = max(1, min(_together(d), BLOCK_NUMBERS // max(1, d)))
    used = F.array(*[_learned_from(f).cast("double") for f in folds]).alias("used")

    def pack(batches):
        import pyarrow as pa

        def blocks(of):
            x, y, keys, use = (np.concatenate(v) for v in zip(*of, strict=True))
            for at in range(0, len(keys), high):
                part = slice(at, at + high)
                bytes_ = [pa.array([v[part].tobytes()], pa.binary()) for v in (x, y, keys, use)]
                yield pa.record_batch([pa.array([len(keys[part])], pa.int32()), *bytes_], names=["n", "x", "y", "keys", "used"])

        waiting, n = [], 0
        for b in batches:  # of however few rows
            if not b.num_rows:
                continue
            waiting.append((matrix(b.column(0), d), matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(3), len(folds)) > 0))
            n += b.num_rows
            if n >= high:
                yield from blocks(waiting)
                waiting, n = [], 0
        if waiting:
            yield from blocks(waiting)

    dealt = rows.select("x", "y", "key", used, "fold").repartition(tasks, "key").sortWithinPartitions("fold", "key")
    return dealt.drop("fold").mapInArrow(pack, "n int, x binary, y binary, keys binary, used binary")


def _fit_on_cluster(rows: DataFrame, make, folds: list[int], sizes: dict[int, int], d: int, q: int, tasks: int) -> dict:
    """By fold (parameters, means, deviations), each step's gradients summed over all rows where they lie, and then band by band of the parameters."""
    spark = rows.sparkSession
    kept = _blocks(rows, folds, d, tasks).persist()  # each step reads them
    kept.count()

    def total(make_part, size: int, t: int = 0) -> dict[int, np.ndarray]:
        """Sums by fold of make_part(fold, x, y, draws), so many numbers of its own or None, over the rows that it is learned from."""

        def part(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            sums: dict[int, np.ndarray] = {}
            task = TaskContext.get().partitionId()
            for b in batches:
                for n, *packed in zip(b.column(0).to_pylist(), *[b.column(i) for i in range(1, 5)], strict=True):
                    x, y, keys, used = (np.frombuffer(v.as_buffer(), dtype=k).reshape(n, -1) for v, k in zip(packed, (np.float64, np.float64, np.int64, bool), strict=True))
                    draws = Draws(keys[:, 0], t)
                    for f, use in zip(folds, used.T, strict=True):
                        if not use.any():
                            continue
                        more = make_part(f, x, y, draws) if use.all() else make_part(f, x[use], y[use], draws.of(use))
                        if f in sums:
                            sums[f] += more
                        elif more is not None:
                            sums[f] = more
            for f, v in sums.items():
                v = np.ascontiguousarray(v, dtype=np.float64)
                for at in range(0, len(v), BAND_NUMBERS):
                    yield pa.record_batch([pa.array([k], pa.int32()) for k in (f, at // BAND_NUMBERS, task)] + [pa.array([v[at : at + BAND_NUMBERS].tobytes()])], names=["fold", "part", "task", "sums"])

        bands: dict[int, list[bytes]] = {f: [] for f in folds}
        parts = kept.mapInArrow(part, "fold int, part int, task int, sums binary")
        adders = min(tasks, len(folds) * math.ceil(size / BAND_NUMBERS))
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, "4")  # of large rows, which reach workers sooner a few at a time
        try:
            found = pairs_of(add_up(parts, ["fold", "part"], "fold int, part int, sums binary", ("task",), (adders,)))
        finally:
            spark.conf.set(BATCH, before)
        for f, s in found:
            bands[f].append(s)
        return {f: np.frombuffer(b"".join(s), dtype=np.float64) if s else np.zeros(size) for f, s in bands.items()}

    first = total(lambda f, x, y, draws: np.concatenate([x.sum(axis=0), y.sum(axis=0)]), d + q)
    mu = {f: first[f][:d] / max(1, sizes[f]) for f in folds}
    spread = total(lambda f, x, y, draws: ((x - mu[f]) ** 2).sum(axis=0), d)
    sd = {f: np.sqrt(spread[f] / max(1, sizes[f] - 1)) + 1e-6 for f in folds}
    pw = {f: pos_weight(sizes[f], first[f][d:]) for f in folds}
    steps = {f: make().steps() for f in folds}
    now = {f: next(steps[f]) for f in folds}
    done: dict = {}
    t = 0
    while now:
        shared = spark.sparkContext.broadcast((now, mu, sd, pw))

        def grads(f, x, y, draws, shared=shared):
            now, mu, sd, pw = shared.value
            if f not in now:
                return None
            loss, g = make().sums(now[f], (x - mu[f]) / sd[f], y, sizes[f], pw[f], draws)
            return np.append(g, loss)

        sums = total(grads, 1 + max(map(len, now.values())), t)
        shared.destroy()
        for f in list(now):
            more, pull = make().penalty(now[f])
            try:
                now[f] = steps[f].send((sums[f][-1] + more, sums[f][:-1] + pull))
            except StopIteration as e:
                done[f] = e.value
                del now[f]
        t += 1
    for _ in range(make().newton_rounds()):
        shared = spark.sparkContext.broadcast((done, mu, sd, pw))

        def curves(f, x, y, draws, shared=shared):
            done, mu, sd, pw = shared.value
            return make().curvature(done[f], (x - mu[f]) / sd[f], y, sizes[f], pw[f])

        sums = total(curves, q * (d + 1) * (d + 2))
        shared.destroy()
        done = {f: make().newton(v, sums[f]) for f, v in done.items()}
    kept.unpersist()
    return {f: (v, mu[f], sd[f]) for f, v in done.items()}


def _score(rows: DataFrame, names: list[str], fitted: dict, make, d: int, kind: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        import pyarrow as pa

        model = make()
        for b in batches:
            own = b.column(1).to_numpy(zero_copy_only=False)
            for f in np.unique(own):
                if int(f) not in shared.value:
                    continue
                theta, mu, sd = shared.value[int(f)]
                at = np.flatnonzero(own == f)
                ids = b.column(0).take(pa.array(at))
                s = model.scores(theta, (matrix(b.column(2), d)[at] - mu) / sd)
                for j, name in enumerate(names):
                    yield pa.record_batch([pa.array([name] * len(at)), ids, pa.array(s[:, j].copy())], names=["query_id", "item_id", "score"])

    return rows.select("item_id", "fold", "x").mapInArrow(run, kind)


def transfer(source: DataFrame, target: DataFrame, names: list[str], head: str = "logistic", **options) -> DataFrame:
    """Scores of another sample's rows (item_id, x) by a head trained on all of the source's (item_id, x, y)."""
    q = _width(source, "y")
    both = source.select("item_id", F.lit(0).alias("fold"), "x", "y").unionByName(target.select("item_id", F.lit(1).alias("fold"), "x", F.array_repeat(F.lit(0.0), q).alias("y")))
    return head_oof(both, names, head, folds=[1], **options)


def openvocab_oof(rows: DataFrame, lineage_vectors: dict[str, np.ndarray], names: list[str], query_vectors: np.ndarray, kind_col: str = "kind", **options) -> DataFrame:
    """(query_id, item_id, score): features mapped into text space out of fold, then cosine with the query's vector.

    rows: item_id, fold, x and the type of each row; rows of a type without vector aren't learned from.
    """
    dim = query_vectors.shape[1]
    folds = fold_list(rows)
    vec = lambda v: F.array(*[F.lit(float(z)) for z in v])
    known = F.coalesce(F.col(kind_col).isin(*lineage_vectors), F.lit(False))
    y = F.lit(None).cast("array<double>")
    for name, v in lineage_vectors.items():
        y = F.when(F.col(kind_col) == name, vec(v)).otherwise(y)
    full = rows.select("item_id", "fold", "x", F.coalesce(y, F.array_repeat(F.lit(0.0), dim)).alias("y"), F.when(known, F.array().cast("array<int>")).otherwise(F.array(*[F.lit(f) for f in folds])).alias("skip"))
    return head_oof(full, names, "openvocab", vectors=np.asarray(query_vectors, dtype=np.float64), folds=folds, **options)
