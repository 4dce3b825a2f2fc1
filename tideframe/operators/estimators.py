"""Constrained estimation: graph Laplacians, block-Toeplitz graphical lasso, penalised segmentation, alignment."""

from __future__ import annotations

from itertools import permutations

import numpy as np


# ---------------------------------------------------------------- Laplacian learning


def incidence(p: int) -> np.ndarray:
    """Signed incidence of the complete graph, a row for each pair (0,1), (0,2), ..."""
    i, j = np.triu_indices(p, 1)
    k = np.zeros((len(i), p))
    k[np.arange(len(i)), i], k[np.arange(len(i)), j] = 1.0, -1.0
    return k


def laplacian(weights: np.ndarray, p: int) -> np.ndarray:
    i, j = np.triu_indices(p, 1)
    lap = np.zeros((p, p))
    lap[i, j] = lap[j, i] = -weights
    np.fill_diagonal(lap, -lap.sum(axis=1))
    return lap


def weights_of(lap: np.ndarray) -> np.ndarray:
    return np.maximum(-lap[np.triu_indices(len(lap), 1)], 0.0)


def log_gdet(lap: np.ndarray, tol: float = 1e-10) -> float:
    lam = np.linalg.eigvalsh(lap)
    return float(np.log(lam[lam > tol]).sum())


def check_laplacian(lap: np.ndarray, tol: float = 1e-6) -> dict[str, bool]:
    off = lap - np.diag(np.diag(lap))
    return {"row_sums": bool(np.abs(lap.sum(axis=1)).max() < tol), "off_diagonal": bool(off.max() < tol), "psd": bool(np.linalg.eigvalsh(lap).min() > -tol)}


def learn_laplacian(s: np.ndarray, beta: float = 1.0, eta: float = 0.0, v: np.ndarray | None = None, rho: float = 0.0, previous: np.ndarray | None = None, gamma: float = 0.0, start: np.ndarray | None = None, steps: int = 1000, tol: float = 1e-7) -> np.ndarray:
    """min over w >= 0 of (q + beta)'w - log gdet(L(w)) + rho/2 |D w - 1|^2 + gamma (2 |w - w'|^2 + |K_sq'(w - w')|^2).

    Projected gradient with Barzilai-Borwein steps and backtracking; stops at
    the projected-gradient residual. The problem is convex, so any solver's
    optimum is the same.
    """
    p = len(s)
    i, j = np.triu_indices(p, 1)
    target = s + (eta * v @ v.T if v is not None and eta else 0.0)
    q = target[i, i] + target[j, j] - 2 * target[i, j] + beta
    ones = np.ones((p, p)) / p
    sums = lambda w: np.bincount(i, w, p) + np.bincount(j, w, p)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        lap = laplacian(w, p) + ones
        try:
            c = np.linalg.cholesky(lap)
            inv = np.linalg.inv(lap)
        except np.linalg.LinAlgError:
            return np.inf, w
        f = float(q @ w) - 2 * float(np.log(np.diag(c)).sum())
        g = q - (inv[i, i] + inv[j, j] - 2 * inv[i, j])
        if rho:
            r = sums(w) - 1
            f, g = f + rho / 2 * float(r @ r), g + rho * (r[i] + r[j])
        if gamma and previous is not None:
            d = w - previous
            e = sums(d)
            f, g = f + gamma * (2 * float(d @ d) + float(e @ e)), g + 2 * gamma * (2 * d + e[i] + e[j])
        return f, g

    w = np.maximum(start, 1e-6) if start is not None else np.full(len(q), 1.0 / p)
    f, g = value(w)
    step = 1.0 / max(float(np.abs(g).max()), 1.0)
    for _ in range(steps):
        if np.abs(w - np.maximum(w - g, 0)).max() < tol:
            break
        while True:
            new = np.maximum(w - step * g, 0)
            f2, g2 = value(new)
            d = new - w
            if f2 <= f + float(g @ d) * 1e-4 or step < 1e-14:
                break
            step *= 0.5
        y = g2 - g
        curve = float(d @ y)
        step = float(np.clip(float(d @ d) / curve, 1e-10, 1e6)) if curve > 1e-18 else min(step * 2, 1e6)
        if not np.abs(d).max() > 0:
            break
        w, f, g = new, f2, g2
    return w


def sgl(s: np.ndarray, beta: float = 10.0) -> np.ndarray:
    """The plain sparse Laplacian, without degree control."""
    return learn_laplacian(s, beta=beta)


def sample_gmrf(lap: np.ndarray, n: int, eps: float = 0.01, seed: int = 42) -> np.ndarray:
    """Rows drawn from the Gaussian field whose precision is the Laplacian plus eps on the diagonal."""
    p = len(lap)
    return np.random.default_rng(seed).multivariate_normal(np.zeros(p), np.linalg.inv(lap + eps * np.eye(p)), n)


def k_component(s: np.ndarray, k: int = 3, eta: float = 300.0, rho: float = 100.0, rounds: int = 50, tol: float = 1e-4) -> np.ndarray:
    """Alternate the k least eigenvectors and the degree-controlled Laplacian until it stops moving."""
    p = len(s)
    w = learn_laplacian(s, beta=0.0, rho=rho)
    lap = laplacian(w, p)
    for _ in range(rounds):
        v = np.linalg.eigh(lap)[1][:, :k]
        w = learn_laplacian(s, beta=0.0, eta=eta, v=v, rho=rho, start=w)
        new = laplacian(w, p)
        if np.linalg.norm(new - lap) <= tol * max(np.linalg.norm(lap), 1e-12):
            return new
        lap = new
    return lap


def time_varying(returns: np.ndarray, window: int = 30, delta: float = 100.0, beta: float = 0.0, rho: float = 0.0, k: int = 1, eta: float = 0.0) -> list[tuple[int, np.ndarray]]:
    """(last day, weights) for every window of correlations; each is tied to the one before by delta / window.

    With eta, weight is drawn away from pairs that the k least eigenvectors of the Laplacian before (at first: of the correlations) tell apart.
    """
    out, previous = [], None
    for t in range(window - 1, len(returns)):
        block = returns[t - window + 1 : t + 1]
        sd = block.std(axis=0)
        z = (block - block.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
        corr = z.T @ z / window
        least = np.linalg.eigh(corr if previous is None else laplacian(previous, len(corr)))[1][:, :k] if eta else None
        previous = learn_laplacian(corr, beta=beta, eta=eta, v=least, rho=rho, previous=previous, gamma=delta / window if previous is not None else 0.0, start=previous, steps=300, tol=1e-5)
        out.append((t, previous))
    return out


def fiedler(lap: np.ndarray) -> float:
    lam = float(np.linalg.eigvalsh(lap)[1])
    return lam if lam > 1e-8 else 0.0


def effective_rank(lap: np.ndarray, tol: float = 1e-8) -> int:
    """Positive eigenvalues: the nodes less the components."""
    return int((np.linalg.eigvalsh(lap) > tol).sum())


# ---------------------------------------------------------------- block-Toeplitz lasso and segmentation


def toeplitz_groups(n: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of every entry of an (n w) x (n w) block-Toeplitz matrix, and whether it is penalised (not the main diagonal)."""
    at = np.arange(n * w)
    block, place = at // n, at % n
    lag = block[None, :] - block[:, None]
    a = np.where(lag >= 0, place[:, None], place[None, :])
    b = np.where(lag >= 0, place[None, :], place[:, None])
    low, high = np.where(lag == 0, np.minimum(a, b), a), np.where(lag == 0, np.maximum(a, b), b)
    keys = (np.abs(lag) * n + low) * n + high
    return np.unique(keys, return_inverse=True)[1].reshape(keys.shape), at[:, None] != at[None, :]


def project(m: np.ndarray, groups: np.ndarray, penalised: np.ndarray, threshold: float) -> np.ndarray:
    flat = groups.ravel()
    mean = np.bincount(flat, m.ravel()) / np.bincount(flat)
    soft = np.sign(mean) * np.maximum(np.abs(mean) - threshold, 0)
    return np.where(penalised, soft[groups], mean[groups])


def toeplitz_lasso(s: np.ndarray, lam: float, n: int, w: int, rho: float = 1.0, steps: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Sparse block-Toeplitz precision by ADMM; made positive definite at the end if it is not."""
    groups, penalised = toeplitz_groups(n, w)
    size = n * w
    z, u = np.eye(size), np.zeros((size, size))
    for _ in range(steps):
        d, q = np.linalg.eigh(rho * (z - u) - s)
        theta = (q * ((d + np.sqrt(d * d + 4 * rho)) / (2 * rho))) @ q.T
        old, z = z, project(theta + u, groups, penalised, lam / rho)
        u = u + theta - z
        if np.linalg.norm(theta - z) < tol * size and rho * np.linalg.norm(z - old) < tol * size:
            break
    least = float(np.linalg.eigvalsh(z).min())
    return z if least > 1e-6 else z + (1e-6 - least) * np.eye(size)


def stack(series: np.ndarray, w: int) -> np.ndarray:
    """Row t holds the w rows up to t, oldest first."""
    return np.hstack([series[k : len(series) - w + 1 + k] for k in range(w)])


def negative_log_likelihood(x: np.ndarray, thetas: list[np.ndarray]) -> np.ndarray:
    d = x.shape[1]
    return np.column_stack([0.5 * (np.einsum("ij,jk,ik->i", x, t, x) - np.linalg.slogdet(t)[1] + d * np.log(2 * np.pi)) for t in thetas])


def viterbi(cost: np.ndarray, beta: float) -> np.ndarray:
    """Cheapest labelling with beta for each switch; staying wins ties, then the first label."""
    total, back = cost[0].copy(), np.zeros(cost.shape, int)
    for t in range(1, len(cost)):
        best = int(total.argmin())
        stay = total <= total[best] + beta
        back[t] = np.where(stay, np.arange(cost.shape[1]), best)
        total = np.where(stay, total, total[best] + beta) + cost[t]
    label = np.zeros(len(cost), int)
    label[-1] = int(total.argmin())
    for t in range(len(cost) - 1, 0, -1):
        label[t - 1] = back[t, label[t]]
    return label


def contiguous_start(length: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of a random number of segments, 2k to 6k of them (fewer in a short series), each of one random label."""
    segments = min(int(rng.integers(2 * k, 6 * k, endpoint=True)), length)
    opens = np.zeros(length, int)
    opens[1 + rng.permutation(length - 1)[: segments - 1]] = 1
    return rng.integers(0, k, segments)[np.cumsum(opens)]


def segment_once(x: np.ndarray, k: int, n: int, w: int, lam: float, beta: float, seed: int, steps: int = 30) -> tuple[float, np.ndarray]:
    """One EM run from a random contiguous start: (penalised cost, labels). A kind of too few rows keeps its matrix, or takes that of all rows."""
    label = contiguous_start(len(x), k, np.random.default_rng(seed))
    learned = lambda rows: toeplitz_lasso(rows.T @ rows / len(rows), lam, n, w)
    thetas: dict[int, np.ndarray] = {}
    for _ in range(steps):
        sizes = np.bincount(label, minlength=k)
        thetas = {c: learned(x[label == c]) if sizes[c] > n * w else thetas[c] if c in thetas else learned(x) for c in range(k)}
        cost = negative_log_likelihood(x, [thetas[c] for c in range(k)])
        before, label = label, viterbi(cost, beta)
        if np.array_equal(before, label):
            break
    return float(cost[np.arange(len(x)), label].sum() + beta * np.count_nonzero(np.diff(label))), label


def align(true: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Predicted labels renamed to the best matching true ones; unmatched ones get a label above all."""
    ts, ps = np.unique(true), np.unique(pred)
    table = np.array([[int(((true == t) & (pred == p)).sum()) for p in ps] for t in ts])
    size = max(len(ts), len(ps))
    full = np.zeros((size, size), int)
    full[: len(ts), : len(ps)] = table
    best = max(permutations(range(size)), key=lambda x: sum(full[x[c], c] for c in range(size))) if size <= 7 else _assign(full)
    other = int(ts.max()) + 1
    names = {p: int(ts[best[c]]) if best[c] < len(ts) else other for c, p in enumerate(ps)}
    return np.array([names[p] for p in pred])


def _assign(gain: np.ndarray) -> list[int]:
    """Row for each column with the greatest total: shortest augmenting paths (Hungarian method)."""
    cost = gain.max() - gain.T.astype(float)
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[col]:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = cost[match[col] - 1, free - 1] - u[match[col]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], col
            nxt = int(free[least[free].argmin()])
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            col = nxt
        while col:
            match[col], col = match[way[col]], way[col]
    out = [0] * n
    for col in range(1, n + 1):
        out[match[col] - 1] = col - 1
    return out


def macro_f1(true: np.ndarray, pred: np.ndarray) -> float:
    named = align(true, pred)
    found = []
    for c in np.union1d(true, named):
        tp = int(((true == c) & (named == c)).sum())
        both = int((true == c).sum() + (named == c).sum())
        found.append(2 * tp / both if both else 0.0)
    return float(np.mean(found))


# ---------------------------------------------------------------- baselines


def kmeans(x: np.ndarray, k: int, seed: int, tries: int = 10, steps: int = 100) -> np.ndarray:
    best = (np.inf, np.zeros(len(x), int))
    for t in range(tries):
        rng = np.random.default_rng([seed, t])
        centre = x[rng.choice(len(x), k, replace=False)].astype(float)
        for _ in range(steps):
            d = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2)
            label = d.argmin(axis=1)
            new = np.array([x[label == c].mean(axis=0) if (label == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        best = min(best, (float(d.min(axis=1).sum()), label), key=lambda z: z[0])
    return best[1]


def mixture(x: np.ndarray, k: int, seed: int, spherical: bool = False, steps: int = 100, floor: float = 1e-4) -> np.ndarray:
    """Gaussian mixture by EM from k-means, full or spherical covariances; `floor` is added to every variance."""
    label, d = kmeans(x, k, seed, 3), x.shape[1]
    r = np.eye(k)[label]
    for _ in range(steps):
        n = r.sum(axis=0) + 1e-9
        mean = r.T @ x / n[:, None]
        logs = np.empty((len(x), k))
        for c in range(k):
            y = x - mean[c]
            cov = floor * np.eye(d) + (np.eye(d) * (r[:, c] @ (y * y)).sum() / (n[c] * d) if spherical else (r[:, c, None] * y).T @ y / n[c])
            logs[:, c] = np.log(n[c] / len(x)) - 0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - r).max() < 1e-5:
            break
        r = new
    return r.argmax(axis=1)


def neural_gas(x: np.ndarray, k: int, seed: int, epochs: int = 20, reach: tuple[float, float] | None = None, rate: tuple[float, float] = (0.5, 0.05)) -> np.ndarray:
    """Centres pulled to each row shown, less by rank of nearness; reach (k / 2 to 0.5) and rate go geometrically from first to last."""
    rng = np.random.default_rng(seed)
    shown = np.concatenate([rng.permutation(len(x)) for _ in range(epochs)])
    centre = x[rng.permutation(len(x))[:k]].astype(float)
    part = np.arange(len(shown)) / len(shown)
    reaches, rates = (first * (last / first) ** part for first, last in (reach or (k / 2, 0.5), rate))
    for row, width, pull in zip(x[shown], reaches, rates):
        gap = row - centre
        rank = np.argsort(np.argsort(np.einsum("ij,ij->i", gap, gap), kind="stable"))
        centre += pull * np.exp(-rank / width)[:, None] * gap
    return ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)


def _warped(cost: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """For many cost matrices (rows, times, times): the totals of the (soft) cheapest paths, and how far each cell is on its path.

    A cell is reached from the cell before on the diagonal, above or to the left; the
    share of each is 1 for the cheapest (the first of equals), or the soft minimum's.
    """
    rows, n, m = cost.shape
    total = np.full((rows, n + 1, m + 1), np.inf)
    total[:, 0, 0] = 0.0
    share = np.zeros((rows, n + 1, m + 1, 3))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            three = np.stack([total[:, i - 1, j - 1], total[:, i - 1, j], total[:, i, j - 1]], axis=1)
            low = three.min(axis=1)
            if gamma:
                soft = np.exp(-(three - low[:, None]) / gamma)
                share[:, i, j] = soft / soft.sum(axis=1, keepdims=True)
                low = low - gamma * np.log(soft.sum(axis=1))
            else:
                share[np.arange(rows), i, j, three.argmin(axis=1)] = 1.0
            total[:, i, j] = cost[:, i - 1, j - 1] + low
    on = np.zeros((rows, n + 1, m + 1))
    on[:, n, m] = 1.0
    for i in range(n, 0, -1):
        for j in range(m, 0, -1):
            here = on[:, i, j, None] * share[:, i, j]
            on[:, i - 1, j - 1] += here[:, 0]
            on[:, i - 1, j] += here[:, 1]
            on[:, i, j - 1] += here[:, 2]
    return total[:, n, m], on[:, 1:, 1:]


def dtw(a: np.ndarray, b: np.ndarray, gamma: float = 0.0) -> float:
    """Dynamic time warping of two (time, dims) series; gamma > 0 takes the soft minimum."""
    return float(_warped(((a[:, None, :] - b[None]) ** 2).sum(axis=2)[None], gamma)[0][0])


def dtw_kmeans(x: np.ndarray, k: int, dims: int, seed: int, gamma: float = 0.0, steps: int = 10, moves: int = 3) -> np.ndarray:
    """Barycentre clustering of rows of (time x dims) values under (soft) time warping; linear in the rows.

    A centre moves to the mean of what its rows' paths align with each of its times.
    """
    series = x.reshape(len(x), -1, dims).astype(float)
    centre = series[np.random.default_rng(seed).permutation(len(x))[:k]]
    costs = lambda rows, c: ((c[None, :, None, :] - rows[:, None, :, :]) ** 2).sum(axis=3)
    label = np.full(len(x), -1)
    for _ in range(steps):
        new = np.stack([_warped(costs(series, c), gamma)[0] for c in centre], axis=1).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            mine = series[label == c]
            for _ in range(moves if len(mine) else 0):
                on = _warped(costs(mine, centre[c]), gamma)[1]
                centre[c] = np.einsum("rts,rsd->td", on, mine) / on.sum(axis=(0, 2))[:, None]
    return label


# ---------------------------------------------------------------- synthetic series


def random_theta(n: int, w: int, rng: np.random.Generator, share: float = 0.2) -> np.ndarray:
    """A sparse positive definite block-Toeplitz matrix."""
    groups, _ = toeplitz_groups(n, w)
    value = np.where(rng.random(groups.max() + 1) < share, rng.uniform(0.5, 0.9, groups.max() + 1) * rng.choice([-1.0, 1.0], groups.max() + 1), 0.0)
    m = value[groups]
    np.fill_diagonal(m, 0.0)
    return m + (0.1 + abs(float(np.linalg.eigvalsh(m).min()))) * np.eye(n * w)


def switching_series(sequence: list[int], length: int, n: int, w: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(series, labels): each new row is drawn given the w - 1 rows before it, by its segment's matrix."""
    rng = np.random.default_rng(seed)
    thetas = {c: random_theta(n, w, rng) for c in sorted(set(sequence))}
    rows, labels = [np.zeros(n)] * (w - 1), []
    for c in sequence:
        cov = np.linalg.inv(thetas[c])
        past, now = cov[: n * (w - 1), : n * (w - 1)], cov[n * (w - 1) :, : n * (w - 1)]
        gain = now @ np.linalg.inv(past) if w > 1 else np.zeros((n, 0))
        left = cov[n * (w - 1) :, n * (w - 1) :] - gain @ now.T
        root = np.linalg.cholesky((left + left.T) / 2 + 1e-12 * np.eye(n))
        for _ in range(length):
            before = np.concatenate(rows[len(rows) - w + 1 :]) if w > 1 else np.zeros(0)
            rows.append(gain @ before + root @ rng.standard_normal(n))
            labels.append(c)
    return np.array(rows[w - 1 :]), np.array(labels)


#: Baselines by name: each is f(rows, k, seed) -> labels.
CLUSTERERS = {
    "kmeans": kmeans,
    "mixture": mixture,
    "spherical_mixture": lambda x, k, seed: mixture(x, k, seed, spherical=True),
    "neural_gas": neural_gas,
    "dtw": lambda x, k, seed, dims=1: dtw_kmeans(x, k, dims, seed),
    "soft_dtw": lambda x, k, seed, dims=1: dtw_kmeans(x, k, dims, seed, gamma=1.0),
}
