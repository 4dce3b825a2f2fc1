import itertools

import numpy as np
import pytest

from tideframe.operators import estimators as es
from tideframe.operators import kernels as k


def cliques(n):
    half = n // 2
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if (a < half) == (b < half)] + [(0, half)]
    return (n, *np.array(sorted(edges)).T)


def random_graph(n, m, seed):
    pairs = np.array(list(itertools.combinations(range(n), 2)))
    return (n, *pairs[np.sort(np.random.default_rng(seed).choice(len(pairs), m, replace=False))].T)


def test_louvain_finds_planted_groups():
    for n in (12, 20, 40):
        comm = k.louvain(*cliques(n), seed=1)
        assert len(set(comm)) == 2 and len(set(comm[: n // 2])) == 1
    g = random_graph(60, 300, 5)
    assert (k.louvain(*g, seed=3) == k.louvain(*g, seed=3)).all()
    q = [k.modularity(*g, k.louvain(*g, seed=s)) for s in range(5)]
    assert min(q) > 0.15 and k.modularity(*g, np.zeros(60, int)) == pytest.approx(0.0)
    assert k.modularity(5, np.zeros(0, int), np.zeros(0, int), np.zeros(5, int)) == 0.0


def test_labels_by_size():
    sizes = np.bincount(k.louvain(*random_graph(50, 120, 2), seed=0))
    assert (np.diff(sizes) <= 0).all()


def test_path_conventions():
    a = k.adjacency(7, np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]))
    got = k.path_measures(a)
    assert got["path_lcc"] == 1.0 and 1 / got["path_harmonic"] == pytest.approx(8 / 42) and got["lcc_frac"] == pytest.approx(3 / 7)
    empty = k.path_measures(k.adjacency(4, np.zeros(0, int), np.zeros(0, int)))
    assert empty["path_harmonic"] == float("inf") and np.isnan(empty["path_lcc"])


def test_betweenness_by_counting_paths():
    n, i, j = random_graph(14, 22, 4)
    a, d = k.adjacency(n, i, j), None
    d = k.distances(a)
    total = 0.0
    for s in range(n):
        count = np.zeros(n)
        count[s] = 1
        for v in np.argsort(np.where(d[s] < 0, 99, d[s]), kind="stable"):
            for u in np.flatnonzero(a[v]):
                if d[s, u] == d[s, v] + 1 and d[s, v] >= 0:
                    count[u] += count[v]
        for t in range(n):
            if d[s, t] > 1:
                back = np.zeros(n)
                back[t] = 1
                for v in sorted(range(n), key=lambda x: -d[s, x]):
                    for u in np.flatnonzero(a[v]):
                        if d[s, u] == d[s, v] - 1 and d[s, v] > 0:
                            back[u] += back[v]
                total += sum(count[v] * back[v] / count[t] for v in range(n) if v not in (s, t) and d[s, v] > 0 and d[v, t] > 0 and d[s, v] + d[v, t] == d[s, t])
    assert k.path_measures(a)["betweenness"] == pytest.approx(total / 2 / n)


def test_clique_number():
    for seed in range(6):
        n, i, j = random_graph(11, 30, seed)
        a = k.adjacency(n, i, j)
        best = max(len(c) for r in range(1, n + 1) for c in itertools.combinations(range(n), r) if all(a[x, y] for x, y in itertools.combinations(c, 2)))
        assert k.clique_number(a) == best
    assert k.clique_number(k.adjacency(3, np.zeros(0, int), np.zeros(0, int))) == 1


def test_matching_index_and_rich_club():
    a = k.adjacency(4, np.array([0, 0, 1, 1]), np.array([2, 3, 2, 3]))
    assert k.matching_mean(a) == pytest.approx(2 / 6)
    assert k.rich_club_mean(k.adjacency(3, np.array([0, 0, 1]), np.array([1, 2, 2]))) == 1.0


def test_null_models():
    n, i, j = random_graph(40, 150, 7)
    deg = np.bincount(np.concatenate([i, j]), minlength=n)
    a, b = k.configuration(n, i, j, 3)
    assert (np.bincount(np.concatenate([a, b]), minlength=n) == deg).all() and len(set(zip(a, b))) == 150 and (a < b).all()
    assert len(set(zip(a, b)) & set(zip(i, j))) < 100
    c, d = k.configuration(n, i, j, 3, "stub")
    assert len(c) <= 150 and (c < d).all() and len(set(zip(c, d))) == len(c)
    with pytest.raises(ValueError):
        k.configuration(n, i, j, 3, "other")
    g = cliques(40)
    comm = (np.arange(40) >= 20).astype(int)
    counts = [len(k.block_graph(*g, comm, s)[0]) for s in range(20)]
    assert abs(np.mean(counts) - len(g[1])) < 3
    assert abs(np.mean([k.modularity(40, *k.block_graph(*g, comm, s), comm) for s in range(20)]) - k.modularity(*g, comm)) < 0.01


def test_spectral_identities():
    rng = np.random.default_rng(1)
    w = np.triu(rng.random((12, 12)), 1)
    w += w.T
    menu = k.spectral_menu(w)
    deg = w.sum(axis=1)
    b = w - np.outer(deg, deg) / deg.sum()
    assert menu["trace_pos"] + menu["trace_neg"] == pytest.approx(np.trace(b)) and menu["frob2"] == pytest.approx((np.linalg.eigvalsh(b) ** 2).sum())
    assert menu["mu1_norm"] == pytest.approx(max(0.0, 1 - menu["lam2_sym"]), abs=1e-9) and menu["dbar"] == pytest.approx(deg.mean())
    low, high = k.marchenko_pastur(4, 16)
    assert (low, high) == (0.25, 2.25)


def test_spectral_scalars_of_a_known_graph():
    """Two edges without a common node: every spectrum is known."""
    w = np.zeros((4, 4))
    w[0, 1] = w[1, 0] = w[2, 3] = w[3, 2] = 1.0
    want = {
        "lam2": 0, "lam_max": 2, "lam2_sym": 0, "dbar": 1, "two_m": 4, "deg_cv": 0, "mu1": 1, "mu2": 0, "muN": -1, "mu1_norm": 1, "muN_norm": -1, "gap12": 1, "spread": 2, "mu_ratio": 1, "absmax": 1,
        "n_pos": 1, "trace_pos": 1, "trace_neg": -2, "energy": 3, "frob2": 3, "spec_entropy": 3, "q_bound": 0.25, "ipr1": 0.25, "v1_deg_align": 0, "proxy_gap": 0, "proxy_norm": 0, "proxy_resid": 0,
    }
    menu = k.spectral_menu(w)
    assert set(menu) - set(want) == {"iprN"}  # of a double eigenvalue
    assert {m: menu[m] for m in want} == pytest.approx(want, abs=1e-9)
    rng = np.random.default_rng(4)
    w = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.5), 1)
    w += w.T + np.diag(np.zeros(9))
    deg, menu = w.sum(axis=1), k.spectral_menu(w)
    mu, vec = np.linalg.eigh(w - np.outer(deg, deg) / deg.sum())
    assert menu["mu_ratio"] == pytest.approx(abs(mu[0]) / mu[-1]) and menu["v1_deg_align"] == pytest.approx(abs(vec[:, -1] @ np.sqrt(deg)) / np.sqrt(deg.sum()))


def test_rewiring_mixes_a_large_graph():
    n, i, j = random_graph(120, 2000, 9)
    for seed in (0, 1):
        a, b = k.rewired(n, i, j, seed)
        assert (a < b).all() and len(set(zip(a.tolist(), b.tolist()))) == 2000
        assert (np.bincount(np.concatenate([a, b]), minlength=n) == np.bincount(np.concatenate([i, j]), minlength=n)).all()
        assert len(set(zip(a.tolist(), b.tolist())) & set(zip(i.tolist(), j.tolist()))) < 900  # by chance: some 28 % of the pairs are edges
    one = k.rewired(5, np.array([1]), np.array([3]), 0)
    assert (one[0].tolist(), one[1].tolist()) == ([1], [3]) and len(k.rewired(5, np.zeros(0, int), np.zeros(0, int), 0)[0]) == 0


def test_laplacian_optimum():
    rng = np.random.default_rng(42)
    p = 10
    chain = es.laplacian((np.subtract(*np.triu_indices(p, 1)[::-1]) == 1).astype(float), p)
    x = rng.multivariate_normal(np.zeros(p), np.linalg.inv(chain + 0.01 * np.eye(p)), 500)
    w = es.learn_laplacian(np.cov(x.T), beta=0.05)
    lap = es.laplacian(w, p)
    assert all(es.check_laplacian(lap).values()) and np.allclose(es.weights_of(lap), w)
    inc = es.incidence(p)
    assert np.allclose(inc.T @ np.diag(w) @ inc, lap)
    heavy = set(np.argsort(-w)[: p - 1])
    assert heavy == {e for e, (i, j) in enumerate(zip(*np.triu_indices(p, 1))) if j == i + 1}
    grad = np.diag(inc @ (np.cov(x.T) - np.linalg.inv(lap + np.ones((p, p)) / p)) @ inc.T) + 0.05
    assert np.abs(np.minimum(w, grad)).max() < 1e-4
    assert es.fiedler(lap) > 0 and es.log_gdet(lap) == pytest.approx(np.log(np.linalg.eigvalsh(lap)[1:]).sum())
    pinned = es.learn_laplacian(np.cov(x.T), beta=0.05, previous=w, gamma=1e6, start=w)
    assert np.abs(pinned - w).max() < 1e-3


def test_k_components():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 2))
    x = base[:, [0, 0, 0, 1, 1, 1]] + 0.3 * rng.standard_normal((400, 6))
    lap = es.k_component(np.corrcoef(x.T), k=2, eta=50.0)
    weights = -lap
    assert weights[:3, 3:].max() < 0.05 * weights[0, 1] and np.allclose(np.diag(lap), 1, atol=0.2)


def test_time_varying_follows_each_series():
    y = np.random.default_rng(0).standard_normal((40, 4))
    found = es.time_varying(y, window=30, delta=10.0)
    assert [t for t, _ in found] == list(range(29, 40)) and all((w >= 0).all() for _, w in found)


def test_spectral_term_of_the_rolling_laplacian():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 2))
    y = base[:, [0, 0, 0, 1, 1, 1]] + 0.4 * rng.standard_normal((60, 6))
    across = lambda eta: sum(-es.laplacian(w, 6)[:3, 3:].sum() for _, w in es.time_varying(y, 30, 10.0, k=2, eta=eta))
    assert across(5.0) < 0.6 * across(0.0)
    assert es.effective_rank(es.laplacian(np.ones(15), 6)) == 5 and es.effective_rank(np.zeros((3, 3))) == 0


def test_contiguous_start():
    sizes = [1 + np.count_nonzero(np.diff(es.contiguous_start(4000, 50, np.random.default_rng(s)))) for s in range(300)]
    assert 90 <= min(sizes) < 110 and 280 < max(sizes) <= 300  # 100 to 300 segments, of which some neighbours share a label
    assert len(es.contiguous_start(3, 2, np.random.default_rng(0))) == 3


def test_viterbi_against_all_paths():
    cost = np.random.default_rng(1).uniform(0, 5, (7, 3))
    price = lambda p: cost[np.arange(7), p].sum() + 1.5 * (np.diff(p) != 0).sum()
    best = min(price(np.array(p)) for p in itertools.product(range(3), repeat=7))
    assert price(es.viterbi(cost, 1.5)) == pytest.approx(best)


def test_toeplitz():
    groups, penalised = es.toeplitz_groups(2, 3)
    assert groups[0, 0] == groups[2, 2] == groups[4, 4] and groups[0, 3] == groups[2, 5] == groups[3, 0] and not penalised[1, 1]
    theta = es.random_theta(3, 3, np.random.default_rng(0), 0.3)
    x = np.random.default_rng(1).multivariate_normal(np.zeros(9), np.linalg.inv(theta), 6000)
    got = es.toeplitz_lasso(x.T @ x / len(x), 0.03, 3, 3)
    assert np.linalg.eigvalsh(got).min() > 0
    true, found = np.abs(theta) > 1e-4, np.abs(got) > 1e-2
    iu = np.triu_indices(9, 1)
    assert 2 * (true & found)[iu].sum() / (true[iu].sum() + found[iu].sum()) > 0.7


def test_segmentation_and_alignment():
    series, label = es.switching_series([1, 2, 1], 300, 5, 5, 3)
    x = es.stack(series, 5)
    assert x.shape == (len(series) - 4, 25) and (x[0, :5] == series[0]).all() and (x[0, -5:] == series[4]).all()
    _, found = min((es.segment_once(x, 2, 5, 5, 0.07, 60.0, s) for s in range(4)), key=lambda z: z[0])
    assert es.macro_f1(label[4:], found) > 0.85
    assert es.macro_f1(np.array([0, 0, 1, 1]), np.array([5, 5, 3, 3])) == 1.0
    assert (es.align(np.array([0, 0, 0]), np.array([1, 1, 2])) == [0, 0, 1]).all()
    gain = np.random.default_rng(2).integers(0, 50, (6, 6))
    best = max(itertools.permutations(range(6)), key=lambda p: sum(gain[p[c], c] for c in range(6)))
    got = es._assign(gain)
    assert sum(gain[got[c], c] for c in range(6)) == sum(gain[best[c], c] for c in range(6))


def test_baselines():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (60, 4)), rng.normal(8, 1, (60, 4))])
    true = np.repeat([0, 1], 60)
    for labels in (es.kmeans(x, 2, 0), es.mixture(x, 2, 0), es.mixture(x, 2, 0, spherical=True), es.neural_gas(x, 2, 0, 5)):
        assert es.macro_f1(true, labels) == 1.0
    few = np.r_[0:12, 60:72]
    assert es.macro_f1(true[few], es.dtw_kmeans(x[few], 2, 2, 0)) == 1.0 and es.macro_f1(true[few], es.dtw_kmeans(x[few], 2, 2, 0, gamma=1.0)) == 1.0
    a = np.array([[0.0], [1.0], [2.0]])
    assert es.dtw(a, a) == 0.0 and es.dtw(a, np.array([[0.0], [0.0], [1.0], [2.0]])) == 0.0


def test_warping():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal((5, 2)), rng.standard_normal((6, 2))
    cost = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    table = np.full((6, 7), np.inf)
    table[0, 0] = 0
    for i, j in itertools.product(range(5), range(6)):
        table[i + 1, j + 1] = cost[i, j] + min(table[i, j], table[i, j + 1], table[i + 1, j])
    assert es.dtw(a, b) == pytest.approx(table[5, 6]) and es.dtw(a, b, 1e-3) == pytest.approx(table[5, 6], abs=0.02)
    total, on = es._warped(cost[None], 0.7)
    for i, j in ((0, 0), (2, 3), (4, 5), (1, 4)):  # a cell's share of the soft path is the derivative by its cost
        more = cost.copy()
        more[i, j] += 1e-5
        assert (es._warped(more[None], 0.7)[0][0] - total[0]) / 1e-5 == pytest.approx(on[0, i, j], abs=1e-3)


def test_barycentres_follow_shifted_shapes():
    rng = np.random.default_rng(6)
    bump = lambda at: np.exp(-((np.arange(16) - at) ** 2) / 4.0)
    x = np.array([(1 if n < 15 else -1) * bump(rng.integers(5, 11)) + 0.02 * rng.standard_normal(16) for n in range(30)])
    true = np.repeat([0, 1], 15)
    for gamma in (0.0, 0.1):
        assert max(es.macro_f1(true, es.dtw_kmeans(x, 2, 1, s, gamma)) for s in range(3)) == 1.0
