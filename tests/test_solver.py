"""The solver kernel against plain dense versions and optimality conditions."""

import numpy as np
import pytest

from sitewise.solver.kernel import METHODS, Columns, Groups, Options, fit, scaled, shrink_groups, shrink_overlapping, shrink_q, softened


def problem(seed=0, m=60, n=120, groups=12):
    rng = np.random.default_rng(seed)
    dense = (rng.random((m, n)) < 0.3).astype(float)
    col, row = np.nonzero(dense.T)
    y = np.where(dense[:, 3] + dense[:, 15] - dense[:, 50] + 0.1 * rng.normal(size=m) > 0.5, 1.0, -1.0)
    size = n // groups
    return dense, Columns(m, n, col, row), y, Groups.ranges([size] * groups, [np.sqrt(size)] * groups)


def test_sparse_products():
    dense, a, y, _ = problem()
    x = np.random.default_rng(1).normal(size=dense.shape[1])
    assert np.allclose(a.dot(x), dense @ x) and np.allclose(a.tdot(y), dense.T @ y)
    keep = np.arange(0, 60, 2)
    assert np.allclose(a.rows(keep).dot(x), dense[keep] @ x)


def dense_fista(dense, y, groups, l1, l2, logistic, steps=100):
    """The schedule, written out for a dense matrix and disjoint groups."""
    m, n = dense.shape
    share = (y > 0).mean()
    x, c = np.zeros(n), np.log(share / (1 - share)) if logistic else 0.0
    xp, cp, a0, a1, big = x, c, 0.0, 1.0, 1.0 / m if logistic else 1.0
    for _ in range(steps):
        beta = (a0 - 1) / a1
        s, sc = x + beta * (x - xp), c + beta * (c - cp)
        z = dense @ s
        if logistic:
            fs = np.mean(np.log1p(np.exp(-y * (z + sc))))
            b = -y / m / (1 + np.exp(y * (z + sc)))
            g, gc = dense.T @ b, b.sum()
        else:
            g, gc = dense.T @ (z - y), 0.0
        xp, cp = x, c
        while True:
            c = sc - gc / big
            v = softened(s - g / big, l1 / big)
            x = np.concatenate([v[i:j] * max(0, 1 - l2 / big * w / np.linalg.norm(v[i:j])) if np.linalg.norm(v[i:j]) > 0 else v[i:j]
                                for i, j, w in zip(groups.start, groups.start[1:], groups.weight, strict=False)])
            d = x - s
            if logistic:
                fx = np.mean(np.log1p(np.exp(-y * (dense @ x + c))))
                r, left = (d @ d + (c - sc) ** 2) / 2, fx - fs - d @ g - (c - sc) * gc
            else:
                r, left = d @ d, ((dense @ d) ** 2).sum()
            if r <= 1e-20 or left <= r * big or abs(left - r * big) < 1e-12:
                break
            big = max(2 * big, left / r)
        a0, a1 = a1, (1 + np.sqrt(1 + 4 * a1 * a1)) / 2
        if r <= 1e-20:
            break
    return x, c


@pytest.mark.parametrize("method,logistic", [("sg_lasso", True), ("sg_lasso_leastr", False)])
def test_iterates_equal_the_dense_schedule(method, logistic):
    dense, a, y, groups = problem()
    found = fit(method, a, y, groups, 0.1, 0.1)
    x, c = dense_fista(dense, y, groups, found.l1, found.l2, logistic)
    assert np.allclose(found.x, x, atol=1e-8) and np.isclose(found.intercept, c, atol=1e-8)


@pytest.mark.parametrize("method", sorted(METHODS))
def test_penalties_near_their_largest_leave_nothing(method):
    _, a, y, groups = problem()
    heavy = fit(method, a, y, groups, 0.9999, 0.9999)
    light = fit(method, a, y, groups, 0.05, 0.05)
    assert np.count_nonzero(groups.norms(heavy.x)) <= 1 < np.count_nonzero(groups.norms(light.x))
    assert light.objective[-1] <= light.objective[0] + 1e-12


def test_optimality_after_many_steps():
    dense, a, y, groups = problem()
    found = fit("sg_lasso_leastr", a, y, groups, 0.2, 0.2, Options(max_iter=5000))
    grad = dense.T @ (dense @ found.x - y)
    for i, j, w in zip(groups.start, groups.start[1:], groups.weight, strict=False):
        x, g = found.x[i:j], grad[i:j]
        if not x.any():
            assert np.linalg.norm(softened(g, found.l1)) <= found.l2 * w + 1e-6
        else:
            on = x != 0
            assert np.allclose(g[on] + found.l1 * np.sign(x[on]) + found.l2 * w * x[on] / np.linalg.norm(x), 0, atol=1e-5)


def test_overlapping_step_equals_the_disjoint_one_and_does_not_expand():
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=40) * 3, rng.normal(size=40) * 3
    plain = Groups.ranges([8] * 5, [1.0] * 5)
    by = np.full(5, 2.5)
    assert np.allclose(shrink_overlapping(u, plain, by, 2000, 1e-12), shrink_groups(u, plain, by), atol=1e-5)
    over = Groups(np.concatenate([np.arange(0, 20), np.arange(10, 30), np.arange(25, 40)]), np.array([0, 20, 40, 55]), np.ones(3))
    step = lambda z: shrink_overlapping(z, over, np.full(3, 2.5), 2000, 1e-12)
    assert np.linalg.norm(step(u) - step(v)) <= np.linalg.norm(u - v) + 1e-6
    x = step(u)  # no better point nearby
    value = lambda z: 0.5 * ((z - u) ** 2).sum() + 2.5 * over.norms(z).sum()
    assert all(value(x) <= value(x + 1e-3 * rng.normal(size=40)) + 1e-9 for _ in range(50))


@pytest.mark.parametrize("q", [1.0, 1.5, 2.0, 3.0, 1e6])
def test_q_norm_step_is_a_minimum(q):
    rng = np.random.default_rng(3)
    v, groups = rng.normal(size=30) * 2, Groups.ranges([10] * 3, [1.0] * 3)
    x = shrink_q(v, groups, 1.2, q)
    value = lambda z: 0.5 * ((z - v) ** 2).sum() + 1.2 * groups.norms(z, q).sum()
    assert all(value(x) <= value(x + 1e-3 * rng.normal(size=30)) + 1e-7 for _ in range(50))


def test_dense_storage_gives_the_same_fit():
    _, a, y, groups = problem()
    one, two = (fit("sg_lasso", a, y, groups, 0.1, 0.1, Options(dense_bytes=limit)) for limit in (0, 1 << 30))
    assert np.allclose(one.x, two.x, atol=1e-10) and (one.x != 0).any()


def test_scaling_matches_its_definition():
    dense, a, y, groups = problem()
    share = (y > 0).mean()
    b = np.where(y > 0, 1 - share, -share) / len(y)
    grad = np.abs(dense.T @ b)
    l1, l2 = scaled(a, y, groups, 0.3, 0.4, True, np.full(len(y), 1 / len(y)), Options())
    assert np.isclose(l1, 0.3 * grad.max())
    assert np.isclose(l2, 0.4 * max(np.linalg.norm(np.maximum(grad[i:j] - l1, 0)) / w for i, j, w in zip(groups.start, groups.start[1:], groups.weight, strict=False)))


def test_intercept_can_be_switched_off_and_classes_weighed():
    _, a, y, groups = problem()
    assert fit("sg_lasso", a, y, groups, 0.1, 0.1, Options(intercept=False)).intercept == 0.0
    assert fit("sg_lasso", a, y, groups, 0.1, 0.1, Options(class_weights=(3.0, 1.0))).intercept > fit("sg_lasso", a, y, groups, 0.1, 0.1).intercept


@pytest.mark.parametrize("logistic", [True, False])
def test_column_tier_equals_the_kernel(spark, logistic):
    from sitewise.solver.distributed import solve_columns

    _, a, y, groups = problem(m=30, n=60, groups=12)
    rows = [(int(c), f"s{r}") for c, r in zip(a.col, a.row, strict=True)]
    cells = spark.createDataFrame(rows, "col_id long, sample string")
    indexed = spark.createDataFrame([(c, f"g{c // 5}") for c in range(60)], "col_id long, gene string")
    weights = spark.createDataFrame([(f"g{i}", float(groups.weight[i])) for i in range(12)], "gene string, weight double")
    options = Options(max_iter=8)
    table, state = solve_columns(cells, indexed, weights, [f"s{i}" for i in range(30)], y, 0.1, 0.1, logistic, options, blocks=3, every=4)
    want = fit("sg_lasso" if logistic else "sg_lasso_leastr", a, y, groups, 0.1, 0.1, options)
    got = np.zeros(60)
    for r in table.collect():
        got[r.col_id] = r.w
    assert np.allclose(got, want.x, atol=1e-8) and np.isclose(state, want.intercept, atol=1e-8)


def spread(spark, a, genes):
    """The cells of a matrix, and its columns with the number of their gene."""
    cells = spark.createDataFrame([(int(c), f"s{r}") for c, r in zip(a.col, a.row, strict=True)], "col_id long, sample string")
    return cells, spark.createDataFrame([(i, int(g)) for i, g in enumerate(genes)], "col_id long, atom int")


@pytest.mark.parametrize("logistic", [True, False])
def test_a_sweep_of_folds_grid_and_terms_equals_the_kernel(spark, logistic):
    """Genes of 1 to 40 columns over blocks of 9: most lie in several; all right-hand sides in two sweeps."""
    from sitewise.solver.sweep import Point, solve_sweep

    _, a, y, _ = problem(m=30, n=60, groups=12)
    sizes, names = np.array([40, 1, 14, 5]), [f"s{i}" for i in range(30)]
    cells, atoms = spread(spark, a, np.repeat(np.arange(4), sizes))
    terms = [np.sqrt(sizes) * t for t in (1, 2)]
    points = [Point(i, f, p, l1, l2) for p in (0, 1) for i, (l1, l2) in enumerate([(0.1, 0.1), (0.1, 0.4), (0.3, 0.2)]) for f in (-1, 0, 1)]
    options = Options(max_iter=7, class_weights=(2.0, 1.0) if logistic else None, ridge=0.01)
    found = solve_sweep(cells, atoms, 60, names, y, points, [Groups.ranges(np.ones(4, int), t) for t in terms], 4, 2, logistic, options, blocks=7, every=3, at_once=10)
    got = {k: np.zeros(61) for k in {(p.run, p.fold, p.penalty_idx) for p in points}}
    for r in found.collect():
        got[r.run, r.fold, r.penalty_idx][r.col_id] = r.w
    for p in points:
        keep = np.flatnonzero(np.arange(30) % 2 != p.fold)
        want = fit("sg_lasso" if logistic else "sg_lasso_leastr", a.rows(keep), y[keep], Groups.ranges(sizes, terms[p.penalty_idx]), p.l1, p.l2, options)
        assert np.allclose(got[p.run, p.fold, p.penalty_idx], [*want.x, want.intercept], atol=1e-8), p


@pytest.mark.parametrize("stop", [0, 3, 4])
def test_right_hand_sides_stop_on_their_own(spark, stop):
    from sitewise.solver.sweep import Point, solve_sweep

    _, a, y, _ = problem(m=30, n=60, groups=12)
    cells, atoms = spread(spark, a, np.arange(60) // 5)
    options = Options(max_iter=12, stop=stop, tol=5e-2)
    points = [Point(i, -1, 0, l, l) for i, l in enumerate((0.05, 0.5, 1.0))]
    groups = Groups.ranges(np.full(12, 5), np.full(12, 2.0))
    found = solve_sweep(cells, atoms, 60, [f"s{i}" for i in range(30)], y, points, [Groups.ranges(np.ones(12, int), np.full(12, 2.0))], 12, 0, True, options, blocks=3)
    got = np.zeros((3, 61))
    for r in found.collect():
        got[r.run, r.col_id] = r.w
    steps = []
    for i, p in enumerate(points):
        want = fit("sg_lasso", a, y, groups, p.l1, p.l2, options)
        steps.append(len(want.objective))
        assert np.allclose(got[i], [*want.x, want.intercept], atol=1e-8)
    assert stop or len(set(steps)) > 1


@pytest.mark.parametrize("logistic", [True, False])
def test_overlapping_groups_on_the_column_tier(spark, logistic):
    """Groups are unions of genes, so their step is one on a number per gene."""
    from sitewise.solver.sweep import Point, solve_sweep

    _, a, y, _ = problem(m=30, n=60, groups=12)
    gene = np.arange(60) // 10
    cells, atoms = spread(spark, a, gene)
    unions, weight = [(0, 1), (1, 2, 3), (3,), (4, 5), (0, 5)], np.array([2.0, 3.0, 1.0, 2.0, 2.5])
    ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
    small = Groups(np.concatenate([np.array(u) for u in unions]), ends([len(u) for u in unions]), weight)
    large = Groups(np.concatenate([np.flatnonzero(np.isin(gene, u)) for u in unions]), ends([10 * len(u) for u in unions]), weight)
    options = Options(max_iter=15, inner_tol=1e-9, inner_iter=2000)
    points = [Point(0, -1, 0, 0.1, 0.1), Point(1, -1, 0, 0.2, 0.5)]
    found = solve_sweep(cells, atoms, 60, [f"s{i}" for i in range(30)], y, points, [small], 6, 0, logistic, options, blocks=4)
    got = np.zeros((2, 61))
    for r in found.collect():
        got[r.run, r.col_id] = r.w
    for i, p in enumerate(points):
        want = fit("olsg_lasso_logisticr" if logistic else "olsg_lasso_leastr", a, y, large, p.l1, p.l2, options)
        assert want.x.any() and np.allclose(got[i], [*want.x, want.intercept], atol=1e-4)


@pytest.mark.parametrize("method", ["sg_lasso", "sg_lasso_leastr", "gl_logisticr"])
def test_fixed_steps_as_joins_equal_the_kernel(spark, method):
    from sitewise.solver.relational import fixed_steps

    dense, a, y, groups = problem(m=40, n=60, groups=12)
    rng = np.random.default_rng(5)
    value = rng.normal(size=len(a.col))
    value[:3] = 0
    a = Columns(40, 60, a.col, a.row, value)
    matrix = spark.createDataFrame([(int(c), f"g{c // 5:02d}", f"s{r}", float(v)) for c, r, v in zip(a.col, a.row, a.value, strict=True)], "col_id long, gene string, sample string, value double")
    target = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(y)] + [("other", 0.0)], "sample string, y double")
    logistic = not method.endswith("leastr")
    table, c = fixed_steps(matrix, target, 0.1, 0.2, 6, logistic, method == "gl_logisticr")
    trace = float((a.value**2).sum())
    big = (trace / 40 + 1) / 4 if logistic else trace
    want = fit(method, a, y, groups, 0.1, 0.2, Options(max_iter=6, lipschitz=big))
    got = np.zeros(60)
    for r in table.collect():
        got[r.col_id] = r.w
    assert want.x.any() and np.allclose(got, want.x, atol=1e-9) and np.isclose(c, want.intercept)


def test_registered_models_run_the_default_schedule():
    import inspect

    from sitewise.plans import catalogue_models

    source = inspect.getsource(catalogue_models)
    assert "max_iter" not in source and "(0.1, 0.2, 0.1)" not in source
