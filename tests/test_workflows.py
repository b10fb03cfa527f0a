"""Training and the workflows on small hand-made inputs."""

from dataclasses import replace

import numpy as np
import pytest

from sitewise.functions import grids
from sitewise.functions.columns import MINOR_POS
from sitewise.plans.train import TrainOptions, evaluate, evaluate_numeric, skipped, train
from sitewise.plans import workflows as W
from sitewise.sources import newick
from sitewise.solver.kernel import Options


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    samples = [f"s{i:02d}" for i in range(24)]
    y = {s: 1.0 if i % 2 else -1.0 for i, s in enumerate(samples)}
    rows = []
    for g in range(4):
        for s in samples:
            seq = [rng.choice(list("ACGT")) for _ in range(12)]
            if g == 1:
                seq[3] = "K" if y[s] > 0 else "R"
            rows.append((f"gene{g}", s, "".join(seq)))
    aln = spark.createDataFrame(rows, "gene string, sample string, seq string").persist()
    hyp = spark.createDataFrame([(s, i, y[s]) for i, s in enumerate(samples)], "sample string, ord int, y double").persist()
    return aln, hyp


def options(**k):
    base = dict(lambdas=[(0, 0.1, 0.1), (1, 0.2, 0.2)], solver=Options(max_iter=60))
    return TrainOptions(**(base | k))


@pytest.mark.parametrize("method", ["sg_lasso", "sg_lasso_leastr", "gl_logisticr"])
def test_training_finds_the_planted_site(data, method):
    aln, hyp = data
    found = train(aln, hyp, options(method=method))
    best = found.position_scores.where("run = 1").orderBy("score", ascending=False).first()
    assert (best.gene, best.pos) == ("gene1", 3)
    assert found.medians["gene"].orderBy("median", ascending=False).first().gene == "gene1"
    metrics = evaluate(aln, found.encoded.features, found.weights.select("run", "col_id", "w"), found.intercepts, hyp)["metrics"]
    assert all(r.accuracy == 1.0 for r in metrics.collect())


def test_cross_validation_covers_every_sample(data):
    aln, hyp = data
    found = train(aln, hyp, options(folds=4, lambdas=[(0, 0.1, 0.1)]))
    rows = found.cv_predictions.collect()
    assert len(rows) == 24 and {r.fold for r in rows} == {0, 1, 2, 3}
    assert found.cv_metrics.first().accuracy >= 0.9


def test_overlapping_groups_and_class_balance(data, spark):
    aln, hyp = data
    groups = spark.createDataFrame([(0, "gene1"), (1, "gene0"), (1, "gene2"), (2, "gene2"), (2, "gene3")], "group int, gene string")
    found = train(aln, hyp, options(method="olsg_lasso_logisticr", groups=groups, lambdas=[(0, 0.2, 0.1)]))
    best = found.position_scores.orderBy("score", ascending=False).first()
    assert (best.gene, best.pos) == ("gene1", 3)
    uneven = hyp.where("ord < 20 OR y > 0")
    for kind in ("up", "down", "weighted"):
        assert train(aln, uneven, options(class_balance=kind, lambdas=[(0, 0.2, 0.1)])).weights.count() > 0


def test_numeric_tables(data, spark):
    _, hyp = data
    rng = np.random.default_rng(9)
    y = {r.sample: r.y for r in hyp.collect()}
    rows = [(g, s, f, f"col_{f}", float(rng.normal() + (3 * y[s] if (g, f) == ("b", 2) else 0))) for g in "abc" for s in y for f in range(5)]
    table = spark.createDataFrame(rows, "gene string, sample string, feature int, name string, value float")
    found = train(table, hyp, options(folds=3, lambdas=[(0, 0.1, 0.1)], precision="fp64"), numeric=True)
    best = found.position_scores.orderBy("score", ascending=False).first()
    assert (best.gene, best.pos) == ("b", 2) and found.cv_metrics.first().accuracy >= 0.9
    scored = evaluate_numeric(table, found.encoded.features, found.weights.select("run", "col_id", "w"), found.intercepts, hyp)
    assert scored["metrics"].first().accuracy == 1.0


def test_skip_ahead():
    grid = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (0.1, 0.2) for b in (0.1, 0.2, 0.3))]
    assert skipped(grid, {0: 5, 1: 1, 2: 0, 3: 3, 4: 1, 5: 0}, 1) == [2, 5]
    assert skipped(grid, {0: 1}, 1) == [1, 2, 3, 4, 5]
    assert skipped(list(reversed(grid)), {0: 1}, 1) == [] == skipped(grid, {0: 1}, 0)


def test_clades(data, spark):
    aln, _ = data
    leaves = [f"s{i:02d}" for i in range(24)]
    odd, even = leaves[1::2], leaves[0::2]
    tree = newick.parse(f"(({','.join(x + ':1' for x in odd)})Odd:1,({','.join(x + ':1' for x in even)})Even:1)Root;")
    out = W.clade_analysis(aln, tree, options(lambdas=[(0, 0.1, 0.1)]), clades=["Odd"])
    assert out["gene_scores"].orderBy("score", ascending=False).first().gene == "gene1"
    assert out["totals"].first().hss > 0 and out["predictions"].count() == 24


def test_dropout_rounds(data):
    aln, hyp = data
    dropped, curve = W.dropout_rounds(aln, hyp, options(lambdas=[(0, 0.1, 0.1)]), W.DropoutOptions(accuracy=0.95, max_iter=2, window=5))
    assert {r.label for r in dropped.where("round = 0").collect()} & {"gene1_3_K", "gene1_3_R"}
    assert curve.where("round = 0 AND k = 0").count() == 1


def test_adaptive(data):
    aln, hyp = data
    chosen, _ = W.adaptive_train(aln, hyp, options(lambdas=[(0, 0.1, 0.1)]), budget_columns=100)
    assert 0 < len(chosen) < 4
    assert W.chunks([("a", 5), ("b", 5), ("c", 5), ("d", 5)], 20) == [["a", "b"], ["c", "d"]]
    parts = W.chunks([(g, 6) for g in "abcde"], 20)
    assert parts == [["a"], ["b"], ["c"], ["d"], ["e"]] and W.chunk_pairs(3) == [(0, 1), (0, 2), (1, 2)]
    assert W.best_fitting([("a", 1.0, 9), ("b", 3.0, 8), ("c", 2.0, 5), ("d", 0.5, 2)], 10) == ["b", "d"]


def test_contrasts(data):
    aln, _ = data
    combos = W.contrasts("s01,s03\ns00\ns05\ns02\n")
    assert combos == [[("s01", "s00"), ("s05", "s02")], [("s03", "s00"), ("s05", "s02")]]
    with pytest.raises(ValueError):
        W.contrasts("a\nb\nc")
    out = W.contrast_scan(aln, combos[:1], options(lambdas=[(0, 0.1, 0.1)], group_penalty="median"), W.ContrastOptions(flipped=True))
    ranks = {(r.model, r.gene): r for r in out["gene_ranks"].collect()}
    assert any(model == "observed" for model, _ in ranks) and all(r.best_rank >= 1 for r in ranks.values())
    sps = {r["sample"]: r.sps for r in out["species_predictions"].where("model = 'observed'").collect()}
    assert len(sps) == 24 and sps["s01"] > sps["s00"]
    assert W.response_pairs("a,1\nb,-1\nc,0\nd,1\ne,-1\n") == [("a", "b"), ("d", "e")]
    assert W.columns_that_fit(100 * 2**20, 100, 4) == int((70 * 2**20 - 4000) / (400 + 32 + 160))


@pytest.mark.parametrize("how", [{}, {"partner_only": True, "tri_allelic": True}, {"whole_genes": True, "outgroup": "s07"}, {"cancel": False}])
def test_contrasts_side_by_side(spark, how):
    """Several contrasts in one plan give what each gives alone, and on the other tiers; null models included."""
    rng = np.random.default_rng(11)
    rows = [(f"gene{g}", f"s{i:02d}", "".join(rng.choice(list("AAACCG-"), 14))) for g in range(5) for i in range(10) if g != 2 or i % 4]
    aln = spark.createDataFrame(rows, "gene string, sample string, seq string").persist()
    combos = W.contrasts("s01,s03\ns00\ns05\ns02,s04\ns09\ns08\n")
    o = options(lambdas=[(0, 0.05, 0.05), (1, 0.1, 0.2)], group_penalty="linear", penalty_range=(1, 2, 1), min_minor=1, precision="fp64", solver=Options(max_iter=10))
    key = {"combo_scores": ("model", "replicate", "combo", "gene"), "selected_sites": ("model", "replicate", "combo", "gene", "pos"), "species_predictions": ("model", "replicate", "combo", "sample"),
           "weights": ("model", "replicate", "combo", "run", "gene", "pos", "allele")}
    value = {"combo_scores": "score", "selected_sites": "score", "species_predictions": "sps", "weights": "w"}

    def scan(which, o=o, **more):
        found = W.contrast_scan(aln, which, o, W.ContrastOptions(flipped=True, randomised=2, **(how | more)))
        return {n: {tuple(r[c] for c in k): r[value[n]] for r in found[n].collect()} for n, k in key.items()}

    def same(a, b):
        for n in key:
            assert a[n] and a[n].keys() == b[n].keys() and all(np.isclose(a[n][k], b[n][k], atol=1e-8) for k in a[n]), n

    whole = scan(combos[:3])
    assert {k[0] for k in whole["combo_scores"]} == {"observed", "flipped", "randomised"}
    alone = scan(combos[1:2])
    same({n: {k: v for k, v in whole[n].items() if k[2] == 1} for n in key}, {n: {(*k[:2], 1, *k[3:]): v for k, v in alone[n].items()} for n in key})
    if not how:
        same(alone, scan(combos[1:2], task_cells=0))
        same(alone, scan(combos[1:2], replace(o, max_entries=1), task_cells=0))


def test_trees():
    t = newick.parse("((a:1,b:2)X:0.5,('c d':x,(e,f)):1)r;")
    assert t.leaves() == ["a", "b", "c d", "e", "f"] and newick.find(t, "X").length == 0.5
    assert newick.name_clades(t, 2, 3) == ["Clade_1", "Clade_2"]
    assert newick.total_length(t) == 4.5 and dict(newick.leaf_distances(t))["b"] == 2.5
    assert newick.clade_hypothesis(t, "X", "none") == [("a", 1), ("b", 1), ("c d", -1), ("e", -1), ("f", -1)]
    assert newick.clade_hypothesis(t, "X", "phylo") == [("a", 1), ("b", 1), ("c d", -1), ("e", -1)]
    assert newick.clade_hypothesis(t, "Clade_2", "phylo_1") == [("e", 1), ("f", 1), ("c d", -1)]
    with pytest.raises(KeyError):
        newick.clade_hypothesis(t, "none")


def test_grids():
    assert grids.lambda_grid((0.1, 0.3, 0.1), (0.1, 0.1, 0.1)) == [(0, 0.1, 0.1), (1, 0.2, 0.1), (2, 0.3, 0.1)]
    logs = grids.sweep(0.1, 0.5, 0.1, logspace=True)
    assert len(logs) == 4 and np.isclose(logs[-1], 0.4) and np.allclose(np.diff(np.log(logs)), np.diff(np.log(logs))[0])
    with pytest.raises(ValueError):
        grids.lambda_grid((0.5, 1.0, 0.5), (0.1, 0.2, 0.1))
    assert grids.parse_lambda_file("# c\n0.1 0.2\n\n0.3 0.4 # d\n") == [(0, 0.1, 0.2), (1, 0.3, 0.4)]
    assert grids.penalty_terms("median", var_counts=[0, 3, 6]) == [4.0] and grids.penalty_terms("linear", 1, 2, 0.5) == [1.0, 1.5, 2.0]
    assert grids.group_weights("median", 4.0, [9], [3]) == [7.0] and grids.group_weights("std", 1, [9], [3]) == [3.0]
    assert np.allclose(grids.log_grid(0.01, 1, 3), [0.01, 0.1, 1])


def test_penalty_terms_stay_apart(data):
    aln, hyp = data
    found = train(aln, hyp, options(group_penalty="linear", penalty_range=(1, 3, 1), min_groups=1))
    assert {r.penalty_idx for r in found.weights.select("penalty_idx").distinct().collect()} <= {0, 1, 2}
    scored = evaluate(aln, found.encoded.features, found.weights.select("penalty_idx", "run", "col_id", "w"), found.intercepts, hyp)
    runs = found.intercepts.count()
    assert scored["predictions"].count() == 24 * runs and scored["metrics"].count() == runs
    w = {(r.penalty_idx, r.run, r.col_id): r.w for r in found.weights.collect()}
    cells = {}
    for r in found.encoded.cells.collect():
        cells.setdefault(r["sample"], []).append(r.col_id)
    base = {(r.penalty_idx, r.run): r.intercept for r in found.intercepts.collect()}
    for r in scored["predictions"].collect():
        key = (r.penalty_idx, r.run)
        assert np.isclose(r.prediction, base[key] + sum(w.get((*key, c), 0.0) for c in cells[r["sample"]]))
    assert {"penalty_idx"} <= set(found.medians["base"].columns)
    runs = W.aggregate_runs(found, aln, hyp, 100.0, 0.0)
    assert runs["predictions"].groupBy("penalty_idx").count().where("count <> 24").isEmpty()


def test_the_last_of_repeated_samples_counts(data, spark):
    aln, hyp = data
    ordered = aln.selectExpr("gene", "sample", "0 AS seq_ord", "seq")
    junk = ordered.where("sample < 's06'").selectExpr("gene", "sample", "-1 AS seq_ord", "repeat('Z', 12) AS seq")
    one, two = (train(a, hyp, options(lambdas=[(0, 0.1, 0.1)])) for a in (ordered, ordered.unionByName(junk)))
    assert sorted(map(tuple, one.encoded.features.collect())) == sorted(map(tuple, two.encoded.features.collect()))
    assert two.encoded.features.agg({"total": "max"}).first()[0] == 24
    model = (one.encoded.features, one.weights.select("run", "col_id", "w"), one.intercepts, hyp)
    assert sorted(map(tuple, evaluate(ordered, *model)["predictions"].collect())) == sorted(map(tuple, evaluate(ordered.unionByName(junk), *model)["predictions"].collect()))


def test_folds_of_repeated_samples(data):
    aln, hyp = data
    found = train(aln, hyp.where("ord < 20 OR y > 0"), options(folds=4, lambdas=[(0, 0.1, 0.1)], class_balance="up"))
    w, base, cells = {}, {}, {}
    for r in found.fold_weights.collect():
        (base if r.col_id < 0 else w)[r.fold, r.col_id] = r.w
    for r in found.encoded.cells.collect():
        cells.setdefault(r["sample"], []).append(r.col_id)
    rows = found.cv_predictions.collect()
    assert len(rows) > len({r["sample"] for r in rows}) and len({(r["sample"], r.fold) for r in rows}) == len(rows)
    for r in rows:
        assert np.isclose(r.prediction, base[r.fold, -1] + sum(w.get((r.fold, c), 0.0) for c in cells[r["sample"]]))


@pytest.mark.parametrize("method", ["sg_lasso", "sg_lasso_leastr", "gl_logisticr"])
def test_large_problems_go_to_the_column_tier(data, method):
    aln, hyp = data
    o = dict(method=method, lambdas=[(0, 0.1, 0.1)], precision="fp64", solver=Options(max_iter=12), folds=2 if method == "sg_lasso" else 0)
    small, large = train(aln, hyp, options(**o)), train(aln, hyp, options(**o, max_entries=10))
    one, two = ({(r.run, r.col_id): r.w for r in t.weights.collect()} for t in (small, large))
    assert one and one.keys() == two.keys() and all(np.isclose(one[k], two[k], atol=1e-8) for k in one)
    assert np.isclose(small.intercepts.first().intercept, large.intercepts.first().intercept)
    if o["folds"]:
        a, b = ({(r["sample"], r.fold): r.prediction for r in t.cv_predictions.collect()} for t in (small, large))
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=1e-8) for k in a)


@pytest.mark.parametrize("method", ["olsg_lasso_leastr", "olsg_lasso_logisticr", "gl_logisticr"])
def test_large_overlapping_and_balanced_problems(data, spark, method):
    """Overlapping groups of genes, up-sampling, folds, and a field of columns, beyond ``max_entries``."""
    aln, hyp = data
    overlapping = spark.createDataFrame([(0, "gene0"), (0, "gene1"), (1, "gene1"), (1, "gene2"), (2, "gene3")], "group int, gene string")
    few = hyp.where("y < 0 OR ord % 3 > 0")
    tight = Options(max_iter=8, inner_iter=2000, inner_tol=1e-9)
    o = dict(method=method, lambdas=[(0, 0.1, 0.1), (1, 0.1, 0.3)], precision="fp64", solver=tight, class_balance="up", folds=2)
    if method.startswith("olsg"):
        o["groups"] = overlapping
        n = train(aln, few, options(**o)).encoded
        start = np.cumsum([0, *(g[1] for g in n.genes)])
        if method.endswith("logisticr"):  # the same groups as columns, named in another order
            o["group_columns"] = [int(c) for group in ((1, 0), (2, 1), (3,)) for g in group for c in np.arange(start[g], start[g + 1])[::-1]]
    small, large = train(aln, few, options(**o)), train(aln, few, options(**o, max_entries=10))
    one, two = ({(r.run, r.col_id): r.w for r in t.weights.collect()} for t in (small, large))
    assert one and all(np.isclose(one.get(k, 0.0), two.get(k, 0.0), atol=1e-4) for k in one.keys() | two.keys())
    a, b = ({(r.run, r["sample"], r.fold): r.prediction for r in t.cv_predictions.collect()} for t in (small, large))
    assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=1e-3) for k in a)


def test_points_that_are_passed_over_are_not_solved(data, monkeypatch):
    from sitewise.plans import train as module

    aln, hyp = data
    lambdas = [(3 * i + j, 0.1 + 0.2 * i, 0.1 + 0.4 * j) for i in range(3) for j in range(3)]
    o = dict(lambdas=lambdas, precision="fp64", solver=Options(max_iter=10))
    whole = train(aln, hyp, options(**o))
    counts = {r.run: r.n for r in whole.weights.groupBy("run").agg({"gene": "count"}).selectExpr("run", "`count(gene)` AS n").collect()}
    genes = {i: len({r.gene for r in whole.weights.where(f"run = {i}").select("gene").distinct().collect()}) if i in counts else 0 for i in range(9)}
    want = set(module.skipped(lambdas, genes, 2))
    solved = []
    plain = module.solve_grid
    monkeypatch.setattr(module, "solve_grid", lambda grid, *a: (solved.extend(r.run for r in grid.collect()), plain(grid, *a))[1])
    found = train(aln, hyp, options(**o, min_groups=2))
    assert want and {run for _, run in found.pruned} == want and {r.run for r in found.weights.select("run").distinct().collect()} == set(counts) - want
    last = [i for i in want if lambdas[i][2] > lambdas[0][2]]  # those of the smallest second penalty go together
    assert len(solved) < 9 and not set(last) & set(solved)
    large = train(aln, hyp, options(**o, min_groups=2, max_entries=10))
    one, two = ({(r.run, r.col_id): r.w for r in t.weights.collect()} for t in (found, large))
    assert one.keys() == two.keys() and all(np.isclose(one[k], two[k], atol=1e-8) for k in one)


def test_columns_of_minor_alleles(data):
    aln, hyp = data
    plain = train(aln, hyp, options(lambdas=[(0, 0.1, 0.1)]))
    for kind, names in (("minor", {"minor"}), ("tiered", {"tminor_0pct", "tminor_0.1pct", "tminor_1pct", "tminor_5pct"})):
        found = train(aln, hyp, options(lambdas=[(0, 0.1, 0.1)], minor=kind))
        own = found.encoded.features.where(f"pos = {MINOR_POS}").collect()
        assert {(r.gene, r.allele) for r in own} == {(f"gene{g}", n) for g in range(4) for n in names}
        assert found.encoded.n == plain.encoded.n + 4 * len(names) and found.position_scores.where(f"pos = {MINOR_POS}").isEmpty()
        held = found.encoded.cells.join(found.encoded.features.where(f"pos = {MINOR_POS}"), "col_id")
        feats = {(r.gene, r.pos, r.allele) for r in plain.encoded.features.where("allele <> major").collect()}
        seqs = {(r.gene, r["sample"]): r.seq for r in aln.collect()}
        want = {(g, s) for (g, s), q in seqs.items() if any((g, p, c) in feats for p, c in enumerate(q))}
        assert {(r.gene, r["sample"]) for r in held.where("allele IN ('minor', 'tminor_0pct')").collect()} == want
        scored = evaluate(aln, found.encoded.features, found.weights.select("run", "col_id", "w"), found.intercepts, hyp)
        w = {r.col_id: r.w for r in found.weights.collect()}
        base, sums = found.intercepts.first().intercept, {}
        for r in found.encoded.cells.collect():
            sums[r["sample"]] = sums.get(r["sample"], 0.0) + w.get(r.col_id, 0.0)
        assert all(np.isclose(r.prediction, base + sums.get(r["sample"], 0.0)) for r in scored["predictions"].collect())


def test_a_field_names_the_columns_of_groups(data, spark):
    aln, hyp = data
    groups = spark.createDataFrame([(0, "gene0"), (1, "gene1")], "group int, gene string")
    sizes = dict(r[:2] for r in train(aln, hyp, options(lambdas=[(0, 0.1, 0.1)])).encoded.genes)
    both = list(range(sizes["gene0"] + sizes["gene1"]))
    o = dict(method="olsg_lasso_leastr", groups=groups, lambdas=[(0, 0.2, 0.1)], precision="fp64")
    one, two = train(aln, hyp, options(**o)), train(aln, hyp, options(**o, group_columns=both))
    assert sorted(map(tuple, one.weights.collect())) == sorted(map(tuple, two.weights.collect()))
    with pytest.raises(ValueError):
        train(aln, hyp, options(**o, group_columns=both[:-1]))
