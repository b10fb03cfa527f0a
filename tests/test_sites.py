"""Alleles and features against a plain-Python encoder."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitewise.operators import scores as S
from sitewise.operators import sites as A

MICRO = {
    "tie": ["A", "A", "A", "C", "C", "C", "T"],
    "gaps": ["A", "-", "?", "X", "A", "C", "C"],
    "singletons": ["A", "C", "G", "T", "-", "-", "-"],
    "near": ["A", "A", "A", "C", "A", "A", "A"],
    "flat": ["A"] * 7,
    "long": ["ACGTA", "ACGTC", "ACCTC", "ATCTC", "ATCT-", "GTCTA", "GTC-A"],
}


def table(spark, data=MICRO):
    rows = [(g, f"s{i}", i, s) for g, seqs in data.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "gene string, sample string, seq_ord int, seq string")


def naive(data, min_minor=2, drop_major=False, skip_x=False):
    out = {}
    for gene, seqs in data.items():
        for pos in range(len(seqs[0])):
            n = Counter(s[pos] for s in seqs if s[pos] not in "-?" and not (skip_x and s[pos] == "X"))
            if len(n) < 2:
                continue
            major = min(n, key=lambda c: (-n[c], c))
            if sum(n.values()) - n[major] < min_minor:
                continue
            for c in sorted(n):
                if n[c] >= min_minor and not (drop_major and c == major):
                    out[gene, pos, c] = (n[c], sum(n.values()), major)
    return out


@pytest.mark.parametrize("options", [{}, {"min_minor": 1}, {"min_minor": 3}, {"drop_major": True}, {"skip_x": True, "min_minor": 1}])
def test_features_match_a_naive_encoder(spark, options):
    skip = options.get("skip_x", False)
    sites = A.ungapped(A.explode_sites(table(spark)), skip)
    found = A.features(A.allele_counts(sites), options.get("min_minor", 2), options.get("drop_major", False))
    assert {(r.gene, r.pos, r.allele): (r.n, r.total, r.major) for r in found.collect()} == naive(MICRO, **options)


def test_major_of_a_tie_is_the_lowest_character(spark):
    counts = A.allele_counts(A.explode_sites(table(spark, {"tie": MICRO["tie"]})))
    assert A.site_stats(counts).first().major == "A"


def test_paired_features_drop_singletons(spark):
    sites = A.ungapped(A.explode_sites(table(spark)), gaps=("-",))
    genes = {r.gene for r in A.paired_features(A.allele_counts(sites), 1).collect()}
    assert "singletons" not in genes and "near" not in genes and {"tie", "gaps", "long"} <= genes


def test_index_is_dense_and_ordered(spark):
    sites = A.ungapped(A.explode_sites(table(spark)))
    rows = A.feature_index(A.features(A.allele_counts(sites), 1)).collect()
    order = sorted(rows, key=lambda r: (r.gene, r.pos, r.allele))
    assert [r.col_id for r in order] == list(range(len(rows)))
    ranges = {r.gene: (r.first_col, r.last_col) for r in A.group_ranges(A.gene_sizes(A.features(A.allele_counts(sites), 1))).collect()}
    for gene, (a, b) in ranges.items():
        assert sorted(r.col_id + 1 for r in rows if r.gene == gene) == list(range(a, b + 1))


def test_cells_rebuild_the_matrix(spark):
    sites = A.ungapped(A.explode_sites(table(spark)))
    indexed = A.feature_index(A.features(A.allele_counts(sites)))
    label = {r.col_id: (r.gene, r.pos, r.allele) for r in indexed.collect()}
    got = {(label[r.col_id], r.sample) for r in A.cells(sites, indexed).collect()}
    want = {((g, p, c), f"s{i}") for g, p, c in naive(MICRO) for i, s in enumerate(MICRO[g]) if s[p] == c}
    assert got == want


def test_minor_columns(spark):
    sites = A.ungapped(A.explode_sites(table(spark)))
    feats = A.features(A.allele_counts(sites), 1)
    got = {(r.gene, r.sample): r.minor for r in A.minor_column(sites, feats).collect()}
    hits = defaultdict(int)
    for (g, p, c), (_, _, major) in naive(MICRO, 1).items():
        for i, s in enumerate(MICRO[g]):
            if s[p] == c and c != major:
                hits[g, f"s{i}"] = 1
    assert got == {k: hits.get(k, 0) for k in got} and set(hits) <= set(got)
    tiers = {(r.gene, r.tier, r.sample) for r in A.tiered_minor(sites, feats).collect()}
    assert {(g, s) for g, t, s in tiers if t == "0pct"} == set(hits)


def test_missing_and_repeated_sequences(spark):
    rows = [("g", "a", 0, "AC"), ("g", "a", 1, "GT"), ("h", "a", 0, "AC"), ("h", "b", 1, "AC")]
    aln = spark.createDataFrame(rows, "gene string, sample string, seq_ord int, seq string")
    hyp = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 0.0)], "sample string, y double")
    assert {tuple(r) for r in A.missing_sequences(aln, hyp).collect()} == {("g", "b")}
    assert {r.seq for r in A.last_of_each(aln).where("gene = 'g'").collect()} == {"GT"}


def test_gap_rules(spark):
    rows = [(s, p, c) for s, seq in {"a": "AA-A", "b": "AC-A", "c": "CG?C", "d": "CTGC", "o": "ACGT"}.items() for p, c in enumerate(seq)]
    sites = spark.createDataFrame([("g", s, p, c) for s, p, c in rows], "gene string, sample string, pos int, ch string")
    pairs = spark.createDataFrame([("a", 0, False), ("b", 0, True), ("c", 1, False), ("d", 1, True)], "sample string, pair int, control boolean")
    read = lambda t: {s: "".join(r.ch for r in sorted(t, key=lambda r: r.pos) if r.sample == s) for s in "abcdo"}
    assert read(A.gap_cancelled(sites, pairs).collect()) == {"a": "AA-A", "b": "AC-A", "c": "CG-C", "d": "CT-C", "o": "ACGT"}
    assert read(A.gap_cancelled(sites, pairs, partner_only=True, min_pairs=1).collect())["d"] == "CT-C"
    assert read(A.gap_cancelled(sites, pairs, tri_allelic=True).collect()) == {"a": "A--A", "b": "A--A", "c": "C--C", "d": "C--C", "o": "ACGT"}
    assert read(A.gap_cancelled(sites, pairs, outgroup="o").collect())["a"] == "----"
    assert {r.gene for r in A.with_all(sites, pairs).select("gene").distinct().collect()} == {"g"}


def test_score_levels(spark):
    """One pass gives what the three scores give apart; minor columns count for genes, runs without weights have 0."""
    rows = [(1, "g", 0, 0, 0.5), (1, "g", 0, 1, -0.25), (1, "g", 2**31 - 1, 2, 1.0), (1, "h", 3, 3, 0.0), (2, "h", 3, 3, 0.0), (2, "g", 0, 0, 0.0), (3, "h", 3, 3, -2.0)]
    weights = spark.createDataFrame(rows, "run int, gene string, pos int, col_id long, w double")
    levels = S.score_levels(weights, "run")
    for level, apart in (("all", S.total_score), ("gene", S.gene_scores), ("position", S.position_scores)):
        assert sorted(S.of_level(levels, level, "run").collect()) == sorted(apart(weights, "run").collect()), level
    assert S.score_levels(weights.limit(0), "run").isEmpty()


@pytest.mark.parametrize("rows", [200_000, 0])
def test_hot_alleles_are_not_shuffled(spark, monkeypatch, rows):
    """F7 F10 F14 F18: cells, their minor columns and weights meet few alleles without a shuffle by allele; many alleles give the same."""
    from sitewise.plans.train import evaluate
    from sitewise.sources import scratch

    monkeypatch.setattr(scratch, "BESIDE", rows)
    alignments = table(spark).select("gene", "sample", "seq")
    sites = A.ungapped(A.explode_sites(alignments))
    feats = A.features(A.allele_counts(sites))
    index = scratch.settled(A.feature_index(feats.unionByName(A.minor_features(feats), allowMissingColumns=True)), "index")
    weights = scratch.settled(index.withColumn("w", index.col_id + 1.0), "w").selectExpr("0 AS run", "gene", "pos", "col_id", "w")
    cells = A.cells(sites, index)
    one = spark.createDataFrame([(0, 0.5)], "run int, intercept double")
    found = {"cells": cells, "minor": A.minor_cells(sites, index), "sums": S.gene_contributions(cells, weights), "predicted": S.predictions(cells, weights, one, "run").select("sample", "prediction"),
             "evaluated": evaluate(alignments, index, weights, one)["predictions"].select("sample", "prediction")}
    if rows:
        for name in ("cells", "minor", "sums"):
            plan = found[name]._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan, name
    numbers = {(r.gene, r.pos, r.allele): r.col_id for r in index.collect()}
    major = {(g, p): m for (g, p, _), (_, _, m) in naive(MICRO).items()}
    of = {(numbers[g, p, c], f"s{i}", g, c != major[g, p]) for (g, p, c) in naive(MICRO) for i, s in enumerate(MICRO[g]) if s[p] == c}
    minor = {(next(n for (gene, _, a), n in numbers.items() if gene == g and a == "minor"), s) for _, s, g, m in of if m}
    assert sorted(map(tuple, found["cells"].collect())) == sorted((n, s) for n, s, _, _ in of)
    assert sorted(map(tuple, found["minor"].collect())) == sorted(minor)
    sums, every = defaultdict(float), defaultdict(float)
    for n, s, g, _ in of:
        sums[s, g] += n + 1
        every[s] += n + 1
    assert {(r["sample"], r.gene): r.score for r in found["sums"].collect()} == sums
    assert {r["sample"]: r.prediction for r in found["predicted"].collect()} == {s: v + 0.5 for s, v in every.items()}
    for n, s in minor:
        every[s] += n + 1
    assert {r["sample"]: r.prediction for r in found["evaluated"].collect()} == {s: v + 0.5 for s, v in every.items()}


def test_minor_column_of_whole_sequences(spark):
    """F16: pieces of sequences give what their characters give, without a join by character."""
    data = MICRO | {"wide": ["ACGT" * 3 + "é", "ACGT" * 3 + "é", "ACGA" * 3 + "x", "ACGA" * 3 + "x", "-?" * 3, "", "ACGT"]}
    alignments = table(spark, data).select("gene", "sample", "seq")
    sites = A.ungapped(A.explode_sites(alignments)).where("ch <> ''")
    feats = A.features(A.allele_counts(sites))
    rows = lambda df: sorted(map(tuple, df.select("gene", "sample", "minor").collect()))
    assert rows(A.minor_column_of(alignments, feats, 4)) == rows(A.minor_column(sites, feats))


def test_counts_of_slices_equal_counts_of_characters(spark, monkeypatch):
    """the job counts alleles with no row per character; long, empty, null and gapped sequences, any character."""
    rows = [("g", 1, "AC-G?T"), ("g", 2, "ACéG😀"), ("g", 1, ""), ("g", 1, None), (None, 3, "AA"), ("h", 1, "-?"), ("h", 2, "xY" * 70_000), ("g", 1, "AC-G?T")]
    found = spark.createDataFrame(rows, "gene string, kind long, seq string")
    key = lambda df: sorted(map(repr, df.collect()))
    want = A.allele_counts(A.ungapped(A.explode_sites(found.select("gene", "seq"))).where("ch <> ''"))
    for limit in (A.SLICE_CHARS, 7):
        monkeypatch.setattr(A, "SLICE_CHARS", limit)
        got = A.counted(found)
        assert got.dtypes == want.dtypes and key(got) == key(want)
    by = A.slice_counts(found).groupBy("gene", "kind", "pos", "ch").agg(F.sum("n").alias("n"))
    exploded = A.ungapped(A.explode_sites(found)).where("ch <> ''").groupBy("gene", "kind", "pos", "ch").agg(F.count(F.lit(1)).alias("n"))
    assert key(by) == key(exploded)
    assert "Generate" not in A.counted(found)._jdf.queryExecution().toString()


def test_counts_of_slices_by_class(spark, monkeypatch):
    """the job counts the classes of all folds with no row per character; slices of several genes at once, a class without rows."""
    rows = [("g", 0, "AC-G?T"), ("g", 2, "ACéG😀"), ("g", 1, ""), ("g", 1, None), (None, 3, "AA"), ("h", 1, "-?"), ("h", 2, "xY" * 70_000), ("g", 0, "AC-G?T"), ("h", 3, "xx")]
    found = spark.createDataFrame(rows, "gene string, class long, seq string").coalesce(1)
    key = lambda df: sorted(map(repr, df.collect()))
    sites = A.ungapped(A.explode_sites(found)).where("ch <> ''")
    want = sites.groupBy("gene", "pos", "ch").agg(*[F.count_if(F.col("class") == k).alias(f"n{k}") for k in range(5)])
    for limit, held in ((A.SLICE_CHARS, A.HELD_CHARS), (7, 50), (1000, 9)):
        monkeypatch.setattr(A, "SLICE_CHARS", limit)
        monkeypatch.setattr(A, "HELD_CHARS", held)
        got = A.class_counts(found, 5)
        assert got.dtypes == want.dtypes and key(got) == key(want)
    assert "Generate" not in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="classes"):
        A.class_counts(found, 0)
