"""Small tables with expected values worked out by hand."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkcells.functions.special import two_sided_p
from sparkcells.model import GroupKeyError
from sparkcells.model import Dataset
from sparkcells.operators import annotate, batch, corr, edges, genes, graph, hierarchy, labels, score, simple, stats, transfer

VALUES = {"c1": "A b1 2 2 0 1 1", "c2": "A b2 4 2 0 0 1", "c3": "B b1 0 4 0 2 1", "c4": "B b2 0 0 0 2 1", "c5": "C b1 0 0 0 0 1", "c6": "C b2 0 0 0 1 1"}


@pytest.fixture(scope="module")
def cells(spark):
    expr, obs = [], []
    for cell, line in VALUES.items():
        grp, own, *values = line.split()
        obs.append((cell, grp, own))
        expr += [(cell, f"g{k}", float(v)) for k, v in enumerate(values, 1)]
    return spark.createDataFrame(expr, "cell_id string, gene string, value double"), spark.createDataFrame(obs, "cell_id string, grp string, batch string")


@pytest.fixture(scope="module")
def grid(cells):
    return stats.grid(*cells, "grp").cache()


@pytest.fixture(scope="module")
def line(spark):
    return spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string")


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_grid(grid):
    found = table(grid, "grp", "gene")
    assert ("A", "g3") not in found  # never expressed: no rows are stored
    assert [found[g, "g1"]["mean"] for g in "ABC"] == [3, 0, 0]
    assert [found[g, "g2"]["frac_expr"] for g in "ABC"] == [1, 0.5, 0]
    assert [found[g, "g4"]["mean_norm"] for g in "ABC"] == [0.25, 1, 0.25]


def test_unknown_label(cells):
    with pytest.raises(GroupKeyError):
        stats.grid(*cells, "nope")


def test_simple(grid):
    pick = lambda mode, **o: {(r["grp"], r["gene"]): r["score"] for r in simple.find(grid, mode, min_count=0, **o).collect()}
    assert pick("single") == {("A", "g1"): 1.0, ("B", "g4"): 0.75}
    assert pick("negative") == {("C", "g2"): 1.0}
    assert pick("groups", targets=["A", "B"]) == {(None, "g2"): 1.0}
    assert pick("multiple") == {("A", "g1"): 1.0, ("B", "g4"): 0.75, ("A", "g2"): 1.0}
    assert simple.find(grid, "single").count() == 0  # ten expressing cells by default


def test_edges_labels_scores(grid, line):
    found = table(edges.fc_delta(grid, line), "start", "end", "gene")
    assert {k: (round(r["fc"], 6), r["delta"]) for k, r in found.items()} == {("B", "A", "g1"): (1001.0, 1.0), ("C", "B", "g2"): (1001.0, 1.0)}
    rises = edges.fc_delta(grid, line, max_mean_low=0.3)
    assert round(table(rises, "start", "end", "gene")["A", "B", "g4"]["fc"], 6) == 3.988048
    own = labels.label_levels(grid, rises)
    got = table(own, "grp", "gene")
    assert [[got[g, x]["l1"] for g in "ABC"] for x in ("g1", "g2", "g4")] == [[1, -1, 0], [0, 1, -1], [-1, 1, -1]]
    assert [[got[g, x]["l2"] for g in "ABC"] for x in ("g1", "g2", "g4")] == [[1, -1, -1], [1, 1, -1], [-1, 1, -1]]
    assert all(r["l3"] == r["l2"] for r in got.values())
    notes = labels.note(own, 3)
    features = score.gene_features(notes, rises)
    assert {r["gene"]: (r["n_low"], r["n_grey"], r["n_high"], r["n_edges"], r["gap"]) for r in features.collect()} == {"g1": (2, 0, 1, 1, 1.0), "g2": (1, 0, 2, 1, 1.0), "g4": (2, 0, 1, 2, 0.75)}
    dst = table(edges.dst_max(grid, line), "grp", "gene")
    assert (round(dst["A", "g2"]["max_fc"], 6), dst["A", "g2"]["max_delta"]) == (1.0, 0.0) and dst["C", "g1"]["max_fc"] == 0
    cover = table(edges.coverage(grid, line), "grp", "gene")
    assert [(cover["A", x]["rest"], cover["A", x]["neighbor"]) for x in ("g1", "g2", "g4")] == [(0, 0), (0.25, 0.5), (0.75, 1)]
    scored = table(score.scores(score.marker_inputs(grid, line, notes, features)), "grp", "gene")
    want = {("A", "g1"): (99.253584, 2.098612, 143.784578), ("A", "g2"): (0, 1.128765, 0), ("B", "g2"): (0, 1.128765, 0), ("B", "g4"): (0.623366, 1.836286, 0.844721)}
    assert {k: tuple(round(r[c], 6) for c in ("local_score", "global_score", "specific_weight")) for k, r in scored.items()} == want


def test_isolated_group_falls_back(grid, spark):
    one = spark.createDataFrame([("A", "B")], "a string, b string")
    found = table(edges.coverage(grid, one), "grp", "gene")["C", "g2"]
    assert found["neighbor"] == found["rest"] == 0.75


@pytest.mark.parametrize(("method", "lower", "upper"), [("sd", 0.15, 0.85), ("iqr", 0.124129, 0.875871), ("mad", 0.19826, 0.80174)])
def test_robust_sigma(spark, method, lower, upper):
    rows = spark.createDataFrame([(-1, x) for x in (0.0, 0.05, 0.1)] + [(1, x) for x in (0.9, 0.95, 1.0)], "side int, x double")
    found = table(labels.robust_sigma(rows, ["side"], "x", method), "side")
    assert round(found[-1,]["mean"] + 2 * found[-1,]["sigma"], 6) == lower
    assert round(found[1,]["mean"] - 2 * found[1,]["sigma"], 6) == upper


def test_top_k(spark):
    weights = [("A", "B", 0.9), ("A", "C", 0.5), ("A", "D", 0.1), ("B", "C", 0.4), ("C", "D", 0.3), ("B", "D", 0.0)]
    both = spark.createDataFrame(weights + [(b, a, w) for a, b, w in weights], "g1 string, g2 string, weight double")
    assert {tuple(r) for r in edges.undirected(edges.top_k_symmetric(both, 1)).collect()} == {("A", "B"), ("A", "C"), ("C", "D")}


def test_gene_network(spark):
    matrix = spark.createDataFrame([("gA", 0.0, 0.0), ("gB", 1.0, 0.0), ("gC", 0.0, 3.0), ("gD", 5.0, 5.0)], "gene string, x double, y double")
    found = {(r["a"], r["b"]): round(r["dist"], 6) for r in corr.gene_network(matrix, 1).collect()}
    assert found == {("gA", "gB"): 1.0, ("gA", "gC"): 3.0, ("gC", "gD"): 5.385165}


def test_metrics(spark):
    matrix = spark.createDataFrame([("a", 1.0, 2.0, 4.0), ("b", 2.0, 1.0, 0.0), ("z", 0.0, 0.0, 0.0)], "gene string, x double, y double, w double")
    x, y = np.array([1.0, 2.0, 4.0]), np.array([2.0, 1.0, 0.0])
    cosine = lambda p, q: 1 - p @ q / np.sqrt((p @ p) * (q @ q))
    want = {"euclidean": np.sqrt(18), "sqeuclidean": 18, "cityblock": 6, "chebyshev": 4, "cosine": cosine(x, y), "correlation": cosine(x - x.mean(), y - y.mean()), "canberra": 1 / 3 + 1 / 3 + 1, "braycurtis": 6 / 10}
    assert set(want) == set(corr.METRICS)
    for name, value in want.items():
        found = {(r["a"], r["b"]): r["dist"] for r in corr.gene_network(matrix, 2, name).collect()}
        assert abs(found["a", "b"] - value) < 1e-9, name
    assert found["a", "z"] == 1


def test_correlation(cells):
    found = table(corr.with_p(corr.one_vs_all(cells[0], 6, "g1"), 6, "g1"), "gene")
    assert (found["g1",]["corr"], found["g1",]["pval"]) == (1.0, 0.0)
    assert (round(found["g2",]["corr"], 6), round(found["g2",]["pval"], 6)) == (0.29277, 0.573392)
    assert round(found["g4",]["corr"], 6) == -0.534522
    assert found["g3",]["corr"] is None and found["g5",]["corr"] is None


def test_student():
    assert abs(two_sided_p(2.0, 10.0) - 0.073388) < 1e-6
    assert two_sided_p(np.inf, 3.0) == 0 and np.isnan(two_sided_p(1.0, 0.0))


def test_welch(spark):
    means = [("s", f"b{k}", "g", 9, v) for k, v in enumerate((1.0, 2.0, 3.0))] + [("e", f"b{k}", "g", 9, v) for k, v in enumerate((4.0, 5.0, 6.0, 8.0))]
    table_ = spark.createDataFrame(means, "grp string, batch string, gene string, n_cells int, mean double")
    rows = spark.createDataFrame([("s", "e", "g", 3.0, 0.5), ("s", "x", "g", 3.0, 0.5)], "start string, end string, gene string, fc double, delta double")
    found = table(batch.with_p(batch.welch(rows, table_)), "end")
    assert [round(found["e",][c], 6) for c in ("t", "df", "ttest_pval")] == [3.638034, 4.849596, 0.015752]
    assert found["x",]["ttest_pval"] is None
    assert batch.significant(batch.welch(rows, table_), 0.01).collect()[0]["end"] == "x"  # undefined is kept
    assert [(r["grp"], r["gene"], round(r["ttest_pval"], 6), r["ttest_n_start"], r["ttest_n_end"]) for r in batch.summary(batch.with_p(batch.welch(rows, table_))).collect()] == [("e", "g", 0.015752, 3, 4)]


def test_hierarchy(spark):
    levels = {1: "a a1 x", 2: "a a1 x", 3: "a a1 x", 4: "b b1 y", 5: "b b1 y", 6: "b b1 y", 7: "a b1 x", 8: "b a1 x", 9: "a a1 y", 10: "b b1 x"}
    obs = spark.createDataFrame([(str(k), *v.split()) for k, v in levels.items()], "cell_id string, l0 string, l1 string, l2 string")
    near = {1: (7, 9, 10), 4: (7, 9), 5: (7,), 7: (1, 4, 5, 8, 10), 8: (7, 10), 9: (1, 4), 10: (7, 8, 1)}
    knn = spark.createDataFrame([(str(a), str(b), 1.0) for a, own in near.items() for b in own], "src string, dst string, weight double")
    cells = hierarchy.reassign(hierarchy.paths(obs, ["l0", "l1", "l2"]), knn, 2)
    found = {r["cell_id"]: r["icls"] for r in hierarchy.cell_ids(cells, hierarchy.path_ids(cells)).collect()}
    assert [found[str(k)] for k in (7, 8, 9, 10)] == ["1", "0", "0", "0"]


def test_gene_filter(spark):
    sets = spark.createDataFrame([("Mito_RNA", "MT-CO1"), ("lncRNA", "XIST"), ("Transcription_Factor", "PAX6")], "category string, gene string")
    drop = genes.GeneFilter(sets, exclude=["Mito_RNA", "lncRNA"])
    assert not drop("MT-CO1") and drop("ACTB")
    keep = genes.GeneFilter(sets, include=["Transcription_Factor"])
    assert keep("PAX6") and not keep("ACTB")
    named = genes.GeneFilter(sets, exclude=["lncRNA"], name_exclude=["LINC", "LOC", "."])
    assert not named("LINC00115") and not named("AL035401.1")
    with pytest.raises(ValueError):
        genes.GeneFilter(sets, exclude=["nope"])


def test_annotator(spark):
    obs = spark.createDataFrame([(str(k), str(k % 4)) for k in range(8)], "cell_id string, cluster string")
    made = annotate.Annotator(obs, "label").update("cluster", "1, 2,3", "x").update("cluster", 1, "y", unknown_only=True)
    assert {r["label"]: r["n"] for r in made.summary().collect()} == {"x": 6, "unknown": 2}


def test_scaled_identity(cells):
    scaled = stats.scaled(*cells, "grp")
    a, b = (table(stats.grid(x, cells[1], "grp"), "grp", "gene") for x in (scaled, cells[0]))
    assert all(abs(a[k]["mean"] - b[k]["mean_norm"]) < 1e-12 for k in b)


def test_corr_store(spark, tmp_path):
    from sparkcells.sources import corr_db

    path = str(tmp_path / "store")
    corr_db.write(spark.createDataFrame([("B", "x", "y", 0.5), ("T", "x", "y", 1.0), ("T", "y", "x", 0.1)], "cell_type string, gene_a string, gene_b string, r double"), spark.createDataFrame([("B", 12), ("T", 30)], "cell_type string, n bigint"), path)
    found = table(corr_db.with_p(corr_db.load(spark, path, "x")), "condition")
    assert round(found["B",]["pval"], 4) == 0.0979 and found["T",]["pval"] < 1e-9
    with pytest.raises(ValueError):
        corr_db.load(spark, path, "z")
    with pytest.raises(ValueError):
        corr_db.load(spark, path, "x", ["nope"])


def test_streaming_sums(spark, cells, tmp_path):
    from sparkcells.streaming import incremental

    cells[0].write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell_id string, gene string, value double").parquet(str(tmp_path / "in"))
    job = incremental.to_memory(incremental.group_sums(stream, cells[1], "grp"), "sums").start()
    job.processAllAvailable()
    job.stop()
    found = {(r["grp"], r["gene"]): r["total"] for r in spark.table("sums").collect()}
    assert found["A", "g1"] == 6.0 and ("C", "g1") not in found


def test_range_of_negative_values(spark):
    bad = spark.createDataFrame([("c", "g", -1.0)], "cell_id string, gene string, value double")
    assert not stats.log1p_check(bad).first()["passes"]
    with pytest.raises(ValueError):
        stats.resolve_expression(bad)
    assert stats.resolve_expression(bad, bad.withColumn("value", F.lit(2.0)))[1] == "raw"


def test_value_check(spark):
    rows = lambda *x: spark.createDataFrame([("c", "g", float(v)) for v in x], "cell_id string, gene string, value double")
    with pytest.raises(ValueError):
        stats.value_check(rows(1, -1))
    with pytest.warns(UserWarning):
        stats.value_check(rows(1, 31))
    assert stats.value_check(rows(1, 2)).first()["passes"]


def test_node_cast(spark):
    whole = spark.createDataFrame([("1", "2"), ("10", "-3")], "a string, b string")
    mixed = spark.createDataFrame([("1", "x")], "a string, b string")
    assert {tuple(r) for r in edges.cast_nodes(whole, ["a", "b"]).collect()} == {(1, 2), (10, -3)}
    assert edges.cast_nodes(mixed, ["a", "b"]).first()["a"] == "1"


def test_raw_table(cells):
    data = Dataset(*cells)
    assert data.with_raw().raw is cells[0] and data.with_raw().with_raw().raw is cells[0]


def test_process_steps(spark):
    from sparkcells.plans import process

    counts = spark.createDataFrame([("c1", "a", 1.0), ("c1", "b", 3.0), ("c2", "a", 2.0)], "cell_id string, gene string, n double")
    total = {tuple(r) for r in process.process(counts, "n")["expr"].collect()}
    assert total == {("c1", "a", 2500.0), ("c1", "b", 7500.0), ("c2", "a", 10000.0)}
    log = process.process(counts, "l")
    assert {(r["cell_id"], r["gene"]): round(r["value"], 6) for r in log["raw"].collect()} == {("c1", "a"): 0.693147, ("c1", "b"): 1.386294, ("c2", "a"): 1.098612}
    assert process.process(counts, "")["expr"].agg(F.sum("value")).first()[0] == 6.0
    with pytest.raises(NotImplementedError):
        process.process(counts, "nu")


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)), 1)  # rounded: ties
    names = [f"c{k:03d}" for k in range(300)]
    coords = spark.createDataFrame(list(zip(names, x.tolist(), strict=True)), "cell_id string, vec array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for own in (True, False):
        if not own:
            np.fill_diagonal(far, np.inf)
        want = {(names[i], names[j]) for i in range(300) for j in np.lexsort((np.arange(300), far[i]))[:4]}
        assert {(r["src"], r["dst"]) for r in graph.knn(coords, 4, own, block=70).collect()} == want
        assert {(r["src"], r["dst"]) for r in graph.knn_probed(coords, 4, own, probes=99, cell=40, block=16).collect()} == want
    assert graph.recall(graph.knn_probed(coords, 4, False, probes=3, cell=40), coords, 4, False) > 0.7


def test_class_sample_of_a_large_class(spark):
    obs = spark.range(20_000).select(F.col("id").cast("string").alias("cell_id"), F.when(F.col("id") < 10, "rare").otherwise("common").alias("grp"))
    found = annotate.class_sample(obs, "grp", 100).toPandas()
    assert found.groupby("grp").size().to_dict() == {"common": 100, "rare": 100} and found[found["grp"] == "common"]["cell_id"].nunique() > 90
    assert set(found[found["grp"] == "rare"]["cell_id"]) <= {str(k) for k in range(10)}


def test_logistic_model(spark):
    rng = np.random.default_rng(2)
    expr = [(str(k), f"g{j}", float(v)) for k in range(300) for j, v in enumerate(rng.random(4) + (k % 3 == np.arange(4)) * 2)]
    cells = spark.createDataFrame([(str(k), f"t{k % 3}") for k in range(300)], "cell_id string, grp string")
    proba, truth, model = transfer.logistic_model(spark.createDataFrame(expr, "cell_id string, gene string, value double"), cells)
    n = truth.count()
    assert 30 < n < 90 and proba.count() == 3 * n and proba.join(truth, "cell_id").count() == 3 * n
    assert transfer.min_auc(proba, truth) > 0.95
    points = transfer.roc(proba, truth, "t0").orderBy("threshold").toPandas()
    assert points["tpr"].is_monotonic_decreasing and points["fpr"].is_monotonic_decreasing and points["tpr"].iloc[0] == points["fpr"].iloc[0] == 1
    assert model.names.labels == ["t0", "t1", "t2"]


def test_hierarchy_plan(spark, tmp_path):
    from sparkcells.plans import hierarchy as plan

    levels = {k: ("a", "a1", "x") if k < 6 else ("b", "b1", "y") for k in range(12)}
    obs = spark.createDataFrame([(str(k), *v, f"s{k % 2}") for k, v in levels.items()], "cell_id string, l0 string, l1 string, l2 string, batch string")
    expr = spark.createDataFrame([(str(k), "up" if k < 6 else "down", 1.0 + k % 2) for k in range(12)] + [(str(k), "both", 1.0) for k in range(12)], "cell_id string, gene string, value double")
    coords = spark.createDataFrame([(str(k), [float(k), 1.0]) for k in range(12)], "cell_id string, vec array<double>")
    data = Dataset(expr, obs, coords=coords)
    markers = {label: simple.ranked(simple.find(stats.grid(expr, obs, label), "single", min_count=0)) for label in ("l0", "l1", "l2")}
    found = plan.run(data, markers, batch="batch", gene_filter=genes.GeneFilter(spark.createDataFrame([], "category string, gene string"), name_exclude=["zz"]))
    assert found.min_cells == 1 and found.path("0") == [("g0", "a"), ("g1", "a1"), ("g2", "x")]
    assert [tuple(r) for r in found.compare("0").select("gene", "p0", "p1", "p2").collect()] == [("up", 1, 1, 1)]
    strips = {(r["level"], r["batch"]): (r["strip"], r["share"]) for r in found.compare_batch("0").collect()}
    assert strips == {(k, b): ((1, 1.0) if b == "s1" else (2, 0.5)) for k in range(3) for b in ("s0", "s1")}
    with pytest.raises(KeyError):
        found.compare("9")
    path = found.write_html(str(tmp_path / "page"))
    page = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert page.startswith("<!doctype html>") and "g0@a|g1@a1|g2@x" in page and "ROWS" not in page
    with pytest.raises(ValueError):
        plan.run(data, markers).compare_batch("0")


def test_strongest(spark):
    matrix = spark.createDataFrame([("a", 0.1, -0.9), ("b", 0.4, 0.4), ("c", 0.0, 0.1), ("d", -0.5, 0.5)], "gene string, x double, y double")
    assert [r["gene"] for r in corr.strongest(matrix, 2).collect()] == ["a", "d"]


def test_cut_tables(spark):
    from sparkcells import lineage

    table = lineage.cut(spark.range(5))
    assert table.count() == 5 and table._written.startswith(spark.sparkContext.getCheckpointDir())
    lineage.discard(table)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    assert lineage.few(spark.range(5), 3).count() == 5 and lineage.few(spark.range(3), 3).count() == 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_deals_no_copies(spark):
    """Points meet all others, but none is dealt more than once however many blocks there are."""
    coords = spark.range(300).select(F.col("id").cast("string").alias("cell_id"), F.array(F.rand(1), F.rand(2)).alias("vec")).localCheckpoint()
    found = graph.knn(coords, 3, block=16)
    assert "Generate" not in plan(found) and "CoGroups" not in plan(found)
    assert found.count() == 900


def test_knn_of_odd_points(spark):
    """Equal distances across blocks go by name; points alike, far values and empty tables."""
    rows = [(f"a{k:02d}", [1.0, 1.0]) for k in range(30)] + [(f"b{k}", [1e9 + k, -1e9]) for k in range(20)] + [("nan", [float("nan"), 0.0]), ("none", [])]
    coords = spark.createDataFrame(rows, "cell_id string, vec array<double>")
    found = {}
    for r in graph.knn(coords, 3, False, block=8).orderBy("place").collect():
        found.setdefault(r["src"], []).append((r["dst"], r["dist"]))
    assert len(found) == 50 and found["a00"] == [("a01", 0.0), ("a02", 0.0), ("a03", 0.0)] and found["a29"] == [("a00", 0.0), ("a01", 0.0), ("a02", 0.0)]
    assert found["b5"] == [("b4", 1.0), ("b6", 1.0), ("b3", 2.0)]
    asked = graph.knn(coords, 1, True, coords.where("cell_id = 'b7'"), 8).collect()
    assert [(r["src"], r["dst"], r["dist"]) for r in asked] == [("b7", "b7", 0.0)]
    assert graph.knn(coords.limit(0), 3).count() == 0
    # the neighbours of one point, in the order in which its blocks come
    names, x = pa.array(["q"]), np.array([[0.0, 0.0]])
    for order in ((0, 1), (1, 0)):
        own = graph._Nearest(names, x, 1, True)
        for k in order:
            own.meet(pa.array([("n1", "n0")[k]]), np.array([[(3.0, 4.0), (4.0, 3.0)][k]]))
        assert own.result().to_pydict() == {"src": ["q"], "dst": ["n0"], "dist": [5.0]}


def test_blocks_by_place():
    from sparkcells.operators import blocks

    x = np.random.default_rng(5).normal(size=(4000, 3))
    x[:1000] = x[0]  # points alike can't be split
    tree = blocks.Tree(x, 20)
    leaf = tree.leaf(x)
    assert np.bincount(leaf).tolist() == tree.sizes and sorted(tree.sizes)[-1] < 1400 and sorted(tree.sizes)[-2] <= 300
    place = blocks.spread(tree.leaf, np.array(tree.sizes), 200)(x, np.arange(4000))
    assert np.bincount(place).max() <= 300 and all(len(np.unique(leaf[place == k])) == 1 for k in np.unique(place))


def test_knn_probed_in_all_cells_deals_no_copies(spark):
    coords = spark.range(400).select(F.col("id").cast("string").alias("cell_id"), F.array(F.rand(1), F.rand(2)).alias("vec")).localCheckpoint()
    found = graph.knn_probed(coords, 3, probes=1 << 20, cell=10, block=32)
    assert "Generate" not in plan(found) and "CoGroups" not in plan(found)
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(r["src"], r["dst"]) for r in graph.knn(coords, 3).collect()}


def test_gene_gene_in_blocks(spark, monkeypatch):
    """Blocks of few genes give what numpy does; no pair of genes and cell is a row."""
    rng = np.random.default_rng(4)
    x = rng.random((60, 23)) * (rng.random((60, 23)) < 0.3)
    x[:, 5], x[:, 6] = 2.0, 0.0
    rows = [(str(c), f"g{k:02d}", float(x[c, k])) for c in range(60) for k in range(23) if x[c, k]]
    expr = spark.createDataFrame(rows, "cell_id string, gene string, value double")
    monkeypatch.setattr(corr, "GENES", 5)
    monkeypatch.setattr(corr, "ENTRIES", 60)
    monkeypatch.setattr(corr, "PRODUCTS", 50)
    found = corr.gene_gene(expr, 60, expr.select("gene"))
    assert "SortMergeJoin" not in plan(found) and "CartesianProduct" in plan(found)
    got = {(r["a"], r["b"]): r["corr"] for r in found.collect()}
    kept = [k for k in range(23) if k != 6]
    assert set(got) == {(f"g{a:02d}", f"g{b:02d}") for a in kept for b in kept if a < b}
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert r is None if 5 in (i, j) else abs(r - np.corrcoef(x[:, i], x[:, j])[0, 1]) < 1e-9
    some = {(r["a"], r["b"]): r["corr"] for r in corr.pruned(corr.gene_gene(expr, 60, expr.select("gene"), 0.1), 0.1).collect()}
    assert some == {k: r for k, r in got.items() if r is not None and r >= 0.1}


def test_documents_are_counted_in_small_parts(spark, monkeypatch):
    from sparkcells.sources import bindings

    folder = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, bindings.document_counts(spark, folder).collect()))
    want = rows()
    monkeypatch.setattr(bindings, "TEXT", 20_000, raising=False)
    size = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert bindings.document_counts(spark, folder).rdd.getNumPartitions() >= size / 20_000 > 8
    assert rows() == want


def test_components_of_scaled_values(spark):
    """The step s decides what components and neighbours are found; a gene of large values doesn't outweigh the others."""
    from sparkcells.plans import process

    rng = np.random.default_rng(6)
    x = rng.poisson(3.0, (40, 6)) * np.array([1, 1, 1, 1, 1, 400])
    counts = spark.createDataFrame([(f"c{c:02d}", f"g{k}", float(x[c, k])) for c in range(40) for k in range(6) if x[c, k]], "cell_id string, gene string, n double")
    found = process.process(counts, "lspk", n_pcs=3, n_neighbors=4)
    values = np.log1p(x)
    z = np.minimum((values - values.mean(0)) / values.std(0, ddof=1), 10)
    got = np.array([r["vec"] for r in found["pca"].orderBy("cell_id").collect()])
    axes = np.linalg.svd(z - z.mean(0))[2][:3]
    want = z @ axes.T
    assert np.allclose(got, want * np.sign((got * want).sum(0)))
    far = np.sqrt(((want[:, None] - want[None]) ** 2).sum(2))
    assert {(r["src"], r["dst"]) for r in found["knn"].collect()} == {(f"c{i:02d}", f"c{j:02d}") for i in range(40) for j in np.argsort(far[i], kind="stable")[:4]}
    plain = process.process(counts, "lp", n_pcs=3)["pca"].orderBy("cell_id").collect()
    assert not np.allclose(np.abs(np.array([r["vec"] for r in plain])), np.abs(got))


def test_pairs_of_a_row_are_in_one_task(spark):
    from sparkcells.lineage import cut
    from sparkcells.operators import blocks

    left, right = cut(spark.range(0, 6, 1, 2)), cut(spark.range(0, 40, 1, 8).withColumnRenamed("id", "other"))
    rows = blocks.paired(left, right, 3, "id").select("id", "other", F.spark_partition_id().alias("task")).collect()
    assert {(r["id"], r["other"]) for r in rows} == {(a, b) for a in range(6) for b in range(40)} and len(rows) == 240
    assert len({(r["id"], r["task"]) for r in rows}) == 6 and len({r["task"] for r in rows}) > 1
