"""Golden values and rules of the operators that SQL does not cover."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.functions import text as t
from cellmill.operators import drafting as dr
from cellmill.operators import features as fe
from cellmill.operators import gather as ga
from cellmill.operators import harmonize as ha
from cellmill.operators import hvg as hv
from cellmill.operators import loaders as lo
from cellmill.operators import materialize as ma
from cellmill.operators import pairs as pa
from cellmill.operators import pca as pc
from cellmill.operators import sampling as sa
from cellmill.operators import stats as st
from cellmill.operators import welch as we
from cellmill.operators.validate import validate
from cellmill.plans.views import Corpus
from cellmill.sources import ledger as le
from cellmill.sources import store as so
from cellmill.streaming.moments import dataset_batches


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "make", "want"),
    [
        ("100nM", t.dose_parse, "100"), ("1.5 μM", t.dose_parse, "1.5"), ("1.5 μM", t.dose_unit, "um"), ("mg/kg", t.dose_parse, "NA"), ("7", t.dose_parse, "7"), ("junk", t.dose_parse, "NA"), ("1e5", t.dose_parse, "1e5"), ("1_000", t.dose_parse, "1_000"),
        ("24h", t.timepoint_parse, "24"), ("48 hr", t.timepoint_unit, "h"), ("3 weeks", t.timepoint_unit, "weeks"), (None, t.timepoint_unit, "NA"), ("ENSG0001.12", t.strip_ensembl_version, "ENSG0001"), ("sym.12", t.strip_ensembl_version, "sym.12"),
        (" 0 ", t.normalize_boolean, "false"), ("Yes", t.normalize_boolean, "true"), ("maybe", t.normalize_boolean, "maybe"), ("KO_A_sg1", t.strip_guide_suffix, "KO_A"), ("KO-g12", t.strip_guide_suffix, "KO"), ("KO", t.strip_guide_suffix, "KO"),
        ("k-562 b_cell it's", lambda c: t.normalize_case(c, "title"), "K-562 B_Cell It'S"), ("a+b+c", lambda c: t.split_on_delimiter(c, "+", 1), "b"), ("a$b", lambda c: t.regex_sub(c, r"(a)\$", r"\1$-"), "a$-b"), (" x\t", t.strip_whitespace, "x"),
        ("n/a", t.is_null_like, True), ("n/a", t.read_null, "n/a"), ("NA", t.read_null, None), ("µμ", t.fold_micro, "uu"), ("ab", lambda c: t.strip_suffix(c, ""), "ab"),
    ],
)
def test_transforms(spark, value, make, want):
    assert one(spark, value, make) == want


def test_pipeline_rules(spark):
    said = []
    assert one(spark, "x", lambda c: t.pipeline(c, [("nope", {}), ("normalize_case", {"mode": "upper"})], warn=said.append)) == "X" and said
    assert one(spark, "x", lambda c: t.pipeline(c, [("normalize_case", {"mode": "odd"})], fallback="f")) == "f"
    t.register("twice", lambda c: F.concat(c, c))
    assert one(spark, "x", lambda c: t.pipeline(c, [("twice", {})])) == "xx"


def test_strategies_check():
    with pytest.raises(ValueError):
        ha.Mapping("a", "odd").check()
    with pytest.raises(ValueError):
        ha.Mapping("a", "join").check()
    with pytest.raises(ValueError):
        ha.check_schema([ha.Mapping("a", "literal"), ha.Mapping("a", "literal")])
    assert "dose" in ha.missing_required(["cell_id"])


def test_coalesce_needs_its_columns(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(KeyError):
        ha.obs_column(df, ha.Mapping("m", "coalesce", sources=("a", "b")))
    with pytest.warns(UserWarning):
        assert df.select(ha.obs_column(df, ha.Mapping("m", source="b", fallback="f")).alias("m")).first()["m"] == "f"


def test_drafting():
    mappings, notes = dr.draft_obs(["guide_1", "batch", "celltype", "sex"], {"tissue": "organ_name"})
    by = {m.name: m for m in mappings}
    assert by["perturb_label"].source == "guide_1" and by["cell_context"].source == "celltype" and by["tissue"].source == "organ_name"
    assert by["species"].literal == "human" and by["dose"].strategy == "null" and "dose" in notes and by["sex"].source == "sex"
    ha.check_schema(mappings)


def test_student_tail():
    assert we.student_tail(np.array([12.706204736432095]), np.array([1.0]))[0] == pytest.approx(0.05, rel=1e-10)
    assert we.student_tail(np.array([2.2281388519649385]), np.array([10.0]))[0] == pytest.approx(0.05, rel=1e-9)
    assert we.student_tail(np.array([1.959963984540054]), np.array([1e9]))[0] == pytest.approx(0.05, rel=1e-6)
    x, df = np.array([0.7, 3.0]), np.array([2.0, 2.0])
    assert np.allclose(we.student_tail(x, df), 1 - x / np.sqrt(2 + x * x), rtol=1e-12)
    got = we.student_tail(np.array([np.inf, np.nan, 0.0]), np.array([5.0, 5.0, 5.0]))
    assert got[0] == 0 and math.isnan(got[1]) and got[2] == pytest.approx(1)


def test_bins_follow_equal_width_cuts(spark):
    pd = pytest.importorskip("pandas")
    for values in (list(np.random.default_rng(1).gamma(2, 1, 400)), [0.0, 0.5, 1.0], [2.0] * 4, [0.0] * 3):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = [r["b"] for r in df.select(hv.bin_of(F.col("x"), F.lit(float(min(values))), F.lit(float(max(values)))).alias("b")).collect()]
        assert got == pd.cut(pd.Series(values), bins=20, labels=False).tolist()


def test_hvg_ties_go_by_origin(spark):
    cells = spark.createDataFrame([(0, i) for i in range(4)], "dataset_index int, global_row_index long")
    coo = spark.createDataFrame([(0, r, g, 1 + r) for r in range(3) for g in range(3)], "dataset_index int, global_row_index long, origin_index int, count int")
    var = spark.createDataFrame([(0, g, f"g{g}", g) for g in range(3)], "dataset_index int, origin_index int, gene_id string, global_feature_id long")
    ledger = spark.createDataFrame([(0, "d")], "dataset_index int, dataset_id string")
    rows = sorted(hv.hvg(coo, cells, var, ledger, n_hvg=2).select("origin_index", "hvg_rank", "is_hvg").collect())
    assert [tuple(r) for r in rows] == [(0, 1, True), (1, 2, True), (2, 3, False)]
    with pytest.raises(ValueError):
        hv.hvg(coo, cells, var, ledger, n_hvg=0)


def test_stats_against_dense(spark, sf):
    c = Corpus(spark, sf)
    coo, obs = c.coo.toPandas(), c.obs.toPandas()
    d = obs[obs.dataset_index == 0].sort_values("global_row_index")
    n_genes = c.var.where("dataset_index = 0").count()
    dense = np.zeros((len(d), n_genes))
    e = coo[coo.dataset_index == 0]
    dense[e.global_row_index - d.global_row_index.min(), e.origin_index] = e["count"]
    x = np.log1p(dense / d.size_factor.to_numpy()[:, None])
    got = st.lognorm_stats(c.coo, c.obs, c.var, c.ledger).where("dataset_index = 0").join(c.var.select("dataset_index", "gene_id", "origin_index"), ["dataset_index", "gene_id"]).orderBy("origin_index").toPandas()
    assert np.allclose(got.mean_lognorm, x.mean(axis=0)) and np.allclose(got.var_lognorm, x.var(axis=0)) and (got.n_nonzero == (x > 0).sum(axis=0)).all()

    coo, obs = c.coo.where("dataset_index = 0"), c.obs.where("dataset_index = 0")
    sel = pc.select_features(hv.hvg(c.coo, c.obs, c.var, c.ledger, n_hvg=8), c.var).where("dataset_index = 0")
    cols = [r["origin_index"] for r in sel.orderBy("selected_feature_index").collect()]
    names = ["component_1", "component_2", "component_3"]
    for fitted in (obs, obs.where("local_row_index % 3 > 0")):  # other rows than the fitted ones are centred by the fitted means
        rows = [r[0] for r in fitted.select("local_row_index").orderBy("local_row_index").collect()]
        model = pc.fit(coo, fitted, sel, 3)
        mean = x[rows][:, cols].mean(axis=0)
        s = np.linalg.svd(x[rows][:, cols] - mean, compute_uv=False)
        got = pc.component_stats(model).orderBy("component_index").toPandas()
        assert np.allclose(got.singular_value, s[:3]) and np.allclose(got.explained_variance_ratio, (s**2 / (s**2).sum())[:3]) and np.allclose(got.cumulative_explained_variance_ratio, np.cumsum(s**2 / (s**2).sum())[:3])
        w = pc.loadings(model).orderBy("component_index", "selected_feature_index").toPandas().loading.to_numpy().reshape(3, -1)
        assert (w[np.arange(3), np.abs(w).argmax(axis=1)] > 0).all()
        emb = pc.project(coo, obs, sel, model, 3).orderBy("global_row_index").toPandas()
        assert np.allclose(emb[names], (x[:, cols] - mean) @ w.T, atol=1e-9)
    with pytest.raises(ValueError):
        pc.fit(coo, obs, sel, 9)
    with pytest.raises(MemoryError):
        pc.fit(coo, obs, sel, 2, most=7)
    with pytest.raises(ValueError):
        pc.fit(coo, obs, sel.limit(0), 2)
    with pytest.raises(ValueError):
        pc.project(c.coo, c.obs, sel, model, 3)
    every = pc.select_features(None, c.var).where("dataset_index = 0")
    assert every.count() == n_genes and pc.memory_needed(1000, 50) == 8 * 1000 * 2050


def test_rank_genes_rules(spark, sf):
    c = Corpus(spark, sf)
    rows = we.rank_genes(c.coo, c.obs, c.var, c.ledger, "BUILDING", top_k=4).toPandas()
    assert rows.groupby(["dataset_index", "perturbation"])["rank"].apply(list).map(lambda r: sorted(r) == [1, 2, 3, 4]).all()
    assert ((rows.p_value >= 0) & (rows.p_adj <= 1) & (rows.p_adj >= rows.p_value - 1e-12)).all()
    with pytest.raises(ValueError):
        we.rank_genes(c.coo, c.obs, c.var, c.ledger, "no such label")
    with pytest.raises(ValueError):
        we.rank_genes(c.coo, c.obs, c.var, c.ledger, "BUILDING", top_k=0)
    with pytest.raises(ValueError, match=r"null in rows \[0, 2"):
        we.contrasts(c.coo, c.obs.withColumn("perturb_label", F.when(~F.col("global_row_index").isin(0, 2), F.col("perturb_label"))), c.var, "BUILDING")


def test_rank_genes_against_definition(spark, sf):
    """Every contrast of one dataset from dense values: means, t, degrees of freedom, p, adjusted p and order."""
    c = Corpus(spark, sf)
    obs = c.obs.where("dataset_index = 2").toPandas().sort_values("global_row_index")
    coo = c.coo.where("dataset_index = 2").toPandas()
    genes = c.var.where("dataset_index = 2").orderBy("origin_index").toPandas()
    dense = np.zeros((len(obs), len(genes)))
    dense[coo.global_row_index - obs.global_row_index.min(), coo.origin_index] = coo["count"]
    x = np.log1p(dense / obs.size_factor.to_numpy()[:, None])
    got = we.rank_genes(c.coo, c.obs, c.var, c.ledger, "BUILDING", top_k=len(genes)).where("dataset_index = 2").toPandas()
    ref = x[(obs.perturb_label == "BUILDING").to_numpy()]
    for label in sorted(set(obs.perturb_label) - {"BUILDING"}):
        one = x[(obs.perturb_label == label).to_numpy()]
        a, b = one.var(axis=0, ddof=1) / len(one), ref.var(axis=0, ddof=1) / len(ref)
        apart = one.mean(axis=0) - ref.mean(axis=0)
        with np.errstate(all="ignore"):
            t_stat = np.where(a + b > 1e-18, apart / np.sqrt(a + b), np.where(np.abs(apart) < 1e-12, 0.0, np.sign(apart) * np.inf))
            df = (a + b) ** 2 / (a**2 / (len(one) - 1) + b**2 / (len(ref) - 1))
        p = np.where(a + b > 1e-18, we.student_tail(t_stat, df), np.where(np.abs(apart) < 1e-12, 1.0, 0.0))
        order = np.argsort(p, kind="stable")
        q = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1)
        adjusted = np.empty(len(p))
        adjusted[order] = q
        rows = got[got.perturbation == label].set_index("gene_id").loc[genes.gene_id]
        assert np.allclose(rows.p_value, p, atol=1e-9) and np.allclose(rows.p_adj, adjusted, atol=1e-9) and np.allclose(rows.logfoldchange, apart / math.log(2), atol=1e-9)
        assert np.allclose(rows.pct_perturbed, (one > 0).mean(axis=0)) and np.allclose(rows.mean_reference, ref.mean(axis=0)) and (rows.n_perturbed == len(one)).all()
        ranked = rows.sort_values("rank")
        assert ranked["rank"].tolist() == list(range(1, len(genes) + 1)) and (np.diff(ranked.p_adj) >= -1e-12).all()


def test_repartitioning_changes_nothing(spark, sf):
    c = Corpus(spark, sf)
    a = st.group_sums(c.coo, c.obs, "perturb_label").selectExpr("round(s, 9) s", "origin_index", "perturb_label", "dataset_index")
    b = st.group_sums(c.coo.repartition(7), c.obs.repartition(3), "perturb_label").selectExpr("round(s, 9) s", "origin_index", "perturb_label", "dataset_index")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lognorm_refuses_bad_factors(spark):
    df = spark.createDataFrame([(1, 0.0)], "count int, sf double")
    with pytest.raises(Exception, match="size_factor"):
        df.select(st.log_normalised(F.col("count"), F.col("sf"))).collect()


def test_recovery(spark):
    rows = spark.createDataFrame([(0, 0, math.log1p(2.0)), (0, 1, math.log1p(6.0)), (0, 2, 0.0)], "row long, gene long, value double")
    assert [tuple(r)[:3] for r in ma.recover_counts(rows).orderBy("gene").collect()] == [(0, 0, 1), (0, 1, 3)]
    bad = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.3)], "row long, gene long, value double")
    with pytest.raises(Exception, match="not integers"):
        ma.recover_counts(bad).collect()
    with pytest.raises(Exception, match="not an integer"):
        ma.direct_counts(bad).collect()


def test_vocabulary_golden(spark):
    var = spark.createDataFrame([(0, 0, "B"), (0, 1, "C"), (1, 0, "A"), (1, 1, "C"), (1, 2, "D")], "dataset_index int, origin_index int, canonical_gene_id string")
    assert [r[0] for r in fe.vocabulary(var).orderBy("global_id").collect()] == ["B", "C", "A", "D"]
    assert sorted(tuple(r) for r in fe.local_map(var).select("dataset_index", "origin_index", "global_id").collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 1), (1, 2, 3)]
    with pytest.raises(Exception, match="missing"):
        fe.vocabulary(var.withColumn("canonical_gene_id", F.lit(None).cast("string"))).collect()
    for bad in ({}, {"a": -1}, {"a": 1, "b": 1}):
        with pytest.raises(ValueError):
            fe.check_stoi(bad)


def test_dynamic_weights_golden(spark):
    cells = spark.createDataFrame([(0, 0)], "global_row_index long, dataset_index int")
    genes = spark.createDataFrame([(0, g, g + 1, g < 2) for g in range(4)], "dataset_index int, global_feature_id long, hvg_rank int, is_hvg boolean")
    none = spark.createDataFrame([], "global_row_index long, global_feature_id long, origin_index int, count int")
    for k, want in ((1, [4, 1, 1, 1]), (3, [4, 4, 4, 1]), (None, [4, 4, 1, 1])):
        got = [r["prob"] for r in sa.gene_weights(cells, genes, none, "hvg", hvg_top_k=k).orderBy("global_feature_id").collect()]
        assert got == pytest.approx([w / sum(want) for w in want])
    with pytest.raises(ValueError):
        sa.gene_weights(cells, genes, none, "hvg", hvg_top_k=0)
    drawn = sa.sample_genes(sa.gene_weights(cells, genes, none), 6, 1)
    out = sa.process(cells, drawn, none, genes, 6).orderBy("seq").collect()
    assert sorted(r["global_feature_id"] for r in out) == [-1, -1, 0, 1, 2, 3] and [r["valid"] for r in out] == [True] * 4 + [False] * 2


def test_urns_draw_by_weight(spark):
    """Genes drawn from urns are distinct, whole where the urn runs short, and as frequent as their weights say."""
    n, cells = 40, 4000
    rows = spark.range(cells).select(F.col("id").alias("global_row_index"), F.lit(0).alias("dataset_index"), F.array(F.lit(3), F.lit(7), F.lit(9)).alias("expressed_gene_indices"), F.array(F.lit(2), F.lit(0), F.lit(5)).alias("expression_counts"))
    genes = spark.createDataFrame([(0, g, 100 + g, g + 1, g < 5) for g in range(n)], "dataset_index int, origin_index int, global_feature_id long, hvg_rank int, is_hvg boolean")
    for mode, hot in (("expressed", {103, 109}), ("hvg", set(range(100, 105))), ("uniform", set())):
        got = sa.sample_rows_genes(rows, genes, 4, 3, mode).toPandas()
        assert len(got) == 4 * cells and not got.duplicated(["global_row_index", "global_feature_id"]).any() and set(got.seq) == set(range(4))
        first = got[got.seq == 0].global_feature_id
        share = first.isin(hot).mean()
        want = 4 * len(hot) / (n - len(hot) + 4 * len(hot))
        assert abs(share - want) < 4 * (want * (1 - want) / cells) ** 0.5 + 1e-9
        counts = first[~first.isin(hot)].value_counts()
        assert len(counts) == n - len(hot) and counts.max() < 3 * counts.min() + 60
        whole = sa.sample_rows_genes(rows.limit(50), genes, 60, 3, mode).groupBy("global_row_index").agg(F.count_distinct("global_feature_id").alias("d"), F.count("seq").alias("n")).collect()
        assert {(r["d"], r["n"]) for r in whole} == {(n, n)}
    with pytest.raises(ValueError):
        sa.sample_rows_genes(rows, genes, 0, 3)
    with pytest.raises(Exception, match="origin_index"):
        sa.sample_rows_genes(rows, genes.where("origin_index <> 5"), 4, 3).collect()


def test_supplied_genes_and_lookups(spark):
    asked = spark.createDataFrame([(0, s, 5 + s) for s in range(3)] + [(1, s, 5) for s in range(2)], "global_row_index long, seq int, global_feature_id long")
    assert sa.check_supplied(asked.where("global_row_index = 0"), 3).count() == 3
    with pytest.raises(Exception, match="3 a cell"):
        sa.check_supplied(asked, 3).collect()
    with pytest.raises(Exception, match="no prepared row"):
        pa.lookup_rows(asked, spark.createDataFrame([(0, "a")], "global_row_index long, label string")).collect()
    assert sa.process(asked.select("global_row_index", F.lit(0).alias("dataset_index")).limit(0), asked, spark.createDataFrame([], "global_row_index long, global_feature_id long, origin_index int, count int"), spark.createDataFrame([(0, 5)], "dataset_index int, global_feature_id long"), 3).collect() == []


def test_draws_stop_when_there_are_enough(spark):
    from hashlib import md5

    urns = F.array(*(F.lit(n) for n in (3, 33, 100, 10**6)))
    rows = spark.range(200).select(F.col("id").alias("global_row_index"), F.element_at(urns, (F.col("id") % 4 + 1).cast("int")).alias("n"))
    for r in rows.withColumn("x", sa._tried(11, 0, F.col("n"), F.array(F.lit(1)), 32)).collect():
        every = [int(md5(f"11|{r['global_row_index']}|0|{i}".encode()).hexdigest()[:15], 16) % r["n"] for i in range(128)]
        assert r["x"][:32] == [k for k in dict.fromkeys(every) if k != 1][:32]
        assert r["n"] < 10**6 or 32 <= len(r["x"]) <= 52


def test_full_vectors(spark):
    rows = spark.createDataFrame([(0, 0, [0, 2], [4, 1]), (1, 1, [], []), (2, 1, [0, 1], [7, 9])], "global_row_index long, dataset_index int, expressed_gene_indices array<int>, expression_counts array<int>")
    genes = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 4), (1, 0, 2), (1, 1, 2)], "dataset_index int, origin_index int, global_feature_id long")
    tokens = spark.createDataFrame([(g, g != 4) for g in range(5)], "global_id long, tokenizable boolean")
    got = {r["global_row_index"]: (r["counts"], r["valid"]) for r in pa.full_vectors(rows, genes, tokens).collect()}
    assert got[0] == ([0, 4, 0, 0, 1], [True, True, False, False, False])
    assert got[1] == ([0] * 5, [False, False, True, False, False]) and got[2] == ([0, 0, 9, 0, 0], got[1][1])


def test_full_vectors_without_lambdas_over_the_vocabulary(spark):
    rows = spark.createDataFrame([(i, i % 2, [2, 0, 1], [1, i, 2]) for i in range(100)] + [(100, 0, [0, 7], [5, 6])], "global_row_index long, dataset_index int, expressed_gene_indices array<int>, expression_counts array<int>")
    genes = spark.createDataFrame([(d, g, 40_000 * d + 20_000 * (g > 0)) for d in range(2) for g in range(3)], "dataset_index int, origin_index int, global_feature_id long")
    tokens = spark.createDataFrame([(20_000 * g, g != 1) for g in range(4)], "global_id long, tokenizable boolean")
    found = pa.full_vectors(rows, genes, tokens)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()  # whose time is that of interpreted code, cells times genes
    got = {r["global_row_index"]: r for r in found.collect()}
    assert len(got) == 101 and all(len(r["counts"]) == len(r["valid"]) == 60_001 for r in got.values())
    there = lambda x: {i: v for i, v in enumerate(x) if v}
    assert all(there(got[i]["counts"]) == {k: v for k, v in ((40_000 * (i % 2), i), (40_000 * (i % 2) + 20_000, 1)) if v} for i in range(100))
    assert there(got[0]["valid"]) == {0: True} and there(got[1]["valid"]) == {40_000: True, 60_000: True} and there(got[100]["counts"]) == {0: 5}


def _tiny(spark):
    rows = spark.createDataFrame([(i, [0, 2], [1 + i, 3]) for i in range(10)], "global_row_index long, expressed_gene_indices array<int>, expression_counts array<int>")
    obs = spark.createDataFrame([(i, i // 6, "ctx" if i % 2 else None, "WT" if i % 3 == 0 else "KO", 1.0 + i) for i in range(10)], "global_row_index long, dataset_index int, cell_context string, perturb_label string, size_factor double")
    genes = spark.createDataFrame([(d, g, 10 * g, g + 1, g < 1) for d in range(2) for g in range(5)], "dataset_index int, origin_index int, global_feature_id long, hvg_rank int, is_hvg boolean")
    tokens = spark.createDataFrame([(10 * g, 4 + g, g != 3) for g in range(5)], "global_id long, token_id long, tokenizable boolean")
    return rows, obs, genes, tokens


def test_loader(spark):
    rows, obs, genes, tokens = _tiny(spark)
    for mode in ("uniform", "expressed", "hvg"):
        loader = lo.Loader(rows, obs, genes, lo.Options(4, 3, mode=mode, metadata=("cell_context",)), tokens)
        batches = list(loader)
        assert [len(b) for b in batches] == [3, 3, 3, 1] and len(loader) == 4 and all(len({r["global_row_index"] for r in b}) == len(b) for b in batches)
        for r in (r for b in batches for r in b):
            assert sorted(r["genes"]) == [0, 10, 20, 40] and all(r["mask"]) and sorted(r["tokens"]) == [4, 5, 6, 8]
            assert dict(zip(r["genes"], r["counts"])) == {0: 1 + r["global_row_index"], 10: 0, 20: 3, 40: 0}
    loader.set_epoch(1)
    assert {tuple(r) for r in loader.batches().collect()} != {(r["batch_id"], r["pos"], r["global_row_index"]) for b in batches for r in b}
    padded = next(iter(lo.Loader(rows, obs, genes, lo.Options(7, 3, policy="pad"), tokens)))[0]
    assert sorted(padded["genes"]) == [-1, -1, 0, 10, 20, 30, 40] and sorted(padded["tokens"]) == [0, 0, 0, 4, 5, 6, 8] and sum(padded["mask"]) == 5
    by = lo.Loader(rows, obs, genes, lo.Options(2, 2, "Context", ("cell_context", "dataset_index"), drop_last=True), only=obs.where("global_row_index < 9"))
    got = [{(r["global_row_index"] % 2, r["dataset_index"]) for r in b} for b in by]
    assert len(got) == len(by) == 3 and all(len(x) == 1 for x in got)
    for bad in ({"seq_len": 0}, {"seq_len": 1, "batch_size": 0}, {"seq_len": 1, "sampler": "odd"}, {"seq_len": 1, "sampler": "context"}, {"seq_len": 1, "sampler": "context", "context": ("a", "a")}, {"seq_len": 1, "policy": "odd"}, {"seq_len": 1, "mode": "odd"}, {"seq_len": 1, "hvg_top_k": 0}):
        with pytest.raises(ValueError):
            lo.Options(**bad)
    with pytest.raises(TypeError):
        lo.Options(1, context="ab")
    with pytest.raises(KeyError):
        lo.Loader(rows, obs, genes, lo.Options(1, metadata=("zz",)))
    empty = lo.Loader(rows.limit(0), obs.limit(0), genes, lo.Options(4, 3))
    assert len(empty) == 0 and list(empty) == []


def test_paired_loader(spark):
    rows, obs, genes, tokens = _tiny(spark)
    obs = obs.withColumn("cell_context", F.lit("c")).withColumn("dataset_index", F.lit(0))
    config = pa.PairConfig(controls=("WT",), treated_target="matched_control_cell", batch_size=4, mask_ratio=0.5)
    loader = lo.PairedLoader(lo.Loader(rows, obs, genes, lo.Options(4, mode="expressed"), tokens), config, sources=obs.where("global_row_index > 0"), targets=obs.where("global_row_index < 8"))
    got = [r for b in loader for r in b]
    assert len(loader) == 2 and len(got) == 8 and loader.effective_sources().count() == 9 and loader.effective_targets().count() == 8
    for r in got:
        assert r["source_row"] > 0 and r["target_row"] < 8 and (r["source_row"] % 3 == 0) != (r["target_row"] % 3 == 0)
        assert sum(r["masked"]) == 2 and dict(zip(r["genes"], r["target_values"]))[0] == 1 + r["target_row"] and r["target_size_factor"] == 1.0 + r["target_row"]
        assert r["label_id"] == (0 if r["target_label"] == "WT" else 1)
    first = {r["source_row"]: r["target_row"] for r in got}
    loader.set_epoch(3)
    assert loader.epoch == 3 and first != {r["source_row"]: r["target_row"] for b in loader for r in b}
    with pytest.raises(KeyError):
        lo.PairedLoader(lo.Loader(rows, obs.drop("size_factor"), genes, lo.Options(4)), config)


def test_pair_rules(spark):
    rows = [(i, 0, "ctx", "WT" if i < 3 else f"KO_{i % 2}") for i in range(9)]
    obs = spark.createDataFrame(rows, "global_row_index long, dataset_index int, cell_context string, perturb_label string")
    for target in ("self_to_control_label", "matched_control_cell"):
        config = pa.PairConfig(controls=("WT",), treated_target=target)
        got = {r["source_row"]: r for r in pa.pairs(pa.prepare(obs, config), config).collect()}
        assert len(got) == 9 and all(got[i]["target_row"] >= 3 for i in range(3))
        for i in range(3, 9):
            assert got[i]["target_label"] == "WT" and (got[i]["target_row"] == i if target.startswith("self") else got[i]["target_row"] < 3)
    config = pa.PairConfig(controls=("WT",), treated_target="matched_control_cell")
    with pytest.raises(Exception, match="no controls"):
        pa.pairs(pa.prepare(obs.where("perturb_label <> 'WT'"), config), config).collect()
    with pytest.raises(ValueError):
        pa.PairConfig(controls=())


def test_gather_rules(spark):
    ledger = spark.createDataFrame([(0, "a", 10, 0, 10), (1, "b", 5, 10, 15)], "dataset_index int, dataset_id string, cell_count long, global_start long, global_end long")
    asked = spark.createDataFrame([(0, 12), (1, 0), (2, 12)], "pos int, global_row_index long")
    assert [(r["dataset_index"], r["local_row_index"]) for r in ga.route(asked, ledger).orderBy("pos").collect()] == [(1, 2), (0, 0), (1, 2)]
    with pytest.raises(Exception, match="out of range"):
        ga.route(spark.createDataFrame([(0, 15)], "pos int, global_row_index long"), ledger).collect()
    for bad, error in (([1, 1], ValueError), ([True], TypeError), ([99], IndexError)):
        with pytest.raises(error):
            ga.check_rows(bad, 0, 10)
    assert ga.check_rows(None, 2, 4) == [2, 3]
    with pytest.raises(KeyError):
        ga.take_columns(ledger, ["zz"])
    for bad in (10, -1, None):
        with pytest.raises(Exception, match="row is not in"):
            ga.checked_requests(spark.createDataFrame([(0,), (bad,)], "global_row_index long"), 10).collect()
    first = ga.match_genes(spark.createDataFrame([(0, 7)], "global_row_index long, global_feature_id long"), spark.createDataFrame([(0, 7, 4, 9), (0, 7, 2, 5)], "global_row_index long, global_feature_id long, origin_index int, count int"))
    assert first.first()["count"] == 5


def test_batches(spark):
    cells = spark.createDataFrame([(0, i) for i in range(10)] + [(1, i) for i in range(5)], "dataset_index int, local_row_index long")
    sizes = {(r["dataset_index"], r["batch_id"]): r["count"] for r in dataset_batches(cells, 4).groupBy("dataset_index", "batch_id").count().collect()}
    assert sizes == {(0, 0): 4, (0, 1): 4, (0, 2): 2, (1, 0): 4, (1, 1): 1}
    with pytest.raises(ValueError):
        dataset_batches(cells, 0)


def test_validation_finds_gaps(spark, sf):
    c = Corpus(spark, sf)
    assert all(r["ok"] for r in validate(c.ledger, c.obs, c.sparse_rows).collect())
    broken = c.ledger.withColumn("global_start", F.when(F.col("dataset_index") == 1, F.col("global_start") + 5).otherwise(F.col("global_start")))
    bad = {r["check"] for r in validate(broken, c.obs, c.sparse_rows).collect() if not r["ok"]}
    assert {"contiguous_ranges", "global_is_start_plus_local"} <= bad


def test_ledger_rules(spark, tmp_path):
    ledger = le.Ledger("c")
    ledger.append("a", 3, "m")
    with pytest.raises(ValueError):
        ledger.append("a", 3, "m")
    with pytest.raises(ValueError):
        ledger.append("b", 3, "m", topology="federated")
    assert ledger.append("b", 2, "m").global_start == 3
    ledger.check()
    ledger.records[1].global_start = 4
    with pytest.raises(ValueError):
        ledger.check()
    with pytest.raises(ValueError):
        le.paths("odd", "r", "d")
    assert le.relative("/r/x/y", "/r") == "x/y"
    with pytest.raises(ValueError):
        le.relative("/q/x", "/r")


def test_store(spark, tmp_path):
    root = str(tmp_path / "corpus")
    so.create_corpus(spark, root, "c", "federated")
    with pytest.raises(FileExistsError):
        so.create_corpus(spark, root, "c")
    rows = spark.createDataFrame([(0, [0, 2], [1, 2]), (1, [], [])], "local_row_index long, expressed_gene_indices array<int>, expression_counts array<int>")
    obs = spark.createDataFrame([("c1", "a", 1.5)], "cell_id string, dataset_id string, x double")
    assert so.add_dataset(spark, root, "a", rows, obs, dry_run=True).records and not le.exists(spark, f"{root}/a")
    so.add_dataset(spark, root, "a", rows, obs)
    ledger = so.add_dataset(spark, root, "b", rows, obs)
    assert sorted(r["global_row_index"] for r in so.read_rows(spark, ledger, root).collect()) == [0, 1, 2, 3]
    assert so.read_rows(spark, ledger, root, ["b"]).count() == 2
    with pytest.raises(KeyError):
        so.read_rows(spark, ledger, root, ["zz"])
    with pytest.raises(ValueError):
        so.write_rows(rows.withColumnRenamed("local_row_index", "global_row_index"), ledger, root, "b")
    (tmp_path / "corpus" / "stray").mkdir()
    assert le.collect_garbage(spark, root, ledger) == ["stray"] and le.collect_garbage(spark, root, ledger, dry_run=False) == ["stray"] and le.orphans(spark, root, ledger) == []
    so.write_result(obs, str(tmp_path / "x"))
    with pytest.raises(Exception, match="exists"):
        so.write_result(obs, str(tmp_path / "x"))
    with pytest.raises(KeyError):
        so.read_obs(spark, str(tmp_path / "x"), ["cell_id"], ["zz"])


def test_lists_and_maps(spark, tmp_path):
    (tmp_path / "genes.tsv").write_text("# comment\nA\tX\n\nB\tY\nA\tZ\n")
    table = so.read_gene_map(spark, str(tmp_path / "genes.tsv"))
    var = spark.createDataFrame([("A",), ("B",), ("C",)], "gene_id string")
    assert [r["canonical_gene_id"] for r in ha.map_genes(var, table).orderBy("gene_id").collect()] == ["Z", "Y", "C"]
    (tmp_path / "in.csv").write_text("source,dataset_id,inspection_summary\n a ,b,c\n")
    assert tuple(so.read_inputs(spark, str(tmp_path / "in.csv")).first()) == ("a", "b", "c")
    (tmp_path / "bad.csv").write_text("source,x\na,b\n")
    with pytest.raises(ValueError):
        so.read_inputs(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "tok.json").write_text('{"stoi": {"A": 101, "D": 404}}')
    tokens = fe.token_map(spark.createDataFrame([("A", 0), ("B", 1)], "canonical_gene_id string, global_id long"), stoi=so.read_tokenizer(spark, str(tmp_path / "tok.json")))
    assert sorted((r["canonical_gene_id"], r["tokenizable"]) for r in tokens.collect()) == [("A", True), ("B", False)]
    assert so.scan_inputs(spark, str(tmp_path), "*.csv")[0].endswith("bad.csv")
    assert '"k": null' in so.provenance("pp", "hvg", "d", {"k": float("nan")})


def test_nothing_else_imports_llm():
    from pathlib import Path

    root = Path(ha.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"(import|from)\b.*\bllm\b", p.read_text())]


@pytest.mark.parametrize(("rows", "size", "drop_last", "want"), [(103, 10, False, [10] * 10 + [3]), (103, 10, True, [10] * 10), (100, 10, False, [10] * 10), (7, 5, False, [5, 2]), (3, 5, False, [3]), (3, 5, True, []), (0, 5, False, [])])
def test_random_batches_of_an_epoch(spark, rows, size, drop_last, want):
    got = {}
    for r in sa.random_batches(spark, rows, size, None, seed=7, drop_last=drop_last).collect():
        got.setdefault(r["batch_id"], []).append(r["global_row_index"])
    assert [len(got[k]) for k in sorted(got)] == want and sorted(got) == list(range(len(want)))
    assert all(len(set(x)) == len(x) and set(x) <= set(range(rows)) for x in got.values())
