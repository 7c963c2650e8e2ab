"""Documents, count sources, and corpora built, opened, checked and ranked again."""

import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill import __main__ as command
from cellmill.operators import drafting as dr
from cellmill.operators import harmonize as ha
from cellmill.sources import build as bu
from cellmill.sources import corpus as co
from cellmill.sources import counts as cn
from cellmill.sources import documents as do
from cellmill.sources import ledger as le
from cellmill.sources import store as so


def source(spark, n=6, genes=4, values=None, name=".X", extra=()):
    obs = spark.createDataFrame([(i, f"c{i}", ["ctrl", "KO_A_sg1", "KO_B_sg2"][i % 3], "T cell") for i in range(n)], "local_row_index long, cell_id string, guide string, celltype string")
    var = spark.createDataFrame([(g, f"ENSG{g}.{g}", f"S{g}") for g in range(genes)], "origin_index int, feature_id string, symbol string")
    values = values if values is not None else [(i, g, float(1 + (i + g) % 3)) for i in range(n - 1) for g in range(genes) if (i * g) % 3 < 2]
    long = spark.createDataFrame([(name, i, g, v) for i, g, v in values] + list(extra), "source string, row long, gene long, value double")
    return cn.Source(obs, var, long, tuple(dict.fromkeys([name, *(e[0] for e in extra)])), "memory")


def test_schema_documents():
    case = ha.Case("a", "in", ("x", "y"), take="b", case_sensitive=False, strip_whitespace=True)
    obs = [ha.Mapping("dose", "null"), ha.Mapping("sex", source="s", transforms=[("normalize_case", {"mode": "lower"})], fallback="unknown"), ha.Mapping("condition", "conditional", cases=(case, ha.Case("a", "equals", ("z",), value="Z", case_sensitive=True)), default="other"),
           ha.Mapping("x", "template", template="{a}", missing="literal", missing_value="?"), ha.Mapping("perturb_label", "join", sources=("a", "b"), separator="|", skip_nulls=False)]
    schema = do.Schema("d", obs, list(ha.VAR_DEFAULTS), {"raw": "raw"}, {"k": "kk"}, do.GeneMapping(True, "mapping_file", mapping_file="m.tsv"), "ready", "said", ["n"])
    text = schema.to_yaml()
    again = do.Schema.from_yaml(text)
    assert again == schema and again.to_yaml() == text
    said = do.yaml.safe_load(text)["obs_column_mappings"]
    assert said[0] == {"canonical_name": "dose", "strategy": "null"} and "skip_nulls" not in said[1] and said[1]["fallback"] == "unknown"
    assert said[2]["cases"][0] == {"source_column": "a", "predicate": "in", "values": ["x", "y"], "result_source_column": "b"}
    assert do.yaml.safe_load(text)["var_column_mappings"][2]["engine"] == "mapping_file"
    bare = do.Schema.from_yaml("dataset_id: d\nobs_column_mappings:\n- {canonical_name: dose, strategy: null}\nobs_extensible:\n- {raw_source_column: q}\n")
    assert bare.obs[0].strategy == "null" and bare.obs_extensible == {"q": "q"} and not bare.gene_mapping.enabled
    for bad in ("dataset_id: ''", "dataset_id: d\nstatus: odd", "- 1", "dataset_id: d\nkind: other", "dataset_id: d\nobs_column_mappings: [{strategy: literal}]", "dataset_id: d\nobs_column_mappings: [{canonical_name: a, strategy: odd}]",
                "dataset_id: d\nobs_column_mappings: [{canonical_name: a, strategy: literal}, {canonical_name: a, strategy: literal}]", "dataset_id: d\nobs_column_mappings: [{canonical_name: a, strategy: literal}]\nobs_extensible: [{raw_source_column: a}]",
                "dataset_id: d\nobs_column_mappings: [{canonical_name: a, strategy: conditional, cases: [{source_column: b, predicate: equals}]}]", "dataset_id: d\nobs_column_mappings: [{canonical_name: a, strategy: join}]"):
        with pytest.raises(ValueError):
            do.Schema.from_yaml(bad)


def test_drafts_of_genes_and_labels():
    var, notes = dr.draft_var(["index", "gene_symbol", "chr"], {"gene_symbol": ["ENSG1.2", "ENSG3.4", "X"]})
    assert [(m.name, m.strategy, m.source) for m in var] == [("origin_index", "passthrough", "index"), ("gene_id", "source-field", "gene_symbol"), ("canonical_gene_id", "gene-mapping", None), ("global_id", "auto", None)]
    assert var[1].transforms == [("strip_ensembl_version", {})] and "gene_id" in notes
    assert dr.draft_var(["zz"])[0][1].strategy == "null" and dr.gene_mapping_engine(["ENSG1", "ENSG2", "A"]) == "ensembl" and dr.gene_mapping_engine(["A"], "x") == "identity" and dr.gene_mapping_engine([], "ensembl_id") == "ensembl"
    profiles = {"guide_1": {"dtype": "string", "null_count": 3}, "perturbation": {"dtype": "string", "null_count": 0}, "sgrna_n": {"dtype": "bigint", "null_count": 0}}
    controls = [{"column": "guide_1", "candidate_values": ["NTC"], "suggested_output": "ctrl", "confidence": "high"}, {"column": "perturbation", "candidate_values": ["WT"], "confidence": "low"}, {"column": "other", "candidate_values": ["x"], "confidence": "high"}]
    schema = do.draft_schema("d", ["guide_1", "perturbation", "sgrna_n", "cell_id", "weight"], ["feature_id", "chr"], {"profiles": profiles, "controls": controls, "obs_values": {"guide_1": ["A_sg1", " B"], "perturbation": ["", "C"]}})
    label = next(m for m in schema.obs if m.name == "perturb_label")
    assert label.strategy == "coalesce" and label.sources == ("guide_1", "perturbation")
    assert [r[0] for r in label.transforms] == ["strip_whitespace", "replace_empty_with_null", "strip_guide_suffix", "map_control_labels"] and label.transforms[-1][1] == {"candidates": ["NTC"], "output": "ctrl"}
    assert schema.obs_extensible == {"sgrna_n": "sgrna_n", "weight": "weight"} and schema.var_extensible == {"chr": "chr"} and schema.status == "draft" and schema.notes
    assert dr.label_columns(["guide_1", "perturbation"], {**profiles, "guide_1": {"dtype": "string", "null_count": 0}}) == ()
    assert dr.merge_rules([("a", {}), ("b", {"x": 1})], [("b", {"x": 1}), ("b", {"x": 2})]) == [("a", {}), ("b", {"x": 1}), ("b", {"x": 2})]
    assert dr.suggest_transforms("dose", ["1nM", "2uM", "x"]) == [("dose_parse", {})] and dr.suggest_transforms("timepoint_unit", ["24h"]) == [("timepoint_unit", {})] and dr.suggest_transforms("sex", ["a_1"]) == []
    assert do.summary_counts({"a": 1}, {"b": "skipped_existing", "c": "skipped_existing"}) == {"drafted": 1, "skipped_existing": 2}


def test_first_values_follow_the_order(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"v{i}") for i in range(200)], "at int, x string").repartition(5)
    assert dr.first_values(df, "at", ["x"], 4) == {"x": ["v1", "v2", "v4", "v5"]}


def test_sources(spark, tmp_path):
    given = source(spark, extra=[(".layers[counts]", 0, 0, 5.0), (".X", 5, 0, 0.0)])
    cn.write_source(given, str(tmp_path / "s"))
    read = cn.read_source(spark, str(tmp_path / "s"))
    assert read.names == (".X", ".layers[counts]") and [tuple(r) for r in read.select(".layers[counts]").collect()] == [(0, 0, 5.0)]
    assert read.select(".X").where("value = 0").count() == 0
    with pytest.raises(KeyError):
        read.select(".raw.X")
    with pytest.raises(FileNotFoundError):
        cn.read_source(spark, str(tmp_path / "none"))
    dense = cn.dense_to_long(spark.createDataFrame([(0, [0.0, 2.0]), (1, [3.0, 0.0])], "i int, v array<double>"), "i", "v", "x")
    assert sorted(map(tuple, dense.collect())) == [("x", 0, 1, 2.0), ("x", 1, 0, 3.0)]


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
def test_array_stores(spark, tmp_path, codec):
    rng = np.random.default_rng(1)
    matrix = rng.poisson(0.4, (23, 17)) * (rng.random((23, 1)) > 0.2)
    indptr = np.concatenate([[0], np.cumsum((matrix > 0).sum(axis=1))])
    genes = np.nonzero(matrix)[1]
    values = matrix[matrix > 0]

    def put(name, array, kind, chunk):
        folder = tmp_path / "X" / name
        folder.mkdir(parents=True)
        array = array.astype(kind)
        for k in range(-(-len(array) // chunk)):
            part = np.zeros(chunk, kind)
            part[: len(array[k * chunk : (k + 1) * chunk])] = array[k * chunk : (k + 1) * chunk]
            data = part.tobytes()
            if codec == "zlib":
                data = zlib.compress(data)
            elif codec == "gzip":
                import gzip

                data = gzip.compress(data)
            elif codec == "zstd":
                import zstandard

                data = zstandard.ZstdCompressor().compress(data)
            (folder / str(k)).write_bytes(data)
        (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [len(array)], "chunks": [chunk], "dtype": kind, "compressor": codec and {"id": codec}, "filters": None, "fill_value": 0, "order": "C"}))

    put("indptr", indptr, "<i8", 5)
    put("indices", genes, "<i4", 7)
    put("data", values, "<f4", 7)
    obs = spark.createDataFrame([(i, f"c{i}") for i in range(23)], "local_row_index long, cell_id string")
    var = spark.createDataFrame([(g, f"g{g}") for g in range(17)], "origin_index int, feature_id string")
    got = cn.read_array_store(spark, str(tmp_path), obs, var)
    dense = np.zeros_like(matrix)
    for r in got.select(".X").collect():
        dense[r["row"], r["gene"]] = r["value"]
    assert got.names == (".X",) and (dense == matrix).all()
    rows = cn.read_csr(spark, *(str(tmp_path / "X" / k) for k in ("indptr", "indices", "data")))
    assert rows.count() == 23 and [r["genes"] == np.nonzero(matrix[r["row"]])[0].tolist() for r in rows.collect()] == [True] * 23
    cn.write_csr(rows, str(tmp_path / "again"), chunk=6)
    back = {r["row"]: (r["genes"], r["values"]) for r in cn.read_csr(spark, *(str(tmp_path / "again" / k) for k in ("indptr", "indices", "data"))).collect()}
    assert back == {r["row"]: (r["genes"], r["values"]) for r in rows.collect()}
    with pytest.raises(FileExistsError):
        cn.write_csr(rows, str(tmp_path / "again"))
    with pytest.raises(ValueError):
        cn.write_csr(rows.where("row <> 3"), str(tmp_path / "gap"))
    with pytest.raises(FileNotFoundError):
        cn.read_array_store(spark, str(tmp_path / "none"), obs, var)


def test_build_and_open(spark, tmp_path, capsys):
    for i, (n, values) in enumerate([(6, None), (5, [(r, g, math.log1p((1 + g) / 2.0)) for r in range(5) for g in range(4)])]):
        cn.write_source(source(spark, n, values=values), str(tmp_path / f"s{i}"))
    root, lists = str(tmp_path / "corpus"), tmp_path / "in.csv"
    lists.write_text(f"source,dataset_id,inspection_summary\n{tmp_path}/s0,a,{tmp_path}/seen/a/dataset-summary.yaml\n{tmp_path}/s1,b,{tmp_path}/seen/b/dataset-summary.yaml\n")
    run = lambda *a: command.run(spark, [str(x) for x in a])
    assert run("inspect", "--inputs", lists, "--out", tmp_path / "seen") == 0
    found = do.Summary.from_dict(do.read_yaml(spark, str(tmp_path / "seen/b/dataset-summary.yaml")))
    assert found.uses_recovery and found.materialization_readiness in ("pass", "needs-review") and {f["column"] for f in found.obs_fields} == {"cell_id", "guide", "celltype"}
    assert run("materialize", "--corpus", root, "--inputs", lists, "--dry-run") == 0 and not le.exists(spark, f"{root}/{co.INDEX}")
    if found.materialization_readiness != "pass":
        found.materialization_readiness = "pass"
        do.write_text(spark, found.to_yaml(), str(tmp_path / "seen/b/dataset-summary.yaml"))
    assert run("materialize", "--corpus", root, "--inputs", lists, "--n-hvg", 2) == 0
    ledger = le.read_ledger(spark, f"{root}/{co.INDEX}")
    assert [(r.dataset_id, r.global_start, r.global_end) for r in ledger.records] == [("a", 0, 6), ("b", 6, 11)] and bu.corpus_kind(spark, root) == ("parquet", "aggregate")
    with pytest.raises(FileNotFoundError, match="canonical cells of dataset 'a'"):
        co.open_corpus(spark, root)
    with pytest.raises(FileNotFoundError):
        bu.canonicalize_all(spark, root)
    assert run("draft-schema", "--corpus", root) == 0 and bu.draft_all(spark, root) == {"drafted": 0, "skipped_existing": 2}
    own = co.meta(ledger, root, "a")
    schema = do.Schema.from_yaml(do.read_text(spark, own["draft"]))
    (tmp_path / "map.tsv").write_text("ENSG0.0\tALPHA\nENSG1.1\tALPHA\n")
    schema.gene_mapping, schema.obs_extensible = do.GeneMapping(True, "mapping_file", mapping_file=str(tmp_path / "map.tsv")), {"celltype": "as_given"}
    do.write_text(spark, schema.to_yaml(), own["schema"])
    do.write_text(spark, "dataset_id: other", co.meta(ledger, root, "b")["schema"])
    done, failed = bu.canonicalize_all(spark, root)
    assert [r.dataset_id for r in done] == ["a"] and list(failed) == ["b"] and (done[0].obs_rows, done[0].var_rows, done[0].vocabulary_size, done[0].gene_mapping) == (6, 4, 3, "mapping_file")
    schema.dataset_id, schema.gene_mapping = "b", do.GeneMapping(True, "identity")
    do.write_text(spark, schema.to_yaml(), co.meta(ledger, root, "b")["schema"])
    capsys.readouterr()
    assert run("canonicalize", "--corpus", root, "--dataset-id", "b") == 0 and "5 cells" in capsys.readouterr().out
    assert run("canonicalize", "--corpus", root, "--dataset-id", "b") == 1  # never over an older one
    assert bu.draft_all(spark, root) == {"drafted": 0, "skipped_canonicalized": 2}

    opened = co.open_corpus(spark, root, ["as_given"])
    cells = opened.obs.orderBy("global_row_index").collect()
    assert [(r["dataset_id"], r["dataset_index"], r["local_row_index"], r["cell_id"]) for r in cells] == [("a", 0, i, f"c{i}") for i in range(6)] + [("b", 1, i, f"c{i}") for i in range(5)]
    assert [r["global_row_index"] for r in cells] == list(range(11)) and {r["as_given"] for r in cells} == {"T cell"} and {r["dose"] for r in cells} == {None} and {r["perturb_label"] for r in cells} == {"ctrl", "KO_A", "KO_B"}
    assert [r["canonical_gene_id"] for r in opened.vocabulary().orderBy("global_id").collect()] == ["ALPHA", "ENSG2.2", "ENSG3.3", "ENSG0.0", "ENSG1.1"]
    assert set(opened.hvg_paths) == {"a", "b"} and opened.hvg().count() == 8 and opened.dataset_index == {"a": 0, "b": 1}
    counts = {r["global_row_index"]: dict(zip(r["expressed_gene_indices"], r["expression_counts"])) for r in opened.rows().collect()}
    assert counts[0] == {g: 1 + g % 3 for g in range(4)} and counts[5] == {} and counts[7] == {g: g + 1 for g in range(4)}
    with pytest.raises(KeyError):
        co.open_corpus(spark, root, ["zz"])

    assert run("corpus-validate", "--corpus", root) == 0 and run("corpus-validate", "--corpus", root, "--format", "orc") == 1
    assert run("recalc-hvg", "--corpus", root, "--dataset-id", "a", "--n-hvg", 1) == 0
    assert do.read_yaml(spark, own["manifest"])["default_n_hvg"] == 1 and co.open_corpus(spark, root).hvg().where("selected_at_default_n_hvg").groupBy("dataset_id").count().orderBy("dataset_id").collect() == [("a", 1), ("b", 2)]
    with pytest.raises(KeyError):
        bu.recalculate_hvg(spark, root, ["zz"])
    do.write_text(spark, "kind: odd", own["manifest"])
    (tmp_path / "corpus/meta/b/manifest.yaml").unlink()
    assert len(co.violations(spark, root)) == 2
    (tmp_path / "corpus/meta/stray").mkdir()
    capsys.readouterr()
    assert run("gc", "--corpus", root, "--delete") == 0 and "stray" in capsys.readouterr().out and not (tmp_path / "corpus/meta/stray").exists()
    with pytest.raises(FileNotFoundError):
        bu.corpus_kind(spark, str(tmp_path))


def test_gate(spark, tmp_path):
    summary = bu.inspect(source(spark), "d")
    assert (summary.source, summary.status, summary.materialization_readiness, summary.n_cells, summary.n_genes) == (".X", "pass", "pass", 6, 4)
    so.create_corpus(spark, str(tmp_path / "c"), "c")
    for bad in ({"materialization_readiness": "needs-review"}, {"obs_filter": "a > 1"}):
        with pytest.raises(ValueError):
            bu.materialize(spark, str(tmp_path / "c"), "d", source(spark), do.Summary(**{**vars(summary), **bad}))
    with pytest.raises(FileNotFoundError):
        bu.materialize(spark, str(tmp_path / "c"), "d", source(spark), None)
    assert bu.materialize(spark, str(tmp_path / "c"), "d", source(spark), summary, dry_run=True).cell_count == 6
    assert not le.read_ledger(spark, f"{tmp_path}/c/{co.INDEX}").records
    assert bu.inspect(source(spark, values=[(0, 0, 0.37), (0, 1, 2.911)]), "d").materialization_readiness == "fail"
    with pytest.raises(ValueError):
        do.Manifest("d", "odd", "parquet", "aggregate", {}, {}, {}).check()
    with pytest.raises(ValueError):
        co.open_corpus(spark, str(tmp_path / "c"))
    for pair in (("odd", "aggregate"), ("parquet", "odd")):
        with pytest.raises(ValueError):
            so.writer(*pair)
        with pytest.raises(ValueError):
            so.reader(*pair)


def test_results_without_rows(spark, tmp_path):
    for kind in ("hvg", *so.RESULTS):
        df = so.empty_result(spark, kind)
        assert df.count() == 0 and len(df.columns) > 3
    parts = [so.empty_result(spark, f"pca_{k}") for k in ("selected_features", "components", "component_stats", "embeddings")]
    so.write_pca(str(tmp_path / "p"), *parts, {"n_components": 2})
    assert json.loads((tmp_path / "p/provenance.json").read_text())["parameters"] == {"n_components": 2}
    assert spark.read.parquet(str(tmp_path / "p/components")).schema == parts[1].schema
    with pytest.raises(FileExistsError):
        so.write_pca(str(tmp_path / "p"), *parts, {})
    assert F is not None
