"""Readers on small files with their traps, and what has no registered query."""

import numpy as np

from evidentia.operators import detection as D
from evidentia.operators import learning as L
from evidentia.operators import stats as S
from evidentia.sources import readers as R
from evidentia.sources import writers as K


def file(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_fasta_traps(spark, tmp_path):
    path = file(tmp_path, "a.fasta", ">sp|P1|ONE GN=a\nACD\nEF\n>plain header\nGG\n")
    assert sorted((r["id"], r["seq"]) for r in R.fasta(spark, path).collect()) == [("P1", "ACDEF"), ("plain", "GG")]
    assert [r[0] for r in R.fasta_ids(spark, path).collect()] == ["P1"]


def test_accession_traps(spark, tmp_path):
    path = file(tmp_path, "sec.txt", "Secondary AC\n____ ____\nP12345     Q9ABC1\np12345 Q9ABC1\nP12345 Q9ABC1 O12345\nA0A023HHK9 P12345\n")
    assert sorted(map(tuple, R.secondary_accessions(spark, path).collect())) == [("A0A023HHK9", "P12345"), ("P12345", "Q9ABC1")]


def test_mapping_traps(spark, tmp_path):
    path = file(tmp_path, "map.tab", "A\tGeneID\t1\nA\tGeneID\t2\nA\tGene_Name\tx\nA\tGene_Name\ty\nbroken line\nB\tGeneID\t7\n")
    assert sorted(tuple(r) for r in R.id_lookup(spark, path).collect()) == [("A", "2", "x"), ("B", "7", None)]


def test_cluster_traps(spark, tmp_path):
    path = file(tmp_path, "a.clstr", ">Cluster 0\n0\t100aa, >rep... *\n1\t90aa, >P1... at 85.50%\n")
    assert [tuple(r) for r in R.clusters(spark, path).collect()] == [("P1", 85.5)]


def test_json_traps(spark, tmp_path):
    path = file(tmp_path, "d.json", '{"acc": "a", "prediction-disorder-mobidb_lite": {"content_fraction": 0.5}}\n\n{"acc": "b"}\n')
    assert [tuple(r) for r in R.disorder(spark, path).collect()] == [("a", 0.5)]


def test_matrix_cells(spark, tmp_path):
    m = np.array([[1.0, np.nan], [0.25, 1.0]])
    np.save(tmp_path / "m.npy", m)
    assert sorted(tuple(r) for r in R.npy_matrix(spark, str(tmp_path / "m.npy")).collect()) == [(0, 0, 1.0), (1, 0, 0.25), (1, 1, 1.0)]


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        path = file(tmp_path, "n.txt", "".join(f"line {i}\n" for i in range(2000)))
        rows = R.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["node_id"], r["value"]) for r in rows) == [(i + 1, f"line {i}") for i in range(2000)]


def test_blank_cells_come_back_as_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", "3", "", "x", None), ("2", "4", "CVCL_1", "", "")], "pubmed_id string, size string, cl_id string, Comment string, `Intact?` string")
    K.tsv(df, str(tmp_path / "curated"))
    assert [tuple(r) for r in R.curated_studies(spark, str(tmp_path / "curated")).collect()] == [("2", "CVCL_1")]


def test_models_are_saved(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    rows = spark.createDataFrame([(i % 2, [float(i % 2), float(i % 3)]) for i in range(40)], "y int, features array<double>")
    L.save(L.train_classifier(rows, "y", numTrees=5), str(tmp_path / "m"))
    assert RandomForestClassificationModel.load(str(tmp_path / "m")).getNumTrees == 5


def test_detection_model_by_quadrature(spark):
    n, k, x = np.array([30.0, 20.0, 10.0]), np.array([6.0, 7.0, 1.0]), np.array([-1.0, 0.5, 0.0])
    rows = spark.createDataFrame([("a", n.tolist(), k.tolist(), x.tolist())], "key string, tested array<double>, observed array<double>, abundance array<double>")
    got = D.detection_model(rows).first()
    a, b = np.meshgrid(np.linspace(-5, 3, 400), np.linspace(-4, 4, 400), indexing="ij")
    eta = a[..., None] + b[..., None] * x
    post = (k * eta - n * np.logaddexp(0, eta)).sum(-1) - a**2 / 4.5 - b**2 / 2
    w = np.exp(post - post.max())
    mean = (w * a).sum() / w.sum()
    sd = np.sqrt((w * (a - mean) ** 2).sum() / w.sum())
    assert abs(got["mean"] - mean) < 0.06 and abs(got["sd"] - sd) < 0.06 and got["low"] < mean < got["high"]


def test_extreme_mean_by_brute_force(spark):
    rows = [(i, float(i % 17), float((i * 7) % 23), float(-i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, v double, n double")
    got = S.extreme_mean_test(df, "k", "a", "v", "n", top=10, permutations=2000).first()
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:10]
    base = sorted(rows, key=lambda r: (-r[3], r[0]))[:10]
    assert abs(got["mean_value"] - np.mean([r[2] for r in top])) < 1e-9
    assert abs(got["naive_mean"] - np.mean([r[2] for r in base])) < 0.2 and 0 <= got["p_value"] <= 1


def test_u_test_by_enumeration():
    from itertools import combinations

    ranks = list(range(1, 12))
    us = [sum(c) - 6 for c in combinations(ranks, 3)]
    for u in (0, 3, 12, 20):
        big = max(u, 24 - u)
        want = min(1.0, 2 * sum(x >= big for x in us) / len(us))
        assert abs(S.u_test_p(u, 3, 8, 0) - want) < 1e-9 and abs(S.u_test_p(u, 8, 3, 0) - want) < 1e-9
