import json
from pathlib import Path

import pytest

from quillon.operators import checks
from quillon.plans import dataset
from quillon.sources import readers, writers


def put(path: Path, text: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_mldist(spark, tmp_path):
    got = readers.read_mldist(spark, put(tmp_path / "f7.mldist", "2\n\na  0 0.5\nb 0.5 0\n"))
    assert [tuple(r) for r in got.orderBy("i", "j").collect()] == [("f7", 0, 0, "a", "a", 0.0), ("f7", 0, 1, "a", "b", 0.5), ("f7", 1, 0, "b", "a", 0.5), ("f7", 1, 1, "b", "b", 0.0)]


@pytest.mark.parametrize(("text", "message"), [("x\na 0\n", "header"), ("2\na 0 1\n", "row count"), ("2\na 0 1\nb 1\n", "another number"), ("2\na 0 x\nb 1 0\n", "not a number"), ("2\na 0 1\nb 2 0\n", "symmetric"), ("2\na 0 -1\nb -1 0\n", "negative")])
def test_broken_mldist(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        readers.read_mldist(spark, put(tmp_path / "f.mldist", text))


def test_matrix_csv_and_header_scan(spark, tmp_path):
    path = put(tmp_path / "12.csv", ",a,b\na,0,-2\nb,-2,0\n")
    assert sorted(r["distance"] for r in readers.read_matrix_csv(spark, path).collect()) == [-2.0, -2.0, 0.0, 0.0]
    assert [r["sequence_id"] for r in readers.read_matrix_ids(spark, path).orderBy("ord").collect()] == ["a", "b"]
    put(tmp_path / "x1.csv", ",a\na,0\n")
    assert [r[0] for r in readers.numeric_csv_families(spark, str(tmp_path)).collect()] == ["12"]
    with pytest.raises(ValueError, match="empty or repeated"):
        readers.read_matrix_ids(spark, put(tmp_path / "9.csv", ",a,a\n"))


def test_labels_read_na_as_missing(spark, tmp_path):
    got = readers.read_labels(spark, put(tmp_path / "l.csv", 'note,sequence_id,known_subfamily\nx,b,"L,1"\ny,a,L2\n'))
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [("l", 0, "b", "L,1"), ("l", 1, "a", "L2")]
    with pytest.raises(ValueError, match="missing values"):
        readers.read_labels(spark, put(tmp_path / "n.csv", "sequence_id,known_subfamily\na,NA\n"))
    with pytest.raises(ValueError, match="lacks"):
        readers.read_labels(spark, put(tmp_path / "m.csv", "sequence_id,other\na,b\n"))


def test_tables_with_quotes_line_breaks_and_many_columns(spark, tmp_path):
    head = [f"x{n}" for n in range(20)]
    path = put(tmp_path / "7.csv", ",".join([*head, "sequence_id", "known_subfamily"]) + "\r\n" + "".join(",".join(["v"] * 20 + [i, s]) + "\r\n" for i, s in (("a", '"L\n""1"""'), ("b", "L2"))))
    assert [tuple(r)[1:] for r in readers.read_labels(spark, path).orderBy("ord").collect()] == [(0, "a", 'L\n"1"'), (1, "b", "L2")]
    both = readers.read_result_table(spark, [path, put(tmp_path / "8.csv", "id,known_subfamily,extra\nq,7,\n")], ["known_subfamily"])
    assert {(r["family"], r["sequence_id"], r["known_subfamily"]) for r in both.collect()} == {("7", "v", 'L\n"1"'), ("7", "v", "L2"), ("8", "q", "7")}
    with pytest.raises(ValueError, match="lacks"):
        readers.read_result_table(spark, put(tmp_path / "9.csv", "id,a\n"), ["b"])


def test_tables_of_unlike_heads_in_splits(spark, tmp_path):
    """Columns stand at other places in each file; blank lines, short rows, quotes and marks of byte order count for nothing."""
    want = {}
    for f, (head, cells) in {"1": ("sequence_id,x,known_subfamily", "s{i},{i},L{m}"), "2": ("x,known_subfamily,y,sequence_id", '"q,{i}",L{m},,s{i}'), "3": ("\ufeff\"known_subfamily\",sequence_id,a,b", 'L{m},"s{i}",1,2,3')}.items():
        put(tmp_path / f"t/{f}.csv", "\n" + head + "\r\n" + "".join(cells.format(i=i, m=i % 3) + "\n" * (1 + (i == 7)) + "  \n" * (i == 9) for i in range(40)))
        want |= {(f, i): (f"s{i}", f"L{i % 3}") for i in range(40)}
    rows = lambda: {(r["family"], r["ord"]): (r["sequence_id"], r["known_subfamily"]) for r in readers.read_labels(spark, str(tmp_path / "t")).collect()}
    assert rows() == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows() == want
        put(tmp_path / "t/4.csv", 'known_subfamily,sequence_id\n"a\n\nb",s0\nL,s1\n')
        assert rows() == want | {("4", 0): ("s0", "a\n\nb"), ("4", 1): ("s1", "L")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for text, message in ((" \n", "lacks sequence_id.*: 5"), ("", "file is empty")):
        put(tmp_path / "t/5.csv", text)
        with pytest.raises(ValueError, match=message):
            rows()


def test_tables_are_parsed_by_spark(spark, tmp_path, monkeypatch):
    """No Python worker and no whole file as one value; the scan reads the columns asked for."""
    plans, keep = [], readers.settled
    monkeypatch.setattr(readers, "settled", lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df))
    put(tmp_path / "a.csv", "id,x,y,z\nq,1,2,3\n")
    assert [tuple(r) for r in readers.read_result_table(spark, str(tmp_path), ["y"]).collect()] == [("a", "q", "2")]
    assert not any("Python" in p or "content" in p.split("== Physical Plan ==")[1] for p in plans)
    assert "ReadSchema: struct<_c0:string,_c2:string>" in plans[-1]
    put(tmp_path / "a.csv", "id,x,y,z\n,1,,3\n")
    assert [tuple(r) for r in readers.read_result_table(spark, str(tmp_path), ["y"]).collect()] == [("a", "", None)]


def test_quoted_ids_of_matrices(spark, tmp_path):
    path = put(tmp_path / "12.csv", ',"a,1",b\r\n\r\n"a,1",0,2e0\r\nb,2.0,0\r\n')
    assert {(r["src"], r["dst"], r["distance"]) for r in readers.read_matrix_csv(spark, path).collect()} == {("a,1", "a,1", 0.0), ("a,1", "b", 2.0), ("b", "a,1", 2.0), ("b", "b", 0.0)}
    assert [r["sequence_id"] for r in readers.read_matrix_ids(spark, path).orderBy("ord").collect()] == ["a,1", "b"]
    with pytest.raises(ValueError, match="not a number"):
        readers.read_matrix_csv(spark, put(tmp_path / "13.csv", ",a\na,x\n"))


def test_files_in_many_splits(spark, tmp_path):
    """Lines and records are numbered alike whether a file is one split or many."""
    n = 40
    text = f"{n}\n" + "".join(f"s{i} " + " ".join(str(abs(i - j) / 4) for j in range(n)) + "\n" * (1 + (i == 7)) for i in range(n))
    fasta = "no record\n" + "".join(f">r{i} x>y\n" + "acgt" * 30 + "\nac>g\n" for i in range(n))
    one, two = put(tmp_path / "5.mldist", text), put(tmp_path / "6.fasta", fasta)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(readers.scan_mldist(spark, one)), rows(readers.scan_fasta(spark, two))
    assert [r[1] for r in whole[1]] == list(range(n)) and whole[1][3][2:] == ("r3", "acgt" * 30 + "ac>g")
    assert {(r[1], r[3]) for r in whole[0]} == {(i, f"s{i}") for i in range(n)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(one).rdd.getNumPartitions() > 4
        assert (rows(readers.scan_mldist(spark, one)), rows(readers.scan_fasta(spark, two))) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_command_line(spark, tmp_path):
    from quillon import cli

    n = 12
    d = [[0.0 if i == j else (0.1 if i // 6 == j // 6 else 1.0) + 0.001 * abs(i - j) for j in range(n)] for i in range(n)]
    m = put(tmp_path / "in.mldist", f"{n}\n" + "".join(f"s{i} " + " ".join(map(str, r)) + "\n" for i, r in enumerate(d)))
    labels = put(tmp_path / "labels.csv", "sequence_id,known_subfamily\n" + "".join(f"s{i},{'AB'[i // 6]}\n" for i in range(n)))
    out = tmp_path / "out"
    assert cli.main(["quick-start", "--mldist", m, "--labels", labels, "--output-dir", str(out)]) == 0
    assert {p.name for p in out.iterdir() if not p.name.startswith(".")} == {"distance_matrix.csv", "affinity_matrix.csv", "cluster_membership.csv", "candidate_scores.csv", "metrics.json"}
    got = json.loads((out / "metrics.json").read_text())
    table = [line.split(",") for line in (out / "candidate_scores.csv").read_text().splitlines()]
    k, score = table[0].index("k"), table[0].index("mean_silhouette")
    best = max(table[1:], key=lambda r: (float(r[score]), -int(r[k])))
    assert (got["selected_k"], got["selected_mean_silhouette"], got["n_sequences"]) == (int(best[k]), float(best[score]), 12)
    lines = (out / "distance_matrix.csv").read_text().splitlines()
    assert lines[0] == "," + ",".join(f"s{i}" for i in range(n)) and lines[1].split(",")[:3] == ["s0", "0.0", "0.101"]
    assert (out / "cluster_membership.csv").read_text().splitlines()[0].startswith("sequence_id,predicted_cluster")
    msa = put(tmp_path / "in.fasta", "".join(f">s{i}\n{'acgt' * 5 if i < 6 else 'ttga' * 5}\n" for i in range(n)))
    for name, table in (("recursive", "recursive"), ("fixed-binary", "fixed_binary")):
        out = tmp_path / table
        assert cli.main([name, "--mldist", m, "--alignment", msa, "--labels", labels, "--output-dir", str(out), "--swipe-threads", "1"]) == 0
        assert {f"{table}_membership.csv", f"{table}_diagnostics.csv", "metrics.json"} <= {p.name for p in out.iterdir()}
        assert (out / f"{table}_diagnostics.csv").read_text().splitlines()[1].startswith("family,")


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "m.fasta", ">a first\nac\ngt\n>b\r\nac-t\r\n")
    assert [tuple(r)[1:] for r in readers.read_alignment(spark, path).orderBy("ord").collect()] == [(0, "a", "acgt"), (1, "b", "ac-t")]
    with pytest.raises(ValueError, match="differ in length"):
        readers.read_alignment(spark, put(tmp_path / "n.fasta", ">a\nac\n>b\na\n"))


def test_writers_round_trip(spark, tmp_path):
    source = readers.scan_mldist(spark, put(tmp_path / "f.mldist", "2\na 0.0 0.50\nb 0.50 0.0\n"))
    ids = source.filter("i = j").selectExpr("i as ord", "src as sequence_id")
    names = writers.public_names(ids, "5")
    writers.write_mldist(source, str(tmp_path / "out"), names)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "2\nfamily5_seq001 0.0 0.50\nfamily5_seq002 0.50 0.0\n"
    after = readers.scan_mldist(spark, str(tmp_path / "out"))
    assert writers.renaming_faults(source.select("src", "dst", "distance_text"), after.select("src", "dst", "distance_text"), names, ["src", "dst"]).isEmpty()
    msa = spark.createDataFrame([(1, "b", "-c"), (0, "a", "ac")], "ord int, sequence_id string, seq string")
    writers.write_fasta(msa, str(tmp_path / "fasta"))
    assert [r["seq"] for r in readers.scan_fasta(spark, str(tmp_path / "fasta"), "f").orderBy("ord").collect()] == ["ac", "-c"]
    writers.write_json({"é": 1}, str(tmp_path / "json"))
    assert (tmp_path / "json").read_text() == '{\n  "é": 1\n}\n'


def test_hits(spark, tmp_path):
    path = put(tmp_path / "h.tsv", "# note\nq\tdb|1\t90\t5\t0\t0\t1\t5\t1\t5\t25.5\n")
    assert [(r["Query"], r["Score"]) for r in readers.read_hits(spark, path).collect()] == [("q", 25.5)]


@pytest.fixture
def study(tmp_path):
    """Two families with all inputs of the dataset evaluation."""
    truth = {"1": {"a:1": "X", "b": "X", "c": "Y", "d": "Y"}, "2": {"e": "Z", "f": "Z"}}
    for fam, t in truth.items():
        ids = [x.replace(":", "_") for x in t]
        put(tmp_path / f"matrix/{fam}.csv", "," + ",".join(ids) + "\n" + "".join(f"{i}," + ",".join("0" for _ in ids) + "\n" for i in ids))
        put(tmp_path / f"annotation/{fam}.csv", "name,subfamily,used\n" + "".join(f"{n},{s},True\n" for n, s in t.items()) + "zz,Q,False\n")
        put(tmp_path / f"sequence/{fam}.csv", ",subfamily,80,90,95\n" + "".join(f"{i},{s},{n},0,{n // 2}\n" for n, (i, s) in enumerate(zip(ids, t.values(), strict=True))))
        put(tmp_path / f"tree/{fam}.csv", "," + ",".join(dataset.TREE_CUTOFFS) + "\n" + "".join(f"{i}," + ",".join(str(n // 2) for _ in dataset.TREE_CUTOFFS) + "\n" for n, i in enumerate(ids)))
        for name in ("dbscan", "recursive_k2", "recursive_silhouette"):
            put(tmp_path / f"{name}/{fam}.csv", ",cluster_number,known_cluster\n" + "".join(f"{i},{-1 if n == 0 and name == 'dbscan' else n // 2},{s}\n" for n, (i, s) in enumerate(zip(ids, t.values(), strict=True))))
        for name in ("umap", "spectral"):
            put(tmp_path / f"{name}/{fam}.csv", ",ARI score,silhouettes\n2,0.3,0.9\n3,0.8,0.1\n")
    put(tmp_path / "meta.csv", "family_ID,order,TE\n1,LTR,TE\n2,SINE,TE\n")
    return {n: str(tmp_path / n) for n in ("matrix", "annotation", "sequence", "tree", "dbscan", "umap", "spectral", "recursive_k2", "recursive_silhouette")} | {"family_metadata": str(tmp_path / "meta.csv")}


def test_dataset_evaluation(spark, study, tmp_path):
    got = dataset.evaluate_dataset(spark, study, str(tmp_path / "out"), 2)
    one = got["comparison"].filter("family = '1'").first().asDict()
    assert (one["n_sequences"], one["known_cluster_number"], one["order"]) == (4, 2, "LTR")
    assert (one["sequence_80_ARI"], one["sequence_80_clusters"], one["sequence_90_ARI"], one["sequence_95_ARI"], one["tree_0.02_ARI"]) == (0.0, 4, 0.0, 1.0, 1.0)
    assert (one["dbscan_noise_count"], one["dbscan_noise_rate"], one["dbscan_clusters"], one["dbscan_noise_removed_ARI"]) == (1, 0.25, 2, 1.0)
    assert (one["umap_silhouette_ARI"], one["umap_silhouette_k"], one["spectral_upper_ARI"], one["spectral_upper_k"]) == (0.3, 2, 0.8, 3)
    assert len(got["comparison"].columns) == 43 + 1
    summary = {(r["subset"], r["method"]): r for r in got["summary"].collect()}
    assert len(summary) == 21
    assert summary["known k > 1", "Recursive Spectral (silhouette)"]["mean_ARI"] == 1.0
    assert (tmp_path / "out/method_summary.csv").exists()


def test_dataset_faults(spark, study):
    Path(study["tree"], "2.csv").unlink()
    with pytest.raises(ValueError, match="family sets differ"):
        dataset.evaluate_dataset(spark, study)


def test_saved_labels_must_agree(spark, study):
    p = Path(study["dbscan"], "2.csv")
    p.write_text(p.read_text().replace(",Z", ",W"))
    with pytest.raises(ValueError, match="known labels differ"):
        dataset.evaluate_dataset(spark, study)


def test_differing_rows_counts_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in checks.differing_rows(a, b).collect()) == [(1, "missing"), (2, "missing"), (3, "extra")]


def test_publishing_changes_names_alone(spark, tmp_path):
    from quillon.plans import publish

    m = put(tmp_path / "in.mldist", "3\nDF1_5 0.0 0.50 1e-1\nDF2_6 0.50 0.0 0.3\nDF3_7 1e-1 0.3 0.0\n")
    f = put(tmp_path / "in.fasta", ">DF1:5 x\nac-\n>DF2:6\nact\n>DF3:7\n--t\n")
    a = put(tmp_path / "in.csv", "name,subfamily,subfamily_ID,used\nDF2:6,L2,2,True\nDF1:5,L1,1,True\nDF3:7,L1,1,true\nDF9:1,L9,9,False\n")
    out = str(tmp_path / "out")
    publish.prepare_example(spark, "5", m, f, a, out, {"organism": "x"})
    publish.verify_example(spark, "5", m, f, a, out)
    assert [tuple(r)[1:] for r in readers.read_labels(spark, f"{out}/labels.csv", "5").orderBy("ord").collect()] == [(0, "family5_seq001", "L1"), (1, "family5_seq002", "L2"), (2, "family5_seq003", "L1")]
    changed = put(tmp_path / "other.mldist", Path(m).read_text().replace("1e-1", "0.1"))
    with pytest.raises(ValueError, match="published distances differ"):
        publish.verify_example(spark, "5", changed, f, a, out)
    with pytest.raises(ValueError, match="annotation lacks"):
        publish.verify_example(spark, "5", m, f, put(tmp_path / "less.csv", "name,subfamily,subfamily_ID,used\nDF1:5,L1,1,True\n"), out)


def test_a_search_without_hits_has_accuracy_zero(spark, tmp_path):
    from quillon.operators import sequences
    from quillon.sources import readers

    empty = tmp_path / "empty.tsv"
    empty.write_text("# no hits\n")
    members = spark.createDataFrame([("f", 0, 0), ("f", 1, 1)], "family string, ord int, cluster int")
    for path in (str(tmp_path / "none.tsv"), str(empty)):
        hits = readers.read_hits(spark, path)
        assert hits.count() == 0 and hits.columns[0] == "Query"
        best = sequences.best_hits(hits.selectExpr("Query as family", "Length as ord", "Length as cluster", "Score as score"), ["family"])
        assert sequences.reassignment_accuracy(members, best, ["family"]).first()["reassignment_accuracy"] == 0.0


def test_facts_of_a_family_come_from_a_file(spark, tmp_path):
    from quillon import cli

    (tmp_path / "facts.json").write_text('{"organism": "x",\n "taxonomy_id": 7}')
    assert cli.read_facts(spark, str(tmp_path / "facts.json")) == {"organism": "x", "taxonomy_id": 7}
    a = cli.parser().parse_args(["prepare-example", *[y for x in ("family", "distance", "alignment", "annotation", "output") for y in (f"--{x}", "1")], "--facts", "f.json"])
    assert a.facts == "f.json"


def test_public_names_are_exported():
    import quillon

    assert all(hasattr(quillon, n) for n in quillon.__all__) and {"SpectralResult", "RecursiveResult"} <= set(quillon.__all__)


def test_example_runs_on_a_family_of_its_folder(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    folder = tmp_path / "family_9"
    folder.mkdir()
    n = 24
    rows = [" ".join([f"s{i}", *("0" if i == j else "1" if (i < 12) == (j < 12) else str(5 + (i + j) % 3) for j in range(n))]) for i in range(n)]
    (folder / "pairwise_ml_distance.mldist").write_text("\n".join([str(n), *rows]) + "\n")
    (folder / "labels.csv").write_text("sequence_id,known_subfamily\n" + "".join(f"s{i},{'A' if i < 12 else 'B'}\n" for i in range(n)))
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-m", "examples.quick_start", "--family", "9", "--data-dir", str(tmp_path), "--output-dir", str(tmp_path / "out")], cwd=root, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "adjusted_rand_index" in said.stdout and (tmp_path / "out/metrics.json").is_file()
