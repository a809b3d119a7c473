"""The jobs: against plain loops, over growing input, repeated, and from the command line."""

import hashlib
import json
import logging
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import consensus_intake, method_report
from jobs.registered import ORACLES, QUERIES, _config

ROOT = Path(__file__).resolve().parent.parent
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- incremental consensuses


class Plain:
    """Taking sequences in one by one, family by family."""

    def __init__(self):
        self.ids, self.digests, self.members, self.rows = set(), set(), {}, Counter()

    def take(self, rows):
        new = {}
        for r in rows:
            seq = re.sub("[ \n\t\r]", "-", r["text"] or "")
            new.setdefault((r["source"] if r["source"] is not None else "?", r["doc_id"], hashlib.md5(seq.encode()).hexdigest()), []).append(seq)
        status, fresh = {}, []
        for key in sorted((k for k in new if k[1] is not None), key=lambda k: (k[1], k[0], k[2])):
            if not new[key][0].replace("-", ""):
                status[key] = "blank"
            elif key[1] in self.ids or key[1] in {k[1] for k in fresh}:
                status[key] = "repeated id"
            else:
                fresh.append(key)
        for key in fresh:
            if (key[0], key[2]) in self.digests:
                status[key] = "copy"
            else:
                status[key] = "accepted"
                self.digests.add((key[0], key[2]))
                self.members.setdefault(key[0], []).append((key[1], new[key][0]))
        self.ids |= {k[1] for k, s in status.items() if s == "accepted"}
        for key, seqs in new.items():
            self.rows[(*key, len(seqs[0].replace("-", "")), len(seqs), status.get(key, "no id"))] += 1

    def consensuses(self):
        out = {}
        for family, members in self.members.items():
            columns = []
            for p in range(max(len(s) for _, s in members)):
                letters = Counter(s[p] for _, s in members if p < len(s) and s[p] != "-")
                if sum(letters.values()) >= 0.5 * len(members) and letters:
                    first = {c: min(i for i, s in members if p < len(s) and s[p] == c) for c in letters}
                    columns.append(max(letters, key=lambda c: (letters[c], -first[c])))
            out[family] = (len(members), "".join(columns))
        return out


def stands(spark, out):
    rows = Counter((r["family"], r["sequence_id"], r["digest"], r["n_letters"], r["n_rows"], r["status"]) for r in spark.read.schema(consensus_intake.SEQUENCES).parquet(f"{out}/sequences").collect())
    found = {r["family"]: (r["n_sequences"], r["consensus"]) for r in spark.read.schema(consensus_intake.CONSENSUS).parquet(f"{out}/consensus").collect()}
    return rows, found


def test_intake_of_growing_input(spark, documents, tmp_path, caplog):
    rows = documents.orderBy("doc_id").select(*[c.split(" ")[0] for c in KIND.split(", ")]).collect()
    odd = [(None, "who", "en", "src1", 3), (900, None, "en", "src1", 0), (901, "\n \t", "en", "src1", 3), (902, "é😀 x", "en", None, 4), (902, "é😀 y", "en", None, 4), (902, "é😀 y", "en", None, 4), (903, rows[0]["text"], "en", rows[0]["source"], 1), (rows[1]["doc_id"], "again", "en", "src2", 5)]
    lots = [rows[:70], [*rows[50:150], *spark.createDataFrame(odd, KIND).collect()], rows[140:]]
    given, out, plain = str(tmp_path / "in"), str(tmp_path / "out"), Plain()
    caplog.set_level(logging.INFO)
    for n, lot in enumerate(lots):
        spark.createDataFrame(lot, KIND).coalesce(1).write.mode("append").parquet(given)
        consensus_intake.run(spark, given, out)
        plain.take(lot)
        assert stands(spark, out) == (plain.rows, plain.consensuses())
        assert f"batch {n}: read" in caplog.text
        caplog.clear()
    before = stands(spark, out)
    again = consensus_intake.run(spark, given, out)  # nothing is new
    assert stands(spark, out) == before and "batch" not in caplog.text
    assert again.count() == sum(before[0].values()) + len(before[1])


def test_a_repeated_batch_replaces_itself(spark, documents, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in documents.limit(120).randomSplit([0.5, 0.5], 1):
        part.coalesce(1).write.mode("append").parquet(given)
        consensus_intake.run(spark, given, out)
    before = stands(spark, out)
    last = sorted(p for p in (tmp_path / "out/checkpoint/commits").iterdir() if p.name.isdigit())[-1]
    for p in (last, last.with_name(f".{last.name}.crc")):  # as if the driver had gone before it noted the batch
        p.unlink(missing_ok=True)
    consensus_intake.run(spark, given, out)
    assert stands(spark, out) == before


def test_empty_intake(spark, documents, tmp_path):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    documents.filter("false").write.parquet(given)
    documents.limit(3).write.mode("append").parquet(given)
    assert consensus_intake.run(spark, given, out).filter("status = 'accepted'").count() == 3


# ---- report


def test_report_repeats_and_adds_methods(spark, sf_dir, tmp_path):
    paths = (f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", str(tmp_path / "out"))
    config = _config("method_report")
    told = lambda df: sorted(map(str, df.collect()))
    once = told(method_report.run(spark, *paths, **config))
    assert told(method_report.run(spark, *paths, **config)) == once
    files = lambda: sorted(p.name for p in (tmp_path / "out/scores").iterdir() if p.is_dir())
    assert files() == ["method=language", "method=length", "method=opening"]
    other = method_report.run(spark, *paths, methods={"first word": "split(text, ' ')[0]"}, family="lang")
    assert {r["method"] for r in other.collect()} == {"first word"}
    assert files() == ["method=first word", "method=language", "method=length", "method=opening"]


def test_report_against_plain_counts(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"{'ab'[n % 2]}{n % 3}", "en" if n % 4 else None, "s" if n < 20 else None, 2) for n in range(30)], KIND)
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(28)] + [(99, 1, 0), (29, None, 0)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "d"))
    labels.write.parquet(str(tmp_path / "l"))
    got = method_report.run(spark, str(tmp_path / "d"), str(tmp_path / "l"), str(tmp_path / "o"), methods={"same": "substring(text, 1, 1)", "all": "1"}).filter("subset = 'all families'").collect()
    by = {(r["method"], r["family"]): r for r in got}
    assert [by[m, f]["n_sequences"] for m in ("same", "all") for f in ("s", "?")] == [20, 8, 20, 8]
    assert by["same", "s"]["adjusted_rand_index"] == by["same", "?"]["mean_ARI"] == 1 and by["all", "s"]["adjusted_rand_index"] == 0
    twice = labels.unionByName(labels.limit(1))
    twice.write.parquet(str(tmp_path / "l2"))
    with pytest.raises(ValueError, match="several labels"):
        method_report.run(spark, str(tmp_path / "d"), str(tmp_path / "l2"), str(tmp_path / "o"), methods={"all": "1"})


# ---- as queries, and from the command line


def test_queries_return_what_two_runs_leave(spark, sf_dir):
    assert set(QUERIES) == set(ORACLES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = Plain()
    plain.take(docs.collect())
    got = QUERIES["job2_consensus_intake"](spark, sf_dir).collect()
    assert Counter(r["status"] for r in got if r["status"] != "consensus") == Counter({s: sum(n for k, n in plain.rows.items() if k[-1] == s) for s in {k[-1] for k in plain.rows}})
    assert {r["family"]: (r["members"], r["digest"]) for r in got if r["status"] == "consensus"} == {f: (n, hashlib.md5(c.encode()).hexdigest()) for f, (n, c) in plain.consensuses().items()}
    report = QUERIES["job1_method_report"](spark, sf_dir)
    assert report.filter("subset = 'all families'").select("family", "method").distinct().count() == 3 * docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("source").distinct().count()


def test_command_line(sf_dir, tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps(_config("method_report") | {"labels": f"{sf_dir}/labels.parquet"}))
    said = subprocess.run([sys.executable, "-m", "jobs.method_report", "--config", str(config), "--documents", f"{sf_dir}/documents.parquet", "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "read 200 documents" in said.stderr and (tmp_path / "out/summary").is_dir()
    lost = subprocess.run([sys.executable, "-m", "jobs.consensus_intake", "--config", str(ROOT / "jobs/consensus_intake.json"), "--output", "x"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert lost.returncode == 2 and "documents" in lost.stderr


def test_column_counts_equal_plain_counts(spark, monkeypatch):
    from quillon.operators import sequences

    rows = [("a", [1], i, "ab-é😀"[i % 3 :] + "c" * (i % 4)) for i in range(20)] + [("b", [1, 2], 3, None), ("b", [1, 2], 4, ""), ("b", None, 5, "zz")]
    df = spark.createDataFrame(rows, "family string, path array<int>, ord int, seq string").repartition(3)
    want = Counter()
    first = {}
    for family, path, o, seq in rows:
        for p, c in enumerate(seq or ""):
            key = (family, str(path), p, c)
            want[key] += 1
            first[key] = min(o, first.get(key, o))
    for letters in (1 << 20, 3):
        monkeypatch.setattr(sequences, "LETTERS", letters)
        got = sequences.column_counts(df, ["family", "path"]).collect()
        assert {(r["family"], str(r["path"]), r["pos"], r["base"]): (r["n"], r["first"]) for r in got} == {k: (n, first[k]) for k, n in want.items()}
    assert sequences.column_counts(df.filter(F.lit(False)), ["family", "path"]).count() == 0
