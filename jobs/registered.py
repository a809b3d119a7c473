"""The jobs as queries: each runs twice into one new folder of the shared store, and returns what stands there then."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import consensus_intake, method_report
from quillon.session import shared_folder


def _config(name: str) -> dict:
    return json.loads(Path(__file__).with_name(f"{name}.json").read_text())


def job1_method_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_folder(spark)}/method-report-{uuid.uuid4().hex}"
    for _ in range(2):
        found = method_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output, **_config("method_report"))
    real = [f.name for f in found.schema if f.dataType.simpleString() == "double"]
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in real})


def job2_consensus_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_folder(spark)}/consensus-intake-{uuid.uuid4().hex}"
    for _ in range(2):
        found = consensus_intake.run(spark, f"{sf_dir}/documents.parquet*", output, **_config("consensus_intake"))
    return found


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_method_report, job2_consensus_intake)}

_SUBSET = """SELECT '{name}' AS subset, method, count(ari) AS n_families, round(avg(ari), 6) + 0.0 AS "mean_ARI", round(sum(ari * n_sequences) / sum(n_sequences), 6) + 0.0 AS "sequence_weighted_mean_ARI",
  round(quantile_cont(ari, 0.5), 6) + 0.0 AS "median_ARI", round(quantile_cont(ari, 0.25), 6) + 0.0 AS "Q1", round(quantile_cont(ari, 0.75), 6) + 0.0 AS "Q3",
  count(*) FILTER (ari >= 0.9) AS "ARI_ge_0.9", count(*) FILTER (ari < 0.5) AS "ARI_lt_0.5" FROM s WHERE {where} GROUP BY method"""

REPORT = f"""WITH d AS (SELECT coalesce(source, '?') AS family, quality::VARCHAR AS truth, lang, (length(text) // 500)::VARCHAR AS size, lower(substr(text, 1, 1)) AS opening FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
m AS (SELECT family, truth, 'language' AS method, lang AS cluster FROM d UNION ALL SELECT family, truth, 'length', size FROM d UNION ALL SELECT family, truth, 'opening', opening FROM d),
c AS (SELECT family, method, truth, cluster, count(*) AS n FROM m GROUP BY ALL),
b AS (SELECT family, method, sum(n) AS n, sum(n * (n - 1) / 2) AS agree, count(DISTINCT cluster) AS predicted_clusters, count(DISTINCT truth) AS known_subfamilies FROM c GROUP BY ALL),
x AS (SELECT family, method, sum(n * (n - 1) / 2) AS x FROM (SELECT family, method, truth, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
y AS (SELECT family, method, sum(n * (n - 1) / 2) AS y FROM (SELECT family, method, cluster, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
e AS (SELECT *, x * y / nullif(n * (n - 1) / 2, 0) AS expected, (x + y) / 2 AS top FROM b JOIN x USING (family, method) JOIN y USING (family, method)),
s AS (SELECT method, family, n::BIGINT AS n_sequences, predicted_clusters, known_subfamilies, CASE WHEN n < 2 OR top = expected THEN 1.0 ELSE (agree - expected) / (top - expected) END AS ari FROM e),
u AS ({_SUBSET.format(name="all families", where="true")} UNION ALL {_SUBSET.format(name="known k > 1", where="known_subfamilies > 1")})
SELECT s.method, family, n_sequences, predicted_clusters, known_subfamilies, round(ari, 6) + 0.0 AS adjusted_rand_index, u.* EXCLUDE (method) FROM s JOIN u USING (method)"""

INTAKE = """WITH t AS (SELECT coalesce(source, '?') AS family, doc_id AS sequence_id, regexp_replace(coalesce(text, ''), '[ \\n\\t\\r]', '-', 'g') AS seq FROM documents),
n AS (SELECT family, sequence_id, md5(seq) AS digest, any_value(seq) AS seq, length(replace(any_value(seq), '-', ''))::BIGINT AS length, count(*) AS members FROM t GROUP BY family, sequence_id, md5(seq)),
i AS (SELECT *, sequence_id IS NOT NULL AND length > 0 AS able FROM n),
f AS (SELECT *, able AND row_number() OVER (PARTITION BY able, sequence_id ORDER BY family, digest) = 1 AS fresh FROM i),
w AS (SELECT *, fresh AND row_number() OVER (PARTITION BY fresh, family, digest ORDER BY sequence_id) = 1 AS won FROM f),
a AS (SELECT family, sequence_id, seq FROM w WHERE won),
l AS (SELECT family, sequence_id, unnest(regexp_extract_all(seq, '(?s).')) AS base, unnest(range(length(seq))) AS pos FROM a),
v AS (SELECT family, pos, base, count(*) AS n, min(sequence_id) AS first FROM l WHERE base <> '-' GROUP BY ALL),
z AS (SELECT family, count(*) AS members FROM a GROUP BY family),
k AS (SELECT family, pos, arg_min(base, {'n': -n, 'first': first}) AS base, sum(n) AS letters FROM v GROUP BY family, pos),
o AS (SELECT family, string_agg(base, '' ORDER BY pos) AS consensus FROM k JOIN z USING (family) WHERE letters >= members * 0.5 GROUP BY family)
SELECT family, sequence_id, CASE WHEN sequence_id IS NULL THEN 'no id' WHEN length = 0 THEN 'blank' WHEN NOT fresh THEN 'repeated id' WHEN NOT won THEN 'copy' ELSE 'accepted' END AS status, digest, length, members FROM w
UNION ALL SELECT family, NULL, 'consensus', md5(coalesce(consensus, '')), length(coalesce(consensus, ''))::BIGINT, members FROM z LEFT JOIN o USING (family)"""

ORACLES = {"job1_method_report": REPORT, "job2_consensus_intake": INTAKE}
