"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

# ---- stand-in tables, as common table expressions

E = "e AS (SELECT label AS family, vec_id AS sequence_id, embedding::DOUBLE[] AS vec, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS ord FROM embeddings)"
D = E + ",\nd AS (SELECT a.family, a.ord AS i, b.ord AS j, a.sequence_id AS src, b.sequence_id AS dst, list_distance(a.vec, b.vec) AS distance FROM e a JOIN e b USING (family))"
A = D + ",\nm AS (SELECT family, max(distance) AS top FROM d GROUP BY family),\na AS (SELECT family, i, j, src, dst, CASE WHEN i = j THEN 0.0 ELSE 1 - distance / top END AS affinity FROM d JOIN m USING (family))"
C = E + ",\nc AS (SELECT *, (sequence_id % 3)::INTEGER AS cluster FROM e)"
CUSTOMER = "t AS (SELECT c_nationkey AS family, c_custkey AS sequence_id, (c_custkey % 3)::INTEGER AS truth, c_mktsegment AS segment, (c_acctbal > 5000)::INTEGER AS balance, (c_custkey % 6)::INTEGER AS nested FROM customer)"
DBSCAN = CUSTOMER + ",\nb AS (SELECT family, sequence_id, truth, CASE WHEN nested = 0 THEN -1 ELSE nested END AS cluster FROM t)"
RAW = "regexp_replace(text, '[ \\n\\t\\r]', '-', 'g')"
BENCHMARK = f"t0 AS (SELECT (item_id % 4)::INTEGER AS family, item_id::INTEGER AS cluster, {RAW} AS raw FROM benchmark),\nb AS (SELECT *, rpad(raw, (max(len(raw)) OVER (PARTITION BY family))::INTEGER, '-') AS seq FROM t0)"
MSA = BENCHMARK + ",\ns AS (SELECT family, cluster AS sequence_id, seq, (cluster % 3)::INTEGER AS cluster, row_number() OVER (PARTITION BY family ORDER BY cluster) - 1 AS ord FROM b)"
SCORES = "p AS (SELECT p_brand AS family, p_size AS k, round(avg(p_retailprice) / 2000, 2) AS silhouette_score, round(count(*) / 50, 2) AS adjusted_rand_index FROM part GROUP BY ALL)"
SIZES = "z AS (SELECT p_type AS family, p_brand AS cluster, count(*) AS n FROM part GROUP BY ALL)"


def _ari(name: str, rows: str, truth: str, predicted: str, keys: str) -> str:
    """A table (keys, n_sequences, ari) from contingency counts of rows."""
    on = f"USING ({keys})" if keys else "ON true"
    k, g = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""{name}_c AS (SELECT {k}{truth} AS x, {predicted} AS y, count(*)::DOUBLE AS n FROM {rows} GROUP BY ALL),
{name}_b AS (SELECT {k}sum(n * (n - 1) / 2) AS agree, sum(n) AS n FROM {name}_c {g}),
{name}_l AS (SELECT {k}sum(n * (n - 1) / 2) AS l FROM (SELECT {k}x, sum(n) AS n FROM {name}_c GROUP BY {k}x) {g}),
{name}_r AS (SELECT {k}sum(n * (n - 1) / 2) AS r FROM (SELECT {k}y, sum(n) AS n FROM {name}_c GROUP BY {k}y) {g}),
{name}_e AS (SELECT {k}n, agree, (l + r) / 2 AS top, l * r / nullif(n * (n - 1) / 2, 0) AS expected FROM {name}_b JOIN {name}_l {on} JOIN {name}_r {on}),
{name} AS (SELECT {k}n::BIGINT AS n_sequences, CASE WHEN n < 2 OR top = expected THEN 1.0 ELSE (agree - expected) / (top - expected) END AS ari FROM {name}_e)"""


COMPARISON = CUSTOMER + ",\n" + ",\n".join(_ari(f"q_{c}", "t", "truth", c, "family") for c in ("segment", "balance", "nested")) + """,
f AS (SELECT q_segment.family, q_segment.n_sequences, round(q_segment.ari, 6) + 0.0 AS "segment_ARI", round(q_balance.ari, 6) + 0.0 AS "balance_ARI", round(q_nested.ari, 6) + 0.0 AS "nested_ARI", known_cluster_number,
  CASE WHEN q_segment.family % 2 = 0 THEN 'TE' ELSE 'other' END AS "TE"
  FROM q_segment JOIN q_balance USING (family) JOIN q_nested USING (family) JOIN (SELECT family, count(DISTINCT truth) AS known_cluster_number FROM t GROUP BY family) USING (family))"""


def _summary(subset: str, where: str) -> str:
    parts = [
        f"""SELECT '{subset}' AS subset, '{m}' AS method, count("{m}_ARI") AS n_families, round(avg("{m}_ARI"), 6) + 0.0 AS "mean_ARI",
  round(sum("{m}_ARI" * n_sequences) / sum(n_sequences), 6) + 0.0 AS "sequence_weighted_mean_ARI", round(quantile_cont("{m}_ARI", 0.5), 6) + 0.0 AS "median_ARI", round(quantile_cont("{m}_ARI", 0.25), 6) + 0.0 AS "Q1", round(quantile_cont("{m}_ARI", 0.75), 6) + 0.0 AS "Q3",
  count(*) FILTER ("{m}_ARI" >= 0.9) AS "ARI_ge_0.9", count(*) FILTER ("{m}_ARI" < 0.5) AS "ARI_lt_0.5" FROM f WHERE {where} HAVING count(*) > 0"""
        for m in ("segment", "balance", "nested")
    ]
    return "\nUNION ALL ".join(parts)


RULES, CUTOFFS = {"80": "segment", "90": "balance", "95": "nested"}, [f"0.0{n}" for n in range(2, 9)]
_VARIANTS = {f"sequence_{r}": c for r, c in RULES.items()} | {f"tree_{c}": f"sequence_id % {n + 2}" for n, c in enumerate(CUTOFFS)} | {"recursive_k2": "balance", "recursive_silhouette": "segment"}
_TABLE = {v: f"m{n}" for n, v in enumerate(_VARIANTS)}


def _choice(name: str, sign: str) -> str:
    return f"""{name}_c AS (SELECT family, k, {sign}silhouette AS silhouette, ari FROM cand),
{name}_s AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY family ORDER BY silhouette DESC, k) = 1),
{name}_u AS (SELECT * FROM {name}_c QUALIFY row_number() OVER (PARTITION BY family ORDER BY ari DESC, k) = 1)"""


FAMILIES = f"""WITH {DBSCAN}, u AS (SELECT family, truth, CASE WHEN cluster = -1 THEN coalesce(max(cluster) FILTER (cluster <> -1) OVER (PARTITION BY family), -1) + row_number() OVER (PARTITION BY family, cluster = -1 ORDER BY sequence_id) ELSE cluster END AS cluster FROM b),
v AS (SELECT * FROM b WHERE cluster <> -1), {_ari("d1", "b", "truth", "cluster", "family")}, {_ari("d2", "u", "truth", "cluster", "family")}, {_ari("d3", "v", "truth", "cluster", "family")},
{", ".join(_ari(_TABLE[v], "t", "truth", e, "family") for v, e in _VARIANTS.items())},
cand AS (SELECT c_nationkey AS family, (c_custkey % 5 + 2)::INTEGER AS k, round(avg(c_acctbal) / 10000, 2) AS silhouette, round(count(*) / 100, 2) AS ari FROM customer GROUP BY ALL),
{_choice("um", "-")}, {_choice("sp", "")},
n AS (SELECT family, count(*) AS n_sequences, count(DISTINCT truth) AS known_cluster_number, {", ".join(f'count(DISTINCT {e}) AS "{v}_clusters"' for v, e in _VARIANTS.items())} FROM t GROUP BY family),
z AS (SELECT family, count(*) FILTER (cluster = -1) AS noise_count, avg((cluster = -1)::INTEGER) AS noise_rate, count(DISTINCT cluster) FILTER (cluster <> -1) AS clusters FROM b GROUP BY family)
SELECT n.family::VARCHAR AS family, n.n_sequences, known_cluster_number, n_name AS "order", CASE WHEN n.family % 2 = 0 THEN 'TE' ELSE 'other' END AS "TE",
{", ".join(f'round({_TABLE[v]}.ari, 6) + 0.0 AS "{v}_ARI", "{v}_clusters"' for v in _VARIANTS)},
noise_count AS dbscan_noise_count, round(noise_rate, 6) + 0.0 AS dbscan_noise_rate, clusters AS dbscan_clusters,
round(d1.ari, 6) + 0.0 AS "dbscan_noise_single_label_ARI", round(d2.ari, 6) + 0.0 AS "dbscan_ARI", round(d2.ari, 6) + 0.0 AS "dbscan_noise_unique_ARI", CASE WHEN d3.n_sequences >= 2 THEN round(d3.ari, 6) + 0.0 END AS "dbscan_noise_removed_ARI",
round(um_s.ari, 6) + 0.0 AS "umap_silhouette_ARI", um_s.k AS umap_silhouette_k, round(um_s.silhouette, 6) + 0.0 AS umap_silhouette_value,
round(sp_s.ari, 6) + 0.0 AS "spectral_silhouette_ARI", sp_s.k AS spectral_silhouette_k, round(sp_s.silhouette, 6) + 0.0 AS spectral_silhouette_value, round(sp_u.ari, 6) + 0.0 AS "spectral_upper_ARI", sp_u.k AS spectral_upper_k
FROM n JOIN nation ON n.family = n_nationkey JOIN z USING (family) JOIN d1 USING (family) JOIN d2 USING (family) LEFT JOIN d3 USING (family) {" ".join(f"JOIN {x} USING (family)" for x in _TABLE.values())}
JOIN um_s USING (family) JOIN sp_s USING (family) JOIN sp_u USING (family)"""

SILHOUETTE = D + """,
g AS (SELECT d.family, d.i, (d.src % 3)::INTEGER AS own, (d.dst % 3)::INTEGER AS other, avg(distance) AS mean FROM d WHERE i <> j GROUP BY ALL),
h AS (SELECT family, i, own AS cluster, min(mean) FILTER (own = other) AS a, min(mean) FILTER (own <> other) AS b FROM g GROUP BY ALL),
w AS (SELECT family, i, cluster, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM h)"""


def _assign(name: str, centres: str) -> str:
    return f"""{name}_g AS (SELECT e.family, e.ord, e.sequence_id, e.vec, k.cluster, list_sum(list_transform(range(1, len(e.vec) + 1), lambda n: (e.vec[n] - k.centre[n]) * (e.vec[n] - k.centre[n]))) AS gap FROM e JOIN {centres} k USING (family)),
{name} AS (SELECT * FROM {name}_g QUALIFY row_number() OVER (PARTITION BY family, ord ORDER BY gap, cluster) = 1)"""


def _centres(name: str, assigned: str) -> str:
    return f"""{name}_x AS (SELECT family, cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS n FROM {assigned}),
{name}_m AS (SELECT family, cluster, n, avg(x) AS x FROM {name}_x GROUP BY ALL),
{name} AS (SELECT family, cluster, list(x ORDER BY n) AS centre FROM {name}_m GROUP BY ALL)"""


START = E + ",\nk0 AS (SELECT family, ord AS cluster, vec AS centre FROM e WHERE ord < 3)"
VOTES = MSA + """,
l AS (SELECT family, cluster, ord, unnest(range(1, len(seq) + 1)) AS pos, seq FROM s),
v AS (SELECT family, cluster, pos, substr(seq, pos, 1) AS base, count(*) AS n, min(ord) AS first FROM l GROUP BY ALL),
w AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY family, cluster, pos ORDER BY n DESC, first) = 1),
k AS (SELECT family, cluster, coalesce(string_agg(base, '' ORDER BY pos) FILTER (base <> '-'), '') AS consensus, list(pos ORDER BY pos) FILTER (base <> '-') AS kept FROM w GROUP BY ALL)"""
PAIRS = BENCHMARK + """,
pairs AS (SELECT x.family, x.cluster AS c1, y.cluster AS c2, x.seq AS s1, y.seq AS s2 FROM b x JOIN b y ON x.family = y.family AND x.cluster < y.cluster),
letters AS (SELECT family, c1, c2, s1, s2, unnest(range(1, len(s1) + 1)) AS pos FROM pairs),
same AS (SELECT family, c1, c2, count(*) FILTER (substr(s1, pos, 1) <> '-' AND substr(s2, pos, 1) <> '-') AS n, count(*) FILTER (substr(s1, pos, 1) <> '-' AND substr(s1, pos, 1) = substr(s2, pos, 1)) AS hit FROM letters GROUP BY ALL),
sim AS (SELECT family, c1, c2, round(CASE WHEN n > 0 THEN hit / n ELSE 0.0 END, 6) AS similarity FROM same)"""
HITS = C + ",\n" + _centres("k", "c") + """,
h AS (SELECT c.family, c.ord, c.sequence_id, c.cluster AS own, k.cluster, round(list_sum(list_transform(range(1, len(c.vec) + 1), lambda n: c.vec[n] * k.centre[n])), 6) + 0.0 AS score FROM c JOIN k USING (family)),
best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY family, ord ORDER BY score DESC, cluster) = 1)"""
RANKED = SCORES + ",\nr AS (SELECT family, k, silhouette_score, row_number() OVER (PARTITION BY family ORDER BY silhouette_score DESC, k)::INTEGER AS rank FROM p)"

ORACLES: dict[str, str] = {
    "ari": f"WITH {_ari('q', 'lineitem', 'l_returnflag', 'l_linestatus', '')} SELECT n_sequences, round(ari, 6) + 0.0 AS adjusted_rand_index FROM q",
    "ari_by_family": f"WITH {CUSTOMER}, {_ari('q', 't', 'truth', 'segment', 'family')} SELECT family, n_sequences, round(ari, 6) + 0.0 AS adjusted_rand_index FROM q",
    "evaluate_clustering": f"WITH {CUSTOMER}, {_ari('q', 't', 'truth', 'segment', 'family')} SELECT family, n_sequences, predicted_clusters, known_subfamilies, round(ari, 6) + 0.0 AS adjusted_rand_index FROM q JOIN (SELECT family, count(DISTINCT segment) AS predicted_clusters, count(DISTINCT truth) AS known_subfamilies FROM t GROUP BY family) USING (family)",
    "cluster_counts": f"WITH {CUSTOMER} SELECT family, count(DISTINCT segment) AS predicted_clusters, count(DISTINCT truth) AS known_subfamilies FROM t GROUP BY family",
    "cluster_sizes": f"WITH {SIZES} SELECT family, cluster, n FROM z",
    "min_size_gate": f"WITH {SIZES} SELECT family, bool_and(n >= 10) AS pass_minimum_size, min(n) AS least FROM z GROUP BY family",
    "child_sizes": f"WITH {SIZES} SELECT family, string_agg(cluster || ':' || n, ';' ORDER BY cluster) AS child_sizes FROM z GROUP BY family",
    "label_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "dbscan_noise": f"WITH {DBSCAN} SELECT family, count(*) AS n_sequences, count(DISTINCT cluster) FILTER (cluster <> -1) AS predicted_clusters_excluding_noise, count(*) FILTER (cluster = -1) AS noise_count, round(avg((cluster = -1)::INTEGER), 6) + 0.0 AS noise_rate FROM b GROUP BY family",
    "dbscan_ari": f"""WITH {DBSCAN}, u AS (SELECT family, truth, CASE WHEN cluster = -1 THEN coalesce(max(cluster) FILTER (cluster <> -1) OVER (PARTITION BY family), -1) + row_number() OVER (PARTITION BY family, cluster = -1 ORDER BY sequence_id) ELSE cluster END AS cluster FROM b),
v AS (SELECT * FROM b WHERE cluster <> -1), {_ari("q1", "b", "truth", "cluster", "family")}, {_ari("q2", "u", "truth", "cluster", "family")}, {_ari("q3", "v", "truth", "cluster", "family")}
SELECT q1.family, round(q1.ari, 6) + 0.0 AS "noise_single_label_ARI", round(q2.ari, 6) + 0.0 AS "noise_unique_ARI", CASE WHEN q3.n_sequences >= 2 THEN round(q3.ari, 6) + 0.0 END AS "noise_removed_ARI" FROM q1 JOIN q2 USING (family) LEFT JOIN q3 USING (family)""",
    "family_comparison": FAMILIES,
    "method_summary": f"WITH {COMPARISON} {_summary('all families', 'true')}",
    "summary_union": f"WITH {COMPARISON} {_summary('all families', 'true')} UNION ALL {_summary('known k > 1', 'known_cluster_number > 1')} UNION ALL {_summary('known k > 1 and TE', 'known_cluster_number > 1 AND \"TE\" = $$TE$$')}",
    "summary_rounding": "SELECT p_brand, round_even(avg(p_size), 4) AS mean_size FROM part GROUP BY p_brand",
    "candidate_choice": f"""WITH {SCORES}, x AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY family ORDER BY silhouette_score DESC, k) = 1),
y AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY family ORDER BY adjusted_rand_index DESC, k) = 1)
SELECT family, x.k AS silhouette_k, x.silhouette_score AS silhouette_value, x.adjusted_rand_index AS silhouette_ari, y.k AS upper_k, y.adjusted_rand_index AS upper_ari FROM x JOIN y USING (family)""",
    "candidate_rank": f"WITH {RANKED} SELECT family, k, silhouette_score, rank FROM r",
    "reason_code": f"""WITH {RANKED}, w AS (SELECT *, CASE WHEN len(family) % 2 = 0 THEN 2 END AS won FROM r)
SELECT family, k, CASE WHEN rank <= 3 AND (won IS NULL OR rank <= won) THEN CASE WHEN rank = won THEN '' ELSE 'reassignment_accuracy_failed' END WHEN k = 7 THEN 'invalid_number_of_clusters' WHEN rank > 3 THEN 'not_in_top_k_candidates' WHEN rank > won THEN 'not_evaluated_after_acceptance' ELSE 'not_evaluated' END AS reason FROM w""",
    "accepted_splits": "SELECT o_orderpriority AS family, count(*) FILTER (o_orderstatus = 'F') AS accepted_splits FROM orders GROUP BY ALL",
    "dup_ids": "SELECT md5(text) AS sequence_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "blank_ids": "SELECT doc_id FROM documents WHERE lang = 'en'",
    "id_reconcile": "SELECT doc_id AS sequence_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)",
    "id_order": f"WITH {E}, o AS (SELECT family, sequence_id, ord, (row_number() OVER (PARTITION BY family ORDER BY sequence_id % 7, sequence_id) - 1)::INTEGER AS other FROM e) SELECT * FROM o WHERE ord <> other",
    "align_labels": "SELECT doc_id AS sequence_id, (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS ord, quality AS known_subfamily FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)",
    "label_nulls": "SELECT doc_id AS sequence_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL",
    "family_sets": " UNION ALL ".join(
        f"SELECT '{s}' AS source, family, 'missing' AS side FROM (SELECT c_custkey AS family FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = '{s}') UNION ALL SELECT '{s}', family, 'extra' FROM (SELECT o_custkey AS family FROM orders WHERE o_orderstatus = '{s}' EXCEPT SELECT c_custkey FROM customer)" for s in "FOP"
    ),
    "matrix_checks": f"WITH {D} SELECT family, count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_columns, count(*) AS n_cells, count(*) FILTER (NOT isfinite(distance)) AS n_not_finite, count(*) FILTER (distance < 0) AS n_negative, count(*) FILTER (i = j AND src <> dst) AS n_order_breaks FROM d GROUP BY family",
    "symmetry_check": f"WITH {D}, x AS (SELECT family, i, j, distance + CASE WHEN i = 1 AND j = 2 THEN 0.5 ELSE 0 END AS distance FROM d) SELECT x.family, x.i, x.j, round(abs(x.distance - y.distance), 6) + 0.0 AS difference FROM x JOIN x y ON x.family = y.family AND x.i = y.j AND x.j = y.i WHERE abs(x.distance - y.distance) > 1e-10 + 1e-7 * abs(y.distance)",
    "finite_check": f"WITH {D} SELECT family, count(*) AS n FROM d WHERE i = 3 OR j = 4 GROUP BY family",
    "msa_lengths": "SELECT lang AS family, count(*) AS n_sequences, min(len(text))::INTEGER AS least_length, max(len(text))::INTEGER AS most_length, count(DISTINCT len(text)) = 1 AS equal_lengths FROM documents GROUP BY lang",
    "id_remap_integrity": "WITH c AS (SELECT c_custkey, replace(c_name, '#', '_') AS before, replace(c_name, '#', ':') AS after FROM customer WHERE c_custkey % 50 = 0) SELECT c_custkey, before AS name, 'missing' AS side FROM c WHERE before <> after UNION ALL SELECT c_custkey, after, 'extra' FROM c WHERE before <> after",
    "used_mask": "SELECT o_orderkey, o_orderstatus = 'F' AS used FROM orders",
    "annotation_used": "SELECT o_orderkey || '_' || replace(o_orderpriority, ':', '_') AS sequence_id, o_orderstatus AS known_subfamily FROM orders WHERE o_orderstatus = 'F'",
    "public_ids": f"WITH {E} SELECT sequence_id, 'family' || family || '_seq' || CASE WHEN ord + 1 < 1000 THEN lpad((ord + 1)::VARCHAR, 3, '0') ELSE (ord + 1)::VARCHAR END AS public_id FROM e",
    "sanitize_name": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM pages",
    "subject_cluster": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN try_cast(p_type AS INTEGER) END, -1) AS cluster FROM part",
    "path_label": "WITH x AS (SELECT n_nationkey, array_to_string(list_slice([n_regionkey, n_nationkey, 1], 1, n_nationkey % 4), '-') AS p FROM nation) SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'root' ELSE p END AS path, CASE WHEN n_nationkey % 4 = 0 THEN '0' ELSE p END AS predicted_cluster FROM x",
    "scan_labels": "SELECT c_nationkey::VARCHAR AS family, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS ord, c_custkey::VARCHAR AS sequence_id, c_mktsegment || ', known' AS known_subfamily FROM customer",
    "result_tables": "SELECT c_nationkey::VARCHAR AS family, c_custkey::VARCHAR AS sequence_id, c_mktsegment AS subfamily, (c_custkey % 14)::VARCHAR AS \"140\", CASE WHEN c_acctbal >= 0 THEN '1' END AS sure FROM customer",
    "candidate_tables": f"WITH {SCORES} SELECT regexp_extract(family, '([0-9]+)', 1)::INTEGER::VARCHAR AS family, k, silhouette_score AS mean_silhouette, adjusted_rand_index FROM p",
    "family_metadata": "SELECT n_nationkey::VARCHAR AS family, n_name AS order, CASE WHEN n_regionkey = 1 THEN 'TE' END AS \"TE\" FROM nation",
    "hit_tables": "SELECT 'q' || l_orderkey AS \"Query\", l_linenumber::INTEGER AS cluster, sum(l_quantity::INTEGER::DOUBLE) AS score, (6 * count(*))::BIGINT AS ends FROM lineitem GROUP BY ALL",
    "family_files": "SELECT r_regionkey::VARCHAR AS family FROM region",
    "scan_mldist": f"WITH {D} SELECT family::VARCHAR AS family, i, j, 's' || src AS src, 's' || dst AS dst, round(distance, 6) + 0.0 AS distance FROM d",
    "matrix_csv": f"WITH {D} SELECT family::VARCHAR AS family, i, j, 's,' || src AS src, 's,' || dst AS dst, round(distance, 6) + 0.0 AS distance FROM d",
    "matrix_ids": f"WITH {E} SELECT family::VARCHAR AS family, ord, sequence_id::VARCHAR AS sequence_id FROM e",
    "scan_fasta": f"WITH {BENCHMARK} SELECT family::VARCHAR AS family, (row_number() OVER (PARTITION BY family ORDER BY cluster) - 1)::INTEGER AS ord, 's' || cluster AS sequence_id, raw AS seq FROM b",
    "fasta_files": f"WITH {BENCHMARK} SELECT family::VARCHAR AS family, (row_number() OVER (PARTITION BY family ORDER BY cluster) - 1)::INTEGER AS ord, cluster::VARCHAR AS sequence_id, seq FROM b",
    "published_names": f"WITH {D} SELECT family::VARCHAR AS family, i, j, 'family' || family || '_seq' || CASE WHEN i < 999 THEN lpad((i + 1)::VARCHAR, 3, '0') ELSE (i + 1)::VARCHAR END AS src, 'family' || family || '_seq' || CASE WHEN j < 999 THEN lpad((j + 1)::VARCHAR, 3, '0') ELSE (j + 1)::VARCHAR END AS dst, round(distance, 6) + 0.0 AS distance FROM d",
    "metrics_json": f"WITH {_ari('q', 'lineitem', 'l_returnflag', 'l_linestatus', '')} SELECT n_sequences, round(ari, 6) + 0.0 AS adjusted_rand_index, predicted_clusters, known_subfamilies FROM q, (SELECT count(DISTINCT l_linestatus) AS predicted_clusters, count(DISTINCT l_returnflag) AS known_subfamilies FROM lineitem)",
    "written_tables": "SELECT p_brand, count(*) AS n, min(p_type) AS kind FROM part GROUP BY p_brand",
    "family_lookup": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "method_join": "SELECT l_returnflag, l_linestatus, l_quantity > 25 AS many, count(*) AS n FROM (SELECT a.l_returnflag, b.l_linestatus, c.l_quantity FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) JOIN lineitem c USING (l_orderkey, l_linenumber)) GROUP BY ALL",
    "pairwise_distance": f"WITH {D} SELECT family, i, j, src, dst, round(distance, 6) + 0.0 AS distance FROM d",
    "family_dmax": f"WITH {D} SELECT family, round(max(distance), 6) + 0.0 AS maximum_distance FROM d GROUP BY family",
    "affinity": f"WITH {A} SELECT family, i, j, src, dst, round(affinity, 6) + 0.0 AS affinity FROM a",
    "submatrix": f"WITH {A} SELECT family, i, j, src, dst, round(affinity, 6) + 0.0 AS affinity FROM a WHERE src IN (SELECT sequence_id FROM e WHERE vec[1] > 0) AND dst IN (SELECT sequence_id FROM e WHERE vec[1] > 0)",
    "degree": f"WITH {A} SELECT family, i, round(sum(affinity), 6) + 0.0 AS degree FROM a GROUP BY ALL",
    "laplacian": f"WITH {A}, g AS (SELECT family, i, sum(affinity) AS s FROM a GROUP BY ALL) SELECT a.family, a.i, a.j, round((a.i = a.j)::INTEGER - affinity / sqrt(x.s * y.s), 6) + 0.0 AS laplacian FROM a JOIN g x ON a.family = x.family AND a.i = x.i JOIN g y ON a.family = y.family AND a.j = y.i",
    "silhouette": f"WITH {SILHOUETTE} SELECT family, i, cluster, round(silhouette, 6) + 0.0 AS silhouette FROM w",
    "mean_silhouette": f"WITH {SILHOUETTE} SELECT family, round(avg(silhouette), 6) + 0.0 AS mean_silhouette FROM w GROUP BY family",
    "component_count": "SELECT p_size AS family, (count(*) % 40 + 4)::INTEGER AS n, (CASE WHEN n - 1 < 21 THEN n - 2 ELSE 20 END)::INTEGER AS one_shot, least(n - 1, 20)::INTEGER AS recursive, (CASE WHEN n < 21 THEN n - 1 ELSE 20 END)::INTEGER AS fixed_binary FROM part GROUP BY p_size",
    "k_range": f"WITH {E}, g AS (SELECT family, count(*)::INTEGER AS n FROM e GROUP BY family) SELECT family, n, unnest(range(2, least(20, n // 10) + 1))::INTEGER AS k FROM g",
    "feature_prefix": f"WITH {E} SELECT sequence_id, n::INTEGER - 1 AS d, round(vec[n], 6) + 0.0 AS x FROM e, (SELECT unnest(range(1, 6)) AS n)",
    "kmeans_step": f"WITH {START}, {_assign('a1', 'k0')} SELECT family, cluster, count(*) AS n, round(sum(gap), 6) + 0.0 AS inertia FROM a1 GROUP BY ALL",
    "kmeans_lloyd": f"WITH {START}, {_assign('a1', 'k0')}, {_centres('k1', 'a1')}, {_assign('a2', 'k1')}, {_centres('k2', 'a2')}, {_assign('a3', 'k2')}, {_centres('k3', 'a3')}, {_assign('a4', 'k3')} SELECT family, sequence_id, cluster FROM a4",
    "consensus": f"WITH {VOTES} SELECT family, cluster, consensus FROM k",
    "gap_strip": f"WITH {VOTES} SELECT sequence_id, coalesce(array_to_string(list_transform(kept, lambda x: substr(seq, x, 1)), ''), '') AS seq FROM s JOIN k USING (family, cluster)",
    "aligned_identity": f"WITH {PAIRS} SELECT c1, c2, similarity + 0.0 AS identity FROM sim",
    "pair_join": f"WITH {PAIRS} SELECT family, c1, c2 FROM pairs",
    "similarity_gate": f"WITH {PAIRS}, g AS (SELECT family, min(similarity) AS least, max(similarity) AS most FROM sim GROUP BY family) SELECT family, 0.01::DOUBLE AS upper, least AS minimum_child_similarity, most AS maximum_child_similarity, coalesce(most < 0.5, true) AS pass_similarity_threshold, coalesce(least >= 0.01, true) AS pass_layer_similarity FROM (SELECT DISTINCT family FROM b) LEFT JOIN g USING (family)",
    "sibling_max": f"WITH {PAIRS} SELECT family, cluster, max(similarity) AS upper FROM (SELECT family, c1 AS cluster, similarity FROM sim UNION ALL SELECT family, c2, similarity FROM sim) GROUP BY ALL",
    "best_hit": f"WITH {HITS} SELECT family, sequence_id, cluster, score FROM best",
    "reassign_accuracy": f"WITH {HITS} SELECT family, round(count(*) FILTER (own = cluster) / count(*), 6) + 0.0 AS reassignment_accuracy FROM best GROUP BY family",
}
