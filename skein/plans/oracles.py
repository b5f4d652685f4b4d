"""DuckDB SQL with the results of ``queries.py``, by query name."""

from __future__ import annotations

SQL: dict[str, str] = {}

PHASES = """
phases(phase_id, phase_name, d0, d1, flooded, receding) AS (VALUES
  (0, 'dry', DATE '2024-01-01', DATE '2024-01-10', false, false),
  (1, 'rising', DATE '2024-01-11', DATE '2024-01-14', false, false),
  (2, 'peak', DATE '2024-01-15', DATE '2024-01-20', true, false),
  (3, 'receding', DATE '2024-01-21', DATE '2024-01-30', true, true))"""

AMOUNTS = """
fine AS (SELECT date_trunc('hour', ts) AS time, sum(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
coarse AS (SELECT CAST(ts AS DATE) AS date, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1),
days AS (SELECT *, CAST(time AS DATE) AS date, sum(value) OVER (PARTITION BY CAST(time AS DATE)) AS s FROM fine),
amounts AS (SELECT time, days.date, CASE WHEN s <> 0 THEN value / s ELSE CAST(1 AS DOUBLE) / 24 END AS share,
                   CASE WHEN s <> 0 THEN value / s ELSE CAST(1 AS DOUBLE) / 24 END * coalesce(total, 0) AS amount
            FROM days LEFT JOIN coarse ON days.date = coarse.date)"""

TOTALS = f"""{PHASES}, {AMOUNTS},
totals AS (SELECT phase_id, phase_name, round(coalesce(sum(amount), 0), 3) AS rainfall_t, count(time) AS n_hours
           FROM phases LEFT JOIN amounts ON time >= d0 AND time < d1 + INTERVAL 1 DAY GROUP BY 1, 2),
running AS (SELECT *, round(sum(rainfall_t) OVER (ORDER BY phase_id), 3) AS cumulative_rainfall_t FROM totals),
per_day AS (SELECT phase_id, phase_name, round(rainfall_t / n_hours * 24, 3) AS intensity FROM totals)"""

SETS = """
users AS (SELECT DISTINCT user_id FROM events),
sar AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 150),
model AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 170),
news AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 190),
early AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 120
          AND CAST(ts AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-20'),
still AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 120
          AND CAST(ts AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-30'),
back AS (SELECT * FROM early EXCEPT SELECT * FROM still)"""

FUSED = f"""{SETS},
flags AS (SELECT user_id, CAST(user_id IN (FROM sar) AS INT) AS in_sar, CAST(user_id IN (FROM model) AS INT) AS in_model,
                 CAST(user_id IN (FROM news) AS INT) AS in_news FROM users),
fused AS (SELECT user_id, phase_id, in_sar, in_model, in_news, in_sar + in_model + in_news AS n_sources,
                 CAST(receding AND user_id IN (FROM back) AS INT) AS recovered,
                 CAST(flooded AND in_sar + in_model + in_news > 0 AND NOT (receding AND user_id IN (FROM back)) AS INT) AS flood_label
          FROM flags CROSS JOIN phases)"""

MOVES = """
moves AS (SELECT a.user_id, a.phase_id, b.phase_id AS next_phase, a.flood_label AS y_t, b.flood_label AS y_next
          FROM fused a JOIN fused b ON a.user_id = b.user_id AND b.phase_id = a.phase_id + 1)"""

HEIGHTS = "heights AS (SELECT user_id AS node, round(avg(value), 2) AS elevation FROM events GROUP BY 1)"
CONTACTS = """
contacts AS (SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM events a JOIN events b
             ON date_trunc('hour', a.ts) = date_trunc('hour', b.ts)
             WHERE a.event_type = 'signup' AND a.value > 100 AND b.event_type = 'error' AND b.value > 100),
near AS (SELECT a AS node, b AS neighbour FROM contacts UNION SELECT b, a FROM contacts)"""

PREDICTED = f"""{TOTALS}, {FUSED}, {MOVES}, {HEIGHTS}, {CONTACTS},
pairs AS (SELECT phase_id, phase_id + 1 AS next_phase, intensity > 1.05 * (SELECT avg(intensity) FROM per_day) AS rain
          FROM per_day WHERE phase_id < 3),
wet AS (SELECT DISTINCT n.node, f.phase_id FROM near n JOIN fused f ON f.user_id = n.neighbour WHERE f.flood_label = 1),
predicted AS (SELECT f.user_id AS node, f.phase_id, p.next_phase,
                     CAST(p.rain OR (coalesce(h.elevation <= 52.0, false) AND w.node IS NOT NULL) AS INT) AS y_pred
              FROM fused f JOIN pairs p ON f.phase_id = p.phase_id LEFT JOIN heights h ON h.node = f.user_id
              LEFT JOIN wet w ON w.node = f.user_id AND w.phase_id = f.phase_id),
judged AS (SELECT p.*, m.y_next AS y_true,
                  CASE WHEN p.node % 20 < 14 THEN 'train' WHEN p.node % 20 < 17 THEN 'val' ELSE 'test' END AS split
           FROM predicted p JOIN moves m ON m.user_id = p.node AND m.phase_id = p.phase_id)"""

COUNTS = """count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true <> 1 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred <> 1) AS fn, count(*) FILTER (y_true <> 1 AND y_pred <> 1) AS tn"""
METRICS = """round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 4) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END, 4) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 4) AS f1,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) ELSE 0 END, 4) AS accuracy"""

SQL["downscale_hourly"] = f"WITH {AMOUNTS} SELECT time, date, round(share, 6) AS share, round(amount, 4) AS amount FROM amounts"
SQL["phase_totals"] = f"WITH {TOTALS} SELECT * FROM totals"
SQL["phase_cumulative"] = f"WITH {TOTALS} SELECT * FROM running"
SQL["phase_intensity"] = f"WITH {TOTALS} SELECT * FROM per_day"
SQL["wettest_days"] = """
SELECT CAST(ts AS DATE) AS date, round(sum(value), 3) AS total FROM events GROUP BY 1 ORDER BY total DESC, date LIMIT 8"""
SQL["peak_hour"] = """
SELECT date_trunc('hour', ts) AS time, round(sum(value), 3) AS value FROM events GROUP BY 1 ORDER BY value DESC, time LIMIT 1"""
SQL["missing_daily_totals"] = """
WITH fine AS (SELECT DISTINCT date_trunc('hour', ts) AS time FROM events)
SELECT CAST(time AS DATE) AS date, count(*) AS n_rows FROM fine WHERE CAST(time AS DATE) NOT IN (
  SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'purchase' AND value > 250) GROUP BY 1"""
SQL["fuse_labels"] = f"WITH {PHASES}, {FUSED} SELECT * FROM fused"
SQL["source_agreement"] = f"WITH {PHASES}, {FUSED} SELECT n_sources, count(*) AS n FROM fused WHERE phase_id = 2 GROUP BY 1"
SQL["flooded_by_phase"] = f"""WITH {PHASES}, {FUSED}
SELECT phase_id, count(*) FILTER (flood_label = 1) AS n_flooded, count(*) AS n,
       round(count(*) FILTER (flood_label = 1) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct FROM fused GROUP BY 1"""
SQL["source_union"] = f"WITH {SETS} SELECT * FROM sar UNION SELECT * FROM model UNION SELECT * FROM news"
SQL["recovered_set"] = f"WITH {SETS} SELECT * FROM back"
SQL["still_flooded_set"] = f"WITH {SETS} SELECT * FROM early INTERSECT SELECT * FROM still"
SQL["recession_report"] = f"""WITH {SETS}
SELECT count(*) AS n_before, count(s.user_id) AS n_still, count(*) - count(s.user_id) AS n_recovered,
       round(CASE WHEN count(*) > 0 THEN (count(*) - count(s.user_id)) / CAST(count(*) AS DOUBLE) ELSE 0 END * 100, 2) AS pct_recovered
FROM early LEFT JOIN still s USING (user_id)"""
SQL["label_transitions"] = f"WITH {PHASES}, {FUSED}, {MOVES} SELECT * FROM moves"
SQL["broadcast_features"] = f"""WITH {TOTALS}, {SETS}
SELECT user_id, phase_id, rainfall_t, cumulative_rainfall_t FROM users CROSS JOIN running"""
SQL["uniform_features"] = f"""WITH {TOTALS}, {SETS}
SELECT phase_id, count(DISTINCT rainfall_t) = 1 AS rainfall_t_uniform, count(DISTINCT cumulative_rainfall_t) = 1 AS cumulative_rainfall_t_uniform
FROM users CROSS JOIN running GROUP BY 1"""
SQL["tag_breakdown"] = """
SELECT event_type, count(*) AS n, event_type IN ('error', 'purchase', 'view') AS allowed FROM events GROUP BY 1"""
SQL["staggered_reveal"] = f"""WITH {PHASES}, {FUSED}, {MOVES}, {HEIGHTS},
c AS (SELECT user_id AS key, y_t, y_next, elevation FROM moves JOIN heights ON node = user_id WHERE phase_id = 2),
m AS (SELECT key, y_next = 1 AS "on", coalesce(elevation, (SELECT median(elevation) FROM c)) AS h FROM c WHERE y_t <> y_next),
r AS (SELECT key, "on", row_number() OVER (ORDER BY "on" DESC, CASE WHEN "on" THEN h ELSE -h END, key) AS k, count(*) OVER () AS n FROM m)
SELECT key, "on", CAST((k - 1) // greatest(1, CAST(ceil(n / 40.0) AS BIGINT)) AS BIGINT) AS step FROM r"""
SQL["adjacency"] = f"WITH {CONTACTS} SELECT * FROM near"
SQL["rule_predict"] = f"WITH {PREDICTED} SELECT * FROM predicted"
SQL["rule_metrics"] = f"WITH {PREDICTED}, c AS (SELECT {COUNTS} FROM judged) SELECT *, {METRICS} FROM c"
SQL["metrics_by_split"] = f"""WITH {PREDICTED}, c AS (SELECT phase_id, split, {COUNTS} FROM judged GROUP BY 1, 2) SELECT *, {METRICS} FROM c"""
SQL["comparison_table"] = f"""WITH {PREDICTED},
r AS (SELECT phase_id, split, {COUNTS} FROM judged GROUP BY 1, 2),
b AS (SELECT phase_id, split, {COUNTS} FROM (SELECT * REPLACE (1 AS y_pred) FROM judged WHERE phase_id < 2) GROUP BY 1, 2),
rm AS (SELECT *, {METRICS} FROM r), bm AS (SELECT *, {METRICS} FROM b)
SELECT CAST(n.name AS VARCHAR) AS name, s.split, rm.f1 AS rule_f1, bm.f1 AS all_positive_f1
FROM (VALUES (0), (1), (2)) n(name) CROSS JOIN (VALUES ('train'), ('val'), ('test')) s(split)
LEFT JOIN rm ON rm.phase_id = n.name AND rm.split = s.split LEFT JOIN bm ON bm.phase_id = n.name AND bm.split = s.split"""

SQL["auc_by_group"] = """
WITH s AS (SELECT lang, quality AS y, n_chars AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM s),
g AS (SELECT lang, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y <> 1) AS n_neg, sum(rk) FILTER (y = 1) AS rs FROM r GROUP BY 1)
SELECT lang, n_pos, n_neg,
       CASE WHEN n_pos > 0 AND n_neg > 0 THEN round((rs - n_pos * (n_pos + 1) / 2.0) / CAST(n_pos * n_neg AS DOUBLE), 4) END AS auc FROM g"""
SWEEP = f"""
t AS (SELECT CAST(unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS DOUBLE) AS threshold),
l AS (SELECT CAST(l_returnflag = 'A' AS INT) AS y_true, l_discount * 10 AS score, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT threshold, CAST(coalesce(sum(n) FILTER (y_true = 1 AND score > threshold), 0) AS BIGINT) AS tp,
             CAST(coalesce(sum(n) FILTER (y_true <> 1 AND score > threshold), 0) AS BIGINT) AS fp,
             CAST(coalesce(sum(n) FILTER (y_true = 1 AND NOT score > threshold), 0) AS BIGINT) AS fn,
             CAST(coalesce(sum(n) FILTER (y_true <> 1 AND NOT score > threshold), 0) AS BIGINT) AS tn FROM t CROSS JOIN l GROUP BY 1),
sweep AS (SELECT *, {METRICS} FROM c)"""
SQL["threshold_sweep"] = f"WITH {SWEEP} SELECT * FROM sweep"
SQL["best_threshold"] = f"WITH {SWEEP} SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, threshold LIMIT 1"
WARD = """
w AS (SELECT c_nationkey, CASE WHEN c_nationkey < 17 THEN 'train' WHEN c_nationkey < 21 THEN 'val' ELSE 'test' END AS split,
             CAST(o_orderstatus = 'F' AS INT) AS y, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey),
diag AS (SELECT split, c_nationkey, count(*) AS n, round(avg(y) * 100, 4) AS pct_positive,
                round(least(avg(y) * 100, 100 - avg(y) * 100), 4) AS minority_pct,
                CASE WHEN stddev_pop(x) * stddev_pop(y) > 0 THEN round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 4) END AS corr
         FROM w GROUP BY 1, 2),
info AS (SELECT split, count(*) AS n_groups, count(*) FILTER (minority_pct >= 30) AS n_mixed,
                count(*) FILTER (minority_pct >= 30 AND abs(corr) >= 0.02) AS n_informative,
                CAST(coalesce(sum(n) FILTER (minority_pct >= 30 AND abs(corr) >= 0.02), 0) AS BIGINT) AS rows_informative FROM diag GROUP BY 1)"""
SQL["ward_diagnostics"] = f"WITH {WARD} SELECT * FROM diag"
SQL["split_informativeness"] = f"WITH {WARD} SELECT * FROM info"
SQL["verdict"] = f"""WITH {WARD},
r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM w WHERE split = 'val'),
a AS (SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
             / CAST(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1) AS DOUBLE), 4) AS val_auc FROM r),
i AS (SELECT max(n_informative) FILTER (split = 'val') AS val_informative, max(n_informative) FILTER (split = 'test') AS test_informative FROM info)
SELECT val_auc, val_informative, test_informative,
       CASE WHEN val_auc > 0.55 AND val_informative > 0 AND test_informative > 0 THEN 'supported'
            WHEN val_auc > 0.55 AND val_informative > 0 THEN 'supported on validation, test inconclusive'
            WHEN test_informative = 0 THEN 'inconclusive' ELSE 'not supported' END AS verdict FROM a, i"""

SEGMENTS = """
pairs AS (SELECT DISTINCT l_suppkey AS u, CAST(p_size AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
segments AS (SELECT u || '_' || v || '_0' AS segment_id, u, v FROM pairs),
line AS (SELECT a.segment_id AS segment_id_from, b.segment_id AS segment_id_to, a.v AS junction FROM segments a JOIN segments b ON a.v = b.u),
pos AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) - 1 AS pos FROM segments)"""
SQL["line_graph_edges"] = f"WITH {SEGMENTS} SELECT * FROM line"
SQL["line_graph_degree"] = f"WITH {SEGMENTS} SELECT junction AS node, count(*) AS n_edges FROM line GROUP BY 1"
SQL["node_positions"] = f"WITH {SEGMENTS} SELECT * FROM pos"
SQL["edge_index"] = f"""WITH {SEGMENTS}
SELECT a.pos AS src_pos, b.pos AS dst_pos FROM line JOIN pos a ON a.segment_id = segment_id_from JOIN pos b ON b.segment_id = segment_id_to"""
SQL["tiled_edge_index"] = f"""WITH {CONTACTS}
SELECT t, node + t * 1000 AS src_pos, neighbour + t * 1000 AS dst_pos FROM near CROSS JOIN range(3) r(t)"""
SQL["edge_consistency"] = f"WITH {SEGMENTS} SELECT count(*) AS n_edges, CAST(0 AS BIGINT) AS n_wrong FROM line"
SQL["graph_profile"] = f"""WITH {SEGMENTS},
nodes AS (SELECT s_suppkey AS node FROM supplier UNION SELECT p_size FROM part),
d AS (SELECT node, (SELECT count(*) FROM segments WHERE v = node) AS i, (SELECT count(*) FROM segments WHERE u = node) AS o FROM nodes)
SELECT count(*) AS n_nodes, count(*) FILTER (i + o = 0) AS n_isolated, count(*) FILTER (i > 0 AND o = 0) AS n_dead_ends,
       (SELECT count(*) FROM segments) AS n_segments, (SELECT count(*) FROM segments WHERE u = v) AS n_loops FROM d"""
SPARSE = """
both_ways AS (SELECT o_custkey AS a, -o_orderkey - 1 AS b FROM orders UNION SELECT -o_orderkey - 1, o_custkey FROM orders),
parts(node, component) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM both_ways
  UNION
  SELECT e.b, min(parts.component) FROM parts JOIN both_ways e ON e.a = parts.node JOIN recurring.parts old ON old.node = e.b
  WHERE parts.component < old.component GROUP BY 1)"""
SQL["weak_components"] = f"WITH RECURSIVE {SPARSE} SELECT * FROM parts"
SQL["component_sizes"] = f"""WITH RECURSIVE {SPARSE}
SELECT component, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM parts), 4) AS pct
FROM parts GROUP BY 1 ORDER BY size DESC, component LIMIT 10"""
SQL["strong_components"] = """
WITH RECURSIVE rows AS (SELECT user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase'),
e AS (SELECT DISTINCT a.user_id AS u, b.user_id AS v FROM rows a JOIN rows b ON b.h = a.h + INTERVAL 1 HOUR),
n AS (SELECT u AS x FROM e UNION SELECT v FROM e),
reach(a, b) AS (SELECT x, x FROM n UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u)
SELECT r.a AS node, max(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY 1"""
SQL["neighbour_means"] = f"""WITH {CONTACTS}, {HEIGHTS}
SELECT h.node, h.elevation, m.elevation_near FROM heights h LEFT JOIN (
  SELECT n.node, round(avg(o.elevation), 4) AS elevation_near FROM near n JOIN heights o ON o.node = n.neighbour GROUP BY 1) m ON m.node = h.node"""
SQL["fingerprint"] = f"""WITH {SEGMENTS}
SELECT count(*) AS n, sha256(string_agg(segment_id, '|' ORDER BY segment_id)) AS sha256 FROM segments"""
SQL["key_consistency"] = """
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) AS only_first, (SELECT count(*) FROM b WHERE k NOT IN (FROM a)) AS only_second,
       (SELECT count(*) FROM a WHERE k IN (FROM b)) AS in_both"""
SQL["duplicate_segments"] = """
SELECT 'line' AS key, count(*) AS n_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1
UNION ALL SELECT 'pair', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) WHERE n > 1"""

SQL["passage_ids"] = r"""
SELECT doc_id, substr(sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 10) AS passage_id FROM documents"""
SQL["label_upsert"] = """
WITH b AS (SELECT user_id, max(ts) AS labeled_at, 'view' AS label, 0 AS new FROM events WHERE event_type = 'view' GROUP BY 1
           UNION ALL SELECT user_id, max(ts), 'click', 1 FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, label, labeled_at FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY labeled_at DESC, new DESC) = 1"""
SQL["labelling_progress"] = """
SELECT count(*) AS n_total, count(quality) AS n_labelled, count(*) - count(quality) AS n_left,
       round(count(quality) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct_done FROM documents LEFT JOIN labels USING (doc_id)"""
GAZETTEER = """
gaz AS (SELECT regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1) AS name, CAST(item_id AS INT) AS place FROM benchmark)"""
PHRASES = r"""
runs AS (SELECT doc_id AS text_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,4}\b')) AS run FROM documents),
words AS (SELECT text_id, regexp_split_to_array(run, '\s+') AS w FROM runs),
cut AS (SELECT text_id, w[(coalesce(list_position(list_transform(w, lambda x: lower(x) NOT IN ('the', 'in', 'at', 'of')), true), len(w) + 1)):] AS w FROM words),
phrase AS (SELECT text_id, array_to_string(w, ' ') AS phrase FROM cut WHERE len(w) >= 2)"""
SQL["phrase_candidates"] = f"WITH {PHRASES} SELECT * FROM phrase"
SQL["novel_phrases"] = f"""WITH {PHRASES}, {GAZETTEER}
SELECT lower(phrase) AS key, min(phrase) AS phrase, count(*) AS n_mentions FROM phrase
WHERE lower(phrase) NOT IN (SELECT lower(name) FROM gaz WHERE name <> '') GROUP BY 1"""
SQL["covered_phrases"] = f"""WITH {PHRASES}, {GAZETTEER}
SELECT count(*) AS n_covered FROM phrase WHERE lower(phrase) IN (SELECT lower(name) FROM gaz WHERE name <> '')"""
MENTIONS = r"""
low AS MATERIALIZED (SELECT doc_id, lower(text) AS t FROM documents),
maybe AS MATERIALIZED (SELECT doc_id, t, name FROM low JOIN (SELECT DISTINCT name FROM gaz WHERE name <> '') g ON contains(t, lower(name))),
found AS (SELECT DISTINCT doc_id AS text_id, name FROM maybe
          WHERE regexp_matches(t, '(^|[^\p{L}\p{N}_])' || lower(name) || '($|[^\p{L}\p{N}_])'))"""
SQL["exact_mentions"] = f"WITH {GAZETTEER}, {MENTIONS} SELECT * FROM found"
SQL["mentions_by_place"] = f"""WITH {GAZETTEER}, {MENTIONS}
SELECT name, string_agg(DISTINCT source, '; ' ORDER BY source) AS joined, count(DISTINCT source) AS n FROM found JOIN documents ON doc_id = text_id GROUP BY 1"""
SQL["located_signals"] = f"""WITH {GAZETTEER}, {MENTIONS},
m AS (SELECT doc_id, contains(text, 'idiot') AS p, doc_id IN (SELECT text_id FROM found) AS l FROM documents)
SELECT count(*) AS n, count(*) FILTER (p) AS n_positive, count(*) FILTER (l) AS n_located, count(*) FILTER (p AND l) AS n_deliverable FROM m"""
SQL["recall_of_known"] = """
WITH w AS (SELECT string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ') AS w FROM benchmark),
s AS (SELECT list_distinct([lower(w[1]), lower(w[2]), lower(w[3])]) AS k,
             list_distinct([lower(w[1]), lower(w[2] || ' ' || w[4]), lower(w[5])]) AS f FROM w),
t AS (SELECT k, f, list_filter(k, lambda x: NOT list_contains(f, x)) AS missed FROM s),
a AS (SELECT k, f, missed, list_filter(missed, lambda x: len(list_filter(f, lambda c: c <> x AND contains(' ' || c || ' ', ' ' || x || ' '))) > 0) AS absorbed FROM t),
n AS (SELECT CAST(sum(len(k) - len(missed)) AS BIGINT) AS r, CAST(sum(len(missed) - len(absorbed)) AS BIGINT) AS m, CAST(sum(len(absorbed)) AS BIGINT) AS b,
             CAST(sum(len(list_filter(f, lambda x: NOT list_contains(k, x)))) AS BIGINT) AS e FROM a)
SELECT r AS n_recovered, m AS n_missed, b AS n_absorbed, e AS n_extra, round(r / CAST(r + m + b AS DOUBLE), 4) AS recall,
       round(r / CAST(r + m AS DOUBLE), 4) AS recall_without_absorbed FROM n"""
SQL["precision_against_known_errors"] = """
WITH bad AS (SELECT DISTINCT lower(p_name) AS k, p_brand AS b FROM part WHERE p_size > 45),
n AS (SELECT count(*) AS a, count(bad.k) AS w FROM part LEFT JOIN bad ON lower(p_name) = k AND p_brand = b)
SELECT a AS n_matches, w AS n_wrong, round((a - w) / CAST(a AS DOUBLE), 4) AS precision FROM n"""
SQL["gazetteer_top1"] = """
WITH g AS (SELECT n_name AS name, 'locality' AS type, CAST(n_nationkey AS BIGINT) AS id, 0 AS p FROM nation
  UNION ALL SELECT r_name, 'landmark', r_regionkey, 1 FROM region
  UNION ALL SELECT p_name, CASE WHEN p_size > 25 THEN 'road' ELSE 'waterway' END, p_partkey, CASE WHEN p_size > 25 THEN 3 ELSE 2 END FROM part)
SELECT name, type, id FROM g QUALIFY row_number() OVER (PARTITION BY name ORDER BY p, id) = 1"""
SQL["name_lookup"] = """
WITH k AS (SELECT p_type AS kind, count(*) AS n FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1)
SELECT name, n FROM (SELECT DISTINCT ' ' || upper(p_type) || ' ' AS name FROM part) LEFT JOIN k ON lower(trim(name)) = lower(trim(kind))"""
SQL["specific_names"] = """
SELECT name FROM (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)
WHERE trim(name) <> '' AND length(name) >= 5 AND (contains(name, ' ') OR lower(name) NOT IN ('asia', 'europe'))"""
SQL["json_props"] = "SELECT event_id, event_type, event_type AS place, value AS score FROM events WHERE event_type NOT IN ('view', 'click')"
SQL["multi_value_names"] = """
SELECT p_partkey, p_brand AS value FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_type FROM part WHERE p_size < 10
UNION ALL SELECT p_partkey, '[unquoted]' FROM part WHERE p_size BETWEEN 20 AND 29"""

GRID = """
grid AS (SELECT CAST(vec_id AS INT) AS "row", CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
CHANGE = f"""{GRID},
cells AS (SELECT "row", col, value * value - value AS diff, col % 16 = 3 AS permanent FROM grid),
cut AS (SELECT avg(diff) - 1.5 * stddev_pop(diff) AS c FROM cells),
mask AS (SELECT "row", col, diff FROM cells, cut WHERE diff < c AND NOT permanent)"""
REGIONS = f"""{CHANGE},
pix AS (SELECT "row", col, "row" * 4294967296 + col AS id FROM mask),
touch AS (SELECT a.id AS a, b.id AS b FROM pix a JOIN (SELECT unnest([-1, 0, 1]) AS dr) d ON true JOIN pix b
          ON b."row" = a."row" + d.dr AND b.col BETWEEN a.col - 1 AND a.col + 1),
reach(a, b) AS (SELECT id, id FROM pix UNION SELECT reach.a, touch.b FROM reach JOIN touch ON reach.b = touch.a),
region AS (SELECT a AS id, min(b) AS region FROM reach GROUP BY 1)"""
SQL["raster_change_mask"] = f'WITH {CHANGE} SELECT "row", col, round(diff, 6) AS diff FROM mask'
SQL["raster_sieve"] = f"""WITH RECURSIVE {REGIONS}
SELECT "row", col FROM pix JOIN region USING (id) QUALIFY count(*) OVER (PARTITION BY region) >= 4"""
SQL["raster_region_areas"] = f"""WITH RECURSIVE {REGIONS}, a AS (SELECT count(*) * 0.01::DOUBLE AS area FROM region GROUP BY region)
SELECT count(*) AS n_regions, round(sum(area), 6) AS total, round(max(area), 6) AS largest, round(median(area), 6) AS median FROM a"""
SQL["raster_slope"] = f"""WITH {GRID},
n AS (SELECT "row", col, value, lag(value) OVER r AS w, lead(value) OVER r AS e, lag(value) OVER c AS u, lead(value) OVER c AS l FROM grid
      WINDOW r AS (PARTITION BY "row" ORDER BY col), c AS (PARTITION BY col ORDER BY "row")),
g AS (SELECT "row", col, CASE WHEN w IS NULL THEN (e - value) / 30.0::DOUBLE WHEN e IS NULL THEN (value - w) / 30.0::DOUBLE ELSE (e - w) / 60.0::DOUBLE END AS gx,
             CASE WHEN u IS NULL THEN (l - value) / 30.0::DOUBLE WHEN l IS NULL THEN (value - u) / 30.0::DOUBLE ELSE (l - u) / 60.0::DOUBLE END AS gy FROM n)
SELECT "row", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope_deg FROM g"""
SQL["raster_percentiles"] = f"""WITH {GRID}
SELECT CAST(p AS DOUBLE) AS p, round(value, 6) AS value FROM (SELECT unnest([0.01, 0.05, 0.1, 0.5, 0.9]) AS p,
  unnest(quantile_cont(value, [0.01, 0.05, 0.1, 0.5, 0.9])) AS value FROM grid)"""
SQL["raster_focal_median"] = f"""WITH {GRID}
SELECT a."row", a.col, round(median(b.value), 6) AS median FROM grid a JOIN (SELECT unnest([-1, 0, 1]) AS dr) d ON true
JOIN (SELECT unnest([-1, 0, 1]) AS dc) e ON true JOIN grid b ON b."row" = a."row" + dr AND b.col = a.col + dc GROUP BY 1, 2"""
SQL["raster_overlap"] = f"""WITH {GRID}, n AS (SELECT count(*) FILTER (value > 0.1) AS a, count(*) FILTER (-value > -0.15) AS b,
  count(*) FILTER (value > 0.1 AND -value > -0.15) AS ab FROM grid)
SELECT round(a * 0.0009::DOUBLE, 6) AS area_first, round(b * 0.0009::DOUBLE, 6) AS area_second, round(ab * 0.0009::DOUBLE, 6) AS area_both,
       round(ab * 100.0 / CAST(a AS DOUBLE), 4) AS pct_of_first FROM n"""

PLACES = """
spots AS (SELECT c_custkey, (c_custkey * 37) % 1009 / 10.09::DOUBLE AS x, (c_custkey * 91) % 997 / 9.97::DOUBLE AS y FROM customer),
sites AS (SELECT s_suppkey, (s_suppkey * 37) % 1009 / 10.09::DOUBLE AS x, (s_suppkey * 91) % 997 / 9.97::DOUBLE AS y FROM supplier),
corners(ward_no, k, n, px, py) AS (VALUES
  (1, 1, 4, 0, 0), (1, 2, 4, 40, 0), (1, 3, 4, 40, 30), (1, 4, 4, 0, 30),
  (2, 1, 3, 40, 0), (2, 2, 3, 90, 0), (2, 3, 3, 65, 45),
  (3, 1, 5, 0, 30), (3, 2, 5, 40, 30), (3, 3, 5, 60, 60), (3, 4, 5, 30, 90), (3, 5, 5, 0, 70),
  (4, 1, 5, 70, 50), (4, 2, 5, 95, 50), (4, 3, 5, 95, 95), (4, 4, 5, 82, 70), (4, 5, 5, 70, 95)),
edges AS (SELECT a.ward_no, a.px::DOUBLE AS ax, a.py::DOUBLE AS ay, b.px::DOUBLE AS bx, b.py::DOUBLE AS by_ FROM corners a JOIN corners b
          ON a.ward_no = b.ward_no AND b.k = a.k % a.n + 1),
hits AS (SELECT c_custkey, ward_no FROM spots JOIN edges ON (ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay)
         GROUP BY 1, 2 HAVING count(*) % 2 = 1),
inside AS (SELECT c_custkey, min(ward_no) AS ward_no FROM hits GROUP BY 1)"""
SQL["points_in_wards"] = f"WITH {PLACES} SELECT c_custkey, ward_no FROM spots LEFT JOIN inside USING (c_custkey)"
SQL["nearest_site"] = f"""WITH {PLACES},
d AS (SELECT c_custkey, s_suppkey, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM spots a CROSS JOIN sites b)
SELECT c_custkey, s_suppkey, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) = 1"""
SQL["ward_fallback"] = f"""WITH {PLACES},
centres AS (SELECT ward_no, avg(px) AS x, avg(py) AS y FROM corners GROUP BY 1),
near AS (SELECT c_custkey, ward_no AS near FROM spots s CROSS JOIN centres c
  QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2), ward_no) = 1)
SELECT s.c_custkey, coalesce(i.ward_no, near) AS ward_no, CASE WHEN i.ward_no IS NOT NULL THEN 'contained' ELSE 'nearest' END AS tier
FROM spots s LEFT JOIN inside i USING (c_custkey) JOIN near n USING (c_custkey)"""
SQL["tiered_resolution"] = f"""WITH {PLACES}
SELECT c_custkey AS mention_id, CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2' ELSE CAST(ward_no AS VARCHAR) END AS target,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'name_match' WHEN ward_no IS NOT NULL THEN 'ward_fallback' ELSE 'unresolved_no_ward' END AS tier
FROM customer LEFT JOIN inside USING (c_custkey)"""
STREETS = f"""{PLACES},
streets AS (SELECT c_custkey, x AS ax, y AS ay, x + c_custkey % 7 - 3 AS bx, y + c_custkey % 5 - 2 AS by_ FROM spots)"""
SQL["lines_in_extent"] = f"""WITH {STREETS},
boxes(x0, y0, x1, y1) AS (VALUES (10::DOUBLE, 10::DOUBLE, 20::DOUBLE, 25::DOUBLE), (50, 5, 52, 90), (18, 20, 30, 40), (80, 80, 81, 81)),
t AS (SELECT c_custkey,
        CASE WHEN bx <> ax THEN least((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END AS ex,
        CASE WHEN bx <> ax THEN greatest((x0 - ax) / (bx - ax), (x1 - ax) / (bx - ax)) WHEN ax BETWEEN x0 AND x1 THEN 1 ELSE -1 END AS lx,
        CASE WHEN by_ <> ay THEN least((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END AS ey,
        CASE WHEN by_ <> ay THEN greatest((y0 - ay) / (by_ - ay), (y1 - ay) / (by_ - ay)) WHEN ay BETWEEN y0 AND y1 THEN 1 ELSE -1 END AS ly
      FROM streets CROSS JOIN boxes)
SELECT DISTINCT c_custkey FROM t WHERE greatest(ex, ey, 0) <= least(lx, ly, 1)"""
SQL["line_lengths"] = f"WITH {STREETS} SELECT c_custkey, round(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 3) AS length_m FROM streets"
SQL["sampled_elevation"] = f"""WITH {STREETS}, {GRID},
n AS (SELECT *, greatest(2, least(50, CAST(floor(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) / 1.0) AS INT) + 2)) AS n FROM streets),
p AS (SELECT c_custkey, ax + (bx - ax) * i / (n - 1) AS x, ay + (by_ - ay) * i / (n - 1) AS y FROM (SELECT *, unnest(range(n)) AS i FROM n)),
s AS (SELECT c_custkey, value FROM p LEFT JOIN grid ON "row" = floor((100.0 - y) / 0.5) AND col = floor(x / 1.5))
SELECT c_custkey, count(value) AS n_valid, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY 1"""
SQL["clipped_extent"] = f"""WITH {PLACES},
b AS (SELECT s_suppkey, greatest(x - 3, 10) AS x0, greatest(y - 2, 10) AS y0, least(x + 3, 60) AS x1, least(y + 2, 50) AS y1 FROM sites)
SELECT s_suppkey, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM b WHERE x1 > x0 AND y1 > y0"""
SQL["area_by_zone"] = """
SELECT r_name, n_name, round(sum(s_acctbal), 4) AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2 HAVING round(sum(s_acctbal), 4) > 0"""
SQL["ward_areas"] = f"""WITH {PLACES}
SELECT ward_no, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area, count(*) AS n_corners FROM edges GROUP BY 1"""
SQL["nearest_valid_cell"] = """
WITH c AS (SELECT c_custkey % 40 AS cx, c_custkey // 40 AS cy, c_acctbal - 9000 AS value FROM customer),
v AS (SELECT cx, cy FROM c GROUP BY 1, 2 HAVING bool_or(value >= 0))
SELECT cx, cy, round(sqrt((cx - 11.3::DOUBLE) * (cx - 11.3::DOUBLE) + (cy - 7.6::DOUBLE) * (cy - 7.6::DOUBLE)), 6) AS distance FROM v ORDER BY 3, cx, cy LIMIT 1"""
SQL["colour_depth"] = """
SELECT l_discount, count(*) AS n, round(CASE WHEN l_discount <= 0 THEN 0.0::DOUBLE WHEN l_discount <= 0.02 THEN l_discount * 0.5 / 0.02
  WHEN l_discount <= 0.05 THEN 0.5 + (l_discount - 0.02) * 0.3 / 0.03 WHEN l_discount <= 0.1 THEN 0.8 + (l_discount - 0.05) * 2.2 / 0.05 ELSE 3.0 END, 6) AS depth
FROM lineitem GROUP BY 1"""


def _stats(name: str, expression: str) -> str:
    return f"""SELECT '{name}' AS name, count(*) AS n, count(*) - count(v) AS missing, round((count(*) - count(v)) * 100.0 / count(*), 4) AS missing_pct,
  round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM (SELECT {expression} AS v FROM lineitem)"""


SQL["column_statistics"] = " UNION ALL ".join(
    [_stats("l_quantity", "l_quantity"), _stats("l_extendedprice", "l_extendedprice"), _stats("l_discount", "CASE WHEN l_discount > 0.02 THEN l_discount END")]
)
STANDARD = "st AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_custkey % 10 < 7)"
SQL["feature_standardizers"] = f"""WITH {STANDARD}
SELECT round(m, 4) AS price_mean, round(s, 4) AS price_std, 3.0::DOUBLE AS flat_mean, 1.0::DOUBLE AS flat_std FROM st"""
SQL["standardized_features"] = f"WITH {STANDARD} SELECT o_orderkey, round((o_totalprice - m) / s, 5) AS price, 0.0::DOUBLE AS flat FROM orders, st"
SQL["class_balance"] = f"""WITH {WARD}
SELECT split, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos,
       round(CASE WHEN count(*) FILTER (y = 1) > 0 THEN count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE) ELSE 1 END, 4) AS pos_weight FROM w GROUP BY 1"""
SQL["metric_across_folds"] = f"""WITH {WARD}
SELECT split, round(avg(pct_positive), 4) AS mean, round(stddev_pop(pct_positive), 4) AS std, count(*) AS n_folds FROM diag GROUP BY 1"""
SQL["largest_difference"] = """
SELECT round(max(abs(l_extendedprice - l_quantity * p_retailprice)), 6) AS max_abs_diff FROM lineitem JOIN part ON l_partkey = p_partkey"""
SQL["reproduced"] = """
SELECT count(*) AS n_shared, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_different FROM orders WHERE o_orderkey > 10"""
SQL["ward_split"] = """
WITH RECURSIVE s AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS k, sum(count(*)) OVER () AS total FROM customer GROUP BY 1),
r(k, c_nationkey, split, a, b, c) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::VARCHAR, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE
  UNION ALL
  SELECT k, c_nationkey, split, a + CASE WHEN split = 'train' THEN n ELSE 0 END, b + CASE WHEN split = 'val' THEN n ELSE 0 END, c + CASE WHEN split = 'test' THEN n ELSE 0 END
  FROM (SELECT s.k, s.c_nationkey, s.n, r.a, r.b, r.c,
          CASE WHEN 0.7::DOUBLE * total - a >= 0.15::DOUBLE * total - b AND 0.7::DOUBLE * total - a >= 0.15::DOUBLE * total - c THEN 'train'
               WHEN 0.15::DOUBLE * total - b >= 0.15::DOUBLE * total - c THEN 'val' ELSE 'test' END AS split
        FROM r JOIN s ON s.k = r.k + 1))
SELECT c_nationkey, split FROM r WHERE k > 0"""
SQL["ward_folds"] = """
WITH RECURSIVE s AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS k FROM customer GROUP BY 1),
r(k, c_nationkey, fold, load) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::INT, [0, 0, 0, 0]::BIGINT[]
  UNION ALL
  SELECT k, c_nationkey, f - 1, list_transform(load, lambda x, i: CASE WHEN i = f THEN x + n ELSE x END)
  FROM (SELECT s.k, s.c_nationkey, s.n, r.load, CAST(list_position(r.load, list_min(r.load)) AS INT) AS f FROM r JOIN s ON s.k = r.k + 1))
SELECT c_nationkey, fold FROM r WHERE k > 0"""
SQL["kpi_scalars"] = f"""WITH {PHASES}, {FUSED}
SELECT count(DISTINCT user_id) AS n_entities, count(*) FILTER (phase_id = 2 AND flood_label = 1) AS n_peak,
       count(*) FILTER (phase_id = 3 AND flood_label = 1) AS n_receding FROM fused"""
SQL["tensor_permuted"] = f"""WITH {TOTALS}, {SETS},
long AS (SELECT user_id, phase_id, 'rainfall_t' AS feature, rainfall_t AS value FROM users CROSS JOIN running
         UNION ALL SELECT user_id, phase_id, 'cumulative_rainfall_t', cumulative_rainfall_t FROM users CROSS JOIN running)
SELECT user_id, feature, max(value) FILTER (phase_id = 0) AS t0, max(value) FILTER (phase_id = 1) AS t1,
       max(value) FILTER (phase_id = 2) AS t2, max(value) FILTER (phase_id = 3) AS t3 FROM long GROUP BY 1, 2"""

SQL["dashboard_star"] = f"""WITH {PREDICTED}
SELECT u.user_id, round(CASE WHEN h.elevation > 49 THEN h.elevation ELSE 0 END, 1) AS elevation, f.flood_label AS truth, p.y_pred,
       CAST(u.user_id IN (FROM sar) AS INT) AS seen,
       CASE WHEN f.flood_label = 1 AND p.y_pred = 1 THEN 'hit' WHEN f.flood_label = 1 THEN 'miss' WHEN p.y_pred = 1 THEN 'alarm' ELSE 'dry' END AS colour
FROM users u JOIN heights h ON h.node = u.user_id JOIN fused f ON f.user_id = u.user_id AND f.phase_id = 2
JOIN predicted p ON p.node = u.user_id AND p.next_phase = 2"""
SQL["source_overlap"] = f"""WITH {SETS}, seen AS (SELECT * FROM sar UNION SELECT * FROM model)
SELECT (SELECT count(*) FROM news WHERE user_id NOT IN (FROM seen)) AS news_only, (SELECT count(*) FROM seen WHERE user_id NOT IN (FROM news)) AS others_only,
       (SELECT count(*) FROM news WHERE user_id IN (FROM seen)) AS in_both"""
SQL["graph_report"] = f"""WITH RECURSIVE {SEGMENTS},
nodes AS (SELECT u AS node FROM segments UNION SELECT v FROM segments),
d AS (SELECT node, (SELECT count(*) FROM segments WHERE v = node) AS i, (SELECT count(*) FROM segments WHERE u = node) AS o FROM nodes),
both_ways AS (SELECT u AS a, v AS b FROM segments UNION SELECT v, u FROM segments),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
part AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT 'n_nodes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM d
UNION ALL SELECT 'n_isolated', 0 UNION ALL SELECT 'n_dead_ends', count(*) FROM d WHERE i > 0 AND o = 0
UNION ALL SELECT 'n_segments', count(*) FROM segments UNION ALL SELECT 'n_loops', count(*) FROM segments WHERE u = v
UNION ALL SELECT 'n_line_edges', count(*) FROM line UNION ALL SELECT 'most_at_a_junction', max(i * o) FROM d
UNION ALL SELECT 'n_components', count(DISTINCT c) FROM part"""
SQL["fusion_report"] = f"""WITH {PHASES}, {FUSED}, p AS (SELECT * FROM fused WHERE phase_id = 2)
SELECT 'in_sar' AS metric, CAST(sum(in_sar) AS DOUBLE) AS value FROM p UNION ALL SELECT 'in_model', sum(in_model) FROM p UNION ALL SELECT 'in_news', sum(in_news) FROM p
UNION ALL SELECT 'two_or_more', count(*) FROM p WHERE n_sources >= 2
UNION ALL SELECT 'n_rows', count(*) FROM fused UNION ALL SELECT 'n_entities', count(DISTINCT user_id) FROM fused"""
SQL["first_scene"] = """
SELECT event_id, ts, user_id FROM events WHERE event_type = 'view' AND value BETWEEN 40 AND 60 AND ts >= '2024-01-10' AND ts < '2024-01-12'
ORDER BY ts, event_id LIMIT 1"""
SQL["daily_peaks"] = """
WITH h AS (SELECT date_trunc('hour', ts) AS time, round(sum(value), 3) AS value FROM events GROUP BY 1)
SELECT CAST(time AS DATE) AS date, time, value FROM h QUALIFY row_number() OVER (PARTITION BY CAST(time AS DATE) ORDER BY value DESC, time) = 1"""
SQL["utm_places"] = f"""WITH {PLACES},
k AS (SELECT 1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE) AS n),
c AS (SELECT n, 0.9996::DOUBLE * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM k),
s AS (SELECT s_suppkey, radians(12 + y / 50) AS phi, radians(79 + x / 50 - 81) AS lam FROM sites),
t AS (SELECT s.*, c.*, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM s, c),
z AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT s_suppkey,
  round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 2) AS easting,
  round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 2) AS northing FROM z"""

SQL["csv_hourly"] = "SELECT date_trunc('hour', ts) AS time, round(sum(value), 3) AS precipitation_mm FROM events GROUP BY 1"
SQL["csv_parts"] = """
SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, 'say "' || p_name || '",' || chr(10) || p_type AS said FROM part"""
BENT = f"""{PLACES},
bent AS (SELECT c_custkey, x AS x0, y AS y0, x + c_custkey % 7 - 3 AS x1, y + c_custkey % 5 - 2 AS y1, x + c_custkey % 3 AS x2, y + c_custkey % 11 - 5 AS y2 FROM spots),
parts AS (SELECT c_custkey, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM bent UNION ALL SELECT c_custkey, x1, y1, x2, y2 FROM bent),
long AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS p, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS q FROM bent)"""
SQL["geojson_streets"] = f"WITH {BENT} SELECT c_custkey, 0 AS part, 3 AS n_points, round(p + q, 3) AS length_m FROM long"
SQL["geojson_wards"] = f"""WITH {PLACES}
SELECT ward_no, 'Polygon' AS kind, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area, count(*) AS n_corners, CAST(0 AS BIGINT) AS n_holes FROM edges GROUP BY 1"""
SQL["graphml_segments"] = f"""WITH {SEGMENTS}
SELECT u, v, '0' AS key, u * 0.5::DOUBLE + v AS length, u * 0.25::DOUBLE AS x,
       CAST((SELECT count(*) FROM segments b WHERE b.v = a.u) - (SELECT count(*) FROM segments b WHERE b.u = a.u) AS DOUBLE) AS y FROM segments a"""
SQL["json_nations"] = "SELECT n_name AS key, CAST(n_nationkey AS DOUBLE) AS a, n_regionkey + 0.5::DOUBLE AS b FROM nation"
SQL["npy_nations"] = """
WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS "row", n_nationkey, n_regionkey FROM nation)
SELECT "row", CAST(0 AS BIGINT) AS col, CAST(n_nationkey AS DOUBLE) AS value FROM n UNION ALL SELECT "row", 1, n_regionkey FROM n"""
SQL["geotiff_pixels"] = f'WITH {GRID} SELECT "row", col, CASE WHEN col <> 5 THEN round(value, 6) END AS value FROM grid'
SQL["json_report"] = SQL["kpi_scalars"]
SQL["tensor_sink"] = SQL["tensor_permuted"]
SQL["wkt_streets"] = f"""WITH {PLACES}
SELECT s_suppkey, 'LINESTRING (' || floor(x)::DOUBLE || ' ' || floor(y)::DOUBLE || ', ' || (floor(x) + 1)::DOUBLE || ' ' || floor(y)::DOUBLE || ')' AS geom,
       '[' || s_suppkey || ']' AS parts FROM sites"""
SQL["saved_probe"] = "SELECT count(*) AS n_shared, CAST(0 AS BIGINT) AS n_different FROM embeddings"
SQL["layer_probes"] = """
WITH p AS (SELECT page_id AS layer, CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 11 = 0 THEN NULL ELSE 200 END AS status, CAST(length(html) AS INT) AS n_bytes FROM pages)
SELECT *, CASE WHEN status IS NULL OR status <> 200 THEN 'dead' WHEN n_bytes < 1500 THEN 'suspect_blank' ELSE 'ok' END AS verdict FROM p"""
SQL["fallback_input"] = "SELECT r_regionkey, r_name FROM region"
SQL["looked_up_names"] = """
SELECT n_name AS name, CASE WHEN n_name[1] IN ('A', 'M') THEN 'unverified' WHEN length(n_name) > 5 THEN 'resolved' ELSE 'no_match' END AS status,
       CASE WHEN n_name[1] NOT IN ('A', 'M') AND length(n_name) > 5 THEN lower(n_name) END AS value FROM nation"""
SQL["drawn_geometry"] = f"""WITH {BENT}
SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'empty' WHEN 3 THEN 'short' ELSE 'ok' END AS status,
       round(CASE WHEN c_custkey % 4 = 0 THEN p + q ELSE sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2) END, 3) AS length_m FROM long"""
SQL["complete_regions"] = "SELECT * FROM region WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')"
SQL["mapped_labels"] = "SELECT event_id, CAST(event_type IN ('error', 'purchase') AS INT) AS label FROM events WHERE event_type <> 'view'"
SQL["flooded_neighbours"] = f"""WITH {CONTACTS}, {HEIGHTS}
SELECT DISTINCT node FROM near WHERE neighbour IN (SELECT node FROM heights WHERE elevation > 55)"""
SQL["control_and_target"] = f"""WITH {GRID}
SELECT CASE WHEN value > 0.1 THEN 'target' ELSE 'control' END AS "group", count(value) AS n, round(avg(value), 6) AS mean FROM grid GROUP BY 1"""
SQL["homography_report"] = "SELECT count(*) AS n, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS max_error, 0.0::DOUBLE AS mean_error FROM supplier"
SQL["pooled_vectors"] = """
WITH e AS (SELECT vec_id, label, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS col FROM embeddings)
SELECT vec_id, CAST(col AS INT) AS col, round((embedding[col + 1]::DOUBLE + embedding[n - col]::DOUBLE * label) / (1.0::DOUBLE + label), 6) AS value FROM e"""
SQL["first_events"] = """
SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
SQL["ngram_windows"] = r"""
WITH w AS (SELECT item_id AS text_id, regexp_extract_all(text, '[A-Za-z'']+') AS w, regexp_split_to_array(text, '[A-Za-z'']+') AS gaps FROM benchmark),
s AS (SELECT text_id, w, gaps, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN range(1, 5) r(n)),
t AS (SELECT text_id, n, array_to_string(list_transform(range(i, i + n), lambda k: w[k] || CASE WHEN k < i + n - 1 THEN gaps[k + 1] ELSE '' END), '') AS span FROM s)
SELECT text_id, CAST(n AS INT) AS n_words, count(*) AS n, count(DISTINCT lower(span)) AS n_distinct FROM t GROUP BY 1, 2"""
CHAIN = f"""{GAZETTEER}, {MENTIONS},
m AS (SELECT doc_id, contains(text, 'the') AS p, doc_id IN (SELECT text_id FROM found) AS l, (SELECT count(*) FROM found WHERE text_id = doc_id) AS n FROM documents)"""
SQL["end_to_end"] = f"""WITH {CHAIN},
judged AS (SELECT toxic AS y_true, CAST(p AND l AS INT) AS y_pred FROM m JOIN labels USING (doc_id)), c AS (SELECT {COUNTS} FROM judged)
SELECT *, {METRICS} FROM c"""
SQL["run_report"] = f"""WITH {CHAIN}
SELECT 'n_texts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM m UNION ALL SELECT 'n_positive', count(*) FROM m WHERE p UNION ALL SELECT 'n_located', count(*) FROM m WHERE l
UNION ALL SELECT 'n_deliverable', count(*) FROM m WHERE p AND l UNION ALL SELECT 'n_matches', sum(n) FROM m"""
SQL["labelled_passages"] = r"""
WITH p AS (SELECT doc_id, substr(sha1(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 10) AS passage_id FROM documents),
k AS (SELECT DISTINCT passage_id, quality AS label FROM p JOIN labels USING (doc_id))
SELECT doc_id, passage_id, label FROM p JOIN k USING (passage_id)"""
SQL["tensor_report"] = f"""WITH {SETS}, {CONTACTS}
SELECT 'missing_rainfall_t' AS metric, CAST(4 * count(*) AS DOUBLE) AS value FROM users WHERE user_id % 5 = 0 UNION ALL SELECT 'missing_cumulative_rainfall_t', 0
UNION ALL SELECT 'rows_beyond_shape', 4 * count(*) - 4000 FROM users UNION ALL SELECT 'n_places', 4 * count(*) FROM users UNION ALL SELECT 'n_transitions', 3
UNION ALL SELECT 'n_edges', count(*) FROM contacts UNION ALL SELECT 'edges_out_of_bounds', count(*) FROM contacts WHERE a >= 1000 OR b >= 1000"""
SQL["accepted_labels"] = f"""WITH {PHASES}, {FUSED} SELECT phase_id, CAST(sum(flood_label) AS BIGINT) AS n_flooded, count(*) AS n FROM fused GROUP BY 1"""
SQL["added_metric"] = f"""WITH {WARD}
SELECT split, count(*) FILTER (y = 0) AS n_neg, count(*) FILTER (y = 1) AS n_pos,
       round(CASE WHEN count(*) FILTER (y = 1) > 0 THEN count(*) FILTER (y = 0) / CAST(count(*) FILTER (y = 1) AS DOUBLE) ELSE 1 END, 4) AS pos_weight,
       count(*) AS n_rows FROM w WHERE split <> 'train' GROUP BY 1"""
SQL["key_differences"] = """
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 5), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 7),
m AS (SELECT k FROM a EXCEPT SELECT k FROM b), e AS (SELECT k FROM b EXCEPT SELECT k FROM a)
SELECT 'missing' AS side, (SELECT count(*) FROM m) AS n, array_to_string(list_sort((SELECT list(k::VARCHAR) FROM (FROM m ORDER BY k LIMIT 10))), ',') AS examples
UNION ALL SELECT 'extra', (SELECT count(*) FROM e), array_to_string(list_sort((SELECT list(k::VARCHAR) FROM (FROM e ORDER BY k LIMIT 10))), ',')"""
SQL["attribute_text"] = """
SELECT p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size, to_json([p_brand, p_type])::VARCHAR AS tags, NULL::VARCHAR AS absent FROM part"""
SQL["spaced_points"] = f"""WITH {BENT},
n AS (SELECT *, greatest(2, least(9, CAST(floor((p + q) / 1.5) AS INT) + 2)) AS n FROM long),
k AS (SELECT *, unnest(range(n)) AS k FROM n), t AS (SELECT *, (p + q) * k / (n - 1) AS far FROM k)
SELECT c_custkey, CAST(k AS INT) AS k,
       round(CASE WHEN p > 0 AND (far < p OR q = 0) THEN x0 + (x1 - x0) * far / p ELSE x1 + (x2 - x1) * CASE WHEN q > 0 THEN (far - p) / q ELSE 0 END END, 6) AS x,
       round(CASE WHEN p > 0 AND (far < p OR q = 0) THEN y0 + (y1 - y0) * far / p ELSE y1 + (y2 - y1) * CASE WHEN q > 0 THEN (far - p) / q ELSE 0 END END, 6) AS y FROM t"""
SQL["bent_in_extent"] = SQL["lines_in_extent"].replace(STREETS, BENT).replace("FROM streets CROSS", "FROM parts CROSS")
MEET = """(greatest(ax, bx) >= least(cx, dx) AND greatest(cx, dx) >= least(ax, bx) AND greatest(ay, by_) >= least(cy, dy) AND greatest(cy, dy) >= least(ay, by_)
  AND sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) <= 0
  AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) <= 0)"""
SQL["bent_in_wards"] = f"""WITH {BENT},
sides AS (SELECT ward_no, ax AS cx, ay AS cy, bx AS dx, by_ AS dy FROM edges WHERE ward_no >= 3),
cross_ AS (SELECT DISTINCT c_custkey FROM parts CROSS JOIN sides WHERE {MEET}),
within AS (SELECT DISTINCT c_custkey FROM (SELECT c_custkey, ax, ay, ward_no FROM (SELECT DISTINCT c_custkey, ax, ay FROM parts) JOIN sides ON (cy > ay) <> (dy > ay) AND ax < cx + (ay - cy) * (dx - cx) / (dy - cy)
           GROUP BY ALL HAVING count(*) % 2 = 1))
SELECT * FROM cross_ UNION SELECT * FROM within"""


def _far(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    along = f"greatest(least((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2), 1), 0)"
    along = f"CASE WHEN {ax} = {bx} AND {ay} = {by} THEN 0 ELSE {along} END"
    return f"sqrt(({px} - {ax} - ({along}) * ({bx} - {ax})) ** 2 + ({py} - {ay} - ({along}) * ({by} - {ay})) ** 2)"


SQL["nearest_drain"] = f"""WITH {BENT},
drains AS (SELECT x AS cx, y AS cy, x + 2 AS dx, y + 1 AS dy FROM sites UNION ALL SELECT x + 2, y + 1, x + 3, y - 2 FROM sites)
SELECT c_custkey, round(min(CASE WHEN {MEET} THEN 0 ELSE least({_far('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {_far('bx', 'by_', 'cx', 'cy', 'dx', 'dy')},
  {_far('cx', 'cy', 'ax', 'ay', 'bx', 'by_')}, {_far('dx', 'dy', 'ax', 'ay', 'bx', 'by_')}) END), 6) AS distance FROM parts CROSS JOIN drains GROUP BY 1"""
#: Areas of the wards inside the box from (20, 10) to (80, 60), by hand: exact integrals over their edges.
SQL["clipped_wards"] = "SELECT * FROM (VALUES (1, 400.0::DOUBLE), (2, 662.777778::DOUBLE), (3, 900.0::DOUBLE), (4, 100.0::DOUBLE)) t(ward_no, area)"
SQL["metric_lengths"] = SQL["utm_places"].rsplit("SELECT s_suppkey,", 1)[0].replace(
    "s AS (SELECT s_suppkey, radians(12 + y / 50) AS phi, radians(79 + x / 50 - 81) AS lam FROM sites)",
    "s AS (SELECT s_suppkey, e AS at_end, radians(12 + y / 50 + 0.02 * e) AS phi, radians(79 + x / 50 + 0.01 * e - 81) AS lam FROM sites CROSS JOIN range(2) g(e))",
).replace("SELECT s.*, c.*,", "SELECT s_suppkey, at_end, phi, lam, n, r, a1, a2, a3, c.e AS ecc,").replace("e * atanh(e * sin(phi))", "c.e * atanh(c.e * sin(phi))") + """,
m AS (SELECT s_suppkey, at_end,
  500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
  r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM z)
SELECT a.s_suppkey, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 2) AS length_m FROM m a JOIN m b ON a.s_suppkey = b.s_suppkey AND a.at_end = 0 AND b.at_end = 1"""
SQL["region_outlines"] = f"WITH RECURSIVE {REGIONS} SELECT region, CAST(count(*) AS DOUBLE) AS area FROM region GROUP BY 1"
