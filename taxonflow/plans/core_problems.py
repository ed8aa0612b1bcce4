"""Queries of the general data problems (p2, p3, p4) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxonflow.operators import hierarchy, integrity, skew
from taxonflow.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys(table(spark, d, "hit_count"), "tax_id", "score", 0.01).select(F.col("key").alias("tax_id"))


def p2_hit_profile(spark: SparkSession, d: str) -> DataFrame:
    p = skew.profile(table(spark, d, "hit_count"), "tax_id", "score", {"score_p50": 0.5, "score_p95": 0.95})
    return p.select(F.col("key").alias("tax_id"), "n_rows", F.col("value_sum").alias("score_sum"), F.col("n_distinct").alias("n_scores"), F.col("mode").alias("mode_score"), "score_p50", "score_p95")


def p2_read_totals(spark: SparkSession, d: str) -> DataFrame:
    p = skew.profile(table(spark, d, "read_counts"), "tax_id", "n_reads", {"median_reads": 0.5})
    return p.select(F.col("key").alias("tax_id"), "n_rows", F.col("value_sum").alias("n_reads"), F.col("n_distinct").alias("n_values"), F.col("mode").alias("mode_reads"), "median_reads")


def _p3(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    to_taxid, to_pos, nodes = (table(spark, d, n) for n in ("ac_to_taxid", "ac_to_pos", "taxonomy_node"))
    ac = integrity.normalised(F.col("ac"))
    taxa = to_taxid.where("taxid <> 0")
    return {
        "ac_to_taxid.ac": (integrity.references(to_taxid, ac, "map_id", "loaded_at"), integrity.lifetimes(to_pos, ac, "loaded_at", "removed_at")),
        "ac_to_taxid.taxid": (integrity.references(taxa, F.col("taxid"), "map_id", "loaded_at"), nodes.select(F.col("tid").alias("key"))),
        "ac_to_pos.ac": (integrity.references(to_pos, ac, "pos_id", "loaded_at"), to_taxid.select(ac.alias("key"))),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, (refs, targets) in _p3(spark, d).items():
        found = integrity.not_alive(refs, targets) if name == "ac_to_taxid.ac" else integrity.without_target(refs, targets)
        parts.append(integrity.named(found, name))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p3_orphan_months(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    parts = []
    for name, (refs, targets) in _p3(spark, d).items():
        if name == "ac_to_taxid.ac":
            counted = integrity.per_period(integrity.not_alive(refs, targets))
        else:
            counted = integrity.orphan_counts(refs, targets)
        parts.append(counted.select(F.lit(name).alias("ref_name"), "ref_month", "n_refs", "key"))
    cols = [p.withColumn("key", F.col("key").cast("string")) for p in parts]
    whole = cols[0].unionByName(cols[1]).unionByName(cols[2])
    return whole.groupBy("ref_name", "ref_month").agg(F.sum("n_refs").alias("n_refs"), F.count("key").alias("n_key_months"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.endless(table(spark, d, "taxonomy_node"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, d, "taxonomy_node"))
    return h.select("tid", "parent_tid", "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "n_descendants", "cycle_tid")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "taxonomy_node")
    return hierarchy.descendants(hierarchy.resolve(hierarchy.links(hierarchy.valid_lines(nodes)))).select(F.col("anc_tid"), F.col("tid"), F.col("distance"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_hit_profile, p2_read_totals, p3_found, p3_orphan_months, p4_found, p4_hierarchy, p4_descendants)}


def _profile_sql(t: str, value: str, columns: str, shares: dict[str, float]) -> str:
    picks = ", ".join(f"min(CASE WHEN upto >= greatest(1, ceil({s} * total)) THEN v END) AS {n}" for n, s in shares.items())
    return f"""
        WITH w AS (SELECT tax_id AS k, {value} AS v, count(*) AS c FROM {t} GROUP BY 1, 2),
        t AS (SELECT k, sum(c) AS n_rows, sum(v * c) AS s, count(v) AS nd, arg_max(v, c * 1000000000000 - v) FILTER (WHERE v IS NOT NULL) AS mode FROM w GROUP BY 1),
        o AS (SELECT k, v, sum(c) OVER (PARTITION BY k ORDER BY v) AS upto, sum(c) OVER (PARTITION BY k) AS total FROM w WHERE v IS NOT NULL),
        p AS (SELECT k, {picks} FROM o GROUP BY 1)
        SELECT t.k AS tax_id, {columns} FROM t LEFT JOIN p ON t.k IS NOT DISTINCT FROM p.k"""


VALID = "v AS (SELECT tid, arg_min(struct_pack(p := parent_tid), line_no).p AS parent_tid FROM taxonomy_node WHERE tid IS NOT NULL GROUP BY tid)"
LINK = "l AS (SELECT a.tid, a.parent_tid AS given, b.tid AS parent_tid FROM v a LEFT JOIN v b ON a.parent_tid = b.tid AND a.parent_tid <> a.tid AND a.parent_tid <> 0)"
WALK = "w AS (SELECT tid, parent_tid, given, tid AS root, CAST(0 AS BIGINT) AS depth, CAST(tid AS VARCHAR) AS path FROM l WHERE parent_tid IS NULL UNION ALL SELECT l.tid, l.parent_tid, l.given, w.root, w.depth + 1, w.path || '/' || l.tid FROM l JOIN w ON l.parent_tid = w.tid)"
# Nodes no walk from a root reaches: follow their links as many steps as there are such nodes, once to get onto the cycle and once round it.
LOST = "x AS (SELECT l.tid, l.parent_tid FROM l WHERE l.tid NOT IN (SELECT tid FROM w)), go AS (SELECT tid, parent_tid AS nxt, 1 AS n FROM x UNION ALL SELECT go.tid, x.parent_tid, n + 1 FROM go JOIN x ON go.nxt = x.tid WHERE n < (SELECT count(*) FROM x)), onto AS (SELECT tid, nxt FROM go WHERE n = (SELECT count(*) FROM x)), cyc AS (SELECT onto.tid, least(onto.nxt, min(go.nxt)) AS cycle_tid FROM onto JOIN go ON go.tid = onto.nxt GROUP BY onto.tid, onto.nxt)"


def oracle_sql() -> dict[str, str]:
    key = "upper(trim({}, ' \t\r\n'))"
    refs = f"""
        SELECT 'ac_to_taxid.ac' AS ref_name, strftime(r.loaded_at, '%Y-%m') AS ref_month, r.map_id AS row_id, {key.format("r.ac")} AS k
        FROM ac_to_taxid r WHERE r.ac IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ac_to_pos p WHERE {key.format("p.ac")} = {key.format("r.ac")} AND p.loaded_at <= r.loaded_at AND (p.removed_at IS NULL OR p.removed_at > r.loaded_at))
        UNION ALL SELECT 'ac_to_taxid.taxid', strftime(r.loaded_at, '%Y-%m'), r.map_id, CAST(r.taxid AS VARCHAR)
        FROM ac_to_taxid r WHERE r.taxid <> 0 AND NOT EXISTS (SELECT 1 FROM taxonomy_node n WHERE n.tid = r.taxid)
        UNION ALL SELECT 'ac_to_pos.ac', strftime(r.loaded_at, '%Y-%m'), r.pos_id, {key.format("r.ac")}
        FROM ac_to_pos r WHERE r.ac IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ac_to_taxid p WHERE {key.format("p.ac")} = {key.format("r.ac")})"""
    return {
        "p2_found": "SELECT tax_id FROM hit_count GROUP BY 1 HAVING tax_id IS NOT NULL AND count(*) >= 0.01 * (SELECT count(*) FROM hit_count)",
        "p2_hit_profile": _profile_sql("hit_count", "score", "CAST(n_rows AS BIGINT) AS n_rows, CAST(s AS BIGINT) AS score_sum, nd AS n_scores, mode AS mode_score, score_p50, score_p95", {"score_p50": 0.5, "score_p95": 0.95}),
        "p2_read_totals": _profile_sql("read_counts", "n_reads", "CAST(n_rows AS BIGINT) AS n_rows, CAST(s AS BIGINT) AS n_reads, nd AS n_values, mode AS mode_reads, median_reads", {"median_reads": 0.5}),
        "p3_found": f"SELECT DISTINCT ref_name, ref_month, row_id FROM ({refs})",
        "p3_orphan_months": f"SELECT ref_name, ref_month, count(*) AS n_refs, count(DISTINCT k) AS n_key_months FROM ({refs}) GROUP BY 1, 2",
        "p4_found": f"WITH RECURSIVE {VALID}, {LINK}, {WALK}, {LOST} SELECT cycle_tid, tid FROM cyc",
        "p4_hierarchy": f"""WITH RECURSIVE {VALID}, {LINK}, {WALK}, {LOST},
            below AS (SELECT b.a AS tid, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM w) b GROUP BY 1)
            SELECT w.tid, w.given AS parent_tid, w.root, w.depth, w.path, below.n AS n_descendants, CAST(NULL AS BIGINT) AS cycle_tid FROM w JOIN below ON below.tid = CAST(w.tid AS VARCHAR)
            UNION ALL SELECT l.tid, l.given, NULL, NULL, NULL, NULL, cyc.cycle_tid FROM cyc JOIN l ON l.tid = cyc.tid""",
        "p4_descendants": f"""WITH RECURSIVE {VALID}, {LINK}, {WALK}
            SELECT CAST(e.anc AS BIGINT) AS anc_tid, e.tid, e.depth - e.i + 1 AS distance FROM (SELECT tid, depth, unnest(string_split(path, '/')) AS anc, unnest(range(1, depth + 2)) AS i FROM w) e""",
    }
