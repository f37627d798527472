"""The same results as plain SQL over all point pairs, for comparison at small scale."""

from __future__ import annotations

import math

from densegrid.functions.geometry import COIN_DST, COIN_MOD, COIN_SRC
from densegrid.operators.silhouette import error_bound
from densegrid.queries import EPS, MIN_PTS, PARTS, RHO, SEED
from densegrid.sources.blobs import HEX_DIGITS, UNIT
from densegrid.sources.points import ELEMENTS, signed


def num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def emb(d: int) -> str:
    """Whole vectors for d = 64, else signed sums over all elements."""
    if d == ELEMENTS:
        sums = [f"CAST(embedding[{k + 1}] AS DOUBLE)" for k in range(d)]
    else:
        sums = [
            "(" + "".join(
                (" + " if signed(k, j) > 0 else " - ") * (j > 0) + f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(ELEMENTS)
            ) + f") / {math.sqrt(ELEMENTS)!r}e0"
            for k in range(1, d + 1)
        ]
    return "SELECT vec_id AS point_id, " + ", ".join(f"{s} AS x{k}" for k, s in enumerate(sums)) + " FROM embeddings"


POINTS = {
    "emb3": emb(3),
    "emb4": emb(4),
    "emb64": emb(64),
    "part2": "SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part",
    "order2": "SELECT o_custkey AS point_id, CAST(count(*) AS DOUBLE) AS x0, "
              "CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS x1 FROM orders GROUP BY o_custkey "
              "HAVING count(CASE WHEN o_orderstatus = 'F' THEN 1 END) > 0",
    "cust1": "SELECT c_custkey AS point_id, c_acctbal AS x0 FROM customer",
    "supp2": "SELECT s_suppkey AS point_id, s_acctbal / 1000e0 AS x0, CAST(s_nationkey AS DOUBLE) AS x1 FROM supplier",
    "user2": "SELECT user_id AS point_id, CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE) / count(value) AS x0, CAST(count(*) AS DOUBLE) AS x1 FROM events GROUP BY user_id",
}


def dims(name: str) -> range:
    return range(int(name.lstrip("abcdefghijklmnopqrstuvwxyz")))


def listed(fmt: str, name: str, sep: str = ", ") -> str:
    return sep.join(fmt.format(k=k) for k in dims(name))


def dist(name: str) -> str:
    return "sqrt(" + listed("(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})", name, " + ") + ")"


def same(name: str) -> str:
    return listed("a.x{k} = b.x{k}", name, " AND ")


def horner(name: str, what: str, size: str) -> str:
    out = what.format(k=0)
    for k in dims(name)[1:]:
        out = f"({out}) * {size.format(k=k)} + {what.format(k=k)}"
    return out


class Sql:
    """Named subqueries of one clustering run, put together on demand."""

    def __init__(self, name: str, grid: str = "stretched", rule: str = "strict", policy: str = "never",
                 cell_points: str = "core", numbered: bool = True):
        gid = f"CAST({horner(name, 'c{k}', 'n{k}')} AS BIGINT)"
        if not numbered:  # too many cells for linear ids: a cell is named by its smallest point
            gid = f"min(point_id) OVER (PARTITION BY {listed('c{k}', name)})"
        eps, d = EPS[name], len(dims(name))
        side = f"({num(eps)} / sqrt({num(float(d))}))"
        outer = eps if policy == "never" else eps * (1 + RHO)
        whole = "CAST(floor((hi{k} - lo{k}) / " + side + ") AS BIGINT)"
        count = f"greatest(1, {whole})" if grid == "stretched" else f"{whole} + 1"
        width = "(hi{k} - lo{k}) / n{k}" if grid == "stretched" else side
        cell = ("CASE WHEN w{k} = 0 THEN 0 ELSE least(n{k} - 1, greatest(0, "
                "CAST(floor((x{k} - lo{k}) / w{k}) AS BIGINT))) END AS c{k}")
        near = f"{dist(name)} <= {num(eps)}"
        match = near if rule == "standard" else f"{near} AND NOT ({same(name)})"
        coin = f"((src * {COIN_SRC} + dst * {COIN_DST} + {SEED}) % {COIN_MOD}) % 2 = 1"
        keep = {"never": "TRUE", "always": "TRUE", "seeded": f"min_dist <= {num(eps)} OR {coin}"}[policy]
        linked = "core" if cell_points == "core" else "(SELECT * FROM flags WHERE gid IN (SELECT gid FROM core))"
        self.name = name
        self.parts = [
            ("p", POINTS[name]),
            ("bounds", f"SELECT {listed('min(x{k}) AS lo{k}, max(x{k}) AS hi{k}', name)} FROM p"),
            ("sizes", f"SELECT *, {', '.join(count.format(k=k) + f' AS n{k}' for k in dims(name))} FROM bounds"),
            ("layout", f"SELECT *, {', '.join(width.format(k=k) + f' AS w{k}' for k in dims(name))} FROM sizes"),
            ("placed", f"SELECT p.*, {', '.join(cell.format(k=k) for k in dims(name))}, "
                       f"{listed('n{k}', name)} FROM p, layout"),
            ("located", f"SELECT *, {gid} AS gid FROM placed"),
            ("counts", f"SELECT a.point_id, count(b.point_id) AS c FROM p a LEFT JOIN p b ON {match} GROUP BY 1"),
            ("flags", "SELECT l.*, c, CAST(CASE WHEN c >= " + str(MIN_PTS) + " THEN 1 ELSE 0 END AS INTEGER) AS core_flag "
                      "FROM located l JOIN counts USING (point_id)"),
            ("core", "SELECT * FROM flags WHERE core_flag = 1"),
            ("closest", f"SELECT a.gid AS src, b.gid AS dst, min({dist(name)}) AS min_dist FROM {linked} a "
                        f"JOIN {linked} b ON a.gid < b.gid WHERE {dist(name)} <= {num(outer)} GROUP BY 1, 2"),
            ("edges", f"SELECT src, dst FROM closest WHERE {keep}"),
            ("arcs", "SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges"),
            ("reach", "SELECT DISTINCT gid AS root, gid AS id FROM core UNION "
                      "SELECT r.root, a.dst FROM reach r JOIN arcs a ON r.id = a.src"),
            ("components", "SELECT id AS gid, min(root) AS cluster_id FROM reach GROUP BY 1"),
            ("clusters", "SELECT cluster_id, point_id, core_flag FROM flags JOIN components USING (gid)"),
            ("filled", "SELECT p.point_id, coalesce(cluster_id, -1) AS label, "
                       "CAST(coalesce(core_flag, -1) AS INTEGER) AS core_flag, "
                       "CAST(CASE WHEN cluster_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS is_noise "
                       "FROM p LEFT JOIN clusters USING (point_id)"),
            ("codes", "SELECT label, row_number() OVER (ORDER BY min(point_id)) - 1 AS cluster_id FROM filled GROUP BY label"),
            ("labeled", "SELECT point_id, cluster_id, core_flag, is_noise FROM filled JOIN codes USING (label)"),
            ("nearcore", f"SELECT a.point_id, min(k.cluster_id) AS cluster_id FROM flags a JOIN core b ON {near} "
                         "JOIN components k ON b.gid = k.gid WHERE a.core_flag = 0 GROUP BY 1"),
            # Textbook rules on points.
            ("xcounts", f"SELECT a.point_id, count(*) AS c FROM p a JOIN p b ON {near} GROUP BY 1"),
            ("xcore", f"SELECT p.* FROM p JOIN xcounts USING (point_id) WHERE c >= {MIN_PTS}"),
            ("xarcs", f"SELECT a.point_id AS src, b.point_id AS dst FROM xcore a JOIN xcore b ON {near}"),
            ("xreach", "SELECT point_id AS root, point_id AS id FROM xcore UNION "
                       "SELECT r.root, a.dst FROM xreach r JOIN xarcs a ON r.id = a.src"),
            ("xcomp", "SELECT id AS point_id, min(root) AS root FROM xreach GROUP BY 1"),
            ("xborder", f"SELECT a.point_id, min(k.root) AS root FROM p a JOIN xcore b ON {near} "
                        "JOIN xcomp k ON b.point_id = k.point_id "
                        "WHERE a.point_id NOT IN (SELECT point_id FROM xcore) GROUP BY 1"),
            ("xall", "SELECT point_id, root, 1 AS core_flag FROM xcomp UNION ALL SELECT point_id, root, 0 FROM xborder"),
            ("xcodes", "SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM xall)"),
            ("exact", "SELECT p.point_id, coalesce(cluster_id, -1) AS cluster_id, "
                      "CAST(coalesce(core_flag, 0) AS INTEGER) AS core_flag "
                      "FROM p LEFT JOIN (SELECT * FROM xall JOIN xcodes USING (root)) USING (point_id)"),
            ("compared", f"SELECT p.point_id, {listed('x{k}', name)}, l.cluster_id, l.is_noise, e.cluster_id AS exact_cluster "
                         "FROM p JOIN labeled l USING (point_id) JOIN exact e USING (point_id)"),
        ]

    def __call__(self, final: str, *extra: tuple[str, str]) -> str:
        """The final query with the subqueries it needs."""
        everything = [*self.parts, *extra]
        needed, text = set(), " " + final
        for name, body in reversed(everything):
            if any(f"{lead}{name}{tail}" in text for lead in (" ", "(") for tail in (" ", ",", ")", "\n", "")
                   if tail or text.endswith(f"{lead}{name}")):
                needed.add(name)
                text += " ; " + body + " "
        ctes = ", ".join(f"{n} AS ({b})" for n, b in everything if n in needed)
        return f"WITH RECURSIVE {ctes} {final}"


def halo_sql(sql: Sql) -> list[tuple[str, str]]:
    """Copies of the occupied cells per partition."""
    name, reach = sql.name, math.ceil(math.sqrt(len(dims(sql.name))))
    step = "(CAST(n{k} - 1 AS DOUBLE) / " + str(PARTS) + ")"
    own = ("CASE WHEN n{k} = 1 THEN 0 ELSE least(" + str(PARTS - 1) + ", greatest(0, CAST(floor(c{k} / "
           + step + ") AS BIGINT))) END")
    tables = ", ".join(f"range({PARTS}) r{k}(p{k})" for k in dims(name))
    inside = listed("c{k} >= p{k} * " + step + f" - {reach} AND c{{k}} <= (p{{k}} + 1) * " + step + f" + {reach}",
                    name, " AND ")
    return [
        ("cells", f"SELECT DISTINCT gid, {listed('c{k}, n{k}', name)} FROM located"),
        ("homes", f"SELECT *, CAST({horner(name, own, str(PARTS))} AS BIGINT) AS home FROM cells"),
        ("copies", f"SELECT CAST({horner(name, 'p{k}', str(PARTS))} AS BIGINT) AS paid, gid, "
                   f"CAST(CASE WHEN {horner(name, 'p{k}', str(PARTS))} = home THEN 1 ELSE 0 END AS INTEGER) AS is_home "
                   f"FROM homes, {tables} WHERE {inside}"),
    ]


def blob_sql() -> str:
    def uniform(tag: str) -> str:
        return (f"(CAST(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || '-{tag}'), 1, {HEX_DIGITS}) AS BIGINT) "
                f"AS DOUBLE) + 0.5e0) / {num(UNIT)}")

    xs = ", ".join(
        f"round(m{k} + 1e0 * (sqrt(-2e0 * ln({uniform(f'{k}-a-42')})) * "
        f"cos({num(2.0 * math.pi)} * ({uniform(f'{k}-b-42')}))), 6) AS x{k}"
        for k in range(3)
    )
    means = ", ".join(f"round(avg(x{k}), 6) * 100e0 AS m{k}" for k in range(3))
    return (
        f"WITH centers AS (SELECT label AS center, {means} FROM ({emb(3)}) p JOIN embeddings v ON v.vec_id = p.point_id GROUP BY 1) "
        f"SELECT p_partkey AS point_id, center, {xs} FROM part "
        "JOIN centers ON center = p_partkey % (SELECT count(*) FROM centers)"
    )


def long_form(name: str, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS dim, {columns.format(k=k)} FROM layout" for k in dims(name))


TABLE = ("cont", "SELECT cluster_id AS label_true, exact_cluster AS label_pred, count(*) AS n FROM compared GROUP BY 1, 2")
MARGINS = [
    TABLE,
    ("lefts", "SELECT label_true, CAST(sum(n) AS BIGINT) AS a FROM cont GROUP BY 1"),
    ("rights", "SELECT label_pred, CAST(sum(n) AS BIGINT) AS b FROM cont GROUP BY 1"),
]
ARI = [
    *MARGINS,
    ("q", "SELECT (SELECT sum(n * n) FROM cont) - (SELECT sum(n) FROM cont) AS tp, "
          "(SELECT sum(b * b) FROM rights) - (SELECT sum(n * n) FROM cont) AS fp, "
          "(SELECT sum(a * a) FROM lefts) - (SELECT sum(n * n) FROM cont) AS fn, (SELECT sum(n) FROM cont) AS total"),
    ("q2", "SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, "
           "CAST(total * total - tp - fp - fn - total AS DOUBLE) AS tn FROM q"),
    ("ari_row", "SELECT round(2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), 6) AS ari FROM q2"),
]
AMI = [
    *MARGINS,
    ("tot", "SELECT CAST(sum(n) AS BIGINT) AS t FROM cont"),
    ("mi", "SELECT sum(n / t * (ln(n) + ln(t) - ln(a) - ln(b))) AS mi FROM cont JOIN lefts USING (label_true) "
           "JOIN rights USING (label_pred), tot"),
    ("hu", "SELECT -sum(a / t * ln(a / t)) AS h FROM lefts, tot"),
    ("hv", "SELECT -sum(b / t * ln(b / t)) AS h FROM rights, tot"),
    ("grid_k", "SELECT a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS k FROM lefts, rights, tot"),
    ("emi", "SELECT sum(k / t * ln(CAST(t AS DOUBLE) * k / (CAST(a AS DOUBLE) * b)) * exp(lgamma(a + 1) + lgamma(b + 1) "
            "+ lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) "
            "- lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS e FROM grid_k"),
    ("ami_row", "SELECT round((mi - e) / ((hu.h + hv.h) / 2 - e), 6) AS ami FROM mi, hu, hv, emi"),
]


def silhouette_sql(label: str) -> list[tuple[str, str]]:
    return [
        ("lab", f"SELECT *, {label} AS lab FROM compared"),
        ("sz", "SELECT lab, count(*) AS n FROM lab GROUP BY 1"),
        ("far", f"SELECT a.point_id, a.lab AS own, b.lab AS other, sum({dist('emb3')}) AS s FROM lab a, lab b GROUP BY 1, 2, 3"),
        ("ab", "SELECT point_id, max(CASE WHEN own = other THEN n END) AS n, "
               "max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, "
               "min(CASE WHEN own <> other THEN s / n END) AS b FROM far JOIN sz ON far.other = sz.lab GROUP BY 1"),
        ("sil_row", "SELECT round(avg(CASE WHEN n = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab"),
    ]


def set_sql(member: str) -> str:
    """Blocks of 32 ids and the bits of those that are there."""
    return f"{member} >> 5 AS block, bit_or(CAST(1 AS BIGINT) << CAST({member} & 31 AS INTEGER)) AS bits"


def build() -> dict[str, str]:
    emb3, part2 = Sql("emb3"), Sql("part2")
    halo = halo_sql(emb3)
    clusters = "SELECT * FROM clusters"
    border = "coalesce(nearcore.cluster_id, -1)"
    return {
        "points_load": POINTS["emb3"],
        "points_index": "SELECT c_custkey AS point_id, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS idx FROM customer",
        "blobs": blob_sql(),
        "data_bounds": emb3(long_form("emb3", "lo{k} AS lo, hi{k} AS hi")),
        "grid_dims": part2(long_form("part2", "lo{k} AS lo, hi{k} AS hi, n{k} AS n, w{k} AS width")),
        "bin_bounds": part2("SELECT dim, i, lo + i * width AS edge FROM edges_of, range(100000) r(i) WHERE i <= n",
                            ("edges_of", long_form("part2", "lo{k} AS lo, n{k} AS n, w{k} AS width"))),
        "cell_assign": emb3("SELECT point_id, c0, c1, c2 FROM placed"),
        "cell_gid": emb3("SELECT point_id, gid FROM located"),
        "gid_to_cell": emb3("SELECT DISTINCT gid, c0, c1, c2 FROM located"),
        "cell_bounds": part2("SELECT DISTINCT gid, lo0 + c0 * w0 AS lo0, lo0 + (c0 + 1) * w0 AS hi0, "
                             "lo1 + c1 * w1 AS lo1, lo1 + (c1 + 1) * w1 AS hi1 FROM located , layout"),
        "cell_members": part2("SELECT gid, count(*) AS n_points, min(point_id) AS first_point, max(point_id) AS last_point, "
                              "CAST(sum(point_id) AS DECIMAL(38,0)) AS sum_points FROM located GROUP BY gid"),
        "cell_member_sets": part2(f"SELECT gid, {set_sql('point_id')} FROM located GROUP BY gid, block"),
        "point_lookup": part2("SELECT point_id, min(point_id) OVER (PARTITION BY x0, x1) AS found_id FROM p "),
        "neighbor_counts": part2(f"SELECT point_id, least(c, {MIN_PTS}) AS neighbors, core_flag FROM flags "),
        "neighbor_counts_emb64": Sql("emb64", numbered=False)(f"SELECT point_id, least(c, {MIN_PTS}) AS neighbors, core_flag FROM flags "),
        "core_points": emb3("SELECT point_id, gid, core_flag FROM flags "),
        "core_points_standard": Sql("part2", rule="standard")("SELECT point_id, gid, core_flag FROM flags "),
        "core_border_split": part2("SELECT gid, CASE WHEN core_flag = 1 THEN 'core' ELSE 'border' END AS kind, "
                                   "count(*) AS n_points FROM flags GROUP BY 1, 2"),
        "core_cells": emb3("SELECT gid, count(*) AS n_core FROM core GROUP BY 1"),
        "core_cell_counts": part2("SELECT gid, CAST(sum(core_flag) AS BIGINT) AS n_core FROM flags GROUP BY 1 HAVING sum(core_flag) > 0"),
        "core_cell_points": emb3("SELECT gid, point_id, core_flag FROM flags WHERE gid IN (SELECT gid FROM core )"),
        "eps_pairs": part2("SELECT a.gid AS src, b.gid AS dst, min(" + dist("part2") + ") AS min_dist FROM located a "
                           f"JOIN located b ON a.gid < b.gid WHERE {dist('part2')} <= {num(EPS['part2'])} GROUP BY 1, 2"),
        "cell_min_dist": Sql("emb3", policy="always")("SELECT src, dst, min_dist FROM closest "),
        "neighbor_cells_exact": emb3("SELECT * FROM edges "),
        "neighbor_cells_always": Sql("emb3", policy="always")("SELECT * FROM edges "),
        "neighbor_cells_seeded": Sql("emb3", policy="seeded")("SELECT * FROM edges "),
        "neighbor_cells_all_points": Sql("emb3", cell_points="all")("SELECT * FROM edges "),
        "cell_graph": emb3("SELECT DISTINCT 'vertex' AS kind, gid AS src, gid AS dst FROM core UNION ALL "
                           "SELECT 'edge', src, dst FROM edges "),
        "components": emb3("SELECT * FROM components "),
        "clusters": emb3(clusters),
        "clusters_emb4": Sql("emb4")(clusters),
        "clusters_emb64": Sql("emb64", numbered=False)(clusters),
        "clusters_user2": Sql("user2")(clusters),
        "clusters_part2": part2(clusters),
        "clusters_cust1": Sql("cust1")(clusters),
        "clusters_supp2": Sql("supp2")(clusters),
        "clusters_exact_grid": Sql("emb3", grid="exact")(clusters),
        "clusters_always": Sql("emb3", policy="always")(clusters),
        "clusters_seeded": Sql("emb3", policy="seeded")(clusters),
        "clusters_standard": Sql("part2", rule="standard")(
            "SELECT cluster_id, point_id, core_flag FROM clusters WHERE core_flag = 1 UNION ALL "
            "SELECT cluster_id, point_id, 0 FROM nearcore "),
        "cluster_members": part2("SELECT cluster_id, count(*) AS n_points, CAST(sum(core_flag) AS BIGINT) AS n_core, "
                                 "min(point_id) AS first_point, max(point_id) AS last_point, "
                                 "CAST(sum(point_id) AS DECIMAL(38,0)) AS sum_points FROM clusters GROUP BY 1"),
        "cluster_member_sets": part2(f"SELECT cluster_id, {set_sql('point_id')} FROM clusters GROUP BY cluster_id, block"),
        "cluster_border_points": part2("SELECT cluster_id, point_id FROM clusters WHERE core_flag = 0"),
        "border_eps": emb3(f"SELECT f.point_id, {border} AS cluster_id FROM flags f LEFT JOIN nearcore USING (point_id) "
                           "WHERE f.core_flag = 0"),
        "labels_filled": part2("SELECT * FROM labeled "),
        "distinct_counts": emb3("SELECT count(*) AS n_points, count(DISTINCT gid) AS n_cells, "
                                "count(DISTINCT CASE WHEN core_flag = 1 THEN gid END) AS n_core_cells, "
                                "count(DISTINCT cluster_id) AS n_clusters, CAST(sum(core_flag) AS BIGINT) AS n_core "
                                "FROM flags LEFT JOIN components USING (gid)"),
        "partition_bounds": emb3(" UNION ALL ".join(
            f"SELECT CAST({k} AS INTEGER) AS dim, i, i * (CAST(n{k} - 1 AS DOUBLE) / {PARTS}) AS edge "
            f"FROM layout , range({PARTS + 1}) r(i)" for k in range(3))),
        "partition_home": emb3("SELECT gid, home FROM homes ", *halo),
        "halo_ids": emb3("SELECT * FROM copies ", *halo),
        "halo_points": emb3("SELECT paid, gid, point_id, is_home FROM copies JOIN located USING (gid)", *halo),
        "partition_cells": emb3("SELECT paid, count(*) AS n_cells, min(gid) AS first_cell, max(gid) AS last_cell, "
                                "CAST(sum(gid) AS DECIMAL(38,0)) AS sum_cells FROM copies GROUP BY 1", *halo),
        "partition_cell_sets": emb3(f"SELECT paid, {set_sql('gid')} FROM copies GROUP BY paid, block", *halo),
        "partition_foreign_cells": emb3("SELECT paid, count(DISTINCT gid) AS n_foreign FROM copies WHERE is_home = 0 GROUP BY paid", *halo),
        "partition_load": emb3("SELECT paid, count(*) AS n_rows, count(DISTINCT gid) AS n_cells, "
                               "CAST(sum(is_home) AS BIGINT) AS n_home_rows FROM copies JOIN located USING (gid) GROUP BY 1", *halo),
        "merge_flags": emb3("SELECT gid, point_id, core_flag FROM flags "),
        "dbscan_exact": emb3("SELECT * FROM exact "),
        "dbscan_exact_emb64": Sql("emb64", numbered=False)("SELECT * FROM exact "),
        "dbscan_exact_part2": part2("SELECT * FROM exact "),
        "label_compare": emb3("SELECT * FROM compared "),
        "contingency": emb3("SELECT * FROM cont ", TABLE),
        "ari": emb3("SELECT * FROM ari_row ", *ARI),
        "ami": emb3("SELECT * FROM ami_row ", *AMI),
        "silhouette": emb3("SELECT * FROM sil_row ", *silhouette_sql("cluster_id")),
        "silhouette_grouped": emb3(
            f"SELECT round(silhouette, 3) AS silhouette, 'grouped' AS mode, {num(round(error_bound(0.2), 6))} AS error_bound FROM sil_row ",
            *silhouette_sql("cluster_id")),
        "clusters_valid": Sql("order2")(clusters),
        "clusters_skew": part2(clusters),
        "evaluate": emb3("SELECT * FROM ari_row , ami_row , sil_row ", *ARI, *AMI[len(MARGINS):], *silhouette_sql("exact_cluster")),
    }
