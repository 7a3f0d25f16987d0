"""The named queries in SQL, over the same tables, written independently of the DataFrame plans.

``VIEWS`` are named fragments; each query is a SELECT over some of them. Scans
are not parsed here: the hits are taken from the lines the scan text was made of.
"""

from __future__ import annotations

import re

from aislefix.operators.model import FEATURES

SLOTS = range(1, 11)


def _each(template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(k=k) for k in SLOTS)


def _r(expression: str, name: str, digits: int = 6) -> str:
    scale = f"{10**digits}e0"
    return f"floor(({expression}) * {scale} + 0.5e0) / {scale} AS {name}"


VIEWS: dict[str, str] = {
    "hits": """
        SELECT l_orderkey AS row_id, l_suppkey * 100 + l_partkey % 100 AS wifi_bssid,
               CAST(l_quantity AS INTEGER) - 100 AS wifi_signal, l_linestatus = 'O' AS conn, l_suppkey AS suppkey,
               row_number() OVER (PARTITION BY l_orderkey
                                  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
        FROM lineitem""",
    "slots": """
        SELECT *, CAST(conn AS INTEGER) AS wifi_flag,
               row_number() OVER (PARTITION BY row_id ORDER BY wifi_signal DESC, pos) AS k
        FROM hits""",
    "shops": """
        SELECT s_suppkey AS shop_no, 's_' || s_suppkey AS shop_id, s_suppkey % 13 AS category_no,
               110 + s_nationkey * 0.4e0 + (s_suppkey % 10) * 0.0005e0 AS longitude,
               20 + s_nationkey * 0.3e0 + (s_suppkey % 7) * 0.0005e0 AS latitude,
               CASE WHEN s_suppkey % 11 <> 0 THEN CAST(floor(abs(s_acctbal) / 100) AS DOUBLE) END AS price,
               s_nationkey AS mall_no, 'm_' || s_nationkey AS mall_id
        FROM supplier""",
    "texts": """
        SELECT row_id, string_agg('b_' || wifi_bssid || '|' || wifi_signal || '|' ||
                                  CASE WHEN conn THEN 'true' ELSE 'false' END, ';' ORDER BY pos) AS wifi_infos
        FROM hits GROUP BY row_id""",
    "all_rows": """
        SELECT o.o_orderkey AS row_id, o.o_orderstatus = 'P' AS pending, 'u_' || o.o_custkey AS user_id,
               o.o_custkey AS user_no, s.shop_id, s.shop_no, coalesce(s.mall_no, 0) AS mall_no,
               coalesce(s.mall_id, 'm_0') AS mall_id,
               o.o_orderdate + to_minutes((o.o_orderkey * 37) % 1440) AS time_stamp,
               coalesce(s.longitude, 110e0) + (o.o_orderkey % 21 - 10) * 0.0002e0 AS longitude,
               coalesce(s.latitude, 20e0) + (o.o_orderkey % 17 - 8) * 0.0002e0 AS latitude,
               t.wifi_infos
        FROM orders o
        LEFT JOIN (SELECT row_id, suppkey FROM slots WHERE k = 1) f ON f.row_id = o.o_orderkey
        LEFT JOIN shops s ON s.shop_no = f.suppkey
        LEFT JOIN texts t ON t.row_id = o.o_orderkey""",
    "visits": """
        SELECT *, day(time_stamp) AS transaction_day FROM all_rows WHERE NOT pending AND shop_id IS NOT NULL""",
    "query_rows": "SELECT *, day(time_stamp) AS transaction_day FROM all_rows WHERE pending",
    "records": "SELECT * FROM visits UNION ALL SELECT * FROM query_rows",
    "prior": """
        SELECT g.row_id, g.suppkey AS shop_no, CAST(g.suppkey = t.suppkey AS BIGINT) AS label, g.k - 2 AS shop_index
        FROM slots g JOIN slots t ON t.row_id = g.row_id AND t.k = 1 WHERE g.k IN (2, 3)""",
    "mall_profile": """
        SELECT s.mall_id, avg(s.price) AS mall_price, avg(s.longitude) AS mall_longitude,
               avg(s.latitude) AS mall_latitude
        FROM visits v JOIN shops s ON s.shop_no = v.shop_no GROUP BY s.mall_id""",
    "distances": """
        SELECT b.row_id, b.mall_id,
               2 * 6371000e0 * asin(sqrt(power(sin(radians(m.mall_latitude - b.latitude) / 2), 2)
                   + cos(radians(b.latitude)) * cos(radians(m.mall_latitude))
                     * power(sin(radians(m.mall_longitude - b.longitude) / 2), 2))) AS distance,
               2 * 6371000e0 * asin(sqrt(power(sin(radians(m.mall_longitude - b.longitude) / 2), 2))) AS longitude1,
               2 * 6371000e0 * asin(sqrt(power(sin(radians(m.mall_latitude - b.latitude) / 2), 2))) AS latitude1
        FROM records b LEFT JOIN mall_profile m ON m.mall_id = b.mall_id""",
    "slot_rows": "SELECT b.row_id, "
    + _each(
        "coalesce(max(CASE WHEN s.k = {k} THEN s.wifi_bssid END), -999) AS wifi{k}_bssid, "
        "CAST(coalesce(max(CASE WHEN s.k = {k} THEN s.wifi_signal END), -999) AS BIGINT) AS wifi{k}_signal, "
        "CAST(coalesce(max(CASE WHEN s.k = {k} THEN s.wifi_flag END), 0) AS BIGINT) AS wifi{k}_flag"
    )
    + ", count(s.k) AS wifi_infos_number, count(DISTINCT s.wifi_bssid) AS distinct_aps"
    + " FROM records b LEFT JOIN slots s ON s.row_id = b.row_id GROUP BY b.row_id",
    "visit_hits": """
        SELECT s.row_id, s.pos, s.k, s.wifi_bssid, s.wifi_signal, v.shop_no, v.transaction_day
        FROM slots s JOIN visits v ON v.row_id = s.row_id""",
    "feature_hits": "SELECT * FROM visit_hits WHERE transaction_day <= 24",
    "label_rows": "SELECT * FROM visits WHERE transaction_day > 24",
    "ap_train": """
        SELECT shop_no, wifi_bssid, count(*) AS n, CAST(sum(wifi_signal) AS DOUBLE) / count(*) AS wifi_signal,
               count(*) / 24e0 AS sw_number
        FROM feature_hits GROUP BY shop_no, wifi_bssid""",
    "ap_all": """
        SELECT shop_no, wifi_bssid, count(*) AS n, CAST(sum(wifi_signal) AS DOUBLE) / count(*) AS wifi_signal,
               count(*) / 31e0 AS sw_number
        FROM visit_hits GROUP BY shop_no, wifi_bssid""",
}

for _window, _hits, _days in (("train", "feature_hits", 24), ("all", "visit_hits", 31)):
    VIEWS[f"modal_{_window}"] = f"""
        SELECT shop_no, wifi_bssid, wifi_signal FROM (
            SELECT *, row_number() OVER (PARTITION BY shop_no ORDER BY n DESC, wifi_signal DESC, wifi_bssid) AS rn
            FROM ap_{_window}) WHERE rn = 1"""
    VIEWS[f"first_{_window}"] = f"""
        SELECT shop_no, wifi_bssid, count(*) AS n, CAST(sum(wifi_signal) AS DOUBLE) / count(*) AS wifi_signal,
               sum(wifi_signal) AS total
        FROM {_hits} WHERE k = 1 GROUP BY shop_no, wifi_bssid"""
    VIEWS[f"modal1_{_window}"] = f"""
        SELECT shop_no, wifi_bssid, wifi_signal FROM (
            SELECT *, row_number() OVER (PARTITION BY shop_no ORDER BY n DESC, wifi_signal DESC, wifi_bssid) AS rn
            FROM first_{_window}) WHERE rn = 1"""
    VIEWS[f"shop_{_window}"] = f"""
        SELECT g.shop_no, m.wifi_bssid AS swifi_bssid_maxsignal, m.wifi_signal AS swifi_signal_maxsignal,
               g.shop_wifi_signal, f.swifi1_signal_all, f.shop_wifi_num,
               m1.wifi_bssid AS swifi1_bssid_maxsignal, m1.wifi_signal AS swifi1_signal_maxsignal
        FROM (SELECT shop_no, CAST(sum(wifi_signal) AS DOUBLE) / count(*) AS shop_wifi_signal
              FROM {_hits} GROUP BY shop_no) g
        JOIN modal_{_window} m ON m.shop_no = g.shop_no
        LEFT JOIN (SELECT shop_no, CAST(sum(total) AS DOUBLE) / sum(n) AS swifi1_signal_all,
                          count(*) / {_days}e0 AS shop_wifi_num
                   FROM first_{_window} GROUP BY shop_no) f ON f.shop_no = g.shop_no
        LEFT JOIN modal1_{_window} m1 ON m1.shop_no = g.shop_no"""

VIEWS |= {
    "index_train": """
        SELECT DISTINCT wifi_bssid, shop_no FROM (
            SELECT *, row_number() OVER (PARTITION BY wifi_bssid ORDER BY wifi_signal DESC, shop_no) AS rn
            FROM (SELECT DISTINCT wifi_bssid, shop_no, wifi_signal FROM feature_hits
                  WHERE wifi_bssid IN (SELECT wifi_bssid FROM feature_hits GROUP BY wifi_bssid HAVING count(*) > 5)))
        WHERE rn <= 12""",
    "popular": """
        SELECT wifi_bssid, shop_no, n FROM (
            SELECT *, row_number() OVER (PARTITION BY wifi_bssid ORDER BY n DESC, shop_no) AS rn FROM ap_all)
        WHERE rn <= 3""",
    "index_query": """
        SELECT wifi_bssid, shop_no FROM (
            SELECT *, row_number() OVER (PARTITION BY wifi_bssid ORDER BY wifi_signal DESC, shop_no) AS rn
            FROM (SELECT DISTINCT wifi_bssid, shop_no, wifi_signal FROM visit_hits)) WHERE rn <= 15
        UNION SELECT wifi_bssid, shop_no FROM popular""",
    "index_pairs": """
        SELECT DISTINCT l.row_id, i.shop_no, CAST(i.shop_no = l.shop_no AS BIGINT) AS label
        FROM label_rows l JOIN slots s ON s.row_id = l.row_id JOIN index_train i ON i.wifi_bssid = s.wifi_bssid""",
    "true_pairs": "SELECT row_id, shop_no, CAST(1 AS BIGINT) AS label FROM label_rows",
    "prior_known": "SELECT * FROM prior WHERE row_id IN (SELECT row_id FROM all_rows WHERE NOT pending)",
    "prior_asked": "SELECT * FROM prior WHERE row_id IN (SELECT row_id FROM all_rows WHERE pending)",
    "prior_train": "SELECT row_id, shop_no, label FROM prior_known WHERE shop_index = 0 "
    "AND row_id IN (SELECT row_id FROM label_rows)",
    "pairs_train": """
        SELECT row_id, shop_no, max(label) AS label FROM (
            SELECT * FROM index_pairs UNION ALL SELECT * FROM true_pairs UNION ALL SELECT * FROM prior_train)
        GROUP BY row_id, shop_no""",
    "index_pairs_query": """
        SELECT DISTINCT q.row_id, i.shop_no
        FROM query_rows q JOIN slots s ON s.row_id = q.row_id JOIN index_query i ON i.wifi_bssid = s.wifi_bssid""",
    "pairs_query": """
        SELECT * FROM index_pairs_query
        UNION SELECT row_id, shop_no FROM prior_asked WHERE shop_index = 0""",
}

for _side, _window in (("train", "train"), ("query", "all")):
    VIEWS[f"overlap_{_side}"] = f"""
        SELECT p.row_id, p.shop_no,
               CASE WHEN count(DISTINCT s.wifi_bssid) = 0 THEN 0e0
                    ELSE CAST(count(DISTINCT a.wifi_bssid) AS DOUBLE) / count(DISTINCT s.wifi_bssid) END AS wifi_in_swifi
        FROM pairs_{_side} p
        LEFT JOIN slots s ON s.row_id = p.row_id
        LEFT JOIN ap_{_window} a ON a.shop_no = p.shop_no AND a.wifi_bssid = s.wifi_bssid
        GROUP BY p.row_id, p.shop_no"""
    VIEWS[f"match_{_side}"] = (
        "SELECT p.row_id, p.shop_no, "
        + _each(
            "max(CASE WHEN s.k = {k} THEN a.wifi_signal END) AS sw_wifi{k}_signal, "
            "max(CASE WHEN s.k = {k} THEN a.sw_number END) AS sw_number{k}"
        )
        + f""" FROM pairs_{_side} p
        LEFT JOIN slots s ON s.row_id = p.row_id AND s.k <= 10
        LEFT JOIN ap_train a ON a.shop_no = p.shop_no AND a.wifi_bssid = s.wifi_bssid
        GROUP BY p.row_id, p.shop_no"""
    )

VIEWS["encoded_rows"] = """
    SELECT * FROM slot_rows WHERE row_id IN (SELECT row_id FROM label_rows)
       OR row_id IN (SELECT row_id FROM pairs_query)"""
VIEWS["codes"] = (
    "SELECT e.row_id, dense_rank() OVER (ORDER BY b.mall_no) - 1 AS mall_no_code, "
    + _each("dense_rank() OVER (ORDER BY wifi{k}_bssid) - 1 AS wifi{k}_bssid_code")
    + " FROM encoded_rows e JOIN records b ON b.row_id = e.row_id"
)

_SHOP_COLUMNS = (
    "swifi_bssid_maxsignal, "
    + ", ".join(
        _r(name, name)
        for name in ("swifi_signal_maxsignal", "shop_wifi_signal", "swifi1_signal_all", "shop_wifi_num")
    )
    + ", swifi1_bssid_maxsignal, "
    + _r("swifi1_signal_maxsignal", "swifi1_signal_maxsignal")
)
_DISTANCES = ", ".join(_r(name, name, 3) for name in ("distance", "longitude1", "latitude1"))
_CALENDAR = (
    "day(time_stamp) AS transaction_day, hour(time_stamp) AS transaction_hour, "
    "minute(time_stamp) AS transaction_minute, isodow(time_stamp) AS transaction_isoweekday"
)
_PLACE = _r("longitude", "longitude") + ", " + _r("latitude", "latitude")
_TIME = "strftime(time_stamp, '%Y-%m-%d %H:%M:%S') AS time_stamp"
_SLOT_LIST = _each("wifi{k}_bssid, wifi{k}_signal, wifi{k}_flag")


def _features(side: str, window: str) -> str:
    label = "p.label, " if side == "train" else ""
    row = "b.row_id = p.row_id"
    geo = ", ".join(
        (
            _r("b.longitude - s.longitude", "longitude_cha"),
            _r("b.latitude - s.latitude", "latitude_cha"),
            _r("(b.longitude - s.longitude) * (b.longitude - s.longitude) "
               "+ (b.latitude - s.latitude) * (b.latitude - s.latitude)", "dist", 9),
        )
    )
    slots = ", ".join(
        f"c.wifi{k}_bssid_code AS wifi{k}_bssid, r.wifi{k}_signal, "
        + ", ".join(
            (
                _r(f"m.sw_wifi{k}_signal", f"sw_wifi{k}_signal"),
                _r(f"m.sw_number{k}", f"sw_number{k}"),
                _r(f"r.wifi{k}_signal - m.sw_wifi{k}_signal", f"sw_wifi{k}_signal_cha"),
            )
        )
        for k in SLOTS
    )
    return f"""
        SELECT p.row_id, {label}b.user_no, {_r('b.longitude', 'longitude')}, {_r('b.latitude', 'latitude')},
               hour(b.time_stamp) AS transaction_hour, isodow(b.time_stamp) AS transaction_isoweekday,
               c.mall_no_code AS mall_no, {_DISTANCES}, s.category_no AS category_id,
               {_r('s.longitude', 'slongitude')}, {_r('s.latitude', 'slatitude')}, {_r('s.price', 'price')},
               {_SHOP_COLUMNS}, p.shop_no, {geo},
               r.wifi1_bssid - w.swifi_bssid_maxsignal AS wifi_bssid_maxsignal_cha,
               {_r('r.wifi1_signal - w.swifi_signal_maxsignal', 'wifi_signal_maxsignal_cha')},
               {slots}, {_r('o.wifi_in_swifi', 'wifi_in_swifi')}
        FROM pairs_{side} p
        JOIN records b ON {row}
        JOIN distances d ON d.row_id = p.row_id
        JOIN slot_rows r ON r.row_id = p.row_id
        JOIN codes c ON c.row_id = p.row_id
        JOIN match_{side} m ON m.row_id = p.row_id AND m.shop_no = p.shop_no
        JOIN overlap_{side} o ON o.row_id = p.row_id AND o.shop_no = p.shop_no
        LEFT JOIN shops s ON s.shop_no = p.shop_no
        LEFT JOIN shop_{window} w ON w.shop_no = p.shop_no"""


def _whole_profile(window: str) -> str:
    return f"""
        SELECT 's_' || a.shop_no AS shop_id, a.wifi_bssid, {_r('a.wifi_signal', 'wifi_signal')},
               {_r('a.sw_number', 'sw_number')}, {_SHOP_COLUMNS}
        FROM ap_{window} a JOIN shop_{window} w ON w.shop_no = a.shop_no"""


_QUERY_ROWS = f"SELECT row_id, user_id, mall_id, {_TIME}, {_PLACE}, wifi_infos FROM query_rows"
_PAIR = "SELECT p.row_id, 's_' || p.shop_no AS shop_id"

QUERIES: dict[str, str] = {
    "visits_scan": f"SELECT row_id, user_id, shop_id, {_TIME}, {_PLACE}, wifi_infos FROM visits",
    "shops_scan": f"SELECT shop_id, 'c_' || category_no AS category_id, {_PLACE}, {_r('price', 'price')}, mall_id FROM shops",
    "query_rows_scan": _QUERY_ROWS,
    "prior_top1": "SELECT row_id, 's_' || shop_no AS shop_id, label FROM prior_known WHERE shop_index = 0",
    "prior_top1_answer": "SELECT row_id, 's_' || shop_no AS shop_id FROM prior_asked WHERE shop_index = 0",
    "csv_roundtrip": _QUERY_ROWS,
    "csv_shops": f"SELECT shop_id, 'c_' || category_no AS category_id, {_PLACE}, {_r('price', 'price')}, mall_id FROM shops",
    "csv_visits": f"SELECT user_id, shop_id, {_TIME}, {_PLACE}, wifi_infos FROM visits",
    "rejected_query_rows": """
        SELECT row_id, concat_ws('; ', CASE WHEN row_id % 107 = 0 THEN 'time_stamp: not a timestamp_ntz' END,
               CASE WHEN row_id % 101 = 0 THEN 'longitude: not a double' END, CASE WHEN row_id % 103 = 0 THEN 'wifi_infos: not a hit' END) AS reasons
        FROM query_rows WHERE row_id % 101 = 0 OR row_id % 103 = 0 OR row_id % 107 = 0""",
    "accepted_query_rows": f"SELECT * FROM ({_QUERY_ROWS}) WHERE row_id % 101 <> 0 AND row_id % 103 <> 0 AND row_id % 107 <> 0",
    "csv_prior_train": "SELECT row_id, 's_' || shop_no AS shop_id, label, shop_index FROM prior_known",
    "csv_prior_answer": "SELECT row_id, 's_' || shop_no AS shop_id, shop_index FROM prior_asked",
    "visit_calendar": f"SELECT row_id, {_CALENDAR} FROM records",
    "mall_distance": f"SELECT row_id, mall_id, {_DISTANCES} FROM distances",
    "shop_dim": f"""
        SELECT shop_id, category_no AS category_id, {_r('longitude', 'slongitude')}, {_r('latitude', 'slatitude')},
               {_r('price', 'price')}, mall_id, shop_no, CAST(mall_no AS BIGINT) AS mall_no FROM shops""",
    "pair_geo_features": f"""
        {_PAIR}, {_r('b.longitude - s.longitude', 'longitude_cha')}, {_r('b.latitude - s.latitude', 'latitude_cha')},
               {_r('power(b.longitude - s.longitude, 2) + power(b.latitude - s.latitude, 2)', 'dist', 9)}
        FROM pairs_train p JOIN records b ON b.row_id = p.row_id LEFT JOIN shops s ON s.shop_no = p.shop_no""",
    "pair_signal_features": f"""
        {_PAIR}, r.wifi1_bssid - w.swifi_bssid_maxsignal AS wifi_bssid_maxsignal_cha,
               {_r('r.wifi1_signal - w.swifi_signal_maxsignal', 'wifi_signal_maxsignal_cha')}
        FROM pairs_train p JOIN slot_rows r ON r.row_id = p.row_id LEFT JOIN shop_train w ON w.shop_no = p.shop_no""",
    "feature_window": "SELECT row_id, shop_id, transaction_day FROM visits WHERE transaction_day <= 24",
    "label_window": "SELECT row_id, shop_id, transaction_day FROM visits WHERE transaction_day >= 25",
    "scan_hits": """
        SELECT s.row_id, s.k, s.pos, s.wifi_bssid, CAST(s.wifi_signal AS BIGINT) AS wifi_signal,
               CAST(s.wifi_flag AS BIGINT) AS wifi_flag
        FROM slots s JOIN records b ON b.row_id = s.row_id""",
    "scan_size": "SELECT row_id, wifi_infos_number FROM slot_rows",
    "scan_slots": f"SELECT row_id, {_SLOT_LIST} FROM slot_rows",
    "scan_overlap": f"{_PAIR}, {_r('wifi_in_swifi', 'wifi_in_swifi')} FROM overlap_query p",
    "visit_shop_join": f"""
        SELECT v.row_id, v.shop_id, s.mall_id, {_r('s.longitude', 'slongitude')}, {_r('s.latitude', 'slatitude')},
               {_r('s.price', 'price')}
        FROM visits v LEFT JOIN shops s ON s.shop_no = v.shop_no""",
    "slot_match_features": f"{_PAIR}, "
    + ", ".join(_r(f"sw_wifi{k}_signal", f"sw_wifi{k}_signal") + ", " + _r(f"sw_number{k}", f"sw_number{k}") for k in SLOTS)
    + " FROM match_query p",
    "mall_profile": "SELECT mall_id, "
    + ", ".join(_r(name, name) for name in ("mall_price", "mall_longitude", "mall_latitude"))
    + " FROM mall_profile",
    "ap_hit_count": "SELECT wifi_bssid, count(*) AS wifi_counts FROM feature_hits GROUP BY wifi_bssid",
    "ap_min_support": """
        SELECT h.row_id, h.pos, 's_' || h.shop_no AS shop_id, h.wifi_bssid,
               CAST(h.wifi_signal AS BIGINT) AS wifi_signal, c.n AS wifi_counts
        FROM feature_hits h
        JOIN (SELECT wifi_bssid, count(*) AS n FROM feature_hits GROUP BY wifi_bssid) c ON c.wifi_bssid = h.wifi_bssid
        WHERE c.n > 5""",
    "ap_profile": f"SELECT 's_' || shop_no AS shop_id, wifi_bssid, {_r('wifi_signal', 'wifi_signal')}, "
    f"{_r('sw_number', 'sw_number')} FROM ap_train",
    "shop_mean_signal": f"SELECT 's_' || shop_no AS shop_id, {_r('avg(wifi_signal)', 'shop_wifi_signal')} "
    "FROM feature_hits GROUP BY shop_no",
    "shop_ap_list": "SELECT 's_' || shop_no AS shop_id, wifi_bssid FROM ap_train",
    "shop_ap_list_answer": "SELECT 's_' || shop_no AS shop_id, wifi_bssid FROM ap_all",
    "shop_modal_ap_ties": """
        SELECT 's_' || shop_no AS shop_id, wifi_bssid, n AS n_hits FROM (
            SELECT *, rank() OVER (PARTITION BY shop_no ORDER BY n DESC) AS place FROM ap_train) WHERE place = 1""",
    "shop_modal_ap": "SELECT 's_' || shop_no AS shop_id, wifi_bssid AS swifi_bssid_maxsignal, "
    f"{_r('wifi_signal', 'swifi_signal_maxsignal')} FROM modal_train",
    "shop_slot1_mean": f"SELECT 's_' || shop_no AS shop_id, {_r('avg(wifi_signal)', 'swifi1_signal_all')} "
    "FROM feature_hits WHERE k = 1 GROUP BY shop_no",
    "shop_slot1_variety": f"SELECT 's_' || shop_no AS shop_id, {_r('count(DISTINCT wifi_bssid) / 24e0', 'shop_wifi_num')} "
    "FROM feature_hits WHERE k = 1 GROUP BY shop_no",
    "shop_slot1_modal_ap": "SELECT 's_' || shop_no AS shop_id, wifi_bssid AS swifi1_bssid_maxsignal, "
    f"{_r('wifi_signal', 'swifi1_signal_maxsignal')} FROM modal1_train",
    "shop_profile": f"SELECT 's_' || shop_no AS shop_id, {_SHOP_COLUMNS} FROM shop_train",
    "shop_profile_answer": f"SELECT 's_' || shop_no AS shop_id, {_SHOP_COLUMNS} FROM shop_all",
    "profiles_train": _whole_profile("train"),
    "profiles_query": _whole_profile("all"),
    "ap_signal_pairs": "SELECT DISTINCT wifi_bssid, 's_' || shop_no AS shop_id, "
    "CAST(wifi_signal AS BIGINT) AS wifi_signal FROM feature_hits",
    "ap_popular_shops": "SELECT wifi_bssid, 's_' || shop_no AS shop_id, n FROM popular",
    "ap_index_train": "SELECT wifi_bssid, 's_' || shop_no AS shop_id FROM index_train",
    "ap_index_query": "SELECT wifi_bssid, 's_' || shop_no AS shop_id FROM index_query",
    "candidate_pairs_train": """
        SELECT row_id, 's_' || shop_no AS shop_id, label
        FROM (SELECT * FROM index_pairs UNION SELECT * FROM true_pairs)""",
    "candidate_pairs_query": f"{_PAIR} FROM index_pairs_query p",
    "candidate_union_train": f"{_PAIR}, label FROM pairs_train p",
    "candidate_union_query": f"{_PAIR} FROM pairs_query p",
    "candidate_recall": f"""
        SELECT l.n AS label_rows, i.n AS index_pairs, i.hit AS true_pairs, {_r('i.hit / CAST(l.n AS DOUBLE)', 'recall')}
        FROM (SELECT count(*) AS n FROM label_rows) l,
             (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS hit FROM index_pairs) i""",
    "row_ids": "SELECT row_id, shop_id, row_number() OVER (ORDER BY row_id) - 1 AS row_number FROM label_rows",
    "ordinal_encode": "SELECT * FROM codes",
    "pair_features_train": _features("train", "train"),
    "pair_features_query": _features("query", "all"),
    "best_candidate": """
        SELECT row_id, 's_' || shop_no AS shop_id FROM (
            SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY wifi_in_swifi DESC, shop_no) AS rn
            FROM overlap_query) WHERE rn = 1""",
    "answer_rule": """
        SELECT r.row_id, 's_' || a.shop_no AS shop_id FROM query_rows r LEFT JOIN (
            SELECT o.row_id, o.shop_no, row_number() OVER (
                PARTITION BY o.row_id
                ORDER BY o.wifi_in_swifi DESC,
                         (q.longitude - s.longitude) * (q.longitude - s.longitude)
                         + (q.latitude - s.latitude) * (q.latitude - s.latitude) NULLS LAST, o.shop_no) AS rn
            FROM overlap_query o JOIN query_rows q ON q.row_id = o.row_id
            LEFT JOIN shops s ON s.shop_no = o.shop_no) a ON a.row_id = r.row_id AND a.rn = 1""",
    # Trained scores cannot be said in SQL; what must hold of them can.
    "rank_gbt": f"{_PAIR}, true AS is_probability, true AS same_when_loaded FROM pairs_query p",
    "feature_importance": "SELECT feature, true AS not_negative, 1e0 AS total FROM (VALUES "
    + ", ".join(f"('{name}')" for name in FEATURES)
    + ") f (feature)",
    "answer_pipeline": """
        SELECT r.row_id, c.row_id IS NOT NULL AS has_candidate, c.row_id IS NOT NULL AS chose_candidate,
               false AS another_scores_higher
        FROM query_rows r LEFT JOIN (SELECT DISTINCT row_id FROM pairs_query) c ON c.row_id = r.row_id""",
    "enrich_visits": f"""
        SELECT v.row_id, v.user_id, v.shop_id, {_PLACE}, v.wifi_infos, v.mall_id, {_DISTANCES}, {_CALENDAR},
               r.wifi_infos_number, {_SLOT_LIST}
        FROM visits v JOIN distances d ON d.row_id = v.row_id JOIN slot_rows r ON r.row_id = v.row_id""",
    "enrich_query_rows": f"""
        SELECT v.row_id, v.user_id, v.mall_id, {_PLACE}, v.wifi_infos, {_DISTANCES}, {_CALENDAR},
               r.wifi_infos_number, {_SLOT_LIST}
        FROM query_rows v JOIN distances d ON d.row_id = v.row_id JOIN slot_rows r ON r.row_id = v.row_id""",
}

# The state by day must give what the visits themselves give.
for _name in ("profiles_train", "profiles_query", "ap_index_train", "ap_index_query"):
    QUERIES[f"state_{_name}"] = QUERIES[_name]


def _needed(sql: str, found: list[str]) -> None:
    """Views that ``sql`` reads, each after the views it reads itself."""
    for name in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)


def oracle_sql() -> dict[str, str]:
    statements = {}
    for name, sql in QUERIES.items():
        views: list[str] = []
        _needed(sql, views)
        chain = ", ".join(f"{view} AS ({VIEWS[view].strip()})" for view in views)
        statements[name] = f"WITH {chain} {sql.strip()}" if chain else sql.strip()
    return statements
