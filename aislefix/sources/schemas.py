"""Explicit schemas of the input tables; nothing is inferred from files."""

from __future__ import annotations

SHOPS = (
    "shop_id string, category_id string, longitude double, latitude double, price double, mall_id string"
)
VISITS = (
    "user_id string, shop_id string, time_stamp timestamp_ntz, longitude double, latitude double, wifi_infos string"
)
QUERY_ROWS = (
    "row_id bigint, user_id string, mall_id string, time_stamp timestamp_ntz, longitude double, latitude double, "
    "wifi_infos string"
)
PRIOR_TRAIN = "row_id bigint, shop_id string, label int, shop_index int"
PRIOR_ANSWER = "row_id bigint, shop_id string, shop_index int"
ANSWER = "row_id bigint, shop_id string"
