"""Schemas of all layers, as DDL; the single place where column names and orders are stated."""

from __future__ import annotations

LOG = """
common STRUCT<ar:STRING, uid:STRING, os:STRING, ch:STRING, is_new:STRING, md:STRING, mid:STRING, vc:STRING, ba:STRING>,
page STRUCT<page_id:STRING, item:STRING, during_time:BIGINT, item_type:STRING, last_page_id:STRING, source_type:STRING>,
start STRUCT<entry:STRING, open_ad_skip_ms:BIGINT, open_ad_ms:BIGINT, loading_time:BIGINT, open_ad_id:BIGINT>,
displays ARRAY<STRUCT<display_type:STRING, item:STRING, item_type:STRING, pos_id:INT, `order`:INT>>,
actions ARRAY<STRUCT<item:STRING, action_id:STRING, item_type:STRING, ts:BIGINT>>,
ts BIGINT
"""
DISPLAY = "display_type STRING, page_id STRING, item STRING, item_type STRING, pos_id INT, `order` INT"
PAGE_VIEW = "common MAP<STRING,STRING>, page MAP<STRING,STRING>, ts BIGINT"
CHANGE = "database STRING, tableName STRING, before MAP<STRING,STRING>, after MAP<STRING,STRING>, type STRING"
ROUTES = "sourceTable STRING, operateType STRING, sinkType STRING, sinkTable STRING, sinkColumns STRING, sinkPk STRING, sinkExtend STRING"

ORDER_INFO = """
id BIGINT, province_id BIGINT, order_status STRING, user_id BIGINT, total_amount DECIMAL(18,2), activity_reduce_amount DECIMAL(18,2),
coupon_reduce_amount DECIMAL(18,2), original_total_amount DECIMAL(18,2), feight_fee DECIMAL(18,2), expire_time STRING, create_time STRING, operate_time STRING
"""
ORDER_DETAIL = """
id BIGINT, order_id BIGINT, sku_id BIGINT, order_price DECIMAL(18,2), sku_num BIGINT, sku_name STRING, create_time STRING,
split_total_amount DECIMAL(18,2), split_activity_amount DECIMAL(18,2), split_coupon_amount DECIMAL(18,2)
"""
PAYMENT_INFO = "id BIGINT, order_id BIGINT, user_id BIGINT, total_amount DECIMAL(18,2), subject STRING, payment_type STRING, create_time STRING, callback_time STRING"
FAVOR_INFO = CART_INFO = "sku_id BIGINT, create_time STRING"
REFUND_INFO = "order_id BIGINT, sku_id BIGINT, refund_amount DECIMAL(18,2), create_time STRING"
COMMENT_INFO = "sku_id BIGINT, appraise STRING, create_time STRING"

#: Columns of the sinks, in their order.
ORDER_WIDE = (
    "detail_id order_id sku_id order_price sku_num sku_name province_id order_status user_id total_amount activity_reduce_amount "
    "coupon_reduce_amount original_total_amount feight_fee split_feight_fee split_activity_amount split_coupon_amount split_total_amount "
    "expire_time create_time operate_time create_date create_hour province_name province_area_code province_iso_code province_3166_2_code "
    "user_age user_gender spu_id tm_id category3_id spu_name tm_name category3_name"
).split()
PAYMENT_WIDE = (
    "payment_id subject payment_type payment_create_time callback_time detail_id order_id sku_id order_price sku_num sku_name province_id "
    "order_status user_id total_amount activity_reduce_amount coupon_reduce_amount original_total_amount feight_fee split_feight_fee "
    "split_activity_amount split_coupon_amount split_total_amount order_create_time province_name province_area_code province_iso_code "
    "province_3166_2_code user_age user_gender spu_id tm_id category3_id spu_name tm_name category3_name"
).split()
VISITOR_STATS = "stt edt vc ch ar is_new uv_ct pv_ct sv_ct uj_ct dur_sum ts".split()
PRODUCT_STATS = (
    "stt edt sku_id sku_name sku_price spu_id spu_name tm_id tm_name category3_id category3_name display_ct click_ct favor_ct cart_ct "
    "order_sku_num order_amount order_ct payment_amount paid_order_ct refund_order_ct refund_amount comment_ct good_comment_ct ts"
).split()
PROVINCE_STATS = "stt edt province_id province_name area_code iso_code iso_3166_2 order_amount order_count ts".split()
KEYWORD_STATS = "keyword ct source stt edt ts".split()

#: Keys by which the OLAP tables keep the latest version of a row, and how they are partitioned.
OLAP_KEYS = {
    "visitor_stats": ["stt", "edt", "is_new", "vc", "ch", "ar"],
    "product_stats": ["stt", "edt", "sku_id"],
    "province_stats": ["stt", "edt", "province_id"],
}

#: Codes of the business tables.
SINK_FACT, SINK_DIM, SINK_OLAP = "kafka", "hbase", "clickhouse"
APPRAISE_GOOD = "1201"
CODES = {
    "order_status": {"unpaid": "1001", "paid": "1002", "cancelled": "1003", "finished": "1004", "refunding": "1005", "refunded": "1006"},
    "payment_type": {"alipay": "1101", "wechat": "1102", "union": "1103"},
    "appraise": {"good": "1201", "soso": "1202", "bad": "1203", "auto": "1204"},
}
KEYWORD_SOURCES = {"search": "SEARCH", "click": "CLICK", "cart": "CART", "order": "ORDER"}
