"""Service layer: windowed statistics of visitors, products, provinces and keywords."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import blank, seconds_text
from ..operators.joins import enrich
from ..operators.routing import union_all
from ..operators.windows import tumble, tumble_by_id

WINDOW = "10 seconds"
VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
VISITOR_SUMS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]


def visitor_rows(df: DataFrame, *more: str, **measures: Column) -> DataFrame:
    """The common columns of visitor records, with the measures that are given and zeros for the others."""
    sums = [measures.get(m, F.lit(0)).cast("bigint").alias(m) for m in VISITOR_SUMS]
    return df.select(*VISITOR_KEYS, *sums, "ts", *more)


def visitor_union(unique: DataFrame, jumps: DataFrame, pages: DataFrame, *more: str) -> DataFrame:
    """Unique visits, bounces and page views as one stream of counts."""
    started = F.when(blank(F.col("last_page_id")), 1).otherwise(0)
    return union_all([
        visitor_rows(unique, *more, uv_ct=F.lit(1)),
        visitor_rows(jumps, *more, uj_ct=F.lit(1)),
        visitor_rows(pages, *more, pv_ct=F.lit(1), sv_ct=started, dur_sum=F.coalesce("during_time", F.lit(0))),
    ])


def visitor_stats(rows: DataFrame, event_time: str = "event_time", window: str = WINDOW, arrival: str | None = None, streaming: bool = False) -> DataFrame:
    """Counts by window and version, channel, area and newness.

    With ``arrival`` the compatible form: only dur_sum is summed, the other counts are
    those of the first record, and page views stay 0.
    """
    if arrival:
        first = [F.min_by(c, arrival).alias(c) if c != "pv_ct" else F.lit(0).cast("bigint").alias(c) for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct")]
        aggs = [*first, F.sum("dur_sum").alias("dur_sum"), F.min_by("ts", arrival).alias("ts")]
    else:
        aggs = [*[F.sum(c).alias(c) for c in VISITOR_SUMS], F.min("ts").alias("ts")]
    return tumble(rows, event_time, window, VISITOR_KEYS, aggs, streaming=streaming).select(*schemas.VISITOR_STATS)


PRODUCT_SUMS = "display_ct click_ct favor_ct cart_ct order_sku_num comment_ct good_comment_ct".split()
PRODUCT_AMOUNTS = "order_amount payment_amount refund_amount".split()
PRODUCT_IDS = {"order_ct": "order_id", "paid_order_ct": "paid_id", "refund_order_ct": "refund_id"}


def product_rows(df: DataFrame, *more: str, sku: Column | str = "sku_id", **measures: Column) -> DataFrame:
    """The common columns of product records; measures that aren't given are 0, ids null."""
    sums = [measures.get(m, F.lit(0)).cast("bigint").alias(m) for m in PRODUCT_SUMS]
    amounts = [measures.get(m, F.lit(0)).cast("decimal(18,2)").alias(m) for m in PRODUCT_AMOUNTS]
    ids = [measures.get(m, F.lit(None)).cast("bigint").alias(m) for m in PRODUCT_IDS.values()]
    sku = F.col(sku) if isinstance(sku, str) else sku
    return df.select(sku.cast("bigint").alias("sku_id"), *sums, *amounts, *ids, "ts", *more)


def clicks_and_displays(pages: DataFrame, *more: str) -> DataFrame:
    """A click for a product's page, and a display for each product shown; both at the page's time."""
    one = F.lit(1)
    clicks = pages.where("page_id = 'good_detail' AND item_type = 'sku_id'")
    shown = pages.select("ts", *more, F.explode("displays").alias("d")).where("d.item_type = 'sku_id'")
    return union_all([
        product_rows(clicks, *more, sku=F.col("item").try_cast("bigint"), click_ct=one),
        product_rows(shown, *more, sku=F.col("d.item").try_cast("bigint"), display_ct=one),
    ])


def product_union(pages: DataFrame, orders: DataFrame, payments: DataFrame, carts: DataFrame, favors: DataFrame, refunds: DataFrame, comments: DataFrame, *more: str) -> DataFrame:
    """All seven sources of product records; each has ts in milliseconds."""
    one = F.lit(1)
    good = F.when(F.col("appraise") == schemas.APPRAISE_GOOD, 1).otherwise(0)
    return union_all([
        clicks_and_displays(pages, *more),
        product_rows(favors, *more, favor_ct=one),
        product_rows(carts, *more, cart_ct=one),
        product_rows(orders, *more, order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"), order_id=F.col("order_id")),
        product_rows(payments, *more, payment_amount=F.col("split_total_amount"), paid_id=F.col("order_id")),
        product_rows(refunds, *more, refund_amount=F.col("refund_amount"), refund_id=F.col("order_id")),
        product_rows(comments, *more, comment_ct=one, good_comment_ct=good),
    ])


def product_stats(rows: DataFrame, event_time: str = "event_time", window: str = WINDOW, streaming: bool = False) -> DataFrame:
    """Sums and distinct orders by window and sku; dimensions come after, when there are fewer rows.

    A record's order, payment and refund ids, where it has them, are one order's id.
    """
    aggs = {c: F.sum for c in (*PRODUCT_SUMS, *PRODUCT_AMOUNTS)} | {"ts": F.min}
    if streaming:
        return tumble(rows, event_time, window, ["sku_id"], [f(c).alias(c) for c, f in aggs.items()], PRODUCT_IDS, streaming)
    return tumble_by_id(rows, event_time, window, ["sku_id"], aggs, PRODUCT_IDS)


def with_product_dimensions(stats: DataFrame, dims: Mapping[str, DataFrame], how: str = "left") -> DataFrame:
    out = enrich(stats, dims["sku"], "sku_id", {"sku_name": "SKU_NAME", "sku_price": "PRICE", "spu_id": "SPU_ID", "tm_id": "TM_ID", "category3_id": "CATEGORY3_ID"}, how=how)
    out = enrich(out, dims["spu"], "spu_id", {"spu_name": "SPU_NAME"}, how=how)
    out = enrich(out, dims["category3"], "category3_id", {"category3_name": "NAME"}, how=how)
    out = enrich(out, dims["trademark"], "tm_id", {"tm_name": "TM_NAME"}, how=how)
    typed = {c: F.col(c).try_cast("bigint") for c in ("spu_id", "tm_id", "category3_id")} | {"sku_price": F.col("sku_price").try_cast("decimal(18,2)")}
    return out.withColumns(typed).select(*schemas.PRODUCT_STATS)


def province_stats_sql(view: str = "order_wide", window: str = WINDOW, streaming: bool = False, whole_units: bool = False, as_of: str = "unix_timestamp() * 1000") -> str:
    """SQL over a view with the row time ``rt``; ``whole_units`` rounds amounts first, as a decimal without precision does."""
    orders = "size(collect_set(order_id))" if streaming else "count(DISTINCT order_id)"
    amount = "CAST(split_total_amount AS DECIMAL(10,0))" if whole_units else "split_total_amount"
    return f"""
      SELECT date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS stt, date_format(w.end, 'yyyy-MM-dd HH:mm:ss') AS edt,
             province_id, province_name, area_code, iso_code, iso_3166_2, order_amount, order_count, {as_of} AS ts
      FROM (SELECT window(rt, '{window}') AS w, province_id, province_name, province_area_code AS area_code, province_iso_code AS iso_code,
                   province_3166_2_code AS iso_3166_2, sum({amount}) AS order_amount, CAST({orders} AS BIGINT) AS order_count
            FROM {view}
            GROUP BY window(rt, '{window}'), province_id, province_name, province_area_code, province_iso_code, province_3166_2_code)"""


def keyword_stats_sql(view: str = "page_view", window: str = WINDOW, source: str = "search", as_of: str = "unix_timestamp() * 1000") -> str:
    """SQL over a view of full_word and the row time ``rt``, by the table function ``split_words``."""
    return f"""
      SELECT word AS keyword, ct, '{source}' AS source, date_format(w.start, 'yyyy-MM-dd HH:mm:ss') AS stt,
             date_format(w.end, 'yyyy-MM-dd HH:mm:ss') AS edt, {as_of} AS ts
      FROM (SELECT window(rt, '{window}') AS w, word, count(*) AS ct FROM {view}, LATERAL split_words(full_word) GROUP BY window(rt, '{window}'), word)"""


def keyword_stats(views: DataFrame, words: Column, rt: str = "rt", window: str = WINDOW, source: str = "search") -> DataFrame:
    """The same without Python: ``words`` is an array of the words of full_word; texts without words give no row."""
    tokens = views.select(rt, F.explode(words).alias("keyword"))
    counted = tokens.groupBy(F.window(rt, window).alias("w"), "keyword").agg(F.count(F.lit(1)).alias("ct"))
    return counted.select("keyword", "ct", F.lit(source).alias("source"), seconds_text(F.col("w.start")).alias("stt"), seconds_text(F.col("w.end")).alias("edt"))
