"""Declared schemas of the raw inputs (no inference anywhere)."""

from pyspark.sql import types as T

RAW_TRANSACTIONS = T.StructType([
    T.StructField("t_dat", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("sales_channel_id", T.IntegerType())])

RAW_CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("FN", T.DoubleType()),
    T.StructField("Active", T.DoubleType()), T.StructField("club_member_status", T.StringType()),
    T.StructField("fashion_news_frequency", T.StringType()), T.StructField("age", T.DoubleType()),
    T.StructField("postal_code", T.StringType())])

_ART_TEXT = ["prod_name", "product_type_name", "product_group_name", "graphical_appearance_name",
             "colour_group_name", "perceived_colour_value_name", "perceived_colour_master_name",
             "department_name", "index_code", "index_name", "index_group_name", "section_name",
             "garment_group_name", "detail_desc"]
_ART_CODES = ["product_code", "product_type_no", "graphical_appearance_no", "colour_group_code",
              "perceived_colour_value_id", "perceived_colour_master_id", "department_no", "index_group_no",
              "section_no", "garment_group_no"]
RAW_ARTICLES = T.StructType([T.StructField("article_id", T.StringType())]
                            + [T.StructField(c, T.DoubleType()) for c in _ART_CODES]
                            + [T.StructField(c, T.StringType()) for c in _ART_TEXT])

MODEL_CONFIG = T.StructType([
    T.StructField("embedding_dim", T.IntegerType()), T.StructField("user_id_col", T.StringType()),
    T.StructField("item_id_col", T.StringType()), T.StructField("top_k", T.IntegerType())])
