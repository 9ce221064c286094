"""Block lists as JSON -> typed blocks; replies of vision models -> blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = (
    "array<struct<type:string,text:string,text_level:int,page_idx:int,bbox:array<double>,img_path:string,"
    "text_detected:array<string>,html:string,list_items:array<string>>>"
)
REPLY = "struct<blocks:array<struct<type:string,number:int,text:string,options:array<string>,description:string,latex:string>>>"


def parse_content_list(df: DataFrame, items: str = "items", page_offset: int = 0) -> DataFrame:
    """(doc_id, item_pos, sub_pos, block_type, content, bbox, page_idx, img_path, text_level) from ``doc_id`` and a JSON list.

    Lists become one text block per non-blank item, with the list's box and page; types other than text, equation, image,
    table and list are dropped; missing fields get their defaults; what isn't a JSON list gives no rows.
    """
    e = df.select("doc_id", F.posexplode(F.from_json(F.col(items), ITEM)).alias("item_pos", "i"))
    entry = F.transform(F.coalesce("i.list_items", F.array().cast("array<string>")), lambda x: F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.text")).otherwise(x))
    texts = (
        F.when(F.col("i.type") == "list", F.filter(entry, lambda x: F.length(F.trim(F.coalesce(x, F.lit("")))) > 0))
        .when(F.col("i.type") == "image", F.array(F.coalesce(F.get("i.text_detected", F.lit(0)), F.lit(""))))
        .when(F.col("i.type") == "table", F.array(F.coalesce("i.html", "i.text", F.lit(""))))
        .when(F.col("i.type").isin("text", "equation"), F.array(F.coalesce("i.text", F.lit(""))))
    )
    r = e.select("*", F.posexplode(texts).alias("sub_pos", "content"))
    kind = F.when(F.col("i.type") == "list", "text").otherwise(F.col("i.type"))
    return r.select("doc_id", "item_pos", "sub_pos", kind.alias("block_type"), "content", F.col("i.bbox").alias("bbox"), (F.coalesce("i.page_idx", F.lit(0)) + page_offset).alias("page_idx"), F.col("i.img_path").alias("img_path"), F.coalesce("i.text_level", F.lit(0)).alias("text_level"))


def parse_model_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """(key columns, pos, block_type, number, content, options): blocks of the first {...} in a model's reply; unreadable replies give none."""
    body = F.from_json(F.regexp_extract(F.col(reply), r"\{[\s\S]*\}", 0), REPLY)
    keys = [c for c in df.columns if c != reply]
    e = df.select(*keys, F.posexplode(body["blocks"]).alias("pos", "b"))
    content = F.when(F.col("b.type") == "image", F.col("b.description")).when(F.col("b.type") == "equation", F.col("b.latex")).otherwise(F.col("b.text"))
    return e.select(*keys, "pos", F.col("b.type").alias("block_type"), F.col("b.number").alias("number"), F.coalesce(content, F.lit("")).alias("content"), F.coalesce("b.options", F.array().cast("array<string>")).alias("options"))


def to_content_list(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse for blocks of one page: ``keys`` and ``items``, a JSON list in reading order."""
    item = F.struct(
        F.col("block_type").alias("type"),
        F.when(F.col("block_type").isin("text", "equation"), F.col("content")).alias("text"),
        F.col("text_level"), F.col("page_idx"), F.col("bbox"), F.col("img_path"),
        F.when((F.col("block_type") == "image") & F.col("content").isNotNull(), F.array("content")).alias("text_detected"),
        F.when(F.col("block_type") == "table", F.col("content")).alias("html"),
    )
    return blocks.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "block_id", item.alias("item")))), lambda x: x["item"])).alias("items"))
