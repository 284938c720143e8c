"""Landed responses: reading, decoding, labelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.codec import decode_body
from folioflow.functions.text import SPACE, strip_space, text_or_blank
from folioflow.schemas import PAGES

# Phrases that mark an interception page.
BLOCK_PHRASES = [
    r"(?i)just a moment\.\.\.",
    r"(?i)cf-browser-verification",
    r"(?i)enable javascript and cookies to continue",
    r"访问过于频繁|请求过于频繁|访问频繁",
    r"您的访问出现异常|安全验证|滑动验证|人机验证",
    r"(?i)403 Forbidden",
]
CLOUDFLARE = "站点启用了 Cloudflare 防护，服务器 IP 被拦截"
TOO_MANY = "请求过于频繁（HTTP 429），请降低并发或稍后重试"
BLOCKED = "疑似被站点风控拦截："


def scan_pages(spark: SparkSession, path: str, schema: T.StructType = PAGES, streaming: bool = False) -> DataFrame:
    """Responses a crawler landed as parquet, as a table or as a stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


def decode_pages(pages: DataFrame) -> DataFrame:
    """Replace the ``body`` bytes by decoded ``text``."""
    text = decode_body(F.col("body"), F.col("content_type"), F.col("charset"))
    return pages.withColumn("text", text).drop("body")


def classify_fetch(pages: DataFrame) -> DataFrame:
    """Label responses outside 2xx with an error code and a message."""
    head = F.substring(text_or_blank(F.col("text")), 1, 3000)
    phrase = reduce(lambda a, b: a | b, [head.rlike(p) for p in BLOCK_PHRASES])
    excerpt = strip_space(F.substring(F.regexp_replace(head, f"[{SPACE}]+", " "), 1, 80))
    status = F.col("status")
    blocked = (
        F.when((status == 403) & text_or_blank(F.col("server")).rlike("(?i)cloudflare"), CLOUDFLARE)
        .when(status == 429, TOO_MANY)
        .when(phrase, F.concat(F.lit(BLOCKED), excerpt))
        .otherwise("")
    )
    gone = status.isin(404, 410)
    ok = status.between(200, 299)
    return pages.withColumn(
        "error_code",
        F.when(ok, "").when((blocked == "") & gone, "UPSTREAM_NOT_FOUND").otherwise("UPSTREAM_ERROR"),
    ).withColumn(
        "error",
        F.when(ok, "").when(blocked != "", blocked)
        .when(gone, F.concat(F.lit("书源站点返回 "), status, F.lit("：该页面不存在或已失效（"), F.col("final_url"), F.lit("）")))
        .otherwise(F.concat(F.lit("HTTP "), status)),
    )
