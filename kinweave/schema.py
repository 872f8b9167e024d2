"""Schemas of the data model. Node ids may be of any orderable type; files use UUID strings."""

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

ENTITIES = StructType([StructField("id", StringType(), False), StructField("name", StringType()), StructField("url", StringType())])
EDGES = StructType([StructField("src", StringType()), StructField("dst", StringType()), StructField("sim", FloatType()), StructField("pos", IntegerType())])
GRAPH_LINE = StructType([StructField("id", StringType()), StructField("connections", ArrayType(ArrayType(StringType())))])
CRAWL_STATE = StructType([StructField("processed_mbids", ArrayType(StringType())), StructField("queue", ArrayType(StringType()))])
TRACK = StructType([StructField(n, StringType()) for n in ("name", "url", "playcount", "listeners", "preview_url")])
LASTFM = StructType([StructField(n, StringType()) for n in ("url", "image_url", "listeners", "playcount")] + [StructField("tags", ArrayType(StringType())), StructField("bio_summary", StringType()), StructField("bio_full", StringType())])
CACHED = StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("url", StringType()), StructField("last_fetched", LongType()), StructField("lastfm", LASTFM), StructField("tracks", ArrayType(TRACK))])
