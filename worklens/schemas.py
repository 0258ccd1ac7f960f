"""Explicit schemas of the exported documents and tables; nothing is inferred."""

from pyspark.sql import types as T

_S = T.StringType()

ASSET = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("name", _S),
        T.StructField("file_extension", _S),
        T.StructField("file_size", _S),
        T.StructField("url", _S),
        T.StructField("public_url", _S),
        T.StructField("created_at", _S),
    ]
)

COLUMN_VALUE = T.StructType(
    [
        T.StructField("column", T.StructType([T.StructField("title", _S)])),
        T.StructField("id", _S),
        T.StructField("type", _S),
        T.StructField("value", _S),
        T.StructField("text", _S),
        T.StructField("display_value", _S),
    ]
)

ITEM = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("item_id", _S),
        T.StructField("state", _S),
        T.StructField("name", _S),
        T.StructField("updated_at", _S),
        T.StructField("created_at", _S),
        T.StructField("account_id", _S),
        T.StructField("account", T.StructType([T.StructField("id", _S)])),
        T.StructField("board_id", _S),
        T.StructField(
            "board",
            T.StructType(
                [
                    T.StructField("id", _S),
                    T.StructField("name", _S),
                    T.StructField("account", T.StructType([T.StructField("id", _S)])),
                ]
            ),
        ),
        T.StructField("group_id", _S),
        T.StructField("group_title", _S),
        T.StructField("group", T.StructType([T.StructField("id", _S), T.StructField("title", _S)])),
        T.StructField("assets", T.ArrayType(ASSET)),
        T.StructField("column_values", T.ArrayType(COLUMN_VALUE)),
        T.StructField(
            "updates",
            T.ArrayType(
                T.StructType([T.StructField("id", _S), T.StructField("assets", T.ArrayType(ASSET))])
            ),
        ),
    ]
)

# JSON text inside a file column.
FILE_COLUMN = T.StructType(
    [
        T.StructField(
            "files",
            T.ArrayType(T.StructType([T.StructField("assetId", _S), T.StructField("name", _S)])),
        )
    ]
)

RAW_EVENT = T.StructType([T.StructField("received_at", T.TimestampType()), T.StructField("payload", _S)])

IDENTITY = T.StructType([T.StructField("input_revision", _S), T.StructField("pipeline_version", _S)])

CSV_DOCUMENT = T.StructType(
    [
        T.StructField("path", _S),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("parameter", _S),
        T.StructField("value", _S),
        T.StructField("source", _S),
        T.StructField("text", _S),
    ]
)

CSV_ROW = T.StructType(
    [
        T.StructField("path", _S),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("fields", T.MapType(_S, _S)),
    ]
)

EMAIL_PART = T.StructType(
    [
        T.StructField("path", _S),
        T.StructField("part_index", T.IntegerType()),
        T.StructField("part_kind", _S),
        T.StructField("filename", _S),
        T.StructField("mime_type", _S),
        T.StructField("content_id", _S),
        T.StructField("text", _S),
        T.StructField("content", T.BinaryType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("sha256", _S),
        T.StructField("error", _S),
    ]
)
