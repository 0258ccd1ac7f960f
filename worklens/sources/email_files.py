"""Mail files (.eml): header block, body and attachments, one row per part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from worklens import schemas, vocab
from worklens.functions.dates import mail_date_in_london

HEADERS = ("from", "to", "subject", "date")
#: What a parser tells about a file; everything else is decided in columns.
PARSED = (
    "path string, error string, headers map<string,string>, several boolean, "
    "texts array<struct<type:string,text:string>>, files array<struct<name:string,type:string,cid:string,content:binary>>"
)
Parser = Callable[[bytes], dict]


def standard_parser() -> Parser:
    """The mail parser of the standard library."""
    reader = BytesParser(policy=policy.default)

    def parse(content: bytes) -> dict:
        message = reader.parsebytes(content)
        leaves = [part for part in message.walk() if not part.is_multipart()]
        return {
            "headers": {name: str(message.get(name, "")) for name in HEADERS},
            "several": message.is_multipart(),
            "texts": [(p.get_content_type(), p.get_content()) for p in leaves if p.get_content_maintype() == "text" and not p.get_filename()],
            "files": [
                (p.get_filename(), p.get_content_type(), p.get("Content-ID"), p.get_payload(decode=True) or b"")
                for p in message.iter_attachments()
                if p.get_filename()
            ],
        }

    return parse


def _read(make_parser: Callable[[], Parser]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    fields = ("headers", "several", "texts", "files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make_parser()
        for batch in batches:
            # One file at a time: the attachments of a batch together may be large.
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    told, error = parse(bytes(content)), None
                except Exception as failure:  # the row carries the error
                    told, error = {}, str(failure)
                yield pd.DataFrame({"path": [path], "error": [error], **{f: [told.get(f)] for f in fields}})

    return run


def _part(kind: Column, **values: Column) -> Column:
    """A part as a struct of all columns but path and index, missing ones null."""
    own = {"part_kind": kind, **values}
    return F.struct(
        *[
            own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.EMAIL_PART.fields
            if f.name not in ("path", "part_index")
        ]
    )


def parse_mails(
    files: DataFrame, html_fallback: bool = True, make_parser: Callable[[], Parser] = standard_parser
) -> DataFrame:
    """Parts of every mail: header, body, attachment, inline, or error.

    ``html_fallback`` takes the HTML body when no plain text exists (ingest);
    the enquiry variant leaves the body empty. The header date is shown in
    Europe/London by Spark. ``.msg`` files have no reader here: each is one error row,
    as ``unreadable`` lists them. ``make_parser`` is called once per task.
    """
    foreign = F.lower("path").endswith(".msg")
    told = files.filter(~foreign).select("path", "content").mapInPandas(_read(make_parser), PARSED)

    date = F.col("headers")["date"]
    shown = F.when(date == "", date).otherwise(mail_date_in_london(date))
    lines = [("From: ", F.col("headers")["from"]), ("\nTo: ", F.col("headers")["to"]), ("\nSubject: ", F.col("headers")["subject"]), ("\nDate: ", shown)]
    block = F.concat(*[piece for label, value in lines for piece in (F.lit(label), value)], F.lit("\n"))

    def texts(kind: str) -> Column:
        own = F.filter("texts", lambda t: t["type"] == kind)
        return F.nullif(F.array_join(F.transform(own, lambda t: F.concat(t["text"], F.lit("\n"))), ""), F.lit(""))

    kinds = ("text/plain", "text/html") if html_fallback else ("text/plain",)
    single = F.try_element_at("texts", F.lit(1))["text"]
    body = F.coalesce(F.when(F.col("several"), F.coalesce(*[texts(k) for k in kinds])).otherwise(single), F.lit(""))

    def attached(file: Column) -> Column:
        image = F.lower(file["name"]).rlike("(" + "|".join(e.replace(".", r"\.") for e in vocab.INLINE_IMAGE_ENDINGS) + ")$")
        inline = image & (F.coalesce(file["cid"], F.lit("")) != "")
        return _part(
            F.when(inline, F.lit("inline")).otherwise("attachment"),
            filename=file["name"],
            mime_type=file["type"],
            content_id=file["cid"],
            content=file["content"],
            size_bytes=F.length(file["content"]),
            sha256=F.sha2(file["content"], 256),
        )

    read = F.concat(F.array(_part(F.lit("header"), text=block), _part(F.lit("body"), text=body)), F.transform("files", attached))
    parts = F.when(F.col("error").isNull(), read).otherwise(F.array(_part(F.lit("error"), error=F.col("error"))))
    rows = told.select("path", F.posexplode(parts).alias("part_index", "_p")).select("path", "part_index", "_p.*")
    rest = unreadable(files).select("path", F.lit(0).alias("part_index"), F.lit("error").alias("part_kind"), "error")
    return rows.unionByName(rest, allowMissingColumns=True)


def unreadable(files: DataFrame) -> DataFrame:
    """Mails in a format without a parser; a caller can feed them to a text extractor."""
    return files.filter(F.lower("path").endswith(".msg")).select("path", F.lit("unsupported_mail_format").alias("error"))
