"""Text rules as Column functions: strip, collapse, truncate, chunk, display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from worklens import vocab

# Unicode white space as ``str.strip`` and ``str.split`` see it; the same class
# works in Java and in RE2, so SQL checks can reuse it.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# The same characters as a trim set: trimming by set is far cheaper than a regex.
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(WS_CHARS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Strip and turn every run of white space into one space; NULL becomes empty."""
    return F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), f"{WS}+", " ")


def fold(c: Column | str) -> Column:
    """Comparison key of a search query (``lower``; full case folding is not available)."""
    return F.lower(collapse(c))


def without_nul(c: Column | str) -> Column:
    return F.replace(F.coalesce(col(c), F.lit("")), F.lit("\x00"), F.lit(""))


def limited(c: Column | str, limit: int | None) -> Column:
    """Stripped display text, cut at ``limit`` characters with an ellipsis; ``None`` cuts nothing."""
    text = strip(F.coalesce(col(c).cast("string"), F.lit("")))
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def chunks(
    c: Column | str,
    size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    max_chars: int | None = None,
    max_chunks: int | None = None,
) -> Column:
    """``array<struct<chunk_index,chunk_total,chunk_start,chunk_end,chunk_text>>`` of overlapping windows.

    One regular-expression pass cuts the text into strides; a window is a stride
    plus the head of the following ones, so the work is linear in the text.
    ``max_chars`` and ``max_chunks`` are off unless the caller asks for them.
    """
    stride = size - overlap
    text = strip(without_nul(c))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    if overlap > stride:
        raise ValueError("the overlap must not exceed the stride")

    def cut(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
        return F.struct(pieces.alias("pieces"), F.length(t).alias("n"))

    def windows(bound: Column) -> Column:
        p, n = bound["pieces"], bound["n"]
        count = F.greatest(F.lit(1), F.ceil((n - overlap) / F.lit(float(stride))).cast("int"))
        if max_chunks is not None:
            count = F.least(count, F.lit(max_chunks))

        def window(piece: Column, i: Column) -> Column:
            start = i * stride
            tail = F.coalesce(F.try_element_at(p, i + 2), F.lit(""))
            return F.struct(
                (i + 1).alias("chunk_index"),
                count.alias("chunk_total"),
                start.alias("chunk_start"),
                F.least(n, start + size).alias("chunk_end"),
                F.concat(piece, F.substring(tail, 1, overlap)).alias("chunk_text"),
            )

        return F.transform(F.slice(p, F.lit(1), count), window)

    # One-element transforms bind the stripped text and its pieces once for all uses.
    return F.flatten(F.transform(F.transform(F.array(text), cut), windows))


def section_label(
    section: Column | str, kind: Column | str, index: Column | str, start: Column | str, end: Column | str, total: Column | str
) -> Column:
    """Label of a chunk: the given section, numbered when there are several chunks."""
    section, index = col(section), col(index)
    numbered = F.concat(F.lit("chunk:"), index.cast("string"))
    offsets = F.concat(F.lit("offset:"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))
    given = F.length(F.coalesce(section, F.lit(""))) > 0
    return (
        F.when(given & (col(total) > 1), F.concat(section, F.lit(":"), numbered))
        .when(given, section)
        .when(col(kind) == "pdf", numbered)
        .otherwise(offsets)
    )


def display_section(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)^(.*):chunk:\d+\z", "$1")


DISCLAIMER = "(?:" + "|".join(vocab.DISCLAIMER_PATTERNS) + ")"


def evidence_snippet(snippet: Column | str, section: Column | str, filename: Column | str) -> Column:
    """Snippet without a mail disclaimer; other documents are only stripped."""
    text = strip(F.replace(F.coalesce(col(snippet), F.lit("")), F.lit("\r\n"), F.lit("\n")))
    from_mail = F.lower(F.coalesce(col(section), F.lit(""))).startswith("email:") | F.lower(
        F.coalesce(col(filename), F.lit(""))
    ).endswith(".msg")
    cut = rstrip(F.regexp_replace(text, f"(?dimsU){DISCLAIMER}.*", ""))
    return F.when(from_mail, cut).otherwise(text)


def safe_filename(c: Column | str) -> Column:
    flat = F.translate(strip(F.coalesce(col(c), F.lit(""))), "\\/", "__")
    return F.coalesce(F.nullif(F.regexp_replace(flat, "[^A-Za-z0-9._-]+", "_"), F.lit("")), F.lit("file"))


def json_text_after_prefix(c: Column | str, prefix: str) -> Column:
    return F.regexp_extract(col(c), rf"(?s){prefix}(.*)\z", 1)
