"""Shared pieces of the operators of this folder."""

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import written  # noqa: F401  (re-exported for the operators)

WORD_SEPARATORS = "\x09\x0a\x0b\x0c\x0d\x20"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_docs(docs, id_col="doc_id", text_col="text", *more):
    """The columns an operator reads, under fixed names; a null text is an empty one. Other columns never clash."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def raw_tokens(text: str) -> list[str]:
    """Runs of anything but the six ASCII white space characters."""
    if text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text):
        return text.split()
    # bytes are split at those six only; str.split also splits at 0x1C-0x1F and at other spaces
    words = text.encode("utf-8", "surrogatepass").split()
    return b" ".join(words).decode("utf-8", "surrogatepass").split(" ") if words else []


def ascii_lower(text: str) -> str:
    """A-Z in lower case and nothing else changed."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def tokens_of(text: str) -> list[str]:
    """raw_tokens with A-Z in lower case."""
    return raw_tokens(ascii_lower(text))


def rows(schema: pa.Schema, columns: dict):
    """A record batch with exactly the columns of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def slices(batch: pa.RecordBatch, text="text", chars=4_000_000):
    """The batch cut into runs of rows of about so many bytes of text, one row at least."""
    lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    at = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def parts_for(size: int, each: int) -> int:
    return max(1, math.ceil(size / each))


def total_bytes(docs) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def training_fold(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo; null for a null doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))
