"""Token counts of fields and sections by offset-mapped attribution.

The fields of a row are written one after another, with ``SEPARATOR`` between, and the whole document is encoded once with a
byte-level BPE vocabulary. A byte-level token covers as many bytes of the text as its own byte string has, so running
sums of these lengths are the tokens' spans. Spans are joined to the sections, which are sorted and do not overlap, by
binary search: ``RULE`` "start" gives a token that crosses a boundary to the section of its first byte, "end" to that of its
last byte, "share" splits it by bytes. Separators are a section of their own, so every token is counted exactly once.

The vocabulary file is a parameter; each worker reads it once. Whole texts are encoded, however long.

Defined results: a null field is an empty one and has no tokens; fields that are no texts count as their text form; repeated
rows have equal counts; a token that ends at a boundary does not cross it; empty tables give empty results; extra columns pass
through, whatever their names, and columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, byte_texts, carried, column_chunks, extended, from_batches, restored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = b"\n\n"
RULE = "start"

_encoders: dict = {}


def encoder(path: str):
    """(encoding, byte length of each token) of a vocabulary of lines "base64 rank"."""
    if path not in _encoders:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encoders[path]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. ``ends``: end of each token; ``bounds``: end of each section; both ascending."""
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends, side="left")
    if rule == "start":
        return np.bincount(first, minlength=len(bounds)).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=len(bounds)).astype(float)
    out = np.bincount(first[first == last], minlength=len(bounds)).astype(float)
    for a, b, i, j in zip(*(x[first != last].tolist() for x in (starts, ends, first, last)), strict=True):
        for s in range(i, j + 1):
            out[s] += (min(b, bounds[s]) - max(a, bounds[s - 1] if s else 0)) / (b - a)
    return out


def crossing(ends: np.ndarray, bounds: np.ndarray) -> int:
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return int((np.searchsorted(bounds, starts, side="right") != np.searchsorted(bounds, ends, side="left")).sum())


def count_tokens(docs: DataFrame, fields: list[str], lines: bool = False, rule: str = RULE, vocabulary: str = VOCABULARY, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with n_tokens (long), field_tokens (array<double>, one a field), separator_tokens, n_crossing (long).

    ``lines``: also line_tokens (array<double>): the sections are the lines of the last field, each with its line break.
    """
    added = "n_tokens long, field_tokens array<double>, separator_tokens double, n_crossing long, line_tokens array<double>"
    names = [x.split()[0] for x in added.split(", ")]
    own = [f"f{i}" for i in range(len(fields))]
    gone = tuple(o for o, f in zip(own, fields, strict=True) if f in drop or f in names)
    rows = docs.select(carried(docs, *names, *drop, *fields), *[F.col(f"`{f}`").cast("string").alias(o) for o, f in zip(own, fields, strict=True)])
    schema, arrow = arrow_schema(added, rows, gone)

    def count(batches):
        import pyarrow as pa

        encoding, lengths = encoder(vocabulary)
        for batch, _ in column_chunks(batches, own[-1]):
            columns = [byte_texts(batch.column(batch.schema.get_field_index(f))) for f in own]
            totals, by_field, between, crossed, by_line = [], [], [], [], []
            for row in zip(*columns, strict=True):
                row = [x or b"" for x in row]
                parts = [x for f in row for x in (f, SEPARATOR)][:-1]
                # the sections: fields and separators in turn; the last field in lines if asked for
                cut = [x + b"\n" for x in parts[-1].split(b"\n")] if lines else [parts[-1]]
                if lines:
                    cut[-1] = cut[-1][:-1]
                bounds = np.cumsum([len(x) for x in [*parts[:-1], *cut]])
                ids = encoding.encode_ordinary(b"".join(parts).decode())
                ends = np.cumsum(lengths[ids]) if ids else np.empty(0, np.int64)
                n = attribute(ends, bounds, rule)
                head = len(parts) - 1
                totals.append(len(ids))
                by_field.append([*n[:head:2].tolist(), float(n[head:].sum())])
                between.append(float(n[1:head:2].sum()))
                crossed.append(crossing(ends, bounds))
                by_line.append(n[head:].tolist() if lines else None)
            made = [pa.array(totals, pa.int64()), pa.array(by_field, pa.list_(pa.float64())), pa.array(between, pa.float64()), pa.array(crossed, pa.int64()), pa.array(by_line, pa.list_(pa.float64()))]
            yield extended(batch, made, arrow, gone)

    return restored(from_batches(rows, count, schema), *[F.col(o).alias(f) for o, f in zip(own, fields, strict=True) if o not in gone], *names)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    out = count_tokens(docs, ["source", "lang", "text"], lines=True, drop=("source", "lang", "text"))
    whole = lambda c: c.cast("long")
    return out.select(
        "doc_id",
        "n_tokens",
        whole(F.get("field_tokens", F.lit(0))).alias("source_tokens"),
        whole(F.get("field_tokens", F.lit(1))).alias("lang_tokens"),
        whole(F.get("field_tokens", F.lit(2))).alias("text_tokens"),
        whole(F.col("separator_tokens")).alias("separator_tokens"),
        "n_crossing",
        F.transform("line_tokens", whole).alias("line_tokens"),
    )


QUERIES = {"op9_tokens": op9_tokens}
ORACLE: dict[str, str] = {}
