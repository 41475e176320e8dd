"""Token counts per field and section by offset-mapped attribution.

Each whole document is encoded once. The byte lengths of its tokens give every
token's span; the spans are interval-joined (two sorted lists, one binary
search each) to the sections, and a token that crosses a boundary is allocated
by an explicit rule:

- "first": to the section that holds the token's first byte,
- "last": to the section that holds its last byte,
- "most": to the section with most of its bytes, the earlier on a tie.

So the counts of a document's sections always add up to the count of the whole,
which separate encodings of the sections would not.

Rows: null and empty texts have no tokens and one empty section; empty sections
count 0; texts are encoded whole, however long; repeated rows give repeated
results; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, table

RULES = ("first", "last", "most")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file and the byte length of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    Both arrays hold ascending end offsets in bytes; spans start where the one
    before ends. Sections of no length get no token.
    """
    counts = np.zeros(len(section_ends), np.int64)
    if not len(token_ends) or not len(section_ends):
        return counts, 0
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crossing = first != last
    owner = {"first": first, "last": last, "most": first}[rule].copy()
    if rule == "most":
        bounds = np.concatenate(([0], section_ends))
        for i in np.flatnonzero(crossing):  # few: a token spans some bytes only
            inside = range(first[i], last[i] + 1)
            owner[i] = max(inside, key=lambda s: (min(bounds[s + 1], token_ends[i]) - max(bounds[s], starts[i]), -s))
    np.add.at(counts, owner, 1)
    return counts, int(crossing.sum())


def section_ends(text: bytes, separator: bytes = b"\n") -> np.ndarray:
    """Ends in bytes of the sections of a text; a separator belongs to the section before it."""
    ends, at = [], text.find(separator)
    while at >= 0:
        ends.append(at + len(separator))
        at = text.find(separator, at + len(separator))
    return np.array([*ends, len(text)], np.int64)


def count_tokens(fields: list[Column], path: str, pattern: str, separator: str = "\n", rule: str = "first") -> Column:
    """struct(n_tokens, n_crossing, field_tokens array, section_tokens array of arrays by field).

    The document is the fields joined by the separator; each field's sections
    end at a separator, and the separator that joins two fields belongs to the
    earlier field's last section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not fields or not separator:
        raise ValueError("at least one field and a separator are needed")

    @F.pandas_udf("n_tokens long, n_crossing long, field_tokens array<long>, section_tokens array<array<long>>")
    def count(*columns: pd.Series) -> pd.DataFrame:
        encode, lengths = encoding(path, pattern)
        gap, rows = separator.encode(), []
        for values in zip(*columns):
            parts = [(v or "") for v in values]
            raw = [p.encode() for p in parts]
            ends, base, sections = [], 0, []
            for k, part in enumerate(raw):
                own = section_ends(part, gap)
                own[-1] += len(gap) if k + 1 < len(raw) else 0
                ends.append(own + base)
                sections.append(len(own))
                base = int(ends[-1][-1])
            ids = encode.encode_ordinary(separator.join(parts))
            counts, crossing = attribute(np.cumsum(lengths[ids]) if ids else np.zeros(0, np.int64), np.concatenate(ends), rule)
            by_field = np.split(counts, np.cumsum(sections)[:-1])
            rows.append((len(ids), crossing, [int(x.sum()) for x in by_field], [x.tolist() for x in by_field]))
        return pd.DataFrame(rows, columns=["n_tokens", "n_crossing", "field_tokens", "section_tokens"])

    return count(*fields)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, separator: str = "\n", rule: str = "first") -> DataFrame:
    """id, n_tokens, n_sections, n_crossing and section_tokens (array<long>, by position) of each row."""
    import public_tokenizers

    python_ready(docs.sparkSession)
    c = count_tokens([F.col(text_col)], path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, separator, rule)
    return docs.select(F.col(id_col), c.alias("__c")).select(
        id_col,
        "__c.n_tokens",
        F.size(F.col("__c.section_tokens")[0]).cast("long").alias("n_sections"),
        "__c.n_crossing",
        F.col("__c.section_tokens")[0].alias("section_tokens"),
    )


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
