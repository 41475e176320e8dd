"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of whitespace markers and the characters up to the next
marker. If no piece of the vocabulary has a marker after another character, no
merge can cross from one chunk into the next, and every distinct chunk of the
corpus is segmented once:

1. Documents are gathered into blocks of about BLOCK characters. A block keeps
   its documents as codes of chunks and lists its distinct chunks, dealt into
   parts by a hash; both are written to the shared folder, packed.
2. A part's task takes the lists of all blocks, segments each distinct chunk
   once and returns to each block the ids of its chunks, in their order.
3. A block meets its ids, joins them by the chunks' positions and decodes.

A list names a chunk once a block, so that a frequent word is no hot key, and
parts grow in number with the text. Chunks of over LONG_CHUNK characters are
segmented once a block, where they stand, since lists of them have no bound. A
model that breaks the condition, or that normalises text, gets whole texts.

Rows: null and empty texts have no ids and decode to the empty text; a text is
never cut, however long; repeated rows give repeated results; an empty table
gives no rows. Other columns are ignored, never read. Ids of documents of any
type that a cast to string and back keeps.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_ready, table, written

MARK = "▁"
#: Distinct chunks that sp_encode() remembers in a worker before it starts its table anew.
TABLE_SIZE = 150_000
#: Longer chunks are segmented but neither dealt nor remembered.
LONG_CHUNK = 64
#: Characters of a block, and of the text for each task that works on parts or blocks; FEWEST such tasks, with PARTS parts each.
BLOCK, SHARE, FEWEST, PARTS = 32 << 20, 32 << 20, 32, 2
#: Characters that are cut into chunks at once, up to the next chunk's start.
STRETCH = 1 << 16
#: Ends a chunk in a list: no UTF-8 text has this byte.
END = b"\xff"


_CHUNK, _START = re.compile(" +[^ ]*"), re.compile("(?<! ) ")


def chunks_of(text: str) -> Iterator[list[str]]:
    """Chunks of a text in order, a list for each stretch of it, so that a long text is never held as chunks.

    Markers are written as spaces: the model takes both for the same, and plain strings are smaller.
    """
    text, at = " " + text.replace(MARK, " "), 0
    while at < len(text):
        cut = _START.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        yield _CHUNK.findall(text, at, end)
        at = end


class Codec:
    """Encodes with the table of chunks; the same ids as the library's encode()."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[str, tuple[int, ...]] = {}
        self.ids = list(range(self.model.get_piece_size()))  # one object for each id, whatever the table's size
        self.width = "<u2" if len(self.ids) <= 1 << 16 else "<u4"
        self.by_chunk = self._chunks_are_independent()

    def _chunks_are_independent(self) -> bool:
        m = self.model
        if any(MARK in m.id_to_piece(i).lstrip(MARK) for i in range(m.get_piece_size())):
            return False
        probe = "  A  Åﬁ　b\n\tc  "  # a model that normalises, or adds no marker in front, changes this
        pieces = m.encode(probe, out_type=str)
        if any(m.is_unknown(i) for i in m.encode(probe)):
            return False
        back = re.sub("((?:<0x[0-9A-F]{2}>)+)", lambda x: bytes.fromhex("".join(re.findall("0x(..)", x[0]))).decode(errors="replace"), "".join(pieces))
        return back == MARK + probe.replace(" ", MARK)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_chunk:
            return self.model.encode(text)
        return list(chain.from_iterable(self.segments(text)))

    def segments(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each chunk, by position."""
        chunks, known = list(chain.from_iterable(chunks_of(text))), self.table
        if len(known) > TABLE_SIZE:
            known.clear()
        new = [c for c in set(chunks) if c not in known]
        once = {c: tuple(map(self.ids.__getitem__, ids)) for c, ids in zip(new, self.segment(new))}
        known.update((c, ids) for c, ids in once.items() if len(c) <= LONG_CHUNK)
        return [known[c] if c in known else once[c] for c in chunks]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk."""
        # the model itself puts the first marker in front, but has no text for a single marker
        found = self.model.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
        return [ids if c != " " else [self.model.piece_to_id(MARK)] for c, ids in zip(chunks, found)]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def sp_encode(text: Column, model_path: str) -> Column:
    """array<int> of all ids, without begin or end ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        c = codec(model_path)
        return pd.Series([c.encode(t or "") for t in texts])

    return encode(text)


def sp_decode(ids: Column, model_path: str) -> Column:
    """The text of an array of ids; null gives the empty text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        c = codec(model_path)
        return pd.Series([c.decode([int(i) for i in r]) if r is not None else "" for r in rows])

    return decode(ids)


def _pressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


#: Numbers that are packed or counted at once.
STEP = 1 << 18


def _pack(numbers, names: np.ndarray | None = None) -> bytes:
    """Whole numbers below 2**32, or what names has at these places, compressed byte by byte of equal weight."""
    numbers = np.asarray(numbers)
    planes = np.empty((4, len(numbers)), np.uint8)
    for at in range(0, len(numbers), STEP):
        some = numbers[at : at + STEP]
        some = some.astype(np.uint32) if names is None else names[some]
        for k in range(4):
            planes[k, at : at + STEP] = some >> np.uint32(8 * k) & np.uint32(255)
    return _pressed(planes)


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(_plain(data), np.uint8).reshape(4, -1)
    numbers = np.zeros(planes.shape[1], kind)
    for k in range(4):
        for at in range(0, len(numbers), STEP):
            numbers[at : at + STEP] |= planes[k, at : at + STEP].astype(kind) << kind(8 * k)
    return numbers


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and all their numbers in one array."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return lengths, np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))


_BLOCKS = "block string, part int, chunks binary, docs array<string>, lengths binary, codes binary, classes binary, long_sizes binary, long_ids binary"


def _blocks(model_path: str, parts: int, size: int):
    """Step 1: rows of blocks (part is null) and of their lists of chunks, for mapInPandas."""

    def made(docs: list, lengths: list[int], codes: array, index: dict[str, int]) -> pd.DataFrame:
        names, first = sorted(index), np.frombuffer(codes, np.uint32)
        place = np.fromiter(map(index.__getitem__, names), np.uint32, len(names))
        count = np.zeros(len(names), np.int64)
        for at in range(0, len(first), STEP):
            count += np.bincount(first[at : at + STEP], minlength=len(names))
        # frequent chunks have small codes, and the lists stay in the order of their names: both are then smaller
        often = np.frexp(count)[1][place]
        part = np.fromiter((zlib.crc32(x.encode()) % parts if len(x) <= LONG_CHUNK else -1 for x in names), np.int64, len(names))
        code = np.empty(len(names), np.uint32)
        code[place[np.lexsort((part, -often))]] = np.arange(len(names), dtype=np.uint32)
        order = np.lexsort((-often, part))
        block, listed = uuid.uuid4().hex, np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(names) else []
        c = codec(model_path)
        long_sizes, long_ids = _flat(c.segment([names[i] for i in order[part[order] < 0]]))
        long_ids = _pressed(long_ids.astype(c.width).tobytes())
        rows = [(block, None, None, docs, _pack(lengths), _pack(first, code), _pack(32 - often[order]), _pack(long_sizes), long_ids)]
        for at in listed:
            if part[at[0]] >= 0:
                own = END.join([names[i][1:].encode() for i in at])
                rows.append((block, int(part[at[0]]), _pressed(own), *[None] * 6))
        out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _BLOCKS.split(", ")])
        return out.astype({"part": "Int32"})

    def run(batches):
        docs, lengths, codes, held = [], [], array("I"), 0
        index = defaultdict()
        index.default_factory = index.__len__
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                before = len(codes)
                for found in chunks_of(text) if text else ():
                    codes.extend(map(index.__getitem__, found))
                docs.append(doc)
                lengths.append(len(codes) - before)
                held += len(text or "") + 16
                if held >= size:
                    yield made(docs, lengths, codes, index)
                    docs, lengths, codes, held = [], [], array("I"), 0
                    index.clear()
        if docs:
            yield made(docs, lengths, codes, index)

    return run


def _segmented(model_path: str):
    """Step 2: for a part, the ids of each block's chunks; each distinct chunk is segmented once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c, index = codec(model_path), defaultdict()
        index.default_factory = index.__len__
        listed = [np.array([index[x] for x in _plain(chunks).split(END)], np.int64) for chunks in rows["chunks"]]
        lengths, ids = _flat(c.segment([" " + x.decode() for x in index]))
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame(
            [(block, part, _pack(lengths[own]), _pressed(ids[_runs(starts[own], lengths[own])].astype(c.width).tobytes())) for block, part, own in zip(rows["block"], rows["part"], listed)],
            columns=["block", "part", "sizes", "ids"],
        )

    return run


def _digests(model_path: str, doc: str, ids: list[int]) -> tuple:
    shown = ",".join(map(str, ids)).encode()
    return doc, len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(codec(model_path).decode(ids).encode()).hexdigest()


def _arrays(model_path: str, doc: str, ids: list[int]) -> tuple:
    return doc, ids


def _joined(model_path: str, result, columns: list[str]):
    """Step 3: a block's documents with the ids of their chunks, joined by position."""

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        b, found = block.iloc[0], found.sort_values("part")
        lengths = np.concatenate([_unpack(b["long_sizes"]), *map(_unpack, found["sizes"])])
        ids = np.concatenate([np.frombuffer(_plain(x), codec(model_path).width) for x in (b["long_ids"], *found["ids"])])
        order = np.argsort(_unpack(b["classes"]), kind="stable")
        starts, lengths, codes = (np.cumsum(lengths) - lengths)[order], lengths[order], _unpack(b["codes"], np.uint32)
        rows, at = [], 0
        for doc, n in zip(b["docs"], _unpack(b["lengths"]).tolist()):
            own = codes[at : at + n]
            at += n
            rows.append(result(model_path, doc, ids[_runs(starts[own], lengths[own])].tolist()))
        return pd.DataFrame(rows, columns=columns)

    return run


def encoded(docs: DataFrame, model_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col and ids (array<int>) for each row of docs; with digests, n_tokens, ids_sha256 and decoded_sha256 in place of ids.

    At corpus scale digests stay small, while the ids are several times the text.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    python_ready(spark)
    named = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text"))
    result, schema = (_digests, "doc string, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests else (_arrays, "doc string, ids array<int>")
    columns = [f.split(" ")[0] for f in schema.split(", ")]
    if codec(model_path).by_chunk:
        characters = named.agg(F.sum(F.length("text"))).first()[0] or 0
        tasks = max(FEWEST, -(-characters // SHARE))
        blocks = written(named.mapInPandas(_blocks(model_path, tasks * PARTS, block), _BLOCKS), "chunk-blocks")
        lists = blocks.where("part is not null").select("block", "part", "chunks").repartition(tasks, "part")
        found = lists.groupBy("part").applyInPandas(_segmented(model_path), "block string, part int, sizes binary, ids binary")
        own = blocks.where("part is null").select("block", "docs", "lengths", "codes", "classes", "long_sizes", "long_ids")
        pairs = own.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block"))
        rows = pairs.applyInPandas(_joined(model_path, result, columns), schema)
    else:

        def whole(batches):
            for batch in batches:
                yield pd.DataFrame([result(model_path, d, codec(model_path).encode(t or "")) for d, t in zip(batch["doc"], batch["text"])], columns=columns)

        rows = named.mapInPandas(whole, schema)
    return rows.select(F.col("doc").cast(kind).alias(id_col), *columns[1:])


def encoded_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return encoded(docs, model_path, digests=True)


def op9_sentencepiece(spark, sf_dir):
    return encoded_digests(table(spark, sf_dir, "documents"))
