"""Removal of repeated byte strings, by pruned suffix sorting.

Every byte covered by a string of LENGTH bytes that also starts earlier goes.
Sorting all suffixes of a corpus would move many times its size, so suffixes
are pruned first, without losing any match:

A. Each window of LENGTH bytes selects the anchor, the substring of ANCHOR
   bytes with the least hash. Equal windows select equal anchors, and windows
   next to each other mostly share one, so a text falls into runs of windows.
   Runs are dealt by anchor. Equal runs are repeats as a whole; where an anchor
   has several different runs, these go on.
B. A run's windows fall into blocks of STEP, counted from the anchor, which
   share a core of bytes. Tasks sort the suffixes at the cores (hash-compared
   mergesort, equal ones verified by their bytes) and deal the cores. Rows carry the few bytes left and right of the
   core, so that no text is needed beyond this point.
C. Blocks whose core is not alone fall into their windows, which are dealt
   likewise; all but the earliest of equal windows are repeats.

Before each exchange a task keeps one row for each key and only announces keys
that it has several rows of, so that a passage that a third of all documents
hold costs one row per task.

What decides: in step A, for equal runs, the hash of the anchor and that of the
whole run, which are of different seeds; no bytes are compared and no suffixes
sorted there, and most repeats of whole copies end there. In step B the order of
the suffixes and their bytes within a block of text, and two hashes of different
seeds across blocks; in step C two hashes mixed from those of the core with the
bytes around it. The hashes are polynomials modulo the prime 2**61 - 1 over random values of
the bytes, with bases of their own: two given strings of a run's length agree in both with a
chance of about 1 in 10**32, whatever their form (Thue-Morse strings, which defeat powers of two, included).

Rows: null and empty texts have no bytes and lose none; matches never cross
rows; rows that share an id, or have none, are ordered by id (null first) and
then by a hash of the text; a repeated row is a copy like any other; texts are
read whole (up to 1 GiB each); an empty table gives no rows. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready, table, written
from .suffix_sort import PrefixHash, U, classes, mixed

LENGTH, ANCHOR, STEP = 100, 40, 8
CORE = LENGTH - STEP + 1
#: Bytes of text that a task hashes at once, and that it sorts at once; rows that it compares before it deals them.
HASHED, SORTED, HELD = 1 << 20, 1 << 22, 600_000

ROW, CLAIM, ANNOUNCED, WINDOW = 0, 1, 2, 3
DEALT = "k1 long, k2 long, l long, r long, id long, pack long"


def _pack(at, n, kind) -> np.ndarray:
    """Place in the text (30 bits), a number (31 bits) and the kind of a row as one long."""
    return (np.asarray(at, np.int64) << 33) | (np.asarray(n, np.int64) << 2) | kind


def _unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pack >> 33, (pack >> 2) & 0x7FFFFFFF, pack & 3


def _merged(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats that follow one another in a text become one."""
    order = np.lexsort((at, ids))
    ids, at, n = ids[order], at[order], n[order]
    if not len(ids):
        return ids, at, n
    end = at + n
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (at[1:] != end[:-1])))
    first = np.flatnonzero(new)
    return ids[first], at[first], np.add.reduceat(n, first)


def _claims(ids, at, n) -> dict[str, np.ndarray]:
    ids, at, n = _merged(ids, at, n)
    key = mixed(ids.astype(U) * U(0x9E3779B97F4A7C15) + at.astype(U)).view(np.int64)  # dealt anywhere
    zero = np.zeros(len(ids), np.int64)
    return {"k1": key, "k2": zero, "l": zero, "r": zero, "id": ids, "pack": _pack(at, n, CLAIM)}


def _rows(**columns: np.ndarray) -> dict[str, np.ndarray]:
    """Rows to deal out; columns not given are 0."""
    zero = np.zeros(len(columns["id"]), np.int64)
    return {c: columns.get(c, zero).view(np.int64) for c in ("k1", "k2", "l", "r", "id", "pack")}


def _batches(parts: list[dict[str, np.ndarray]], columns=("k1", "k2", "l", "r", "id", "pack"), size: int = 50_000):
    for part in parts:
        for i in range(0, len(part["id"]), size):
            yield pa.RecordBatch.from_arrays([pa.array(part[c][i : i + size]) for c in columns], names=list(columns))


class Texts:
    """Texts side by side in one array, with room around them."""

    PAD = 8

    def __init__(self, texts: list[bytes]):
        gap = bytes(self.PAD)
        self.data = np.frombuffer(gap + b"".join(texts) + gap, np.uint8)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])) + self.PAD


def runs(texts: Texts, seed: int = 1):
    """Runs of windows with one anchor: (anchor hash, hash of the run's bytes, text, start in the text, windows, anchor's distance)."""
    data, hashes = texts.data, PrefixHash(texts.data, seed)
    total = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if total <= 0:
        return empty.astype(U), empty.astype(U), empty, empty, empty, empty
    values = mixed(hashes.every(ANCHOR))
    shift = U(max(1, int(len(data) - 1).bit_length()))
    least = (values >> shift << shift) | np.arange(len(values), dtype=U)  # on a tie the one further left
    width, reach = LENGTH - ANCHOR + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & ((U(1) << shift) - U(1))).astype(np.int64)
    inside = np.zeros(total + 1, np.int8)
    long = texts.lengths >= LENGTH
    np.add.at(inside, texts.starts[long], 1)
    np.add.at(inside, texts.starts[long] + texts.lengths[long] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:total]).astype(bool)
    change = np.ones(total, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    sizes = np.diff(np.concatenate((edges, [total])))
    keep = valid[edges]
    first, n = edges[keep], sizes[keep]
    # texts side by side: a run never leaves its text, since its windows do not
    text = np.searchsorted(texts.starts, first, side="right") - 1
    while True:  # empty texts share a start with the next
        off = texts.lengths[text] == 0
        if not off.any():
            break
        text[off] += 1
    cut = first + n - 1 + LENGTH > texts.starts[text] + texts.lengths[text]
    assert not cut.any()
    whole = PrefixHash(data, seed + 1)  # a second seed: anchor and run are told apart by both
    return values[anchor[first]], whole.of(first, n + LENGTH - 1), text, first - texts.starts[text], n, anchor[first] - first


def _deal_runs(batches):
    """A, map side."""
    held, size = [], 0

    def flush():
        k1, k2, ids, at, n, o = (np.concatenate(x) for x in zip(*held))
        if not len(k2):
            return []
        parts = []
        order = np.lexsort((k1, k2))
        again = ~_new(k1[order], k2[order])
        several = again.copy()
        several[:-1] |= again[1:]
        dup = order[several]
        if len(dup):  # equal runs: the earliest stays
            dup = dup[np.lexsort((at[dup], ids[dup], k1[dup], k2[dup]))]
            gone = dup[~_new(k1[dup], k2[dup])]
            parts.append(_claims(ids[gone], at[gone], n[gone]))
            stay = np.ones(len(k1), bool)
            stay[gone] = False
            k1, k2, ids, at, n, o = (x[stay] for x in (k1, k2, ids, at, n, o))
        # anchors that this task has several runs of: the runs go on, one row tells other tasks
        _, place, count = np.unique(k1, return_inverse=True, return_counts=True)
        many = count[place] > 1
        number = (n | o << 8) & 0x7FFFFFFF
        parts.append(_rows(k1=k1[~many], k2=k2[~many], id=ids[~many], pack=_pack(at[~many], number[~many], ROW)))
        where = np.flatnonzero(many)
        if len(where):
            spread = mixed(k2[where] + U(1))
            parts.append(_rows(k1=spread, k2=k2[where], id=ids[where], pack=_pack(at[where], number[where], WINDOW)))
            one = where[np.unique(k1[where], return_index=True)[1]]
            parts.append(_rows(k1=k1[one], k2=k2[one], id=ids[one], pack=_pack(at[one], number[one], ANNOUNCED)))
        return parts

    for ids, block in _blocks(batches, HASHED):
        texts = Texts(block)
        k1, k2, text, at, n, o = runs(texts)
        held.append((k1, k2, ids[text], at, n, o))
        size += len(k1)
        if size >= HELD:
            yield from _batches(flush())
            held, size = [], 0
    if held:
        yield from _batches(flush())


def _blocks(batches, size: int):
    """(ids, texts) of whole texts, about size bytes together."""
    ids, texts, have = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("__id").to_pylist(), batch.column("__t").to_pylist()):
            if t is None or len(t) < LENGTH // 4:  # a character has at most four bytes
                continue
            t = t.encode("utf-8", "surrogatepass")
            ids.append(i)
            texts.append(t)
            have += len(t)
            if have >= size:
                yield np.array(ids, np.int64), texts
                ids, texts, have = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def _groups(batches, least: int = 200_000):
    """Whole groups of (k1, k2 or k1) of sorted rows, as dicts of arrays; a group by k1 is never cut."""
    held, size = [], 0

    def joined():
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        size += batch.num_rows
        if size >= least:
            rows = joined()
            cut = int(np.searchsorted(rows["k1"], rows["k1"][-1], side="left"))
            if cut:
                yield {c: x[:cut] for c, x in rows.items()}
            held = [{c: x[cut:] for c, x in rows.items()}]
            size = len(held[0]["k1"])
            least = max(least, 2 * size)
    if held:
        yield joined()


def _new(*keys: np.ndarray) -> np.ndarray:
    """Whether a sorted row has another key than the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _resolve_runs(batches):
    """A, reduce side: rows of (id, pack) that are repeats (CLAIM) or go on (WINDOW). Sorted by k1, k2, id, pack."""
    for g in _groups(batches):
        kind = g["pack"] & 3
        done = (kind == CLAIM) | (kind == WINDOW)
        out = [{"id": g["id"][done], "pack": g["pack"][done]}]
        k1, k2, ids, pack, kind = (x[~done] for x in (g["k1"], g["k2"], g["id"], g["pack"], kind))
        if len(k1):
            group = np.cumsum(_new(k1)) - 1
            distinct = np.bincount(group, _new(k1, k2)) + 2 * np.bincount(group, kind == ANNOUNCED)  # announced: has several runs elsewhere
            row = kind == ROW
            k1, k2, ids, pack, shared = k1[row], k2[row], ids[row], pack[row], (distinct[group] > 1)[row]
            if len(k1):
                first = _new(k1, k2)
                at, number, _ = _unpack(pack)
                out.append({"id": ids[~first], "pack": _pack(at[~first], number[~first] & 0xFF, CLAIM)})
                go = first & shared
                out.append({"id": ids[go], "pack": _pack(at[go], number[go], WINDOW)})
        yield from _batches(out, ("id", "pack"))


def blocks(at: np.ndarray, n: np.ndarray, o: np.ndarray):
    """The blocks of runs: (run, core's start, mask); bit t of a mask stands for the window that starts t before the core."""
    low, high = o - n + 1, o
    first, last = low // STEP, high // STEP
    count = last - first + 1
    run = np.repeat(np.arange(len(at)), count)
    j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + first[run]
    from_, to = np.maximum(low[run] - STEP * j, 0), np.minimum(high[run] - STEP * j, STEP - 1)
    return run, at[run] + o[run] - STEP * j, (1 << (to + 1)) - (1 << from_)


def _windows(k1, k2, left, right, ids, core, mask):
    """Rows of kind WINDOW for all windows of blocks; the keys stand for core, distance and the bytes around."""
    parts = []
    for t in range(STEP):
        has = np.flatnonzero(mask >> t & 1)
        if not len(has):
            continue
        own_left = left[has].view(U) & ((U(1) << U(8 * t)) - U(1))
        own_right = right[has].view(U) >> U(8 * t)
        around = mixed(own_left * U(0x9E3779B97F4A7C15) + U(t + 1)) + mixed(own_right * U(0xD6E8FEB86659FD93) + U(t + 77)) * U(0xC2B2AE3D27D4EB4F)
        parts.append(_rows(k1=mixed(k1[has].view(U) + around), k2=mixed(k2[has].view(U) ^ (around * U(0x94D049BB133111EB))), id=ids[has], pack=_pack(core[has] - t, np.zeros(len(has), np.int64), WINDOW)))
    return parts


def _span(core, mask):
    """First window and number of windows of a mask, whose bits are neighbours."""
    high = np.floor(np.log2(mask)).astype(np.int64)
    low = np.floor(np.log2(mask & -mask)).astype(np.int64)
    return core - high, high - low + 1


def _deal_blocks(batches):
    """B, map side."""
    ids, texts, packs, have = [], [], [], 0
    for batch in batches:
        for i, t, p in zip(batch.column("__id").to_pylist(), batch.column("__t").to_pylist(), batch.column("__packs")):
            p = p.values.to_numpy()
            ids.append(i)
            texts.append(t.encode("utf-8", "surrogatepass"))
            packs.append(p[(p & 3) == WINDOW])
            have += len(texts[-1])
            if have >= SORTED:
                yield from _batches(_sorted_blocks(np.array(ids, np.int64), Texts(texts), packs))
                ids, texts, packs, have = [], [], [], 0
    if ids:
        yield from _batches(_sorted_blocks(np.array(ids, np.int64), Texts(texts), packs))


def _sorted_blocks(ids, texts, packs):
    text = np.repeat(np.arange(len(packs)), [len(p) for p in packs])
    at, number, _ = _unpack(np.concatenate(packs))
    run, core, mask = blocks(at, number & 0xFF, number >> 8)
    text = text[run]
    place = core + texts.starts[text]
    data, one, two = texts.data, PrefixHash(texts.data, 1), PrefixHash(texts.data, 2)
    group = classes(data, one, place, CORE)
    k1, k2 = mixed(one.of(place, CORE)), mixed(two.of(place, CORE))
    left, right = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    reach = len(data) - 1
    for i in range(STEP - 1):
        left = left << 8 | data[place - (STEP - 1) + i]
        right = right << 8 | data[np.minimum(place + CORE + i, reach)]
    who = ids[text]
    order = np.lexsort((core, who, mask, right, left, group))
    k1, k2, left, right, who, core, mask, group = (x[order] for x in (k1, k2, left, right, who, core, mask, group))
    first = _new(group, left, right, mask)
    parts = [_claims(who[~first], *_span(core[~first], mask[~first]))] if not first.all() else []
    k1, k2, left, right, who, core, mask, group = (x[first] for x in (k1, k2, left, right, who, core, mask, group))
    many = np.bincount(group)[group] > 1
    parts.append(_rows(k1=k1[~many], k2=k2[~many], l=left[~many], r=right[~many], id=who[~many], pack=_pack(core[~many], mask[~many], ROW)))
    if many.any():
        windows = _windows(k1[many].view(np.int64), k2[many].view(np.int64), left[many], right[many], who[many], core[many], mask[many])
        parts += _earliest({c: np.concatenate([w[c] for w in windows]) for c in windows[0]}, True)
        one = many & _new(group)
        parts.append(_rows(k1=k1[one], k2=k2[one], id=who[one], pack=_pack(core[one], mask[one], ANNOUNCED)))
    return parts


def _earliest(w: dict[str, np.ndarray], keep: bool) -> list[dict[str, np.ndarray]]:
    """Repeats among windows, and (if keep) the earliest of each key."""
    order = np.lexsort((w["pack"], w["id"], w["k2"], w["k1"]))
    w = {c: x[order] for c, x in w.items()}
    first = _new(w["k1"], w["k2"])
    at = w["pack"][~first] >> 33
    parts = [_claims(w["id"][~first], at, np.ones(len(at), np.int64))]
    return parts + [{c: x[first] for c, x in w.items()}] if keep else parts


def _resolve_blocks(batches):
    """B, reduce side. Sorted by k1, k2."""
    for g in _groups(batches):
        kind = g["pack"] & 3
        done = (kind == CLAIM) | (kind == WINDOW)
        parts = [{c: x[done] for c, x in g.items()}]
        g, kind = {c: x[~done] for c, x in g.items()}, kind[~done]
        if len(kind):
            group = np.cumsum(_new(g["k1"], g["k2"])) - 1
            go = (np.bincount(group)[group] > 1) & (kind == ROW)
            if go.any():
                core, mask, _ = _unpack(g["pack"][go])
                windows = _windows(g["k1"][go], g["k2"][go], g["l"][go], g["r"][go], g["id"][go], core, mask)
                parts += _earliest({c: np.concatenate([w[c] for w in windows]) for c in windows[0]}, True)
        yield from _batches(parts, ("k1", "k2", "id", "pack"))


def _resolve_windows(batches):
    """C, reduce side. Sorted by k1, k2, id, pack."""
    for g in _groups(batches):
        kind = g["pack"] & 3
        parts = [{c: g[c][kind == CLAIM] for c in ("id", "pack")}]
        w = {c: g[c][kind == WINDOW] for c in ("k1", "k2", "id", "pack")}
        if len(w["id"]):
            again = ~_new(w["k1"], w["k2"])
            parts.append(_claims(w["id"][again], w["pack"][again] >> 33, np.ones(int(again.sum()), np.int64)))
        yield from _batches(parts, ("id", "pack"))


def removed_runs(length: int, packs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text, from its repeats."""
    change = np.zeros(length + 1, np.int64)
    for p in packs:
        if p is None or not len(p):
            continue
        at, n, kind = _unpack(np.asarray(p, np.int64))
        at, n = at[kind == CLAIM], n[kind == CLAIM]
        np.add.at(change, at, 1)
        np.add.at(change, at + n - 1 + LENGTH, -1)
    covered = np.concatenate(([0], (np.cumsum(change[:length]) > 0).astype(np.int8), [0]))
    step = np.diff(covered)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _without(text, one, two):
    """struct(n_bytes, n_removed, starts, ends, kept) of a text and its repeats."""

    @F.pandas_udf("n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")
    def run(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(texts, first, second):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if (a is None or not len(a)) and (b is None or not len(b)):
                rows.append((len(raw), 0, [], [], raw))
                continue
            starts, ends = removed_runs(len(raw), [a, b])
            kept = b"".join(raw[x:y] for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)]))
            rows.append((len(raw), int((ends - starts).sum()), starts.tolist(), ends.tolist(), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "starts", "ends", "kept"])

    return run(text, one, two)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, which orders the rows, __own (the id) and __t."""
    rows = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__t"))
    clash = rows.groupBy("__own").count().where("count > 1 or __own is null").select("__own")
    if clash.isEmpty():
        return rows.withColumn("__id", F.col("__own").cast("long"))
    return written(rows.orderBy(F.col("__own").asc_nulls_first(), F.xxhash64("__t")).withColumn("__id", F.monotonically_increasing_id()), "ordered")


def repeats(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeats found by steps A and B-C: __id and packs (place, windows, kind CLAIM) by text."""
    dealt = rows.select("__id", "__t").mapInArrow(_deal_runs, DEALT).select("k1", "k2", "id", "pack")
    found = dealt.repartition("k1").sortWithinPartitions("k1", "k2", "id", "pack").mapInArrow(_resolve_runs, "id long, pack long")
    first = written(found.groupBy("id").agg(F.collect_list("pack").alias("packs")), "repeats")  # bounded by a text's length
    open_ = first.where(F.exists("packs", lambda p: p.bitwiseAND(F.lit(3)) == WINDOW)).select(F.col("id").alias("__i"), F.col("packs").alias("__packs"))
    dealt = rows.join(open_, rows["__id"] == open_["__i"]).select("__id", "__t", "__packs").mapInArrow(_deal_blocks, DEALT)
    windows = dealt.repartition("k1").sortWithinPartitions("k1", "k2").mapInArrow(_resolve_blocks, "k1 long, k2 long, id long, pack long")
    found = windows.repartition("k1").sortWithinPartitions("k1", "k2", "id", "pack").mapInArrow(_resolve_windows, "id long, pack long")
    return first, written(found.groupBy("id").agg(F.collect_list("pack").alias("packs")), "repeats")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, starts and ends of the removed runs, and kept (binary) for each row of docs."""
    python_ready(docs.sparkSession)
    rows = _ordered(docs, id_col, text_col)
    first, second = repeats(rows)
    joined = rows.join(first.select(F.col("id").alias("__id"), F.col("packs").alias("__a")), "__id", "left")
    joined = joined.join(second.select(F.col("id").alias("__id"), F.col("packs").alias("__b")), "__id", "left")
    return joined.select(F.col("__own").alias(id_col), _without("__t", "__a", "__b").alias("__r")).select(id_col, "__r.*")


def op3_suffix_dedup(spark, sf_dir):
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)
), f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM w
), m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f WHERE n > 1
), g AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m
), i AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY 1, 2
), j AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS gap FROM i
), t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS tail, list({'a': a, 'gap': gap} ORDER BY a) AS parts FROM j GROUP BY 1
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(parts, lambda x: substr(h, 2 * x.gap + 1, 2 * (x.a - x.gap))), ''), '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
