"""Near-duplicate documents by a chosen-path set-similarity join.

Documents are sets of word shingles. Sets that are equal become one class.
Independent trees branch the classes by selected minwise tokens: a node holds
the sets that chose the same tokens on the path to it. A pair of similarity J
stays together through d choices with probability J**d, and TREES repetitions
bring the chance that it never meets to (1 - J**ROOT)**TREES, about one in a
million at J = 0.8. First every node's rows are compared with the node's pivot,
in rounds that prefer central rows as pivots. Then each row outside the
component of a node's pivot is compared with all others of the node: the pairs
of small nodes by a join, those of large nodes in blocks of bounded rows and
bytes, where the full sets meet and only links that join two components come
out, so that the pairs of a large group are never rows. Only nodes with more than SMALL such rows branch first, by
REPEATS draws of STRIDE further tokens, which are drawn for each node and are no
root's, so that a pair at J = 0.8 loses a branched node with a chance of 6 to 8 %
and all trees with one of 3 in a million. What is large after LEVELS is compared
in blocks as well, so the chance does not depend on how alike the table's rows
are; the work does. No node is ever collected. Every link is confirmed on the full sets; a 1-bit minwise sketch of SKETCH bits only drops pairs that are DEVIATIONS
standard deviations below the threshold, and none with a set of fewer than SHORT
shingles, whose bits depend on each other.

Rows: null texts and texts without words have the empty set and link with
nothing; shorter texts than a shingle are one shingle; rows with a null id take
no part and are kept with a null component; rows that share an id are one node
for links and each keep the class of their own text; texts are read whole; an
empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, empty, python_ready, table, written
from .components import leaves

#: Independent trees, and minwise tokens that choose the root nodes of each.
TREES, ROOT = 20, 3
#: Nodes with up to so many rows outside the pivot's component are compared exhaustively without branching.
SMALL = 16_384
#: Nodes with more pairs to compare are compared in blocks, in which the full sets meet.
PAIRS = 512
#: Rows, and bytes of their sets, of a side of a block, about.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 24
#: Rounds in which every row meets the pivots of its nodes.
STAR_ROUNDS = 2
#: Minwise tokens kept for branching, tokens a draw takes, draws a level, and the most levels below the root.
TOKENS, STRIDE, REPEATS, LEVELS = 192, 6, 9, 2
SKETCH = 1024
#: Standard deviations below the threshold at which the sketch drops a pair: of links just at it, three in ten million.
DEVIATIONS = 5.0
#: Pairs with a smaller set than this are not tested by sketches.
SHORT = 32
#: The sketch as columns of 64 bits.
BITS = [f"w{i}" for i in range(SKETCH // 64)]
SEED = 20240229

Mix = np.uint64


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * Mix(2) + Mix(1)


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted 64-bit hashes; A-Z count as a-z, words end at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    factors = _odd(k, SEED + 1)
    n = len(w) - k + 1
    h = w[:n] * factors[0]
    for i in range(1, k):
        h += w[i : i + n] * factors[i]
    h ^= h >> Mix(29)
    h *= Mix(0xBF58476D1CE4E5B9)
    h ^= h >> Mix(32)
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise values (32 bits) of each set, none of which is empty."""
    joined = np.concatenate(sets)
    values = (joined ^ (joined >> Mix(32))).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    out = np.empty((len(sets), SKETCH), np.uint32)
    mixed = np.empty_like(values)
    for j, a in enumerate((_odd(SKETCH, SEED + 2) >> Mix(32)).astype(np.uint32) | np.uint32(1)):
        np.multiply(values, a, out=mixed)
        out[:, j] = np.minimum.reduceat(mixed, starts)
    return out


def path_keys(signature: np.ndarray) -> np.ndarray:
    """The root node of each tree, as 64-bit keys; one row for each set."""
    tree = np.arange(TREES, dtype=np.uint64) * Mix(0x9E3779B97F4A7C15)
    keys = np.tile(tree, (len(signature), 1))
    for level in range(ROOT):
        keys ^= signature[:, [t * ROOT + level for t in range(TREES)]].astype(np.uint64)
        keys *= Mix(0xBF58476D1CE4E5B9)
        keys ^= keys >> Mix(31)
    return keys


def _sketches(k: int):
    def run(batches):
        import xxhash

        for pdf in batches:
            sets = [shingles(t, k) for t in pdf["__t"]]
            some = [i for i, s in enumerate(sets) if len(s)]
            out = {"id": pdf["__id"], "n": [len(s) for s in sets], "set_id": [b""] * len(sets), "keys": [[]] * len(sets), "tokens": [b""] * len(sets)}
            out |= {w: np.zeros(len(sets), np.int64) for w in BITS}
            at = 0
            while at < len(some):  # bounded blocks of whole sets
                block, size = [], 0
                while at < len(some) and (not block or size + len(sets[some[at]]) <= 200_000):
                    size += len(sets[some[at]])
                    block.append(some[at])
                    at += 1
                sig = signatures([sets[i] for i in block])
                bits = np.packbits((sig >> 8 & 1).astype(np.uint8), axis=1).view(np.int64)
                keys = path_keys(sig).view(np.int64)
                for row, i in enumerate(block):
                    out["set_id"][i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                    for w, value in zip(BITS, bits[row]):
                        out[w][i] = value
                    out["keys"][i] = keys[row]
                    out["tokens"][i] = sig[row, TREES * ROOT : TREES * ROOT + TOKENS].astype("<u2").tobytes()
            yield pd.DataFrame(out)

    return run


def _differ(x: str, y: str) -> Column:
    """Differing bits of two sketches, whose columns have these prefixes."""
    return reduce(Column.__add__, [F.bit_count(F.col(x + w).bitwiseXOR(F.col(y + w))) for w in BITS]).cast("int")


def _most(percent: int) -> int:
    """Differing bits at which a sketch still lets a pair pass."""
    half = (1 - percent / 100) / 2
    return int(SKETCH * half + DEVIATIONS * (SKETCH * half * (1 - half)) ** 0.5) + 1


def _candidate(x: str, y: str, percent: int) -> Column:
    """Whether two sets may be similar enough, by their sizes and sketches."""
    sizes = 100 * F.least(x + "n", y + "n") >= percent * F.greatest(x + "n", y + "n")
    return sizes & ((F.least(x + "n", y + "n") < SHORT) | (_differ(x, y) <= _most(percent)))


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, t, assume_unique=True))
    return len(s) > 0 and 100 * both >= percent * (len(s) + len(t) - both)


def similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two full sets (sorted 64-bit shingles) have 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right)], dtype=bool)

    return run(a, b)


def _sets(k: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["__id"], "t": [shingles(t, k).tobytes() for t in pdf["__t"]]})

    return run


def _pivots(rows: DataFrame, draw: int) -> DataFrame:
    """Nodes of more than one component: key, a pivot (p_), total rows and out, the number of rows outside the pivot's component.

    The pivot is of the node's largest component and the most central of it so far; ties are drawn anew.
    """
    own = F.struct("central", F.xxhash64(F.lit(draw), "key", "id").alias("drawn"), "id", "n", *BITS)
    parts = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("size_n"), F.max(own).alias("p"))
    top = F.max(F.struct("size", "p.central", "p.drawn", "c", "p", "size_n"))
    nodes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("total"), F.sum("size_n").alias("total_n"), top.alias("top")).where("parts > 1")
    columns = [F.col(f"top.p.{x}").alias(f"p_{x}") for x in ("id", "n", *BITS)]
    out = [(F.col("total") - F.col("top.size")).alias("out"), (F.col("total_n") - F.col("top.size_n")).alias("out_n")]
    return written(nodes.select("key", *columns, F.col("top.c").alias("p_c"), "total", "total_n", *out), "nodes")


def _stars(live: DataFrame, percent: int) -> DataFrame:
    near = _candidate("", "p_", percent)
    return live.where((F.col("c") != F.col("p_c")) & near).select(F.col("id").alias("a"), F.col("p_id").alias("b"), _differ("", "p_").alias("d")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")


def _exhaustive(live: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components, one row of which is outside the pivot's; for nodes of at most PAIRS such pairs."""
    columns = ("id", "n", *BITS, "c")
    left = live.where("c <> p_c").select("key", *[F.col(x).alias(f"x_{x}") for x in columns])
    right = live.select(F.col("key").alias("y_key"), *[F.col(x).alias(f"y_{x}") for x in columns])
    found = left.join(right, (F.col("key") == F.col("y_key")) & (F.col("x_c") != F.col("y_c")) & _candidate("x_", "y_", percent))
    return found.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), _differ("x_", "y_").alias("d")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")


def _parts(rows: str, shingles: str) -> Column:
    """Parts of a side of a node, each of about BLOCK_ROWS rows and BLOCK_BYTES of sets at most."""
    return F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) * 8 / BLOCK_BYTES, F.lit(1.0))).cast("int")


def block_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between components among the pairs of a block, confirmed on the full sets.

    Pairs of rows that links of the block join already are not tested, so there
    are fewer links than rows, however alike the rows are.
    """
    names, code = np.unique(np.concatenate((left["c"].to_numpy(np.int64), right["c"].to_numpy(np.int64))), return_inverse=True)
    label = np.arange(len(names))
    mine, theirs = code[: len(left)], code[len(left) :]
    x, y = (np.stack([side[w].to_numpy(np.int64) for w in BITS], 1).view(np.uint64) for side in (left, right))
    n_x, n_y = left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64)
    sets_x, sets_y = ([np.frombuffer(t, np.uint64) for t in side["t"]] for side in (left, right))
    most, links = _most(percent), []
    for i in range(len(left)):
        differ = np.bitwise_count(y ^ x[i]).sum(1, dtype=np.int64)
        low, high = np.minimum(n_y, n_x[i]), np.maximum(n_y, n_x[i])
        near = (100 * low >= percent * high) & ((low < SHORT) | (differ <= most)) & (theirs != mine[i])
        for j in np.flatnonzero(near)[np.argsort(differ[near], kind="stable")]:
            a, b = label[mine[i]], label[theirs[j]]
            if a != b and _alike(sets_x[i], sets_y[j], percent):
                links.append((int(left["id"].iloc[i]), int(right["id"].iloc[j])))
                label[label == b] = a
    return links


def _compared(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large nodes, confirmed where the full sets meet: their pairs are never rows.

    Each row outside the pivot's component is compared with all rows of its
    node. Both sides are dealt into parts, and a task holds a part of each, so that no task has a large node alone.
    """
    need = live.select("id").distinct()
    own = sets.join(need, "id", "left_semi")
    dealt = live.join(own, "id").withColumns({"n_left": _parts("out", "out_n"), "n_right": _parts("total", "total_n")})
    hashed = F.xxhash64("id")
    columns = ("id", "n", *BITS, "c", "t")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = dealt.where("c <> p_c").select("key", F.pmod(hashed, F.col("n_left")).cast("int").alias("u"), each("n_right").alias("v"), *columns)
    right = dealt.select("key", each("n_left").alias("u"), F.pmod(hashed, F.col("n_right")).cast("int").alias("v"), *columns)
    right = right.select(*[F.col(x).alias(f"y_{x}") for x in right.columns])

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y.columns = [c.removeprefix("y_") for c in y.columns]
        return pd.DataFrame(block_links(x, y, percent) if len(x) and len(y) else [], columns=["u", "v"], dtype="int64")

    return left.groupBy("key", "u", "v").cogroup(right.groupBy("y_key", "y_u", "y_v")).applyInPandas(run, "u long, v long")


def _token(at: Column) -> Column:
    return F.substring("tokens", F.pmod(at, F.lit(TOKENS)).cast("int") * 2 + 1, F.lit(2))


def _branched(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows, each in REPEATS nodes below its node by tokens that are drawn for each node and repetition."""
    drawn = rows.join(tokens, "id").withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    chosen = [_token(F.xxhash64("key", "again", F.lit(i))) for i in range(STRIDE)]
    return drawn.withColumn("key", F.xxhash64("key", "again", *chosen)).drop("tokens", "again")


def _marked(rows: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with c, the component of id so far, and central, how near it is to others on average in the pairs met so far."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "d").groupBy("id").agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("met"))
    ends = ends.select("id", F.when(F.col("met") >= 3, -F.col("mean")).otherwise(-float(SKETCH)).alias("__n"))
    known = ends.join(labels.select(F.col("node").alias("id"), F.col("component").alias("__c")), "id", "left")
    marked = rows.drop("c", "central").join(known, "id", "left")
    return marked.withColumn("c", F.coalesce("__c", "id")).withColumn("central", F.coalesce("__n", F.lit(-float(SKETCH)))).drop("__c", "__n")


def _best(pairs: DataFrame) -> DataFrame:
    """The most similar candidate of each row that stands first or second in a pair."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    chosen = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()


def _apart(pairs: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """The untested pairs whose ends are not in one component yet."""
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    ends = labels.select("node", "component")
    named = pairs.join(ends.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left")
    named = named.join(ends.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
    return named.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links, as u and v, by the full sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = written(sets.join(ends, "id", "left_semi"), "involved")
    joined = pairs.join(own.select(F.col("id").alias("b"), F.col("t").alias("t_b")), "b").join(own.select(F.col("id").alias("a"), F.col("t").alias("t_a")), "a")
    return written(joined.where(similar(F.col("t_a"), F.col("t_b"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and kept for each row of docs."""
    python_ready(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    sketch = written(own.mapInPandas(_sketches(k), "id long, n long, set_id binary, keys array<long>, tokens binary, " + ", ".join(f"{w} long" for w in BITS)), "sketches")
    # equal sets are one class, represented by the smallest id
    classes = written(sketch.where("n > 0 and id is not null").groupBy("set_id").agg(F.min("id").alias("rep")), "classes")
    reps = sketch.join(classes, (sketch["set_id"] == classes["set_id"]) & (sketch["id"] == classes["rep"]), "left_semi")
    reps = written(reps.dropDuplicates(["id", "set_id"]).select("id", "n", "keys", "tokens", *BITS), "representatives")
    nodes = reps.select("id", F.posexplode("keys").alias("tree", "key"))
    shared = written(nodes.groupBy("key").count().where("count > 1").select("key"), "shared")
    nodes = written(nodes.join(shared, "key"), "nodes")
    rows = nodes.join(reps.select("id", "n", *BITS), "id").withColumns({"c": F.col("id"), "central": F.lit(-float(SKETCH))})
    rows = written(rows.select("key", "tree", "id", "n", *BITS, "c", "central"), "rows")
    # every pair to come shares a root node, so these are all the texts that are needed
    sets = own.join(nodes.select(F.col("id").alias("__id")).distinct().hint("merge"), "__id", "left_semi").dropDuplicates(["__id", "__t"])
    sets = written(sets.mapInPandas(_sets(k), "id long, t binary"), "sets")

    # rounds of stars: each row confirms the most similar pivot that it meets
    links, labels, tested, found = None, None, None, []
    for draw in range(STAR_ROUNDS):
        nodes = _pivots(rows, draw)
        found.append(written(_stars(rows.join(nodes, "key"), percent).groupBy("a", "b").agg(F.min("d").alias("d")), "stars"))
        open_ = reduce(DataFrame.unionByName, found)
        chosen = written(_best(_apart(open_, labels, tested) if draw else open_).select("a", "b"), "pairs")
        new = _confirmed(chosen, sets, percent)
        links, tested = (links.unionByName(new), tested.unionByName(chosen)) if draw else (new, chosen)
        labels = leaves(links)
        rows = written(_marked(rows.join(nodes.select("key"), "key", "left_semi"), open_, labels), "rows")

    # nodes that still hold several components are compared; they branch first if too many rows are outside the pivot's
    tokens = reps.select("id", "tokens")
    for level in range(LEVELS + 1):
        nodes = _pivots(rows, STAR_ROUNDS + level)
        large = nodes.where(F.col("out") > SMALL).select("key")
        few = nodes if level == LEVELS else nodes.where(F.col("out") <= SMALL)
        few = few.select("key", "p_c", "out", "out_n", "total", "total_n")
        found += [_exhaustive(rows.join(few.where(F.col("out") * F.col("total") <= PAIRS), "key"), percent), _stars(rows.join(nodes, "key"), percent)]
        blocks = rows.join(few.where(F.col("out") * F.col("total") > PAIRS), "key")
        links = links.unionByName(written(_compared(blocks, sets, percent).distinct(), "block-links"))
        if level == LEVELS or empty(large):
            break
        rows = written(_branched(rows.join(large, "key", "left_semi"), tokens).select("key", "tree", "id", "n", *BITS, "c", "central"), "branched")
    labels = leaves(links)
    rest = written(_apart(reduce(DataFrame.unionByName, found).select("a", "b").distinct(), labels, tested), "rest")
    if not empty(rest):
        labels = leaves(links.unionByName(_confirmed(rest, sets, percent)))

    members = sketch.select("id", "n", "set_id").join(classes, "set_id", "left")
    labelled = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return labelled.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def op2_minhash_neardup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x AND e.y > r.root
), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
