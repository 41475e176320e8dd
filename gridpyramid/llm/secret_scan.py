"""Secret scanning (DataFrame only): base patterns plus windowed entropy.

Base spans are the matches of three patterns, leftmost and non-overlapping for
each kind. Candidates are longer runs of a character class; over each a window
slides whose Shannon entropy is kept by incremental counts: the state holds the
number of each character in the window, a few bits each in an array of longs;
one character leaves, one enters, and only their two counts and their two terms
of sum(c * log2(c)) change. The terms are whole numbers, so nothing drifts on a
long run. The windows at or over the class's threshold make one span. Candidates that the
allow list matches, and those that touch a base span, add nothing.

Positions are code points, ends are exclusive. A match's place follows from the
lengths of the pieces that a split by the same pattern leaves between matches.
The work is linear in the length of a run, and nearly so in the number of
matches: arrays grow in blocks, and what is used twice is bound once.

Rows: null text counts as empty and has no spans; texts are scanned whole;
repeated rows give repeated results; an empty table gives no rows. Other
columns are carried or ignored, never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Same as runs of any length that are then dropped if short: such runs are maximal.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: (character class of the candidates, window, least entropy in bits for a character)
CLASSES = (("[A-Za-z0-9+/_=-]", 20, 3.75), ("[0-9A-F]", 24, 3.1))
#: Candidates that any of these finds are no secrets.
ALLOW = (
    "^[A-Za-z_/=+-]+$",  # without digits: words, paths
    "^[0-9_/=+-]+$",  # without letters: numbers, dates
    "(?i:example|sample|placeholder|changeme|dummy|redacted|lorem)",
    "(?i:0123456789|abcdefgh|qwerty)",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"(.)\1{7}",
)


#: Items of an array that a scan gathers at a time.
SCANNED = 64
#: The first character of the classes, and counts and their bits in a long of the window's state.
FIRST, SLOTS, COUNT_BITS = ord("+"), 12, 5
LONGS = (ord("z") - FIRST) // SLOTS + 1
#: Terms c * log2(c) are whole numbers of this unit.
UNIT = 1 << 40

SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def _bound(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step) -> Column:
    """The state before each item, where step(state, item) is the next state.

    The states are gathered in blocks, so that an array is not copied as a whole for each item.
    """

    def of_block(state, block):
        begin = F.struct(state.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(block, begin, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def add(a, block):
        return _bound(of_block(a["at"], block), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def whole(bound):
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(bound), F.lit(1)), F.lit(SCANNED)), lambda i: F.slice(bound, i, F.lit(SCANNED)))
        begin = F.struct(zero.alias("at"), F.slice(F.array(F.slice(F.array(zero), 1, 0)), 1, 0).alias("out"))
        return F.flatten(F.aggregate(blocks, begin, add)["out"])

    return _bound(items, whole)


def _spans(text: Column, pattern: str, kind: int, least: int = 0, group: int | None = None) -> Column:
    """Spans (s, k, e, m) of the pattern's matches, of which group has least characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    tested = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def sized(x):
        return F.struct(F.char_length(F.coalesce(x["g"], F.lit(""))).alias("g"), F.char_length(F.coalesce(x["m"], F.lit(""))).alias("n"), x["m"].alias("m"), F.char_length(x["t"]).alias("t"))

    def placed(pieces):
        before = scan(pieces, F.lit(0), lambda at, x: at + x["g"] + x["n"])
        kept = F.filter(F.arrays_zip(pieces.alias("p"), before.alias("at")), lambda x: x["p"]["m"].isNotNull() & (x["p"]["t"] >= least))
        start = lambda x: x["at"] + x["p"]["g"]
        return F.transform(kept, lambda x: F.struct(start(x).alias("s"), F.lit(kind).alias("k"), (start(x) + x["p"]["n"]).alias("e"), x["p"]["m"].alias("m")))

    pieces = F.transform(F.arrays_zip(found.alias("m"), gaps.alias("g"), tested.alias("t")), sized)
    return F.when(F.size(found) == 0, F.expr("array()").cast(SPANS)).otherwise(_bound(pieces, placed).cast(SPANS))


def _terms(window: int) -> list[int]:
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 2)]


def entropy_span(candidate: Column, window: int, least: float) -> Column:
    """struct(lo, hi): the windows at or over the entropy, from the first's start to the last's end; lo is -1 if there is none.

    The candidate has at least window characters, all from the classes.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError(f"a window has 1 to {(1 << COUNT_BITS) - 1} characters")
    # entropy = log2(window) - sum(c * log2(c)) / window
    most = F.lit(round((window * (math.log2(window) - least) + 1e-9) * UNIT))
    terms = _terms(window)
    gain = F.array(*[F.lit(b - a).cast("long") for a, b in zip(terms, terms[1:])])  # from a count to the next
    zero, none = F.lit(0).cast("long"), F.lit(-1)

    def place(code):
        return F.floor(code / SLOTS).cast("int"), code % SLOTS * COUNT_BITS

    def count(counts, code):
        which, bits = place(code)
        return F.call_function("shiftright", F.get(counts, which), bits).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def one(code, i):
        which, bits = place(code)
        return F.when(which == i, F.call_function("shiftleft", F.lit(1).cast("long"), bits)).otherwise(zero)

    def hit(a):
        """lo and hi with the window that ends before the state's place."""
        ok = (a["at"] >= window) & (a["t"] <= most)
        return F.when(ok & (a["lo"] < 0), a["at"] - window).otherwise(a["lo"]).alias("lo"), F.when(ok, a["at"]).otherwise(a["hi"]).alias("hi")

    def step(a, x):
        new, gone = x["new"], x["gone"]
        lost = F.when(gone >= 0, F.get(gain, count(a["n"], gone) - 1)).otherwise(zero)
        t = F.when(new == gone, a["t"]).otherwise(a["t"] + F.get(gain, count(a["n"], new)) - lost)
        n = F.transform(a["n"], lambda v, i: v + one(new, i) - F.when(gone >= 0, one(gone, i)).otherwise(zero))
        return F.struct((a["at"] + 1).alias("at"), t.alias("t"), n.alias("n"), *hit(a))

    def slide(codes):
        gone = F.slice(F.concat(F.array_repeat(none, window), codes), F.lit(1), F.size(codes))
        begin = F.struct(F.lit(0).alias("at"), zero.alias("t"), F.array_repeat(zero, LONGS).alias("n"), none.alias("lo"), none.alias("hi"))
        return F.aggregate(F.arrays_zip(codes.alias("new"), gone.alias("gone")), begin, step, lambda a: F.struct(*hit(a)))

    return _bound(F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST), slide)


def _untouched(runs: Column, base: Column) -> Column:
    """The runs that no base span touches: none that starts before ends beyond the run's start, the next starts at its end or later."""
    item = lambda x, own: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), x["m"].alias("m"))

    def swept(both):
        reach = scan(both, F.lit(-1), lambda at, x: F.when(x["own"], at).otherwise(F.greatest(at, x["e"])))
        follows = F.reverse(scan(F.reverse(both), F.lit(2**31 - 1), lambda at, x: F.when(x["own"], at).otherwise(x["s"])))
        free = F.filter(F.arrays_zip(both.alias("x"), reach.alias("reach"), follows.alias("next")), lambda z: z["x"]["own"] & (z["reach"] <= z["x"]["s"]) & (z["next"] >= z["x"]["e"]))
        return F.transform(free, lambda z: F.struct(z["x"]["s"].alias("s"), F.lit(3).alias("k"), z["x"]["e"].alias("e"), z["x"]["m"].alias("m")))

    both = F.array_sort(F.concat(F.transform(base, lambda x: item(x, False)), F.transform(runs, lambda x: item(x, True))))
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(_bound(both, swept).cast(SPANS))


def _dense(runs: Column, window: int, least: float) -> Column:
    """Spans of the runs that have windows at or over the entropy."""
    scored = F.transform(runs, lambda r: F.struct(r["s"].alias("s"), entropy_span(r["m"], window, least).alias("w")))
    return F.transform(F.filter(scored, lambda x: x["w"]["lo"] >= 0), lambda x: F.struct((x["s"] + x["w"]["lo"]).alias("s"), F.lit(3).alias("k"), (x["s"] + x["w"]["hi"]).alias("e"), F.lit("").alias("m")))


def _entropy(text: Column, base: Column) -> Column:
    """Spans of kind entropy that touch no base span."""
    allowed = "|".join(f"(?:{p})" for p in ALLOW)
    parts = []
    for chars, window, least in CLASSES:
        runs = F.filter(_spans(text, f"{chars}{{{window},}}", 3), lambda r: ~r["m"].rlike(allowed))
        parts.append(_bound(runs, lambda r: _bound(_untouched(r, base), lambda free: _dense(free, window, least))))
    return F.array_distinct(F.concat(*[p.cast(SPANS) for p in parts]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of docs plus n_assign, n_access, n_hex (long), base_spans and spans (strings)."""
    own = [c for c in docs.columns if c not in ("n_assign", "n_access", "n_hex", "base_spans", "spans")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*own, text.alias("__t")).select(
        "*", _spans(F.col("__t"), ASSIGN, 0, 6, 2).alias("__a"), _spans(F.col("__t"), ACCESS, 1).alias("__k"), _spans(F.col("__t"), HEX, 2).alias("__x")
    )
    found = found.withColumn("__b", F.concat("__a", "__k", "__x"))
    found = found.withColumn("__e", _entropy(F.col("__t"), F.col("__b")))
    return found.select(
        *own,
        F.size("__a").cast("long").alias("n_assign"),
        F.size("__k").cast("long").alias("n_access"),
        F.size("__x").cast("long").alias("n_hex"),
        _joined(F.col("__b")).alias("base_spans"),
        _joined(F.concat("__b", "__e")).alias("spans"),
    )


def op5_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    """The same in DuckDB, whose patterns have no back references and fold more letters."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    words = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    assign = f"({words})" + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = "['assign', 'access', 'hex', 'entropy']"

    def pieces(name: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all(t, '{pattern}', 0) AS {name}m, regexp_extract_all(t, '{pattern}', {group}) AS {name}t, string_split_regex(t, '{pattern}') AS {name}g"

    def placed(name: str, kind: int, least: int = 0) -> str:
        before = f"list_sum(list_transform({name}g[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({name}m[1:i - 1], lambda g: length(g))), 0)"
        return f"list_transform(range(1, len({name}m) + 1), lambda i: {{'s': CAST({before} AS BIGINT), 'k': {kind}, 'n': length({name}m[i]), 'm': {name}m[i], 'ok': length({name}t[i]) >= {least}}})"

    allowed = " OR ".join(f"regexp_matches(r.m, '{p}')" for p in ALLOW if "\\1" not in p)
    allowed += " OR list_bool_or(list_transform(range(1, length(r.m) - 6), lambda i: substr(r.m, i, 8) = repeat(substr(r.m, i, 1), 8)))"
    runs, dense = [], []
    for n, (chars, window, least) in enumerate(CLASSES):
        runs.append(pieces(f"e{n}", f"{chars}{{{window},}}"))
        fresh = f"list_filter({placed(f'e{n}', 3)}, lambda r: NOT ({allowed}) AND len(list_filter(b, lambda o: o.s < r.s + r.n AND r.s < o.s + o.n)) = 0)"
        hits = f"list_filter(range(0, r.n - {window - 1}), lambda i: list_entropy(string_split(substr(r.m, i + 1, {window}), '')) >= {least} - 1e-10)"
        found = f"list_filter(list_transform({fresh}, lambda r: {{'s': r.s, 'hits': {hits}}}), lambda h: len(h.hits) > 0)"
        dense.append(f"list_transform({found}, lambda h: {{'s': h.s + h.hits[1], 'k': 3, 'e': h.s + h.hits[-1] + {window}}})")
    shown = lambda spans: f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda r: {kinds}[r.k + 1] || ':' || r.s || ':' || r.e), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), f AS (SELECT doc_id, {pieces('p', assign, 2)}, {pieces('q', ACCESS)}, {pieces('y', HEX)}, {', '.join(runs)} FROM d
), g AS (SELECT *, list_filter({placed('p', 0, 6)}, lambda r: r.ok) AS a, {placed('q', 1)} AS k, {placed('y', 2)} AS x FROM f
), h AS (SELECT *, list_concat(list_concat(a, k), x) AS b FROM g
), e AS (SELECT *, list_transform(b, lambda r: {{'s': r.s, 'k': r.k, 'e': r.s + r.n}}) AS base, list_distinct(list_concat({', '.join(dense)})) AS more FROM h)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(x) AS BIGINT) AS n_hex,
  sha256({shown('base')}) AS base_sha256, {shown('list_concat(base, more)')} AS spans FROM e
"""


SQL = _sql()
