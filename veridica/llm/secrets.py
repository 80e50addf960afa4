"""Secret scan (operator 9), in DataFrame functions alone.

Base patterns give spans of kinds ``assign``, ``access`` and ``hex``. The method adds spans of kind ``entropy``:
candidates are runs of ``A-Za-z0-9+/_=-`` of ``WINDOW`` characters or more that hold a digit, or ``CASES`` letters of
either case; a window slides over each, with the counts of its characters kept up to date as one leaves and one enters,
and its Shannon entropy must reach the bound of the candidate's character class. The span goes from the first such
window to the end of the last. Words of placeholders end a run, so what stands beside one is a run of its own; runs and
spans that an allow-list pattern covers whole are left alone, and so are spans inside a base span.

Positions of matches are running sums of the lengths of the matches and of the pieces between them, in code points.
Patterns begin only where a run begins and are possessive, running sums and maxima go block by block, and a window's
counts are a string of 128 cells of which a step overlays two: a text is read in time near proportional to its length
and its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: runs of full length only: within a shorter run no later start could be longer
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}+", r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: bits a character that a window must reach; a window of 20 different characters has 4.32. Of windows of random keys 95 %
#: reach the bound of their class (simulated; upper: of base32). Slugs and paths in one case with a digit are ``other``.
BOUNDS = {"hex": 3.0, "lower": 3.54, "upper": 3.48, "letters": 3.68, "base64": 3.78, "other": 3.9}
#: the classes' patterns, the first that fits counts
CLASSES = {"hex": "^[0-9a-f]+$|^[0-9A-F]+$", "lower": "^[a-z0-9]+$", "upper": "^[A-Z0-9]+=*$", "letters": "^[A-Za-z]+$", "base64": "^(?=.*[a-z])(?=.*[A-Z])"}
CASES = 5
_RUN = r"[A-Za-z0-9+/_=-]"
_WORDS = "(?i:example|sample|dummy|placeholder|changeme|xxxx)"
CANDIDATE = rf"(?={_RUN}{{{WINDOW}}})(?:(?<!{_RUN})|(?<={_WORDS}))(?:(?!{_WORDS}){_RUN}){{{WINDOW},}}+"
#: not secrets: numbers, dates and times, UUIDs
ALLOWED = (r"^[0-9_=+/-]+$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]+Z?$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once: inside a lambda an outer expression would be computed for every element."""
    return F.transform(F.array(x), f)[0]


def _running(values: Column, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """For an array of n ints n + 1 results: ``op`` of 0 and all values before each place, and of all. A block's own results
    come first, so that no step copies more than a block or one entry a block."""
    none, rows = F.array().cast("array<int>"), F.array().cast("array<array<int>>")

    def whole(v):
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(block))).otherwise(none)
        inside = lambda b: F.aggregate(b, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))
        parts = F.transform(starts, lambda s: inside(F.slice(v, s, F.lit(block))))
        return F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), rows.alias("out")),
            lambda s, b: F.struct(op(s["at"], b["at"]).alias("at"), F.concat(s["out"], F.array(F.transform(b["out"], lambda y: op(s["at"], y)))).alias("out")),
            lambda s: F.concat(F.flatten(s["out"]), F.array(s["at"])))

    return _let(values, whole)


def _matches(text: Column, pattern: str, group: int = 0, length: Callable[[Column], Column] = F.char_length) -> Column:
    """array<struct<start,end,g>>, g the text of a group; null text: empty. ``length`` measures: code points or bytes."""

    def placed(x):
        sizes = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["found"])), x["found"], lambda p, m: F.struct(length(p).alias("p"), length(m).alias("m")))
        return _let(sizes, lambda z: F.zip_with(
            F.zip_with(z, F.slice(_running(F.transform(z, lambda s: s["p"] + s["m"]), lambda a, b: a + b), F.lit(1), F.size(z)), lambda s, r: F.struct((r + s["p"]).alias("start"), (r + s["p"] + s["m"]).alias("end"))),
            x["groups"], lambda s, g: F.struct(s["start"].alias("start"), s["end"].alias("end"), g.alias("g"))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
    parts = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces"), groups.alias("groups"))
    parts = parts if group else _let(parts, lambda x: F.struct(x["found"].alias("found"), x["pieces"].alias("pieces"), x["found"].alias("groups")))
    return F.when(text.rlike(pattern), _let(parts, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,g:string>>"))


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def _g(c: Column) -> Column:
    """c log2 c."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def windows(text: Column, bound: Column, window: int = WINDOW) -> Column:
    """struct<first,last>: starts of the first and last window whose entropy reaches ``bound``; -1 if none does.

    ``text``: ASCII, at least one window long. For counts c of a window of w characters the entropy is
    log2 w - sum(c log2 c) / w; the sum changes by two terms a step, and so do the counts, cells of a string.
    """
    base = 48  # a count c is the character of code 48 + c

    def read(cells, code):
        return F.ascii(F.substring(cells, code + 1, 1)) - base

    def put(cells, code, c):
        return F.overlay(cells, F.char(c + base), code + 1)

    def step(s, x):
        # nothing here holds the text, as a step copies what it makes
        def moved(n):
            cells = put(put(s["cells"], x["out"], n["lost"] - 1), x["into"], n["won"] + 1)
            total = s["sum"] + _g(n["lost"] - 1) - _g(n["lost"]) + _g(n["won"] + 1) - _g(n["won"])
            same = x["out"] == x["into"]
            return F.struct(F.when(same, s["cells"]).otherwise(cells).alias("cells"), F.when(same, s["sum"]).otherwise(total).alias("sum"))

        def seen(m):
            i, hit = s["i"] + 1, m["sum"] <= s["least"]
            return F.struct(i.alias("i"), m["cells"].alias("cells"), m["sum"].alias("sum"), s["least"].alias("least"), F.when(hit & (s["first"] < 0), i).otherwise(s["first"]).alias("first"), F.when(hit, i).otherwise(s["last"]).alias("last"))

        return _let(_let(F.struct(read(s["cells"], x["out"]).alias("lost"), read(s["cells"], x["into"]).alias("won")), moved), seen)

    def begun(codes):
        first = F.slice(codes, 1, window)
        cells = F.aggregate(first, F.lit(chr(base) * 128), lambda s, x: put(s, x, read(s, x) + 1))
        total = _let(first, lambda f: F.aggregate(f, F.lit(0.0), lambda s, x: s + F.log2(F.size(F.filter(f, lambda y: y == x)).cast("double"))))
        # the sum that still reaches the bound
        least = F.lit(float(window)) * (F.log2(F.lit(float(window))) - bound) + 1e-9
        return _let(F.struct(cells.alias("cells"), total.alias("sum"), least.alias("least"), F.when(total <= least, 0).otherwise(-1).alias("at")), lambda s: F.struct(F.lit(0).alias("i"), s["cells"].alias("cells"), s["sum"].alias("sum"), s["least"].alias("least"), s["at"].alias("first"), s["at"].alias("last")))

    def followed(codes):
        more = F.size(codes) - window
        moves = F.zip_with(F.slice(codes, F.lit(1), more), F.slice(codes, F.lit(window + 1), more), lambda a, b: F.struct(a.alias("out"), b.alias("into")))
        return F.aggregate(moves, begun(codes), step, lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")))

    return _let(F.transform(F.filter(F.split(text, ""), lambda x: x != ""), F.ascii), followed)


def base_spans(text: Column, length: Callable[[Column], Column] = F.char_length) -> Column:
    assign = F.filter(_matches(text, ASSIGN, 2, length), lambda m: F.char_length(m["g"]) >= 6)
    every = F.concat(_spans(assign, "assign"), _spans(_matches(text, ACCESS, length=length), "access"), _spans(_matches(text, HEX, length=length), "hex"))
    return F.array_sort(every.cast(_SPANS))


def entropy_spans(text: Column, bounds: dict[str, float] | None = None, allowed: tuple[str, ...] = ALLOWED, length: Callable[[Column], Column] = F.char_length) -> Column:
    """Spans of the method in the order of their starts; null and empty texts have none. They never overlap each other."""
    bounds = bounds or BOUNDS

    def fine(text):
        out = F.lit(True)
        for pattern in allowed:
            out = out & ~text.rlike(pattern)
        return out

    def keep(m):
        letters = [F.char_length(F.regexp_replace(m["g"], f"[^{c}]+", "")) >= CASES for c in ("a-z", "A-Z")]
        return (m["g"].rlike("[0-9]") | (letters[0] & letters[1])) & fine(m["g"])

    def hit(m):
        bound = F.lit(bounds["other"])
        for kind in reversed(CLASSES):
            bound = F.when(m["g"].rlike(CLASSES[kind]), bounds[kind]).otherwise(bound)
        return F.struct(m["start"].alias("at"), m["g"].alias("g"), windows(m["g"], bound).alias("w"))

    found = F.filter(F.transform(F.filter(_matches(text, CANDIDATE, length=length), keep), hit), lambda h: h["w"]["first"] >= 0)
    hits = F.filter(found, lambda h: fine(F.substring(h["g"], h["w"]["first"] + 1, h["w"]["last"] - h["w"]["first"] + WINDOW)))
    spans = F.transform(hits, lambda h: F.struct((h["at"] + h["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"), (h["at"] + h["w"]["last"] + WINDOW).alias("end")))
    return spans.cast(_SPANS)


def _alone(base: Column, found: Column) -> Column:
    """All of ``base``, and of ``found`` those inside none of them, in order. Of base spans that begin no later the furthest end tells."""

    def whole(every):
        ends = _running(F.transform(every, lambda s: F.when(s["kind"] < F.lit(3), s["end"]).otherwise(F.lit(0))), F.greatest)
        pairs = F.zip_with(every, F.slice(ends, F.lit(1), F.size(every)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        return F.transform(F.filter(pairs, lambda p: (p["s"]["kind"] < F.lit(3)) | (p["e"] < p["s"]["end"])), lambda p: p["s"])

    return F.when((F.size(base) > 0) & (F.size(found) > 0), _let(F.array_sort(F.concat(base, found)), whole)).otherwise(F.array_sort(F.concat(base, found)))


def scan(docs: DataFrame, text: str = "text", out: str = "spans", base: str = "base_spans", length: Callable[[Column], Column] = F.char_length, **how) -> DataFrame:
    """Adds ``base``, the spans of the patterns, and ``out``, all spans: arrays of (start, kind, end), sorted.

    kind is a place in ``KINDS``; positions are code points from 0 (with ``length`` octet_length: bytes), the end exclusive.
    Null and empty texts have none; other columns and repeated rows stay as they are; an empty table gives no rows. A column
    that is named as ``out`` or ``base`` is replaced, as is said by naming it.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.withColumn(base, base_spans(whole, length)).withColumn(out, entropy_spans(whole, length=length, **how))
    return rows.withColumn(out, _alone(F.col(f"`{base}`"), F.col(f"`{out}`")))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, text: str = "text", sign: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``sign`` (overlapping spans by one); columns else unchanged, whatever their names;
    null texts stay null, empty ones empty; repeated rows stay; an empty table gives no rows."""
    names = docs.columns
    spans, base = unused(names, "_spans", "_base")
    rows = scan(docs, text, spans, base, length=F.octet_length)
    whole = F.col(f"`{text}`")

    def done(x):
        # a span begins a sign if it begins where all before it have ended; pieces are cut from bytes, whose places need no reading
        ends = _running(F.transform(x["spans"], lambda s: s["end"]), F.greatest)
        last = lambda e: F.decode(F.substring(x["data"], F.element_at(e, -1) + 1, F.lit(2147483647)), "UTF-8")

        def joined(e):
            pairs = F.zip_with(x["spans"], F.slice(e, F.lit(1), F.size(x["spans"])), lambda s, m: F.struct(m.alias("from"), s["start"].alias("to")))
            gaps = F.transform(F.filter(pairs, lambda p: p["to"] >= p["from"]), lambda p: F.decode(F.substring(x["data"], p["from"] + 1, p["to"] - p["from"]), "UTF-8"))
            return F.array_join(F.concat(gaps, F.array(last(e))), sign)

        return _let(ends, joined)

    masked = F.when(F.size(F.col(spans)) > 0, _let(F.struct(F.col(spans).alias("spans"), F.encode(whole, "UTF-8").alias("data")), done)).otherwise(whole)
    return rows.withColumn(text, masked).select(*(F.col(f"`{c}`") for c in names))
