"""Pages and documents to classified chunks: HTML lines, cleaning, a fold into units, lexicon classes, focus, numbering."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import MENTIONED, N_STAGES, NEIGHBOUR, UNSTAGED
from .ranking import numbered

# Tags and class or id tokens whose subtree is skipped; tags of headings and of text.
BLOCK_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "select", "noscript", "iframe", "button"}
BLOCK_TOKENS = {
    "menu", "menu-dropdown", "breadcrumb", "breadcrumbs", "footerbox", "moduletable", "smartsearch",
    "module-title", "block-header", "mod-box-grey", "rl_tabs-tab", "nn_tabs-tab", "nav-tabs",
    "teaser-item", "social", "share", "comment", "comments",
}
HEADINGS = {"h1", "h2", "h3", "h4"}
TEXTS = {"p", "li", "td", "dd", "dt"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MARK = "## "


class _Lines(html.parser.HTMLParser):
    """Balanced: void tags open nothing, a new block closes the one before, the end of input closes the last."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[str] = []
        self.open: list[tuple[str, bool]] = []  # tag, skipped
        self.kind = ""
        self.held: list[str] = []

    def close_line(self) -> None:
        line = " ".join("".join(self.held).split())
        if line and self.kind:
            self.rows.append((MARK if self.kind == "heading" else "") + line)
        self.held = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.held.append(" ")
            return
        named = {t for k, v in attrs if k in ("class", "id") and v for t in v.lower().split()}
        skipped = bool(self.open and self.open[-1][1]) or tag in BLOCK_TAGS or bool(named & BLOCK_TOKENS)
        if tag in HEADINGS or tag in TEXTS or skipped and not (self.open and self.open[-1][1]):
            self.close_line()
            self.kind = "" if skipped else "heading" if tag in HEADINGS else "text"
        self.open.append((tag, skipped))

    def handle_endtag(self, tag: str) -> None:
        if tag not in (t for t, _ in self.open):
            return
        if tag in HEADINGS or tag in TEXTS or self.open[-1][1]:
            self.close_line()
        while self.open.pop()[0] != tag:
            pass
        inner = [t for t, s in self.open if not s and (t in HEADINGS or t in TEXTS)]
        if tag in HEADINGS or tag in TEXTS:  # back in the block around it
            self.kind = "" if not inner else "heading" if inner[-1] in HEADINGS else "text"

    def handle_data(self, data: str) -> None:
        if self.kind and not (self.open and self.open[-1][1]):
            self.held.append(data)


def html_to_lines(page: str | None) -> list[str]:
    """Text lines of a page in order; headings begin with MARK."""
    p = _Lines()
    p.feed(page or "")
    p.close()
    p.close_line()
    return p.rows


#: Rows that a Python task turns into objects at once; what comes of them is Arrow again before the next, as a batch of whole
#: pages is many times its size in objects.
SLICE = 64


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_lines(pages: pa.Array) -> pa.Array:
    """A parser has no SQL form; batches pass by Arrow."""
    parts = [pa.array([html_to_lines(x) for x in pages.slice(i, SLICE).to_pylist()], pa.list_(pa.string())) for i in range(0, len(pages), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


# else a filter on the lines, such as Spark makes for an explode, would parse every page a second time
html_lines = html_lines.asNondeterministic()


def is_heading(line: Column) -> Column:
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    n = F.length(letters)
    return line.startswith(MARK) | line.rlike(r"^(?:[IVX]+\.|[0-9]+(?:\.[0-9]+){0,3}[.)])\s+") | ((n >= 7) & (F.length(line) < 150) & (upper > 0.83 * n))


def cleaned(lines: Column, captions: tuple[str, ...] = (), running: tuple[str, ...] = ()) -> Column:
    """Lines without bullets; blanks, page numbers (digits or roman), captions (by prefix) and running headers go."""
    trimmed = F.transform(lines, lambda x: F.btrim(X.normalized(x), F.lit(" •▪●")))

    def keep(x: Column) -> Column:
        fine = (x != "") & ~x.rlike("(?i)^[ivxlcdm0-9]+$")
        for c in captions:
            fine = fine & ~F.lower(x).startswith(c)
        for r in running:
            fine = fine & ~F.contains(F.lower(x), F.lit(r))
        return fine

    return F.filter(trimmed, keep)


_LIST_ITEM = re.compile(r"^(?:[-+]|\d+[.)]|[a-zđ][.)])\s+", re.I)


def _fold(rows: list[tuple[str, bool]], least: int, close: int, most: int) -> Iterator[tuple[str, str]]:
    title, held, n = "", [], 0
    for line, heading in rows:
        size = len(line.split())
        new_item = n >= least and _LIST_ITEM.match(line)
        if held and (heading or new_item or n + size > most):
            if n >= least:
                yield title, " ".join(held)
            held, n = [], 0
        if heading:
            title = line.removeprefix(MARK)
            continue
        held.append(line)
        n += size
        if n >= close and line.endswith((".", ";")):
            yield title, " ".join(held)
            held, n = [], 0
    if n >= least:
        yield title, " ".join(held)


def units(rows: DataFrame, lines: str = "lines", least: int = 28, close: int = 45, most: int = 190) -> DataFrame:
    """Adds a row for each unit: (position, section, unit_text). Lines fold in order: a heading opens a section, a list item
    or an overfull buffer closes a unit, and so does a full stop once it is long enough; short units are dropped.

    The fold is sequential within a document, and an SQL aggregate would copy its growing list each step, so it runs in
    Arrow batches, which give the rows themselves: of an array to explode Spark would ask first, by a second parse and fold of
    every page, whether it is empty.
    """
    flagged = rows.withColumn("_flags", F.transform(lines, is_heading))
    kept = [c for c in rows.columns if c != lines]
    flagged = flagged.select(*kept, lines, "_flags")
    schema = rows.select(*kept).schema
    for name, kind in (("position", "integer"), ("section", "string"), ("unit_text", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                of, found = [], []
                for k, (a, f) in enumerate(zip(*(c.to_pylist() for c in some.columns[-2:]), strict=True)):
                    for position, unit in enumerate(_fold(list(zip(a or [], f or [], strict=True)), least, close, most)):
                        of.append(k)
                        found.append((position, *unit))
                position, section, text = zip(*found, strict=True) if found else ((), (), ())
                made = [pa.array(position, pa.int32()), pa.array(section, pa.string()), pa.array(text, pa.string())]
                own = [c.take(pa.array(of, pa.int64())) for c in some.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*own, *made], [*kept, "position", "section", "unit_text"])

    return flagged.mapInArrow(run, schema)


def quality_ok(text: Column, low: int = 28, high: int = 260, distinct: int = 16, boilerplate: tuple[str, ...] = ()) -> Column:
    fine = _once(X.words(text), lambda w: F.size(w).between(low, high) & (F.size(F.array_distinct(F.transform(w, F.lower))) >= distinct))
    for b in boilerplate:
        fine = fine & ~F.contains(F.lower(text), F.lit(b))
    return fine


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once however often f names it."""
    return F.transform(F.array(value), f)[0]


def any_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any of the lower-case ``terms`` is in the text."""
    return _holds(F.lower(text), terms)


def _holds(low: Column, terms: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    return hit


Lexicon = dict[str, tuple[str, ...]]


def keyword_score(section: Column, text: Column, phrases: tuple[str, ...], bounded: bool = False) -> Column:
    """Sum of the phrases' counts in section and text, tripled for a phrase that the section has."""
    section = F.lower(F.coalesce(section, F.lit("")))
    joined = F.concat_ws(" ", section, F.lower(text))
    out = F.lit(0)
    for p in phrases:
        n, has = (X.bounded_count(joined, p), X.bounded_count(section, p) > 0) if bounded else (X.substring_count(joined, p), F.contains(section, F.lit(p)))
        out = out + n * F.when(has, 3).otherwise(1)
    return out


def classify(section: Column, text: Column, lexicon: Lexicon, default: str | None = None, bounded: bool = False) -> Column:
    """The label of highest score, the first declared of equals; ``default`` where all are 0."""
    # the default is a label of score 0 that comes first, so scores are counted once and not again for a condition
    none = F.struct(F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit(default).cast("string").alias("label"))
    scored = (F.struct(keyword_score(section, text, p, bounded).alias("score"), F.lit(-i).alias("order"), F.lit(label).alias("label")) for i, (label, p) in enumerate(lexicon.items()))
    return F.array_max(F.array(*scored, none))["label"]


def stage_vector(section: Column, text: Column, topic: Column, lexicon: list[tuple[str, ...]], hints: tuple[str, ...] = (), topics: dict[str, dict[int, int]] | None = None, hint_topic: str = "general_crop_care") -> Column:
    """Compatibility with the stages from the phrases of each: the first of highest score 1, its neighbours NEIGHBOUR, any
    stage that is mentioned MENTIONED at least; nothing found: all UNSTAGED. ``topics``: added scores by topic."""
    boosts = topics if topics is not None else {"harvest_readiness": {5: 4}, "residue_management": {5: 3}, "weed_management": {0: 2, 1: 2}}
    section = F.lower(F.coalesce(section, F.lit("")))
    low = F.lower(text)
    both = F.concat_ws(" ", section, low)
    counts = []  # of each stage: score by phrases, and whether it is mentioned
    for phrases in lexicon[:N_STAGES]:
        s, hit = F.lit(0), F.lit(False)
        for p in phrases:
            n, m = X.bounded_count(low, p), X.bounded_count(section, p)
            s = s + n + 3 * m
            # the space between section and text can only be inside a phrase with a space
            hit = hit | (X.bounded_count(both, p) > 0 if " " in p else (n > 0) | (m > 0))
        counts.append((s, hit))
    scores = []
    for k, (s, _) in enumerate(counts):
        for t, add in boosts.items():
            if k in add:
                s = s + F.when(topic == t, add[k]).otherwise(0)
        if k == 0 and hints:
            s = s + F.when((topic == hint_topic) & any_term(text, hints), 3).otherwise(0)
        scores.append(s)
    packed = F.struct(F.array(*scores).alias("s"), F.array(*(hit for _, hit in counts)).alias("h"))

    def vector(r: Column) -> Column:
        main = F.array_position(r["s"], F.array_max(r["s"])) - 1
        each = F.transform(r["h"], lambda h, k: F.when(k == main, 1.0).otherwise(F.greatest(F.when(F.abs(k - main) == 1, NEIGHBOUR).otherwise(0.0), F.when(h, MENTIONED).otherwise(0.0))))
        return F.when(F.array_max(r["s"]) == 0, F.array(*[F.lit(UNSTAGED)] * N_STAGES)).otherwise(each)

    return F.transform(F.array(packed), vector)[0]


def focused(rows: DataFrame, lexicon: Lexicon, text: str = "text", topic: str = "topic") -> DataFrame:
    """For each label of ``lexicon`` that is not a row's topic: the sentences with a phrase of it, and those beside them,
    distinct and in order, as a derived row of that topic; only snippets of fair quality stay."""

    def near(s: Column, hits: Column) -> Column:
        return F.transform(s, lambda x, i: F.when(F.get(hits, i) | F.coalesce(F.get(hits, i + 1), F.lit(False)) | F.coalesce(F.get(hits, i - 1), F.lit(False)), x))

    def snippet(phrases: tuple[str, ...]) -> Column:
        # a sentence is searched once, not again for each of its neighbours and theirs
        hits = F.transform("_s", lambda x: _once(F.lower(x), lambda low: _holds(low, phrases)))
        return X.normalized(F.array_join(F.array_distinct(F.array_compact(_once(hits, lambda h: near(F.col("_s"), h)))), " "))

    options = F.array(*(F.when((F.col(topic) != label) & any_term(F.col(text), p), F.struct(F.lit(label).alias("focus"), snippet(p).alias("snippet"))) for label, p in lexicon.items()))
    out = rows.withColumn("_s", X.sentences(F.col(text))).withColumn("_o", F.explode(F.array_compact(options)))
    return out.withColumn(topic, F.col("_o.focus")).withColumn(text, F.col("_o.snippet")).where(quality_ok(F.col(text))).drop("_s", "_o").withColumn("derived_focus", F.lit(True))


def dedup_number(rows: DataFrame, source: str = "source_id", position: str = "position", text: str = "text", topic: str = "topic") -> DataFrame:
    """Per source the first of equal (topic, letters and digits of the whole text), numbered "<source>_C%04d" in ``position``.

    Firsts are aggregates, combined before the exchange, so copies never gather in a task. Numbers are places in one order of
    all rows, of range partitions, less those before the source: a source of any size is many tasks. Rows of one position are
    ordered by their keys; a null source is a source without a name, whose ids are null.
    """
    every = [c for c in rows.columns if c != "chunk_id"]
    keyed = rows.select(*every).withColumn("_k", X.dedup_key(F.col(topic), F.col(text)))
    first = F.min_by(F.struct(*every), F.struct(position, F.xxhash64(*every))).alias("_row")
    kept = keyed.groupBy(F.col(source).alias("_s"), "_k").agg(first).select("_s", "_k", "_row.*")
    put = numbered(kept, [F.col("_s"), F.col(position), F.col("_k")], "_n")
    starts = put.groupBy(F.col("_s").alias("_of")).agg(F.min("_n").alias("_low"))
    put = put.join(starts, F.col("_s").eqNullSafe(F.col("_of")))
    number = F.format_string("%04d", F.col("_n") - F.col("_low") + 1)
    return put.withColumn("chunk_id", F.concat("_s", F.lit("_C"), number)).drop("_s", "_of", "_k", "_n", "_low")


def page_filter(page: Column, ranges: Column) -> Column:
    """Whether a page lies in one of the inclusive (start, end) ranges."""
    return F.exists(ranges, lambda r: page.between(r["start"], r["end"]))


def review_queue(rows: DataFrame) -> DataFrame:
    """Restricted chunks first, then by source, page (none: 0) and id."""
    return rows.orderBy(~F.col("restricted_action"), "source_id", F.coalesce("page_start", F.lit(0)), "chunk_id")
