"""Span expressions: find, resolve overlaps, replace. All stay in the JVM; offsets count code points, half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import validators
from .catalog import Pattern

SPAN = "struct<start:int,end:int,entity:string,confidence:double,tier:int,text:string>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def empty() -> Column:
    return F.expr(NONE)


def once(value: Column) -> Column:
    """The same value, evaluated once for each row.

    A filter above a projection is pushed below it with a copy of what it tests, and exploding an array adds such
    a filter; an expression that isn't deterministic stays where it is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


#: Hits, or spans, that a fold handles at once; longer arrays are handled in runs of so many, so that the time
#: grows with the length and not with its square.
RUN = 256


def _runs(items: Column, of: Callable[[Column], Column]) -> Column:
    """of() applied to each run of RUN items."""
    last = F.floor((F.size(items) - 1) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: of(F.slice(items, i * RUN + 1, F.lit(RUN))))


PAIR = "struct<hit:string,gap:int,entity:string,first:boolean>"


def paired(text: Column, matched: Column, pattern: str, entity: Column) -> Column:
    """array of (hit, length of the text before it, entity, whether it is the first): matched are all hits of pattern."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(matched, F.slice(gaps, F.lit(1), F.size(matched)), lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap")))
    full = F.transform(pairs, lambda x, i: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), entity.alias("entity"), (i == 0).alias("first")))
    return F.when(F.coalesce(F.size(matched), F.lit(0)) > 0, full).otherwise(F.expr(f"CAST(array() AS array<{PAIR}>)"))


def located(pairs: Column, confidence: float = 1.0, tier: int = 1) -> Column:
    """Spans of paired() hits, of one pattern or of several one after the other. pairs should be a plain column."""

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["fresh"] | x["first"]
        begin = F.when(x["first"], x["gap"]).otherwise(acc["at"] + x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["entity"].alias("entity"), F.lit(float(confidence)).alias("confidence"), F.lit(tier).alias("tier"), x["hit"].alias("text"))
        # `moves` are spans before the run's first new pattern: they go on from where the run before ended.
        return F.struct(end.alias("at"), fresh.alias("fresh"), F.when(fresh, acc["moves"]).otherwise(F.concat(acc["moves"], F.array(span))).alias("moves"), F.when(fresh, F.concat(acc["stays"], F.array(span))).otherwise(acc["stays"]).alias("stays"))

    def of(run: Column) -> Column:
        return F.aggregate(run, F.struct(F.lit(0).alias("at"), F.lit(False).alias("fresh"), empty().alias("moves"), empty().alias("stays")), step)

    def joined(acc: Column, run: Column) -> Column:
        moved = F.transform(run["moves"], lambda x: F.struct((x["start"] + acc["at"]).alias("start"), (x["end"] + acc["at"]).alias("end"), x["entity"].alias("entity"), x["confidence"].alias("confidence"), x["tier"].alias("tier"), x["text"].alias("text")))
        at = F.when(run["fresh"], run["at"]).otherwise(acc["at"] + run["at"])
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.concat(moved, run["stays"]))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<array<{SPAN}>>)").alias("out"))
    every = F.flatten(F.aggregate(_runs(pairs, of), start, joined, lambda acc: acc["out"]))
    return F.when(F.size(pairs) > 0, every).otherwise(empty())


def hits(text: Column, pattern: Pattern) -> Column:
    """All matches of a pattern; texts without what it needs aren't searched."""
    found = F.regexp_extract_all(text, F.lit(pattern.regex), 0)
    tests = [text.contains(x) for x in pattern.needs] + [text.rlike(x) for x in pattern.guards]
    if not tests:
        return found
    has = tests[0]
    for t in tests[1:]:
        has = has | t
    return F.when(has, found)


def valid(found: Column, patterns: tuple[Pattern, ...]) -> Column:
    """The spans that their pattern's validator lets pass."""
    checked = [p for p in patterns if p.validator]

    def good(s: Column) -> Column:
        out = F.when(s["entity"] == checked[0].label, validators.BY_NAME[checked[0].validator](s["text"]))
        for p in checked[1:]:
            out = out.when(s["entity"] == p.label, validators.BY_NAME[p.validator](s["text"]))
        return out.otherwise(True)

    return F.filter(found, good) if checked else found


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _first_wins(spans: Column) -> Column:
    return F.aggregate(spans, empty(), lambda acc, s: F.when(F.exists(acc, lambda a: overlaps(a, s)), acc).otherwise(F.concat(acc, F.array(s))))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _clusters(spans: Column) -> Column:
    """The spans in groups that don't overlap one another, each in the order given: runs in text order, joined where
    a span reaches from one into the next."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("at"), i.alias("rank"), s.alias("s"))))

    def run(items: Column) -> Column:
        return F.struct(items.alias("items"), F.array_max(F.transform(items, lambda x: x["s"]["end"])).alias("reach"), items[0]["at"].alias("first"))

    def begins(runs: Column) -> Column:
        """Numbers of the runs into which nothing reaches; the fold holds numbers only, since each step copies it."""
        step = lambda acc, x, i: F.struct(F.greatest(acc["reach"], x["reach"]).alias("reach"), F.when(x["first"] >= acc["reach"], F.concat(acc["at"], F.array(i))).otherwise(acc["at"]).alias("at"))
        start = F.struct(F.lit(0).alias("reach"), F.expr("CAST(array() AS array<int>)").alias("at"))
        numbered = F.transform(runs, lambda x, i: F.struct(x["first"].alias("first"), x["reach"].alias("reach"), i.alias("i")))
        return F.aggregate(numbered, start, lambda acc, x: step(acc, x, x["i"]), lambda acc: acc["at"])

    def ordered(items: Column) -> Column:
        return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s")))), lambda x: x["s"])

    def groups(runs: Column) -> Column:
        def of(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(runs))
            return F.transform(at, lambda i, k: ordered(F.flatten(F.transform(F.slice(runs, i + 1, end(k) - i), lambda x: x["items"]))))

        return _bind(begins(runs), of)

    return _bind(ranked, lambda r: _bind(_runs(r, run), groups))


def first_wins(spans: Column) -> Column:
    """Take spans in the order given; drop one that overlaps a span taken before. The result is in text order.

    Longer arrays are first cut where no span reaches over, so that only spans near each other are compared.
    """
    groups = F.when(F.size(spans) <= 64, F.array(spans)).otherwise(_clusters(spans))
    return F.array_sort(F.flatten(F.transform(groups, _first_wins)))


def by_confidence(spans: Column) -> Column:
    """Overlaps go to the higher confidence, ties to the earlier span of the array."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s.alias("s"))))
    return first_wins(F.transform(ranked, lambda r: r["s"]))


def outside(spans: Column, zones: Column) -> Column:
    """Spans that overlap none of the zones (start, end)."""
    return F.filter(spans, lambda s: F.forall(zones, lambda z: ~overlaps(s, z)))


def replace(text: Column, spans: Column, value: Callable[[Column], Column], gap: Callable[[Column], Column] = lambda x: x) -> Column:
    """text with each span (disjoint, in order) replaced by value(span), and what lies between by gap(text)."""

    def of(part: Column, run: Column, at: Column) -> Column:
        """part, a text that begins at `at`, with the spans of a run replaced."""

        def step(acc: Column, s: Column) -> Column:
            kept = gap(F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]))
            return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, value(s)).alias("out"))

        end = lambda acc: F.concat(acc["out"], gap(F.substring(part, acc["at"] - at + 1, F.length(part))))
        return F.aggregate(run, F.struct(at.alias("at"), F.lit("").alias("out")), step, end)

    def cut(acc: Column, run: Column) -> Column:
        stop = F.element_at(run, -1)["end"]
        piece = F.struct(F.substring(acc["rest"], F.lit(1), stop - acc["at"]).alias("part"), run.alias("run"), acc["at"].alias("at"))
        return F.struct(stop.alias("at"), F.substring(acc["rest"], stop - acc["at"] + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.expr(f"CAST(array() AS array<struct<part:string,run:array<{SPAN}>,at:int>>)").alias("out"))
    join = lambda acc: F.concat(F.array_join(F.transform(acc["out"], lambda x: of(x["part"], x["run"], x["at"])), ""), gap(acc["rest"]))
    every = F.aggregate(_runs(spans, lambda run: run), start, cut, join)
    return F.when(F.size(spans) == 0, gap(text)).otherwise(every)


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def any_of(terms: Column) -> Column:
    """A pattern for the longest of the literal terms at each place; empty terms don't count."""
    ranked = F.array_sort(F.transform(F.array_distinct(F.filter(terms, lambda t: F.length(t) > 0)), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.array_join(F.transform(ranked, lambda r: _quoted(r["t"])), "|")


def find_literals(text: Column, terms: Column, entity: Column, confidence: float = 1.0, tier: int = 3) -> Column:
    """All places of the literal terms, longest first, without overlaps."""
    pattern = any_of(terms)
    found = located(paired(text, F.regexp_extract_all(text, pattern, F.lit(0)), pattern, entity), confidence, tier)
    return F.when(F.length(pattern) == 0, empty()).otherwise(found)


def replace_literals(text: Column, mapping: Column) -> Column:
    """Every key of the map, leftmost and longest, replaced by its value."""
    pattern = any_of(F.map_keys(mapping))
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.try_element_at(mapping, h), F.lit(""))))
    return F.when(F.coalesce(F.size(mapping), F.lit(0)) < 1, text).otherwise(F.array_join(pieces, ""))
