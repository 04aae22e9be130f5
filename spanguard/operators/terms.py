"""Vault terms in the texts of their conversations: one automaton for each conversation, texts streamed past it.

Terms and texts meet in one shuffle by conversation, in which the terms sort before the texts. A task holds the terms
of one conversation and a batch of texts; a conversation with many texts is dealt over several tasks, each with its terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.restoring import Known, restore_text
from ..functions.terms import Automaton
from ..session import cut

#: Texts of a conversation that one task gets, about.
TEXTS = 1 << 14
#: Conversations with more texts than that are broadcast by their number up to so many; else they are joined.
FEW = 1 << 16
#: Tables of texts of so many bytes at most, by the optimizer's estimate, aren't dealt by conversation and number.
SMALL_BYTES = 32 << 20
#: Texts of a batch that are handled at a time.
SLICE = 256


class Terms:
    """The terms of a conversation: maps of each kind from term to value, and their automata, built when asked for."""

    def __init__(self, maps: dict[str, dict[str, str]]) -> None:
        self.maps, self.built = maps, {}

    def automaton(self, kind: str) -> Automaton:
        if kind not in self.built:
            self.built[kind] = Automaton(self.maps.get(kind, ()))
        return self.built[kind]

    def restore(self, text: str) -> str:
        """Tokens by the maps id and display, text between them by the map synthetic."""
        if "" not in self.built:
            self.built[""] = Known(*(self.maps.get(k, {}) for k in ("id", "display", "synthetic")))
        return restore_text(text, self.built[""])

    def replace(self, kind: str, text: str) -> tuple[str, bool]:
        return self.automaton(kind).replace(text, self.maps.get(kind, {}))


def beside_terms(texts: DataFrame, terms: DataFrame, keep: Sequence[str], text: str, work: Callable[[Terms, str], tuple], schema: T.StructType, conversation: str = "conv_id") -> DataFrame:
    """keep, and the columns of schema that work(terms of the text's conversation, text) gives for each text.

    terms: conversation, kind, term, value. Of values of one term of a kind the smallest counts, null ones and empty
    terms don't. keep must hold the conversation and the text if they are wanted. Texts of conversations without terms get
    Terms({}), null texts count as empty, rows that repeat are each returned; empty tables are fine. keep's columns may
    have any names.
    """
    none = lambda kind: F.lit(None).cast(kind)
    beside = [k for k in keep if k != text]
    # A table whose rows all fit one task needs no count of its conversations' texts.
    small = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    counts = texts.groupBy(F.col(conversation).alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TEXTS)
    large = None if small else cut(counts.select("c", (1 + F.floor(F.col("n") / TEXTS)).cast("int").alias("parts")))
    many = 0 if large is None else large.limit(FEW + 1).count()
    part = F.lit(0)
    left = terms.select(F.col(conversation).alias("c"), "kind", "term", "value").where("term <> '' AND value IS NOT NULL")
    right = texts.select(F.col(conversation).alias("c"), F.col(text).alias("text"), F.struct(F.lit(0).alias("of"), *[F.col(f"`{k}`").alias(f"{n}") for n, k in enumerate(beside)]).alias("row"))
    if many:
        side = large.withColumnRenamed("c", "of")
        side = F.broadcast(side) if many <= FEW else side
        part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int"), F.lit(0))
        right = right.join(side, F.col("c").eqNullSafe(F.col("of")), "left")
        left = left.join(side, F.col("c").eqNullSafe(F.col("of")), "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    else:
        left = left.withColumn("part", F.lit(0))
    right = right.withColumn("part", part)
    row = right.schema["row"].dataType
    both = left.select("c", "part", F.lit(0).alias("turn"), "kind", "term", "value", none("string").alias("text"), F.lit(None).cast(row).alias("row"))
    both = both.unionByName(right.select("c", "part", F.lit(1).alias("turn"), *(none("string").alias(k) for k in ("kind", "term", "value")), "text", "row"))
    dealt = both.repartition("c", "part").sortWithinPartitions("c", "part", "turn", F.col("value").desc())
    out = T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, names = None, Terms({}), schema.fieldNames()
        shape: pa.Schema | None = None
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE):
                b = whole.slice(s, SLICE)
                head = zip(*(b.column(k).to_pylist() for k in ("c", "turn", "kind", "term", "value", "text")))
                rows, made = [], []
                for i, (c, turn, kind, term, value, said) in enumerate(head):
                    if now is None or now[0] != c:
                        now, known = (c,), Terms({})
                    if turn == 0:
                        known.maps.setdefault(kind, {})[term] = value  # values come in falling order
                    else:
                        rows.append(i)
                        made.append(work(known, said or ""))
                if rows:
                    columns = [b.column(k).take(pa.array(rows)) for k in ("row", "text")]
                    shape = shape or pa.schema([("row", columns[0].type), ("text", columns[1].type), *((f.name, _arrow(f.dataType)) for f in schema.fields)])
                    columns += [pa.array([m[k] for m in made], shape.field(n).type) for k, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays(columns, schema=shape)

    kept = [F.col("text").alias(k) if k == text else F.col("row")[str(beside.index(k))].alias(k) for k in keep]
    return dealt.mapInArrow(run, out).select(*kept, *schema.fieldNames())


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]


def _replacing(kind: str, texts: DataFrame, rows: DataFrame, term: str, value: Column, keep: Sequence[str], text: str, conversation: str) -> DataFrame:
    terms = rows.select(conversation, F.lit(kind).alias("kind"), F.col(term).alias("term"), value.alias("value"))
    schema = T.StructType([T.StructField("replaced", T.StringType()), T.StructField("any", T.BooleanType())])
    return beside_terms(texts, terms, keep, text, lambda known, said: known.replace(kind, said), schema, conversation)


def replace_originals(texts: DataFrame, rows: DataFrame, keep: Sequence[str], text: str = "text", conversation: str = "conv_id") -> DataFrame:
    """keep, replaced, any: every original of the conversation's vault replaced by its surrogate, leftmost and longest."""
    return _replacing("original", texts, rows, "original", F.col("synthetic"), keep, text, conversation)


def replace_synthetics(texts: DataFrame, rows: DataFrame, keep: Sequence[str], text: str = "text", conversation: str = "conv_id") -> DataFrame:
    """keep, replaced, any: every surrogate replaced by its original (of several the smallest), and whether there was one."""
    return _replacing("synthetic", texts, rows, "synthetic", F.col("original"), keep, text, conversation)


def occurring(texts: DataFrame, rows: DataFrame, keep: Sequence[str], text: str = "text", term: str = "original", conversation: str = "conv_id") -> DataFrame:
    """keep, terms: the different terms of the conversation's vault that occur anywhere in each text, sorted."""
    terms = rows.select(conversation, F.lit("t").alias("kind"), F.col(term).alias("term"), F.col(term).alias("value"))

    def work(known: Terms, said: str) -> tuple:
        found = known.automaton("t")
        return (sorted(found.terms[k] for k in found.contained(said)),)

    return beside_terms(texts, terms, keep, text, work, T.StructType([T.StructField("terms", T.ArrayType(T.StringType()))]), conversation)


def resolved(texts: DataFrame, rows: DataFrame, keep: Sequence[str], text: str = "text", term: str = "original", conversation: str = "conv_id") -> DataFrame:
    """keep, hits, starts: the places of the terms in each text, longest terms first, without overlaps."""
    terms = rows.select(conversation, F.lit("t").alias("kind"), F.col(term).alias("term"), F.col(term).alias("value"))

    def work(known: Terms, said: str) -> tuple:
        found = known.automaton("t").resolve(said)
        return [said[s:e] for s, e in found], [s for s, _ in found]

    schema = T.StructType([T.StructField("hits", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.LongType()))])
    return beside_terms(texts, terms, keep, text, work, schema, conversation)


def restored(texts: DataFrame, rows: DataFrame, keep: Sequence[str], text: str = "masked", conversation: str = "conv_id") -> DataFrame:
    """keep, restored: tokens by id, then by what they show, text between them by surrogate; other tokens stay."""
    keys = {"id": "token_id", "display": "display_value", "synthetic": "synthetic"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("term")) for k, c in keys.items()]))
    terms = rows.select(conversation, pairs.alias("p"), F.col("original").alias("value")).select(conversation, "p.*", "value")
    schema = T.StructType([T.StructField("restored", T.StringType())])
    return beside_terms(texts, terms, keep, text, lambda known, said: (known.restore(said),), schema, conversation)
