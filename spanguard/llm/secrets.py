"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

The novelty of a string is what it adds to the compressed size of the code around it, under a dictionary of
identifiers and prose. A string after a word that names credentials, which neither its surroundings nor the
dictionary can compress, is reported besides the matches of the fixed patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_column, map_arrow, parts, table

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones only would be dropped
_PIECE, _LETTER, _DIGIT = re.compile("[A-Za-z0-9]+").findall, re.compile("[A-Za-z]").search, re.compile("[0-9]").search
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that announce a credential, how many characters after them a candidate may begin, and what one is: a
#: whole run of these characters with a piece between separators that mixes letters and digits.
CONTEXT_WORDS = ("access", "auth", "bearer", "cert", "client", "cookie", "cred", "jwt", "key", "login", "pass", "private", "pwd", "secret", "session", "sig", "token")
CONTEXT_CHARS = 48
_CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Characters of surrounding text that the compressor sees before and after; the share of its alphabet's entropy
#: from which a string counts as incompressible.
BEFORE, AFTER, NOVEL = 512, 256, 0.85
#: Characters of such a piece at least; names with numbers in them have shorter ones.
MIXED = 8

LEVEL = 6
#: Follows what is compressed, since the compressor looks for no matches in the last bytes.
TAIL = b" " * 32

#: Words that identifiers and prose around secrets consist of; the compressor's dictionary.
_FIRST = "access account admin api app application auth authorization aws backup base bearer bucket build cache certificate channel client cloud cluster config connection console container controller cookie credential database default deploy dev development domain endpoint env environment example file gateway github google host http https instance internal jwt key local login machine master message node oauth organization password path pipeline platform policy port private production profile project provider proxy public queue region registry release remote request resource response role root route runtime sandbox schema secret secure server service session setting signature staging storage stripe subscription system team template tenant test token topic url user username vault version webhook worker workflow workspace".split()
_LAST = "body callback class context count data documentation error expiry factory field format function handler header helper identifier index info interface item label length level limit list manager map metadata method mode model module name number object operation option order output parameter parser payload placeholder prefix process properties query record reference repository result rule scope signing size source state status string suffix table tag task time type update value variable view your_key_here changeme xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ".split()
IDENTIFIERS = " ".join(f"{a}_{b} {b}-{a}-{a.title()}{b.title()}" for i, a in enumerate(_FIRST) for b in _LAST[i % 7 :: 7]).encode()


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def marginal(self, before: bytes, string: bytes, after: bytes) -> int:
        return len(self.zip.compress(before + after + string + TAIL)) - len(self.zip.compress(before + after + TAIL))


def entropy_bytes(string: str) -> float:
    """Bytes that a random string of this length takes over the least alphabet, of common ones, that holds it."""
    kinds = re.search("[0-9]", string), re.search("[a-z]", string), re.search("[A-Z]", string), re.search("[+/_=-]", string)
    if not kinds[3] and not (kinds[1] and kinds[2]) and not re.search("[G-Zg-z]", string):
        return len(string) * 0.5
    return len(string) * math.log2(max(2, sum(n for n, k in zip((10, 26, 26, 2), kinds) if k))) / 8


def base_spans(text: str) -> list[tuple[int, int, int, int | None]]:
    """(start, kind, end, None) of the fixed patterns: leftmost non-overlapping matches, short ones dropped."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(text)]
    return found


def novel_spans(text: str, base: list[tuple[int, int, int, int | None]], novelty: Novelty) -> list[tuple[int, int, int, int | None]]:
    """(start, kind, end, marginal bytes) of incompressible strings in a sensitive context, outside the base spans.

    Candidates are whole runs, so they don't overlap; each is compressed once, among surroundings of bounded size.
    """
    found: list[tuple[int, int, int, int | None]] = []
    words, taken = _CONTEXT.finditer(text), iter(sorted((s, e) for s, _, e, _ in base))
    word, last, span, reach = next(words, None), -1 - CONTEXT_CHARS, next(taken, None), -1
    if word is None:
        return found
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while word is not None and word.start() < e:  # the last word that begins before the run ends
            last, word = word.end(), next(words, None)
        while span is not None and span[0] < e:
            reach, span = max(reach, span[1]), next(taken, None)
        string = m[0]
        if last < s - CONTEXT_CHARS or reach > s or not any(len(x) >= MIXED and _LETTER(x) and _DIGIT(x) for x in _PIECE(string)):
            continue
        before, after = text[max(0, s - BEFORE) : s].encode(), text[e : e + AFTER].encode()
        cost = novelty.marginal(before, string.encode(), after)
        if cost >= NOVEL * entropy_bytes(string):
            found.append((s, 3, e, cost))
    return found


def scan_text(text: str | None, novelty: Novelty) -> list[tuple[int, int, int, int | None]]:
    """All spans, by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty), key=lambda x: x[:2])


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, spans: array of (kind, start, end, marginal), in code points, end exclusive, for each row.

    Null and empty texts have no spans; repeated rows are each returned; whole texts are read.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.LongType())])
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in parts(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "marginal": c} for s, k, e, c in scan_text(x.as_py(), novelty)] for x in as_column(batch, "__text")]
            yield pa.RecordBatch.from_arrays([*(as_column(batch, c) for c in keep), pa.array(spans, arrow)], schema.fieldNames())

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")), run, schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
