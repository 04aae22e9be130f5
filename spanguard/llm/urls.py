"""URL filter: allow and block rules first, else logistic regression on hashed character n-grams of host and path.

Everything that runs over rows is DataFrame expressions: one pass over the characters of a url, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Cells of hashed n-grams; weights are whole numbers of this share; steps, step size and ridge of the training.
CELLS, UNIT, STEPS, RATE, RIDGE = 1 << 12, 1 << 12, 1000, 2.0, 5e-4
#: Log odds from which the method blocks, under as many wanted as unwanted urls; unwanted ones are rarer than that.
SURE = 0.25
#: The hash of an n-gram of field f: f * SALT and its code points, each times a power of BASE, modulo CELLS.
BASE, SALT = 131, 7919
FIELDS = {"host": 1, "path": 2}

#: The labelled table: names of sites and paths, drawn by hand, of which text isn't wanted or is. Each name stands in
#: urls of the same shapes, so that only its letters tell the kinds apart.
BLOCKED_SITES = "casino-royal luckycasino casino-bonus onlinecasinos casino casino-win-big jackpot-slots free-betting sportsbets bets-today freebets bet-win bets poker-win lotto-win cheap-pills pills-shop cheappills pills pills4you discount-viagra pharmacy-pills adult-videos adult-chat adultx xxx-adult adult adult-dating porn-tube free-porn porn sex-cams sexchat escort-girls ads-server ads-tracker ads track-ads adstrack adserver clicktrack click-tracker ad-track banner-ads popup-ads spam-links spamfarm spam link-farm seo-spam spam-blog content-farm-seo free-ringtones warez-crack torrent-crack payday-loans easy-loans replica-watches win-prizes malware-download phishing-login hot-girls free-iphone".split()
ALLOWED_SITES = "dailynews news writer riverside gazette observer times encyclopedia docs wiki manual handbook reference university college research science journal museum school recipes garden travelnotes photo kitchen weather health clinic hospital parliament city-council law court hill nation station theatre motion thornton tones thread leather other together weathered northern brother table thing truthful southend software code radio library address loader better alphabet adapter shadow window winter essex farmer farmhouse freedom education spillway traction tradition addition stadium canada nevada bethany betty october trackless trucks clicker cliff spanish spaniel spawn pillar pillow porcelain portal poker-face sextant sussex middlesex cashier casing free-press freeman wins-low lottery-history a b2 x7 bbc mit w3 go my web info home site page index main local city-map".split()
BLOCKED_PATHS = "casino/slots porn/videos bets/odds pills/order adult/cams login?next=1 cart/checkout account/signin ads/click redirect?to=1 download/crack xxx/live".split()
ALLOWED_PATHS = "article/history guide/install papers/archive world/politics books/adventure recipes/bread travel/islands science/physics courses/english sport/football music/concert garden/roses".split()
_SHAPES = "http://{}.com/en/{n} https://{}.net/ http://www.{}.com https://www.{}.net/en/{n}.html http://m.{}.example.net/de/{n}/ https://blog.{}.org/fr/{n} http://{}.example.com/es/{n}?page=2 https://{}.example.org/en/{n}".split()
_PATH_SHAPES = "http://www.example.com/{} https://m.example.net/{} http://blog.example.org/en/{}".split()


def labelled_table() -> tuple[list[str], list[str]]:
    """The urls of unwanted and of wanted text: each site's name in every other shape, each path in all of its shapes."""
    site = lambda names: [s.format(x, n=37 * i % 401 + 10 ** (i % 5)) for i, x in enumerate(names) for s in _SHAPES[i % 2 :: 2]]
    path = lambda names: [s.format(x) for x in names for s in _PATH_SHAPES]
    return site(BLOCKED_SITES) + path(BLOCKED_PATHS), site(ALLOWED_SITES) + path(ALLOWED_PATHS)


def _parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null and for urls without ://."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER), F.regexp_extract(whole, pattern, 2)


def split_url(url: str | None) -> tuple[str, str]:
    """The same for one url."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(str.maketrans(UPPER, LOWER)), m[2]) if m else ("", "")


def gram_cells(text: str, field: int) -> list[int]:
    """Cells of the n-grams of three and four characters that end at each character, or at the end."""
    codes = [ord("^")] * 3 + [ord(c) for c in text] + [ord("$")]
    out = []
    for i in range(3, len(codes)):
        a, b, c, d = codes[i - 3 : i + 1]
        out.append((field * SALT + (b * BASE + c) * BASE + d) % CELLS)
        out.append((field * SALT + ((a * BASE + b) * BASE + c) * BASE + d) % CELLS)
    return out


def _cells(url: str) -> list[int]:
    host, path = split_url(url)
    return gram_cells(host, FIELDS["host"]) + gram_cells(path, FIELDS["path"])


def train(blocked: Sequence[str], allowed: Sequence[str]) -> tuple[list[int], int]:
    """Weights of the cells and the bias, in UNIT parts, from a table of labelled urls that fits the driver.

    Gradient descent on the log loss of the counts, each url's divided by the root of its squares, with a ridge. The
    weights are rounded, so that sums of them are exact in any order. Without urls of both kinds all weights are 0.
    """
    urls = [*blocked, *allowed]
    if not blocked or not allowed:
        return [0] * CELLS, 0
    x = np.zeros((len(urls), CELLS))
    for row, url in zip(x, urls):
        np.add.at(row, _cells(url), 1.0)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    y = np.repeat([1.0, 0.0], [len(blocked), len(allowed)])
    weight = np.where(y == 1, 0.5 / len(blocked), 0.5 / len(allowed))
    # All weights are sums of the urls' counts, so the steps only need the urls' products with each other.
    product, share, bias = x @ x.T, np.zeros(len(urls)), 0.0
    for _ in range(STEPS):
        wrong = weight * (1 / (1 + np.exp(-(product @ share + bias))) - y)
        share -= RATE * (wrong + RIDGE * share)
        bias -= RATE * wrong.sum()
    w = x.T @ share
    return np.rint(w * UNIT).astype(int).tolist(), int(np.rint(bias * UNIT))


@lru_cache(maxsize=1)
def trained() -> tuple[list[int], int]:
    return train(*labelled_table())


def _sums(text: Column, field: int, weights: Column) -> Column:
    """(sum of the weights of the text's n-grams, their number), in one pass over its characters."""
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(*(long(ord("^")).alias(k) for k in "abc"), long(0).alias("sum"), long(0).alias("n"))
    cell = lambda x: F.pmod(x + long(field * SALT), long(CELLS)).cast("int")

    def step(s: Column, char: Column) -> Column:
        d = F.ascii(char).cast("long")
        three = (s["b"] * BASE + s["c"]) * BASE + d
        four = ((s["a"] * BASE + s["b"]) * BASE + s["c"]) * BASE + d
        return F.struct(s["b"].alias("a"), s["c"].alias("b"), d.alias("c"), (s["sum"] + weights[cell(three)] + weights[cell(four)]).alias("sum"), (s["n"] + 2).alias("n"))

    return F.aggregate(F.concat(F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$"))), start, step)


def judge(pages: DataFrame, keep: Sequence[str] = ("page_id",), url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[list[int], int] | None = None) -> DataFrame:
    """keep, host, path, rule (null if none fits), verdict (allow or block), score (log odds; the method blocks over SURE).

    The longest rule that fits decides, else the regression: the sum of weights of the n-grams of host
    and path, over the root of their number, and the bias. Null urls and those without :// have an empty host and
    path, and are judged like any other. Repeated rows are each returned, an empty table gives no rows, columns other
    than keep and the url aren't read.
    """
    weights, bias = model or trained()
    vector = F.from_json(F.lit(str(weights)), "array<bigint>")  # folded into one constant
    host, path = _parts(F.col(f"`{url_col}`"))
    out = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("__host"), path.alias("__path"))
    host, path = F.col("__host"), F.col("__path")
    fits = F.lit(None).cast("string")
    for _, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = F.when((F.lit("." + of) == F.right(F.concat(F.lit("."), host), F.lit(len(of) + 1))) & F.startswith(path, F.lit(start)), of + start).otherwise(fits)
    out = out.withColumns({"__rule": fits, "__h": _sums(host, FIELDS["host"], vector), "__p": _sums(path, FIELDS["path"], vector)})
    logit = (F.col("__h.sum") + F.col("__p.sum")) / F.sqrt(F.col("__h.n") + F.col("__p.n")) + F.lit(bias)
    verdict = F.when(logit > SURE * UNIT, "block").otherwise("allow")
    for kind, of, start in rules:
        verdict = F.when(F.col("__rule") == of + start, kind).otherwise(verdict)
    return out.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), F.round(logit / UNIT, 6).alias("score"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    weights, bias = trained()
    fits = "".join(f" WHEN ends_with('.' || host, '.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    kinds = "".join(f" WHEN rule = '{h}{p}' THEN '{k}'" for k, h, p in RULES)
    grams = lambda f, n: f"({f * SALT} + " + " + ".join(f"unicode(t[i + {3 - k}]) * {BASE**k}" for k in range(n)) + f") % {CELLS}"
    sums = " + ".join(f"coalesce(list_sum(list_transform(range(1, length({name}) + 2), lambda i: w[1 + {grams(f, n).replace('t[', f't{f}[')}] )), 0)" for name, f in FIELDS.items() for n in (3, 4))
    return f"""
WITH model AS (SELECT {weights} AS w),
u AS (
  SELECT page_id, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS k FROM pages),
s AS (
  SELECT page_id, CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^/?#]*') ELSE '' END AS h,
         CASE WHEN k > 0 THEN substr(url, k + 3) ELSE '' END AS rest FROM u),
p AS (
  SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s),
f AS (
  SELECT page_id, host, path, CASE{fits} END AS rule, '^^^' || host || '$' AS t1, '^^^' || path || '$' AS t2 FROM p),
l AS (
  SELECT page_id, host, path, rule, ({sums}) / sqrt(2 * (length(host) + length(path) + 2)) + {bias} AS logit FROM f, model)
SELECT page_id, host, path, rule, CASE{kinds} WHEN logit > {SURE * UNIT} THEN 'block' ELSE 'allow' END AS verdict,
       round(logit / {UNIT}, 6) AS score
FROM l
"""


SQL = _sql()
