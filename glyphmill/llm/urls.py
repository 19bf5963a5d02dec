"""URL filters: longest matching rules, and logistic regression on hashed character trigrams.

The regression is trained on the driver from a small labelled table of urls; its weights are
whole numbers, so that every engine adds them to the same score. Judging is DataFrame
expressions only.

Defined results: a null url, or one without ://, has an empty host and path and is allowed by
the method if its score is not above 0; rules apply to their host and its subdomains whose
path starts with the rule's path; the longest host wins, then the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bind

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DIMENSIONS = 8192
SCALE = 1000

#: The labelled table: words of sites to block and of sites to allow, from which training urls of common shapes are made.
BLOCKED = (
    "ads adserver adclick track tracker tracking clicks popunder popup banner doubleclick spam spammy link-farm linkfarm casino casinos bet bets bonus betting bookmaker poker roulette jackpot slots lottery winner "
    "adult porn porno xxx sexy sex escort escorts nude webcam cams dating hookup pills pharma pharmacy viagra cialis meds drugs steroids replica loan loans payday cash credit crypto forex malware phish phishing "
    "warez torrent torrents crack cracked keygen serial hack cheat followers cheap discount prize giveaway"
).split()
ALLOWED = (
    "news wiki docs forum library museum school university college research journal garden gardening recipes weather travel history science music sports football cooking nature health hospital law court city "
    "county village town council market bakery train trains theatre cinema film data river mountain photo photos paper letters archive archives magazine daily gazette courier network therapy thread leather "
    "anderson rotterdam northern altona interest thornton edinburgh sherborne winterthur lyon lighting enterprise station map maps software book books hotel guide brand weaver painter church parish orchestra "
    "choir poetry novel grammar language dictionary teacher student learning course physics biology chemistry geology astronomy animals birds forest farming harvest kitchen bread coffee tea wine cheese bicycle "
    "walking hiking climbing sailing running chess puzzle drawing pottery sewing knitting carpenter plumber energy solar water bridge railway airport harbour library theory method notes review essays letter"
).split()
_TOPS = "com org net info de fr es io co.uk eu".split()
_HOSTS = ("{a}.{t}", "www.{a}.{t}", "{a}-{b}.{t}", "{a}{b}.{t}", "{b}.{a}.{t}", "{a}{n}.{t}", "my{a}.{t}", "www.{b}-{a}.{t}", "blog.{a}.{t}", "the{a}.{t}", "m.{a}-{b}.{t}", "blog.{a}-{b}.{t}", "{a}-{n}.{t}")
_PATHS = ("/", "/index.html", "/{b}/{n}", "/{n}/{b}.php", "/2021/05/{a}", "/{a}-{b}/", "", "/img/{n}.png", "/page/{n}", "/en/{b}")


def training_urls(part: tuple[int, ...] = (0, 1, 2, 3, 4)) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) from the labelled words whose number, modulo five, is in `part`."""
    out = []
    for words, label, times in ((BLOCKED, 1, 16), (ALLOWED, 0, 12)):
        some = [w for i, w in enumerate(words) if i % 5 in part]
        for i, w in enumerate(some):
            for j in range(times):
                k = i * times + j
                fill = {"a": w, "b": some[(7 * k + 3) % len(some)], "t": _TOPS[(k + j) % len(_TOPS)], "n": k * 37 % 1000}
                out.append((_HOSTS[k % len(_HOSTS)].format(**fill), _PATHS[(k // 3 + j) % len(_PATHS)].format(**fill), label))
    return out


def _grams(host: str, path: str) -> list[int]:
    out = []
    for part, s in ((0, f"^{host}$"), (1, f"^{path}$")):
        s = [ord(c) for c in s]
        out += [(961 * a + 31 * b + c + 4099 * part) % DIMENSIONS for a, b, c in zip(s, s[1:], s[2:])]
    return out


_MODEL: dict[str, tuple[list[int], int]] = {}


def fit(rows: list[tuple[str, str, int]]) -> tuple[list[int], int]:
    """Whole weights and bias of the regression; the same wherever it is trained."""
    used = np.unique([g for h, p, _ in rows for g in _grams(h, p)])
    x = np.zeros((len(rows), len(used)))
    for i, (h, p, _) in enumerate(rows):
        np.add.at(x[i], np.searchsorted(used, _grams(h, p)), 1.0)
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.5 * (x.T @ (p - y) / len(y) + 3e-4 * w)
        b -= 0.5 * float((p - y).mean())
    full = np.zeros(DIMENSIONS)
    full[used] = w
    return [int(v) for v in np.rint(full * SCALE)], int(round(b * SCALE))


def model() -> tuple[list[int], int]:
    if "urls" not in _MODEL:
        _MODEL["urls"] = fit(training_urls())
    return _MODEL["urls"]


def held_out(part: int = 4) -> tuple[float, float]:
    """Shares of held-out urls that are blocked: of those to block and of those to allow; none of their words was trained on."""
    weights, bias = fit(training_urls(tuple(k for k in range(5) if k != part)))
    said = {0: [], 1: []}
    for h, p, y in training_urls((part,)):
        said[y].append(sum(weights[g] for g in _grams(h, p)) + bias > 0)
    return float(np.mean(said[1])), float(np.mean(said[0]))


def _sum(s: Column, part: int, weights: Column) -> Column:
    def scored(code: Column) -> Column:
        at = lambda i: F.pmod(961 * F.get(code, i) + 31 * F.get(code, i + 1) + F.get(code, i + 2) + 4099 * part, F.lit(DIMENSIONS))
        return F.aggregate(F.sequence(F.lit(0), F.size(code) - 3), F.lit(0).cast("long"), lambda a, i: a + F.get(weights, at(i)))

    return bind(F.transform(F.filter(F.split(F.concat(F.lit("^"), s, F.lit("$")), ""), lambda c: c != ""), lambda c: F.ascii(c)), lambda code: F.when(F.size(code) >= 3, scored(code)).otherwise(0))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score."""
    weights, bias = model()
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one literal
    u = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u"))
    rest = F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    u = u.withColumn("rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    u = u.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    score = _sum(F.col("host"), 0, table) + _sum(F.col("path"), 1, table) + bias
    return u.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), score.cast("long").alias("score")).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")


def oracle() -> str:
    """The same in DuckDB."""
    weights, bias = model()
    rules = sorted(RULES, key=lambda r: (-len(r[1]), -len(r[2])))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", f"{h}{p}", kind) for kind, h, p in rules]
    one = lambda s, part: f"coalesce(list_sum(list_transform(range(1, length({s}) + 1), lambda i: w[(961 * ord(substr('^' || {s} || '$', i, 1)) + 31 * ord(substr('^' || {s} || '$', i + 1, 1)) + ord(substr('^' || {s} || '$', i + 2, 1)) + {4099 * part}) % {DIMENSIONS} + 1])), 0)"
    return f"""
WITH r AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT {weights} AS w),
s AS (SELECT page_id, host, path, CAST({one('host', 0)} + {one('path', 1)} + {bias} AS BIGINT) AS score FROM u, m)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {t} THEN '{n}'" for t, n, _ in fits)} END AS rule,
       CASE {' '.join(f"WHEN {t} THEN '{k}'" for t, _, k in fits)} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM s"""
