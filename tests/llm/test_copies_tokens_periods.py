"""Covering SimHash, tokenizer alignment and periodic runs against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import alignment, periods, queries, simhash

from .test_operators import FOLD, WORDS, texts, union


@pytest.fixture(scope="module")
def table(spark):
    """Prose with copies; nulls, ties, repeated rows and ids, clashing names."""
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts(8, 60))]
    rows += [(5, rows[5][1], "x", 1, 2), (8, "other words under an id that is taken", "x", 1, 2), (None, rows[9][1], "x", 1, 2), (70000, "a b c " * 40 + "d " * 30, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_runs string, fingerprint long, n_a int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def pairs_of(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.select(*names).collect()]


# ---- SimHash ----


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate(FOLD))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius):
    """(doc_id, fingerprint) rows to the smallest id that each reaches."""
    links = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i][1] ^ prints[j][1]).bit_count() <= radius]
    label = union(len(prints), links)
    least = collections.defaultdict(list)
    for (d, _), g in zip(prints, label):
        least[g].append(d)
    return [(d, f"{p:016x}", min((x for x in least[g] if x is not None), default=None)) for (d, p), g in zip(prints, label)]


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("few", [16, 1])
def test_simhash_rows(table, few):
    prints = [(d, brute_fingerprint(t)) for d, t in pairs_of(table, "doc_id", "text")]
    got = [tuple(r) for r in simhash.near_duplicates(table, few=few).collect()]
    assert key(got) == key(brute_groups(prints, 2))


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_every_pair_within_the_radius_has_a_key(radius):
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    sets = itertools.combinations(range(64), radius) if radius < 3 else (rng.sample(range(64), radius) for _ in range(3000))
    for some in sets:
        changed = sum(1 << i for i in some)
        assert any(m & changed == 0 for m in tables)


@pytest.mark.parametrize("radius,few", [(1, 16), (1, 1), (2, 16), (2, 2), (3, 1), (3, 16)])
def test_links_of_crowded_keys(spark, radius, few):
    """Families of fingerprints around few centres: links reach what all pairs reach."""
    rng = random.Random(radius)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << i for i in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))))
    prints = [simhash._signed(p) for p in prints]
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, few).collect()
    at = {p: i for i, p in enumerate(prints)}
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius for r in got)
    mine = union(len(prints), [(at[r.a], at[r.b]) for r in got])
    true = union(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= radius])
    assert len(set(zip(mine, true))) == len(set(mine)) == len(set(true))


# ---- alignment ----

ODD = ["", None, " ", "  \n\n a", "a  b   c ", "don't 1234 it's<|endoftext|>", "<s> x </s>", "naïve ÀÉ çok", "日本語 text", "emoji 👍🏽 done", "a▁b", "tab\tand\r\nline ", " x y", "\x00nul\x1fx", "x" * 3000, "é" * 200]


def ends(ids, table):
    return np.cumsum([len(table[i]) for i in ids]).tolist()


def brute_alignment(texts_):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and digest of each text, by whole encoding and dictionaries."""
    a, b, *_ = alignment._loaded(alignment.FIRST, alignment.SECOND)
    rows, links = [], []
    for t in texts_:
        x = a.whole.encode(f" {t}", add_special_tokens=False).ids if t else []
        y = b.whole.encode(t) if t else []
        want = f" {t}".encode()
        if b"".join(a.table[i] for i in x) != want or b"".join(b.table[i] for i in y) != want:
            x, y = [], []
        p, q = ends(x, a.table), ends(y, b.table)
        own = [(i, j) for e, i in zip(p, x) for f, j in zip(q, y) if e == f] if len(p) < 400 else [(x[p.index(e)], y[q.index(e)]) for e in sorted(set(p) & set(q))]
        cuts = sorted(set(p) & set(q))
        groups = [",".join(str(i) for e, i in zip(p, x) if lo < e <= hi) + "|" + ",".join(str(j) for e, j in zip(q, y) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts)] if len(cuts) < 1500 else None
        links.append(own)
        rows.append((len(x), len(y), len(cuts), len(own), groups))
    count = collections.Counter(l for own in links for l in own)
    most = collections.defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*r[:4], sum(count[l] == most[l[1]] for l in own), sum(count[l] for l in own), "" if not r[0] else hashlib.sha256(";".join(r[4]).encode()).hexdigest() if r[4] is not None else None) for r, own in zip(rows, links)]


@pytest.mark.parametrize("radix,span", [(16, 8), (3, 1)])
def test_alignment_rows(spark, table, radix, span):
    some = table.select("doc_id", "text", "n_runs", "n_a").union(spark.createDataFrame([(900 + i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_runs string, n_a int")).cache()
    rows = pairs_of(some, "doc_id", "text")
    want = [(d, *w) for (d, _), w in zip(rows, brute_alignment([t for _, t in rows]))]
    got = key(tuple(r) for r in alignment.align(some, radix=radix, span=span).collect())
    assert len(got) == len(want)
    for g, w in zip(got, key(want)):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_token_groups_give_the_text(table):
    a, b, *_ = alignment._loaded(alignment.FIRST, alignment.SECOND)
    for d, groups, text in [(r.doc_id, r.groups, r.text) for r in alignment.token_groups(table.filter("doc_id IS NOT NULL AND doc_id NOT IN (5, 8)")).join(table, "doc_id").collect()]:
        whole = b"".join(a.table[i] for g in groups for i in g.a)
        assert whole == b"".join(b.table[i] for g in groups for i in g.b)
        assert whole == (f" {text}".encode() if text else b"")
        assert all(b"".join(a.table[i] for i in g.a) == b"".join(b.table[i] for i in g.b) for g in groups)


def test_runs_round_trip_and_merge():
    rng = np.random.default_rng(3)
    total = collections.Counter()
    runs = []
    for _ in range(7):
        pair, doc = rng.integers(0, 50, 900) + (rng.integers(0, 40, 900) << 20), rng.integers(0, 300, 900)
        total.update(pair.tolist())
        made = list(alignment._runs(pair, doc, 4))
        assert [r for r, _, _ in made] == sorted({int(p >> 20) % 4 for p in pair})
        for r, p, posts in made:
            ids, n = alignment.unpacked(p)
            _, each, d, times = alignment.unpacked(posts)
            assert collections.Counter(dict(zip(zip(np.repeat(ids, each).tolist(), d.tolist()), times.tolist()))) == collections.Counter((int(x), int(y)) for x, y in zip(pair, doc) if (x >> 20) % 4 == r)
        runs += [p for _, p, _ in made]
    assert list(alignment.merged(runs)) == sorted(total.items())


def test_alignment_empty(empty):
    assert alignment.align(empty).count() == 0


# ---- periodic runs ----


def brute_runs(w, least=12):
    """Every maximal stretch for each period, if no smaller one fits it."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                found.append((i, n, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(rng):
    """A text of repeats within repeats, over few or many words."""
    some = [f"w{i}" for i in range(rng.choice([2, 3, 5, 40]))]
    out = []
    while len(out) < rng.randint(5, 160):
        kind = rng.random()
        if kind < 0.4 or not out:
            out += [rng.choice(some) for _ in range(rng.randint(1, 12))]
        elif kind < 0.8:
            block = out[-rng.randint(1, 20) :]
            out += (block * rng.randint(1, 6))[: rng.randint(1, 90)]
        else:
            out += [f"only{len(out)}"]
    return out


@pytest.mark.parametrize("least", [12, 2, 5, 30])
def test_runs_of_made_texts(least):
    rng = random.Random(least)
    made = [periodic(rng) for _ in range(250)] + [[], ["a"] * 400, ["a", "b"] * 90]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    made.append(list(fib[-1]))
    for w, (ws, runs) in zip(made, periods.runs_of([" ".join(w).encode() for w in made], least)):
        assert [x.decode() for x in ws] == w
        assert runs == brute_runs(w, least), w


def test_long_periodic_text_in_time():
    rng = random.Random(1)
    block = [str(rng.randrange(3000)) for _ in range(20000)]
    assert periods.runs_of([" ".join(block * 3).encode()])[0][1][-1:] != []
    assert periods.runs_of([b"a " * 200000])[0][1] == [(0, 200000, 1)]


def brute_row(d, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return d, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_periodic_rows(spark, table, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(periodic(rng))) for i in range(1000, 1150)]
    short = table.filter("text IS NULL OR length(text) < 3000").select("doc_id", "text", F.lit(1).alias("runs")).union(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, runs int"))
    short.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pairs_of(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", "text")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert key(tuple(r[n] for n in names) for r in got) == key(brute_row(d, t) for d, t in rows)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows)


def test_periodic_keeps_columns_and_bears_an_empty_table(table, empty):
    found = periods.periodic_runs(table, keep=("n_runs", "text"))
    assert found.columns == ["doc_id", "n_words", "runs", "text", "keep_n_runs", "keep_text"] and found.count() == table.count()
    assert periods.periodic_runs(empty).count() == 0
    assert re.search("long", found.schema.simpleString().replace("bigint", "long"))
