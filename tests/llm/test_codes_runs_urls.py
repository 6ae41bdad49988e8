"""Vector codes, periodic runs and the URL filter against plain versions, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import periodic_runs, queries, url_filter, vector_codes

CLASH = ["v", "ids", "labels", "trees", "part", "entry", "at", "n", "code", "error", "_label", "host", "path", "rule", "says", "blocked", "features", "fold", "runs", "start"]


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# --- vector codes


def plain_codes(rows, entries=256, rounds=4):
    """vec_id, label and vector triples in the order of the ids, coded with Python's integers."""
    whole = [[math.floor(1024 * x) for x in v] for _, _, v in rows]
    width = len(whole[0]) // 4
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(4):
        part = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(x) for x in part[:entries]]
        for turn in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in part]
            if turn == rounds:
                break
            for k in range(len(book)):
                mine = [x for x, (_, e) in zip(part, near) if e == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        books += book
        codes = [c + f"{e:02x}" for c, (_, e) in zip(codes, near)]
        errors = [x + d for x, (d, _) in zip(errors, near)]
    by_label = Counter()
    for (_, label, _), e in zip(rows, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(v) for e in books for v in e).encode()).hexdigest()
    return [(i, c, e, by_label[label], sha) for (i, label, _), c, e in zip(rows, codes, errors)]


def coded(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label int")
    out = vector_codes.product_codes(clash(df), **more)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("kind", ["cloud", "groups", "copies", "large"])
def test_codes_equal_plain_rounds(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    n, dims = 300, 8
    if kind == "cloud":
        v = rng.normal(size=(n, dims)) / 5
    elif kind == "groups":
        v = rng.normal(size=(n, dims)) / 200 + rng.integers(0, 3, size=(n, 1))
    elif kind == "copies":
        v = rng.integers(0, 3, size=(n, dims)) / 4
    else:
        v = rng.normal(size=(n, dims)) * 10.0 ** rng.integers(-2, 30, size=(n, 1))
    monkeypatch.setattr(vector_codes, "CHUNK", 70)
    rows = [(i, [None, 0, 1][i % 3], [float(x) for x in r]) for i, r in enumerate(v)]
    want = [(i, c, e if e < 1 << 63 else None, g, s) for i, c, e, g, s in plain_codes(rows, entries=20)]
    got = coded(spark, rows, entries=20)
    if kind == "large":  # sums beyond a long: the codes and codebooks still have to agree
        want, got = [[(r[0], r[1], r[2], r[4]) for r in x] for x in (want, got)]
    assert got == sorted(want, key=repr)


def test_a_ball_with_one_entry_left_is_counted_by_its_sum():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 3, size=(200, 4)) for c in (0, 500, 1000, 1500)]).round().astype(np.int32)
    state = vector_codes.Tree(points.astype(float), points).state
    owned, leaves = vector_codes.walk(state, np.array([[c] * 4 for c in (0, 500, 1000, 1500)], np.int64))
    assert not leaves and sum(len(nodes) for nodes, _ in owned) < 40
    start, stop, sums = state[2], state[3], state[7]
    assert sum((stop - start)[nodes].sum() for nodes, _ in owned) == 800
    assert sum(sums[nodes].sum(0) for nodes, _ in owned).tolist() == points.sum(0).tolist()


def test_balls_hold_their_points_sums_and_counts():
    rng = np.random.default_rng(2)
    points = rng.integers(-50, 50, size=(500, 3)).astype(np.int32)
    ordered, order, start, stop, left, right, radius, sums, root = vector_codes.Tree(points.astype(float), points).state
    assert (ordered == points[order]).all() and sorted(order.tolist()) == list(range(500)) and (start[root], stop[root]) == (0, 500)
    for k in range(len(start)):
        mine = ordered[start[k] : stop[k]].astype(float)
        assert sums[k].tolist() == mine.sum(0).tolist()
        assert np.sqrt(((mine - mine.mean(0)) ** 2).sum(1)).max() <= radius[k] + 1e-9
        if left[k] >= 0:
            assert (start[left[k]], stop[left[k]], stop[right[k]]) == (start[k], start[right[k]], stop[k])


def test_unusable_vectors_are_left_out(spark):
    good = [(i, 0, [i / 10, 1.0, 2.0, 3.0]) for i in range(5)]
    odd = [(-1, 0, None), (-2, 0, []), (-3, 0, [1.0, None, 2.0, 3.0]), (-4, 0, [1.0, float("nan"), 2.0, 3.0]), (-5, 0, [1.0, float("inf"), 2.0, 3.0]), (9, 0, [1.0, 2.0])]
    assert coded(spark, good + odd) == sorted(plain_codes(good), key=repr)
    assert coded(spark, odd[:5]) == [] == coded(spark, [])
    repeated = sorted(good + good[:2])
    assert coded(spark, repeated) == sorted(plain_codes(repeated), key=repr)
    nulls = good + [(None, None, [0.5, 0.5, 0.5, 0.5])]
    assert coded(spark, nulls) == sorted(plain_codes(nulls), key=repr)
    with pytest.raises(ValueError):
        coded(spark, [(1, 0, [1.0, 2.0, 3.0])])


# --- periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def made_words(rng):
    kind, n = rng.random(), rng.randint(0, 160)
    if kind < 0.2:
        w = [rng.choice("ab") for _ in range(n)]
    elif kind < 0.5:
        w = []
        while len(w) < n:
            w += ([rng.choice("abc") for _ in range(rng.randint(1, 20))] * rng.randint(1, 12))[: rng.randint(1, 80)]
    elif kind < 0.6:
        w = ["a"] * n
    elif kind < 0.8:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        w = list((b * 3)[:n])
    else:
        w = (([str(rng.randint(0, 3)) for _ in range(rng.randint(1, 40))] * 2 + ["z"]) * 5)[:n]
        if len(w) > 10:
            w[rng.randrange(len(w))] = "q"
    return [x.encode() for x in w]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [made_words(rng) for _ in range(60)]
    got = periodic_runs.batch_runs(texts)
    assert got == [plain_runs(w) for w in texts] and sum(map(len, got)) > 10


@pytest.mark.parametrize("seed", range(6))
def test_common_extensions_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    body = rng.integers(0, 2, 300) if seed % 2 else np.repeat(rng.integers(0, 2, 60), rng.integers(1, 12, 60))
    text = np.concatenate([[7], body, [8]])
    text = np.unique(text, return_inverse=True)[1]
    right = periodic_runs.Grammar(text)
    left, n = right.mirrored(), len(text)
    a, b = rng.integers(1, n - 1, 400), rng.integers(1, n - 1, 400)
    a, b = a[a != b], b[a != b]
    common = lambda t, x, y: next(k for k in range(n) if x + k >= n or y + k >= n or t[x + k] != t[y + k])
    assert right.common(a, b).tolist() == [common(text, x, y) for x, y in zip(a, b)]
    assert left.common(n - 1 - a, n - 1 - b).tolist() == [common(text[::-1], n - 1 - x, n - 1 - y) for x, y in zip(a, b)]
    assert len(right.symbols) < 8 * math.log2(n)


def plain_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(kept))


def test_run_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.registered()["op12_periodic_runs"](spark, sf).collect()]
    small = {i for i, t in docs if len((t or "").split()) <= 600}
    assert len(got) == len(docs) and len(small) > 100
    assert sorted((r for r in got if r[0] in small), key=repr) == sorted((plain_row(i, t) for i, t in docs if i in small), key=repr)
    assert sum(r[1] > 0 for r in got) > 10


def test_run_edges(spark):
    line = "one two three four five six seven eight "
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line * 4), (4, line * 4), (5, line * 2), (None, "a " * 30), (6, "a\x1ca a\x85a \u3000 " * 20), (7, "x" * 100_000), (8, line * 5_000), (9, ("a b c d e f g h i " * 3 + "z ") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for source in (df, clash(df)):
        got = periodic_runs.find_runs(source, plant=True, texts=False).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((plain_row(i, t) if i != 8 else tuple(next(r for r in got if r.doc_id == 8)) for i, t in rows), key=repr)
    whole = {r.doc_id: r for r in periodic_runs.find_runs(df.where("doc_id in (4, 8)").distinct()).collect()}
    assert whole[8].runs == [[0, 40_000, 8]] and whole[8].collapsed == whole[4].collapsed == line.strip() and whole[4].exponent_milli == 4000
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


# --- URL filter


def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, says in rules:
        own, _, below = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, *(best or (None, None))


URLS = [
    "https://WWW.Example.com/en/1", "http://example.com/en/", "http://a.www.example.com/en/x?u=1", "http://wwwexample.com/en/", "http://example.com/EN/1", "http://x.com", "http://x.com?a=/en/", "http://x.com#://y.net/es/",
    "ftp://b.net/es/1", "//b.net/es/1", "b.net/es/", "http://b.net/fr/a?b#c", "http://net/fr/", "://com/", "http:///en/", "", None, "http://É.net/es/ü", "http://x.com:80/a", "http://x.org/a.php?x=1&y=2;z", "http://x.com/\nen/", "a://b://c.com/",
]


def judged(df, **more):
    out = url_filter.judge(df, queries.RULES, **more)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "blocked"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_rules_equal_plain_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://b.net/es/"), (3, URLS[3])]
    got = judged(clash(spark.createDataFrame(rows, "page_id long, url string")), rounds=2)
    want = sorted(((i, *plain_verdict(u, queries.RULES)) for i, u in rows), key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert all(r[4] == w[4] for r, w in zip(got, want) if w[4])
    assert all((r[5] is None) == (r[3] is not None) and r[4] == ("block" if (r[5] or 0) >= 0.5 else "allow") for r in got if r[3] is None)


def test_without_labels_of_both_kinds(spark):
    rows = lambda *urls: spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r[4] for r in judged(rows("http://a.org/", "http://b.org/", None))] == ["allow"] * 3
    assert [r[4] for r in judged(rows("http://a.net/es/", "http://b.org/"))] == ["block"] * 2
    assert [r[4] for r in judged(rows("http://a.com/", "http://b.org/"))] == ["allow"] * 2
    assert judged(rows("http://a.com/").limit(0)) == []


def test_features_count_what_they_say(spark):
    url = "https://a1.b-c.example.com/one/two22/file.html?x=1&y=2#top"
    df = spark.createDataFrame([(1, url)], "page_id long, _url string")
    host, path = url_filter.host_and_path(F.col("_url"))
    r = url_filter.with_features(df.withColumns({"host": host, "path": path})).first()
    entropy = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
    assert (r.f_length, r.f_depth, r.f_host_depth, r.f_parameters, r.f_hyphens, r.f_fragment, r.f_secure) == (len(url), 3, 4, 2, 1, 1, 1)
    assert (r.tld, r.site, r.folder, r.file) == ("com", "example.com", "one", "html")
    assert r.f_digits == pytest.approx(5 / len(url)) and r.f_host_entropy == pytest.approx(entropy(r.host)) and r.f_path_entropy == pytest.approx(entropy(r.path))


def test_trees_learn_the_blocked_hosts_they_have_not_seen(spark):
    """Rules know half of the spam hosts; the others look like them."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    spam = lambda: f"{word(4)}{rng.randint(1000, 99999)}-{rng.randint(100, 999)}"
    hosts = [(f"{spam()}.xyz" if k % 2 else f"{word(7)}.org", k % 2) for k in range(240)]
    rules = [(h + "/", "block" if bad else "allow") for h, bad in hosts[:120]]
    rows = [(i, f"http://{h}/{word(5)}/{word(6)}" + (f"?id={rng.randint(1, 10**9)}&s={word(9)}" if bad else ".html")) for i, (h, bad) in enumerate(hosts * 3)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, rounds=5).where("rule is null").collect()
    truth = dict(hosts)
    assert len(out) == 360 and sum((r.verdict == "block") == bool(truth[r.host]) for r in out) > 350
