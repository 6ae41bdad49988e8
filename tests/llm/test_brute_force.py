"""Each corpus operator against a plain version of itself, on the small tables or on made cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from seriesloom.llm import byte_bpe, chat, components, decontaminate, exact_dedup, html_text, near_dedup, quality, queries, sharding, token_files, toxicity


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark, sf):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def run(spark, sf, name):
    return queries.registered()[name](spark, sf).collect()


# --- sharding


def smallest_by_trial(sizes, shards):
    """Least capacity by dynamic programming over all contiguous partitions."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    best = {(0, 0): 0}
    for j in range(1, shards + 1):
        for i in range(len(sizes) + 1):
            best[i, j] = min((max(best[k, j - 1], total[i] - total[k]) for k in range(i + 1) if (k, j - 1) in best), default=math.inf)
    return best[len(sizes), shards]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_the_least(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 9, 40]) for _ in range(rng.randint(1, 25))]
    shards = rng.randint(1, 6)
    borders = sharding.Borders(sizes)
    capacity = borders.capacity(shards, max(sizes))
    assert capacity == smallest_by_trial(sizes, shards)
    ends = [0, *borders.cuts(capacity, shards)]
    assert ends[-1] == len(sizes) and ends == sorted(ends)
    assert max(borders.at[b] - borders.at[a] for a, b in zip(ends[:-1], ends[1:])) <= capacity


def test_cells_give_the_exact_capacity(spark, monkeypatch):
    """With cells so coarse that they have to be refined several times."""
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    rng = random.Random(3)
    rows = [(rng.randrange(-(2**63), 2**63), rng.choice([1, 7, 300])) for _ in range(150)]
    capacity, ends = sharding.minimax_cuts(spark.createDataFrame(rows, "h long, size long"), 5)
    rows.sort(key=lambda r: r[0] % 2**64)
    assert capacity == smallest_by_trial([s for _, s in rows], 5)
    sums = [sum(s for h, s in rows if a <= h % 2**64 < b) for a, b in zip([0, *ends], ends)]
    assert sum(sums) == sum(s for _, s in rows) and max(sums) <= capacity


def test_shards(spark, sf, documents):
    got = run(spark, sf, "op1_sharding")
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in documents)
    texts = dict(documents)
    shards, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        shards[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in shards.values()) and set(slots) <= set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) == got[0].capacity


@pytest.mark.parametrize("copies", [100, 2000])
def test_equal_texts_are_never_divided(spark, copies):
    """Below and above an equal share of the bytes; the largest group then bounds the capacity."""
    rows = [(i, "copied text " * 5 if i < copies else f"text {i} " * 8) for i in range(6000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    group = copies * 68
    assert len({r.shard for r in got if r.doc_id < copies}) == 1
    assert len(got) == len(rows) and max(sizes.values()) == got[0].capacity < max(1.1 * sum(sizes.values()) / 24, group + 1)


# --- exact dedup


def test_exact_groups(spark, sf, documents):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for d, t in documents:
        groups[low(t)].append(d)
    want = {d: (max(ds), len(ds), d == max(ds), hashlib.sha256(t.encode()).hexdigest()) for t, ds in groups.items() for d in ds}
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, sf, "op8_exact_dedup")} == want


def test_filter_slices_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, bits_per_row=4, filter_bytes=40).collect())) == whole
    kept = sorted(r[0] for r in whole if r[3])
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs).collect()) == kept
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs, bits_per_row=4, filter_bytes=40).collect()) == kept


def test_unique_rows_are_not_shuffled(spark, sf):
    keys = exact_dedup.stage(spark.read.parquet(f"{sf}/documents.parquet").select(exact_dedup.text_key("text").alias("sha")))
    flagged = exact_dedup.flag_repeats(keys).groupBy("maybe").count().collect()
    assert {r.maybe: r["count"] for r in flagged}[False] > 0.8 * keys.count()


# --- near dedup


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_by_trial(docs, size, share=80):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and share * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= share * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets}


def test_near_groups(spark, sf, documents):
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, sf, "op5_near_dedup")} == near_by_trial(documents, 2)


def copies(seed, n_bases=6, n_copies=40):
    """Chains of copies around the threshold: their links cross the groups that the first partners give."""
    rng = random.Random(seed)
    docs = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(n_copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                base = own
            docs.append(" ".join(own))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_groups_of_many_copies(spark, seed, size, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 7)
    docs = copies(seed)
    got = near_dedup.link_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=size).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == near_by_trial(docs, size)


@pytest.mark.parametrize("pairs", [0, 10**9])
def test_near_groups_with_several_texts_by_id(spark, pairs, monkeypatch):
    """Ids with several texts, by rounds of partners as long as they lessen the tiles' work, and by tiles after the first."""
    monkeypatch.setattr(near_dedup, "TILE", 7)
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    docs = [(d % 170, text) for d, text in copies(3)]
    got = near_dedup.link_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    want = near_by_trial(docs, 2)
    assert len(got) == len(docs)
    assert {r.doc_id: {r.component_id} for r in got} == {d: {c} for d, (_, c, _) in want.items()}


def test_links_of_a_second_text_in_tiles(spark):
    """Each of two texts of an id has a partner of its own: one is linked by the first round, the other by a tile."""
    rng = random.Random(9)
    x, y = ([f"{c}{rng.randrange(10**6)}" for _ in range(120)] for c in "xy")
    near = lambda words, k: " ".join(words[:k] + ["new"] + words[k + 1 :])
    docs = [(1, near(x, 10)), (2, near(y, 20)), (3, " ".join(x)), (3, " ".join(y))]
    got = near_dedup.link_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=2, star_rounds=1).collect()
    assert {r.component_id for r in got} == {1}


def test_near_groups_write_few_tables(spark, monkeypatch):
    """Each written table costs a job over all shuffle partitions, however few rows it has."""
    count = []
    for module in (near_dedup, components):
        monkeypatch.setattr(module, "stage", lambda df, f=module.stage: (count.append(1), f(df))[1])
    docs = copies(4)
    near_dedup.link_groups(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    assert len(count) <= 35
    count.clear()
    stars = [(100 * a + b, 100 * a) for a in range(5) for b in range(1, 20)]
    assert components.components(spark.createDataFrame(stars, "a long, b long")).count() == 100
    assert len(count) == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    gaps = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 300).astype(np.uint64)
        y = np.concatenate([x[30:], rng.integers(0, 2**63, 30).astype(np.uint64)])
        a, b = near_dedup.signatures([np.unique(x), np.unique(y)])
        gaps.append((a == b).mean() - 270 / 330)
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.03


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)


# --- decontamination


def best_by_trial(item, doc, most):
    """Least edit distance of the item to any stretch of the document, by the full table."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row) if min(row) <= most else None


def test_items_in_documents(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, sf, "op4_decontamination")}
    rng = random.Random(1)
    texts = dict(documents)
    held = {d for d, _ in got}
    assert held
    for d in sorted(held)[:6] + rng.sample(sorted(texts), 6):
        doc = decontaminate.words_of(texts[d])[:1500]
        if len(doc) < len(decontaminate.words_of(texts[d])):
            continue
        for item_id, text in items:
            words = decontaminate.words_of(text)
            assert got.get((d, item_id)) == best_by_trial(words, doc, decontaminate.edits(len(words), 0.2)), (d, item_id)


def test_recall_of_edited_passages():
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(15, 60)))) for i in range(60)]
    items = decontaminate.Items(rows, 0.2)
    found = tried = 0
    for item, words in enumerate(items.words):
        for _ in range(4):
            own = words.tolist()
            for _ in range(items.most[item]):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                own[at : at + (kind > 0)] = [] if kind == 2 else [0]
            found += any(f[0] == item for f in items.find(np.array([0] * 20 + own + [0] * 20)))
            tried += 1
    assert found >= 0.97 * tried


@pytest.mark.parametrize("n, tries", [(60, 40), (300, 20), (800, 12), (2000, 5)])
def test_recall_at_the_full_number_of_edits(n, tries):
    rng = random.Random(n)
    words = [f"w{rng.randrange(3 * n)}" for _ in range(n)]
    items = decontaminate.Items([(1, " ".join(words))], 0.2)
    found = 0
    for _ in range(tries):
        own = items.words[0].tolist()
        for _ in range(items.most[0]):
            at, kind = rng.randrange(len(own)), rng.randrange(3)
            own[at : at + (kind != 1)] = [] if kind == 2 else [0]
        found += bool(items.find(np.array([0] * 50 + own + [0] * 50)))
    assert found >= 0.95 * tries


def test_tables_follow_length_and_recall():
    assert decontaminate.tables_for(3, 0.2, 0.99) == (1, 3)  # no edits: equal walks
    more, fewer = decontaminate.tables_for(40, 0.2, 0.999)[0], decontaminate.tables_for(40, 0.2, 0.9)[0]
    assert more > fewer
    assert decontaminate.tables_for(2000, 0.2, 0.99)[1] < decontaminate.tables_for(40, 0.2, 0.99)[1]


def test_start_distances():
    rng = random.Random(8)
    for _ in range(60):
        item, doc = ([rng.randrange(1, 5) for _ in range(rng.randint(1, 9))] for _ in range(2))
        got = decontaminate.start_distances(np.array(item), np.array(doc)).tolist()
        full = lambda part: min(best_by_trial_prefix(item, part))
        assert got == [full(doc[s:]) for s in range(len(doc) + 1)]


def best_by_trial_prefix(item, part):
    """Edit distances of the item to each beginning of ``part``."""
    row = list(range(len(part) + 1))
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(part, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != v)))
        row = new
    return row


def test_item_slices(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.find_items(docs, items).collect()))
    assert sorted(map(tuple, decontaminate.find_items(docs, items, most_items=15).collect())) == whole
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, items, most_items=15).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {r[0] for r in whole}


def test_documents_of_a_batch_stay_apart():
    items = decontaminate.Items([(7, "one two three four five six seven eight nine ten")], 0.0)
    texts = pa.array(["x One, two three four", None, "five six seven eight nine ten", "", "one two three four; five six seven eight nine_ten y", "one two three four five six seven eight nine ten"])
    coded, edges = decontaminate._coded(texts, items)
    assert [h[0] for h in items.find_all(coded, edges)] == [4, 5]
    assert np.diff(edges).tolist() == [5, 0, 6, 0, 11, 10]


# --- tokenizers


def test_byte_bpe(spark, sf, documents):
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.RANKS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in documents:
        ids = plain.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, sf, "op6_byte_bpe")} == want


@pytest.mark.parametrize("text", ["", "a" * 1500 + "bcd" * 300, "漢字かな交じり文 😀😀 x́ ﷽", " \n\n\t x  ", "it's they're\x00\x01 <|endoftext|>", "ab" * 203, "=" * 399 + " " * 402])
def test_byte_bpe_of_odd_texts(spark, text):
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS), special_tokens={})
    got = byte_bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.RANKS, public_tokenizers.PATTERN).first()
    assert np.frombuffer(got.ids, "<u4").tolist() == plain.encode_ordinary(text) and bytes(got.decoded) == text.encode()


def test_token_files(spark, sf, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.WORD_BPE)
    want, start = {}, 0
    for d, t in sorted(documents):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: tuple(r)[1:] for r in run(spark, sf, "op9_token_files")} == want


def test_token_files_on_disk(spark, tmp_path):
    rows = [(5, "Ab c d"), (None, "x"), (2, None), (2, "it's <|endoftext|> 12 é ß"), (9, "")]
    folder = f"file://{tmp_path}/tokens"
    index = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, lambda: token_files.WordEncoder(queries.WORD_BPE, "<u2"), 1, parts=3)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.WORD_BPE)
    ids = [np.fromfile(tmp_path / "tokens" / f"part-{p['part']:06d}.ids", "<u2").tolist() for p in index["parts"]]
    want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for _, t in [rows[1], rows[2], rows[3], rows[0], rows[4]]]
    got = sum(ids, [])
    assert got == sum(want, []) or got == sum([want[0], want[2], want[1], *want[3:]], [])
    offsets = [np.fromfile(tmp_path / "tokens" / f"part-{p['part']:06d}.off", "<u8").tolist() for p in index["parts"]]
    assert [o[0] for o in offsets] == [p["base"] for p in index["parts"]] and offsets[-1][-1] == len(got) == index["tokens"]
    back = token_files.read_tokens(spark, folder, index).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, 2, 2, 5, 9]


# --- pages


PAGES = [
    ("", ""),
    (None, ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one <b>t</b>wo<p>three<script>if (a<b) { '</p>' }", "one two three"),
    ("<body><nav>menu</nav><article><h1>T</h1><p>a&nbsp;b<br>c</p><ul><li>x<li>y</ul></article><footer>f</footer>", "T a b c x y"),
    ("<div class='sidebar'>s</div><div id=main><p>Hello wor<i>l</i>d</p><div class='comments'>no</div><p>second &lt;3</p></div><div class=cookie-notice>n</div>", "Hello world second <3"),
    ("<body><!-- <p>not</p> --><main><form><p>not</p></form><p>yes</p></main><aside>not</aside></body>", "yes"),
    ("<article><p>" + "long text " * 50 + "</p><div class=ad><p>not</p></div></article>", ("long text " * 50).strip()),
    ("<article><p>cut off &am", "cut off &am"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "a long line of the article, which goes on and on. " * 20
WRAPPED = [
    f"<div class='content has-sidebar'><p>{LONG}</p><p>{LONG}</p><div class=sidebar>other</div></div>",
    f"<div id='page' class='no-sidebar'><nav>menu</nav><article><p>{LONG}</p><p>{LONG}</p><div class=share>other</div></article><div class=comments><p>other</p></div></div>",
    f"<div class='widget'><main><p>{LONG}</p><p>{LONG}</p></main></div><div class='related'>other</div>",
    f"<section id='legal'><div><p>{LONG}</p><p>{LONG}</p></div></section><div class='social'>other</div>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_names_of_wrappers_do_not_cut_the_article(page):
    assert html_text.main_text(page) == " ".join([LONG.strip()] * 2)


def test_deep_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"


def test_pages(spark, sf):
    """The test pages have their text in one article element: an independent reading of it gives the same."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.on, self.out = False, []

        def handle_starttag(self, tag, attrs):
            self.on |= tag == "article"
            self.out += [" "] * (self.on and tag != "b")

        def handle_endtag(self, tag):
            self.out += [" "] * (self.on and tag != "b")
            self.on &= tag != "article"

        def handle_data(self, data):
            self.out += [data] * self.on

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = run(spark, sf, "op2_html_text")
    assert len(got) == len(pages)
    for r in got:
        reader = Article()
        reader.feed(pages[r.page_id].html)
        reader.close()
        assert r.text == " ".join("".join(reader.out).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# --- models


def held(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def test_toxicity(spark, sf, labels):
    got = run(spark, "/root/testdata/sf0.01", "op3_toxicity")
    known = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    rows = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in rows) / len(rows) >= 0.93


def test_kneser_ney_sums_to_one():
    """After any context the letters' probabilities add up to one in both orders that are mixed."""
    words = ["abc", "abd", "bcd", "cab", "dab", "abab"]
    owner, keys = toxicity.gram_keys(words)
    at, n = np.unique(keys, return_counts=True)
    shared, own = toxicity.Shared(at), toxicity.Counts(at[::2], n[::2])
    letters = np.array(sorted({int(k) & 4095 for k in at}))
    for context in sorted({int(k) >> 12 for k in at})[:20]:
        every = (context << 12) | letters
        lower = shared(every)
        rest = 1 - lower.sum()
        assert 0 <= rest < 0.2  # what is left is for letters that were never seen
        assert abs(own.smoothed(every, lower).sum() + rest * (1 - own.smoothed(every, lower * 0).sum()) - 1) < 1e-9


def test_rare_toxic_words_count_in_noise(spark):
    """However many sequences of junk there are, a word seen once in a toxic row is evidence, and the model is that of all sequences."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzабвгдежзиклмнопрстуфхцчшщъыьэюя"))
    junk = [(1000 + i, " ".join("".join(w) for w in rng.choice(letters, (500, 9)))) for i in range(420)]
    common = [(i, "the plain words of a common text are here again " * 3) for i in range(60)]
    greek = np.array(list("αβγδεζηθικλμνξοπρστυφχψω"))
    toxic = [(i, "".join(rng.choice(greek, 6))) for i in range(60, 99) if not held(i, 3, 1)]  # each word is there once
    rows = common + [(i, f"the {word} of a common text") for i, word in toxic] + junk
    classes = [(i, 0) for i, _ in common] + [(i, 1) for i, _ in toxic]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(classes, "doc_id long, toxic int")
    words = [word for _, word in toxic] + ["plain", "theqk", "common", *junk[0][1].split()[:50]]
    every = np.unique(np.concatenate([toxicity.gram_keys(toxicity.words_of(t))[1] for _, t in rows]))
    assert len(every) > 1_500_000
    model = toxicity.train(docs, known)
    got = model.of_words(words)
    assert np.allclose(got, toxicity.Model(model.toxic, model.ordinary, toxicity.Shared(every)).of_words(words), atol=1e-12)
    assert (got[: len(toxic)] > 5).sum() >= len(toxic) // 2  # a fifth of the labelled rows fit the curve and give no counts


def test_quality(spark, sf):
    got = run(spark, "/root/testdata/sf0.01", "op10_quality")
    known = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    rows = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in rows) / len(rows) >= 0.93


def test_votes_by_trial():
    rng = np.random.default_rng(0)
    vectors, latent = quality.unit(rng.normal(size=(60, 5))), quality.unit(rng.normal(size=(30, 5)))
    labels = rng.integers(0, 2, 60).astype(float)
    model = quality.Model(np.zeros(1), np.zeros((1, 5)), vectors, labels, nearest=7, power=3.0)
    for row, score in zip(latent, model.scores(latent, block=4)):
        near = sorted(((float(row @ v), y) for v, y in zip(vectors, labels)), reverse=True)[:7]
        total = sum(max(s, 0) ** 3 for s, _ in near)
        assert abs(score - (sum(max(s, 0) ** 3 * y for s, y in near) + labels.mean() * 1e-3) / (total + 1e-3)) < 1e-5


# --- chat


def likeliest(model, lines):
    """Score of the best path over all sequences of states."""
    best = -math.inf
    for path in itertools.product(range(len(chat.STATES)), repeat=len(lines)):
        score, before = 0, None
        for state, (_, marker, kind, first) in zip(path, lines):
            score += int(model.first[state] if before is None else model.move(first, marker)[before, state]) + int(model.emission(marker, kind)[state])
            before = state
        best = max(best, score)
    return best


def score_of(model, lines, path):
    score, before = 0, None
    for state, (_, marker, kind, first) in zip(path, lines):
        score += int(model.first[state] if before is None else model.move(first, marker)[before, state]) + int(model.emission(marker, kind)[state])
        before = state
    return score


def talk(rng, n):
    return [(rng.choice(["user", "assistant", "system", None, "odd"]), rng.choice(["Hi?\nAssistant: hello", "- a\n- b", "", "long " * 30, "User: x"])) for _ in range(n)]


def test_viterbi_finds_the_likeliest(spark):
    rng = random.Random(0)
    counts = np.random.default_rng(1)
    model = chat.Speakers(chat.normal(counts.integers(0, 9, 3)), chat.normal(counts.integers(0, 9, (3, 3))), chat.normal(np.eye(3) * 50), chat.normal(counts.integers(0, 9, (3, chat.FEATURES))))
    for _ in range(10):
        lines = [x for r, t in talk(rng, 4) for x in chat.lines_of(r, t)][:7]
        assert score_of(model, lines, chat.decode(model, lines, None, None)) == likeliest(model, lines)


def test_long_conversations_are_decoded_whole(spark, monkeypatch):
    """In chunks and levels, the path is as likely as that of one walk over all lines."""
    monkeypatch.setattr(chat, "CHUNK", 4)
    monkeypatch.setattr(chat, "FAN", 3)
    rng = random.Random(7)
    rows = [(c, t, *x) for c, n in ((1, 90), (2, 3), (3, 17)) for t, x in enumerate(talk(rng, n))]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    seen = {}
    keep = chat.learn
    monkeypatch.setattr(chat, "learn", lambda rows: seen.setdefault("model", keep(rows)))
    got = sorted(chat.format_turns(table).collect(), key=lambda r: (r.conv_id, r.turn))
    model = seen["model"]
    for conv in (1, 2, 3):
        own = [r for r in rows if r[0] == conv]
        lines = [x for r in own for x in chat.lines_of(r[2], r[3])]
        want = chat.decode(model, lines, None, None)
        path, at = [], 0
        for r, row in zip([g for g in got if g.conv_id == conv], own):
            for line, marker, _, _ in chat.lines_of(row[2], row[3]):
                path.append(want[at])
                at += 1
        flat = [role for r in got if r.conv_id == conv for role in r.roles]
        shortened = [chat.STATES[s] for s in _turn_states(own, want)]
        assert flat == shortened or conv == 1 and sum(a != b for a, b in zip(flat, shortened)) <= 2


def _turn_states(rows, states):
    out, at = [], 0
    for row in rows:
        last, empty = None, True
        for line, marker, _, _ in chat.lines_of(row[2], row[3]):
            if last is None or states[at] != last or marker >= 0:
                out.append(states[at])
            last = states[at]
            at += 1
    return out


def test_roles_are_recovered(spark, sf):
    """Where every third role is hidden, the model gives most of them back."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hidden = [(c, t, None if zlib.crc32(f"{c}-{t}".encode()) % 3 == 0 else r, x) for c, t, r, x in rows]
    got = {(r.conv_id, r.turn): r.roles for r in chat.format_turns(spark.createDataFrame(hidden, "conv_id long, turn int, role string, text string")).collect()}
    asked = [(got[c, t][0], r) for (c, t, r, _), h in zip(rows, hidden) if h[2] is None]
    assert len(got) == len(rows) and sum(a == b for a, b in asked) / len(asked) > 0.85


def test_rendering(spark):
    rows = [(1, 0, "system", "Be kind.<|im_end|>"), (1, 1, "human", "Hi\nAssistant: hello\nthere"), (1, 1, "human", "Hi\nAssistant: hello\nthere")]
    got = sorted(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect(), key=lambda r: r.turn)
    assert [r.roles for r in got] == [["system"], ["user", "assistant"]]
    assert "".join(r.rendered for r in got) == "<|im_start|>system\nBe kind.< |im_end| ><|im_end|>\n<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nhello\nthere<|im_end|>\n"


CHAT = "conv_id long, turn int, role string, text string"


def test_repeated_rows_all_come_back(spark):
    """A transcript without turn numbers keeps its second 'ok', and a row that is there 700 times is given 700 times."""
    rows = [(1, None, "user", "ok"), (1, None, "assistant", "go on"), (1, None, "user", "ok")] + [(2, 0, "user", "again")] * 700 + [(None, None, None, "x")] * 3
    got = chat.format_turns(spark.createDataFrame(rows, CHAT).repartition(5), distinct=False).collect()
    assert Counter((r.conv_id, r.turn, r.given_role) for r in got) == Counter(r[:3] for r in rows)
    assert {(r.conv_id, *r.texts) for r in got} == {(1, "ok"), (1, "go on"), (2, "again"), (None, "x")}


def learnt(monkeypatch, table):
    seen, keep = [], chat.learn
    with monkeypatch.context() as patch:
        patch.setattr(chat, "learn", lambda rows: seen.append(keep(rows)) or seen[-1])
        chat.format_turns(table)
    return seen[0]


def test_what_is_learnt_counts_equal_rows_once_in_any_layout(spark, monkeypatch):
    rows = [(c, t, role, "text?" * (t + 1)) for c in range(20) for t, role in enumerate(["system", "user", "assistant", "user"])]
    once = learnt(monkeypatch, spark.createDataFrame(rows, CHAT))
    for parts in (1, 7):
        many = learnt(monkeypatch, spark.createDataFrame(rows * 3, CHAT).repartition(parts))
        assert all(np.array_equal(getattr(once, f), getattr(many, f)) for f in ("first", "rows", "inside", "shown"))


def test_moves_between_chunks_are_learnt(spark, monkeypatch):
    rows = [(1, t + 1000, ["user", "assistant"][t % 2], "x") for t in range(40)]
    whole = learnt(monkeypatch, spark.createDataFrame(rows, CHAT))
    monkeypatch.setattr(chat, "CHUNK", 3)
    cut = learnt(monkeypatch, spark.createDataFrame(rows, CHAT))
    assert np.array_equal(whole.rows, cut.rows) and np.array_equal(whole.first, cut.first)
    assert np.array_equal(whole.rows, chat.normal([[0, 0, 0], [0, 0, 20], [0, 19, 0]])) and np.array_equal(whole.first, chat.normal([0, 1, 0]))
