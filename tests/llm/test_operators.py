"""Every operator against brute force on small inputs, and on nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortica.llm import common, decontam, fingerprint, html_extract, jaccard, licenses, mixing, quality, sharding, token_counts, token_output

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = ("size", "key", "words", "shard", "slot", "position", "score", "shingles", "root", "part", "_bucket")
WORDS = [f"w{k}" for k in range(300)]


def odd_docs(spark, n=60, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 8, 40]))), "en", f"s{i % 3}", 1) for i in range(n)]
    rows += [(None, "no id", None, None, None), (n, None, None, "s0", None), (n + 1, "", "en", None, 0), (5, rows[5][1], "en", "s2", 1), (5, "other text", "en", "s2", 1), (n + 2, "x " * 30_000, "en", "s1", 1)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(spark):
    rows, df = odd_docs(spark, 200)
    got = sharding.shard(clashing(df), 8).collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by_shard.values())
    text = {(i, zlib.crc32((t or "").encode())): (t or "") for i, t, *_ in rows}
    place = collections.defaultdict(set)
    for r in got:
        t = text[(r.doc_id, r.text_crc32)]
        assert r.size == len(t.encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        place[t].add(r.shard)
    assert all(len(s) == 1 for s in place.values())
    small = [sum(x.size for x in v if x.size < 10_000) for v in by_shard.values()]
    assert sum(small) == sum(x.size for x in got if x.size < 10_000)
    assert sharding.shard(none(spark)).count() == 0
    sizes = np.bincount(sharding.pack(np.random.default_rng(0).integers(1, 100, (2000, 3)).astype(float), 8), minlength=8)
    assert sizes.max() - sizes.min() < 60


def test_packing_balances_every_dimension():
    v = np.random.default_rng(1).lognormal(3, 1, (5000, 3))
    at = sharding.pack(v, 8)
    sums = np.array([v[at == s].sum(axis=0) for s in range(8)])
    assert (sums.max(axis=0) / sums.min(axis=0) < 1.02).all()


def test_bytes_are_even_beside_many_short_copies(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS, k=rng.choice([3, 20, 60]))) for _ in range(900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *[""] * 500, *["a"] * 300, *[None] * 100])], "doc_id long, text string").repartition(5)
    got = sharding.shard(df, 8).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 1800 and len(sizes) == 8 and max(sizes.values()) < 1.01 * min(sizes.values())
    assert len({r.shard for r in got if r.size == 1}) == 1
    heavy = sharding.pack(np.array([[1000.0, 1, 1], *[[1, 1, 1]] * 70, *[[0, 0, 90]] * 3]), 8)  # one group over a fair share
    assert np.bincount(heavy, weights=[1000, *[1] * 70, *[0] * 3], minlength=8).tolist() == [1000, *[10] * 7]


# -- html ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><a href=/>Home</a> Big banner</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav><div id=cookieNotice>We use cookies</div>
<div class="wrap main-content"><article><h1>Title &amp; more</h1><p>First   line<br>of it &eacute;<p>Second <b>bold <i>text</b> end.<ul><li>item one<li>item two</ul>
<div class=ad>Buy now</div><form><input value=x>Sign up</form><aside>Side</aside><!-- hidden > --></article></div>
<div class="sidebar">Related <a href=x>link</a></div><section id="comments"><article class=comment><p>A reader says a lot about this, much longer than the text itself, on and on and on.</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_extract.extract(PAGE) == "Title & more\n\nFirst line of it é\n\nSecond bold text end.\n\nitem one\n\nitem two"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract("<body><article><p>cut off here &am") == "cut off here &am"
    assert html_extract.extract("<body><article><p>text</p><p clas") == "text"
    assert html_extract.extract("<body><article>" + "<div>" * 5000 + "deep") == "deep"
    no_article = "<body><div><a href=1>a</a><a href=2>b</a><a href=3>c</a></div><div><p>%s</p><p>%s</p></div></body>" % ("long text " * 30, "more text " * 30)
    assert html_extract.extract(no_article).startswith("long text") and " a " not in html_extract.extract(no_article)
    inner = '<h2 class="section-header">Head</h2><p class="related">related words</p><div class="search-results"><p>results</p></div><div class="share"><a href=1>share it</a></div>'
    inner += '<div class="ad">buy</div><div id="notice">take note</div><div class="comments"><p>me too</p></div><header class="entry-header"><h1>Title</h1></header>'
    assert html_extract.extract(f"<body><article>{inner}<p>text of it</p></article></body>") == "Head\n\nrelated words\n\nresults\n\nTitle\n\ntext of it"
    teaser = '<article><a href="1">a teaser</a></article>'
    assert html_extract.extract(f"<body>{teaser}<div><p>{'long text ' * 40}</p><p>{'more text ' * 40}</p></div></body>").startswith("long text")
    assert html_extract.extract("<body><article>" + "<p>word</p>" * 30_000 + "</article>").count("word") == 30_000
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    got = html_extract.main_text(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(r.text == "" for r in got) == 2
    assert html_extract.main_text(pages.limit(0)).count() == 0


def density_text(node, body):
    """Composite text density by its definition, on nested (tag, children) with strings as text."""
    import math

    def measure(x, link):
        if isinstance(x, str):
            n = len("".join(x.split()))
            return n, n if link else 0, 0, 0
        c = lc = t = lt = 0
        for y in x[1]:
            a, b, d, e = measure(y, link or x[0] == "a")
            c, lc, t, lt = c + a, lc + b, t + d + (not isinstance(y, str)), lt + e + (not isinstance(y, str) and y[0] == "a")
        return c, lc, t, lt

    whole = measure(body, False)

    def density(x):
        c, lc, t, lt = measure(x, False)
        if not c:
            return 0.0
        if not whole[1]:
            return c / max(1, t)
        base = math.log(c / max(1, c - lc) * lc + whole[1] / whole[0] * c + math.e)
        return c / max(1, t) * math.log(max(1 + 1e-9, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    kids = lambda x: [y for y in x[1] if not isinstance(y, str)]
    total = lambda x: sum(map(density, kids(x)))
    every = lambda x: [x] + [z for y in kids(x) for z in every(y)]
    top = max(every(body), key=total)
    path = []

    def find(x, way):
        if x is top:
            path.extend([*way, x])
        for y in kids(x):
            find(y, [*way, x])

    find(body, [])
    least, out = min(map(density, path)), []

    def walk(x):
        if density(x) >= least > 0:
            out.append(max(every(x), key=total))
        for y in kids(x):
            walk(y)

    walk(body)
    text = lambda x: x if isinstance(x, str) else " ".join(map(text, x[1]))
    return {w for x in out for w in text(x).split()}


def test_html_by_definition():
    rng = random.Random(4)
    serial = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(serial, x[1]))}</{x[0]}>"
    number = [0]

    def words(n):
        number[0] += n
        return " ".join(f"t{number[0]}x{k}" for k in range(n)) + " "

    for _ in range(40):
        block = lambda: ("div", [("p", [words(rng.randint(1, 40)), *([("a", [words(rng.randint(1, 4))])] * rng.randint(0, 2))]) for _ in range(rng.randint(1, 4))])
        menu = ("div", [("a", [words(1)]) for _ in range(8)])
        body = ("body", [menu, ("div", [block() for _ in range(rng.randint(1, 3))]), block()])
        assert set(html_extract.extract(serial(body)).split()) == density_text(body, body)


def test_html_names_made_of_several_words():
    text = "Long main text of the article about rivers and hills. " * 6
    for page in (
        '<article class="post comments-open"><p>{}</p></article>', '<div class="page has-comments"><article><p>{}</p></article></div>',
        '<div id="no-comments"><p>{}</p></div>', '<article><p>{}</p><div class="ad-banner">Buy</div><div id="cookieNotice">We use</div><p class="advert_box2">Buy</p></article>',
        '<div id=posts><article><p>{}</p></article></div><article class="comment-body"><p>Reader</p></article><div class="comments comments-open">Reader</div>',
    ):
        assert html_extract.extract(f"<html><body>{page.format(text)}</body></html>") == text.strip()
    own = '<article><p>{}</p><section id="discussion"><p>We found it.</p></section><div class="notice-of-award"><p>Won.</p></div></article>'
    assert html_extract.extract(own.format(text)) == f"{text.strip()}\n\nWe found it.\n\nWon."


# -- licences ------------------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_licences(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. More cc-by text"), (2, "x\nThis work is LICENSED under the GNU General Public License, version 3."), (3, None), (4, ""), (5, "All rights reserved. all RIGHTS reserved"),
        (6, "the license of the version 2 0 apache"), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (None, "rights All reserved"), (8, "Éte cc by"), (9, "permission is hereby granted free of charge to some person obtaining a copy of this software"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in licenses.scan(clashing(df)).collect():
        got[r.doc_id].append(r)
    for i, text in rows:
        w, places, labels = words_of(text), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = next(x for x in got[i] if x.n_words == len(w))
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[1][0].labels == "cc-by,cc-by-nc-4.0" and got[1][0].score == 1.0 and got[2][0].labels == "gpl,gpl-3.0" and got[5][0].labels == "all-rights-reserved,reserved"
    assert got[6][0].labels == "" and got[6][0].score == 0.0 and len(got[7]) == 2 and got[7][0].labels == "mit" and got[9][0].labels == "mit" and 0.7 <= got[9][0].score < 1
    assert licenses.scan(none(spark)).count() == 0


# -- Jaccard -------------------------------------------------------------------------------------------------------------


def components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num:
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = i if least[find(k)] is None else min(i, least[find(k)])
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    base = [rng.choices(WORDS, k=rng.choice([5, 12, 25, 40, 60, 120])) for _ in range(8)]
    for b in base:
        for _ in range(20):
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p = rng.randrange(len(w))
                w[p : p + rng.choice([0, 1])] = rng.choice([[], [rng.choice(WORDS)]])
                w = w or ["x"]
            texts.append(" ".join(w + base[0][:20] * (rng.random() < 0.2)))
    texts += [None, "", "   ", "one", "One", "two words", "two words", "a b c", "A b C\n"]
    rng.shuffle(texts)
    return [(k if k % 50 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("n", "num", "den", "chunk"), [(3, 9, 10, 256), (5, 8, 10, 4)])
def test_jaccard(spark, monkeypatch, n, num, den, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)  # small chunks take the way across groups
    rows = near_copies(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(clashing(df), n, num, den, bits=18).collect()), key=str)
    assert got == components(rows, n, num, den)


def test_jaccard_of_few_words_alone(spark):
    for n in (3, 5):
        for k in range(1, 8):
            words = "one two three four five six seven".split()[:k]
            alone = jaccard.shingle_sets([" ".join(words)], n)[0]
            assert len(alone) == max(1, k - n + 1) and np.array_equal(alone, jaccard.shingle_sets([" ".join(words), "long " * 20], n)[0])
    df = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.join(df, n=5, bits=18).collect()] == [(1, 1, 1)]


def test_jaccard_keeps_one(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "q r s t u v w"), (None, "a b c d e f g"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(df, bits=18).collect()) == ["1", "2", "9", "None"]
    assert jaccard.join(none(spark), bits=18).count() == 0


def test_jaccard_keeps_one_row_by_row(spark):
    a, b, c = "a b c d e f g", "q r s t u v w", "h i j k l m n"
    rows = [(1, a), (3, a), (3, b), (3, None), (4, c), (4, c), (4, c), (5, c), (6, ""), (6, ""), (None, a), (None, c)]
    df = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, size string").repartition(4)
    kept = jaccard.keep_one(df, bits=18)
    assert kept.columns == df.columns
    want = [(1, a), (3, b), (3, None), (4, c), (6, ""), (6, ""), (None, a), (None, c)]
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_jaccard_deals_out_the_texts_of_copies_only(spark, tmp_path, monkeypatch):
    """Kept rows are not shuffled however large the list of dropped ones is; only tables the result reads stay on disk."""
    monkeypatch.setattr(common, "workspace", lambda _: f"file://{tmp_path}")
    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(400)]
    rows = [*enumerate(texts), *((1000 + k, texts[k]) for k in range(5)), (1000, texts[0]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(df, bits=18)
        left = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
        assert sorted(kept.select("doc_id", "text").collect()) == sorted(enumerate(texts))
        kept.collect()
        dealt = sum(shuffled(kept._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == {"jaccard-fate", "jaccard-met"}
    assert 0 < dealt < 100  # 8 ids in the map and the rows that share a bit with one, against the list


def shuffled(plan):
    """Rows written by each exchange of an executed plan of texts; ``repartition`` of the input apart."""
    kind = plan.getClass().getSimpleName()
    if kind == "ShuffleExchangeExec":
        if "RoundRobin" in plan.outputPartitioning().toString():
            return
        yield plan.metrics().apply("shuffleRecordsWritten").value()
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(k) for k in range(plan.children().size())]
    for x in below:
        yield from shuffled(x)


# -- tokens --------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    rows, df = odd_docs(spark, 40)
    import public_tokenizers as P

    encode = token_counts._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    sizes = np.array([len(encode(t or "")) for _, t, *_ in rows])
    hist = token_counts.histogram(token_counts.lengths(clashing(df)))
    sums = token_counts.suffix_sums(hist).collect()
    assert {r.n_tokens for r in sums} == set(sizes)
    for r in sums:
        n = r.n_tokens
        assert (r.n_docs, r.docs_over, r.tokens_over, r.tokens_total) == ((sizes == n).sum(), (sizes > n).sum(), sizes[sizes > n].sum(), sizes.sum())
        assert r.truncated_total == np.minimum(sizes, n).sum() and abs(r.quantile - (sizes <= n).mean()) < 1e-12
    for r in token_counts.at_limits(hist, [0, 7, 100, 10**6]).collect():
        assert (r.docs, r.docs_over, r.truncated_total) == (len(sizes), (sizes > r.context_limit).sum(), np.minimum(sizes, r.context_limit).sum())
    got = {r.share: r.n_tokens for r in token_counts.quantiles(token_counts.suffix_sums(hist), [0.5, 1.0]).collect()}
    assert got[1.0] == sizes.max() and (sizes <= got[0.5]).mean() >= 0.5 > (sizes < got[0.5]).mean()
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(none(spark)))).count() == 0


def test_token_files(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows, df = odd_docs(spark, 40)
    rows += [(500, "a <|endoftext|> b é日本語\r\n  x")]
    df = df.union(spark.createDataFrame([(500, rows[-1][1], None, None, None)], DOCS))
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.round_trip(clashing(df), parts=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_output.round_trip(none(spark)).count() == 0
    folder = f"{common.workspace(spark)}/token-ids-test"
    token_output.write(df, folder, parts=2)
    read = {(r.doc_id, r.start): r.ids for r in token_output.read_ids(spark, folder).collect()}
    assert len(read) == len(want) and all(zlib.crc32(np.array(read[i, at], "<u4").tobytes()) == crc for i, at, _, crc in want)


@pytest.mark.parametrize("n", [0, 1, 40, 32767, 32768, 32769, 100_000])
def test_range_coder(spark, n):
    rng = np.random.default_rng(n)
    table = b"".join(np.array([(k == 0, -7 * k, c)], np.dtype([("n", "u1"), ("d", "<i8"), ("c", "<u4")])).tobytes() for k, c in enumerate([n // 3, 0, n - n // 3]))
    kinds = [rng.integers(0, 65536, n), np.zeros(n, int), rng.integers(0, 4, n), rng.zipf(1.3, n) % 50257, np.arange(n) % 65536, np.tile(rng.integers(0, 65536, 50), n // 50 + 1)[:n]]
    rows = [(k, bytearray(table), bytearray(ids.astype("<u2").tobytes())) for k, ids in enumerate(kinds)]
    df = spark.createDataFrame(rows, "k int, documents binary, ids binary").withColumn("blob", token_output._call(spark, "Encode", "documents", "ids")).cache()
    back = df.select("k", "blob", token_output._call(spark, "Decode", "blob").alias("raw"), token_output._call(spark, "Digest", "blob").alias("x")).collect()
    for r in back:
        ids = kinds[r.k]
        assert bytes(r.raw) == table + ids.astype("<u2").tobytes()
        parts = [ids[: n // 3], ids[:0], ids[n // 3 :]]
        assert r.x == [v for k, (p, before) in enumerate(zip(parts, [0, n // 3, n // 3], strict=True)) for v in (int(k == 0), -7 * k, before, len(p), zlib.crc32(p.astype("<u4").tobytes()))]
    if n > 30_000:
        sizes = {r.k: len(r.blob) for r in back}
        assert sizes[1] < n / 50 and sizes[2] < n / 3 and sizes[3] < 1.6 * n and sizes[5] < n / 10 and sizes[0] < 2.4 * n
        blob = bytes(back[0].blob)
        for at in (len(blob) - 40, 20):
            broken = bytearray(blob)
            broken[at] ^= 255
            with pytest.raises(Exception, match="damaged"):
                spark.createDataFrame([(broken,)], "blob binary").select(token_output._call(spark, "Decode", "blob")).collect()


def test_blocks_can_be_read_alone(spark):
    ids = np.random.default_rng(1).zipf(1.3, 70_000) % 50257
    one = lambda x: bytearray(np.array([(0, 1, len(x))], np.dtype([("n", "u1"), ("d", "<i8"), ("c", "<u4")])).tobytes())
    parts = [ids[:32768], ids[32768:65536], ids[65536:]]
    rows = [(one(x), bytearray(x.astype("<u2").tobytes())) for x in (ids, *parts)]
    whole, *alone = [bytes(r.b) for r in spark.createDataFrame(rows, "documents binary, ids binary").coalesce(1).select(token_output._call(spark, "Encode", "documents", "ids").alias("b")).collect()]
    assert whole[16 + 13 + 36 :] == b"".join(x[16 + 13 + 12 :] for x in alone)  # a block's bytes depend on its own ids only


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'.,é日\u00a0\u2003\x1c\x85 \t\n\r")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_encoder_equals_the_library(text):
    import public_tokenizers as P

    encoder = token_output._encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text) == np.array(want, "<u2").tobytes()


def test_encoder_takes_a_batch_at_once(monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa

    encoder, rng = token_output.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN), random.Random(4)
    cuts, whole = [], encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda text: (cuts.append(text), whole(text))[1])
    encoder.ids(" ".join("".join(rng.choices("abcdeéß", k=9)) + rng.choice(("", ",", ".\nEn", "7")) for _ in range(2000)))
    assert len(cuts) == 1  # the pattern sees the first unit only, not each of 2000
    parts = ["a", "é", "ɐ", "×", "²", "1", "'s", ".", "-", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "中", "😀", "\u0301", "<|endoftext|>", "\x01", "\x00", " the"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(5000)]
    array = pa.array(["cut off", *texts], pa.string()).slice(1)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoder.many(array).to_pylist() == want and len(encoder.many(array.slice(0, 0))) == 0


# -- fingerprints --------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rows, df = odd_docs(spark, 40)
    got = fingerprint.fingerprints(clashing(df), parts=4).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t, *_ in rows))
    want = []
    for k, (i, t) in enumerate(order):
        new = fingerprint.edited(t, order[(k + 1) % len(order)][1])
        want.append((None if i < 0 else i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.Fingerprint.of(t).hex(), fingerprint.Fingerprint.of(new).hex()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprints(none(spark)).count() == 0
    single = fingerprint.fingerprints(spark.createDataFrame([(7, "ab")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_fingerprint_is_a_homomorphism():
    a, b = ["one", "two", "two"], ["three", "four"]
    f = fingerprint.Fingerprint
    assert f().add(a + b).hex() == f().add(b[::-1]).add(a[::-1]).hex() == f.parse(f().add(a).hex()).add(b).hex()
    assert f().add(a + b).remove(a).hex() == f().add(b).hex() != f().add(["three"]).hex()
    near = lambda x, y: float(fingerprint.likeness(*[v[None] for g in (f().add(x), f().add(y)) for v in (g.wide, g.signs)])[0])
    long = [f"p{i}" for i in range(100)]
    assert near(a, a) == 1.0 and near(long, long[:-2] + ["x", "y"]) > 0.8 > near(long, long[:50] + [f"q{i}" for i in range(50)]) > 0.1 and near(long, [f"q{i}" for i in range(100)]) < 0.15


# -- mixing --------------------------------------------------------------------------------------------------------------


def test_targets():
    sizes, weights = [100, 100, 5, 0], [1, 2, 3, 1]
    got = mixing.targets(sizes, weights)
    assert got[2:] == [15.0, 0.0] and abs(sum(got) - 205) < 1e-9 and abs(got[1] / got[0] - 2) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0.0, 0.0]


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 30))), "en", None if i % 7 == 0 else f"s{i % 4}", 0) for i in range(800)]
    rows += [(801, None, None, "s1", None), (None, "a b", None, None, None), (5, rows[5][1], "en", "s1", 1), (5, rows[5][1], "en", "s1", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.place(df).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and len(r.positions) <= 3 and all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        size[r.source] += r.size
        taken[r.source] += r.size * len(r.positions)
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [round(target[s], 6) for s in names] == [round(x, 6) for x in mixing.targets([size[s] for s in names], [1 + k % 3 for k in range(len(names))])]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 30 for s in names)
    again = mixing.place(df.repartition(3)).collect()
    flat = lambda rs: sorted((str(r.doc_id), str(r.text), r.positions) for r in rs)
    assert flat(got) == flat(again)
    mixed = mixing.mix(df, partitions=3)
    at = [r.position for r in mixed.collect()]
    assert at == sorted(at) and len(at) == sum(len(r.positions) for r in got)
    clash = mixing.mix(df.withColumns({"size": F.lit("c"), "position": F.lit("c"), "words": F.lit("kept")}))
    assert set(clash.columns) == {*df.columns, "words", "position"}
    assert mixing.mix(none(spark)).count() == 0


# -- quality -------------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = " ".join(rng.choices(WORDS, k=60)) + "." if good else " ".join(w + "###" for w in rng.choices(WORDS, k=60))
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(None, "text"), (900, None), (901, ""), (3, rows[3][1])]
    labels += [(5, 0), (5, 1), (None, 1), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs.withColumn("score", F.lit("clash")), known).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:400])
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.score for r in quality.classify(docs.limit(3), known.limit(0)).collect()} == {0.5}
    # Labels of held-out rows, and columns other than the text, teach nothing; neither does the order of the rows.
    flipped = known.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda rs: sorted((str(r.doc_id), round(r.score, 9)) for r in rs)
    repeated = docs.union(spark.createDataFrame([(7, "other text of a learned row")], docs.schema))
    assert scores(got) == scores(quality.classify(docs.withColumn("source", F.lit("x")), flipped).collect())
    assert scores(quality.classify(repeated, known).collect()) == scores(quality.classify(repeated.orderBy(F.desc("text")).repartition(7), known).collect())
    assert quality.classify(docs.limit(0), known).count() == 0


# -- decontamination -----------------------------------------------------------------------------------------------------


def multiset(words, n):
    n = min(n, len(words))
    return collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if words else collections.Counter()


def best_windows(docs, items):
    out = {}
    for i, text in docs:
        w = words_of(text)
        for item, t in items:
            q = words_of(t)
            if not q or not w:
                continue
            want = multiset(q, 5)
            n = min(5, len(q))
            for s in range(max(1, len(w) - len(q) + 1)):
                part = w[s : s + len(q)]
                have = collections.Counter(tuple(part[k : k + n]) for k in range(len(part) - n + 1))
                same, all_ = sum((have & want).values()), sum((have | want).values())
                if all_ and 5 * same >= 4 * all_:
                    out[(i, item)] = max(out.get((i, item), 0), same / all_)
    return out


@pytest.mark.parametrize("most", [100_000, 1])
def test_decontamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontam, "MOST_LITERALS", most)
    rng = random.Random(9)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate([40, 40, 20, 12, 6, 5, 3, 1])] + [(90, None), (91, "..."), (0, "zz " * 12)]
    filler = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    docs = []
    for k in range(60):
        item = items[k % 8][1].split()
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            item[rng.randrange(len(item))] = "edited"
        docs.append((k, f"{filler(rng.randint(0, 50))} {', '.join(item).upper()} {filler(rng.randint(0, 50))}"))
    docs += [(100, items[0][1][: len(items[0][1]) // 2]), (101, None), (102, ""), (103, filler(80)), (None, items[1][1]), (7, docs[7][1]), (104, "zz " * 50)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = best_windows(docs, items)
    got = collections.defaultdict(float)
    for r in decontam.leaks(clashing(df), bench).collect():
        assert 0 <= r.hamming <= 64
        got[(r.doc_id, r.item_id)] = max(got[(r.doc_id, r.item_id)], r.similarity)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    kept = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0


def inserted_and_edged(words, k, e):
    """``words`` with the outer ``e`` on each side replaced and ``k`` put in between, or taken out where k < 0."""
    half = len(words) // 2
    middle = words[e:half] + [f"new{j}" for j in range(k)] + words[half - min(k, 0) : len(words) - e]
    return " ".join([f"left{j}" for j in range(e)] + middle + [f"right{j}" for j in range(e)])


def test_decontamination_of_passages_edited_inside_and_at_both_ends(spark):
    docs, items = [], []
    for size, k, e in [(58, 2, 1), (100, 6, 3), (150, 10, 5), (300, 20, 10), (58, -2, 1), (100, -6, 3)]:
        words = [f"q{size}x{k + 50}x{j}" for j in range(size)]
        items.append((len(items), " ".join(words)))
        docs.append((len(docs), f"{'before ' * 30}{inserted_and_edged(words, k, e)}{' after' * 30}"))
        docs.append((len(docs), inserted_and_edged(words, k, e)))
        docs.append((len(docs), f"{'before ' * 9}{' '.join(words[size // 2 :] + words[: size // 2])}{' after' * 9}"))  # swapped parts
        docs.append((len(docs), f"{words[5]} {' '.join(words[7:15])} {'far ' * 400}{inserted_and_edged(words, k, e)} {'far ' * 400}{' '.join(words[-20:])}"))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = best_windows(docs, items)
    assert len(want) >= 12
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.leaks(df, bench).collect()} == {k: round(v, 9) for k, v in want.items()}


def test_decontamination_loses_no_short_borderline_passage(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_LITERALS", 1)
    items = [[f"i{k}w{j}" for j in range(9)] for k in range(2000)]
    df = spark.createDataFrame([(k, " ".join(w[:8])) for k, w in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = decontam.leaks(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in got) == [(k, k, 0.8) for k in range(2000)]


def test_clean_decides_row_by_row(spark):
    item = "a b c d e f g h"
    rows = [(None, f"x {item} y"), (None, "nothing here at all"), (None, None), (7, item), (7, "another text of this id"), (8, item), (8, item), (9, "last")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = sorted(str((r.doc_id, r.text)) for r in decontam.clean(df, bench).collect())
    assert kept == sorted(str(r) for r in rows if item not in (r[1] or ""))


# -- common --------------------------------------------------------------------------------------------------------------


def test_words(spark):
    texts = [None, "", "  ", "a", " A b\tc\x0bd\x1ce\n", "é É x" ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, w, n in df.select("t", common.plain_words(F.col("t")), common.count_space_words(F.col("t"))).collect():
        assert n == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert w == words_of(t)


def test_join_of_hot_keys(spark):
    left = [(k, "hot" if k % 3 else f"k{k % 11}" if k % 2 else None) for k in range(300)]
    right = [("hot", 7, 200), ("k1", 1, 10), ("k3", 3, 10), ("k5", None, 1), ("unused", 9, 1)]
    got = common.join_hot(spark.createDataFrame(left, "id int, key string"), spark.createDataFrame(right, "key string, value int, n int"), "key", "n", 10).collect()
    want = {k: v for k, v, _ in right}
    assert sorted((r.id, str(r.key), str(r.value)) for r in got) == sorted((i, str(k), str(want.get(k))) for i, k in left)


@pytest.mark.parametrize("few", [200_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(str(rng.randrange(60)).encode(), str(rng.randrange(60)).encode()) for _ in range(45)] + [(b"x%02d" % i, b"x%02d" % (i + 1)) for i in range(20)]
    got = {bytes(r.node): bytes(r.root) for r in jaccard.connected(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
