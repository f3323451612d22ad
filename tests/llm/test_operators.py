"""Contracts, edge rows and brute-force versions of the corpus operators."""

import hashlib
import html
import itertools
import random
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_rows import LONG, ODD, SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartwheel.llm import (components, decontaminate, exact_dedup, html_extract, jaccard_join, langid, mixing, pii, queries, shingles, suffix_dedup, token_count,
                           url_filter)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 URL rules

URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.net/en/x", "https://a.b.example.net/en/1?q#f", "https://example.net/EN/", "http://badexample.net/en/",
        "http://x.org/fr/a", "http://x.org/fr", "http://net/", "http://net", "http://y.com/x.net/", "http://example.com/de/?net/", "http://a.example.com/de/1",
        "http://x.org#://y.net/", "ftp://u@h.net:80/", "http://É.net/", "http://h\x00.net/", "http://a.net" + "/p" * 5000]


def judged_slowly(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host):]).group(0)
    host = host.translate(LOWER)
    best = None
    for line in queries.URL_RULES:
        verdict, rule = line.split()
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else "allow"


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.parse_rules(queries.URL_RULES)).collect()}
    assert got == {k: judged_slowly(u) for k, u in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), url_filter.parse_rules(queries.URL_RULES)).count() == 0


def test_url_judging_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "k", "h", "r")], "page_id long, url string, __k string, __host string, Rule string")
    got = url_filter.judge_urls(pages, url_filter.parse_rules(queries.URL_RULES))
    assert got.columns == ["page_id", "url", "__k", "__host", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, "http://a.net/x", "k", "h", "a.net", "/x", "net/", "block")


def test_automaton_takes_many_words_and_wildcards():
    rules = [url_filter.Rule("block", f"h{k}.example/{'x' * (k % 90)}") for k in range(200)] + [url_filter.Rule("allow", "w*.z?/a*c/")]
    machine = url_filter.Automaton(rules)
    assert machine.words > 60
    got = machine.match([b".sub.h150.example\0/" + b"x" * 70, b".h15.example\0/x", b".www.zq\0/abbc/d", b".www.z\0/abbc/d", b""])
    assert [np.flatnonzero(g).tolist() for g in got] == [[150], [], [200], [], []]


# ---- 2 repeated strings

def cut_slowly(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                mark[k:k + length] = True
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), int(mark.sum()), int((np.diff(np.concatenate([[0], mark.astype(int)])) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeated_strings_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAD", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 400, "x" * 199, "y" * 200, "y" * 201, passages[0], passages[0][:-1], "z\0" * 150]
    for _ in range(40):
        t = " ".join(word() for _ in range(rng.randrange(60)))
        texts.append(t + rng.choice(passages)[rng.randrange(40):] + t[: rng.randrange(1, 300)] + "".join(rng.choice(passages)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, length=200).collect()}
    assert [got[k] for k in range(len(texts))] == cut_slowly(texts, 200)


def test_repeated_strings_of_whole_documents_and_empty_table(spark, odd, empty):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix_dedup.remove_repeats(odd, with_text=True).collect()}
    assert len(got) == len(set((i, len((t or "").encode())) for i, t, _, _ in ODD))
    assert got[8, len(LONG)] == len(LONG) and got[9, len(LONG) + 4] == len(LONG) and got[1, 0] == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_multikey_sort_orders_like_bytes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"\0ab") for _ in range(rng.randrange(20))) for _ in range(300)]
    symbols, words = suffix_dedup._symbols(strings, 20)
    order = suffix_dedup.multikey_sort(words, np.zeros(300, np.int64))
    assert [strings[k] for k in order] == sorted(strings)
    common = suffix_dedup._common(symbols, order)
    for a, b, n in zip(order, order[1:], common[1:]):
        x, y = strings[a], strings[b]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


# ---- 3 token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, clashing, tmp_path, name):
    import public_tokenizers

    path = str(public_tokenizers.path(name))
    extra = ["<|endoftext|>", "a <|endoftext|> b", "x  <|endoftext|>\n\n y", "it's  don't,'ll .5 3.14, a'.s", "   x y ", "a\r\n\r\nb\t\tc ", "₂²½ x,y.z"]
    df = clashing.select("doc_id", "text", "n_tokens", "lang_pred").unionByName(
        spark.createDataFrame([(100 + k, t, "m", "m") for k, t in enumerate(extra)], "doc_id long, text string, n_tokens string, lang_pred string"))
    cache = f"file://{tmp_path}/cache"
    got = rows(token_count.count_tokens(df, path, cache).select("text", "n_bytes", "n_tokens", "over_limit", "lang_pred"))
    if name.endswith(".model"):
        library = token_count.ModelCounter(path).processor
        count = lambda t: len(library.encode(t))
    else:
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False))
    assert len(got) == df.count()
    for text, n_bytes, n, over, _ in got:
        assert (n_bytes, n, over) == (len((text or "").encode()), count(text or ""), count(text or "") > 512)


def test_token_cache_encodes_only_misses(spark, odd, empty, tmp_path, monkeypatch):
    import public_tokenizers

    path, cache = str(public_tokenizers.path("byte_bpe_50k.json")), f"file://{tmp_path}/cache"
    first = sorted(rows(token_count.count_tokens(odd, path, cache).select("n_bytes", "n_tokens")))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("text_digest").distinct().count() == len({t or "" for _, t, _, _ in ODD})
    assert sorted(rows(token_count.count_tokens(odd, path, cache).select("n_bytes", "n_tokens"))) == first
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was appended
    assert token_count.count_tokens(empty, path, cache).count() == 0


# ---- 4 Jaccard join

def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components_slowly(docs, width, percent):
    sets = {i: shingle_set(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sorted(sets.items()), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def edited_documents(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 120))] for _ in range(8)]
    line = [rng.choice(vocabulary) for _ in range(25)]
    docs = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "one two three four"), (5, "...")]
    for k in range(6, n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 3, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary) + rng.choice(("", "x"))
        docs.append((k, " ".join(words + line * (rng.random() < 0.3))))
    return docs


@pytest.mark.parametrize(("width", "percent", "small", "frequent"), [(4, 85, 2048, 4), (5, 80, 2, 2)])
def test_jaccard_components_equal_brute_force(spark, width, percent, small, frequent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small)  # small limits send regions through cells and blocks
    monkeypatch.setattr(jaccard_join, "LOCAL_FREQUENT", frequent)
    docs = edited_documents(width * percent)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("mine"))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.link_components(df, width=width, percent=percent).collect()}
    assert got == components_slowly(docs, width, percent)


def test_jaccard_odd_rows(odd, empty):
    got = jaccard_join.link_components(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[5] == {(1, 4)} and by[None] == {(1, None)} and {c for _, c in by[9]} == {8}
    assert jaccard_join.link_components(empty).count() == 0


def test_shingles_are_the_same_in_any_chunk(monkeypatch):
    texts = [(t or "").encode() for _, t, _, _ in ODD[:8]]
    alone = [shingles.sets([t], 4)[0].tolist() for t in texts]
    assert [s.tolist() for s in shingles.sets(texts, 4)] == alone
    assert [len(s) for s in alone] == [len(shingle_set(t.decode(), 4)) for t in texts]


def test_components_of_long_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(5, 5)]
    got = dict(rows(components.components(spark.createDataFrame(pairs, "a long, b long"))))
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(7, 40)} == {7} and 5 not in got


# ---- 5 languages

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    scored = langid.predict(docs, model).filter(langid.held_out() & F.col("lang").isNotNull())
    right = scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_language_odd_rows_and_backoff(clashing, empty, documents):
    model = langid.fit(documents)
    got = langid.predict(clashing, model)
    assert got.columns.count("score") == 1 and got.count() == len(ODD)
    kinds = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert kinds[1] == kinds[2] == kinds[3] == ("und", 0.0)
    assert langid.keep_known(clashing, model).columns == clashing.columns
    assert langid.predict(clashing, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0
    scorer = langid.Scorer(model)
    assert scorer.predict("½ 12 _ ²")[0] == "und"
    assert scorer.predict("unglichkeitschung zuverheit")[0] == "de"  # unseen words, known n-grams
    assert "unglichkeitschung" not in model.words


def test_documents_in_unknown_scripts_go_and_the_given_stay(spark, documents):
    foreign = ["Это предложение написано по-русски.", "这是一个中文句子。", "यह एक वाक्य है", "Αυτό είναι ελληνικό κείμενο, Microsoft", "هذه جملة عربية"]
    docs = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(foreign)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))
    kept = {r["doc_id"] for r in langid.keep_known(docs, langid.fit(documents)).collect()}
    assert kept == {r["doc_id"] for r in documents.collect() if langid.words(r["text"] or "")}


def test_rare_languages_are_learned_at_every_size(spark):
    rows_ = [(k, f"the quick brown fox and the lazy dog {k}", "en") for k in range(3000)] + [(3000 + k, "szybki brązowy lis skacze nad leniwym psem", "pl") for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), train_rows=40)
    assert model.langs == ["en", "pl"]
    scorer = langid.Scorer(model)
    assert scorer.predict("leniwym lisem")[0] == "pl" and scorer.predict("the dog")[0] == "en"


def test_fitting_takes_the_driver_little_memory(spark):
    texts = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.expr(
        "array_join(transform(sequence(0, 199), k -> translate(substr(sha2(cast((id div 2) % 25 * 200 + k as string), 256), 1, 12), '0123456789', 'ghijklmnop')), ' ')").alias("text"))
    tracemalloc.start()
    try:
        model = langid.fit(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    entries = len(model.words) + len(model.grams)
    assert entries > 10_000 and peak < 300 * entries


def test_fold_is_crc32(spark):
    import zlib
    got = rows(spark.range(50).select("id", langid.held_out("id")))
    assert got == [(k, zlib.crc32(str(k).encode()) % 3 == 1) for k in range(50)]


# ---- 6 exact copies

@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 400))
def test_fingerprints_compose(data, cut):
    f = exact_dedup.Fingerprint(chunk=64)
    assert f.combine(f.of(data[:cut]), f.of(data[cut:])) == f.of(data) == exact_dedup.Fingerprint(chunk=7).of(data)


def test_fingerprint_of_a_huge_text_takes_little_memory():
    data = bytes(range(256)) * (1 << 18) + b"end"
    f = exact_dedup.Fingerprint()
    tracemalloc.start()
    whole = f.of(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert whole == f.combine(f.of(data[:12_345_678]), f.of(data[12_345_678:]))


@pytest.mark.parametrize("primes", [exact_dedup.PRIMES, (3,)])
def test_copies_equal_brute_force_even_when_fingerprints_collide(spark, odd, primes):
    more = [(100 + k, t, "en", "a") for k, t in enumerate(["aaab", "aaba", "abaa", "baaa", "abab", "baba", "aaab", "x" * 70_000, "x" * 69_999 + "y", "x" * 70_000])]
    df = odd.drop("n_chars").unionAll(spark.createDataFrame(more, odd.drop("n_chars").schema))
    data = [(i, t) for i, t, *_ in [*ODD, *more]]
    want = []
    for i, t in data:
        same = [j for j, u in data if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(rows(exact_dedup.group_copies(df, primes=primes)), key=repr) == sorted(want, key=repr)


def test_drop_copies_leaves_one_row_of_each_text(clashing, empty):
    got = exact_dedup.drop_copies(clashing)
    assert got.columns == clashing.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 2, 3, 5, 7, 8, 9, 10, 11]
    assert exact_dedup.drop_copies(empty).count() == exact_dedup.group_copies(empty).count() == 0
    named = clashing.withColumns({c: F.lit("mine") for c in ("__id", "__sha", "__text_sha")})
    assert exact_dedup.drop_copies(named).columns == named.columns
    assert exact_dedup.drop_copies(named).filter("__id = 'mine' and __text_sha = 'mine'").count() == 9


# ---- 7 mixing

def seats_slowly(claims, seats):
    won = [0] * len(claims)
    for _ in range(seats):
        best = max(range(len(claims)), key=lambda k: (claims[k] / (2 * won[k] + 1), -k))
        won[best] += 1
    return won


def test_sainte_lague_equals_seat_by_seat(spark):
    rng = random.Random(3)
    for claims, seats in [([rng.uniform(0, 100) for _ in range(n)], rng.randrange(1, 400)) for n in (1, 2, 7, 30)] + [([0.0, 5.0], 4), ([53e3, 24e3, 23e3], 7)]:
        df = spark.createDataFrame([(k, c, seats) for k, c in enumerate(claims)], "k int, claim double, seats long")
        got = dict(rows(mixing.sainte_lague(df, [], "claim", "seats").select("k", "quota")))
        assert [got[k] for k in range(len(claims))] == seats_slowly(claims, seats)


def targets_slowly(sizes, weights):
    left, capped = sum(sizes), set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in capped]
        rest = left - sum(3 * sizes[k] for k in capped)
        aim = {k: rest * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = {k for k in open_ if aim[k] > 3 * sizes[k]}
        if not over:
            return [3.0 * sizes[k] if k in capped else aim[k] for k in range(len(sizes))]
        capped |= over


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(9)
    for _ in range(4):
        sizes = [int(rng.paretovariate(0.5) * 10) for _ in range(9)]
        weights = [float(mixing.WEIGHTS[k % 3]) for k in range(9)]
        df = spark.createDataFrame([(f"s{k}", n, w) for k, (n, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight double")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        assert [got[f"s{k}"] for k in range(9)] == pytest.approx(targets_slowly(sizes, weights))


def test_mix_meets_targets_and_reruns_agree(spark, documents):
    got = mixing.mix(documents).collect()
    assert sorted(map(tuple, mixing.mix(documents.repartition(7)).collect())) == sorted(map(tuple, got))
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in {(r["source"], r["target"]) for r in got}:
        assert abs(taken[source] - target) <= 16 * 12


def test_mix_odd_rows(clashing, empty):
    got = mixing.mix(clashing)
    assert got.count() == len(ODD) and mixing.mix(empty).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["size"] == by[2]["size"] == 0 and by[8]["size"] == len(WORD.findall(LONG)) and by[9]["source"] is None


# ---- 8 main text

def cut_by_enumeration(costs, edges):
    best = None
    for label in itertools.product((False, True), repeat=len(costs)):
        total = sum(c if keep else b for (c, b), keep in zip(costs, label)) + sum(w for i, j, w in edges if label[i] != label[j])
        if best is None or (total, -sum(label)) < best[0]:
            best = ((total, -sum(label)), list(label))
    return best[0][0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=9), st.data())
def test_minimum_cut_is_minimal(costs, data):
    n = len(costs)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 40)).filter(lambda e: e[0] != e[1]), max_size=14))
    label = html_extract.min_cut(costs, edges)
    total = sum(c if keep else b for (c, b), keep in zip(costs, label)) + sum(w for i, j, w in edges if label[i] != label[j])
    assert total == cut_by_enumeration(costs, edges)


def test_main_text_of_the_given_pages():
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))
        assert html_extract.main_text(p["html"]) == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in parts) if x)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<script>x</script>", ""), ("<p>Hello.", "Hello."), ("a < b", "a < b"), ("<p>x&nbsp;&amp;&#33;\n\n y</p>", "x &! y"),
    ("<nav>n</nav><main><p>a</p><aside>s</aside><div class='comments'><p>c</p></div><p>b</p><form>f</form></main><footer>z</footer>", "a\nb"),
    ("<div id='cookie-notice'>n</div><article><h1>T</h1><p>a<p>b<ul><li>x<li>y</ul><div class=ad>ad</div></article>", "T\na\nb\nx\ny"),
    ("<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>A plain text without any article around it.</p><p>Short.</p></div>",
     "A plain text without any article around it.\nShort."),
    ("<!-- <p>no --><article><p title='a>b'>yes</p><style>p{}</style><pre>k  l\nm</pre></article>", "yes\nk l m")])
def test_main_text_cases(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(("page", "want"), [
    ("<nav>n</nav><div class='post has-sidebar'><h1>T</h1><p>One.</p><p>Two.</p></div><footer>f</footer>", "T\nOne.\nTwo."),
    ("<nav>n</nav><div class='entry-content no-comments'><p>One.</p></div><div class='comments'><p>c</p></div>", "One."),
    (f"<nav>n</nav><div class='sidebar-layout'><h1>A title</h1><p>{LONG[:400]}</p><p>Short.</p><p>{LONG[:400]}</p></div>", f"A title\n{LONG[:400]}\nShort.\n{LONG[:400]}"),
    (f"<form id=form1><p>{LONG[:400]}</p><p>{LONG[:300]}</p></form>", f"{LONG[:400]}\n{LONG[:300]}"),
    (f"<div><p>{LONG[:400]}</p></div><div class=comments><p>{LONG[:400]}</p></div>", LONG[:400]),
    (f"<article><p>{LONG[:400]}</p></article><div class='comment-body'>{LONG[:400]}</div><nav><p>{LONG[:400]}</p></nav>", LONG[:400])])
def test_class_words_are_weighed_and_decide_nothing_alone(page, want):
    assert html_extract.main_text(page) == "\n".join(x.strip() for x in want.split("\n"))


SHORT = [f"Paragraph {k} of a page in short paragraphs, no more." for k in range(20)]


@pytest.mark.parametrize(("page", "want"), [
    ("<nav>n</nav><div>" + "".join(f"<p>{s}</p><p><a href=x>Read more of part {k}</a></p>" for k, s in enumerate(SHORT)) + "</div>", SHORT),
    ("<div>" + "".join(f"<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{s}</p>" for s in SHORT) + "</div>", SHORT),
    (f"<article><p>{LONG[:900]}</p></article><div class='feedback'><p>{LONG[:400]}</p><p>Short one.</p></div>", [LONG[:900]]),
    (f"<article><p>{LONG[:900]}</p></article><div class='qx-17'><p>{LONG[:400]}</p><p>{LONG[:300]}</p><p>Short.</p></div>", [LONG[:900]]),
    (f"<div class='post'><p>{LONG[:900]}</p></div><section><h3>Said by readers</h3><p>{LONG[:400]}</p></section>", [LONG[:900]]),
    (f"<div><p>{LONG[:900]}</p></div><div class=feedback><p>{LONG[:400]}</p></div>", [LONG[:900]]),
    (f"<div><p>{LONG[:3000]}</p><p>{LONG[:2000]}</p></div><article><p>Teaser of another page.</p></article>", [LONG[:3000], LONG[:2000], "Teaser of another page."])])
def test_short_paragraphs_stay_and_unknown_neighbours_of_an_article_go(page, want):
    assert html_extract.main_text(page).split("\n") == [x.strip() for x in want]


def test_minimum_cut_of_many_alternating_blocks():
    label = html_extract.min_cut([(0, 300), (300, 0)] * 4000, [(k, k + 1, 15) for k in range(7999)])
    assert label == [True, False] * 4000


def test_extract_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    many = "<article>" + "".join(f"<p>Paragraph {k}.</p>" for k in range(4000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", None, "mine"), (1, "u", None, "mine"), (2, None, deep, "x"), (3, "u", many, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()}
    assert got[1] == ("", 0) and got[2] == ("deep", 4) and got[3][0].count("\n") == 3999
    assert html_extract.extract(pages.limit(0)).count() == 0


# ---- 9 benchmark passages

def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for ch in item:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (ch != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (10, 12, 25, 40, 60)]
    items.append(items[3][:100])

    def hurt(s, edits):
        s = list(s)
        for _ in range(edits):
            k = rng.randrange(len(s))
            rng.choice((lambda: s.pop(k), lambda: s.insert(k, rng.choice("xyz")), lambda: s.__setitem__(k, "q")))()
        return "".join(s)

    docs = [(0, None), (1, ""), (2, " ".join(word() for _ in range(400))), (3, items[2].upper().replace(" ", "\n ")), (4, items[4] * 3), (5, items[0][:-1])]
    for k in range(6, 46):
        docs.append((k, " ".join(word() for _ in range(30)) + " " + hurt(rng.choice(items), rng.randrange(14)) + " " + " ".join(word() for _ in range(20))))
    benchmark = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, block_chars=150).collect()}
    want = {}
    for i, t in docs:
        for k, item in enumerate(items):
            if len(item) >= decontaminate.MIN_CHARS and t:
                e = edit_distance_inside(decontaminate.normal(item), decontaminate.normal(t))
                if e <= decontaminate.budget(len(decontaminate.normal(item))):
                    want[i, k] = e
    assert got == want and {e for e in want.values()} > {0, 1}


def test_bands_equal_plain_counting(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(decontaminate.Block, "dense", lambda self, spot: spot)

    def plain(block, code):
        out = set()
        for k, (_, item, edits) in enumerate(block.items):
            shared = {}
            for a in range(len(item) - block.q + 1):
                cells = {(p - a) // (edits + 1) for p in range(len(code) - block.q + 1) if (code[p:p + block.q] == item[a:a + block.q]).all()}
                for c in cells | {c - 1 for c in cells}:
                    shared[c] = shared.get(c, 0) + 1
            out |= {(k, c) for c, n in shared.items() if n >= block.need[k]}
        return out

    for _ in range(60):
        alphabet = rng.choice(["a", "ab", "a ", "abcdefghij"])
        items = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 60))) for _ in range(rng.randrange(1, 4))]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(10, 90))) + "z" + items[0][:30] + "z" + items[0][31:]
        monkeypatch.setattr(decontaminate, "PAIRS", rng.choice([1, 50, 1 << 20]))
        monkeypatch.setattr(decontaminate, "WIDE", rng.choice([1, 20, 1 << 14]))
        for block in decontaminate._block(list(enumerate(items)), 0.05, 12):
            code, got = decontaminate.codes(text), set()
            for k, low, high in block.bands(decontaminate.gram_hashes(code, block.q)):
                step = int(block.edits[k]) + 1
                got |= {(k, c) for c in range(low // step, (high + 1) // step - 1)}
            assert got == plain(block, code)


def test_long_repetitive_texts_take_little_memory_and_time():
    rng = random.Random(5)
    mixed = decontaminate.normal("".join(rng.choice("- ") for _ in range(300)))
    items = list(enumerate(["-" * 300, "-" * 100, "-" * 15, mixed, "-" * 150 + "abcdefghij" + "-" * 150]))
    blocks, shorts = decontaminate._block(items[:4], 0.05, 12), decontaminate._shorts(items[:4], 0.05)
    tracemalloc.start()
    begun = time.process_time()
    assert decontaminate._search("-" * 1_000_000, blocks, shorts)[1] == {0: (0, 0, 300), 1: (0, 0, 100), 2: (0, 0, 15)}
    assert time.process_time() - begun < 10 and tracemalloc.get_traced_memory()[1] < 200 << 20
    text = "".join(rng.choice("- ") for _ in range(50_000))
    assert 3 not in decontaminate._search(text, blocks, shorts)[1]
    assert decontaminate._search(text + mixed, blocks, shorts)[1][3][0] == 0
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert decontaminate._search("-" * 50_000, decontaminate._block(items[4:], 0.05, 12), [])[1] == {4: (10, 0, 300)}


def test_leaks_odd_rows(spark, clashing, empty):
    benchmark = spark.createDataFrame([(1, "word7 is here word8 is here word9 is here")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_leaks(clashing, benchmark).collect()) == [8, 9]
    kept = decontaminate.drop_leaky(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == len(ODD) - 2
    assert decontaminate.drop_leaky(clashing, benchmark.limit(0)).count() == len(ODD)
    assert decontaminate.find_leaks(empty, benchmark).count() == 0


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "cat"), (2, "Two plus  two?"), (3, "x"), (4, "東京"), (5, "what is the capital of"), (6, "nineteen characters"), (7, " ")]
    docs = [(1, "Concatenate, cats and a_cat."), (2, "A CAT, a cat"), (3, "so two plus\ntwo? four"), (4, "x"), (5, "xx x1"), (6, "私は東京にいる"),
            (7, "say what is the kapital of it"), (8, "nineteen characterz, nineteen characters"), (9, None), (10, ""), (11, "cafe\u0301 x\u0301")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): (r["n_edits"], r["start"], r["passage"]) for r in got.collect()} == {
        (2, 1): (0, 2, "cat"), (3, 2): (0, 3, "two plus two?"), (4, 3): (0, 0, "x"), (6, 4): (0, 2, "東京"),
        (7, 5): (1, 4, "what is the kapital of"), (8, 6): (0, 21, "nineteen characters")}


# ---- 10 personal data

PRIVATE = [
    (1, "Mail und.34@mail7.example.com or UND.34@Mail7.example.com, call +1 (017) 555-7713. Mrs. Anna Schmidt met Herr Schmidt and Mr. Otto Weber."),
    (2, "card 4111 1111 1111 1111, again 4111111111111111, 97.51.17.173 and 97.51.17.174"), (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'),
    (4, "clean 12345 v1.2.3.4.5 a@b 1.5.2020"), (5, None), (6, ""), (7, "und.34@mail7.example.com"), (7, "und.34@mail7.example.com"), (8, "г. Mr. Иван Петров")]


def test_surrogates_keep_type_format_and_identity(spark):
    df = spark.createDataFrame([(*r, "mine") for r in PRIVATE], "doc_id long, text string, entity string")
    out = pii.pseudonymise(df, "k").collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(PRIVATE) and got[1]["entity"] == "mine"
    one = got[1]["text"]
    mails = re.findall(r"\S+@\S+?\.com", one)
    assert len(set(mails)) == 1 and mails[0] == got[7]["text"] and re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com", mails[0])
    assert re.search(r"call \+\d \(\d{3}\) \d{3}-\d{4}\.", one) and "7713" not in one
    names = re.search(r"Mrs\. (\w+) (\w+) met Herr (\w+) and Mr\. (\w+) (\w+)\.", one).groups()
    assert names[1] == names[2] and names[0].endswith("a") and names[3].endswith("n") and len(set(names)) == 4
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{16}), (\S+) and (\S+)$", got[2]["text"]).groups()
    digits = [int(c) for c in cards[1]]
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    assert sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert cards[2] != cards[3] and all(0 <= int(o) < 256 for o in (cards[2] + "." + cards[3]).split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[3]["text"]) and got[3]["text"] != PRIVATE[2][1]
    assert [got[k]["text"] for k in (4, 5, 6)] == [PRIVATE[3][1], None, ""] and got[4]["n_replaced"] == 0
    assert re.fullmatch(r"г\. Mr\. [А-Я][а-я]{3} [А-Я][а-я]{5}", got[8]["text"])
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df.repartition(5), "k").collect()}
    assert again == {k: r["text"] for k, r in got.items()}
    assert pii.pseudonymise(df, "other").filter("doc_id = 7").first()["text"] != mails[0]


def test_surrogates_are_distinct_when_first_draws_collide(spark):
    # two-letter surnames have few surrogates of their length, so many draws collide
    names = [f"{a}{b}" for a in "ABCDEFGHIJ" for b in "abcdefghij"]
    df = spark.createDataFrame([(k, f"Mr. {n}") for k, n in enumerate(names)], "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(out)) == len(names) and not {t[4:].lower() for t in out} & {n.lower() for n in names}


def test_private_data_of_the_documents_goes_and_the_rest_stays(documents, empty):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    out = {r["doc_id"]: r for r in pii.pseudonymise(documents, "k").collect()}
    found = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)|[0-9a-f]{40}")
    for k, t in texts.items():
        held = set(found.findall(t or ""))
        assert not held & set(found.findall(out[k]["text"] or "")) and (held or out[k]["n_replaced"] or out[k]["text"] == t)
    assert pii.pseudonymise(empty, "k").count() == 0


def test_secrets_go_in_any_case_and_usual_length(spark):
    tokens = ["04dbebab91ab85687d33eeaaf9ac699e1188f962"[:n] if n < 40 else ("04dbebab91ab85687d33eeaaf9ac699e1188f962" * 4)[:n] for n in (32, 40, 48, 56, 64, 96, 128)]
    texts = [f'a = "{t}", b = "{t.upper()}", c = "{t[:20].upper() + t[20:]}".' for t in tokens] + ["f" * 31, "F" * 41, "x" + "f" * 40]
    out = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    got = {r["doc_id"]: r for r in out}
    for k, t in enumerate(tokens):
        low, up, mixed = re.fullmatch(r'a = "([0-9a-f]+)", b = "([0-9A-F]+)", c = "(\w+)"\.', got[k]["text"]).groups()
        assert low != t and len(low) == len(t) and up == low.upper() and mixed.lower() == low and mixed != low
        assert got[k]["n_replaced"] == 3 and got[k]["pii_types"] == ["secret"]
    assert [got[k]["text"] for k in range(len(tokens), len(texts))] == texts[len(tokens):]


def test_upper_case_secrets_of_the_larger_table_go(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/documents.parquet").filter(F.col("text").rlike("(?i)(?<![0-9a-z_])[0-9a-f]{40}(?![0-9a-z])")).select("doc_id", "text")
    secret = re.compile(r"(?<![0-9A-Za-z_])[0-9A-Fa-f]{40}(?![0-9A-Za-z])")
    before = {r["doc_id"]: secret.findall(r["text"]) for r in docs.collect()}
    after = {r["doc_id"]: secret.findall(r["text"]) for r in pii.pseudonymise(docs, "k").collect()}
    assert {2514, 8743} <= set(before) == set(after)
    for k, held in before.items():
        assert not set(held) & set(after[k]) and [(x.isupper(), x.islower()) for x in held] == [(x.isupper(), x.islower()) for x in after[k]]
