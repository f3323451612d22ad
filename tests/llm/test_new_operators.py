"""Spelling variants, MinHash groups and token alignment against brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD, SF
from pyspark.sql import functions as F
from test_operators import shingle_set

from cartwheel.llm import minhash, queries, spelling, token_align
from cartwheel.llm.star_components import star_components

PATHS = [str(public_tokenizers.path(t)) for t in (queries.TOKENIZER, queries.OTHER_TOKENIZER)]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# spelling variants

def plain_variants(rows, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        edits |= {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters}
        near[w] = [v for v in edits if v in n and v != w]
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants(df, **how):
    rows = [tuple(r) for r in spelling.group_variants(df, **how).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text")
    assert variants(rows) == plain_variants([tuple(r) for r in rows.collect()])


def test_variants_of_planted_chains(spark):
    # counts that grow tenfold at each step, ties, edits at both ends, letters in any place, repeated letters
    words = {"abcdefgh": 2, "abcdefghi": 20, "abcdefghij": 200, "xabcdefghij": 2000, "aaaaaaa": 3, "aaaaaaaa": 30, "aaaaaaab": 30,
             "baaaaaaa": 30, "étéétéé": 2, "étéétéè": 25, "étéétéÀ": 2, "listenings": 5, "silentings": 50}
    texts = [" ".join(w for w, c in words.items() if k < c) for k in range(2000)]
    rows = list(enumerate(texts))
    assert variants(rows_of(spark, texts)) == plain_variants(rows)
    got = variants(rows_of(spark, texts), every=1 << 40)
    assert got == plain_variants(rows, every=1 << 40)
    roots = {r[0]: r[2] for r in got}
    assert roots["abcdefgh"] == "xabcdefghij" and roots["aaaaaaa"] == "aaaaaaaa" and roots["listenings"] == "listenings"


def test_variants_take_odd_rows(spark, odd, clashing, empty):
    wanted = plain_variants([r[:2] for r in ODD])
    assert variants(odd) == wanted and variants(clashing) == wanted
    assert variants(empty) == set()


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.data())
def test_near_words_share_a_signature(word, data):
    k = data.draw(st.integers(0, len(word) - 1))
    for other in (word[:k] + word[k + 1:], word[:k] + "z" + word[k:], word[:k] + "z" + word[k + 1:], word + "a"):
        assert spelling.signatures(word) & spelling.signatures(other)


# MinHash

def plain_groups(rows, width=3, percent=85):
    sets = [shingle_set(t or "", width) for _, t in rows]
    ids = defaultdict(set)
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            ids[i].add(k)
    lead = {i: i for i in ids}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and any(100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) for x in ids[i] for y in ids[j]):
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    out = []
    for k, (i, _) in enumerate(rows):
        component = i if i is None or not sets[k] else top(i)
        out.append((i, len(sets[k]), component, i is None or component == i))
    return sorted(out, key=repr)


def groups(df, **how):
    out = minhash.near_groups(df, **how)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_groups_equal_brute_force(spark, documents):
    rows = documents.select("doc_id", "text")
    assert groups(rows) == plain_groups([tuple(r) for r in rows.collect()])


def test_groups_at_the_threshold(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(2, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert groups(rows_of(spark, texts)) == plain_groups(list(enumerate(texts)))


def test_groups_in_one_crowded_bucket(spark, monkeypatch):
    """A chain of sets in which few are linked with the smallest id: the rest of the buckets is compared in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[10 * k:10 * k + 120]) for k in range(28)]
    assert groups(rows_of(spark, texts), percent=80) == plain_groups(list(enumerate(texts)), percent=80)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join(common + [f"{m}u{k}" for k in range(8)] + [f"{m // 3}v{k}" for k in range(20)]) for m in range(45)]
    assert groups(rows_of(spark, texts), percent=60) == plain_groups(list(enumerate(texts)), percent=60)


def test_groups_take_odd_rows(spark, odd, clashing, empty):
    wanted = plain_groups([r[:2] for r in ODD])
    assert groups(odd) == wanted and groups(clashing) == wanted
    assert groups(empty) == []
    # one id with two texts, each in a group of its own: both groups are one
    rows = [(4, "a b c d e"), (9, "a b c d e"), (9, "v w x y z"), (7, "v w x y z"), (8, "k l m n")]
    assert groups(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)


def test_star_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    lead = {i: i for link in links for i in link}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        lead[b] = a
    got = star_components(spark.createDataFrame(links, "a long, b long")).collect()
    met = {i for a, b in links if a != b for i in (a, b)}
    assert {tuple(r) for r in got} == {(i, top(i)) for i in met} and len(got) == len(met)


# token alignment

@pytest.fixture(scope="module")
def aligner():
    return token_align.Aligner(*PATHS)


def plain_alignment(text):
    """(n_a, n_b, links, groups) over the whole text by the libraries and the intersection of ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _LIBRARIES
    if "_LIBRARIES" not in globals():
        tokenizer = Tokenizer.from_file(PATHS[0])
        tokenizer.encode_special_tokens = True
        _LIBRARIES = tokenizer, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    if not text:
        return 0, 0, [], ""
    own, (tokenizer, processor) = (" " + text).encode(), _LIBRARIES
    back = {c: b for b, c in token_align.byte_letters().items()}
    a = tokenizer.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(back[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    b = [(i, bytes([int(t[3:5], 16)]) if processor.is_byte(i) else t.replace("▁", " ").encode()) for i, t in ((i, processor.id_to_piece(i)) for i in processor.encode(text))]
    if b"".join(t for _, t in a) != own or b"".join(t for _, t in b) != own:
        return 0, 0, [], ""
    ends = [list(itertools.accumulate(len(t) for _, t in side)) for side in (a, b)]
    common = set(ends[0]) & set(ends[1])
    cut = [], []
    for k, side in enumerate((a, b)):
        group = []
        for (i, _), end in zip(side, ends[k]):
            group.append(i)
            if end in common:
                cut[k].append(group)
                group = []
    links = [(x[-1], y[-1]) for x, y in zip(*cut)]
    groups = [",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in zip(*cut)]
    return len(a), len(b), links, ";".join(groups)


def as_plain(found):
    return found[0], found[1], [(v >> 32, v & 0xFFFFFFFF) for v in struct.unpack(f"<{len(found[2]) // 8}q", found[2])], found[3]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text("ab ▁<0x41>'s\n\t\x00\x1c é漢😀1,.", max_size=30) | st.lists(st.sampled_from(["the", " ", "  ", "<s>", "<|endoftext|>", "don't", "été", "\n", "<0x0A>", "1234", "'", "ﬁ", "é"]), max_size=15).map("".join))
def test_alignment_equals_the_libraries(aligner, text):
    assert as_plain(aligner.align(text)) == plain_alignment(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=0x7FF, exclude_characters=" "), max_size=12) | st.sampled_from(["the", "don't", "<s>", "<0x41>", "naïve", "a\nb", "§½", "$$$", "straße."]), min_size=1, max_size=12))
def test_plain_units_have_the_library_s_pieces(aligner, units):
    units = [u + "." for u in units]
    assert all(token_align._PLAIN.fullmatch(u) for u in units) and not any(token_align._PLAIN.fullmatch(u) for u in ("", "a b", "漢", "a▁b", "x\x00", "x\n"))
    wanted = aligner.b.processor.encode(units, num_threads=1)
    assert aligner.b.encode_plain(" " + " ".join(units)) == [i for ids in wanted for i in ids]


def test_alignment_hands_texts_over_in_small_batches(spark, monkeypatch):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    monkeypatch.setattr(queries, "written", lambda df, label, own=queries.written: seen.append(spark.conf.get(setting)) or own(df, label))
    queries.op13_token_alignment(spark, SF)
    assert int(seen[0]) <= 1000 and spark.conf.get(setting) == before


def test_plain_units_need_no_priority_queue(monkeypatch):
    aligner, text = token_align.Aligner(*PATHS), "die Straße, l'été and 1234 the-end."
    wanted = plain_alignment(text)

    def encode(*a, **kw):
        raise AssertionError("the slower library was asked")

    monkeypatch.setattr(aligner.b, "encode", encode)
    assert as_plain(aligner.align(text)) == wanted


def test_alignment_of_long_texts(aligner, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK_CHARS", 50)
    for text in ("word " * 300, "漢字かな交じり文" * 200, "a" * 3000, " " * 500, "x" + " " * 400 + "y", "no cut here but one " + "z" * 400 + " end"):
        assert as_plain(aligner.align(text)) == plain_alignment(text)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_cuts_are_the_common_ends(a, b):
    a, b = sorted(a), sorted(b)
    assert token_align.common_cuts(a, b) == [(a.index(v), b.index(v)) for v in sorted(set(a) & set(b))]


def test_cuts_of_a_long_interval_without_any():
    n = 200_000
    assert token_align.common_cuts(list(range(2, 2 * n, 2)), list(range(1, 2 * n, 2))) == []
    ends = list(range(0, 4 * n, 2))
    assert len(token_align.common_cuts(ends[:n] + [e + 1 for e in ends[n:]], ends)) == n


def plain_report(rows):
    found = [(i, *plain_alignment(t)) for i, t in rows]
    count = Counter(link for f in found for link in f[3])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, n_a, n_b, groups.count(";") + bool(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, n_a, n_b, links, groups in found), key=repr)


def test_alignment_query_equals_brute_force(spark):
    got = queries.op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_report(rows)


def test_alignment_takes_odd_rows(spark, odd, clashing, empty):
    wanted = plain_report([r[:2] for r in ODD])
    for df in (odd, clashing.withColumns({c: F.lit("mine") for c in ("links", "groups", "n_best", "n_a")})):
        aligned = token_align.align(df, *PATHS)
        scored = token_align.score_links(aligned, token_align.link_counts(aligned)).withColumn("sha", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(""))
        assert sorted((tuple(r) for r in scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect()), key=repr) == wanted
        assert set(df.columns) <= set(scored.columns) | {"links"}
    aligned = token_align.align(empty, *PATHS)
    assert token_align.score_links(aligned, token_align.link_counts(aligned)).collect() == []


# token counts: white space that Python and the tokenizer see differently

@settings(max_examples=400, deadline=None)
@given(st.text("ab1.,\n\t \x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000é'", max_size=25))
def test_counts_of_any_white_space_equal_the_library(text):
    global _COUNTER
    if "_COUNTER" not in globals():
        from cartwheel.llm import token_count
        _COUNTER = token_count.counter(PATHS[0])
    assert _COUNTER.count([text]) == [len(_COUNTER.tokenizer.encode(text, add_special_tokens=False).ids)]


# long broken pages

def test_unclosed_tags_and_deep_blocks_are_read_once():
    import time

    from cartwheel.llm import html_extract
    for page in ("<a " * 350_000, "<p>text</p>" + "<b x" * 250_000, "<div>" * 4000 + "x" + "</div>" * 4000 + "<i " * 100_000, "<div>t" * 4000, "1 < 2 and <b " * 50_000):
        start = time.process_time()
        found = html_extract.blocks(page)
        assert time.process_time() - start < 2 and found
    assert "".join(html_extract.blocks("a < b <i c")[0].parts) == "a < b <i c"


def test_units_of_a_text_are_encoded_together(aligner, monkeypatch):
    asked = []
    for side in (aligner.a, aligner.b):
        monkeypatch.setattr(side, "encode", lambda units, encode=side.encode: asked.append(len(units)) or encode(units))
    text = "quarzab, zwölfxy umbrellaish 0x7fe3 ofthings."
    assert as_plain(aligner.align(text)) == plain_alignment(text)
    assert asked == [0, 0, 1, 1]  # by A and B: no unit by itself, all five as one text
