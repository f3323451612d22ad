"""The driver queries against their SQL, and the pipeline against a plain version of its stages."""

import os
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from odd_rows import SF
from test_operators import shingle_set

import corpus_pipeline
from cartwheel.llm import decontaminate, langid, oracles, queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_query_equals_sql(spark, duck, name):
    got = queries.all_queries()[name](spark, SF)
    cur = duck.execute(oracles.all_oracles()[name])
    columns = [c[0] for c in cur.description]
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert sorted(got.columns) == sorted(columns)
    assert tidy(tuple(r) for r in got.select(*columns).collect()) == tidy(cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.all_queries()))
def test_query_gives_a_row_for_each_input(spark, name):
    out = queries.all_queries()[name](spark, SF)
    if name == "op11_spelling_variants":
        assert out.count() == out.select("word").distinct().count() > 0
    elif name != "op9_decontamination":
        table = "pages" if "page_id" in out.columns else "documents"
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
    else:
        assert out.select("doc_id").distinct().count() > 0


def test_pipeline_equals_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    scorer = langid.Scorer(model)
    kept = {r["doc_id"]: r["text"] or "" for r in docs.collect() if scorer.predict(r["text"])[0] != langid.UNKNOWN}
    last = {}
    for i, t in sorted(kept.items()):
        last[t] = i
    kept = {i: t for t, i in last.items()}
    sets = {i: shingle_set(t, 5) for i, t in kept.items()}
    near = defaultdict(set)
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y):
                near[i].add(j)
                near[j].add(i)
    seen = set()
    for i in sorted(kept):
        if i in seen:
            continue
        todo = [i]
        seen.add(i)
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
                del kept[j]
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, t in kept.items() if any(m in decontaminate.normal(t) for m in items)}
    clean = set(kept) - leaky

    taken, columns = None, docs.columns
    from cartwheel.llm.common import written
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name == "benchmark_free":
            assert {r["doc_id"] for r in docs.collect()} == clean
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        taken = docs
    out = taken.collect()
    assert {r["doc_id"] for r in out} <= clean and all(0 < r["taken"] <= 3 * r["size"] for r in out)
    assert {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, SF).collect()} == {(r["doc_id"], r["taken"]) for r in out}


def plain_stage_rows(name, rows, items):
    """What a stage keeps of rows ``(id, text, ...)``, as a multiset; None where it is not a plain choice of rows."""
    if name == "exact_copies":
        by_text = defaultdict(list)
        for r in rows:
            by_text[r[1] or ""].append(r)
        return [max(group, key=lambda r: (r[0] is not None, r[0] or 0)) for group in by_text.values()]
    if name == "benchmark_free":
        return [r for r in rows if not any(m in decontaminate.normal(r[1] or "") for m in items)]
    return None


def test_pipeline_stages_take_odd_rows(spark, clashing, empty):
    """Rows with null and repeated ids: every stage keeps the rows it should, each once and whole."""
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    columns = ["doc_id", "text", "lang", "source"]
    plain = [tuple(r) for r in clashing.select(columns).collect()]
    more = [(5, f"here is {items[0]} and more", "en", "b"), (5, "quite another text of the same id", "en", "b"), (None, f"again {items[1]}", "en", "a"),
            (None, "a clean text without an id", "en", "a"), (None, "a second clean text without an id", "en", "a"), (None, "a second clean text without an id", "fr", None)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    docs = clashing.unionByName(extra, allowMissingColumns=True)
    normal = [decontaminate.normal(m) for m in items]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(columns).collect()]
        out = stage(spark, docs, SF)
        after = [tuple(r) for r in out.select(columns).collect()]
        assert not Counter(after) - Counter(before)
        wanted = plain_stage_rows(name, before, normal)
        if wanted is not None:
            assert sorted(((r[0], r[1]) for r in after), key=repr) == sorted(((r[0], r[1]) for r in wanted), key=repr)
        if name == "mixed":
            # words are taken of nearly every clean row that has any, also of those that share an id
            assert len(after) <= len(before) and {r[1] for r in after} <= {r[1] for r in before}
            assert all(0 < r["taken"] <= 3 * r["size"] and r["size"] == len((r["text"] or "").split()) for r in out.collect())
        else:
            assert out.columns == docs.columns
        # each stage is also given all rows, not only what the stages before have kept
    assert len(plain) == clashing.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_mixing_whole_rows_equals_mixing_ids(spark, clashing):
    from cartwheel.llm import mixing
    whole = mixing.mix(clashing, keep=True)
    assert whole.count() == clashing.count() and set(whole.columns) == set(clashing.columns) | {"size", "source_size", "target", "taken"}
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    tidy = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert tidy(whole) == tidy(mixing.mix(clashing))


def test_entry_has_all_numbered_queries():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
