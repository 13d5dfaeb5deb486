"""The pipeline against brute force, stage by stage, and its place in the registry."""

import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from geoloom.llm import oracles, queries, token_output
from tests.llm.test_operators import VOCABULARY, components, hits, mixed
from tests.test_queries import same

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.queries()[name], SQL[name])


def test_registry():
    names = registry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert names["pipeline"].__wrapped__ is corpus_pipeline.run
    assert "pipeline" not in registry.oracle_sql()
    assert set(SQL) <= set(names)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with what each stage must catch, and columns that operators use themselves."""
    rng = random.Random(11)
    items = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(25))) for k in range(5)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(VOCABULARY) for _ in range(60)]
        if i % 10 == 1:
            words = rows[-1][1].split()
        if i % 10 == 2:
            words = rows[-1][1].split()
            words[rng.randrange(60)] = "changed"
        if i % 10 == 3:
            words[20:20] = items[i % 5][1].split()[5:17]
        bad = i % 10 == 4
        if bad:
            words = [rng.choice(VOCABULARY[:20]) + "%%%" for _ in words]
        rows.append((i, " ".join(words), "en", rng.choices(["a", "b", "c", None], [1, 8, 3, 1])[0], 0))
        if i % 3:
            labels.append((i, int(not bad), 0))
    rows += [(1000, None, "en", "a", 0), (1001, "", None, "a", 0), (None, " ".join(VOCABULARY[:50]), "en", "b", 0), (5, rows[5][1], "en", rows[5][3], 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit(7), "Size": F.lit("s"), "items": F.lit(0)})
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert docs.where("kept != 7 OR Size != 's' OR items != 0").count() == 0
        seen.append([tuple(r)[:4] for r in docs.collect()] if k < 4 else docs.collect())
    classified, unique, clean, mixed_rows, records = seen

    bad = {i for i, *_ in rows if i is not None and i < 400 and i % 10 == 4}
    left = {r[0] for r in classified}
    assert not left & bad
    assert len({i for i, *_ in rows} - bad - left) <= 4

    pairs = [(i, t) for i, t, *_ in classified]
    want = {c if n else i for i, n, c in components(pairs)}
    assert {r[0] for r in unique} == want
    assert len([r for r in unique if r[0] == 5]) == 1

    dirty = {i for i, _, n, *_ in hits([(i, t) for i, t, *_ in unique], items) if n}
    assert dirty
    assert Counter(clean) == Counter(r for r in unique if r[0] not in dirty)

    assert set(mixed_rows) <= set(clean)
    size, target = mixed([(i, t, s) for i, t, _, s in clean])
    taken = Counter()
    for r in mixed_rows:
        taken[r[3]] += len((r[1] or "").split())
    assert all(abs(taken[s] - target[s]) <= 0.3 * target[s] + 100 for s in target)
    assert max(Counter(r[0] for r in mixed_rows).values()) <= 3

    tiktoken = pytest.importorskip("tiktoken")
    lines = open(queries.VOCABULARY, "rb").read().splitlines()
    encoding = tiktoken.Encoding("t", pat_str=token_output.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    assert sorted(r.slot for r in records) == list(range(len(records)))
    texts = Counter((r[0], r[1]) for r in mixed_rows if r[1])
    first = Counter()
    for r in records:
        if r.chunk == 0:
            ids = np.frombuffer(bytes(r.tokens), "<u2")[: r.n_tokens].tolist()
            first[r.doc_id, tuple(ids)] += 1
    want = Counter()
    for (i, t), n in texts.items():
        want[i, tuple((encoding.encode_ordinary(t) + [token_output.SEPARATOR])[: token_output.LENGTH])] += n
    assert first == want


def test_run_is_the_stages_and_reruns_agree(spark, folder):
    path, _, _ = folder
    got = [sorted(map(str, corpus_pipeline.run(spark, path).select("doc_id", "chunk", "n_tokens", "tokens").collect())) for _ in range(2)]
    assert got[0] == got[1]
    assert got[0]


def test_stages_of_an_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
