import hashlib
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_dedup import brute_words
from vecloom.llm import byte_bpe, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts with planted copies, a shared passage and rows to reject."""
    rnd = random.Random(11)
    en = "the of and to in that is was for with on as by they this from".split()
    fr = "le la les des est une dans pour que qui sur avec pas plus par".split()
    text = lambda words, n: " ".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randrange(9))]) for _ in range(n))
    rows = [(i, text(en if i % 2 else fr, rnd.randint(60, 200)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    passage = text(en, 40)
    rows += [(100 + i, f"{text(en, 50)} {passage} {text(en, 30)}", "en", "s0") for i in range(5)]
    rows += [(200 + i, rows[i][1], rows[i][2], "s1") for i in range(8)]
    rows += [(300, None, "en", "s2"), (301, "12 34 !!", None, "s2"), (302, "", "fr", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows, passage


def test_stages(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
    clean = {r[0] for r in rows if r[0] < 200}
    assert set(seen["language"]) == clean | set(range(200, 208))
    assert set(seen["near_dedup"]) == clean
    after = seen["substring_dedup"]
    assert set(after) == clean and passage in after[100]["text"]
    before = [(i, r["text"]) for i, r in seen["near_dedup"].items()]
    want = {i: (n, gone, sha) for i, n, gone, sha in brute_words(before, 13)}
    for i, text in before:
        n, gone, sha = want[i]
        assert after[i]["text"] == text if not gone else hashlib.sha256(after[i]["text"].encode()).hexdigest() == sha
        assert after[i]["n_chars"] == len(after[i]["text"]) and (gone > 0) == (i > 100)
    mixed = seen["mixing"]
    assert set(mixed) <= clean and all(mixed[i]["text"] == after[i]["text"] for i in mixed)
    bpe = byte_bpe.vocabulary(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    for i, r in seen["byte_bpe"].items():
        ids = bpe.encode(mixed[i]["text"])
        assert (r["n_tokens"], r["ids"]) == (len(ids) // 4, np.frombuffer(ids, "<u4").tolist())
        assert r["decoded_sha256"] == hashlib.sha256(mixed[i]["text"].encode()).hexdigest()


def test_run_is_the_stages(spark, corpus):
    folder, *_ = corpus
    a, b = (sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and len(a) > 20


def test_names_do_not_clash(spark, corpus):
    """Every name a stage uses inside, as an extra column of all rows: stages keep them and decide alike."""
    from pyspark.sql import functions as F

    folder, *_ = corpus
    plain = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 3 <> 1")
    names = ["n_words", "n_removed", "kept_sha256", "__kept", "kept", "rest", "row", "key", "id", "t", "node", "component", "found", "best", "share", "__lang_pred", "__score"]
    names += ["__dropped", "__text", "__mix_size", "__mix_rank", "__mix_copies", "__mix_source", "__mix_i", "__mix_tie", "label", "fp0", "n", "count"]
    odd = plain.select("*", *(F.lit(7 + i).alias(c) for i, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, plain, folder), stage(spark, odd, folder)
        assert b.columns == odd.columns
        assert sorted(map(str, b.select(*plain.columns).collect())) == sorted(map(str, a.select(*plain.columns).collect()))
        assert b.select(*names).distinct().collect() == [tuple(range(7, 7 + len(names)))]


def test_stages_with_odd_rows(spark, odd, odd_rows):
    """Null ids, texts and sources, repeated rows and ids, an empty and a very long text, in every stage by itself."""
    from pyspark.sql import functions as F

    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.when(F.col("doc_id") < 200, "s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    left = {name: corpus_pipeline.materialize(stage(spark, docs, "")) for name, stage in corpus_pipeline.STAGES}
    none = sum(i is None for i, _ in odd_rows)
    ids = {name: [r["doc_id"] for r in df.select("doc_id").collect()] for name, df in left.items()}
    assert not {300, 301, 302, 303} & set(ids["language"]) and len(ids["byte_bpe"]) == len(odd_rows)
    assert ids["near_dedup"].count(None) == none and ids["near_dedup"].count(310) == 1 and {300, 203, 304} <= set(ids["near_dedup"]) and not {301, 302, 303} & set(ids["near_dedup"])
    texts = {r["doc_id"]: r["text"] for r in left["substring_dedup"].filter("doc_id is not null").collect()}
    assert texts[300] is None and texts[301] == "" and len(texts[203].split()) == 20_000
    assert set(ids["mixing"]) <= {i for i, _ in odd_rows} and len(ids["mixing"]) > 10


def test_empty_documents(spark, nothing, tmp_path):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    if name in queries.ORACLE_SQL:
        connection = duckdb.connect()
        connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = connection.sql(queries.ORACLE_SQL[name])
        columns = sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.select(*columns).fetchall())
    else:
        assert got.count() == (50 if name.startswith("op1_") else 200)
