from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.functions import scalar, text
from termweave.operators import batch, shards, signatures, statistics
from termweave.plans.api import Engine
from termweave.plans.parser import parse
from termweave.sources import chunks, synthetic


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_primes_match_arithmetic(spark):
    engine = Engine(synthetic.prime_factors(spark, 64))
    primes = [2, 3, 5, 7]
    log, want = {}, {}
    for mask in range(1, 16):
        parts = [str(p) if mask >> k & 1 else f"-{p}" for k, p in enumerate(primes)]
        log[str(mask)] = " ".join(parts)
        want[str(mask)] = {i for i in range(64) if all((i > 0 and i % p == 0) == bool(mask >> k & 1) for k, p in enumerate(primes))}
    got = {}
    for r in engine.log(log).collect():
        got.setdefault(r.query, set()).add(r.doc_id)
    assert {k: got.get(k, set()) for k in log} == want
    assert set(ids(engine.query("2 -3"))) == {i for i in range(1, 64) if i % 2 == 0 and i % 3}


def test_phrases_and_short_documents(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "b a"), (3, ""), (4, None), (5, "a")], "doc_id long, text string")
    engine = Engine.from_texts(df)
    assert ids(engine.query('"a b"')) == [1]
    assert ids(engine.query("-a")) == [3, 4]
    assert ids(engine.query('"b c" | -"b a"')) == [1, 3, 4, 5]


def test_streams_are_enforced_or_ignored(spark):
    docs = spark.createDataFrame([(1, ["red"], ["blue"]), (2, ["blue"], ["red"])], "doc_id long, title array<string>, body array<string>")
    columns = {0: ("body", "body"), 1: ("title", "title")}
    assert ids(Engine(docs, {"title": 1}, columns).query("title:red")) == [1]
    assert ids(Engine(docs, {"title": 1}, columns, stream_scope="ignore").query("title:red")) == [1, 2]


def test_grams_run_forward_only(spark):
    docs = text.documents(spark.createDataFrame([(1, "one two three four five")], "doc_id long, text string"))
    grams = {r.gram for r in text.postings(docs, 5).collect()}
    words = "one two three four five".split()
    assert grams == {" ".join(words[i:j]) for i in range(5) for j in range(i + 1, 6)}


def test_statistics_of_the_prime_corpus(spark):
    docs = synthetic.prime_factors(spark, 64)
    df = {r.gram: r.df for r in statistics.document_frequency(text.postings(docs), docs).collect()}
    assert len(df) == 18 and df["2"] == 31 and df["3"] == 21


def test_frequencies_of_all_grams(spark, tmp_path):
    from termweave.plans.catalog import QUERIES

    texts = [f"common w{i} w{i // 2}" for i in range(30)] + ["common common", "", None]
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    split = [(t or "").split() for t in texts]
    one = Counter(g for w in split for g in set(w))
    two = Counter(g for w in split for g in {f"{a} {b}" for a, b in zip(w, w[1:])})
    assert min(one.values()) < 20 and min(two.values()) < 3  # what freq_at_rank and doc_freq_bigram leave out
    assert {tuple(r) for r in QUERIES["doc_freq_bigram_all"](spark, str(tmp_path)).collect()} == set(two.items())
    got = {(r.gram, r.rank): r.frequency for r in QUERIES["freq_at_rank_all"](spark, str(tmp_path)).collect()}
    want = {(g, r): 1 - (1 - n / len(texts)) ** 2**r for g, n in one.items() for r in range(7)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_shard_boundaries(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 10, 399, 400, 401, 749, 750, 751, 10000)], "n int")
    got = [r[0] for r in rows.select(scalar.shard_of(F.col("n"), [0, 400, 500, 600, 750])).collect()]
    assert got == [0, 0, 0, 1, 1, 3, 4, 4, 4]
    assert shards.geometric() == [0, *(32 << k for k in range(10))]


def test_optimal_shards_equal_brute_force():
    from itertools import combinations

    bars = [(3, 700), (10, 500), (40, 900), (90, 20), (400, 600)]

    def cost(cuts):
        edges = [0, *cuts, len(bars)]
        return sum(-(-sum(n for _, n in bars[a:b]) // 512) * 512 * bars[b - 1][0] + 1 for a, b in zip(edges, edges[1:]))

    best = min((cost(c) for k in range(3) for c in combinations(range(1, 5), k)))
    got = shards.optimal(bars, most=3)
    cuts = [i for i in range(1, 5) if bars[i][0] in got[1:]]
    assert got[0] == 0 and cost(cuts) == best


@pytest.mark.parametrize("name", signatures.TREATMENTS)
def test_signatures_have_no_false_negatives(spark, name):
    docs = signatures.number_documents(synthetic.prime_factors(spark, 256))
    postings = docs.select("doc_id", "doc_index", F.explode("terms").alias("gram"), F.lit(1).alias("gram_size"))
    f = statistics.document_frequency(postings, docs).withColumn("idf_x10", scalar.idf_x10(F.col("df"), F.col("n")))
    rows = signatures.term_rows(f, signatures.TREATMENTS[name](0.2, 10.0), 0.2)
    bits = signatures.signature(postings, rows)
    for query, terms in (("2 (3 | 7)", ["2", "3", "7"]), ("5 -2", ["5", "2"])):
        exact = set(ids(Engine(docs).query(query)))
        assert exact <= set(ids(signatures.candidates(docs, bits, rows, parse(query), terms)))


def test_log_equals_single_queries(spark):
    engine = Engine(synthetic.prime_factors(spark, 100))
    log = {"a": "2 | 3 -5", "b": "-(2 | 3)", "c": "2 -2", "d": "(2 | 3) (5 | 7)", "e": '"2 3"'}
    found = engine.log(log)
    got = {q: sorted(r.doc_id for r in found.where(F.col("query") == q).collect()) for q in log}
    assert got == {q: ids(engine.query(t)) for q, t in log.items()}
    assert {r.query: r.matches for r in batch.log_summary(found, log).collect()} == {q: len(v) for q, v in got.items()}


def test_chunks_round_trip(spark, tmp_path):
    docs = [(7, [(0, ["red", "größe"]), (1, [])]), (8, [])]
    data = b"".join(chunks.format_document(*d) for d in docs) + b"\0"
    assert [(i, s) for i, _, s in chunks.parse_chunk(data)] == docs
    (tmp_path / "c").write_bytes(data)
    (tmp_path / "manifest").write_text(f" {tmp_path}/c \n\n")
    df = chunks.read_manifest(spark, str(tmp_path / "manifest"))
    assert [(r.stream_id, r.pos, r.term) for r in chunks.chunk_tokens(df).orderBy("pos").collect()] == [(0, 0, "red"), (0, 1, "größe")]
    chunks.write_chunks(df, str(tmp_path / "out"))
    assert ids(chunks.read_chunk_folder(spark, str(tmp_path / "out"))) == [7, 8]
    for bad in (b"", data[:-1], data[:20], b"XYZ\0\0"):
        with pytest.raises(chunks.ChunkError):
            list(chunks.parse_chunk(bad))


def test_chunks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 100)
    rows = [(i - 2, [(0, ["größe", "two\nlines"][: i % 3]), (255, [f"w{i}"] * (i % 4)), (3, [])][: i % 4]) for i in range(40)] + [(99, [(1, ["long"] * 60)])]
    docs = spark.createDataFrame(rows, "doc_id long, streams array<struct<stream_id:smallint,terms:array<string>>>").coalesce(1)
    chunks.write_chunks(docs, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 100 + 400
    want = {i: (len(chunks.format_document(i, s)), [(k, t) for k, t in s]) for i, s in rows}
    read = chunks.read_chunk_folder(spark, str(tmp_path / "out"))
    assert {r.doc_id: (r.source_bytes, [(s.stream_id, s.terms) for s in r.streams]) for r in read.collect()} == want
    tokens = {i: [x for _, t in s for x in t] for i, s in rows}
    assert {tuple(r) for r in chunks.token_counts(read).collect()} == {(i, len(t), len(set(t))) for i, t in tokens.items() if t}


def test_store_adds_deletes_and_follows(spark, tmp_path):
    from termweave.streaming.ingest import Store

    store = Store(spark, str(tmp_path / "store"))
    store.add(spark.createDataFrame([(1, "red"), (2, "blue red")], "doc_id long, text string"), 1)
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([(2, "x")], "doc_id long, text string"), 2)
    assert store.delete(spark.createDataFrame([(1,), (9,)], "doc_id long"), 3) == 1
    assert ids(Engine(store.active()).query("red")) == [2]
    spark.createDataFrame([(1, "red again"), (2, "kept out")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    store.follow(stream, str(tmp_path / "ck")).awaitTermination()
    store.set_fact(spark.createDataFrame([(2,)], "doc_id long"), "good", True, 1)
    assert store.facts().count() == 1


def test_csv_columns(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from termweave.sources import delimited

    (tmp_path / "t.csv").write_text('name,id\n"a ""b""",ff\nc,\n')
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    got = delimited.read_csv(spark, str(tmp_path / "t.csv"), schema, {"id": 5}, ("id",)).collect()
    assert [tuple(r) for r in got] == [(255, 'a "b"'), (5, "c")]
    with pytest.raises(ValueError):
        delimited.extract_columns(spark.range(1), ["id", "id"])
