"""The stored index against the scanning engine, orders without a single task, treatments and files."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termweave.functions import scalar, text
from termweave.operators import batch, ordering, shards, signatures, statistics, verify
from termweave.plans.api import Engine
from termweave.plans.compiler import possible_without
from termweave.plans.index import Index, IndexedEngine
from termweave.plans.parser import And, Fact, MatchAll, MatchNone, Not, Or, Term, format_tree, parse
from termweave.sources import delimited, synthetic
from termweave.sources.workspace import new_folder


def ids(df):
    return sorted(r.doc_id for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.randrange(12)))) for i in range(120)] + [(500, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def held(spark, corpus):
    docs = ordering.numbered(text.documents(corpus), [], ["doc_id"], "doc_index")
    return Index.build(docs, new_folder(spark, "index"), buckets=4)


QUERIES = ["a", "a b -c", "a | -b", "-(a | b)", '"a b"', '"a b c" | -d', '-"b a" c', "zzz", "zzz | a", '"a a"', "(a | b) (c | -d)"]


def test_index_equals_scan(spark, corpus, held):
    plain, stored = Engine.from_texts(corpus), IndexedEngine(held)
    gone = spark.createDataFrame([(3,), (4,)], "doc_id long")
    for q in QUERIES:
        assert ids(stored.query(q)) == ids(plain.query(q)), q
    assert ids(IndexedEngine(held, deleted=gone).query("a")) == [i for i in ids(plain.query("a")) if i not in (3, 4)]
    log = {f"q{k}": q for k, q in enumerate(QUERIES)}
    got, want = ({(r.query, r.doc_id) for r in e.log(log).collect()} for e in (stored, plain))
    assert got == want
    assert {r.doc_id: r.contains for r in stored.contains("a").collect()} == {r.doc_id: r.contains for r in plain.contains("a").collect()}


def test_index_reads_only_its_buckets(held):
    plan = IndexedEngine(held).explain('"a b" -c')
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [Or(" in plan or "In(gram, [a,b,c])" in plan


def test_index_grows(spark, corpus, held):
    more = Index.build(held.documents.where("doc_id < 60"), new_folder(spark, "index"), buckets=4).add(held.documents.where("doc_id >= 60"), new_folder(spark, "index"), buckets=4)
    assert ids(IndexedEngine(more).query("a -b")) == ids(IndexedEngine(held).query("a -b"))


def test_streams_of_an_index(spark):
    docs = spark.createDataFrame([(1, ["red", "car"], ["blue"]), (2, ["blue"], ["red", "car"]), (3, ["car"], ["red"])], "doc_id long, title array<string>, body array<string>")
    held = Index.build(docs, new_folder(spark, "index"), {1: "title", 2: "body"}, buckets=2)
    one = IndexedEngine(held, {"title": 1}, {0: 2})
    assert (ids(one.query("title:red")), ids(one.query("red")), ids(one.query('title:"red car"'))) == ([1], [2, 3], [1])
    wide = IndexedEngine(held, {"title": 1}, stream_scope="ignore")
    assert (ids(wide.query("title:red")), ids(wide.query('"red car"')), ids(wide.query("red -blue"))) == ([1, 2, 3], [1, 2], [3])
    assert {(r.query, r.doc_id) for r in wide.log({"q": "red blue"}).collect()} == {("q", 1), ("q", 2)}


def test_system_terms_and_facts(spark, held):
    engine = IndexedEngine(held)
    engine.all = engine.all.withColumn("even", F.col("doc_id") % 2 == 0)
    every = ids(engine.match(MatchAll()))
    assert len(every) == 121 and ids(engine.match(MatchNone())) == []
    assert ids(engine.match(Fact("even"))) == [i for i in every if i % 2 == 0]
    assert ids(engine.match(And((Term("a"), Not(Fact("even")))))) == [i for i in ids(engine.query("a")) if i % 2]
    assert ids(engine.match(Or((Term("a"), Fact("even"))))) == [i for i in every if i % 2 == 0 or i in ids(engine.query("a"))]
    assert format_tree(MatchAll()) == "MatchAll()"
    assert [possible_without(t) for t in (parse("a | -b"), parse("a -b"), And((Fact("x"), Not(Term("a")))), Or((Fact("x"), Term("a"))))] == [True, False, True, True]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_and_sums(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice("xyz") if by else "x", rng.randrange(1 << 62), rng.randrange(9)) for _ in range(500)] + [(None, 5, 7)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): (r.n, r.s) for r in ordering.running_sum(ordering.numbered(df, by, ["k"]), by, ["k"], F.col("v"), "s").collect()}
    for g in {r[0] for r in rows} if by else [None]:
        total = 0
        for n, (h, k, v) in enumerate(sorted((r for r in rows if not by or r[0] == g), key=lambda r: r[1])):
            total += v
            assert got[h, k] == (n, total)
    assert ordering.numbered(df.limit(0), by, ["k"]).count() == 0


def test_percentiles_of_a_histogram(spark):
    rng = random.Random(2)
    values = [rng.randrange(40) for _ in range(301)]
    r = statistics.order_statistics(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    for name, share in (("p5", 0.5), ("p9", 0.9), ("p99", 0.99), ("p999", 0.999)):
        assert abs(r[name] - np.percentile(values, 100 * share)) < 1e-9
    assert r.largest == max(values)


def brute_cost(plan, f, density):
    """Cost and noise of a plan by following the rows one by one."""
    at = [f if r == 0 else 1 - (1 - f) ** (2**r) for r in range(len(plan))]
    rows = [r for r in reversed(range(len(plan))) for _ in range(plan[r])]
    noise, reads, alive, passed, top = 0.0, 0.0, 1.0, len(plan), rows[0]
    for k, r in enumerate(rows):
        if r < passed:
            for level in range(min(passed, top + 1) - 1, r - 1, -1):  # ranks from the last one read down to this
                noise += (1.0 if level == top else at[level + 1] - f) - (at[level] - f)
            passed = r
        chance = max(0.0, density - at[r])
        reads += alive / 2**r
        noise = chance if k == 0 else noise * chance
        alive = 1 - max(0.0, 1 - f - noise - (at[r] - f)) ** 64
    bits = sum(n / 2**r if at[r] >= density else n * at[r] / density for r, n in enumerate(plan))
    return reads * bits, noise


def test_the_optimal_treatment_equals_brute_force():
    density, snr, most = 0.1, 10.0, 2
    best = signatures.optimal(density, snr, most)
    for idf in (0, 8, 10, 15, 25, 30, 40, 60):
        f, found = 10 ** (-idf / 10), {}
        for plan in itertools.product(range(most + 1), repeat=signatures.RANKS):
            if plan[0]:
                cost, noise = brute_cost(plan, f, density)
                fast = signatures.plan_cost(np.array([plan], float), f, density)
                assert np.allclose([x[0] for x in fast], [cost, noise], rtol=1e-9)
                if noise * snr <= f:
                    found[plan] = cost
        got = best(idf)
        if found:
            plan = tuple(got.get(r, 0) for r in range(signatures.RANKS))
            assert found[plan] <= min(found.values()) * (1 + 1e-12)
        else:
            assert got == {0: 1}


def test_treatments_by_name():
    rows = {n: [t(0.1, 10.0)(idf) for idf in (5, 10, 20, 60)] for n, t in signatures.TREATMENTS.items() if n != "optimal"}
    assert rows["private_rank0"] == [{0: 1}] * 4
    assert rows["private_shared_rank0"] == [{0: 1}, {0: 1}, {0: 3}, {0: 7}]
    assert rows["private_shared_rank0_and_3"][2:] == [{0: 2, 3: 1}, {0: 2, 3: 5}]
    assert all(sum(r.values()) == k for r, k in zip(rows["private_shared_rank0_to_n"], (1, 1, 3, 7)))
    assert len({tuple(r.items()) for r in rows["classic_bitsliced"]}) == 1
    assert signatures.adhoc_cut("optimal", 0.1) == 0.01 and signatures.adhoc_rows(0, 0.1) == 10


def test_shards_with_a_cost_of_ones_own():
    bars = [(10, 600), (20, 600), (400, 600)]
    assert shards.optimal(bars, most=2, cost_of=lambda documents, postings: documents * postings) == [0, 400]
    assert shards.optimal(bars, most=1) == [0]
    assert shards.optimal(bars, most=3, cost_of=shards.padded_cost(least_capacity=2000)) == [0]


def test_unsigned_rows(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    got = [r[0] for r in df.select(scalar.unsigned_mod(F.col("h"), F.lit(1000))).collect()]
    assert got == [v % 2**64 % 1000 for v in values]
    with pytest.raises(ValueError):
        scalar.shared_row(F.col("h"), 64, F.lit(10))
    for bad in ("__import__('os')", "a if b else c", "'x'"):
        with pytest.raises(ValueError):
            scalar.arithmetic(bad)
    assert df.limit(1).select(scalar.arithmetic("10 - 4 - 3"), scalar.arithmetic("-(2 + 2) * 2 / 4")).first()[:] == (3.0, -2.0)


def test_files(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", LongType())])
    path = str(tmp_path / "f.csv")
    with open(path, "w") as f:
        f.write('# made by hand\n#Fields: b, a\n1,"x, y"\n# a comment\n2,z\n')
    assert [tuple(r) for r in delimited.read_fields_csv(spark, path, schema).collect()] == [("x, y", 1), ("z", 2)]
    with pytest.raises(ValueError):
        delimited.read_fields_csv(spark, path, StructType(schema.fields[:1]))
    df = spark.createDataFrame([("a\tb", 1)], schema)
    with pytest.raises(Exception, match="a line feed or tab"):
        delimited.write_csv(df, str(tmp_path / "t"), sep="\t")
    with pytest.raises(ValueError):
        delimited.save_statistics(df, str(tmp_path), "DocFreqTable")
    delimited.save_statistics(df, str(tmp_path), "DocFreqTable", 2)
    assert delimited.load_statistics(spark, str(tmp_path), "DocFreqTable", 2).count() == 1


def test_logs_and_corpora(spark):
    assert synthetic.number_words(921_015) == "nine hundred twenty one thousand fifteen" and synthetic.number_words(40) == "forty"
    log = synthetic.query_log(["a", "b", "c"], 50, seed=4)
    assert log == synthetic.query_log(["a", "b", "c"], 50, seed=4) and len(log) == 50 and all(1 <= len(q.split()) <= 8 for q in log)
    assert synthetic.with_phrases(["a", "a b"]) == ["a b", '"a b"']
    assert sum(r.blocks for r in synthetic.row_access(spark, 1000, 0.1, 6).collect()) == 1000
    assert len(synthetic.zipf_lengths(100, 10_000, 7)) == 7


def test_summaries_without_rows(spark):
    none = spark.createDataFrame([], "query string, succeeded boolean, matches long, plan_s double, match_s double")
    assert batch.timing_summary(none).first().queries == 0
    one = spark.createDataFrame([(5,)], "v int").agg(*statistics.accumulate("v")).first()
    assert (one["count"], one["mean"], one["var"]) == (1, 5.0, 1.0)
    zero = spark.createDataFrame([], "v int").agg(*statistics.accumulate("v")).first()
    assert zero["count"] == 0 and zero["mean"] is None
    pairs = spark.createDataFrame([("q", 1)], "query string, doc_id long")
    assert verify.summary(verify.compare(pairs, pairs.limit(0))).first().false_negatives == 1


def test_grams_of_each_size(spark):
    docs = text.documents(spark.createDataFrame([(1, "a b a b c"), (2, "a"), (3, "")], "doc_id long, text string"))
    got = {(r.doc_id, r.gram, r.gram_size) for r in text.postings(docs, 3).collect()}
    assert got == {(1, g, len(g.split())) for g in ("a", "b", "c", "a b", "b a", "b c", "a b a", "b a b", "a b c")} | {(2, "a", 1)}
    assert {r.gram for r in text.postings(docs, 2, exact=True).collect()} == {"a b", "b a", "b c"}


@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_a_file_and_of_a_folder(spark, tmp_path, folder):
    from termweave.plans.catalog import QUERIES

    docs = spark.createDataFrame([(1, "red red car"), (2, "blue"), (3, ""), (4, "a b c")], "doc_id long, text string")
    if folder:
        docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        docs.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["stream_ingest"](spark, str(tmp_path)).collect()} == {(1, 2), (2, 1), (3, 0), (4, 3)}


def test_a_gram_is_written_once_for_many_documents(spark, corpus, held):
    want = {(w, r.doc_id, tuple(i for i, x in enumerate((r.text or "").split()) if x == w)) for r in corpus.collect() for w in (r.text or "").split()}
    assert {(r.gram, r.doc_id, tuple(r.places)) for r in held.postings.collect()} == want
    assert held.blocks.count() <= 6 * 4 * 4 < len(want)  # grams, tasks that read and parts at most
    numbers = {r.doc_id: r.doc_index for r in held.documents.collect()}
    assert all([numbers[d] for d in r.doc_ids] == list(itertools.accumulate(r.steps)) and r.df == len(r.doc_ids) for r in held.blocks.collect())


def test_grouping_and_merging_of_postings(monkeypatch):
    import pyarrow as pa

    from termweave.plans import index

    rng, want, packed = random.Random(5), Counter(), {}
    for part in range(3):
        rows = [{"doc_id": 100 * part + i, "lang": rng.choice(["x", "y", None]), "a": rng.choices(["u", "v", "größe", None], k=rng.randrange(9)), "b": rng.choices("uw", k=rng.randrange(3)) if i else None} for i in range(20)]
        for r in rows:
            for s, c in ((1, "a"), (2, "b")):
                for i, g in enumerate(r[c] or []):
                    if g:
                        want[s, g, r["lang"], r["doc_id"], i] += 1
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string()))])
        for k, data in index._grouped(pa.Table.from_pylist(rows, schema), {1: "a", 2: "b"}, ("lang",), 3):
            packed.setdefault(k, []).append(data)
    for longest in (1 << 16, 7):
        monkeypatch.setattr(index, "LONGEST", longest)
        got, rows = Counter(), 0
        for k, held in packed.items():
            for t in index._merged(k, held, ["doc_id", "lang"], ("lang",)):
                for r in pa.table(t).to_pylist():
                    rows += 1
                    assert r["bucket"] == k == index.buckets_of(pa.array([r["gram"]]), 3)[0] and r["df"] == len(r["doc_ids"]) == len(r["ends"]) and len(r["places"]) < longest + 9
                    for d, a, b in zip(r["doc_ids"], [0, *r["ends"]], r["ends"]):
                        got.update((r["stream"], r["gram"], r["lang"], d, i) for i in r["places"][a:b])
        assert got == want and (rows == len({x[:3] for x in want}) if longest > 7 else rows > len({x[:3] for x in want}))


def test_queries_on_documents_write_no_postings(spark, tmp_path):
    from termweave.plans import catalog

    texts = [" ".join(f"w{i}" for i in range(n)) for n in (25, 3, 40)]
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ids(catalog.QUERIES["filter_first_n"](spark, str(tmp_path))) == [0, 2]
    assert not any(name == "documents" and at == str(tmp_path) for _, at, name in catalog._built)
    assert ids(catalog.QUERIES["match_phrase2"](spark, str(tmp_path))) == []
    found = catalog.index(spark, str(tmp_path))
    assert {r.doc_id: r.doc_index for r in found.numbered.collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize(("pairs", "cells"), [(1 << 21, 1 << 26), (7, 3 << 13)])
def test_bits_of_blocks(monkeypatch, pairs, cells):
    import pyarrow as pa

    monkeypatch.setattr(signatures, "PAIRS", pairs)
    monkeypatch.setattr(signatures, "CELLS", cells)
    rng, want, packed = random.Random(6), Counter(), {}
    for _ in range(3):
        rows = []
        for _ in range(30):
            shared = [(rng.choice((0, 3)), rng.randrange(20)) for _ in range(rng.randrange(4))]
            private = [(rng.choice((0, 3)), f"p{rng.randrange(5)}") for _ in range(rng.randrange(2))]
            docs = sorted(rng.sample(range(3 * signatures.CHUNK), rng.randrange(1, 12)))
            rows.append({"shared": [8 * n + r for r, n in shared], "private": [f"{r}{n}" for r, n in private], "steps": [b - a for a, b in zip([0, *docs], docs)]})
            want.update({(r, n if isinstance(n, str) else f"s{n}", d >> r) for r, n in shared + private for d in docs})
        schema = pa.schema([("shared", pa.list_(pa.int32())), ("private", pa.list_(pa.string())), ("steps", pa.list_(pa.int32()))])
        for k, data in signatures._dealt(pa.Table.from_pylist(rows, schema)):
            packed.setdefault(k, []).append(data)
    got = set()
    for k, held in packed.items():
        for r in (r for b in signatures._matrix(k, held) for r in b.to_pylist()):
            assert r["ones"] == sum(bin(w % 2**64).count("1") for w in r["words"]) and len(r["words"]) == signatures.CHUNK // 64 >> r["rank"]
            got |= {(r["rank"], r["row"], (k * signatures.CHUNK >> r["rank"]) + 64 * i + b) for i, w in enumerate(r["words"]) for b in range(64) if w >> b & 1}
    assert got == set(want)


def test_densities_of_rows_and_columns(spark, tmp_path):
    from termweave.plans import catalog

    rng = random.Random(8)
    texts = [" ".join([*rng.choices("abcdefg", k=rng.randrange(6)), f"x{i}", f"y{i // 9}"]) for i in range(150)]
    docs = [(7 * i, t, "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")

    def rows(name):
        return catalog.QUERIES[name](spark, str(tmp_path)).collect()

    sizes = {r["rank"]: r.rows for r in rows("index_size")}
    assert not any(name == "bits" and at == str(tmp_path) for _, at, name in catalog._built)  # index_size and term_rows ask for none
    own = {}
    for r in rows("term_rows"):
        own.setdefault(r.gram, set()).add((r["rank"], r["row"]))
    bits = {(*row, i >> row[0]) for i, t in enumerate(texts) for g in set(t.split()) for row in own[g]}
    assert sizes == {k: len({row for s in own.values() for row in s if row[0] == k}) for k in sizes}
    ones = Counter(b[:2] for b in bits)
    assert {(r["rank"], r["row"]): r.ones for r in rows("signature_density")} == ones
    share = {k: n / -(-150 // 2 ** k[0]) for k, n in ones.items()}
    df = Counter(g for t in texts for g in set(t.split()))
    assert {(r.gram, r.frequency, r["rank"], r["row"], r.density) for r in rows("row_density_report")} == {(g, round(df[g] / 150, 9), *k, round(share[k], 9)) for g, s in own.items() for k in s}
    up = Counter((r, run) for r, _, run in bits)
    assert {(r.doc_id, r["rank"], r.density) for r in rows("column_density")} == {(7 * i, k, round(up[k, i >> k] / n, 9)) for i in range(150) for k, n in sizes.items()}
    plan = catalog.QUERIES["row_density_report"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_numbers_over_all_rows_cross_one_shuffle(spark):
    df = spark.createDataFrame([(f"g{i % 97}", i % 13, i / 7) for i in range(300)], "gram string, df long, frequency double")
    ordered = statistics.by_frequency(df)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1  # the rows before each task alone
    assert [r.place for r in ordered.orderBy(F.desc("df"), "gram").collect()] == list(range(300))
    assert statistics.frequency_breaks(ordered).count() > 0 and statistics.frequency_breaks(ordered.withColumn("frequency", F.col("df") / 300)).count() == 0


def test_correlation_of_rows(spark):
    rng = random.Random(9)
    own = {f"g{i}": [(rng.choice((0, 3)), f"s{rng.randrange(6)}") for _ in range(rng.randrange(1, 6))] for i in range(60)}
    sets = spark.createDataFrame([(g, [(*x, False) for x in s]) for g, s in own.items()], "gram string, sets array<struct<rank:int,row:string,private:boolean>>")
    want = {(a, b): n for a in own for b in own if a < b and (n := len(set(own[a]) & set(own[b])))}
    for least in (1, 2):
        assert {(r.left, r.right): r.shared for r in signatures.correlation(sets, least).collect()} == {k: n for k, n in want.items() if n >= least}
    got = signatures.correlation_histogram(sets)
    assert {r.shared: r.pairs for r in got.collect()} == Counter(want.values()) and max(want.values()) > 2
    assert got.dtypes == [("shared", "bigint"), ("pairs", "bigint")]
    for part in (sets.limit(1), sets.where("gram = 'none'")):
        assert signatures.correlation_histogram(part).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "slice(names" in plan  # pairs are met by two rows, not by one


def test_tables_of_bounded_size():
    import pyarrow as pa

    from termweave.functions.blocks import gathered, starts, steps, summed

    sizes = [0, 3, 4, 0, 50, 1, 1, 1, 7, 0, 20, 2, 3, 0]
    rows = [{"a": None if n == 0 else [0] * (n // 2), "b": [1] * (n - n // 2)} for n in sizes]
    kinds = pa.schema([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 5], kinds) for i in range(0, len(rows), 5)]
    got = [t.to_pylist() for t in gathered(iter(batches), ["a", "b"], 10)]
    assert [r for t in got for r in t] == rows
    counts = [sum(len(r["a"] or []) + len(r["b"]) for r in t) for t in got]
    assert all(n <= 10 or sum(bool(r["b"]) for r in t) == 1 for n, t in zip(counts, got)) and max(counts) == 50
    values, held = np.array([5, 6, 9, 2, 2, 8]), np.array([3, 0, 1, 2])
    assert list(steps(values, held)) == [5, 1, 3, 2, 2, 6] and list(summed(steps(values, held), held)) == list(values) and list(starts(held)) == [0, 3, 3, 4, 6]
