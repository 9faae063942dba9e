"""Each stage of the pipeline against brute force, and the whole on odd rows."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from termweave.llm import common, mixing, neardup, packing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASH = ["t", "row", "k", "k2", "t2", "id", "own", "n", "c", "key", "lot", "size", "each", "from", "kept", "class_size", "bands", "names", "_t", "_h", "_k", "_k2", "toxic", "score", "length", "piece", "rank", "cell", "target"]


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))

    passage = prose(120)  # over 400 bytes
    out = [None, "", " ", "a", "é" * 30_000, prose(12), "You idiot. You are a moron. " + prose(20), "I will kill you. " * 4 + prose(20)]
    for _ in range(4):
        base = prose(150)
        near = base.split()
        near[70] = "changed"
        out += [base, base, " ".join(near)]
    out += [f"{prose(50)} {passage} {prose(40)}" for _ in range(5)]
    return out + [prose(rng.randint(20, 200)) for _ in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", [None, "é", "a", "z"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Documents with repeated rows and null ids, and labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd = [(None, "same words " * 60, None, None, None), (None, "same words " * 60, None, None, None), (3, "a", "x", "z", 1), (None, None, None, None, None)]
    docs.union(spark.createDataFrame(odd, SCHEMA)).union(docs.where("doc_id IN (8, 20)")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(6, 1, 1), (7, 1, 1), (8, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_toxic_documents_go(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")  # the seed words and the priors hold
    counts = toxicity._matched(pa.RecordBatch.from_pydict({"text": pa.array(texts(), pa.string())}), toxicity.Model())
    bad = set(np.flatnonzero(toxicity.Model().score(counts) >= 0.5).tolist())
    assert {6, 7} <= bad
    assert {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()} == set(range(len(texts()))) - bad


def test_one_document_of_each_group_stays(spark, docs, folder):
    bags = [Counter(neardup.shingles(pa.array([t], pa.string()))[0].tolist()) for t in texts()]
    want = [i for i, b in enumerate(bags) if not any(b and bags[j] and neardup._overlap(b, bags[j]) >= 0.8 for j in range(i))]
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect()) == want
    # repeated rows, also those without an id, are copies; rows without words all stay
    got = Counter(r.doc_id for r in neardup.drop_near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")).collect())
    assert got == Counter([*want, None, None])


def test_repeated_passages_go(spark, docs):
    bodies, n = [(t or "").encode() for t in texts()], 400
    count = Counter(b[i : i + n] for b in bodies for i in range(len(b) - n + 1))
    for r in corpus_pipeline.suffix_duplicates(spark, docs, "").collect():
        b = bodies[r.doc_id]
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        want = bytes(x for x, c in zip(b, cover) if not c).decode("utf-8", "ignore")
        assert (r.text or "") == want and r.n_chars == len(want) and (r.text is None) == (texts()[r.doc_id] is None)


def test_repeated_passages_of_51_words_go(spark):
    rng = random.Random(9)
    new = iter(rng.sample([a + b + c for a in "abcdefghij" for b in "aeioué" for c in "klmnopqrst"], 600))

    def prose(n):
        return " ".join(next(new) for _ in range(n))

    passage, tiny, short, first, second = prose(51), " ".join("xyzabcdefg"[k % 10] if k % 3 else "q" for k in range(51)), prose(50), prose(30), prose(30)
    assert len(passage.encode()) < 400 and len(tiny) == 101  # the least that 51 words can have
    cases = [  # text, what stays
        (f"{(a := prose(20))} {passage} {(b := prose(9))}", f"{a}  {b}"), (f"{(c := prose(3))}\n{passage}", f"{c}\n"),
        (f"{(d := prose(5))} {tiny} {(e := prose(5))}", f"{d}  {e}"), (f"{tiny}\t{(g := prose(4))}", f"\t{g}"),
        *((t, t) for t in (f"{prose(8)} {short} {prose(9)}", f"{prose(7)} {short} {prose(8)}")),  # 50 words stay
        *((t, t) for t in (f"{prose(2)} {first} {second} {prose(2)}", f"{first} {prose(3)}", f"{prose(3)} {second}")),  # so do neighbours
        (copy := prose(55), ""), (copy, ""), (None, None), ("", ""),
    ]
    df = spark.createDataFrame([(i, t, "x", "a", len(t or "")) for i, (t, _) in enumerate(cases)], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_duplicates(spark, df, "").collect()}
    assert got == {i: (t, len(t or "")) for i, (_, t) in enumerate(cases)}


def test_a_worker_holds_little_for_signatures(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(400), "text": [" ".join(rng.choices(words, k=1400)) for _ in range(400)], "t": [b""] * 400})
    monkeypatch.setattr(common, "_pow", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    tracemalloc.start()
    got = pa.Table.from_batches(neardup._signed(iter([batch]), neardup.BANDS, neardup.ROWS))
    left, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(got) == 400 and got["bands"].combine_chunks().flatten().equals(pa.array(neardup.signatures(batch.column("text"))[0].reshape(-1)))
    assert peak < 100e6 and left < 30e6  # the batch at once took 178
    common.Prefix(np.zeros(common.SLICE_BYTES + 2, np.uint8))  # a longer document's powers go with it
    assert len(common._pow[0]) <= common.SLICE_BYTES + common._POWER_STEP


def test_a_worker_keeps_few_words():
    enc = packing.WordCache(*packing.tokenizer_files())
    texts = [" ".join(f"w{k}" for k in range(i, i + 40_000)) for i in range(0, 600_000, 40_000)]
    tracemalloc.start()
    for t in texts:
        ids, _ = enc.encode(pa.array([t]))
    left, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert ids.tolist() == enc.encode_slow(texts[-1]).tolist()
    assert len(enc.known) <= 250_000 and left < 60e6


def test_mixed_rows_follow_the_mix(docs):
    want = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix_sources(docs).collect() if r.taken}
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs).collect()) == want
    got = mixing.mixed_documents(docs.where("doc_id > 4").union(docs.where("doc_id > 4"))).groupBy("doc_id").count().collect()
    assert got and all(r["count"] % 2 == 0 for r in got)  # repeated rows share their takes


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_clashing_columns(spark, docs, folder, k):
    name, step = corpus_pipeline.STAGES[k]
    plain = step(spark, docs, folder)
    wide = docs
    for c in CLASH:
        wide = wide.withColumn(c, wide.doc_id)
    got = step(spark, wide, folder)
    assert got.columns == wide.columns and plain.columns == docs.columns
    assert rows(got.select(docs.columns)) == rows(plain)
    assert all(r[c] == r.doc_id for r in got.collect() for c in CLASH)
    none = step(spark, spark.createDataFrame([], SCHEMA), folder)
    assert none.columns == docs.columns and none.count() == 0


def test_whole_pipeline(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {r.doc_id for r in got}
    assert not ids & {6, 7} and {5, 8, 25} <= ids and 9 not in ids and 10 not in ids
    assert rows(corpus_pipeline.run(spark, folder)) == sorted(tuple(str(x) for x in r) for r in got)
