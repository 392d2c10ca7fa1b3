"""The pipeline against brute force: what each stage lets through, row by row."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_dedup import brute
from test_llm_scan import ASSIGN, contained

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _key string"
BAD = ["grumbler", "nastyhead", "fouldog"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    words = [f"{a}{b}{c}" for a in ("tion", "ment", "er", "and", "the") for b in ("al", "ist", "en", "or") for c in ("", "s", "ed")]
    text = lambda n: " ".join(str(w) for w in rng.choice(words, n))
    rows, labels = [], []
    for k in range(160):
        some = text(60).split()
        if k % 4 == 0:
            for at in rng.integers(0, 60, 4):
                some[at] = str(rng.choice(BAD))
        rows.append((k, " ".join(some)))
        labels.append((k, 1, int(k % 4 == 0)))
    item = text(30)
    clean = rows[1][1]
    rows += [(1000, clean), (1, clean), (1, "another text under the same id " + text(40)), (1001, clean + " end"), (1002, "long " + text(200) + " " + item + " " + text(200)), (1, item + " and more"), (None, text(50)), (None, None), (1003, ""), (1003, "")]
    rows += [(1004, 'see password = "abcdef123" here ' + text(30)), (1005, " ".join(BAD) + " " + text(20))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def pairs(frame):
    return sorted(((str(r.doc_id), str(r.text)) for r in frame.select("doc_id", "text").collect()))


def test_every_stage_lets_through_what_it_should(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(pipeline.STAGES)

    def through(name, frame):
        out = stages[name](spark, frame, folder)
        assert out.columns == columns
        out.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return spark.read.parquet(f"{folder}/{name}.parquet")

    bad = lambda t: any(w in BAD for w in (t or "").split())
    kept = through("toxicity", docs)
    clean = [(i, t) for i, t in rows if not bad(t)]
    assert pairs(kept) == sorted((str(i), str(t)) for i, t in clean)

    kept = through("near_dedup", kept)
    classes = brute(dict(enumerate(t for _, t in clean)))
    want = {}
    for k, (i, t) in enumerate(clean):
        n, top = classes[k]
        want.setdefault(top if n else ("empty", k), []).append((i is None, i or 0, str(i), str(t)))
    assert pairs(kept) == sorted(min(group)[2:] for group in want.values())

    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    kept = through("decontamination", kept)
    assert pairs(kept) == sorted((str(i), str(t)) for i, t in left if contained(t, item) is None)
    assert len(left) - kept.count() == 2 and ("1", clean[1][1]) not in pairs(kept)

    before = {(str(r.doc_id), r.text) for r in kept.collect()}
    kept = through("secrets", kept)
    every = [r.text for r in kept.collect()]
    after = {(str(r.doc_id), r.text): r.n_chars for r in kept.collect()}
    redacted = [(i, t) for i, t in after if "[secret]" in (t or "")]
    assert len(after) == len(before) and len(redacted) == 1 and redacted[0][0] == "1004" and not ASSIGN.search(redacted[0][1])
    assert {x for x in before if x[0] != "1004"} == {x for x in after if x[0] != "1004"} and after[redacted[0]] == len(redacted[0][1])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(pipeline.VOCABULARY))
    packed = stages["packing"](spark, kept, folder).toPandas()
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in every]
    assert packed.length.sum() == sum(sizes) and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    one = packed[packed.doc_id == 1004]
    ids = np.array(tokenizer.encode(redacted[0][1], add_special_tokens=False).ids + [1], dtype="<u4")
    assert [r.ids_crc32 for r in one.sort_values("start").itertuples()] == [zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes()) for r in one.sort_values("start").itertuples()]


def test_empty_tables_pass_through(spark, corpus):
    folder, _, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES[1:]:
        assert stage(spark, none, folder).count() == 0, name
    assert pipeline.drop_toxic(spark, none.withColumn("more", F.lit(1)), folder).columns[-1] == "more"
