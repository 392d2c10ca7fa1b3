import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from switchyard.llm.packing import Encoder, Packing, hilbert, pack
from switchyard.llm.sharding import Splitters, shard

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_hilbert_visits_every_cell_by_unit_steps():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = hilbert(grid, 3)
    walk = grid[np.argsort(key)]
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_every_id_lies_in_one_piece(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(50, "a <|endoftext|> b"), (51, "ΣΑΣ İstanbul é ﬁ don't x\x1cy 12.5%"), (52, "...!!? ..a.. 'sx s' '")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = pack(rows, Packing(path)).toPandas()
    bare, twice = (got[got.doc_id.isna()], got[got.doc_id == 2])
    ids_of = lambda doc: len(tokenizer.encode(texts[doc], add_special_tokens=False).ids) + 1
    assert bare.length.sum() == ids_of(None) and twice.length.sum() == 2 * ids_of(2) and set(twice.doc_tokens) == {ids_of(2)}
    for doc, part in got[(got.doc_id != 2) & got.doc_id.notna()].groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[int(doc)], add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in part.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[int(r.start) : int(r.start + r.length)].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        total = int(s.length.sum())
        assert total <= 2048 and total & (total - 1) == 0 and list(s.offset) == list(np.cumsum(s.length) - s.length)
    assert pack(none, Packing(path)).count() == 0


def test_ids_are_those_of_the_tokenizer_on_any_letters():
    """Letters that lower-casing or composing turns into several signs, marks after them, and signs of all planes."""
    encoder, rng = Encoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    odd_signs = list("abXYéÉİßﬁΣςıſKǅ日ا्ก1²Ⅷ.,|!?;:'-%") + ["\u0301", "\u0307", "\u0345", "\u200d", "\x1c", "\x85", "\U0001d400", " ", "  "]
    planes = [(32, 0x24F), (0x250, 0x2FFF), (0xA640, 0xABFF), (0xF900, 0xFFEF), (0x10400, 0x1FFFF)]
    assert encoder.split
    for k in range(40):
        sign = (lambda: rng.choice(odd_signs)) if k % 2 else (lambda: chr(rng.randint(*rng.choice(planes))) if rng.random() < 0.6 else rng.choice("ab.!|, "))
        some = ["".join(sign() for _ in range(rng.randint(1, 14))) for _ in range(500)] + ["SAHİBİ. İ! bYéİ|"]
        assert encoder.encode([x.encode() for x in some]) == encoder.direct(some)


def counted(encoder: Encoder) -> list[list[str]]:
    """The words of every string that goes to the tokenizer from now on."""
    seen, direct = [], encoder.direct
    encoder.direct = lambda some: seen.extend(x.split() for x in some) or direct(some)
    return seen


def test_words_are_encoded_together_and_the_signs_after_them_apart():
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["".join(w) for w in itertools.product("aeiouéà", "bcdstß", "lmnr", "éao")]
    some = [f"{w} {w}, {w}*** {w.upper()},###" for w in words]
    plain = encoder.direct(some)
    seen = counted(encoder)
    assert encoder.encode([x.encode() for x in some]) == plain and len(seen) < 10 and encoder.encode([x.encode() for x in some]) == plain and len(seen) < 10


def test_common_words_are_not_forgotten_with_rare_ones():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, direct = Encoder(path, limit=1000), Encoder(path).direct
    common = [f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst"]
    seen = counted(encoder)
    for k in range(12):
        rare = ["uvwxyzäöüéèç"[k] + "".join(w) for w in itertools.product("abcdefgh", "abcdefgh", "klmno")]
        some = [" ".join(common + rare), "y" * 5000 + str(k)]
        assert encoder.encode([x.encode() for x in some]) == direct(some)
    assert sum(words.count(common[0]) for words in seen) == 1
    assert len(encoder.pieces) <= 1000 and max(map(len, encoder.pieces.to_pylist())) <= 64


def test_letters_of_the_fast_way_and_the_signs_after_them():
    """Every sign after each letter of the class and its neighbours, letters in pairs, and nulls beside a special token's name."""
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x61, 0x460)) if c.isprintable()]
    some = [a + b for a in letters for b in map(chr, range(33, 127))] + [a + b + "," for a in letters[::5] for b in letters[::7]]
    assert encoder.encode([x.encode() for x in some]) == encoder.direct(some)
    odd_texts = [None, "a <|endoftext|> b", "", "a. b", None]
    assert encoder.encode_column(pa.array(odd_texts, pa.string())).to_pylist() == encoder.direct([x or "" for x in odd_texts])


def test_shards_are_even_whole_and_gapless(spark, odd, none):
    rng = np.random.default_rng(1)
    rows = [(k, "hot text of a third of all rows" if k % 3 == 0 else f"{k} " + "x" * int(rng.integers(10, 60))) for k in range(6000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), Splitters(full=50)).toPandas()
    texts = dict(rows)
    assert sorted(got.doc_id) == list(range(6000)) and set(got.law) == {"bytes"} and set(got["shard"]) == set(range(16))
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert all(zlib.crc32(texts[r.doc_id].encode()) == r.text_crc32 and r.size == len(texts[r.doc_id].encode()) + 1 for r in got.itertuples())
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.min() < 1.05
    odd_rows = shard(odd).toPandas()
    assert len(odd_rows) == odd.count() and all(sorted(s.slot) == list(range(len(s))) for _, s in odd_rows.groupby("shard"))
    assert shard(none).count() == 0


def test_shards_of_repeated_rows_and_clashing_names(spark, odd):
    """Rows that agree in all take a slot each; columns named like results or like the operator's own do not matter."""
    rows = odd.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id = 2"))
    plain = shard(rows).toPandas()
    clash = rows.selectExpr("doc_id", "text", "'x' AS size", "doc_id AS shard", "'h' AS h", "1 AS rows", "2 AS bytes", "text AS law", "0 AS slot")
    found = shard(clash).toPandas()
    key = ["doc_id", "size", "text_crc32"]
    assert sorted(map(str, plain[key].to_numpy().tolist())) == sorted(map(str, found[key].to_numpy().tolist())) and found.columns.tolist() == plain.columns.tolist()
    assert (found[found.doc_id == 2].groupby("shard").slot.nunique().sum()) == (found.doc_id == 2).sum() == 4
    assert found.doc_id.isna().sum() == 1 and all(sorted(s.slot) == list(range(len(s))) for _, s in found.groupby("shard"))
