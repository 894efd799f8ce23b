"""Problems 6, 8 and 9."""

import collections
import os
import random

import numpy as np
import pytest

from textlake.llm import packing, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabularies here")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    e = tokens.encoder(PATH)
    out = []
    for part in tokens.chunks(texts):
        flat, sizes = e.encode(part)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out += [flat[at[i] : at[i + 1]].tolist() for i in range(len(part))]
    return out


def test_encoding_equals_the_library():
    rng = random.Random(3)
    alphabet = " \n\t\r'sStlrevmd 中文a1!　é́²'ll_-<|endoftext|>👍🏽‍\x85"
    texts = ["", " ", "  ", "'s", " 's", "'s's", "''s", "don't 'really' we'll", "a  b", "\n\n x", "<|endoftext|>", "x" * 5000, "中" * 3000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert ours(texts) == reference(texts)


def test_merge_slice_equals_the_library():
    e = tokens.encoder(PATH)
    for s in ("hello", "中文没有标点符号", "aaaaaaaaaa", "日本語のテキスト", "é" * 9):
        assert tokens.merge_slice(s.encode(), e.ranks) == e.library._encode_single_piece(s.encode())


def test_round_trip_and_defined_ids(spark):
    rows = [(1, "héllo 世界\n"), (2, ""), (3, None), (4, "x" * 2000), (5, "héllo 世界\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids", "2 as k")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got[2] == [] and got[3] == [] and got[1] == got[5] == reference(["héllo 世界\n"])[0]
    back = {r.doc_id: r for r in tokens.decode(tokens.encode(df)).collect()}
    assert back[1].text == "héllo 世界\n" and back[4].text == "x" * 2000 and back[1].offsets[0] == 0
    assert tokens.encode(df.limit(0)).count() == 0


def test_token_budget(spark):
    rows = [("a", "wiki", {"lang": "中文"}, "你好"), ("a", "wiki", {"lang": "zh-CN"}, "你好"), ("a", "wiki", {"lang": "EN"}, "hello there"), (None, None, None, None), ("a", "wiki", {}, "plain words"), ("b", "wiki", {"lang": "zh"}, "你好")]
    df = spark.createDataFrame(rows, "source_name string, source_type string, metadata map<string,string>, text string").selectExpr("*", "'x' as h", "0 as copies")
    got = {(r.source_name, r.language, r.domain): (r.documents, r.distinct_documents, r.tokens) for r in tokens.token_budget(df).collect()}
    n = {t: len(reference([t])[0]) for t in ("你好", "hello there", "plain words")}
    assert got == {("a", "zh", "wiki"): (2, 1, 2 * n["你好"]), ("a", "en", "wiki"): (2, 2, n["hello there"] + n["plain words"]), (None, "und", None): (1, 1, 0), ("b", "zh", "wiki"): (1, 1, n["你好"])}


def test_packing_is_valid_and_tight():
    rng = np.random.default_rng(1)
    for capacity in (64, 512):
        sizes = np.minimum(rng.geometric(0.02, 4000), capacity)
        where, space = packing.pack(sizes, capacity)
        used = np.bincount(where, weights=sizes, minlength=len(space))
        assert (where >= 0).all() and (used + space == capacity).all() and (space >= 0).all()
        assert len(space) <= -(-sizes.sum() // capacity) + 2


def test_two_replace_the_smallest():
    # Greedy fills 10 with 7 + 2; the pair 1 + 2 does better than 2 in the gap of 3.
    where, space = packing.pack(np.array([7, 2, 2, 1]), 10)
    assert sorted(space.tolist())[0] == 0


def test_documents_lie_whole_unless_too_large(spark):
    rows = [(1, 1000), (2, 30), (3, 0), (4, None), (5, 70), (6, 64), (7, 30), (7, 30)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' as container")
    caps = spark.createDataFrame([("c64", 64), ("bad", None), ("zero", 0)], "container string, capacity_tokens int")
    got = packing.pack_documents(sizes.drop("container"), caps).collect()
    assert {r.container for r in got} == {"c64"}
    per = collections.Counter()
    for r in got:
        per[r.doc_id] += r.tokens
    assert per == {1: 1000, 2: 30, 3: 0, 4: 0, 5: 70, 6: 64, 7: 60}
    fill = collections.defaultdict(int)
    for r in got:
        fill[r.container_id] += r.tokens
    assert all(fill[r.container_id] + r.space_left == 64 for r in got)
    parts = collections.Counter(r.doc_id for r in got)
    assert parts[1] == 16 and parts[5] == 2 and parts[2] == 1
    assert packing.pack_documents(sizes.drop("container").limit(0), caps).count() == 0


def test_queries_run(spark, data):
    ids = {r.doc_id: r.ids for r in tokens.p8_ids(spark, data).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert ids == dict(zip(texts, reference(list(texts.values()))))
    assert tokens.p6_tokens(spark, data).count() > 0
    assert packing.p9_fill(spark, data).where("fill < 0.9").count() == 0
