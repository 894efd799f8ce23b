"""Byte-level BPE against the public library and by round trips."""

import pytest

from textlake.operators import bytebpe

TEXTS = ["The cat sat on the mat, the cat's hat. 我们的书在桌上，我们的笔。", "the thin  cat\n\nthat 2024 2023 hat's", "Ａｂｃ é naïve 🙂 我们", "", None, "   ", "<eos> is text here"] * 2


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    return df, bytebpe.train(df, "text", 4 + 256 + 25)


def test_merges_are_those_of_the_library(trained):
    tokenizers = pytest.importorskip("tokenizers")
    import unicodedata

    t = tokenizers.Tokenizer(tokenizers.models.BPE())
    t.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    trainer = tokenizers.trainers.BpeTrainer(vocab_size=4 + 256 + 25, min_frequency=2, special_tokens=list(bytebpe.SPECIALS), initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet(), show_progress=False)
    t.train_from_iterator([unicodedata.normalize("NFKC", x) for x in TEXTS if x], trainer)
    shown = {c: b for b, c in zip(bytebpe.byte_order(), sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet()))}
    import json

    want = [tuple(bytes(shown[c] for c in p) for p in (m if isinstance(m, list) else m.split(" "))) for m in json.loads(t.to_str())["model"]["merges"]]
    vocabulary = trained[1]
    assert len(want) == 25 and list(vocabulary.merges) == want
    ids = {bytes(shown[c] for c in k): v for k, v in t.get_vocab().items() if k not in bytebpe.SPECIALS}
    assert ids == vocabulary.ids()


def test_round_trips_and_separators(trained):
    df, v = trained
    rows = bytebpe.decode(bytebpe.encode(bytebpe.encode(df, v), v, out="stream", separator="<eos>"), v).collect()
    for r in rows:
        assert r.decoded == r.text and (r.stream == (None if r.text is None else [*r.ids, 3]))
    assert any(len(r.ids) < len(r.text.encode()) for r in rows if r.text)


def test_preview(trained):
    df, v = trained
    got = {}
    for r in bytebpe.preview(bytebpe.encode(df, v), v, "i").collect():
        got.setdefault(r.i, []).append(r)
    for i, t in enumerate(TEXTS):
        rows = sorted(got.get(i, []), key=lambda r: r.position)
        assert [r.start for r in rows] == [0, *(r.end for r in rows)][: len(rows)]
        assert not t or rows[-1].end == len(t.encode())
    assert {r.kind for rows in got.values() for r in rows} >= {"word", "bytes", "number", "mark", "blank"}


def test_empty(spark):
    d = spark.createDataFrame([], "i int, text string")
    v = bytebpe.train(d, "text", 300)
    assert v.merges == () and bytebpe.decode(bytebpe.encode(d, v), v).count() == 0
