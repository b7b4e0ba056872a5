"""Chunk-wise coding gives the library's ids for any text."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from voltrace.llm.token_output import ChunkCoder, write_token_files  # noqa: E402

PATH = public.path("word_bpe_49k.json")
MARKED = [chr(x) for x in range(0x300, 0x370)]
ODD = ["İ", "क़", "K", "Å", "ẞ", "Σ", "ς", "ﬁ", "ำ", "ཱི", "ᄀ", "ᅡ", "ᆨ", "\xa0", "\x85", "‍", "\U0001f600", "़", "ǅ", "\x1f", "ŉ", "<|endoftext|>", "<|"]


def same(coder, tokenizer, texts):
    ids, lengths = coder.encode([t.encode("utf-8") for t in texts], 1)
    at = 0
    for text, n in zip(texts, lengths.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], ascii(text)
        at += n


def test_marks_compose_before_letters_are_lowered():
    coder, tokenizer, rng = ChunkCoder(PATH), tokenizers.Tokenizer.from_file(PATH), random.Random(0)
    same(coder, tokenizer, ["J̌", "H̱. T̈!", "W̊ Y̊", "İ.", "क़.", "À á,"])
    pool = list("aAjJhHtTwWyYiI.,!?'|#&()<> \n\t09") + MARKED + ODD
    anything = [chr(x) for x in range(1, 0x30000) if not 0xD800 <= x < 0xE000]
    for _ in range(40):
        same(coder, tokenizer, ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(200)])
        same(coder, tokenizer, ["".join(rng.choice(anything if rng.random() < 0.6 else pool) for _ in range(rng.randint(0, 30))) for _ in range(100)])


def test_ids_must_be_whole_numbers(spark, tmp_path):
    with pytest.raises(TypeError, match="whole-number"):
        write_token_files(spark.createDataFrame([("a", "text")], "doc_id string, text string"), str(tmp_path / "f"), PATH)
