from __future__ import annotations

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm import token_counts
from tests.llm.conftest import DOCUMENTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(PATH, token_counts.ByteLevel(PATH).whole_tokens())


def expected(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_every_proven_token_is_one_token_and_no_other_is(library):
    whole = token_counts.ByteLevel(PATH).whole_tokens()
    # A string that the pattern cuts up can't be met as a piece; all others must be one token.
    import regex

    met = [text for text in whole if regex.fullmatch(token_counts.PIECES, text)]
    assert len(met) > 40_000
    assert {len(x.ids) for x in library.encode_batch(met, add_special_tokens=False)} == {1}
    assert "<|endoftext|>" not in whole
    assert "zqxj" not in whole


def test_libraries_class_settled_characters_alike(library):
    import regex

    pieces = regex.compile(token_counts.PIECES)
    draw = random.Random(5)
    for sign in draw.sample(sorted(token_counts.settled_characters()), 30_000):
        text = f"a{sign}1{sign}!{sign}\n{sign}"
        cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert cut == pieces.findall(text), hex(ord(sign))


def test_pieces_are_spelt_as_the_library_spells_them():
    from tokenizers import pre_tokenizers

    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for text in [chr(c) for c in range(1, 0x500)] + ["日本", "🎉 a", "\x00"]:
        assert token_counts.spelt(text) == level.pre_tokenize_str(text)[0][0]


def test_counts_equal_the_library_on_hostile_texts(library, counter):
    draw = random.Random(9)
    parts = [
        "<|endoftext|>", "<|endoftext|", "<|", " ", "  ", "\n", "\r\n", "\t", " ", "　", "\x00", "\x1c",
        "don't", "WE'LL", "'s", "''", "naïve", "Straße", "日本語", "한국어", "🎉", "👩‍👩‍👧", "\U0001fae8", "՘",
        "\U00031350", "é", "é", "12345", "٣٤", "½", "x" * 70, "ab" * 40, "!!!", "...", "—", "word", " The",
    ]
    for _ in range(4_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert counter.count(text) == expected(library, text), repr(text)


def test_cuts_between_blocks_change_nothing(library, counter, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 7)
    for text in ("a  b   c \n d  e", "one two  three\n\n four", "   ", "x" * 50, "né à  ça   il"):
        assert counter.count(text) == expected(library, text)


def test_forgetting_merged_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_KEPT", 3)
    small = token_counts.TokenCounter(PATH, token_counts.ByteLevel(PATH).whole_tokens())
    text = " ".join(f"zq{i}xj{i} kvw{i}" for i in range(50))
    assert small.count(text) == expected(library, text)


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.ByteLevel(public_tokenizers.path("word_bpe_49k.json"))


def test_edge_rows_and_columns(spark, edge_documents, library):
    found = token_counts.count_tokens(edge_documents, PATH, 512)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = sorted(tuple(row) for row in found.select(*found.columns).fillna(-1).collect())
    wanted = []
    for row in edge_documents.select("doc_id", "text").collect():
        tokens = expected(library, row.text)
        wanted.append((-1 if row.doc_id is None else row.doc_id, len((row.text or "").encode()), tokens, tokens > 512))
    assert rows == sorted(wanted)
    assert any(row[3] for row in rows)


def test_no_documents(spark, no_documents):
    assert token_counts.count_tokens(no_documents, PATH, 512).collect() == []


def test_given_documents_equal_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {row.doc_id: row.n_tokens for row in token_counts.count_tokens(docs, PATH, 512).collect()}
    assert found == {row.doc_id: expected(library, row.text) for row in docs.collect()}
    assert DOCUMENTS.names == docs.columns
