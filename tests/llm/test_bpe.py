"""The tokenizers library is the yardstick for the two byte-pair operators."""

import hashlib
import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from panelith.llm.bpe import Merger, StreamingWord, heap_merge, load_table
from panelith.llm.stream_bpe import StreamingDecoder, StreamingEncoder, encode_documents, pack
from panelith.llm.tables import BYTE_FILE, WORD_FILE, tokenizer_path
from panelith.llm.token_counts import TokenCounter, count_tokens
from panelith.llm.word_ids import WordEncoder

BYTE, WORD = tokenizer_path(BYTE_FILE), tokenizer_path(WORD_FILE)

ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\n b", "it's we'll 'S x'", "'r", "!!'re", "tab\t x\r\n y", "x  y 　z", "naïve Éá ΑΣ Σ ΣΑΣ İx",
    "<|endoftext|>", "a<|endoftext|> b", "<|startoftext|>x<|ENDOFTEXT|>", "日本語テキスト 12345 ²³½", "👍🏽 é́", "\x1c\x1da b\x1e", "a" * 700, " " * 900 + "x", "\n" * 300, "-" * 999, "ab" * 500 + " " + "=" * 300,
]


def random_texts(n, seed=1):
    r = random.Random(seed)
    bits = ["the", "and", " ", "  ", "\n", "'", "'ll", "é", "ß", "1", "23", "!", "?!", "\t", "日", "a", "b", "ing", "<|endoftext|>", "Σ", " ", "=", "--"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_lib():
    return Tokenizer.from_file(WORD)


def encoded(encoder, texts):
    out = [b""] * len(texts)
    for i, part in encoder.encode(texts):
        out[i] += part
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 4096, 7, 1, 300])
def test_encoder_equals_library(byte_lib, chunk):
    encoder, decoder = StreamingEncoder(BYTE, chunk=chunk), StreamingDecoder(BYTE)
    texts = ODD + random_texts(300)
    for text, got in zip(texts, encoded(encoder, texts)):
        ids = byte_lib.encode(text, add_special_tokens=False).ids
        assert got == np.array(ids, "<u4").tobytes(), text
        assert decoder.feed(ids, final=True) == byte_lib.decode(ids, skip_special_tokens=False) == text


def test_decoder_replaces_broken_text(byte_lib):
    r = random.Random(3)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(8))]
        decoder = StreamingDecoder(BYTE)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.feed((), final=True) == byte_lib.decode(ids, skip_special_tokens=False)


def test_counter_equals_library(word_lib):
    counter = TokenCounter(WORD)
    for text in ODD + random_texts(300, 2):
        assert counter.count(text) == len(word_lib.encode(text, add_special_tokens=False).ids), text


def test_every_character(byte_lib, word_lib):
    """White space, letter and number classes and lower case agree on all characters."""
    counter, encoder, words = TokenCounter(WORD), StreamingEncoder(BYTE), WordEncoder(WORD, 4)
    bad = []
    for start in range(0, sys.maxunicode + 1, 512):
        chars = [chr(c) for c in range(start, min(start + 512, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        if not chars or 0x30000 <= start < 0xE0000 or start >= 0xF0000 or 0x3400 <= start < 0x9E00 or 0xAC00 <= start < 0xD600:
            continue
        texts = [f"a{c}b {c} 1{c}2" for c in chars]
        got, ids = dict(zip(texts, encoded(encoder, texts))), dict(zip(texts, words.encode(texts)))
        for text, x, y in zip(texts, byte_lib.encode_batch(texts, add_special_tokens=False), word_lib.encode_batch(texts, add_special_tokens=False)):
            if got[text] != pack(x.ids) or counter.count(text) != len(y.ids) or ids[text] != pack(y.ids):
                bad.append(hex(ord(text[1])))
    assert not bad, (len(bad), bad[:50])


def test_window_equals_whole_word():
    """Tokens leave a window of twice the lookahead exactly as a merge of the whole word has them."""
    table, r = load_table(BYTE), random.Random(5)
    assert table.lookahead < 4096
    for letters in ("a", "ab", "-=", " \n", "etaoin", "0123", "é", "xX", "*", "_-"):
        for _ in range(6):
            raw = "".join(r.choice(letters) for _ in range(5000)).encode()
            word = StreamingWord(table)
            word.window = table.lookahead + 200
            got, at = [], 0
            while at < len(raw):
                step = r.randrange(1, 900)
                got += [t for part in word.push(raw[at : at + step], final=at + step >= len(raw)) for t in part]
                assert len(word.held) <= word.window
                at += step
            assert got == heap_merge([table.first[b] for b in raw], table.merges)


def test_queries_on_odd_rows(spark, byte_lib, word_lib):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None), (3, "the end " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = encode_documents(docs, BYTE).collect()
    assert len(got) == 5
    for row in got:
        text = next(t or "" for i, t, _ in rows if i == row.doc_id)
        ids = byte_lib.encode(text, add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(pack(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = count_tokens(docs, WORD, limit=100).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.over_limit) for r in got) == [(0, 0, False), (1, 3, False), (1, 3, False), (2, 0, False), (3, 24000, True)]
    assert {r.n_tokens for r in got if r.doc_id == 3} == {len(word_lib.encode("the end " * 3000, add_special_tokens=False).ids)}
    assert encode_documents(docs.limit(0), BYTE).count() == count_tokens(docs.limit(0), WORD).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_equal_library(spark, byte_lib, word_lib, sf):
    """Whole documents; every pre-token that is not remembered goes through the transducer."""
    texts = [r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    encoder, counter = StreamingEncoder(BYTE), TokenCounter(WORD)
    got, words = encoded(encoder, texts), WordEncoder(WORD, 2).encode(texts)
    known, pushed = set(byte_lib.pre_tokenizer.pre_tokenize_str(" ".join(texts))), encoder.machine.windows
    assert pushed >= len({w for w, _ in known}) > 1000
    for text, x, y in zip(texts, byte_lib.encode_batch(texts, add_special_tokens=False), word_lib.encode_batch(texts, add_special_tokens=False)):
        assert got[0] == pack(x.ids) and counter.count(text) == len(y.ids) and words[0] == np.array(y.ids, "<u2").tobytes()
        del got[0], words[0]


def test_state_stays_small():
    """An endless pre-token is emitted while it grows; the machine keeps a window at most."""
    for letter in ("a", " ", "\n", "=", "é", "1"):
        encoder = StreamingEncoder(BYTE)
        parts = []
        for _ in range(200):
            parts += [x for kind, items in encoder.feed(letter * 1000) if kind == 2 for x in items]
            assert len(encoder.tail) <= 1 + encoder.table.lookahead and (encoder.stream is None or len(encoder.stream.held) <= encoder.machine.window)
        assert sum(map(len, parts)) // 4 > 500


def test_merger_equals_heap():
    r = random.Random(9)
    for path in (BYTE, WORD):
        table = load_table(path)
        words = [bytes(r.choice(b"etaoin shrdlu=-\xc3\xa9") for _ in range(r.randrange(0, 90))) for _ in range(3000)]
        merger = Merger(table)
        merger.ROWS = 500
        assert merger.packed(words, "<u4") == [pack(heap_merge(table.symbols(w), table.merges)) for w in words]
    assert merger.packed([], "<u2") == []


def test_word_encoder_equals_library(word_lib):
    more = ["it's 'tis ''s !'s a'sx 'LL 're've'd'm 's's's x'rex 1's", "'", "''", "a'", "x" * 23 + " " + "x" * 24 + " " + "é" * 12, "\0 a\0 \0\0", "don't", "'s", "a\u2028b", "12 3a4"]
    texts = ODD + more + random_texts(2000, 3)
    want = [pack(x.ids) for x in word_lib.encode_batch(texts, add_special_tokens=False)]
    for encoder in (WordEncoder(WORD, 4), WordEncoder(WORD, 4, bits=6)):  # the second forgets and grows
        for texts_at in range(2):
            assert encoder.encode(texts) == want
        assert [encoder.encode([t])[0] for t in texts[:60]] == want[:60]
        assert encoder.counts(texts) == [len(x) // 4 for x in want] and encoder.encode([]) == []
