"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib
import struct
import sys

import numpy as np
import pytest

from barlake.llm import byte_bpe, pieces, token_counts
from conftest import plan_of

from .samples import ODD_ROWS, prose

files = pytest.importorskip("public_tokenizers")
JSON, RANKS = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken")

ODD = ["a" * 5000, "a b" * 900, " " * 3000, "x  " * 400 + "<|endoftext|>" + "y\n\n " * 200, "<|endoftext|>" * 90,
       "é\xa0 \n" * 300, "it's we'll I'd they've " * 100, "日本語テキスト" * 90, "  　a" * 90,
       "<|endof" * 60 + "text|>" * 20, "1234 5678" * 120, "tail   ", "\r\n\r\n x", "🙂👍🏽" * 50, "'", "''s"]


def texts():
    return [*ODD, *(t for _, t in ODD_ROWS if t), *(prose(k, 200) for k in range(10))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts(library, make_docs):
    rows = [*ODD_ROWS, *((k, t) for k, t in enumerate(texts()))]
    found = token_counts.report(make_docs(rows), JSON).collect()
    expected = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512)
                for d, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("chunk, overlap", [(150, 8), (400, 40)])
def test_spliced_chunks(library, chunk, overlap):
    counter = token_counts.Counter(JSON, huge=100, chunk=chunk, overlap=overlap)
    for text in [*texts(), prose(77, 3000), "word" * 900 + prose(1, 300) + " " * 900 + prose(2, 100)]:
        assert counter.spliced(text) == len(library.encode(text, add_special_tokens=False).ids), text[:30]
    assert counter.widened > 0


def test_plain_characters_are_cut_as_by_the_library(library):
    """Every character of the texts that are cut into words here has the class the library gives it."""
    import regex

    find = regex.compile(pieces.PATTERN).findall
    for code in range(sys.maxunicode + 1):
        if pieces.PLAIN.fullmatch(chr(code)):
            for text in (f"a{chr(code)}1", f" {chr(code)} {chr(code)}a"):
                cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
                assert cut == find(text), hex(code)


def test_encoding_and_decoding(reference, make_docs):
    rows = [*ODD_ROWS, *((k, t) for k, t in enumerate(texts()))]
    expected = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
    found = byte_bpe.report(make_docs(rows), RANKS).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_offsets_and_split_characters(reference, make_docs):
    text = "日本語 🙂 é ok"
    row = byte_bpe.encode(make_docs([(1, text)]), RANKS, offsets=True).first()
    ids = np.frombuffer(row.ids, "<u4").tolist()
    assert ids == reference.encode_ordinary(text)
    assert row.ends == np.cumsum([len(reference.decode_single_token_bytes(i)) for i in ids]).tolist()
    back = byte_bpe.decode(byte_bpe.encode(make_docs([(1, text)]), RANKS), RANKS, as_text=True).first()
    assert back.text == text
    assert byte_bpe.coder(RANKS).decode(row.ids[:4]).decode("utf-8", "replace") != text[0] or len(ids) == 1


def test_library_values(library):
    assert pieces.PATTERN == files.PATTERN
    assert byte_bpe.byte_characters()[32] == "Ġ" and len(set(byte_bpe.byte_characters())) == 256


def test_encoded_and_decoded_in_one_worker(make_docs):
    """A task of the report holds one worker, and gives what two give one after the other."""
    docs = make_docs([*ODD_ROWS, *enumerate(texts())])
    assert plan_of(byte_bpe.report(docs, RANKS)).count("MapInArrow") == 1
    both = byte_bpe.round_trip(docs, RANKS)
    apart = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).drop("text").select(*both.columns)
    assert "text" not in both.columns and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
