"""Tokenising, token counts, token files and packing."""

import random
import unicodedata
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import catalog, packing, token_counts, token_file
from quarry.llm.catalog import tokenizer_path
from quarry.llm.tokens import ChunkEncoder

ODD = ["", None, "  a  b ", "a\n\nb", "\n a\t b c  \n\n d", "don't 's x's.", "a\x1cb c.", "é é ΣΑΣ. ΣΑΣ,", "x" * 300 + " yy, zz!",
       "GELD\u0130. \u0932\u095c. ab\u0915\u0958, \u05d0\ufb1d.", "<|endoftext|> hi <|endoftext|>", "12,3.4 5!", "　wide em", "a\r\nb\x85c"]


def whole(name, text):
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunked_ids_equal_the_library(name, spaced):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("ab .,\n\t'é1 !|#") for _ in range(r.randint(0, 60))) for _ in range(300)]
    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    enc = ChunkEncoder(tokenizer_path(name), spaced, limit=500)      # small, so that it empties
    for i in range(0, len(texts), 50):
        for x, got in zip(texts[i:i + 50], enc.encode(texts[i:i + 50]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_letters_that_normalise_to_a_letter_and_a_mark(name, spaced):
    """Before punctuation, against the library as it comes."""
    r = random.Random(7)
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    apart = [c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalpha()]
    assert {"\u0130", "\u0958", "\u095c", "\ufb1d"} <= set(apart)
    texts = [f + c + m for c in apart for m in ".,;:!?" for f in ("", "ab", c)]
    texts += ["".join(r.choice([r.choice(letters), r.choice(apart), r.choice("abAB"), r.choice(" .,;:!?"), chr(r.randrange(0x300, 0x370))])
                      for _ in range(r.randint(1, 14))) for _ in range(5000)]
    texts += ["ab" + c + "." for c in letters[::5]]
    t = Tokenizer.from_file(tokenizer_path(name))
    got = ChunkEncoder(tokenizer_path(name), spaced, special=True).encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def greedy(s, vocab):
    n = i = 0
    while i < len(s):
        j = next((j for j in range(len(s), i, -1) if s[i:j] in vocab), None)
        n, i = (n + len(s[i].encode()), i + 1) if j is None else (n + 1, j)
    return n


def test_automaton_matches_greedy_longest_match():
    r = random.Random(1)
    for _ in range(150):
        vocab = {"".join(r.choice("abcé") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        auto = token_counts.Automaton(sorted(vocab))
        for _ in range(60):
            w = "".join(r.choice("abcédx") for _ in range(r.randint(0, 14)))
            assert auto.count(w) == greedy(w, vocab)


def test_token_counts_of_documents(make_docs):
    path = tokenizer_path(token_counts.VOCABULARY)
    vocab = set(token_counts.load_pieces(path))
    texts = [t for t in ODD if t != "x" * 300 + " yy, zz!"] + ["The quick brown fox", "漢字 😀 mixed\ttext", "a" * 5000]
    docs = make_docs(list(enumerate(texts)) + [(2, texts[2])]).withColumn("n_words", F.lit("clash")).withColumn("c", F.lit(1))
    got = sorted((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs, path).collect())
    words = [token_counts.find_words(t or "") for t in texts]
    want = [(i, len(w), sum(greedy("▁" + x, vocab) if len(x) < 100 else token_counts.Automaton(sorted(vocab)).count("▁" + x) for x in w))
            for i, w in enumerate(words)]
    assert got == sorted([*want, want[2]])
    assert token_counts.count_tokens(make_docs([]), path).count() == 0


def test_segment_round_trip_and_checksum():
    r = np.random.default_rng(0)
    for n, top in ((1, 5), (2, 60000), (2047, 9), (2048, 300), (2049, 60000), (9000, 40)):
        ids = r.integers(0, top, n).astype("<u4")
        table, payloads, crcs = token_file.encode_segment(ids)
        assert token_file.decode_segment(table, payloads, crcs, n).tolist() == ids.tolist()
        with pytest.raises(ValueError, match="checksum"):
            token_file.decode_segment(table, payloads, [crcs[0] ^ 1, *crcs[1:]], n)
    same = np.full(5000, 77, "<u4")
    assert sum(map(len, token_file.encode_segment(same)[1])) < 200           # certain predictions cost next to nothing


def test_token_file_matches_whole_texts(make_docs):
    rows = [(10 * i, t) for i, t in enumerate(ODD)] + [(10, "z second"), (10, "a first"), (None, "no id"), (7, "word " * 6000)]
    docs = make_docs(rows).withColumn("bucket", F.lit("clash")).withColumn("start", F.lit(1))
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_file.round_trip(docs, tokenizer_path("word_bpe_49k.json"), target=3000).collect()]
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*whole("word_bpe_49k.json", t), 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_file.round_trip(make_docs([]), tokenizer_path("word_bpe_49k.json")).count() == 0


def check_packing(rows, got, capacity=1024):
    want = []
    for i, t in rows:
        ids = np.array([*whole("byte_bpe_50k.json", t), 2], "<u4")
        a, b, p = 0, (len(ids) - 1) % capacity + 1, 0
        while a < len(ids):
            want.append((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            a, b, p = b, b + capacity, p + 1
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_packing(make_docs, monkeypatch):
    r = random.Random(4)
    rows = [(i, "word " * r.randint(0, 400)) for i in range(300)] + [(1000, "x y z " * 2500), (1001, None), (1002, ""), (3, "again"), (None, "no id")]
    docs = make_docs(rows).withColumn("item", F.lit("clash")).withColumn("piece", F.lit(1)).withColumn("offset", F.lit(2))
    got = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), shard_size=64).collect()
    n, tokens = check_packing(rows, got)
    assert n <= -(-tokens // 1024) * 1.05 + 1
    assert packing.pack_documents(make_docs([]), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_evolution_never_worse_than_best_fit():
    r = random.Random(9)
    for _ in range(5):
        sizes = np.array([r.randint(200, 700) for _ in range(150)])
        base = packing.best_fit(sizes, np.argsort(-sizes, kind="stable").tolist(), 1024)
        best = packing.evolve(sizes, [], 1024, 10, 6, np.random.default_rng(1))
        assert len(set(best.tolist())) == best.max() + 1 <= base.max() + 1
        assert packing.fills(best, sizes).max() <= 1024
        child = packing.crossover(base, best, sizes, 1024, np.random.default_rng(2))
        assert packing.fills(child, sizes).max() <= 1024 and len(set(child.tolist())) == child.max() + 1


ADDED = ["hi <|endoftext|> there", "<|startoftext|>", "a <|startoftext|>b<|endoftext|>. c", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>  y\n",
         "x\n\n<|endoftext|>\n z", "<|endoftext| >", "plain words.", " a <|startoftext|> ", "é<|endoftext|>\x1cb"]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_added_tokens_as_the_library_reads_them(name, spaced):
    r = random.Random(6)
    texts = ADDED + ["".join(r.choice(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "ab", " ", ".", "\n", "é"]) for _ in range(12)) for _ in range(200)]
    t = Tokenizer.from_file(tokenizer_path(name))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for step in (1, 7, len(texts)):
        enc = ChunkEncoder(tokenizer_path(name), spaced, special=True)
        got = [np.frombuffer(g, "<u4").tolist() for i in range(0, len(texts), step) for g in enc.encode(texts[i:i + step])]
        assert got == want


def test_ids_do_not_depend_on_the_batch():
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        for batch in ([x] for x in ADDED), [ADDED], [["<|startoftext|>", "b"], ["<|endoftext|> <|startoftext|>x"]]:
            enc = ChunkEncoder(tokenizer_path(name), spaced)
            for part in batch:
                assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(part)] == [whole(name, x) for x in part]


def test_queries_read_added_tokens_as_the_library_does(spark, make_docs, monkeypatch):
    docs = make_docs(list(enumerate(ADDED)))
    monkeypatch.setattr(catalog, "load", lambda *_: docs)
    crc = {}
    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 2)):
        t = Tokenizer.from_file(tokenizer_path(name))
        ids = [np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4") for x in ADDED]
        crc[name] = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
    got = catalog.QUERIES["op2_token_file"](spark, "").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc["word_bpe_49k.json"]
    for out in (catalog.QUERIES["op6_packing"](spark, ""), corpus_pipeline.packing_stage(spark, docs, "")):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in out.collect()) == crc["byte_bpe_50k.json"]


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_each_distinct_piece_reaches_the_library_once(name, spaced, monkeypatch):
    """Plain pieces go to the model, cut as the library cuts them; a batch
    that repeats them, and a table that changes, ask for none again."""
    r = random.Random(5)
    letters = "abcXYZ" + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    texts = ["".join(r.choice([r.choice(letters), r.choice(letters), r.choice("'s't're've'm'll'd'S'LL"), r.choice("0123456789#*$|.,;<>-_"), " ", r.choice(" \n")])
                     for _ in range(r.randint(0, 80))) for _ in range(2000)]
    t = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for limit in (500_000, 3000):
        enc = ChunkEncoder(tokenizer_path(name), spaced, limit=limit, special=True)
        assert [np.frombuffer(g, "<u4").tolist() for i in range(0, 2000, 300) for g in enc.encode(pa.array(texts[i:i + 300], pa.string()))] == want
    enc = ChunkEncoder(tokenizer_path(name), spaced, special=True)
    words = "Some plain words, it's Ähnlich: 12 %%% end"
    asked = []
    monkeypatch.setattr(enc, "_direct", lambda chunks, ask=enc._direct: asked.extend(chunks) or ask(chunks))
    first = enc.encode([words])
    assert [x for x in asked if x != "Some"] == []                    # the first word has no leading space
    enc.model = None                                                  # and the model is not asked again
    assert enc.encode([words, words]) == first * 2
    enc.limit = 2
    assert enc.encode([words]) == enc.encode([words]) == first


def test_long_and_spaced_pieces_are_not_remembered():
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        enc = ChunkEncoder(tokenizer_path(name), spaced, special=True)
        texts = ["ab " + "y" * 200 + " cd", " ", "  ", " a", "a ", "a\n b", "\n", " \n", None, "", "a\nb c", "y" * 200, "end  x", "x y z"]
        t = Tokenizer.from_file(tokenizer_path(name))
        got = [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert max(len(x) for table in (enc.words, enc.bare, enc.stems) for x in table) <= 65
        assert enc.encode([]) == []
