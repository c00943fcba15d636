import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkwell.llm.bpe import Merges, PieceBPE, WordBPE, piece_bpe, word_bpe
from inkwell.llm.tokens import decode, digests, encode, fitting_chars, prefix_counts, token_counts

ODD = ["", None, " ", "Hello  world\n a", "<|startoftext|>Hi<|endoftext|> x <|END", "ΑΣ ΣΑΣ ς Σ", "İstanbul ﬁ①é\té ẞ", "▁▁ a▁b ▁", "a" * 5000, "ab" * 3000, "日本語テキスト🙂👩‍👧", "don't WE'LL 12345 $$$ !!!...", "<s></s><unk><0x0A>", "\x00\x01", "a\U00010941bꟋ\U00010b93"]


@pytest.fixture(scope="module")
def texts(spark, mid):
    return ODD + [r.text for r in spark.read.parquet(f"{mid}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)


def test_ids_and_decoding_are_the_library_s(df, texts):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in digests(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        sha = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), *sha), t


def test_encode_decode_round(df):
    few = encode(df.where("doc_id < 40"))
    assert {(r.doc_id, r.decoded) for r in few.collect()} == {(r.doc_id, r.decoded) for r in decode(few).collect()}


def test_counts_are_the_library_s(df, texts):
    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in token_counts(df).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or ""))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 4096), t


def test_every_prefix(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    t = "The  quick\nbrown ▁▁ fóx 日本 jumped   overoveroverover "
    row = fitting_chars(prefix_counts(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")), 9).orderBy("doc_id").collect()
    want = [len(own.encode(t[:i])) for i in range(1, len(t) + 1)]
    assert row[0].counts == want
    assert row[0].fits == max(i + 1 for i, n in enumerate(want) if n <= 9)
    assert (row[1].counts, row[1].fits) == ([], 0)


def test_pair_table_stays_bounded():
    for bpe in (word_bpe(P.path("word_bpe_49k.json")), piece_bpe(P.path("piece_bpe_32k.model"))):
        assert len(bpe.merges.table) <= bpe.merges.bound
        assert len(bpe.kept) <= bpe.words_kept


def test_empty_table(spark, df):
    assert digests(df.limit(0)).collect() == []
    assert token_counts(df.limit(0)).collect() == []


def test_frequent_words_stay_when_many_were_met():
    for kind, file, many, of in ((WordBPE, "word_bpe_49k.json", "encode", WordBPE.encode_bytes), (PieceBPE, "piece_bpe_32k.model", "prefix_counts", PieceBPE.count)):
        bpe, asked = kind(P.path(file), words_kept=5), []
        plain = getattr(bpe.merges, many)
        setattr(bpe.merges, many, lambda w, f=plain, asked=asked: asked.append(w) or f(w))
        for i in range(40):
            of(bpe, f"often w{i}x")
        assert sum("ofte" in w for w in asked) == 1 and len(bpe.kept) <= 5 and len(bpe.older) <= 5


def test_steps_back_give_what_merging_gives():
    merges = [("a", "b"), ("b", "c"), ("c", "d"), ("ab", "cd"), ("d", "a")]
    bpe = Merges({a + b: i for i, (a, b) in enumerate(merges)}, {a + b: (a, b) for a, b in merges}, [*"abcd", *(a + b for a, b in merges)])
    rank = {m: i for i, m in enumerate(merges)}
    for k in range(1, 7):
        for word in map("".join, itertools.product("abcd", repeat=k)):
            parts = list(word)
            while own := [(rank[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in rank]:
                i = min(own)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert bpe.encode(word) == parts and bpe.prefix_counts(word)[-1] == len(parts), word
