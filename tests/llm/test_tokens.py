"""Token counts, packing and matrices against the tokenizer itself."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from llmfixtures import documents  # noqa: F401

from holdspan.llm import encode, packing, tokencount, tokenout

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", " ", " ", "\n", "\t", "a", "b", "'s", "'", "1", "é", ".", "!", "<|endoftext|>", " ", " ",
            "\x1c", "\x85", "ab cd", "日", "​", "the ", "Word", "a.", "é,", "\x01", "Ωx.", "7!"]


def some_texts(n, longest=60, seed=1):
    random.seed(seed)
    return ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return encode.load(PATH)


@pytest.fixture(scope="module")
def rows():
    texts = [*some_texts(60), None, "", "x" * 20_000, "word " * 9_000, "same", "same"]
    return [*enumerate(texts), (None, "no id"), (0, "again")]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_have_the_ids_of_the_whole(tokenizer):
    cache = encode.PieceCache(PATH, lambda b: np.frombuffer(b, "<u4").tolist(), most=200)
    for seed in range(10):
        texts = some_texts(300, 40, seed)
        for text, values in zip(texts, cache.texts(texts), strict=True):
            assert [i for v in values for i in v] == ids_of(tokenizer, text), repr(text)
    assert len(cache.held) <= 200 + 4_000


def test_whole_texts_have_the_same_ids(tokenizer):
    encoder = encode.TextEncoder(PATH)
    assert encoder.fast is not None
    texts = [*some_texts(2_000, 40, 9), "x" * 50_000, " \n\n  é²½«… ", "it's we'll", "<|endoftext|>", "a<|endoftext|> b"]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids_of(tokenizer, text), repr(text)
    encoder.fast = None
    assert np.frombuffer(encoder.ids("plain text"), "<u4").tolist() == ids_of(tokenizer, "plain text")


def test_counts(documents, tokenizer, rows):
    docs = documents(rows)
    got = tokencount.count_tokens(docs.withColumnRenamed("lang", "n_tokens"), PATH)
    want = sorted((str(d), len((t or "").encode()), len(ids_of(tokenizer, t))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.collect())
    # The broadcast table is a cache only.
    bare = tokencount.count_tokens(docs, PATH, frequent={})
    assert sorted(map(str, bare.collect())) == sorted(map(str, got.collect()))
    assert "Exchange" not in bare._jdf.queryExecution().executedPlan().toString()


def library_count(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        tokenizer = encode.load(path)
        return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda t: len(ranked.encode_ordinary(t))


FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.mark.parametrize("name", FILES)
def test_every_file_counts_as_its_library_does(documents, rows, name):
    count = library_count(name)
    more = [*rows, *((k + 1_000, t) for k, t in enumerate(some_texts(400, 40, 3)))]
    got = tokencount.count_tokens(documents(more).repartition(3), public_tokenizers.path(name))
    want = sorted((str(d), len((t or "").encode()), count(t or "")) for d, t in more)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert encode.cuts_at_spaces(public_tokenizers.path(name)) == (name == "byte_bpe_50k.json")


def test_an_unknown_kind_of_file_is_refused(documents, rows):
    with pytest.raises(ValueError):
        tokencount.count_tokens(documents(rows), "/nowhere/vocabulary.txt")


def test_empty_tables(documents):
    docs = documents([])
    assert tokencount.count_tokens(docs, PATH).count() == 0
    assert packing.pack(docs, PATH).count() == 0
    assert tokenout.token_matrices(docs, PATH).count() == 0


@pytest.mark.parametrize("partitions,capacity", [(1, 64), (40, 64), (5, 2048)])
def test_packing_loses_and_repeats_nothing(documents, tokenizer, rows, partitions, capacity):
    docs = documents(rows).repartition(partitions)
    got = packing.pack(docs, PATH, capacity=capacity, windows=4, with_ids=True).collect()
    sequences, of = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        sequences[r.sequence_id].append(r)
        of[r.doc_id, r.doc_tokens].append(r)
    short = 0
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        short += at < capacity
    assert short <= 1
    want = defaultdict(list)
    for d, t in rows:
        raw = np.array([*ids_of(tokenizer, t), 1], "<u4").tobytes()
        want[d, len(raw) // 4].append(raw)
    assert {k: len(v) for k, v in want.items()}.keys() == of.keys()
    for key, raws in want.items():
        if len(raws) == 1:
            parts = sorted(of[key], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == raws[0]
    assert sum(r.length for r in got) == sum(len(raw) // 4 for raws in want.values() for raw in raws)


def test_matrices_give_back_every_document(documents, tokenizer, rows, spark, tmp_path):
    docs = documents(rows).repartition(3)
    got = tokenout.write_matrices(docs, PATH, str(tmp_path / "m"), capacity=512, block_tokens=5_000).collect()
    found = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        assert r.position_resets == r.cu_seqlens[:-1]
        positions = tokenout.position_ids(r.cu_seqlens)
        assert (np.flatnonzero(positions == 0) == r.position_resets).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found[d].append((s, ids[a:b].tolist()))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append([*ids_of(tokenizer, t), 50256])
    assert found.keys() == want.keys()
    for d, lists in want.items():
        if len(lists) == 1:
            assert [i for _, ids in sorted(found[d]) for i in ids] == lists[0]
    assert sum(r.n_tokens for r in got) == sum(len(x) for lists in want.values() for x in lists)


def test_segment_tree_finds_the_best_fit():
    random.seed(3)
    for _ in range(30):
        capacity = random.choice([7, 8, 100, 2048])
        lengths = np.array([random.randint(1, capacity) for _ in range(200)])
        rows = tokenout.best_fit_decreasing(lengths, capacity)
        free: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):  # the same by a scan of all rooms
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(capacity - n)
        assert sorted(p for r in rows for p in r) == list(range(200))
        assert sorted(capacity - int(lengths[r].sum()) for r in rows) == sorted(free)
