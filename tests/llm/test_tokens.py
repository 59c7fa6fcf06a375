import os
import zlib

import numpy as np
import pytest

from rulewright.llm import huffman, packing, tokens

TEXTS = [
    None, "", " ", "Hello, world!", "it's we'll  don't\n\nTabs\there", "Übergröße ñandú ça façade <|endoftext|> x", "á école  nbsp em\x1cfs",
    "12 345-678 +1 (555) 555-0100 a@b.co", "日本語 テキスト 😀😀 ok.", "x" * 5000, "word " * 5000, "Same text.", "Same text.", "$$$ de,&&& ''' 's", "İstanbul ǅ ŉ ß ẞ", "the\rend\x0b\x0cmore\x85z",
]


def whole(texts):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def corpus(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(100).collect()]


def test_chunks_give_the_ids_of_whole_texts(spark, sf):
    for block, texts in ((64, TEXTS), (1 << 16, TEXTS + corpus(spark, sf)), (1 << 22, TEXTS + corpus(spark, sf))):
        tok = tokens.ChunkTokenizer(tokens.default_path(), max_bytes=2000, block_bytes=block)
        assert [np.frombuffer(t, dtype="<u4").tolist() for t in tok.ids(texts)] == whole(texts)


def test_another_pretokeniser_is_left_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(tokens.default_path(), encoding="utf-8").read())
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    (tmp_path / "own.json").write_text(json.dumps(spec), encoding="utf-8")
    tok = tokens.ChunkTokenizer(str(tmp_path / "own.json"))
    t = Tokenizer.from_file(str(tmp_path / "own.json"))
    assert not tok.by_chunk
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in tok.ids(TEXTS)] == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


def test_odd_characters():
    import random

    rng = random.Random(3)
    odd = [chr(c) for c in (*range(1, 0x300), 0x301, 0x308, 0x1E9E, 0x130, 0x2028, 0x3000, 0xFB01, 0x1F600, 0xFEFF, 0xAC00)]
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else "abc ABC é.*'s ,") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in tokens.ChunkTokenizer(tokens.default_path()).ids(texts)] == whole(texts)


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "c", 2), (3, "again", "c", 3), (3, "again", "c", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard int").repartition(3), rows


def expected(rows):
    out = []
    for r, ids in zip(rows, whole([r[1] for r in rows]), strict=True):
        out.append((r[0], np.array(ids + [1], dtype="<u4")))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))


@pytest.mark.parametrize("max_len", [1, 8, 2048])
def test_packing(spark, max_len):
    df, rows = frame(spark, TEXTS)
    got = packing.pack_documents(df, max_len=max_len).collect() if max_len > 1 else packing.pack_documents(df.where("length(text) < 50"), max_len=1).collect()
    if max_len == 1:
        assert all(r.length == 1 for r in got)
        return
    assert len({r.sequence_id for r in got}) == len(got)
    want = {(d, x.tobytes()) for d, x in expected(rows)}
    by = {}
    for r in sorted(got, key=lambda r: r.sequence_id):
        assert r.length & (r.length - 1) == 0 and r.length <= max_len and r.offset == 0 and len(r.ids) == r.length
        piece = np.array(r.ids, dtype="<u4").tobytes()
        assert zlib.crc32(piece) == r.ids_crc32
        by.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, piece))
    for (doc, n), pieces in by.items():
        copies = 2 if doc == 3 and sum(s == 0 for s, _ in pieces) == 2 else 1
        text = b"".join(p for _, p in pieces[: len(pieces) // copies])
        assert len(text) == 4 * n and (doc, text) in want


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shard", [50, 10**6])
def test_huffman_round_trip(spark, tmp_path, shard):
    df, rows = frame(spark, TEXTS)
    path = huffman.write_ids(df, f"file://{tmp_path}/out{shard}", ids_per_shard=shard, block_ids=64, interval=16)
    got = sorted([tuple(r) for r in huffman.read_ids(spark, path).collect()], key=lambda r: r[1])
    want, at = [], 0
    for doc, ids in expected(rows):
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert not [p for p in tmp_path.rglob("*.tmp")]


def test_huffman_of_nothing(spark, tmp_path):
    path = huffman.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert huffman.read_ids(spark, path).count() == 0


def test_codes_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for counts in ([5], [0, 0, 3], [1, 1], rng.integers(0, 1000, 300), 2 ** np.arange(20)):
        counts = np.array(counts)
        lengths = huffman.code_lengths(counts, 30).astype(int)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        best = heap[0] if len(heap) == 1 else 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            best += a
            heapq.heappush(heap, a)
        assert (counts * lengths).sum() == best
    limited = huffman.code_lengths(2 ** np.arange(20), 8)
    assert limited.max() <= 8 and sum(2.0 ** -int(x) for x in limited) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20), 4)
