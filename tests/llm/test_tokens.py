import zlib

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")

from veilspark.llm import pieces, token_files  # noqa: E402
from veilspark.llm.chunk_table import ChunkTable  # noqa: E402

MODEL, BYTES = public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "  a", "a ", "\n", "a\nb", "a\n b", "a \nb", "a\n\nb", "x▁ y", "▁", "a▁b  c", "<|endoftext|>", "</s>",
    "a <|endoftext|> b, c.", "it's 's a 's don 't.", "é 你好 🙂", "a\tb", " \n ", "a b c", "x\x1c y", "\0 a b", "1 2\n3", "1.5,2 a.,b x_.y a...b",
    "$5.00, é.ö,ß x̄.y ٣.٤ .b", "long " * 40_000, "w" * 20_000,
]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, None, ODD[3]]
    docs = _docs(spark, texts).drop("ids")
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL, out="decoded").collect()
    assert len(out) == len(texts)
    for r in out:
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.decoded) == (ids, sp.decode(ids))
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    rng = np.random.default_rng(0)
    texts = [*ODD, None, ODD[4]]
    docs = _docs(spark, texts).withColumnRenamed("doc_id", "k").selectExpr("1000 - k AS doc_id", "text", "k AS shard").repartition(5)
    folder = token_files.encoded_files(docs, BYTES, f"file:{tmp_path}/set{rng.integers(1 << 30)}")
    rows, lookup = token_files.stored(spark, folder), token_files.id_of_rank(spark, folder)
    ids = {r.doc: r.ids for r in token_files.unpacked(rows, "doc", lookup=lookup).collect()}
    crc = {r.doc: r.crc32 for r in token_files.checksums(spark, folder).collect()}
    at = {r.doc: r.start for r in token_files.starts(spark, folder).join(rows.select("place", "doc"), "place").collect()}
    before = 0
    for doc in sorted(ids):
        want = tok.encode(texts[1000 - doc] or "", add_special_tokens=False).ids + [0]
        assert ids[doc] == want and at[doc] == before
        assert crc[doc] == zlib.crc32(np.array(want, "<u4").tobytes())
        before += len(want)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.rank for r in ranks] == list(range(len(ranks)))


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = token_files.encoded_files(docs, BYTES, f"file:{tmp_path}/empty")
    assert token_files.checksums(spark, folder).count() == 0 and token_files.starts(spark, folder).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (0, "d e f")], "doc_id long, text string")
    folder = token_files.encoded_files(docs, BYTES, f"file:{tmp_path}/ties")
    out = token_files.starts(spark, folder).join(token_files.stored(spark, folder), "place").orderBy("start").collect()
    assert [(r.doc, r.start, r.n_ids) for r in out] == [(None, 0, 3), (0, 3, 4), (1, 7, 2), (1, 9, 2)]


def test_pack_all_lengths():
    rng = np.random.default_rng(1)
    ids = (rng.integers(0, 2**32, 999) >> rng.integers(0, 32, 999)).astype(np.uint32)
    counts = np.array([0, 1, 5, 400, 0, 593])
    n, control, data = token_files.pack(ids, counts)
    assert (token_files.unpack(counts, control, data) == ids).all()
    part = pa.record_batch([n, control, data], names=token_files._PACKED).slice(2, 2)
    (_, c, got), = token_files._parts(part)
    assert (got == ids[1:406]).all() and c.tolist() == [5, 400]


def test_chunk_table_is_bounded_and_right():
    calls = []

    def encode(chunks):
        calls.extend(chunks)
        return [[ord(c) for c in x] for x in chunks]

    table = ChunkTable(encode, room=10, keep=4)
    for k in range(8):
        texts = [["a", "b", "ab"], [], [f"x{k}{j}" for j in range(5)] + ["a"]]
        ids, counts = table.ids(texts)
        assert "".join(map(chr, ids)) == "".join(c for t in texts for c in t)
        assert counts.tolist() == [sum(map(len, t)) for t in texts]
        assert len(table.number) <= 10 + 8
    assert calls.count("a") == 1


MARKS = [".abc", ", see below", ".", ",", "..", ",.", ".a.", " .a", "a .", ".,a", ",1", ".\n", ",a b.", "\n.", "\n,a", "a\n.b", ".a\n,b c"]


def test_texts_that_begin_and_end_with_marks(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    rng = np.random.default_rng(3)
    letters = list("ab1.,,.  \n'é_-$")
    texts = MARKS + ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(3000)]
    folder = token_files.encoded_files(_docs(spark, texts), BYTES, f"file:{tmp_path}/set")
    rows = token_files.unpacked(token_files.stored(spark, folder), "doc", lookup=token_files.id_of_rank(spark, folder)).collect()
    want = tok.encode_batch(texts, add_special_tokens=False)
    assert len(rows) == len(texts) and all(r.ids == want[r.doc].ids + [0] for r in rows)


def test_long_chunks_are_encoded_but_not_kept():
    from veilspark.llm import chunk_table

    asked = []

    def encode(keys):
        asked.extend(keys)
        return [[len(k), 7] for k in keys]

    table = ChunkTable(encode, room=40, keep=5)
    for i in range(30):
        long = "x" * (chunk_table.LONG + 1 + i % 2)
        ids, counts = table.ids([[long, "a", f"b{i}"], ["a", long, long], []])
        n = len(long)
        assert ids.tolist() == [n, 7, 1, 7, len(f"b{i}"), 7, 1, 7, n, 7, n, 7] and counts.tolist() == [6, 6, 0]
        assert not any(len(c) > chunk_table.LONG for c in table.number)
    assert asked.count("a") == 1 and len(table.number) == 31
    table.shrink(0)
    assert table.ids([["a"]])[0].tolist() == [1, 7]


def test_lone_marks():
    import re

    rng = np.random.default_rng(6)
    letters = list("ab1.,,.  _é-٣\n")
    for _ in range(20000):
        text = "".join(rng.choice(letters, rng.integers(0, 9)))
        assert token_files._lone_mark(text) == bool(re.search(r"[\W_][.,]", text)), text
