import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from geomlake.llm import packing, token_count, token_files, word_ids
from geomlake.llm.queries import PIECE_BPE, WORD_BPE

WORD, PIECE = public_tokenizers.path(WORD_BPE), public_tokenizers.path(PIECE_BPE)
BITS = ["a", "B", "the", "ing", "é", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "▁", "Σ", "İ", "1", "日", "<s>", "<|endoftext|>", "<0x41>", "|>", "'s", ".", "!!", "😀", "\x00", "​"]
DOCS = [(3, "One text, twice."), (1, None), (2, ""), (9, "word " * 3000), (None, "no id"), (3, "One text, twice."), (4, "x" * 5000), (7, "é\x1c日 <|endoftext|> ok")]
SCHEMA = "doc_id long, text string, lang string, ids string, place string"


def strings(n):
    rng = random.Random(5)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)] + ["", " ", "   "]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "en", "clash", "clash") for r in rows], SCHEMA)


def test_word_ids_equal_the_library():
    coder, values = word_ids.WordTokenizer(WORD), strings(3000)
    ids, at = coder.encode(pa.array(values))
    for i, text in enumerate(values):
        assert ids[at[i] : at[i + 1]].tolist() == coder.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_piece_counts_equal_the_library():
    import sentencepiece

    values = strings(3000)
    assert token_count.PieceCounter(PIECE).counts(pa.array(values)).tolist() == [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(values)]


def test_token_counts(spark):
    got = token_count.token_counts(frame(spark), PIECE).collect()
    assert len(got) == len(DOCS)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_tokens"], by[2]["n_bytes"], by[None]["n_bytes"]) == (0, 0, 5)
    assert token_count.token_counts(frame(spark, []), PIECE).count() == 0
    assert token_count.token_counts(frame(spark), PIECE, 100).where("over_limit").count() == 2


@pytest.mark.parametrize("kind", [0, 1])
@pytest.mark.parametrize("width", [2, 4])
def test_file_image_round_trip(kind, width):
    ids = np.random.default_rng(1).integers(0, 49408, 10_007).astype(f"<u{width}")
    counts = np.array([0, 7, 10_000])
    held = token_files.TokenFile(io.BytesIO(token_files.file_image(ids, np.array([1, 2, 3]), counts, kind, block=1000)))
    assert (held.ids() == ids).all() and (held.ids(990, 2010) == ids[990:2010]).all() and held.ids(5, 5).size == 0
    assert [x.tolist() for x in held.documents()] == [[1, 2, 3], [0, 7, 10_000]]


def expected_ids(end):
    library = word_ids.WordTokenizer(WORD).library
    return [(d, [*library.encode(t or "", add_special_tokens=False).ids, end]) for d, t in DOCS]


@pytest.mark.parametrize("file_ids", [1, 1 << 20])
def test_token_files_equal_brute_force(spark, tmp_path, file_ids):
    files = token_files.write_token_files(frame(spark), str(tmp_path / "f"), WORD, file_ids=file_ids)
    got = [tuple(r) for r in token_files.read_token_files(files, str(tmp_path / "f")).collect()]
    start, want = 0, []
    for doc_id, ids in sorted(expected_ids(2), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_files_of_an_id_that_many_rows_share(spark, tmp_path):
    rows = [(5, f"text {i % 40}") for i in range(200)] + [(4, "before"), (6, "after")]
    files = token_files.write_token_files(frame(spark, rows).repartition(7), str(tmp_path / "f"), WORD, file_ids=50)
    got = sorted((tuple(r) for r in token_files.read_token_files(files, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    library = word_ids.WordTokenizer(WORD).library
    want = sorted((d, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in rows)
    assert sorted((r[0], r[3]) for r in got) == want and [r[0] for r in got] == sorted(d for d, _ in rows)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]


def test_token_files_of_an_empty_table(spark, tmp_path):
    files = token_files.write_token_files(frame(spark, []), str(tmp_path / "f"), WORD)
    assert token_files.read_token_files(files, str(tmp_path / "f")).count() == 0


@pytest.mark.parametrize("window", [2048, 64])
def test_packing_covers_every_id_once(spark, window):
    got = packing.packed(frame(spark), WORD, window=window).collect()
    places, pieces = {}, {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    lengths = {}
    for s, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window and (at == window or at & (at - 1) == 0)
        lengths[s] = at
    assert sorted(lengths) == list(range(len(lengths)))
    assert sum(lengths.values()) == sum(len(ids) for _, ids in expected_ids(1))
    for doc_id, ids in expected_ids(1):
        spans = sorted({(r["start"], r["length"], r["ids_crc32"]) for r in pieces[(doc_id, len(ids))]})
        assert {zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in spans} == {True}
        # One row of its id: its pieces follow one another from its first id to its last.
        if doc_id != 3:
            assert [a for a, _, _ in spans] == [0, *np.cumsum([n for _, n, _ in spans]).tolist()[:-1]]
            assert sum(n for _, n, _ in spans) == len(ids) == pieces[(doc_id, len(ids))][0]["doc_tokens"]
    assert sum(r["length"] for r in pieces[(3, len(dict(expected_ids(1))[3]))]) == 2 * len(dict(expected_ids(1))[3])
    assert packing.packed(frame(spark, []), WORD).count() == 0


def test_last_cuts():
    assert packing.last_cuts(2048 + 1300, 2048) == [2048, 3072, 3328, 3344]
    assert packing.last_cuts(4096, 2048) == []
