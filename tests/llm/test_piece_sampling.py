import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from geomlake.llm import piece_sampling
from geomlake.llm.queries import PIECE_BPE
from tests.llm.test_tokens import DOCS, frame, strings

PIECE = public_tokenizers.path(PIECE_BPE)


def test_lossless_and_independent_of_batches():
    lattice = piece_sampling.PieceLattice(PIECE)
    values = [*strings(1500), "▁▁ a▁b", " lead", "trail ", "a  b   c", "\n", "\x00"]
    keys = np.arange(len(values))
    ids, at = lattice.sample(pa.array(values), keys, 1)
    for i, text in enumerate(values):
        assert lattice.decode(ids[at[i] : at[i + 1]]) == text
    alone, _ = piece_sampling.PieceLattice(PIECE).sample(pa.array(values[700:702]), keys[700:702], 1)
    assert alone.tolist() == ids[at[700] : at[702]].tolist()


@pytest.mark.parametrize("text", ["thing", "a the", "  of  it", "on\nin"])
def test_shares_equal_enumeration(text):
    lattice = piece_sampling.PieceLattice(PIECE)
    n = 20_000
    weights = {}

    def walk(start, ids, w):
        if start == len(text) + 1:
            weights[tuple(ids)] = math.exp(w)
        elif (c := (" " + text)[start]) not in lattice.pieces:
            walk(start + 1, [*ids, *(lattice.octets[b] for b in c.encode())], w)
        for end in range(start + 1, len(text) + 2):
            if (p := lattice.pieces.get((" " + text)[start:end])) is not None:
                walk(end, [*ids, p[0]], w + p[1])

    walk(0, [], 0.0)
    ids, at = lattice.sample(pa.array([text] * n), np.arange(n), 3)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for segmentation, w in weights.items():
        share = w / total
        assert abs(seen[segmentation] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_a_model_with_spaces_inside_pieces_is_refused(monkeypatch):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "of▁the" if i == 500 else plain(self, i))
    with pytest.raises(ValueError, match="stretches"):
        piece_sampling.PieceLattice(PIECE)


def test_table(spark):
    got = piece_sampling.sampled(frame(spark), PIECE).collect()
    assert len(got) == len(DOCS) and all(r["lossless"] for r in got)
    assert len({r["ids_crc32"] for r in got if r["doc_id"] == 3}) == 1
    assert {r["n_pieces"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert piece_sampling.sampled(frame(spark, []), PIECE).count() == 0
    back = piece_sampling.decoded(piece_sampling.encoded(frame(spark), PIECE), PIECE).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t in DOCS), key=str)
    again = piece_sampling.sampled(frame(spark).repartition(3), PIECE).collect()
    assert sorted(again, key=str) == sorted(got, key=str)
    assert piece_sampling.sampled(frame(spark), PIECE, seed=18).collect() != got
