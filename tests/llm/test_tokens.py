"""Pieces of texts, encoded together."""

from lumbra.llm.tokens import encoder, vocabulary


def test_pieces_spelled_together_have_the_ids_of_each(spark):
    pieces = ["Olá", " mundo", "!!", " it's", "\n", " ção", "日本", "", " 12", "a", "...", "\r\n x", "Ünï", " ", "|a", "~"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = encoder(vocabulary(name))
        assert list(enc.make_all(pieces)) == [enc.make(p) for p in pieces]
        assert list(enc.make_all([])) == [] and list(enc.make_all([" 1"])) == [enc.make(" 1")]
