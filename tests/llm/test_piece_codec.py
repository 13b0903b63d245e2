"""The agenda encoder against the sentencepiece library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylake.llm import _common as C
from quarrylake.llm import piece_codec as P

CASES = ["", " ", "  ", "a", " a", "a ", "a  b", "\ta\n b\n", "\n", "a\nb c\n\nd", "▁", "a▁b", "\x00x", "<s>hi</s>", "<0x41>", "ﬁ ｆ", "日本語 テキスト", "😀 x😀", "x" * 3000, "é́", "1234567 89", "a\n\n  b \n c"]


@pytest.fixture(scope="module")
def codec():
    return P.load(C.tokenizer_file(P.DEFAULT_MODEL))


@pytest.mark.parametrize("text", CASES)
def test_cases(codec, text):
    ids = codec.codec.encode(text)
    assert ids == codec.library.encode(text)
    assert codec.of(text) == ids
    assert codec.codec.decode(ids) == codec.library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeinorst.,0123éß▁日"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_any_text(codec, text):
    ids = codec.of(text)
    assert ids == codec.library.encode(text)
    assert codec.codec.decode(ids) == codec.library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=2, max_size=80))
def test_both_agendas_agree(codec, text):
    assert codec.codec.merge_array(list(text)) == codec.codec.merge_heap(list(text))


def test_frames(spark):
    rows = [(i, t, "own") for i, t in enumerate(CASES)] + [(None, None, "x"), (3, "a", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = P.decode(P.encode(docs)).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in got)
    digests = P.round_trip_digest(docs).collect()
    by = {r["doc_id"]: r for r in digests}
    for r in got:
        assert by[r["doc_id"]]["n_tokens"] == len(r["ids"])
        assert by[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    assert P.round_trip_digest(docs.limit(0)).count() == 0


def test_long_runs_are_not_kept():
    import random
    import resource

    import sentencepiece

    from quarrylake.llm import _common as C

    draw = random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=C.tokenizer_file(P.DEFAULT_MODEL))
    segments = P.Segments(P.AgendaBpe(library), library)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(30):
        text = "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(20_000)) + " plain words"
        assert segments.of(text) == library.encode(text)
    text = "word " * 200_000
    assert segments.of(text) == library.encode(text)
    assert max(map(len, segments)) <= P.CACHED_CHARS and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
