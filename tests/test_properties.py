from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from letterloom.operators import embed, export, fonts
from letterloom.plans.service import BadRequest, doc_id_of, path_of

KEYS = "fZkhqwsSaz~;jdyin e,]&ंािर्क"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=KEYS, max_size=60))
def test_decoder_ends_and_places_signs(raw):
    out = fonts.Decoder()(raw)
    assert "Z" not in out and "f" not in out and "््" not in out


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_paths_stay_inside(name):
    root = Path("/tmp/letterloom-root")
    try:
        assert path_of(root, doc_id_of(name)).is_relative_to(root.resolve())
    except (BadRequest, UnicodeEncodeError):
        pass


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_embedding_has_length_one_or_nothing(text):
    [v] = embed.HashEmbedder(16).embed([text])
    assert len(v) == 16 and (abs(sum(x * x for x in v) - 1) < 1e-9 or not any(v))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\n", min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_paragraphs(parts):
    assert ["\n".join(p) for p in export.paragraphs("\n\n".join(parts))] == "\n\n".join(parts).strip().split("\n\n")
