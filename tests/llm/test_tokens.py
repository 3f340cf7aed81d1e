from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserine.llm import tokens

from .fixtures import edge_texts

PATH = tokens.default_path()
REAL = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ éÉßÿ'.,;!<|>0129\n\t\x0b\x1ć  Σσ")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
@example(["ΑΣ ΑΣΑ", "İ i̇", "don't WE'LL l'été", "a<|endoftext|>b <|startoftext|>"])
def test_ids_equal_those_of_the_whole_tokenizer(texts):
    coder = tokens.encoder(PATH)
    assert [x.tolist() for x in coder.encode_many(texts)] == [REAL.encode(t, add_special_tokens=False).ids for t in texts]


def test_edge_texts():
    coder = tokens.Encoder(PATH, size=50)  # the cache is emptied again and again
    for text, ids in zip(edge_texts(), coder.encode_many(edge_texts()), strict=True):
        assert ids.tolist() == REAL.encode(text or "", add_special_tokens=False).ids
