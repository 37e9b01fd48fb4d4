import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from cardloom.llm import tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {n: tokens.Encoder(public_tokenizers.path(n)) for n in NAMES}
CHARS = st.text(st.one_of(st.sampled_from(list("aZ19 .,!?'\n\t_-*#\x00éßİΣçñ\u0301\u00a0\u2003\u200b\x1c中")), st.characters(exclude_categories=["Cs"])), max_size=40)
ODD = ["", " ", "\n", "a  b", "a\n\nb", " a", "a ", "...", "it's, he'd. We'll", "x_.y", "don't.\nStop", "A.B,C", "a ,b", "!! ,.", "<|endoftext|> x", "a <|endoftext|> b", "a.<|endoftext|>.b", "<|endoftext |>", "<|startoftext|>", "e\u0301.", "a\x00b", "ΣΑΣ. ΣΑΣ", "1,000.5 %"]


PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}


def same(name, texts, encoder=None):
    """What the library, as it comes, gives for the whole texts."""
    ids, begin = (encoder or ENCODERS[name]).encode(texts)
    for t, own in enumerate(PLAIN[name].encode_batch(texts, add_special_tokens=False)):
        assert ids[begin[t] : begin[t + 1]].tolist() == own.ids, texts[t]


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(name):
    assert ENCODERS[name].shares
    same(name, ODD)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(CHARS, min_size=1, max_size=4))
def test_any_text(name, texts):
    same(name, texts)


@pytest.mark.parametrize("name", NAMES)
def test_documents_with_little_memory(spark, name, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    monkeypatch.setattr(tokens, "REMEMBERED", 5000)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for i in range(0, len(texts), 250):
        same(name, texts[i : i + 250], encoder)


def test_other_vocabularies_are_encoded_whole(tmp_path):
    """A pre-tokenizer under which the pieces of the other two would be wrong."""
    other = Tokenizer(models.BPE({"a": 0, "b": 1, " ": 2, "a ": 3, "a b": 4}, [("a", " "), ("a ", "b")]))
    other.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
    other.save(str(tmp_path / "other.json"))
    encoder = tokens.Encoder(str(tmp_path / "other.json"))
    texts = ["a b", "", "a a b", "b"]
    ids, begin = encoder.encode(texts)
    assert not encoder.shares and [ids[x:y].tolist() for x, y in zip(begin, begin[1:], strict=False)] == [other.encode(t).ids for t in texts]
    assert encoder.encode([])[1].tolist() == [0]


@pytest.mark.parametrize("name", NAMES)
def test_stops_behind_what_the_vocabulary_takes_for_marks(name):
    """Python calls these white space or letters; normalized, the library joins them with a stop."""
    for end in ("\x1c", "\x1d", "\x1e", "\x1f", "İ", "é", "क़", " ", "　", "_", "9", "中", "Ω"):
        same(name, [f"{end}.", f"a{end}.b", f"x {end}, {end}."])


@pytest.mark.parametrize("name", NAMES)
def test_pieces_that_differ_late_or_are_long(name):
    """Pieces are told apart by all their bytes; those longer than a key come back right in every call."""
    encoder = tokens.Encoder(public_tokenizers.path(name))
    stem = "w" * (8 * tokens.WORDS - 1)
    texts = [f"go {stem[:k]}{end}. {stem[:k]}{end}x, {stem}{end}{end} {stem}{end}{end}y" for k in (6, 7, 8, 15, 16, 30, 31) for end in "abé"]
    for _ in range(3):
        same(name, texts, encoder)
        held = len(encoder.hash.held)
        assert len(encoder.size.held) == len(encoder.start.held) == len(encoder.mark.held) == len(encoder.key.held) == held
        assert len(encoder.flat.held) == encoder.size.held.sum()


@pytest.mark.parametrize("name", NAMES)
def test_equal_hashes_are_not_taken_for_equal_pieces(name, monkeypatch):
    monkeypatch.setattr(tokens, "FACTORS", np.zeros(tokens.WORDS, dtype=np.uint64))
    texts = [" ".join(f"w{i * j}" for j in range(60)) + ".\nEnd" for i in range(5)]
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for _ in range(2):
        same(name, texts, encoder)


def test_repeated_pieces_are_encoded_once_and_outlast_others(monkeypatch):
    """Common pieces are not encoded again because rare ones filled the memory."""
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    encoder, asked = tokens.Encoder(public_tokenizers.path(NAMES[0])), []
    plain = encoder.tokenizer

    class Counting:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    for i in range(30):
        same(NAMES[0], ["x the of and " + " ".join(f"rare{i}q{j}" for j in range(100))], encoder)
    assert asked.count(" the") == 1 and asked.count(" rare7q7") == 1
    assert len(encoder.hash.held) <= 400 + 200


def test_arrow_columns_with_nulls_and_offsets():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["skipped", "a b.", None, "", "é,  .", "a\x00b"], kind).slice(1)
        for name in NAMES:
            ids, begin = ENCODERS[name].encode(column)
            want = [e.ids for e in PLAIN[name].encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == want
