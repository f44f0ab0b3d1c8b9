import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fixtures import documents, frame
from tidemill.llm import pieces
from tidemill.llm.langid import UND, LanguageModel, Spectrum, classifier, fit, identify, labelled_sample, predict
from tidemill.llm.q_documents import TOKENIZER


def test_codec_agrees_with_the_library_on_whole_texts(spark):
    rows = documents() + [(900, "  two  blanks  ", None, None), (901, "emoji 😀 \x07 bell", None, None), (902, "a" * 300, None, None)]
    found = frame(spark, rows).select("doc_id", "text", pieces.encoder(spark, TOKENIZER, keep_text=True)("text").alias("e")).collect()
    theirs = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    assert len(found) == len(rows)
    for r in found:
        assert list(r["e"]["ids"]) == theirs.encode(r["text"] or "") and r["e"]["n_tokens"] == len(r["e"]["ids"]) and r["e"]["parity"]
        assert r["e"]["decoded"] == theirs.decode(list(r["e"]["ids"])) and r["e"]["lossless"] == (r["e"]["decoded"] == (r["text"] or ""))


def test_codec_keeps_parity_on_whole_texts_with_literal_markers():
    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    theirs = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    hard = ["a▁ 😀 b", "mark▁ 中", "▁", "▁▁ x", " ▁x▁", "x ▁ ▁中", "▁ ", "a ▁\n▁ 😀▁ 😀 ▁"]
    ids, sizes, same = codec.encode(hard)
    assert same.all()
    for text, part in zip(hard, np.split(ids, np.cumsum(sizes)[:-1])):
        assert part.tolist() == theirs.encode(text)


def test_parity_shows_an_error_of_the_split():
    import re

    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    codec.words = re.compile(" ?[^ ]{1,3}| ")  # cuts inside of words
    assert codec.encode(["information about everything", "a b"])[2].tolist() == [False, True]


def test_codec_on_an_empty_table(spark):
    assert frame(spark, []).select(pieces.encoder(spark, TOKENIZER)("text")).count() == 0


def test_codec_decodes_as_the_tokenizer_and_forgets_within_its_bound(monkeypatch):
    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    whole = pieces.build(codec.model)
    monkeypatch.setattr(pieces, "MEMO_WORDS", 50)
    for k in range(6):
        batch = [f"some words {k} {j} and more{j}{k}" for j in range(20)] + ["", " ", "x▁y z"]
        ids, sizes, same = codec.encode(batch)
        assert same.all() and len(codec.memo) <= 200
        at = 0
        for text, n, decoded in zip(batch, sizes, codec.decode(ids, sizes)):
            assert ids[at:at + n].tolist() == whole.encode(text, add_special_tokens=False).ids
            assert decoded == whole.decode(ids[at:at + n].tolist(), skip_special_tokens=False)
            at += n


def test_codec_compares_arrays_and_learns_odd_words_among_plain_ones(monkeypatch):
    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    library, asked = codec.check, []

    class Check:
        def encode(self, texts, **kwargs):
            asked.append(library.encode(texts, **kwargs))
            return asked[-1]

    codec.check = Check()
    plain = [" ".join(f"word{k}{j}" for j in range(30)) for k in range(40)]
    odd = ["  a  b ", "c ", " ", "   ", "", "d▁e ▁", "word00  word11", " a\n ", "f"]
    for batch in (plain, odd, plain[:3] + odd + ["new1 new2  new3 ", "new4 new5"]):
        ids, sizes, same = codec.encode(batch)
        assert same.all() and all(isinstance(a, np.ndarray) for a in asked[-1])
        for text, part in zip(batch, np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == library.encode(text)


def test_codec_asks_the_memo_once_a_word_and_cuts_plain_texts_without_the_pattern():
    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    asked, looked = [], []

    class Memo(type(codec.memo)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

        def __contains__(self, word):
            looked.append(word)
            return super().__contains__(word)

    codec.memo = Memo(codec.memo.default_factory)
    batch = ["plain words, plain text", "  two  blanks ", "a▁b", "", " ", "plain\nwords x", "\u3000é 中 x"]
    words = [codec.cut(t) for t in batch]
    assert words[:5] == [["plain", "words,", "plain", "text"], ["  two", " blanks "], ["a", "b"], [], [" "]]
    for text, mine in zip(batch, words):
        assert "".join(" " + w for w in mine) == (" " + text.replace("▁", " ") if text else "")
        assert [" " + w for w in mine] == (pieces.WORDS.findall(" " + text.replace("▁", " ")) if text else [])
    for _ in range(2):
        ids, sizes, same = codec.encode(batch)
        assert same.all()
        for text, part in zip(batch, np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == codec.check.encode(text)
    assert asked == 2 * [w for mine in words for w in mine] and not looked
    assert list(codec.memo) == list(dict.fromkeys(w for mine in words for w in mine)) and len(codec.sizes) == len(codec.memo)


def test_codec_is_right_after_learning_was_broken_off(monkeypatch):
    with open(TOKENIZER, "rb") as f:
        codec = pieces.Codec(f.read(), 1)
    assert codec.encode(["some words"])[2].all()
    with monkeypatch.context() as m:
        m.setattr(codec, "heads", ~codec.heads)  # no word begins where it should
        with pytest.raises(AssertionError):
            codec.encode(["more words and yet more", "  odd  ones "])
    ids, sizes, same = codec.encode(["yet more words and", "  odd  ones ", "some"])
    assert same.all() and ids.tolist() == [i for t in ("yet more words and", "  odd  ones ", "some") for i in codec.check.encode(t)]


def test_unigram_models_keep_their_scores(tmp_path):
    # a hand-made unigram model file: pieces with scores and byte fallback off
    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + payload

    def piece(text, score, kind):
        import struct

        raw = text.encode()
        body = field(1, 2, bytes([len(raw)]) + raw) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    vocabulary = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("▁ab", -0.9, 1), ("ba", -1.2, 1)]
    trainer = field(3, 0, b"\x01")
    norm = field(1, 2, b"\x08identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00")
    raw = b"".join(piece(*p) for p in vocabulary) + field(2, 2, bytes([len(trainer)]) + trainer) + field(3, 2, bytes([len(norm)]) + norm)
    codec = pieces.Codec(raw, 1)
    assert codec.model.kind == pieces.UNIGRAM
    ids, sizes, same = codec.encode(["ab aba", "b", ""])
    assert same.all() and sizes.tolist()[2] == 0


def test_language_accuracy_on_held_out_rows_and_edge_cases(spark):
    rows = documents(2) + documents(3)
    docs = frame(spark, rows)
    found = docs.select("doc_id", "lang", "text", identify(docs, F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False)))("text").alias("p")).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r["lang"] and r["text"] and r["doc_id"] is not None and r["doc_id"] % 3 == 1 and 0 < r["doc_id"] < 300]
    assert sum(r["lang"] == r["p"]["lang"] for r in held) >= 0.9 * len(held)
    for r in found:
        letters = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["p"]["lang"] == UND) == (not letters) and 0 <= r["p"]["score"] <= 1


def test_language_kernel_equals_a_plain_count(spark):
    docs = frame(spark, documents())
    model = fit(labelled_sample(docs, F.lit(True)), landmarks=6)
    assert isinstance(model, LanguageModel)
    from tidemill.llm.langid import Spectrum, kernel

    def grams(text):
        s, last = [], " "
        for c in " " + text.lower() + " ":
            c = c if c.isalpha() else " "
            if not (c == " " and last == " " and s):
                s.append(c)
            last = c
        s = "".join(s)
        return {g for n in (2, 3) for g in (s[i:i + n] for i in range(len(s) - n + 1))} | {c for c in s if c != " "}

    sample = sorted((r["lang"], r["n"], r["text"]) for r in labelled_sample(docs, F.lit(True)).collect())
    marks = [t for lang, n, t in sample if n <= max(2, 6 // len(model.langs))]
    got = kernel(model, Spectrum(model.letters), ["abc fed", marks[0]])
    for text, row in zip(["abc fed", marks[0]], got):
        for mark, value in zip(marks, row):
            a, b = grams(text), grams(mark)
            assert abs(value - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-6


def test_languages_of_large_scripts_are_told_apart(spark):
    import random

    rng = random.Random(4)
    starts = {"h1": 0x4E00, "h2": 0x5E00, "k1": 0xAC00, "k2": 0xBC00, "e1": 0x1200}  # letters of Han, Hangul and Ethiopic
    rows = []
    for k in range(150):
        lang = sorted(starts)[k % 5]
        text = " ".join("".join(chr(starts[lang] + rng.randrange(60)) for _ in range(3)) for _ in range(60))
        rows.append((k, text, lang, "s0"))
    docs = frame(spark, rows)
    model = fit(labelled_sample(docs, F.col("doc_id") < 100))
    langs, _ = predict(model, Spectrum(model.letters), [t for _, t, *_ in rows[100:]])
    assert langs == [lang for _, _, lang, _ in rows[100:]]
    codes = Spectrum("").codes("中国 中")
    assert len(codes) == 2 + 4 + 4 and len(set(Spectrum("").codes("a")) & set(Spectrum("").codes("b"))) == 0


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "abc", None, None), (2, None, "aa", None)])
    assert {r["p"]["lang"] for r in docs.select(identify(docs, F.lit(True))("text").alias("p")).collect()} == {UND}
    empty = frame(spark, [])
    assert empty.select(identify(empty, F.lit(True))("text").alias("p")).count() == 0
    assert classifier(spark, None) is not None


def test_every_labelled_language_is_learned(spark):
    """Rows with one id, one text many times, and languages that have only long texts."""
    import random

    rng = random.Random(8)

    def text(start, n):
        return " ".join("".join(chr(start + rng.randrange(20)) for _ in range(4)) for _ in range(n))

    rows = [(None, text(0x4E00, 30), "hh", "s0") for _ in range(800)] + [(k, text(0x61, 30), "aa", "s0") for k in range(800)]
    rows += [(9, "слово одно и то же", "cc", "s0")] * 800 + [(5000 + k, text(0xAC00, 6_000), "kk", "s0") for k in range(3)]
    docs = frame(spark, rows)
    sample = labelled_sample(docs, F.lit(True)).collect()
    count = {lang: sum(r["lang"] == lang for r in sample) for lang in ("hh", "aa", "cc", "kk")}
    assert count == {"hh": 300, "aa": 300, "cc": 1, "kk": 3} and max(len(r["text"]) for r in sample) <= 20_000
    assert {lang: sum(r["lang"] == lang for r in labelled_sample(docs, F.lit(True), max_texts=40).collect()) for lang in count} == {"hh": 10, "aa": 10, "cc": 1, "kk": 3}
    model = fit(labelled_sample(docs, F.lit(True)))
    asked = [text(0x4E00, 20), text(0x61, 20), "то же слово", text(0xAC00, 3_000)]
    assert predict(model, Spectrum(model.letters), asked)[0] == ["hh", "aa", "cc", "kk"]
