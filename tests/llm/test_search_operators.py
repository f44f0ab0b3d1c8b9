"""Ranked search, the transducer lexicon and the conversation trie against plain versions of what is asked."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import documents, frame
from tidemill.llm import lexicon, ranked
from tidemill.llm.prefix_trie import numbered, rebuilt, trie
from tidemill.llm.registry import load

MODEL = "/opt/tokenizers/byte_bpe_50k.json"


# -- ranked search


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return ranked.TERM.findall(low)


def plain_search(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, words = len(counted), sum(x[2] for x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        asked = Counter(plain_terms(text))
        found = []
        for i, c, size in counted:
            m = 100 - 75 + 75 * size * n // words
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m))
                        for w, times in asked.items() if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return out


ITEMS = [(1, "One word two abc DEF abc"), (2, None), (3, "zzzzunknown"), (4, "12 34 ünï çödé"), (5, ""), (5, "abc def word")]


def items(spark, docs):
    some = ITEMS + [(10 + k, docs[k][1]) for k in range(8)] + [(30, docs[-1][1])]
    return some, spark.createDataFrame([(i, t, 7) for i, t in some], "item_id long, text string, score int")


def test_search_ranks_as_a_full_scan_does(spark):
    docs = documents()
    some, table = items(spark, docs)
    found = ranked.search(frame(spark, docs).repartition(5), table)
    want = plain_search([(d[0], d[1]) for d in docs], some)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    again = ranked.search(frame(spark, docs), table, k=3, group_chars=200)  # many groups of queries
    assert sorted(map(tuple, again.collect()), key=str) == sorted(plain_search([(d[0], d[1]) for d in docs], some, 3), key=str)


def test_search_on_empty_tables(spark):
    docs = documents()
    _, table = items(spark, docs)
    assert ranked.search(frame(spark, docs).limit(0), table).count() == 0
    assert ranked.search(frame(spark, docs), table.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_block_search_equals_all_scores(seed):
    rng = np.random.default_rng(seed)
    n, kinds = 400, 12
    there = rng.random((kinds, n)) < rng.choice([0.02, 0.3, 0.9], kinds)[:, None]
    there[:, 100:180] = there[:, 100:101]  # a group of copies
    terms, places = np.nonzero(there)
    tfs = rng.integers(1, 4, len(terms))
    tfs[(places >= 100) & (places < 180)] = 2
    sizes = rng.integers(50, 400, n)
    sizes[100:180] = 99
    weights = rng.integers(0, 9000, kinds)
    norm = ranked.sizes_to_norm(n, int(sizes.sum()))
    block = ranked.Block(list(range(n)), sizes, terms.astype(np.int32), places.astype(np.int32), tfs, weights, norm)
    asked, times = np.array([0, 2, 3, 5, 7, 11]), np.array([1, 1, 2, 1, 3, 1])
    full = np.zeros(n, dtype=np.int64)
    for t, x in zip(asked, times):
        mine = terms == t
        full[places[mine]] += x * weights[t] * (10 ** 9 * tfs[mine] // (1000 * tfs[mine] + 8 * norm(sizes)[places[mine]]))
    order = sorted((d for d in range(n) if full[d] > 0), key=lambda d: (-full[d], d))
    scores, docs = block.top(asked, times, 10)
    assert docs.tolist() == order[:10] and scores.tolist() == [full[d] for d in order[:10]]
    floor = int(full[order[9]])
    scores, docs = block.top(asked, times, 10, floor)
    assert docs.tolist() == order[:10]
    scores, docs = block.top(asked, times, 10, 1, 3)  # a probe yields scores of documents
    assert all(full[d] == s for d, s in zip(docs, scores))


def test_norms_beyond_64_bits():
    norm = ranked.sizes_to_norm(5 * 10 ** 10, 10 ** 13)
    assert norm(np.array([10 ** 8])).tolist() == [25 + 75 * 10 ** 8 * 5 * 10 ** 10 // 10 ** 13]


# -- lexicon


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    with open(MODEL, encoding="utf-8") as f:
        raw = f.read()
    tokenizer, _ = lexicon.load_tokenizer(raw)
    words = sorted({w for t in (" the of and a", " don't 12", "été où", "中文 字") for w in (t[a:b].encode() for a in range(len(t)) for b in range(a + 1, len(t) + 1))})
    path = tmp_path_factory.mktemp("lexicon") / "words.bin"
    path.write_bytes(lexicon.pack(*lexicon.compile_words(words), [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words], lexicon.point_classes()))
    return lexicon.Codec(raw, str(path)), words, tokenizer


def test_transducer_ranks_words_and_shares_suffixes(codec):
    made, words, _ = codec
    buf = np.frombuffer(b"".join(words + [w + b"x" for w in words] + [b"\xff", b"zz"]), dtype=np.uint8)
    sizes = [len(w) for w in words] + [len(w) + 1 for w in words] + [1, 2]
    known = {w: k for k, w in enumerate(words)}
    want = list(range(len(words))) + [known.get(w + b"x", -1) for w in words] + [-1, -1]
    assert made.lexicon.ranks(buf, np.concatenate(([0], np.cumsum(sizes)))).tolist() == want
    states, _ = lexicon.compile_words([b"stop", b"tap", b"taps", b"top", b"tops"])
    assert len(states) == len(set(states)) == 8  # minimal: no two states with the same words to come


def test_no_words_at_all(tmp_path, codec):
    path = tmp_path / "none.bin"
    path.write_bytes(lexicon.pack(*lexicon.compile_words([]), [], lexicon.point_classes()))
    with open(MODEL, encoding="utf-8") as f:
        made = lexicon.Codec(f.read(), str(path))
    ids, sizes = made.texts(["the cat", ""])
    assert ids.tolist() == codec[2].encode("the cat").ids and sizes.tolist() == [2, 0]


BITS = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", " ", "  ", "\n", "\t", "1", "é", "中", "😀", "!", "_", "　", "\xa0", "\x85", "\x1c",
        "<|endoftext|>", "<|", "՘", "ᲊ", "́", "²", "Ⅷ"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(BITS), max_size=25).map("".join), st.text(max_size=20)))
def test_ids_are_the_library_s(codec, text):
    made, _, tokenizer = codec
    ids, sizes = made.texts([text, "", text])
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and sizes.tolist() == [len(want), 0, len(want)]
    assert made.decode(ids, sizes)[0].decode() == tokenizer.decode(want, skip_special_tokens=False)


def test_long_texts_are_worked_on_in_pieces(codec, monkeypatch):
    made, _, tokenizer = codec
    rng = random.Random(1)
    text = "".join(rng.choice(BITS) for _ in range(4000)) + "x" * 3000
    monkeypatch.setattr(lexicon, "CUT", 64)
    ids, sizes = made.texts([text, text])
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want + want and sizes.tolist() == [len(want)] * 2


def test_queries_of_search_and_codec(spark, tmp_path, codec):
    docs = documents()
    frame(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    some, table = items(spark, docs)
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    queries, _ = load()
    tokenizer = codec[2]
    found = {tuple(r) for r in queries["op12_bpe"](spark, str(tmp_path)).collect()}
    want = set()
    for i, text, *_ in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
    assert found == want
    assert queries["op12_bpe"](spark, str(tmp_path)).count() == len(docs)
    ranks = [tuple(r) for r in queries["op11_ranked_search"](spark, str(tmp_path)).collect()]
    assert sorted(ranks, key=str) == sorted(plain_search([(d[0], d[1]) for d in docs], some), key=str)


def test_codec_keeps_ids_when_asked_and_takes_an_empty_table(spark):
    docs = frame(spark, documents())
    built = lexicon.build(docs, MODEL)
    rows = docs.select("text", lexicon.encoder(built, keep_ids=True)("text").alias("e")).select("text", "e.*").collect()
    tokenizer, _ = lexicon.load_tokenizer(open(MODEL, encoding="utf-8").read())
    assert all(r["ids"] == tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    none = docs.limit(0)
    assert none.select(lexicon.encoder(lexicon.build(none, MODEL))("text").alias("e")).count() == 0


# -- conversation trie


def plain_trie(rows, group=100, most=5):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    said = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in said.items()}
    members = defaultdict(list)
    for c in said:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        whole = said.get(c - int(math.fmod(c, group)), [])[:h] + said[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += own
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c, e in m if e))).encode()).hexdigest()) for p, m in members.items())


def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(98, 130), -3, -100, -150, 250]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(["hi", "so", "ünï 😀", ""]) if t < 4 else rng.choice("ab")))
    rows += [(300, t, "user", f"turn {t % 7}") for t in range(700)]  # long
    rows += [(301, t, "user", f"turn {t % 7}") for t in range(650)] + [(301, 650, "user", "end")]
    rows += [(400, 3, "user", "same")] * 40 + [(400, None, None, None), (400, None, "user", None), (None, 1, "user", "nobody's")]
    rows += [(500 + k, 0, "system", "shared") for k in range(1, 60)] + [(500 + k, 1, "user", "copy") for k in range(1, 60) if k % 3]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, conv int, part string, k1 string, depth string, chars int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "k", "d", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("height", [2, 16])
def test_trie_against_all_beginnings(spark, height):
    rows = conversations()
    found = trie(*rebuilt(numbered(turns(spark, rows).repartition(7)), 100, 5), height=height).drop("k1", "k2")
    assert sorted(map(tuple, found.collect())) == plain_trie(rows)


def test_conversation_query_and_an_empty_table(spark, tmp_path):
    rows = conversations()
    turns(spark, rows).write.parquet(f"{tmp_path}/some/conversations.parquet")
    turns(spark, []).write.parquet(f"{tmp_path}/none/conversations.parquet")
    query = load()[0]["op13_conversation_trie"]
    found = query(spark, f"{tmp_path}/some")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect())) == plain_trie(rows)
    assert query(spark, f"{tmp_path}/none").count() == 0
