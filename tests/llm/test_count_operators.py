"""Spelling variants, token counts and collocations against plain Python and the library."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tickloom.llm import phrases, queries, spelling, token_automata
from tickloom.llm.common import table

SF = "/root/testdata/sf0.001"
SPEC = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(SPEC)


@pytest.fixture(scope="module")
def machine():
    with open(SPEC, encoding="utf-8") as f:
        return token_automata.TokenCounter(f.read())


def _counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def _odd_texts(n, seed=4):
    rng = random.Random(seed)
    parts = ["'", "s", "'s", "'re", "ll", "ve", " ", "  ", "\n", "\t", "a", "the", "ing", "1", "22", "!", "?.", "é", "日本", "𝒳",
             " ", " ", "<|endoftext|>", "<|endof", "''", "er", "İ", "½"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


# ---------------------------------------------------------------- token counts

def test_token_counts_equal_the_library(machine, library):
    texts = [*_odd_texts(4000), "a" * 4000, " " * 3000, "ab" * 2500, "\n" * 700, "'" * 500, "x1" * 4000, "\0", "�"]
    assert machine.count(texts).tolist() == _counts(library, texts)


def test_token_counts_hold_for_small_chunks_blocks_and_tables(machine, library, monkeypatch):
    texts = [*_odd_texts(600, 5), "a" * 300, "the ring " * 200]
    want = _counts(library, texts)
    for name, value in (("CHUNK", 3), ("CELLS", 9000), ("BLOCK_POINTS", 50), ("LANES", 30), ("FEW", 1)):
        monkeypatch.setattr(token_automata, name, value)
        assert machine.count(texts).tolist() == want, name
    assert len(machine.counter.states) * machine.counter.table.shape[1] < 10 * 9000


def test_chunk_maps_give_the_state_of_a_plain_walk(machine):
    split = machine.splitter
    text = "it's  'll\n\n we're 12 !'s " * 30
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.zeros(len(points), bool)
    ends[-1] = True
    state, want = token_automata.NEW, []
    for symbol in split.symbols(points, ends):
        want.append(split.begins[state, symbol])
        state = split.to[state, symbol]
    assert split.starts(points, np.array([len(points)])).tolist() == want


def test_token_count_columns(spark, library):
    rows = [(1, "one <|endoftext|> two", "x"), (1, "one <|endoftext|> two", "x"), (None, None, None), (3, "", "y"), (4, "w " * 50_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    got = token_automata.count_tokens(frame, SPEC).collect()
    assert [r.n_tokens for r in got] == _counts(library, [t or "" for _, t, _ in rows]) and got[0].asDict().keys() == {"doc_id", "text", "n_tokens"}
    assert token_automata.count_tokens(frame.limit(0), SPEC).count() == 0


def test_token_count_query_columns(spark, library):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    want = dict(zip(docs, _counts(library, list(docs.values()))))
    got = queries.op12_token_counts(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = got.collect()
    assert len(rows) == len(docs) and all(
        (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 512) for r in rows)


def test_unsupported_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        token_automata.TokenCounter(f.read())


# ---------------------------------------------------------------- spelling variants

def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _made_words(n, seed=1):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        word = [rng.choice("abé") for _ in range(rng.randrange(7, 12))]
        words.add("".join(word))
        at = rng.randrange(len(word))
        words.add("".join([*word[:at], rng.choice("abéz"), *word[at + rng.randrange(2):]]).ljust(7, "a"))
    return sorted(words)


@pytest.mark.parametrize("block, together", [(30_000, 8000), (9, 8000), (30_000, 40)])
def test_near_words_are_all_pairs_one_edit_apart(spark, monkeypatch, block, together):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "TOGETHER", together)
    words = _made_words(400)
    got = spelling.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint")).collect()
    want = {(a, b, words.index(b)) for a in words for b in words if _one_edit(a, b)}
    assert len(got) == len(want) > 100 and {(r.word, r.near, r.near_n) for r in got} == want


def test_suffix_ranks_find_whole_words_only():
    words = ["banana", "bananas", "ananas", "nab", "a"]
    index = spelling.SuffixRanks(words)
    which, hit = spelling.one_edit(index, ["banana", "bananas", "aananas", "zzzz"], np.array([3, 3, 3, 2]))
    assert {(int(a), words[b]) for a, b in zip(which, hit)} == {(1, "ananas"), (2, "ananas"), (2, "bananas")}  # banana and bananas differ at the end


def _plain_variants(docs, least=2, every=31):
    counts = Counter()
    for key, text in docs:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= least}
    forms, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if _one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = (n, len(near))
    def root(w):
        return root(forms[w]) if forms[w] else w
    return {(w, forms[w], root(w), *out[w], words[forms[w]] if forms[w] else None) for w in words}


def test_variants_with_odd_rows(spark):
    rng = random.Random(3)
    chain = ["corridor"] * 2 + ["corridors"] * 25 + ["corridorss"] * 260
    texts = [(i, " ".join(rng.sample(chain, 40)), "x") for i in range(60)] + [
        (None, "Corridor ÉTATSUNIS étatsunis ÉTATSUNIS", None), (7, None, "a"), (8, "", "b"), (None, "Corridor", "n"), (9, "a" * 30_000, "n")] * 2
    frame = spark.createDataFrame(texts, "doc_id int, text string, word string")
    got = spelling.group_variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
    want = _plain_variants([(k, t) for k, t, _ in texts])
    assert len(rows) == len(want) and set(rows) == want and any(r[1] for r in rows)
    assert spelling.group_variants(frame.limit(0)).count() == 0


def test_chains_of_forms_end_at_their_last_word(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)] + [("alone", None)]
    got = {r.word: r.root for r in spelling.follow_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w9" for i in range(9)}


# ---------------------------------------------------------------- collocations

def _plain_collocations(docs, least, covered=100, top=2000):
    counts, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in spelling.re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in spelling.re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    c = counts.setdefault(lang, Counter())
                    c[tuple(words[i:i + m])] += 1
    out = []
    for lang, c in counts.items():
        chosen = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            score, k = min((int(Fraction(1000 * a * total[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                       for q, b in chosen.items()):
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("size, bits, shards", [(24 << 20, 1 << 19, 8), (400, 64, 3), (400, 1 << 19, 20)])
def test_collocations_equal_plain_counting(spark, monkeypatch, size, bits, shards):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
    monkeypatch.setattr(phrases, "BLOCK_BITS", bits)
    monkeypatch.setattr(phrases, "SHARDS", shards)
    rng = random.Random(6)
    words = ["new", "york", "city", "Éa", "A b", "of", "the"]
    docs = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n"]) for _ in range(60)))
            for _ in range(40)] + [("en", "new york city of the"), ("de", ""), ("xx", None), (None, "..,,"), ("en", "the " * 500)] * 2
    frame = spark.createDataFrame([(i, t, lang, "q") for i, (lang, t) in enumerate(docs)], "doc_id int, text string, lang string, phrase string")
    frame = frame.repartition(5)
    got = [tuple(r) for r in phrases.mine_collocations(frame, min_count=12, top=30).collect()]
    want = _plain_collocations(docs, 12, top=30)
    assert sorted(got) == sorted(want) and len(want) > 40
    assert phrases.mine_collocations(frame.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counted = spark.createDataFrame([("en", "", 900_000_000_000_000), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)],
                                    "lang string, phrase string, a bigint")
    row = phrases.rank_collocations(counted, 100, 10).first()
    assert row.score == 1000 * (big - 1) * 900_000_000_000_000 // (big * (big + 1))


def test_words_and_pieces():
    assert phrases.split_words("A b,\tC\x0bÉ!") == [b"a", b"b", b"\xff", b"c", b"\xff", "É".encode(), b"\xff"]
