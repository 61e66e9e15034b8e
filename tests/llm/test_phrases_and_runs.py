"""Phrase collocations, periodic runs and cached token counts against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from panelmill.llm import collocations, periodic, tokencache
from tests.llm.conftest import PROSE, SCHEMA

# --- collocations -----------------------------------------------------------------------------


def _plain_phrases(rows, least, share, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase on its own."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    candidates = {p for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for p in candidates:
        lang, *words = p
        a = f[p]
        inside = any(
            q[0] == lang and len(q) > len(p) and 100 * f[q] >= share * a and any(list(q[1 + i : 1 + i + len(words)]) == words for i in range(len(q)))
            for q in candidates
        )
        if not inside:
            cuts = [(1_000_000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(own[:top])]
    return sorted(ranked)


def _rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def _corpus(rng, n):
    words = ["a", "b", "C", "dé", "E", "f\xa0g", "中", "h"]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r\n", " ; "]) for _ in range(rng.randint(0, 60)))
        rows.append((f"{text}. {passage} x{i % 7}" if i % 3 == 0 else text, rng.choice(["en", "fr", None, "und"])))
    return [*rows, (None, "en"), ("", "en"), ("one", "de"), (" \t", "de")]


@pytest.mark.parametrize("hot", [5_000, 1])
def test_phrases_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "HOT", hot)  # 1: no word or node is dealt by node or edge
    monkeypatch.setattr(collocations, "_SLICE", 2_000)
    rows = _corpus(random.Random(hot), 240)
    frame = spark.createDataFrame([(i, t, lang, None, None) for i, (t, lang) in enumerate(rows)], SCHEMA)
    frame = frame.withColumns({c: F.lit("x") for c in ("w1", "bucket", "c", "f", "path", "row", "phrase")})
    assert _rows(collocations.phrases(frame, least=10, share=50, top=30)) == _plain_phrases(rows, 10, 50, 30)
    deal = collocations._deal(collocations._texts(frame, "text", "lang"))
    assert (bool(deal.words), bool(deal.nodes)) == (hot > 1, hot > 1)


def test_a_long_passage_becomes_one_path(spark):
    passage = " ".join(f"w{i}" for i in range(200))
    frame = spark.createDataFrame([(i, passage + f" end{i}", "en", None, None) for i in range(12)], SCHEMA)
    paths = collocations.compacted(collocations.build(frame, 10)).collect()
    assert {r.path for r in paths} == {"w0 w1 w2"}
    assert sorted(r.place for r in paths) == list(range(198))
    assert [r.w3 for r in paths if r["last"]] == ["w199"]
    assert {r.path_words for r in collocations.phrases(frame).filter("path_words is not null").collect()} == {200}


def test_counts_past_64_bits(spark):
    big = 3_000_000_000
    row = spark.range(1).select(collocations.score(F.lit(big), F.lit(big + 1), F.lit(big + 7)).alias("s")).first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_blocks_round_trip_and_add_up():
    one = collocations.Triples.of(["A b a b a b. c", "b a"])
    two = collocations.Triples.of(["a b a", ""])
    both = collocations.Triples.merged([t.packed(slice(None)) for t in (one, two)])
    plain = collocations.Triples.of(["A b a b a b. c", "b a", "a b a", ""])

    def named(t):
        name = lambda i: t.words[i] if i else None
        return {(name(a), name(b), name(c)): n for a, b, c, n in zip(*(x.tolist() for x in (t.one, t.two, t.three, t.count)))}

    assert named(both) == named(plain)


def test_phrases_of_empty_and_wordless_tables(docs):
    assert collocations.phrases(docs()).count() == 0
    assert collocations.phrases(docs((1, None), (2, ""), (None, " . ,"))).count() == 0


# --- periodic runs ----------------------------------------------------------------------------


def _plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                s = words[i : i + size]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repetitive(rng):
    letters = "abcde"[: rng.choice([1, 2, 3, 5])]
    words = []
    for _ in range(rng.randint(0, 5)):
        unit = [rng.choice(letters).encode() for _ in range(rng.randint(1, 9))]
        words += (unit * rng.randint(1, 7))[: rng.randint(1, 60)]
    return words


def test_runs_match_brute_force():
    rng = random.Random(2)
    texts = [_repetitive(rng) for _ in range(1_500)]
    assert periodic.runs(texts) == [_plain_runs(t) for t in texts]


def test_squares_are_previous_occurrences():
    """Each (end, distance, length): the longest strings whose last earlier end lies `distance` back."""
    rng = random.Random(5)
    words = [rng.randrange(2) for _ in range(60)]
    got = {(i, d): n for i, d, n in periodic.squares(words)}
    plain = {}
    for i in range(len(words)):
        for n in range(1, i + 1):
            ends = [e for e in range(n - 1, i) if words[e - n + 1 : e + 1] == words[i - n + 1 : i + 1]]
            if ends:
                plain[i, i - ends[-1]] = n
    assert got == plain


def test_stretches_spare_words_without_repeats():
    prose = PROSE.encode().split()
    assert periodic.stretches([prose, prose + [b"la"] * 9, [], prose + prose]) == [[], [(len(prose) - 1, len(prose) + 5, len(prose) + 8)], [], []]


def test_planted_repeats_follow_the_contract():
    for doc_id in range(3_000):
        h = zlib.crc32(str(doc_id).encode())
        words = [b"%d" % i for i in range(37)]
        if h % 10:
            assert periodic.planted(doc_id, words) == words
        else:
            a = h // 10 % 37
            p = 1 + (37 - a) // (3 + h // 10 % 8)
            assert periodic.planted(doc_id, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(37)]
    assert periodic.planted(None, [b"a"]) == [b"a"]


def test_run_rows_and_defined_cases(docs):
    long = "x y z " * 20_000
    rows = periodic.detect(docs((1, "q a b a b a b a b c"), (2, None), (3, ""), (None, "la\tla\nla la la la"), (1, "q a b a b a b a b c"), (4, long))).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 6
    one = by_id[1]
    assert (one.n_runs, one.start, one.length, one.period, one.exponent_milli) == (1, 1, 8, 2, 4_000)
    assert one.runs_sha256 == hashlib.sha256(b"1,8,2\n").hexdigest()
    assert one.collapsed_sha256 == hashlib.sha256(b"q a b c").hexdigest()
    none = hashlib.sha256(b"").hexdigest()
    for i in (2, 3):
        assert (by_id[i].n_runs, by_id[i].start, by_id[i].runs_sha256, by_id[i].collapsed_sha256) == (0, None, none, none)
    assert by_id[None].length == 6 and by_id[4].length == 60_000 and by_id[4].period == 3
    assert periodic.detect(docs()).count() == 0


def test_of_equal_runs_the_first_is_the_longest(docs):
    row = periodic.detect(docs((1, "a a a a a a b c d d d d d d"))).first()
    assert (row.n_runs, row.start, row.length) == (2, 0, 6)


# --- token counts -----------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(WORDS)


def _count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


#: Letters, marks, added tokens and white space that normalisation or cutting could get wrong.
BITS = (
    "a B İ J̌ ǰ ́ ̌ \x1c \x85 \xa0   ​ 's 'LL 1 23 ² <|endoftext|> <|startoftext|> <|ENDOFTEXT|> <| |> 中 ß ẞ 😀 . ... Σ σς é e ﬁ \x00 \x7f"
).split(" ") + [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r"]


def test_counts_by_pieces_are_the_librarys():
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(8_000)]
    folded = [re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ") for t in texts]
    own = tokencache.Tokenizer.of(WORDS)
    assert own.spaces
    assert tokencache.counts_of(folded, tokencache.Pieces(own)).tolist() == [_count(t) for t in texts]


def test_kept_counts_are_forgotten_and_stay_right(monkeypatch):
    monkeypatch.setattr(tokencache, "KNOWN", 50)
    pieces = tokencache.Pieces(tokencache.Tokenizer.of(WORDS))
    texts = [" ".join(f"w{i % 90}x é{i}" for i in range(j, j + 40)) for j in range(0, 400, 20)]
    assert tokencache.counts_of(texts, pieces).tolist() == [_count(t) for t in texts]


def _appended(spark, cache):
    return spark.read.schema(tokencache.CACHE).option("recursiveFileLookup", True).parquet(cache)


def test_the_cache_is_filled_once_and_told_apart_by_version(spark, docs, tmp_path):
    cache = str(tmp_path / "counts")
    own = tokencache.Tokenizer.of(WORDS)
    rows = [(1, "Hello  World"), (2, " Hello\tWorld\n"), (3, None), (4, ""), (None, "héllo"), (1, "Hello  World"), (5, "x <|endoftext|> y"), (6, "lorem ipsum " * 30_000)]
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in tokencache.counted(docs(*rows), own, cache).collect())
    assert got == sorted(((i or 0), len((t or "").encode()), _count(t)) for i, t in rows)
    assert _appended(spark, cache).count() == 5  # equal but for white space: one content
    again = tokencache.counted(docs((9, "Hello World"), (10, "new")), own, cache).collect()
    assert {r.doc_id: r.n_tokens for r in again} == {9: _count("Hello World"), 10: _count("new")}
    assert _appended(spark, cache).count() == 6
    # a planted count proves that hits are read, another tokenizer that versions are kept apart
    spark.createDataFrame([(own.digest, hashlib.sha256(b"planted").digest(), 777)], tokencache.CACHE).write.mode("append").parquet(f"{cache}/{own.digest}")
    assert tokencache.counted(docs((1, "planted")), own, cache).first().n_tokens == 777
    other = tokencache.Tokenizer.of(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.spaces and other.digest != own.digest
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = " planted  twice\n"
    assert tokencache.counted(docs((1, text)), other, cache).first().n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert tokencache.counted(docs(), own, cache).count() == 0


def test_sentence_pieces(docs, tmp_path):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello  world", "", "<s> été 中文 😀", PROSE]
    got = {r.doc_id: r.n_tokens for r in tokencache.counted(docs(*enumerate(texts)), tokencache.Tokenizer.of(path), str(tmp_path / "c")).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
